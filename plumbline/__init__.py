"""plumbline: a Spark-first engine for public-record graph analytics."""
