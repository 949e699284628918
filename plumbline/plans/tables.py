"""The driver's tables and the property-graph projection over them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Lazy access to the tables of one folder, raw by name and as the domain's labels and relationships."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def nation(self) -> DataFrame:
        return self.raw("nation")

    @cached_property
    def politician(self) -> DataFrame:
        c = self.raw("customer").join(self.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        return c.select(F.col("c_custkey").alias("pol"), F.col("c_name").alias("name"), F.col("n_name").alias("state"), F.col("c_mktsegment").alias("party"), F.col("c_acctbal").alias("assets"), F.col("c_nationkey").alias("nk"))

    @cached_property
    def company(self) -> DataFrame:
        s = self.raw("supplier").join(self.nation, F.col("s_nationkey") == F.col("n_nationkey"))
        return s.select(F.col("s_suppkey").alias("comp"), F.col("s_name").alias("name"), F.col("n_name").alias("state"), F.col("s_acctbal").alias("capital"), F.col("s_nationkey").alias("nk"))

    @cached_property
    def contract(self) -> DataFrame:
        return self.raw("orders").select(F.col("o_orderkey").alias("contract"), F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("buyer"), F.col("o_custkey").alias("cust"), F.col("o_totalprice").alias("total"))

    @cached_property
    def won(self) -> DataFrame:
        """Company won contract: one row a pair, whatever the number of line items."""
        return self.raw("lineitem").groupBy(F.col("l_suppkey").alias("comp"), F.col("l_orderkey").alias("contract")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("amount"))

    @cached_property
    def awarded(self) -> DataFrame:
        """Contract awarded by ministry (the buyer's nation)."""
        return self.contract.join(self.politician.select(F.col("pol").alias("cust"), F.col("state").alias("ministry")), "cust").select("contract", "ministry")

    @cached_property
    def director(self) -> DataFrame:
        """None to three companies a person, a dozen for one in fifty, drawn by the person's number: rows grow with the people alone."""
        most = self.raw("supplier").agg((F.max("s_suppkey") + 1).alias("m"))
        seats = F.when(F.col("pol") % 50 == 0, 12).otherwise(F.col("pol") % 4).cast("int")
        drawn = self.politician.select("pol", F.explode(F.slice(F.sequence(F.lit(0), F.lit(11)), F.lit(1), seats)).alias("j")).crossJoin(F.broadcast(most))
        drawn = drawn.select("pol", ((F.col("pol") * 31 + F.col("j") * 7) % F.col("m")).alias("comp")).distinct()
        return drawn.join(self.company.select("comp"), "comp", "left_semi").select("pol", "comp")

    @cached_property
    def owns(self) -> DataFrame:
        """Rings of up to four suppliers of a nation: each owns the next, the last the first."""
        from pyspark.sql import Window

        w = Window.partitionBy("nk").orderBy("comp")
        s = self.company.select("comp", "nk", (F.row_number().over(w) - 1).alias("k")).withColumn("g", F.floor(F.col("k") / 4))
        g = Window.partitionBy("nk", "g").orderBy("comp")
        whole = Window.partitionBy("nk", "g")
        s = s.withColumn("dst", F.coalesce(F.lead("comp").over(g), F.min("comp").over(whole)))
        return s.filter("comp <> dst").select(F.col("comp").alias("src"), "dst")

    @cached_property
    def audit(self) -> DataFrame:
        d, l = self.raw("documents"), self.raw("labels")
        return d.join(l, "doc_id").select("doc_id", F.col("source").alias("scheme"), "lang", F.col("toxic").alias("flag"), (F.col("n_chars") / 100.0).alias("amount"))

    @cached_property
    def audit_title(self) -> DataFrame:
        """doc_id and title of the audits: they name a person, every fourth a company, by number."""
        named = None
        for df, key, fourth in ((self.politician.select(F.col("pol").alias("id"), "name"), "pol", False), (self.company.select(F.col("comp").alias("id"), "name"), "comp", True)):
            most = df.agg((F.max("id") + 1).alias("m"))
            own = self.raw("documents").join(self.raw("labels").select("doc_id"), "doc_id").select("doc_id").filter((F.col("doc_id") % 4 == 0) == F.lit(fourth))
            one = own.crossJoin(F.broadcast(most)).select("doc_id", ((F.col("doc_id") * 7) % F.col("m")).alias("id")).join(df, "id")
            one = one.select("doc_id", F.concat(F.lit("Audit of "), "name", F.lit(" and others")).alias("title"))
            named = one if named is None else named.union(one)
        return named

    @cached_property
    def event(self) -> DataFrame:
        return self.raw("events").select("event_id", "ts", F.col("user_id").alias("pol"), F.col("event_type").alias("kind"), "value", "props")


#: The same projection for the oracle.
DOMAIN_SQL = """
WITH RECURSIVE politician AS (SELECT c_custkey AS pol, c_name AS name, n_name AS state, c_mktsegment AS party, c_acctbal AS assets, c_nationkey AS nk FROM customer JOIN nation ON c_nationkey = n_nationkey),
company AS (SELECT s_suppkey AS comp, s_name AS name, n_name AS state, s_acctbal AS capital, s_nationkey AS nk FROM supplier JOIN nation ON s_nationkey = n_nationkey),
contract AS (SELECT o_orderkey AS contract, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS buyer, o_custkey AS cust, o_totalprice AS total FROM orders),
won AS (SELECT l_suppkey AS comp, l_orderkey AS contract, round(sum(l_extendedprice * (1 - l_discount)), 4) AS amount FROM lineitem GROUP BY 1, 2),
awarded AS (SELECT contract, state AS ministry FROM contract JOIN politician ON cust = pol),
director AS (SELECT DISTINCT pol, (pol * 31 + j * 7) % (SELECT max(s_suppkey) + 1 FROM supplier) AS comp FROM (SELECT pol, unnest(range(CASE WHEN pol % 50 = 0 THEN 12 ELSE pol % 4 END)) AS j FROM politician) WHERE (pol * 31 + j * 7) % (SELECT max(s_suppkey) + 1 FROM supplier) IN (SELECT comp FROM company)),
ring AS (SELECT comp, nk, (row_number() OVER (PARTITION BY nk ORDER BY comp) - 1) // 4 AS g FROM company),
owns AS (SELECT comp AS src, dst FROM (SELECT comp, coalesce(lead(comp) OVER (PARTITION BY nk, g ORDER BY comp), min(comp) OVER (PARTITION BY nk, g)) AS dst FROM ring) WHERE comp <> dst),
audit AS (SELECT d.doc_id, source AS scheme, lang, toxic AS flag, n_chars / 100.0 AS amount FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
audit_title AS (SELECT doc_id, 'Audit of ' || name || ' and others' AS title FROM audit JOIN politician ON doc_id % 4 <> 0 AND pol = doc_id * 7 % (SELECT max(pol) + 1 FROM politician) UNION ALL SELECT doc_id, 'Audit of ' || name || ' and others' FROM audit JOIN company ON doc_id % 4 = 0 AND comp = doc_id * 7 % (SELECT max(comp) + 1 FROM company)),
event AS (SELECT event_id, ts, user_id AS pol, event_type AS kind, value, props FROM events)
"""
