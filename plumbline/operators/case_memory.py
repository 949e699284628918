"""Case memory: cases are appended to a stored table with an index from finding types to signatures; similar cases and statistics come from these."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators.graph import settle
from plumbline.operators.investigate import FINDINGS, findings
from plumbline.plans.registry import query
from plumbline.plans.tables import Tables

CASE = "case_id long, types array<string>, outcome string, signature string"


def append_cases(cases: DataFrame, folder: str) -> None:
    """Adds cases (case_id, types: their finding types in any order, outcome: open, confirmed or false_positive)."""
    kept = F.sort_array(F.array_distinct("types"))
    cases.select(F.col("case_id").cast("long"), kept.alias("types"), "outcome", F.array_join(kept, ",").alias("signature")).write.mode("append").parquet(f"{folder}/cases")


def append_outcomes(outcomes: DataFrame, folder: str) -> None:
    """Adds outcomes (case_id, outcome, at): a case's last outcome by `at` replaces the one it was stored with."""
    outcomes.select(F.col("case_id").cast("long"), "outcome", F.col("at").cast("long")).write.mode("append").parquet(f"{folder}/outcomes")


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """case_id, types, signature and the last outcome of every case."""
    cases = spark.read.schema(CASE).parquet(f"{folder}/cases")
    # an empty write makes the folder where nothing was recorded yet
    spark.createDataFrame([], "case_id long, outcome string, at long").write.mode("append").parquet(f"{folder}/outcomes")
    last = spark.read.schema("case_id long, outcome string, at long").parquet(f"{folder}/outcomes").groupBy("case_id").agg(F.max_by("outcome", "at").alias("later"))
    return cases.join(last, "case_id", "left").select("case_id", "types", "signature", F.coalesce("later", "outcome").alias("outcome"))


def similar(probes: DataFrame, spark: SparkSession, folder: str, most: int = 5) -> DataFrame:
    """probe, case_id, overlap, outcome and place: for each probe (probe, types) the stored cases, but its own number, that share most finding types.

    Cases of one set of types overlap alike, so sets are compared, by their types, and of each only its first most + 1 cases go on."""
    cases = settle(stored(spark, folder))
    first = F.row_number().over(Window.partitionBy("signature").orderBy("case_id"))
    heads = settle(cases.withColumn("_k", first).filter(F.col("_k") <= most + 1).select("signature", "case_id", "outcome"))
    index = settle(cases.select("signature", "types").distinct().select("signature", F.explode("types").alias("type")))
    asked = settle(probes.select("probe", F.sort_array(F.array_distinct("types")).alias("types")).withColumn("asked", F.array_join("types", ",")))
    types = asked.select("asked", "types").distinct().select("asked", F.explode("types").alias("type"))
    overlap = types.join(index, "type").groupBy("asked", "signature").agg(F.count(F.lit(1)).cast("int").alias("overlap"))
    # per set of types asked for, the first cases of all sets: most + 1 are enough, as only the probe itself may drop out
    ranked = overlap.join(heads, "signature").withColumn("_k", F.row_number().over(Window.partitionBy("asked").orderBy(F.col("overlap").desc(), "case_id"))).filter(F.col("_k") <= most + 1)
    found = asked.select("probe", "asked").join(settle(ranked.drop("_k", "signature")), "asked").filter("probe <> case_id")
    place = F.row_number().over(Window.partitionBy("probe").orderBy(F.col("overlap").desc(), "case_id"))
    return found.withColumn("place", place).filter(F.col("place") <= most).select("probe", "case_id", "overlap", "outcome", "place")


def statistics(spark: SparkSession, folder: str) -> DataFrame:
    """type, cases, confirmed, false_positives and the share of confirmed among the decided, of every finding type."""
    each = stored(spark, folder).select("outcome", F.explode("types").alias("type"))
    n = lambda outcome: F.count(F.when(F.col("outcome") == outcome, 1))
    x = each.groupBy("type").agg(F.count(F.lit(1)).alias("cases"), n("confirmed").alias("confirmed"), n("false_positive").alias("false_positives"))
    decided = F.col("confirmed") + F.col("false_positives")
    return x.withColumn("precision", F.round(F.when(decided > 0, F.col("confirmed") / decided), 4))


def remembered(t: Tables) -> str:
    """The findings as cases in a new folder, in two appended batches; later outcomes for every fifth of them."""
    from plumbline.operators.graph import shared_folder

    folder = f"{shared_folder(t.spark)}/plumbline-cases/{uuid.uuid4().hex}"
    grave = F.count(F.when(F.col("severity").isin("HIGH", "VERY_HIGH"), 1))
    cases = settle(findings(t).groupBy(F.col("pol").alias("case_id")).agg(F.collect_set("type").alias("types"), grave.alias("grave")))
    cases = cases.withColumn("outcome", F.when(F.col("grave") >= 3, "confirmed").when(F.col("grave") == 0, "false_positive").otherwise("open"))
    for k in (0, 1):
        append_cases(cases.filter(F.col("case_id") % 2 == k), folder)
    append_outcomes(cases.filter("case_id % 5 = 0").select("case_id", F.lit("false_positive").alias("outcome"), F.lit(1).alias("at")), folder)
    append_outcomes(cases.filter("case_id % 10 = 0").select("case_id", F.lit("confirmed").alias("outcome"), F.lit(2).alias("at")), folder)
    return folder


_CASES = FINDINGS + ", cs2 AS (SELECT pol AS case_id, list(DISTINCT type) AS types, count(*) FILTER (severity IN ('HIGH', 'VERY_HIGH')) AS grave FROM f GROUP BY pol), ca AS (SELECT case_id, types, CASE WHEN case_id % 10 = 0 THEN 'confirmed' WHEN case_id % 5 = 0 THEN 'false_positive' WHEN grave >= 3 THEN 'confirmed' WHEN grave = 0 THEN 'false_positive' ELSE 'open' END AS outcome FROM cs2)"


@query("dt32_case_memory", _CASES + ", o AS (SELECT a.case_id AS probe, b.case_id, len(list_intersect(a.types, b.types)) AS overlap, b.outcome FROM ca a JOIN ca b ON a.case_id <> b.case_id) SELECT probe, case_id, CAST(overlap AS INTEGER) AS overlap, outcome, CAST(row_number() OVER (PARTITION BY probe ORDER BY overlap DESC, case_id) AS INTEGER) AS place FROM o WHERE overlap > 0 QUALIFY row_number() OVER (PARTITION BY probe ORDER BY overlap DESC, case_id) <= 5")
def case_memory(t: Tables) -> DataFrame:
    """For every case the stored cases that are most like it."""
    folder = remembered(t)
    return similar(stored(t.spark, folder).select(F.col("case_id").alias("probe"), "types"), t.spark, folder)


@query("ag24_case_outcomes", _CASES + " SELECT type, count(*) AS cases, count(*) FILTER (outcome = 'confirmed') AS confirmed, count(*) FILTER (outcome = 'false_positive') AS false_positives, round(CASE WHEN count(*) FILTER (outcome <> 'open') > 0 THEN count(*) FILTER (outcome = 'confirmed') / count(*) FILTER (outcome <> 'open') END, 4) AS precision FROM (SELECT outcome, unnest(types) AS type FROM ca) GROUP BY type")
def case_outcomes(t: Tables) -> DataFrame:
    """How often each finding type was confirmed and refuted."""
    return statistics(t.spark, remembered(t))
