"""A stored inverted index: postings are written once, by word and block of entries, with the bounds that let a ranked search skip blocks.

Layout below a folder: `postings/batch=/bucket=` holds rows (w, block, label, id, n, length), sorted by word within a bucket of words, so a
search reads its words' buckets and, by the files' statistics, little else of them; `blocks/bucket=` holds for each word and block of
entries how many entries have the word, the largest n and the least length; `sizes` holds each batch's number of entries and words. A new
batch is appended to all three; `compact` rewrites a grown index as one."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.graph import settle, shared_folder
from plumbline.operators.search import B, K1, _named_sql, named_entries
from plumbline.plans.registry import query
from plumbline.plans.tables import Tables

BUCKETS = 32
#: Blocks of entries: the unit of skipping, so entries over this is what a skipped block saves.
BLOCKS = 256
#: Blocks whose postings are read in the first round.
FIRST = 8
TOP = 20


def _bucket(w: Column) -> Column:
    return F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")


POSTINGS = "label string, id string, block int, length int, w string, n long"
#: Ranges of blocks to which a bucket's postings are dealt.
SLICES = 16
#: Postings of one Arrow batch.
ROWS = 100_000


def append(entries: DataFrame, folder: str) -> None:
    """Adds entries (label, id, text); an entry is added once. Its words are counted where it is read, and only its postings are shuffled, once."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A posting for each different word of each entry (label, id, block, length, ws)."""
        for batch in batches:
            ws = batch.column("ws")
            found = pa.table({"at": pc.list_parent_indices(ws), "w": pc.list_flatten(ws)}).group_by(["at", "w"]).aggregate([([], "count_all")]).combine_chunks()
            own = batch.select(["label", "id", "block", "length"]).take(found["at"].combine_chunks())
            n = found["count_all"].combine_chunks().cast("int64")
            for start in range(0, len(n), ROWS):
                rows = slice(start, start + ROWS)
                yield pa.record_batch([*(c[rows] for c in own.columns), found["w"].combine_chunks()[rows], n[rows]], ["label", "id", "block", "length", "w", "n"])

    split = F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "")
    # dealt anew, as a file may be few row groups
    x = entries.repartition("label", "id").select("label", "id", split.alias("ws")).filter(F.size("ws") > 0)
    x = x.select("label", "id", F.pmod(F.xxhash64("label", "id"), F.lit(BLOCKS)).cast("int").alias("block"), F.size("ws").alias("length"), "ws")
    written = _write(x.mapInArrow(counted, POSTINGS), folder)
    # an entry's counts add up to its length
    size = written.agg(F.round(F.coalesce(F.sum(F.col("n") / F.col("length")), F.lit(0.0))).cast("long").alias("entries"), F.coalesce(F.sum("n"), F.lit(0)).alias("words"))
    size.write.mode("append").parquet(f"{folder}/sizes")


def _write(postings: DataFrame, folder: str) -> DataFrame:
    """The postings as written, in a folder of their own below postings/; their blocks are counted from there."""
    path = f"{folder}/postings/batch=b{uuid.uuid4().hex}"
    # a bucket's words go to ranges of blocks, so that a word that very many entries hold is in several files
    dealt = postings.repartition(_bucket(F.col("w")), F.col("block") % SLICES).withColumn("bucket", _bucket(F.col("w")))
    dealt.sortWithinPartitions("bucket", "w", "block").write.partitionBy("bucket").parquet(path)
    written = postings.sparkSession.read.schema(dealt.schema).parquet(path)
    blocks = written.groupBy("bucket", "w", "block").agg(F.count(F.lit(1)).alias("held"), F.max("n").alias("most"), F.min("length").alias("least"))
    blocks.repartition("bucket").sortWithinPartitions("w").write.mode("append").partitionBy("bucket").parquet(f"{folder}/blocks")
    return written


def compact(spark: SparkSession, folder: str, into: str) -> None:
    """The whole index rewritten as one batch in another folder."""
    _write(spark.read.parquet(f"{folder}/postings").drop("batch", "bucket"), into)
    spark.read.parquet(f"{folder}/sizes").agg(F.sum("entries").alias("entries"), F.sum("words").alias("words")).write.parquet(f"{into}/sizes")


def _only(df: DataFrame, words: list[str]) -> DataFrame:
    """The rows of the words: their buckets' folders, and within these what the files' statistics leave."""
    buckets = [r[0] for r in df.sparkSession.createDataFrame([(w,) for w in words], "w string").select(_bucket(F.col("w"))).distinct().collect()]
    return df.filter(F.col("bucket").isin(buckets) & F.col("w").isin(words))


def _weight(n: Column, length: Column, mean: float) -> Column:
    return n * (K1 + 1) / (n + K1 * (1 - B + B * length / F.lit(mean)))


def search(spark: SparkSession, folder: str, words: list[str], most: int = TOP) -> tuple[DataFrame, dict[str, int]]:
    """The `most` best entries (label, id, score) by BM25, and how many blocks the words have and were read.

    A block's bound is the sum over the words of what its largest n and least length could give. Blocks are scored by falling bound, in
    rounds; once the next bound is below the worst score kept, no block can hold a better entry, and the postings of the rest are never
    read. Blocks are dealt by entry, so all of an entry's postings are in one."""
    words = sorted(set(words))
    size = spark.read.parquet(f"{folder}/sizes").agg(F.sum("entries").alias("e"), F.sum("words").alias("w")).first()
    if not words or not size or not size["e"]:
        return spark.createDataFrame([], "label string, id string, score double"), {"blocks": 0, "read": 0}
    total, mean = size["e"], size["w"] / size["e"]
    blocks = settle(_only(spark.read.parquet(f"{folder}/blocks"), words).groupBy("w", "block").agg(F.sum("held").alias("held"), F.max("most").alias("most"), F.min("least").alias("least")))
    # a row for each of the words asked for
    held = {r["w"]: r["df"] for r in blocks.groupBy("w").agg(F.sum("held").alias("df")).collect()}
    if not held:
        return spark.createDataFrame([], "label string, id string, score double"), {"blocks": 0, "read": 0}
    rare = spark.createDataFrame([(w, df) for w, df in held.items()], "w string, df long").withColumn("idf", F.log(1 + (F.lit(total) - F.col("df") + 0.5) / (F.col("df") + 0.5))).drop("df")
    bounds = blocks.join(F.broadcast(rare), "w").groupBy("block").agg(F.sum(F.col("idf") * _weight(F.col("most"), F.col("least"), mean)).alias("bound"))
    # at most BLOCKS rows
    order = [(r["block"], r["bound"]) for r in bounds.orderBy(F.col("bound").desc(), "block").collect()]

    def scored(chosen: list[int]) -> DataFrame:
        postings = _only(spark.read.parquet(f"{folder}/postings"), words).filter(F.col("block").isin(chosen)).join(F.broadcast(rare), "w")
        score = F.sum(F.col("idf") * _weight(F.col("n"), F.col("length"), mean))
        return postings.groupBy("label", "id").agg(F.round(score, 6).alias("score"))

    best = lambda df: df.orderBy(F.col("score").desc(), "label", "id").limit(most)
    found, floor, at, step, read = None, float("-inf"), 0, FIRST, 0
    # twice as many blocks each round, so few rounds; every round raises the floor that the next blocks must reach
    while at < len(order) and order[at][1] >= floor - 1e-5:
        chosen = [b for b, bound in order[at : at + step] if bound >= floor - 1e-5]
        found = settle(best(scored(chosen) if found is None else found.union(scored(chosen))))
        # at most `most` rows
        worst = found.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).first()
        floor = worst["s"] if worst["n"] >= most else floor
        at, step, read = at + step, 2 * step, read + len(chosen)
    return best(found), {"blocks": len(order), "read": read}


def all_entries(t: Tables) -> DataFrame:
    """label, id and text: the names of all labels, and the whole texts of audits and press releases."""
    texts = [t.raw("documents").select(F.lit("AuditReport").alias("label"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text"), t.raw("benchmark").select(F.lit("PressRelease"), F.concat(F.lit("b"), F.col("item_id").cast("string")), "text")]
    return reduce(DataFrame.union, [named_entries(t).select("label", "id", F.col("name").alias("text")).distinct(), *texts])


WORDS = ("nation_3", "steel", "the", "building", "brand#12")

_SQL = f""", e0 AS ({_named_sql()}), e AS (SELECT DISTINCT label, id, name AS text FROM e0 UNION ALL SELECT 'AuditReport', 'd' || doc_id, text FROM documents UNION ALL SELECT 'PressRelease', 'b' || item_id, text FROM benchmark), w AS (SELECT label, id, unnest(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')) AS w FROM e), l AS (SELECT label, id, count(*) AS length FROM w GROUP BY 1, 2), i AS (SELECT label, id, w, count(*) AS n FROM w WHERE w IN {WORDS} GROUP BY 1, 2, 3), m AS (SELECT count(*) AS docs, avg(length) AS mean FROM l), d AS (SELECT w, count(*) AS df FROM i GROUP BY w) SELECT label, id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM i JOIN l USING (label, id) JOIN d USING (w), m GROUP BY label, id ORDER BY score DESC, label, id LIMIT {TOP}"""


@query("se01_stored_index", _SQL)
def stored_search(t: Tables) -> DataFrame:
    """Ranked search over an index that is written for the tables in two batches, then read by its words alone."""
    folder = f"{shared_folder(t.spark)}/plumbline-index/{uuid.uuid4().hex}"
    e = all_entries(t)
    half = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    append(e.filter(half), folder)
    append(e.filter(~half), folder)
    return search(t.spark, folder, list(WORDS))[0]
