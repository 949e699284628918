"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets. Sources in code-point order, null last, weigh WEIGHTS in turn and share the total
size; a target stops at MOST times its source's size and the excess is shared again by
weight until none is above (the fixed point is min(cap, level x weight), found by sorting
caps by cap / weight).

Blocks. A source's rows fall into blocks by a hash of doc_id. Its target is a number of
whole passes over its blocks and part of one more pass: so many block draws are its quota.

Tree. The sources' blocks and quotas are dealt to the output shards by a splitting tree: a
node holds a number of blocks of each source and, of these, the quota of the last pass; the
blocks of its left child are one multivariate hypergeometric draw over the sources, and the
quota goes with them by one hypergeometric draw a source. At the leaves each shard knows
exactly how many blocks of each source are its own and how many of them it draws.

Draws. In each pass a source's blocks are permuted anew and cut into the shards' own runs, so
shards are disjoint. In a whole pass every shard draws its run; in the last one it draws the
first of its run, as many as its quota. Documents are taken whole: the last pass ends inside
one boundary block (which the quotas' words leave open), where documents are taken in hash
order as long as they fit; a document is taken at most MOST times, and a source misses its
target by less than its smallest document left out. Each shard orders its rows by a hash.

Scale. Rows are read once into narrow ones (id, source, size, block), written to the shared
folder; sums go by (source, block), so a source with a third of all rows is spread over its
blocks. There are at most MOST_BLOCKS blocks whatever the rows, so that windows over a
source's blocks and passes stay small; only the rows of boundary blocks (one a source) reach
a grouped function. The tree needs one row per source. Equal seeds give equal results.

Defined results: a null or empty text has size 0, is taken as often as its block, and adds
nothing; a null source is a source; repeated rows of one doc_id are taken together; an
empty table gives an empty mix; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import WORD, cut, text_of

WEIGHTS = (5, 2, 1)
MOST = 3
#: Rows of a block, on average, until there are MOST_BLOCKS of them.
BLOCK_ROWS = 1024
MOST_BLOCKS = 65_536
#: Rows of a shard, on average, within LEAST_SHARDS and MOST_SHARDS.
SHARD_ROWS = 50_000
LEAST_SHARDS, MOST_SHARDS = 8, 4_096
SEED = 20_240_501


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def hashed(seed: int) -> Column:
    return F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size and target from one row (source, source_size) per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    ranked = sizes.withColumn("_place", F.row_number().over(order) - 1).withColumn("_weight", F.element_at(weights, (F.col("_place") % len(WEIGHTS) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", (MOST * F.col("source_size")).cast("double"))
    full = Window.orderBy(F.col("_cap") / F.col("_weight"), "_place").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    zero = F.lit(0.0)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(full), zero)) / (F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(full), zero))
    found = ranked.withColumn("_level", level)
    # the first source in that order which the level leaves below its cap sets the level for all
    fits = F.when(F.col("_level") * F.col("_weight") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_weight"), F.col("_place"), F.col("_level").alias("level")))
    found = found.withColumn("_final", F.min(fits).over(every)["level"])
    return found.select("source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_final"), zero) * F.col("_weight")).alias("target"))


def split_quotas(blocks: np.ndarray, quotas: np.ndarray, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows: shards; columns: sources; exact shares of the blocks, and of the quotas (at most the blocks), by recursive hypergeometric halving."""
    rng = np.random.default_rng(seed)
    own, drawn = np.zeros((shards, len(blocks)), np.int64), np.zeros((shards, len(blocks)), np.int64)

    def divide(left: int, right: int, held: np.ndarray, quota: np.ndarray) -> None:
        if right - left == 1:
            own[left], drawn[left] = held, quota
            return
        middle = (left + right) // 2
        rest = int(held.sum())
        want = rest * (middle - left) // (right - left)
        first, part = np.zeros_like(held), np.zeros_like(held)
        # one multivariate draw as its chain of conditional draws, which has no bound on the number of sources
        for k in np.flatnonzero(held):
            n = int(held[k])
            first[k] = rng.hypergeometric(n, rest - n, want) if want else 0
            rest, want = rest - n, want - int(first[k])
            # the quota's blocks among the left child's
            part[k] = rng.hypergeometric(int(quota[k]), n - int(quota[k]), int(first[k])) if first[k] else 0
        divide(left, middle, first, part)
        divide(middle, right, held - first, quota - part)

    divide(0, shards, blocks.astype(np.int64), quotas.astype(np.int64))
    return own, drawn


def fill(sizes: np.ndarray, room: float) -> np.ndarray:
    """Which of the sizes, in order, to take: each that still fits, and at the end the smallest left out if that comes nearer."""
    taken = np.zeros(len(sizes), bool)
    for k, s in enumerate(sizes):
        if s <= room:
            taken[k] = True
            room -= s
    left = np.flatnonzero(~taken)
    if len(left) and room > 0:
        k = left[np.argmin(sizes[left])]
        taken[k] = sizes[k] < 2 * room
    return taken


def blocks_of(n_rows: int, block_rows: int) -> int:
    return min(MOST_BLOCKS, max(1, -(-n_rows // block_rows)))


def shards_of(n_rows: int) -> int:
    return min(MOST_SHARDS, max(LEAST_SHARDS, -(-n_rows // SHARD_ROWS)))


def draw(docs: DataFrame, shards: int | None = None, block_rows: int = BLOCK_ROWS, seed: int = SEED) -> tuple[DataFrame, DataFrame, int, int]:
    """(rows, draws, blocks, shards): rows has doc_id, source, size, block, h, source_size and target of every row of docs;
    draws has for each (source, block) taken at all an array of structs (pass, shard, chosen): `chosen` is null where the whole block is drawn, else the hashes of the documents drawn."""
    n_rows = docs.count()
    n_blocks, shards = blocks_of(n_rows, block_rows), shards or shards_of(n_rows)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text_of()).alias("size"))
    base = cut(narrow.withColumn("h", hashed(seed)).withColumn("block", F.pmod("h", F.lit(n_blocks)).cast("int")))
    blocks = cut(base.groupBy("source", "block").agg(F.sum("size").alias("block_size")))
    sizes = blocks.groupBy("source").agg(F.sum("block_size").alias("source_size"), F.count(F.lit(1)).alias("blocks"))
    numbers = sizes.select(F.col("source").alias("_source"), "blocks")
    sources = targets(sizes.drop("blocks"))
    whole = F.least(F.lit(MOST), F.floor(F.col("target") / F.col("source_size"))).cast("int")
    sources = sources.withColumn("whole", F.when(F.col("source_size") > 0, whole).otherwise(0))
    sources = sources.withColumn("rest", F.when(F.col("whole") < MOST, F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))).otherwise(0.0))
    sources = sources.join(numbers, sources.source.eqNullSafe(numbers._source)).drop("_source")
    # the last pass's draws of a source, its boundary block included
    share = F.when(F.col("source_size") > 0, F.ceil(F.col("rest") * F.col("blocks") / F.col("source_size"))).otherwise(0)
    sources = sources.withColumn("quota", F.least(share, F.col("blocks")))

    def split(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("source", na_position="last", ignore_index=True)
        own, drawn = split_quotas(frame.blocks.to_numpy(), frame.quota.to_numpy(), shards, seed)
        return frame.drop(columns="_all").assign(ends=list(own.cumsum(axis=0).T), drawn=list(drawn.T))

    columns = "source string, source_size long, target double, whole int, rest double, blocks long, quota long"
    sources = sources.selectExpr(*[f"cast({c.split()[0]} as {c.split()[1]}) {c.split()[0]}" for c in columns.split(", ")])
    sources = cut(sources.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(split, f"{columns}, ends array<long>, drawn array<long>"))

    # every pass of every block, in the order of that pass, cut into the shards' runs
    passes = blocks.join(sources, blocks.source.eqNullSafe(sources.source)).select(blocks.source, "block", "block_size", "whole", "rest", "ends", "drawn", F.explode(F.sequence(F.lit(0), F.col("whole"))).alias("pass"))
    order = Window.partitionBy("source", "pass").orderBy(F.xxhash64("block", "pass", F.lit(seed)), "block")
    passes = passes.withColumn("rank", F.row_number().over(order) - 1).withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("rank"))))
    place = F.col("rank") - F.when(F.col("shard") > 0, F.get("ends", F.col("shard") - 1)).otherwise(0)
    passes = passes.withColumn("spare", place >= F.get("drawn", F.col("shard"))).drop("ends", "drawn")
    # the last pass takes the blocks that the shards draw, until the target's words are reached
    taking = Window.partitionBy("source", "pass").orderBy("spare", "rank").rowsBetween(Window.unboundedPreceding, 0)
    room = F.col("rest") - (F.sum("block_size").over(taking) - F.col("block_size"))
    passes = passes.withColumn("left", room)
    last = F.col("pass") == F.col("whole")
    taken = passes.withColumn("room", F.when(last & (F.col("block_size") > F.col("left")), F.col("left"))).filter(~last | (F.col("left") > 0))
    taken = cut(taken.select("source", "block", "pass", "shard", "room"))

    boundary = taken.filter("room is not null").select("source", "block", "pass", "room")
    units = base.join(boundary.hint("shuffle_hash"), base.source.eqNullSafe(boundary.source) & (base.block == boundary.block)).select(base.source, base.block, "pass", "room", "h", "size")
    units = units.groupBy("source", "block", "pass", "room", "h").agg(F.sum("size").alias("size"))

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("h", ignore_index=True)
        found = fill(frame["size"].to_numpy(), float(frame.room.iloc[0]))
        return pd.DataFrame({"source": [frame.source.iloc[0]], "block": [frame.block.iloc[0]], "pass": [frame["pass"].iloc[0]], "chosen": [frame.h.to_numpy()[found]]})

    chosen = units.groupBy("source", "block", "pass").applyInPandas(choose, "source string, block int, pass int, chosen array<long>")
    drawn = taken.join(chosen, taken.source.eqNullSafe(chosen.source) & (taken.block == chosen.block) & (taken["pass"] == chosen["pass"]), "left")
    drawn = drawn.select(taken.source, taken.block, taken["pass"], "shard", F.when(F.col("room").isNotNull(), F.coalesce("chosen", F.array().cast("array<long>"))).alias("chosen"))
    draws = cut(drawn.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard", "chosen"))).alias("draws")))
    rows = base.join(sources, base.source.eqNullSafe(sources.source)).select("doc_id", base.source, "size", "block", "h", "source_size", "target")
    return rows, draws, n_blocks, shards


def own_draws(h: Column) -> Column:
    """The draws that take a row with this hash."""
    return F.coalesce(F.filter("draws", lambda d: d["chosen"].isNull() | F.array_contains(d["chosen"], h)), F.array().cast("array<struct<pass:int,shard:int,chosen:array<bigint>>>"))


def mix_counts(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, times and shards (those that take it, by pass, comma-joined) of every row of docs."""
    rows, draws, _, _ = draw(docs, **options)
    joined = rows.join(draws, rows.source.eqNullSafe(draws.source) & (rows.block == draws.block), "left")
    found = joined.select("doc_id", "size", "source_size", "target", own_draws(F.col("h")).alias("found"))
    times = F.size("found").cast("long")
    shards = F.array_join(F.transform("found", lambda d: d["shard"].cast("string")), ",")
    return found.select("doc_id", "size", "source_size", "target", (times * F.col("size")).alias("taken"), times.alias("times"), shards.alias("shards"))


def mix(docs: DataFrame, shards: int | None = None, block_rows: int = BLOCK_ROWS, seed: int = SEED) -> DataFrame:
    """The mix itself: the columns of docs, a row for each time it is taken, one shard a partition and each shard in an order of its own."""
    _, draws, n_blocks, shards = draw(docs, shards, block_rows, seed)
    keyed = docs.select(F.struct("*").alias("_row"), hashed(seed).alias("_h")).withColumn("_block", F.pmod("_h", F.lit(n_blocks)).cast("int"))
    joined = keyed.join(draws, F.col("_row.source").cast("string").eqNullSafe(draws.source) & (keyed._block == draws.block))
    out = joined.select("_row", "_h", F.explode(own_draws(F.col("_h"))).alias("_draw")).select("_row", "_draw.shard", F.xxhash64("_h", "_draw.pass", F.lit(seed + 1)).alias("_order"))
    return out.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "_order").select("_row.*")
