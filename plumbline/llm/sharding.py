"""Sharding by a hierarchical weighted hash tree.

Tree. A cluster is regions of racks of shards. A shard has a weight; a rack weighs as much as
its shards, a region as much as its racks. `tree(n)` lays n shards out: SHARDS of them in
regions of REGION_RACKS racks of RACK_SHARDS shards, and each further one in a region of its own.

Descent. A document descends from the root to a region, a rack and a shard. At each node every
child draws -ln(u) / weight, where u in (0, 1) comes from the hash of the doc_id and the
child's name, and the least draw wins. So a child wins in proportion to its weight, and its
draw depends on nothing but the doc_id, its own name and its own weight: where weights change,
only draws of changed nodes change. Documents move into grown subtrees or out of shrunk ones,
never between two subtrees that did not change, and those that stay in a subtree choose anew
only among its changed children. A further shard is a new region, so it takes rows from all
others in proportion and only into itself: the `key` law of the contract.

Slots. The rows of a shard are numbered from 0 in the order of the hash of (doc_id, size,
crc32). Equal rows are counted before the shuffle and numbered as one run; a run's rows are
made in pieces of PIECE. Runs are dealt to blocks, ranges of that hash; a block's first slot is
the sum of the blocks before it. So no shard, doc_id or text is numbered in one task.

Everything is built-in functions. A row costs one hash for each child of three nodes.

Defined results: doc_id alone decides, so repeated doc_ids share a shard and get slots of their
own; a null doc_id counts as the word `null`; a null text has no bytes, so its size is 8 and its
crc32 is 0; long texts are only measured; an empty table gives no rows. `place` keeps all columns of
docs and adds region, rack, shard and grown_shard, replacing columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import cut, text_of

SHARDS = 24
RACK_SHARDS = 4
REGION_RACKS = 2
#: Runs of rows that a block of slots holds, about.
BLOCK = 200_000
#: Equal rows that one task makes at once.
PIECE = 100_000

#: region -> rack -> shard -> weight
Tree = dict[str, dict[str, dict[int, float]]]


def tree(n: int = SHARDS) -> Tree:
    """n equal shards: the first SHARDS in full regions, each further one in a region of its own."""
    found: Tree = {}
    for s in range(n):
        region, rack = (f"r{s // (RACK_SHARDS * REGION_RACKS)}", f"k{s // RACK_SHARDS}") if s < SHARDS else (f"x{s}", f"x{s}")
        found.setdefault(region, {}).setdefault(rack, {})[s] = 1.0
    return found


def _node(name: str, weight: float, **more: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), F.lit(float(weight)).alias("weight"), *(c.alias(k) for k, c in more.items()))


def _literal(cluster: Tree) -> Column:
    """The tree as an array of regions, each with its racks, each with its shards; a subtree without weight is left out."""
    regions = []
    for region, racks in cluster.items():
        kept = []
        for rack, shards in racks.items():
            live = {s: w for s, w in shards.items() if w > 0}
            if live:
                kept.append((sum(live.values()), _node(f"rack {rack}", sum(live.values()), shards=F.array(*(_node(f"shard {s}", w, shard=F.lit(s)) for s, w in live.items())))))
        if kept:
            regions.append(_node(f"region {region}", sum(w for w, _ in kept), racks=F.array(*(c for _, c in kept))))
    if not regions:
        raise ValueError("no shard has a weight")
    return F.array(*regions)


def _winner(key: Column, children: Column, *fields: str) -> Column:
    """Of the children the one of the least draw (ties: the smaller name)."""

    def drawn(child: Column) -> Column:
        u = (F.conv(F.substring(F.md5(F.concat(key, F.lit(" "), child["name"])), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
        return F.struct((-F.log(u) / child["weight"]).alias("draw"), child["name"].alias("name"), *(child[f].alias(f) for f in fields))

    return F.array_min(F.transform(children, drawn))


def descend(doc_id: Column, cluster: Tree) -> Column:
    """Struct of region, rack and shard that the document comes to."""
    key = F.coalesce(doc_id.cast("string"), F.lit("null"))
    region = lambda at: _winner(key, at, "racks")
    # a one-element transform names what a level has chosen, so that it is drawn once
    step = F.transform(F.array(region(_literal(cluster))), lambda r: F.struct(r["name"].alias("region"), _winner(key, r["racks"], "shards").alias("rack")))
    step = F.transform(step, lambda r: F.struct(r["region"].alias("region"), r["rack"]["name"].alias("rack"), _winner(key, r["rack"]["shards"], "shard").alias("shard")))
    return F.transform(step, lambda r: F.struct(F.substring_index(r["region"], " ", -1).alias("region"), F.substring_index(r["rack"], " ", -1).alias("rack"), r["shard"]["shard"].cast("int").alias("shard")))[0]


def place(docs: DataFrame, cluster: Tree | None = None, grown: Tree | None = None) -> DataFrame:
    """docs with region, rack and shard, and grown_shard by the grown tree (one more shard, if none is given); no shuffle."""
    cluster = cluster or tree()
    grown = grown or tree(sum(len(s) for racks in cluster.values() for s in racks.values()) + 1)
    at = docs.drop("region", "rack", "shard", "grown_shard").withColumn("_at", descend(F.col("doc_id"), cluster))
    return at.select("*", F.col("_at.*"), descend(F.col("doc_id"), grown)["shard"].alias("grown_shard")).drop("_at")


def write_shards(docs: DataFrame, path: str, cluster: Tree | None = None, files: int = 1) -> None:
    """Writes docs as Parquet below path, partitioned by shard, each shard in about `files` files."""
    part = F.pmod(F.xxhash64("doc_id", text_of()), F.lit(files))
    placed = place(docs, cluster).drop("region", "rack", "grown_shard")
    placed.withColumn("_part", part).repartition("shard", "_part").drop("_part").write.partitionBy("shard").parquet(path)


def numbered(rows: DataFrame, shard: str, order: str) -> DataFrame:
    """rows (shard, order: a hex hash, n and more) with `start`, the sum of n of the rows of the shard that come before by order and the other columns."""
    rows = cut(rows)
    blocks = max(1, -(-rows.count() // BLOCK))
    # blocks are ranges of the hash, so they follow one another in its order
    block = F.floor(F.conv(F.substring(order, 1, 8), 16, 10).cast("long") * blocks / float(1 << 32)).cast("long")
    rows = rows.withColumn("_block", block)
    before = Window.partitionBy(shard).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(shard, "_block").agg(F.sum("n").alias("_n")).select(shard, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    rest = [c for c in rows.columns if c not in (shard, order, "_block", "n")]
    inner = Window.partitionBy(shard, "_block").orderBy(order, *rest).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(offsets, [shard, "_block"]).withColumn("start", F.col("_offset") + F.coalesce(F.sum("n").over(inner), F.lit(0))).drop("_block", "_offset")


def shard_slots(docs: DataFrame, cluster: Tree | None = None, grown: Tree | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of docs."""
    body = F.encode(text_of(), "UTF-8")
    sized = docs.select("doc_id", (F.octet_length(body).cast("long") + 8).alias("size"), F.crc32(body).alias("text_crc32"))
    runs = sized.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    runs = place(runs, cluster, grown).drop("region", "rack")
    runs = runs.withColumn("_order", F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "size", "text_crc32")))
    runs = cut(numbered(runs, "shard", "_order"))
    made = lambda first, last: F.explode(F.sequence(first, last)).alias("slot")
    columns = ["doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard"]
    few = runs.filter(F.col("n") <= PIECE).select(*columns, made(F.col("start"), F.col("start") + F.col("n") - 1), "grown_shard")
    pieces = runs.filter(F.col("n") > PIECE).withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PIECE)))).repartition("doc_id", "size", "text_crc32", "_piece")
    first = F.col("start") + F.col("_piece") * PIECE
    many = pieces.select(*columns, made(first, F.least(first + PIECE, F.col("start") + F.col("n")) - 1), "grown_shard")
    return few.union(many)
