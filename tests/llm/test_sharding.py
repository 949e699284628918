"""The hash tree against a plain descent, and what it promises where weights change."""

import hashlib
import math
import zlib
from collections import Counter

import pytest

from plumbline.llm import sharding


def draw(doc_id, name, weight):
    u = (int(hashlib.md5(f"{doc_id} {name}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
    return (-math.log(u) / weight, name)


def by_hand(doc_id, cluster):
    doc_id = "null" if doc_id is None else doc_id
    live = {r: {k: {s: w for s, w in shards.items() if w > 0} for k, shards in racks.items()} for r, racks in cluster.items()}
    rack = lambda k: sum(k.values())
    region = lambda r: sum(map(rack, r.values()))
    r = min((r for r in live if region(live[r])), key=lambda r: draw(doc_id, f"region {r}", region(live[r])))
    k = min((k for k in live[r] if rack(live[r][k])), key=lambda k: draw(doc_id, f"rack {k}", rack(live[r][k])))
    return r, k, min(live[r][k], key=lambda s: draw(doc_id, f"shard {s}", live[r][k][s]))


CLUSTER = {"a": {"a1": {0: 1.0, 1: 2.5}, "a2": {2: 1.0}}, "b": {"b1": {3: 4.0, 4: 0.0}}, "c": {"c1": {5: 0.0}}}


def test_descent(spark):
    docs = spark.range(3000).selectExpr("id doc_id", "'x' shard", "id % 7 rack").union(spark.sql("SELECT NULL, 'x', 0"))
    rows = sharding.place(docs, CLUSTER, CLUSTER).collect()
    assert len(rows) == 3001
    assert all((r.region, r.rack, r.shard) == by_hand(r.doc_id, CLUSTER) for r in rows)
    share = Counter(r.shard for r in rows)
    assert set(share) == {0, 1, 2, 3} and all(abs(share[s] / 3001 - w / 8.5) < 0.03 for s, w in {0: 1, 1: 2.5, 2: 1, 3: 4}.items())


def test_movement_is_confined(spark):
    """More weight in rack a1: rows move only into region a, and rows that stay in a move only into a1."""
    heavier = CLUSTER | {"a": {"a1": {0: 1.0, 1: 4.0}, "a2": {2: 1.0}}}
    docs = spark.range(5000).selectExpr("id doc_id")
    before = {r.doc_id: r for r in sharding.place(docs, CLUSTER).collect()}
    moved = 0
    for r in sharding.place(docs, heavier).collect():
        old = before[r.doc_id]
        if old.region != r.region:
            assert r.region == "a"
        elif old.rack != r.rack:
            assert r.region == "a" and r.rack == "a1"
        elif old.shard != r.shard:
            assert r.shard == 1
        moved += old.shard != r.shard
    assert 0 < moved < 1500


@pytest.mark.parametrize("n", [24, 30])
def test_one_more_shard(spark, n):
    rows = sharding.place(spark.range(20000).selectExpr("id doc_id"), sharding.tree(n)).collect()
    share = Counter(r.shard for r in rows)
    assert sorted(share) == list(range(n)) and max(share.values()) < 1.2 * 20000 / n and min(share.values()) > 0.8 * 20000 / n
    moved = [r for r in rows if r.shard != r.grown_shard]
    assert {r.grown_shard for r in moved} == {n} and abs(len(moved) / 20000 - 1 / (n + 1)) < 0.01


def check_slots(rows, got):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    for s in range(sharding.SHARDS):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(r.law == "key" and r.shard == by_hand(r.doc_id, sharding.tree())[2] for r in got)


def test_slots(spark, monkeypatch):
    """A third of the rows are equal, another part shares a null doc_id; blocks and pieces are small, so that every path is taken."""
    monkeypatch.setattr(sharding, "BLOCK", 40)
    monkeypatch.setattr(sharding, "PIECE", 7)
    rows = [(7, "hot")] * 300 + [(None, f"é{k}") for k in range(100)] + [(k, None if k % 3 else "") for k in range(300)] + [(900, "x" * 200_000)] + [(5, "a"), (5, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 size", "2 slot", "3 start", "4 n")
    got = sharding.shard_slots(docs).collect()
    check_slots(rows, got)
    assert sorted(map(tuple, sharding.shard_slots(docs.repartition(5)).collect()), key=repr) == sorted(map(tuple, got), key=repr)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shard_slots(docs).count() == 0 and sharding.place(docs).count() == 0


def test_written_shards(spark, tmp_path):
    docs = spark.range(500).selectExpr("id doc_id", "concat('t', id) text")
    sharding.write_shards(docs, f"{tmp_path}/out", files=2)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 500 and all(r.shard == by_hand(r.doc_id, sharding.tree())[2] for r in back.collect())
