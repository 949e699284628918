"""The mix against plain Python: targets, nearness, whole documents, shards, reruns."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from plumbline.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets_by_hand(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        rest, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        share = {s: rest * weight[s] / w for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


def check(spark, docs, **options):
    rows = docs.collect()
    size = lambda t: len(WORD.findall(t or ""))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += size(r.text)
    want = targets_by_hand(dict(sizes))
    got = mixing.mix_counts(docs, **options).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in rows)
    source = {(r.doc_id, size(r.text)): r.source for r in rows}
    taken, least = defaultdict(int), defaultdict(lambda: 10**9)
    for r in got:
        s = source[r.doc_id, r.size]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.times * r.size
        taken[s] += r.taken
    for s in sizes:
        most = max(size(r.text) for r in rows if r.source == s)
        assert abs(taken[s] - want[s]) <= most, s
    again = mixing.mix_counts(docs, **options).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in got) == Counter((r.doc_id, r.size, r.taken) for r in again)
    return got


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(spark, docs)
    check(spark, docs, block_rows=4, shards=3)


def test_nearness(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.mix_counts(docs).collect()
    assert sum(r.taken for r in got) == pytest.approx(sum(r.size for r in got), rel=0.01)


def test_small(spark):
    schema = "doc_id long, text string, source string, size int, h string"
    rows = [(1, "a b c", "x", 0, ""), (1, "a b c", "x", 0, ""), (2, None, "x", 0, ""), (3, "", None, 0, ""), (4, "w " * 500, None, 0, ""), (5, "q", "é", 0, ""), (None, "n n", "x", 0, ""), (7, "w " * 20_000, "big", 0, "")]
    docs = spark.createDataFrame(rows, schema)
    check(spark, docs)
    assert mixing.mix_counts(docs.limit(0)).count() == 0
    assert mixing.mix_counts(docs.filter("text is null")).collect()[0].taken == 0


def test_rows_of_the_mix_are_the_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = {r.doc_id: r.times for r in mixing.mix_counts(docs).collect()}
    out = mixing.mix(docs, shards=8)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.select("doc_id").collect()) == Counter({k: v for k, v in counts.items() if v})


def test_shards_are_disjoint_and_the_tree_decides(spark, monkeypatch):
    """Each pass of a document lies in one shard; another split of the quotas gives another mix that meets the targets too."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    options = {"shards": 4, "block_rows": 16}
    got = {r.doc_id: r for r in check(spark, docs, **options)}
    assert all(len(r.shards.split(",")) == r.times if r.times else r.shards == "" for r in got.values())
    assert {s for r in got.values() for s in r.shards.split(",") if s} == {"0", "1", "2", "3"}
    skewed = lambda blocks, quotas, shards, seed: tuple(np.vstack([np.zeros((shards - 1, len(x)), np.int64), x]) for x in (blocks, quotas))
    monkeypatch.setattr(mixing, "split_quotas", skewed)
    other = {r.doc_id: r for r in check(spark, docs, **options)}
    assert any(other[d].times != r.times for d, r in got.items())


def test_tree():
    blocks, quotas = np.array([0, 9, 1, 500, 33]), np.array([0, 7, 1, 400, 0])
    for shards in (1, 2, 5, 64):
        own, drawn = mixing.split_quotas(blocks, quotas, shards, 1)
        assert (own.sum(axis=0) == blocks).all() and (drawn.sum(axis=0) == quotas).all()
        assert (drawn >= 0).all() and (drawn <= own).all()
        assert np.ptp(own.sum(axis=1)) <= max(1, int(np.log2(shards)) + 1)
        assert all((a == b).all() for a, b in zip((own, drawn), mixing.split_quotas(blocks, quotas, shards, 1), strict=True))
    mean = np.mean([mixing.split_quotas(blocks, quotas, 4, s) for s in range(400)], axis=0)[:, 0]
    assert np.allclose(mean, [blocks / 4, quotas / 4], atol=1.5)
