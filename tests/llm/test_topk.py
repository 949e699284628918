"""Exact top-k against brute force."""

import math

import numpy as np
import pytest

from plumbline.llm import topk


def by_hand(rows, every, k):
    fine = [(i, [math.floor(1024 * float(x)) for x in e]) for i, e, *_ in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    out = set()
    for q, qv in fine:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(qv, v, strict=False)), i) for i, v in fine if i != q)[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)}
    return out


def check(spark, rows, every=100, k=10, **blocks):
    vectors = topk.integers(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string"))
    got = topk.top_k(vectors, vectors.filter(f"vec_id % {every} = 0"), k, **blocks).collect()
    assert {tuple(r) for r in got} == by_hand(rows, every, k) and len(got) == len({tuple(r) for r in got})


def f32(x):
    return [float(v) for v in np.float32(x)]


@pytest.mark.parametrize("scale", [0.05, 1.0, 300.0])
def test_random(spark, scale):
    r = np.random.default_rng(4)
    rows = [(i, f32(r.normal(size=16) * scale), "x") for i in range(700)]
    rows += [(700 + i, rows[i % 5][1], "x") for i in range(60)]
    check(spark, rows, query_block=3, candidate_block=128)


def test_edges(spark):
    rows = [(0, [0.5, -0.5], "x"), (100, None, "x"), (200, [], "x"), (300, [1.0, None], "x"), (400, [float("nan"), 1.0], "x"), (500, [float("inf"), 1.0], "x"), (None, [1.0, 1.0], "x"), (600, [0.0, 0.0], "x"), (601, [0.5, -0.5], "x"), (602, [0.5, -0.5], "x"), (-100, [-1.0, 0.25], "x")]
    check(spark, rows)
    check(spark, rows, k=1)
    assert topk.top_k_of_table(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_repeated_queries(spark):
    """A repeated query row is one query; two vectors of one query vec_id rank for themselves; candidates repeat."""
    rows = [(100, [1.0, 0.0])] * 2 + [(1, [1.0, 0.0]), (2, [0.5, 0.0]), (2, [0.5, 0.0]), (3, [0.25, 0.0])]
    got = [tuple(r)[1:3] for r in topk.top_k_of_table(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3).collect()]
    assert sorted(got) == [(1, 1), (2, 2), (3, 2)]
    rows += [(100, [-1.0, 0.0])]
    got = sorted(tuple(r)[1:3] for r in topk.top_k_of_table(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3).collect())
    assert got == [(1, 1), (1, 3), (2, 2), (2, 2), (3, 2), (3, 2)]


def test_slices_prune():
    r = np.random.default_rng(1)
    v = np.floor(1024 * r.normal(size=(5000, 64)) / 8).astype(np.int64)
    block = topk.SlicedBlock(np.arange(5000), v)
    q = v[7]
    total = block.sums(q)
    u = (v - block.low) >> block.shift
    most = (1 << block.bits) - 1
    want = np.where(q > 0, u, most - u) @ np.abs(q)
    assert (block.values(total, np.arange(5000)) == want).all()
    assert block.kth(total, 10, block.valid) == np.sort(want)[-10]
    assert set(block._rows(block.at_least(total, int(np.sort(want)[-10])))) == set(np.flatnonzero(want >= np.sort(want)[-10]))


def test_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, "") for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = topk.top_k_of_table(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).collect()
    assert {tuple(r) for r in got} == by_hand(rows, 100, 10)


def test_large_components(spark):
    """Products beyond 64 bits rank exactly and show the range's end."""
    rows = [(100, [1e17, 1.0]), (1, [1e17, 0.0]), (2, [2.0**40, 0.0]), (3, [-1e17, 0.0]), (4, [0.0, 5.0])]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k_of_table(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert [got[100, k][0] for k in (1, 2, 3, 4)] == [1, 2, 4, 3]
    assert got[100, 1][1] == (1 << 63) - 1 and got[100, 3][1] == 5 * 1024 * 1024 and got[100, 4][1] == -(1 << 63)
