"""Hard negatives against all pairs."""

import math
from fractions import Fraction

import numpy as np
import pytest

from plumbline.llm import hard_negatives as hn


def by_hand(rows, every=100, k=5):
    fine = []
    for i, e, label, *_ in rows:
        if i is not None and label is not None and e and all(x is not None and math.isfinite(x) for x in e):
            fine.append((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * float(x)) for x in e)))
    out = []
    for a, label, v in dict.fromkeys(r for r in fine if r[0] % every == 0):
        score = lambda w: max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(v, w, strict=False))))  # noqa: B023, E731
        for p, ps in [(i, -s) for s, i in sorted((-score(w), i) for i, lab, w in fine if lab == label and i != a)[:k]]:
            found = sorted((-score(w), i) for i, lab, w in fine if lab != label and 80 * ps <= 100 * score(w) <= 100 * ps)[:k]
            out += [(a, p, r + 1, i, ps, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def check(spark, rows, **more):
    rows = [(i, None if e is None else [None if x is None else float(x) for x in e], *rest) for i, e, *rest in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, score string, v int, anchor int")
    got = sorted(map(tuple, hn.mine_table(df, **more).collect()))
    assert got == by_hand(rows)
    return got


def clustered(n, seed, dims=12):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dims))
    return [(i, [float(x) for x in centres[i % 6] + 0.3 * r.normal(size=dims)], int(r.integers(0, 4)), "x", 1, 1) for i in range(n)]


@pytest.mark.parametrize("blocks", [(1 << 15, 128, 2048), (100, 2, 2)])
def test_clusters(spark, monkeypatch, blocks):
    monkeypatch.setattr(hn, "CANDIDATE_BLOCK", blocks[0])
    monkeypatch.setattr(hn, "LEAST_ANCHORS", blocks[1])
    monkeypatch.setattr(hn, "MOST_ANCHORS", blocks[2])
    monkeypatch.setattr(hn, "LEAF", 8)
    assert len(check(spark, clustered(900, 3))) > 100


def test_ties_and_hot_vector(spark, monkeypatch):
    """A third of the rows hold one vector, half of all rows one label."""
    monkeypatch.setattr(hn, "LEAF", 4)
    rows = clustered(400, 5)
    rows = [(i, rows[1][1] if i % 3 == 0 else e, 1 if i % 2 else lab, *rest) for i, e, lab, *rest in rows]
    assert check(spark, rows)


def test_defined_cases(spark):
    rows = clustered(150, 8, 4) + [(200, None, 1, "x", 1, 1), (300, [], 1, "x", 1, 1), (None, [1.0, 1, 1, 1], 1, "x", 1, 1), (400, [1.0, None, 1, 1], 1, "x", 1, 1), (500, [float("nan"), 1, 1, 1], 1, "x", 1, 1)]
    rows += [(600, [1.0, 1, 1, 1], None, "x", 1, 1), (700, [1.0, 2.0], 2, "x", 1, 1), (-100, [0.5, 0.5, 0, 0], 1, "x", 1, 1), (800, [0.0, 0, 0, 0], 1, "x", 1, 1), (801, [float("inf"), 1, 1, 1], 1, "x", 1, 1)]
    rows += [rows[100], rows[3], rows[3]]
    check(spark, rows)
    assert check(spark, []) == [] and check(spark, rows[1:50]) == []


def test_large_components(spark):
    rows = [(100, [1e9, 1.0], 1), (1, [1e9, 3.0], 1), (2, [9e8, 0.0], 2), (3, [1e9, 0.0], 3), (4, [1.0, 5.0], 1), (5, [1e16, 1e16], 2)]
    check(spark, [(*r, "x", 1, 1) for r in rows])


def test_bounds_hold():
    """Each pair of nodes bounds the products of its rows; windows prune pairs and lose none."""
    r = np.random.default_rng(1)
    x, y = np.floor(256 * r.normal(size=(60, 6))), np.floor(256 * (r.normal(size=(500, 6)) + 3 * r.integers(0, 3, (500, 1))))
    a, b = hn.Ball(x, 4), hn.Ball(y, 8)
    rows = lambda t, k: t.order[t.low[k] : t.high[k]]
    for p in range(len(a.low)):
        for q in range(len(b.low)):
            low, high = hn.interval(a, b, np.array([p]), np.array([q]))
            s = x[rows(a, p)] @ y[rows(b, q)].T
            assert low[0] <= s.min() and s.max() <= high[0]
    least = np.full(60, float(np.quantile(x @ y.T, 0.98)))
    p, q, _ = hn.leaf_pairs(a, b, a.over(least, np.minimum), a.over(np.full(60, np.inf), np.maximum))
    leaves = int((a.kids < 0).sum() * (b.kids < 0).sum())
    assert 0 < len(p) < leaves / 2
    kept = {(i, j) for m, n in zip(p, q, strict=True) for i in rows(a, m) for j in rows(b, n)}
    assert all((i, j) in kept for i, j in zip(*np.nonzero(x @ y.T >= least[0]), strict=True))


def test_windows_are_whole_numbers():
    for ps in (-7, 0, 1, 3, 99, 101, 12345):
        least = -(-hn.LEAST * ps // 100)
        assert least == math.ceil(Fraction(80 * ps, 100))
