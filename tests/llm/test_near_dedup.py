"""Near duplicates against brute force over all pairs."""

import random
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import near_dedup as nd


def labelled(text):
    w = nd.words_of(text)
    runs = [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
    seen, out = Counter(), []
    for r in runs:
        out.append((r, seen[r]))
        seen[r] += 1
    return out


def ordered_similarity(a, b):
    """Plain dynamic programming over all places."""
    x, y = labelled(a), labelled(b)
    if not x or not y:
        return 0.0
    row = [0] * (len(y) + 1)
    for p in x:
        new = [0]
        for j, q in enumerate(y):
            new.append(row[j] + 1 if p == q else max(row[j + 1], new[j]))
        row = new
    return row[-1] / (len(x) + len(y) - row[-1])


def by_hand(rows):
    """doc_id -> smallest doc_id of its component, comparing every pair whose plain Jaccard similarity allows it."""
    texts = {}
    for d, t, *_ in rows:
        w = tuple(nd.words_of(t or ""))
        if w and d is not None:
            texts.setdefault(w, []).append(d)
    keys = {w: set(labelled(" ".join(w))) for w in texts}
    parent = {w: w for w in texts}

    def root(w):
        while parent[w] != w:
            w = parent[w]
        return w

    names = list(texts)
    holders = {}
    for w in names:
        for k in keys[w]:
            holders.setdefault(k, []).append(w)
    pairs = {(a, b) for ws in holders.values() for i, a in enumerate(ws) for b in ws[i + 1 :]}
    for a, b in pairs:
        common = len(keys[a] & keys[b])
        if common >= 0.8 * (len(keys[a]) + len(keys[b]) - common) - 1e-9 and ordered_similarity(" ".join(a), " ".join(b)) >= 0.8 - 1e-12:
            parent[root(a)] = root(b)
    groups = {}
    for w in names:
        groups.setdefault(root(w), []).extend(texts[w])
    return {d: min(g) for g in groups.values() for d in g}


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string, n int")
    got = nd.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    want = by_hand(rows)
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == {d: want.get(d, d) for d, *_ in rows if d is not None}
    kept = nd.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({want.get(d, d) for d, *_ in rows if d is not None})
    return got


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        k = r.randrange(len(words))
        words[k : k + r.randint(0, 1)] = [f"new{r.randrange(10**6)}"] * r.randint(0, 1)
    return words


def test_planted(spark):
    r = random.Random(6)
    rows, i = [], 0
    shared = [f"s{k}" for k in range(80)]
    for _ in range(25):
        base = [f"w{r.randrange(4000)}" for _ in range(r.randint(60, 400))]
        if r.random() < 0.3:
            base[20:20] = shared
        for _ in range(r.randint(1, 6)):
            rows.append((i, " ".join(edited(r, base, r.randint(0, len(base) // 60))), "x", 0))
            i += 1
    base = [f"h{k}" for k in range(120)]
    rows += [(i + k, " ".join(edited(r, base, 1)), "x", 0) for k in range(80)]
    check(spark, rows)


def test_small(spark):
    long = " ".join(f"v{k % 9000}" for k in range(30_000))
    rows = [(1, None, "x", 0), (2, "", "x", 0), (3, " . ", "x", 0), (4, "one two", "x", 0), (5, "One, two!", "x", 0), (6, "one two three", "x", 0), (7, long, "x", 0), (8, long + " end", "x", 0), (9, "a " * 40, "x", 0), (10, "a " * 41, "x", 0), (11, "a " * 80, "x", 0), (None, "alone here", "x", 0), (4, "one two", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string, n int")
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 7, 9: 9, 10: 9, 11: 11, None: None}
    assert sorted(r.doc_id or 0 for r in nd.keep_one(docs).collect()) == [0, 1, 2, 3, 4, 6, 7, 9, 11]
    assert nd.near_duplicates(docs.limit(0)).count() == 0 and nd.keep_one(docs.limit(0)).count() == 0


def test_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text, "", 0) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(spark, rows)


def test_alignment():
    r = np.random.default_rng(2)
    for _ in range(200):
        a = r.permutation(60)[: r.integers(1, 60)]
        b = np.delete(a, r.integers(0, len(a), r.integers(0, 4)))
        if r.random() < 0.3:
            b = np.roll(b, r.integers(0, 9))
        a, b = a.astype(np.uint64), b.astype(np.uint64)
        row = [0] * (len(b) + 1)
        for p in a:
            new = [0]
            for j, q in enumerate(b):
                new.append(row[j] + 1 if p == q else max(row[j + 1], new[j]))
            row = new
        want = row[-1] / (len(a) + len(b) - row[-1])
        assert nd.alignment(a, b) == (pytest.approx(want) if want >= 0.8 else 0.0)


def sited(r, n):
    """n pairs of texts of 100 places with two readings each, the second one rare: pairs differ in 11 places, others in about 25, so buckets are full and hold many components."""
    rows = []
    for k in range(n):
        one = [int(r.random() < 0.15) for _ in range(100)]
        two = list(one)
        for s in r.sample(range(100), 11):
            two[s] ^= 1
        for m, bits in enumerate((one, two)):
            words = [f"w{j}" for j in range(510)]
            for s, bit in enumerate(bits):
                words[5 * s + 5] += "x" * bit
            rows.append((2 * k + m, " ".join(words), "x", 0))
    return rows


def test_full_buckets(spark, monkeypatch):
    """Pairs that meet only in buckets of more than BLOCK components are found, also where a bucket takes several cells."""
    monkeypatch.setattr(nd, "CELL_MEMBERS", 40, raising=False)
    rows = sited(random.Random(11), 300)
    bits = np.array([["x" in w for w in t.split()] for _, t, *_ in rows])
    # a place touches five runs of words that no other touches, so eleven places leave 451 / 561 and twelve 446 / 566
    near = (bits[:, None, :] != bits[None, :, :]).sum(2) <= 11
    want = {d: d for d, *_ in rows}
    while True:
        after = {d: min(want[e] for e in np.nonzero(near[d])[0].tolist()) for d in want}
        if after == want:
            break
        want = after
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string, n int")
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(docs).collect()}
    assert len(set(got.values())) == len(set(want.values()))
    assert got == want
