"""Toxicity: the segment scan against brute force, held-out accuracy, defined results."""

import random
import zlib

from plumbline.llm import toxicity

D = "/root/testdata/sf0.01"


def test_segments_are_maximal():
    """Each positive prefix-minimal run as Ruzzo and Tompa define it, by recursion on the best segment."""

    def by_hand(s, at):
        best = max(((sum(s[i:j]), -i, -j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        value, i, j = best[0], -best[1], -best[2]
        return by_hand(s[:i], at) + [(at + i, at + j, value)] + by_hand(s[j:], at + j)

    r = random.Random(1)
    for _ in range(200):
        s = [r.choice((-3, -2, -1, 1, 2, 4)) + r.random() * 0.1 for _ in range(r.randint(0, 14))]
        got, want = toxicity.segments(s), by_hand(s, 0)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]


def test_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs.join(labels, "doc_id", "left_semi"), model).join(labels, "doc_id").toPandas()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]).all()
    out = rows[rows.held_out]
    assert (out.predicted == out.toxic).mean() > 0.96
    found = out[out.predicted == 1]
    assert found.toxic.mean() > 0.9 and len(found) > 50
    assert ((rows.score >= 0.5) == (rows.predicted == 1)).all() and rows.score.between(0, 1).all()
    small = spark.createDataFrame([(1, None), (2, ""), (3, "idiot moron scum trash " * 5), (3, "idiot moron scum trash " * 5), (None, "x" * 300_000)], "doc_id long, text string")
    got = toxicity.score(small, model).collect()
    assert len(got) == 5 and {r.predicted for r in got if r.doc_id == 3} == {1}
    assert {r.predicted for r in got if r.doc_id in (1, 2)} == {0}
    kept = toxicity.keep_clean(small.selectExpr("doc_id", "text", "'a' score"), model)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2] and kept.columns == ["doc_id", "text", "score"]
    assert toxicity.passages(small, model).filter("doc_id = 3").count() >= 2
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert model is None and toxicity.score(docs, model).collect()[0].predicted == 0
    assert toxicity.keep_clean(docs, model).count() == 1
