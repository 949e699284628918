"""The stored index: ranks as a full scan does, reads its words' postings alone, skips blocks, grows by batches."""

import contextlib
import io
import math
import random
from collections import Counter

from plumbline.plans import registry

registry.load()
from plumbline.operators import stored_index as si  # noqa: E402


def by_hand(entries, words, most=si.TOP):
    split = {(label, i): text.lower().split() for label, i, text in entries}
    split = {k: w for k, w in split.items() if w}
    mean = sum(map(len, split.values())) / len(split)
    df = Counter(w for ws in split.values() for w in set(ws) & set(words))
    scores = []
    for k, ws in split.items():
        n = Counter(ws)
        s = sum(math.log(1 + (len(split) - df[w] + 0.5) / (df[w] + 0.5)) * n[w] * 2.2 / (n[w] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w in set(words) if n[w])
        if s:
            scores.append((-round(s, 6), *k))
    return [(label, i, -s) for s, label, i in sorted(scores)[:most]]


def test_index(spark, tmp_path):
    r = random.Random(3)
    entries = [("L", f"{k:04}", " ".join(["common"] * (r.random() < 0.5) + [f"w{int(r.paretovariate(0.7)) % 300}" for _ in range(r.randint(0, 12))])) for k in range(1500)]
    entries += [("M", f"{k}", "common Rare rare") for k in range(25)]
    df = spark.createDataFrame(entries, "label string, id string, text string")
    folder = str(tmp_path / "index")
    for low, high in ((0, 700), (700, 1525)):
        si.append(spark.createDataFrame(entries[low:high], df.schema), folder)
    for words in (["rare", "common"], ["w1", "w2", "w17"], ["none"], ["w250"]):
        found, read = si.search(spark, folder, words)
        got, want = [tuple(x) for x in found.collect()], by_hand(entries, words)
        assert [x[:2] for x in got] == [x[:2] for x in want] and all(abs(x[2] - y[2]) < 2e-6 for x, y in zip(got, want))
        if words == ["rare", "common"]:
            assert read["read"] < read["blocks"] / 2
    si.compact(spark, folder, str(tmp_path / "whole"))
    assert [tuple(x) for x in si.search(spark, str(tmp_path / "whole"), ["rare", "w1"])[0].collect()] == [tuple(x) for x in si.search(spark, folder, ["rare", "w1"])[0].collect()]
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        si._only(spark.read.parquet(f"{folder}/postings"), ["rare"]).explain("formatted")
    assert "PartitionFilters: [isnotnull(bucket" in plan.getvalue() and "EqualTo(w,rare)" in plan.getvalue()


def test_nothing_stored(spark, tmp_path):
    si.append(spark.createDataFrame([("L", "1", "  "), ("L", "2", None)], "label string, id string, text string"), str(tmp_path / "i"))
    assert si.search(spark, str(tmp_path / "i"), ["a"])[0].count() == 0
