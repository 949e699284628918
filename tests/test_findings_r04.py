"""Small inputs on which the findings of round 4 show."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.plans import registry
from plumbline.plans.tables import Tables

registry.load()


def test_sections_below_the_threshold_count(spark, tmp_path):
    """Of two submissions with one section in a bill, one has five others that are in none: its mean does not pass."""
    from plumbline.operators import forensics

    def text(*keys):
        return " ".join(" ".join(f"word{k}{chr(97 + j)}{'x' * 60}" for j in range(6)) + "." for k in keys)

    spark.createDataFrame([(1, text(*"abcdef")), (2, text("a")), (3, text("z"))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(10, text(*"apqr")), (11, text("q"))], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.item_id, r.doc_id, r.score, r.flagged) for r in forensics.shadow_draft(Tables(spark, str(tmp_path))).collect())
    assert got == [(1, 10, 20.0, False), (2, 10, 100.0, True)]


@pytest.mark.parametrize("most", [500, 20])
def test_surroundings_are_whole(spark, monkeypatch, most):
    """A company of 130 edges and its neighbours' ones are all measured, as a matrix and by edges."""
    import random

    from plumbline.operators import graph

    r = random.Random(6)
    ends = {("c0", f"c{k}") for k in range(1, 131)} | {(f"c{k}", f"p{k % 7}") for k in range(1, 40)} | {("c300", "c301")}
    ends |= {(f"c{r.randrange(1, 131)}", f"p{r.randrange(10, 14)}") for _ in range(30)}
    near = {}
    for a, b in ends:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    monkeypatch.setattr(graph, "undirected", lambda t: spark.createDataFrame([(a, b) for a in near for b in near[a]], "src string, dst string"))
    monkeypatch.setattr(graph, "EGO_EDGES", most)
    monkeypatch.setattr(graph, "EGO_STATES", 5_000)
    rows = {x.ego: x for x in graph.spectral_role(None).collect()}
    assert set(rows) == {v for v in near if v[0] == "c"} and rows["c0"].edges > 190
    for ego in ("c0", "c5", "c300"):
        edges = np.array(sorted({tuple(sorted((a, b))) for a in {ego} | near[ego] for b in near[a]}), dtype=object)
        # the matrix's measures, which test_by_force.py checks
        want = graph._spectrum(ego, edges[:, 0], edges[:, 1], True)
        assert (rows[ego].n, rows[ego].edges, rows[ego].bridges, rows[ego].degree) == (want[1], len(edges), want[4], len(near[ego]))
        assert (rows[ego].fiedler, rows[ego].betweenness) == pytest.approx((want[3], want[5]), abs=2e-6)
    assert {x.ego: x.fiedler for x in graph.ego_spectrum(None).collect()} == pytest.approx({v: x.fiedler for v, x in rows.items()}, abs=2e-6)


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_neighbourhoods_are_whole(spark, monkeypatch, depth):
    """A hub of 260 neighbours and what is beyond them; places and chunks of any size give what a search from every start gives."""
    import random

    from plumbline.operators import neighbourhood

    r = random.Random(7)
    ends = [("h", f"v{k}") for k in range(260)] + [(f"v{r.randrange(260)}", f"w{r.randrange(20)}") for _ in range(60)] + [(f"w{k}", f"w{k + 1}") for k in range(12)] + [("w3", "w3")]
    e = {(f"R|{a}|{b}", a, b) for a, b in ends} | {("S|w1|w2", "w1", "w2")}
    starts = ["v0", "v1", "h", "w5", "w19", "alone", "w3"]
    want = set()
    for s in starts:
        far, level = {s: 0}, {s}
        for k in range(1, depth + 1):
            level = {y for _, a, b in e for x, y in ((a, b), (b, a)) if x in level} - set(far)
            far |= dict.fromkeys(level, k)
        want |= {(s, "node", v, k) for v, k in far.items()}
        want |= {(s, "edge", x, 1 + k) for x, a, b in e if (k := min(far.get(a, 9), far.get(b, 9))) < depth}
    edges = spark.createDataFrame(sorted(e), "edge string, src string, dst string")
    frame = spark.createDataFrame([(s,) for s in starts], "start string")
    for starts_, rows in ((2_000, 1_000_000), (2, 50)):
        monkeypatch.setattr(neighbourhood, "STARTS", starts_)
        monkeypatch.setattr(neighbourhood, "ROWS", rows)
        got = [tuple(x) for x in neighbourhood.neighbourhoods(frame, edges, depth).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_vendors_are_shuffled_with_all_their_days(spark):
    """Blocks are dealt one row a vendor, not one a day."""
    from plumbline.operators import forensics

    rows = [("x", c, day, 30) for c in range(30) for day in range(c % 4, 40, 1 + c % 5)]
    d = spark.createDataFrame(rows, "ministry string, comp long, day int, n long").withColumn("day", F.date_from_unix_date("day"))
    days = {c: {day for _, x, day, _ in rows if x == c} for c in range(30)}
    want = {(a, b): n for a in days for b in days if a < b and (n := len(days[a] & days[b])) >= 2}
    found = forensics.common_days(d, 2, 7)
    assert "collect_list(unix_date(" in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.a, r.b): r.days for r in found.collect()} == want
