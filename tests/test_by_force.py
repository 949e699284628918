"""Queries that SQL can't express, against plain Python."""

import itertools
import math
import re
from collections import Counter

import numpy as np
import pytest

from plumbline.functions.text import FUNCTION_WORDS, jaro_winkler_of
from plumbline.operators import evidence, forensics, graph, investigate, resolution
from plumbline.operators.library import STOP_WORDS
from plumbline.plans.tables import Tables


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def words(name):
    found = set(re.findall(r"\w+", name.lower()))
    return {w for w in found if len(w) > 1} or found


def test_jaro_winkler_facts():
    assert jaro_winkler_of("martha", "marhta") == pytest.approx(0.961, abs=1e-3)
    assert jaro_winkler_of("dwayne", "duane") == pytest.approx(0.84, abs=1e-2)
    assert jaro_winkler_of("", "a") == 0 and jaro_winkler_of("abc", "abc") == 1 and jaro_winkler_of("abc", "xyz") == 0
    assert len(FUNCTION_WORDS) == 32 and len(STOP_WORDS) == 44


def test_names(spark):
    names = ["Retd. Col. Ram Singh", "Shri Smt Dr. A-B", "M/s Sample (India) Private Limited", "Late", "late shri er. Nair"]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    got = [(r[0], r[1]) for r in rows.select(resolution.normalise_name(rows.name), resolution.normalise_name(rows.name, "company")).collect()]
    assert [p for p, _ in got] == ["ram singh", "a-b", "sample india private limited", "", "nair"]
    assert got[2][1] == "sample pvt ltd"


def score(a, b):
    if a["cin"] and b["cin"]:
        return 1.0 if a["cin"].upper() == b["cin"].upper() else 0.0
    if a["cin"]:
        return 0.0
    x, y = a["norm"], b["norm"]
    return 0.0 if not x or not y else 1.0 if x == y else 0.6 * jaro_winkler_of(x, y) + 0.4 * jaccard(words(x), words(y))


def stars(n, near):
    """Each unused record takes the later unused ones that score against itself."""
    centre = {}
    for i in range(n):
        if i in centre:
            continue
        centre[i] = i
        for j in range(i + 1, n):
            if j not in centre and near(i, j):
                centre[j] = i
    return centre


def test_resolution(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = sorted((r.asDict() for r in resolution.part_records(t).collect()), key=lambda r: r["seq"])
    for r in rows:
        r["norm"] = " ".join(re.sub(r"[^\w\s-]", " ", r["name"].lower()).split())
    want = {(a["seq"], b["seq"]): s for a, b in itertools.combinations(rows, 2) if (s := score(a, b)) >= 0.72}
    got = {(r.i, r.j): r.score for r in resolution.scored_pairs(resolution.part_records(t)).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-5 for k in want)
    centres = stars(len(rows), lambda i, j: (rows[i]["seq"], rows[j]["seq"]) in want)
    found = {r.seq: [d.seq for d in r.duplicates] for r in resolution.resolve(t).collect()}
    assert found == {rows[c]["seq"]: [rows[j]["seq"] for j in sorted(centres) if centres[j] == c and j != c] for c in set(centres.values())}
    plain = stars(len(rows), lambda i, j: jaccard(words(rows[i]["name"]), words(rows[j]["name"])) >= 0.7)
    assert {r.seq for r in resolution.resolve_by_words(t).collect()} == {rows[c]["seq"] for c in set(plain.values())}
    near = {r.seq: r.score for r in resolution.q_find_matches(t).collect()}
    alone = {r["seq"]: score({"cin": None, "norm": r["norm"]}, {"cin": None, "norm": "small ring"}) for r in rows}
    assert set(near) == {k for k, s in alone.items() if s >= 0.72}


def test_cross_match(spark, sf_dir):
    t = Tables(spark, sf_dir)
    left = [r.asDict() for r in resolution.part_records(t).collect()]
    got = {(r.a, r.b): r.score for r in resolution.cross_match(t).collect()}
    want = {}
    for a in left:
        if a["cin"]:
            continue
        for b in left:
            x, y = a["name"].lower(), f"{b['name'].lower()} ii"
            s = 0.6 * jaro_winkler_of(x, y) + 0.4 * jaccard(words(x), words(y))
            if s >= 0.72:
                want[a["name"], f"Dr. {b['name'].title()} II"] = round(s, 3)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-3 for k in want)
    with pytest.raises(ValueError):
        resolution.resolve_batch(spark.range(501).selectExpr("id seq", "'x' name"))


def test_shadow_draft(spark, tmp_path):
    sentence = lambda k: " ".join(f"{w}{chr(97 + k)}" for w in ("clause", "grants", "subsidy", "toward", "exporters", "review")) + "."
    spark.createDataFrame([(1, " ".join(map(sentence, range(8)))), (2, "unrelated words entirely here.")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(10, " ".join(map(sentence, range(8)))), (11, " ".join(map(sentence, range(12, 20))))], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [(r.item_id, r.doc_id, r.score, r.flagged) for r in forensics.shadow_draft(Tables(spark, str(tmp_path))).collect()]
    assert got == [(1, 10, 100.0, True)]


def play(n, high):
    """A debate by hand: final confidences by agent, and the verdicts."""
    table = "simple" if n <= 1 and high == 0 else "complex" if high >= 2 or n >= 4 else "moderate"
    seats = [(a, s) for a, s in investigate.AGENTS if a in investigate.TABLES_OF[table]]
    verdict = {a: "REQUIRES_FURTHER_EVIDENCE" if a in ("skeptic", "contrarian") else ("ELEVATED_RISK" if high else "LOW_RISK") if a == "risk_analyst" else ("FINDINGS_SUPPORTED" if high else "INCONCLUSIVE") for a, _ in seats}
    c = {a: round((0.7 if high >= 2 else 0.5) * (1 - s * 0.3) + 1e-12, 3) for a, s in seats}
    for k in (1, 2, 3):
        for a, s in seats:
            others = sum(v != verdict[a] for v in verdict.values())
            c[a] = round(min(0.95, max(0.05, c[a] + ((0.05 if s < 0.5 else -0.03) if others > len(seats) // 2 else 0.03))), 3)
        drift = max(0.0, 1 - 5 * float(np.std(list(c.values()))))
        if drift > 0.85 and k < 3:
            for a in ("skeptic", "contrarian"):
                if a in c:
                    c[a] = max(0.05, c[a] - 0.12)
    top, count = Counter(verdict.values()).most_common(1)[0]
    return table, top, len(seats), count / len(seats), sum(c.values()) / len(c), drift


def test_debate(spark, sf_dir):
    t = Tables(spark, sf_dir)
    n, high = Counter(), Counter()
    for r in investigate.findings(t).collect():
        n[r.pol] += 1
        high[r.pol] += r.severity in ("HIGH", "VERY_HIGH")
    got = investigate.debate(t).collect()
    assert len(got) == len(n)
    for r in got:
        table, top, agents, rate, c, drift = play(n[r.pol], high[r.pol])
        assert (r.complexity, r.verdict, r.agents) == (table, top, agents)
        assert abs(r.agreement - rate) < 1e-3 and abs(r.confidence - c) < 2e-3 and abs(r.drift - drift) < 2e-3


EDGES = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "d"), ("f", "g"), ("g", "h")]


def check_roles(rows, near):
    """Roles, bridges and betweenness around each vertex by enumerating all simple shortest paths."""
    assert {r.ego for r in rows} == set(near)
    for r in rows:
        edges = {tuple(sorted((a, b))) for a in {r.ego} | near[r.ego] for b in near[a]}
        ends = {v: {b if a == v else a for a, b in edges if v in (a, b)} for e in edges for v in e}

        def paths(a, b):
            found, level = [], [(a,)]
            while level and not found:
                level = [(*p, w) for p in level for w in ends[p[-1]] if w not in p]
                found = [p for p in level if p[-1] == b]
            return found

        def joined(a, b, without):
            seen, todo = {a}, [a]
            while todo:
                v = todo.pop()
                for w in ends[v] - seen:
                    if tuple(sorted((v, w))) != without:
                        seen.add(w)
                        todo.append(w)
            return b in seen

        others = [v for v in ends if v != r.ego]
        pairs = list(itertools.combinations(others, 2))
        share = sum(sum(r.ego in p for p in ps) / len(ps) for ps in (paths(a, b) for a, b in pairs))
        assert r.betweenness == pytest.approx(share / len(pairs) if pairs else 0.0, abs=1e-5)
        assert (r.edges, r.degree, r.bridges) == (len(edges), len(near[r.ego]), sum(not joined(*e, e) for e in edges))
        assert r.role == ("bridge_entity" if r.fiedler < 0.1 else "peripheral_entity" if r.fiedler < 0.5 else "core_entity")
        assert ("high_betweenness" in r.findings) == (r.betweenness > 0.3)


def test_graph(spark, monkeypatch):
    both = spark.createDataFrame([(f"c{x}", f"c{y}") for a, b in EDGES for x, y in ((a, b), (b, a))], "src string, dst string")
    ranks = {r.id: r["rank"] for r in graph.pagerank_of(spark.createDataFrame(EDGES, "src string, dst string")).collect()}
    names = sorted({x for e in EDGES for x in e})
    out = {x: [b for a, b in EDGES if a == x] for x in names}
    p = dict.fromkeys(names, 1 / len(names))
    for _ in range(100):
        loose = sum(p[x] for x in names if not out[x])
        p = {x: 0.15 / len(names) + 0.85 * (sum(p[a] / len(out[a]) for a in names if x in out[a]) + loose / len(names)) for x in names}
    assert abs(sum(ranks.values()) - 1) < 1e-3 and all(abs(ranks[x] - p[x]) < 1e-5 for x in names)

    monkeypatch.setattr(graph, "undirected", lambda t: both)
    near = {f"c{x}": {f"c{b if a == x else a}" for a, b in EDGES if x in (a, b)} for x in names}
    role = {r.ego: (r.degree, r.betweenness) for r in graph.ego_role(None).collect()}
    for x, ns in near.items():
        pairs = list(itertools.combinations(sorted(ns), 2))
        own = sum(0 if b in near[a] else 1 / (1 + len(near[a] & near[b] & ns)) for a, b in pairs)
        assert role[x] == (len(ns), pytest.approx(own / len(pairs) if pairs else 0.0, abs=1e-5))
    for r in graph.ego_spectrum(None).collect():
        edges = {tuple(sorted((a, b))) for v in {r.ego} | near[r.ego] for a in [v] for b in near[v]}
        vs = sorted({v for e in edges for v in e})
        m = np.zeros((len(vs), len(vs)))
        for a, b in edges:
            i, j = vs.index(a), vs.index(b)
            m[i, i] += 1
            m[j, j] += 1
            m[i, j] = m[j, i] = -1
        assert r.n == len(vs) and math.isclose(r.fiedler, np.linalg.eigvalsh(m)[1], abs_tol=1e-5)
    check_roles(graph.spectral_role(None).collect(), near)
    communities = graph.label_communities(None).collect()
    assert all(2 <= r.n <= 8 for r in communities) and sum(r.n for r in communities) <= 8


def test_jaro_winkler_query(spark, sf_dir):
    from plumbline.functions.text import q_jaro_winkler

    t = Tables(spark, sf_dir)
    names = sorted({r.p_name for r in t.raw("part").collect()})
    want = {(a, b): jaro_winkler_of(a, b) for a, b in itertools.combinations(names, 2) if jaccard(words(a), words(b)) >= 0.3}
    got = {(r.a, r.b): r.similarity for r in q_jaro_winkler(t).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-5 for k in want)
