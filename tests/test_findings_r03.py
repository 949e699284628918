"""Small inputs on which the findings of round 3 show."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline.plans import registry

registry.load()
BASE = "/root/testdata/sf0.001"


@pytest.fixture
def tables(tmp_path):
    """A folder of the smallest tables, some of them replaced by DuckDB SQL over the others, and the oracle's rows on it."""

    def made(**changed):
        con = duckdb.connect()
        for f in os.listdir(BASE):
            name = f.removesuffix(".parquet")
            if name in changed:
                con.execute(f"COPY ({changed[name].format(old=f"'{BASE}/{f}'")}) TO '{tmp_path}/{f}' (FORMAT parquet)")
            else:
                os.symlink(f"{BASE}/{f}", tmp_path / f)
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{f}'")
        return str(tmp_path), lambda query: con.sql(registry.ORACLES[query])

    return made


def same(spark, made, query):
    folder, oracle = made
    want = oracle(query)
    got = registry.QUERIES[query](spark, folder).select(*want.columns)
    rows = sorted(map(repr, map(tuple, want.fetchall())))
    assert sorted(repr(tuple(tuple(v) if isinstance(v, list) else v for v in r)) for r in got.collect()) == [r.replace("[", "(").replace("]", ")") for r in rows]
    return rows


def test_function_words_round_as_the_sql(spark, tables):
    text = " ".join(["the"] * 41 + ["word"] * 599)
    rows = same(spark, tables(documents=f"SELECT * REPLACE ('{text}' AS text) FROM {{old}} LIMIT 3"), "sc26_function_words")
    assert "0.064062" in rows[0]


def test_common_days_by_pairs_of_blocks(spark):
    from plumbline.operators import forensics

    rows = [(m, c, (c * c + 3 * k + c * k) % 11) for m in ("x", "y") for c in range(40) for k in range(c % 6)]
    d = spark.createDataFrame([(m, c, day, 40) for m, c, day in rows], "ministry string, comp long, day int, n long").withColumn("day", F.date_from_unix_date("day")).distinct()
    days = {}
    for m, c, day in rows:
        days.setdefault((m, c), set()).add(day)
    want = {(m, a, b): len(x & days[o, b]) for (m, a), x in days.items() for o, b in days if o == m and a < b and len(x & days[o, b]) >= 2}
    for vendors in (7, 8_192):
        found = forensics.common_days(d, 2, vendors)
        # pairs of vendors are counted where their rows meet, so there is no join
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert {(r["ministry"], r["a"], r["b"]): r["days"] for r in found.collect()} == want and want


@pytest.mark.parametrize("hot", [2, 20_000])
def test_containment_with_common_runs(spark, hot):
    from plumbline.operators.loaders import contains_join

    names = [(k, f"Customer#{k:05d}") for k in range(40)] + [(100, "x#1"), (101, None), (102, "")]
    mentions = [(k, f"mer#{k:05d}") for k in range(0, 60, 7)] + [(200, "#0"), (201, "customer"), (202, " "), (203, "CUSTOMER#"), (204, "nobody"), (205, "#1")]
    found = contains_join(spark.createDataFrame(names, "id long, name string"), spark.createDataFrame(mentions, "mid long, mention string"), hot)
    want = {(i, m) for i, n in names for m, x in mentions if n and x.strip() and x.strip().lower() in n.lower()}
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_contains_join_shuffles_no_pairs(spark, tables):
    made = tables()
    same(spark, made, "jn05_contains_join")
    plan = registry.QUERIES["jn05_contains_join"](spark, made[0])._jdf.queryExecution().optimizedPlan().toString()
    assert not plan.splitlines()[0].startswith("Aggregate") and "Join Inner" in plan.splitlines()[1]


def test_facts_meet_in_one_grouping(spark, tables):
    from plumbline.operators.investigate import facts
    from plumbline.plans.tables import Tables

    made = tables()
    plan = facts(Tables(spark, made[0]))._jdf.queryExecution().optimizedPlan().toString()
    # each of the ten parts is dealt anew, so no task computes several
    assert plan.count("RepartitionByExpression [pol") == 10
    same(spark, made, "dt23_findings")


def test_scripts_strip_runs_of_characters(spark):
    from plumbline.functions.text import language_of

    x = "मोदी मोदी and a few more words"
    df = spark.createDataFrame([(x,), ("plain",), ("मो",), ("",), (None,)], "x string").select(language_of(F.col("x")).alias("l"))
    assert [r[0] for r in df.collect()] == ["hi", "en", "en", "en", "en"]
    # one replacement a run, not one a character
    assert "]+" in df._jdf.queryExecution().analyzed().toString()


def test_a_settled_state_has_the_size_of_its_rows(spark):
    """A checkpoint kept the product over the joins of all rounds as its size."""
    from plumbline.operators.graph import settle

    x = settle(spark.range(100).select("id", ((F.col("id") + 1) % 100).alias("to")))
    for _ in range(4):
        x = settle(x.join(x.select(F.col("id").alias("to"), F.col("to").alias("far")), "to").select("id", F.col("far").alias("to")))
    assert x._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 2**30
    assert x.filter("to = (id + 16) % 100").count() == 100


@pytest.fixture
def deep(spark, monkeypatch):
    """A path of 3,000 vertices, closed to a cycle from its 1,000th to its 2,000th; and how often state was written."""
    from plumbline.operators import graph, network

    written, settle = [], graph.settle
    for module in (graph, network):
        monkeypatch.setattr(module, "settle", lambda df: written.append(1) or settle(df))
    monkeypatch.setattr(graph, "LAST", 100)
    ends = [(f"v{k:04}", f"v{k + 1:04}") for k in range(2999)] + [("v1000", "v2000")]
    return spark.createDataFrame([p for a, b in ends for p in ((a, b), (b, a))], "src string, dst string"), written


def test_bridges_of_a_deep_graph(deep):
    from plumbline.operators import network

    e, written = deep
    got = {(r.a, r.b) for r in network.bridges_of(e).collect()}
    assert got == {(f"v{k:04}", f"v{k + 1:04}") for k in range(2999) if not 1000 <= k < 2000}
    # not one a level
    assert len(written) < 80


def test_components_of_a_deep_graph(deep):
    from plumbline.operators import graph

    e, written = deep
    found, tree = graph.contracted(graph.settle(e))
    assert [tuple(r) for r in found.groupBy("root").count().collect()] == [("v0000", 3000)] and tree.distinct().count() == 2999
    assert len(written) < 50


def test_small_graphs_come_many_to_a_batch(spark, tables):
    """No graph is a group of its own, and their bridges are those found by taking each edge away."""
    import random

    import numpy as np

    from plumbline.operators import graph

    plan = registry.QUERIES["dt18_spectral_role"](spark, tables()[0])._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan
    r = random.Random(3)
    parts = lambda m: len({frozenset(np.flatnonzero(row)) for row in np.linalg.matrix_power(m + np.eye(len(m)), len(m)) > 0})
    for n in (2, 6, 12):
        near = np.zeros((n, n))
        for _ in range(n + 1):
            i, j = r.sample(range(n), 2)
            near[i, j] = near[j, i] = 1
        want = 0
        for i, j in zip(*np.nonzero(np.triu(near)), strict=True):
            less = near.copy()
            less[i, j] = less[j, i] = 0
            want += parts(less) > parts(near)
        assert graph._bridges(near) == want


@pytest.mark.parametrize("ends", [4_096, 6, 0])
def test_paths_by_neighbours_and_by_frontiers(spark, monkeypatch, ends):
    """Both ways give the first of the shortest paths; paths from a neighbour grow once, whatever the pairs that have it."""
    import random

    from plumbline.operators import neighbourhood

    r = random.Random(4)
    near = {}
    for _ in range(70):
        a, b = (f"v{r.randrange(45):02}" for _ in range(2))
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    vs = sorted(near)
    pairs = [(a, b) for a in vs[::3] for b in vs[::2]] + [(vs[0], "alone")]

    def first(a, b, most):
        level, seen = {a: [a]}, {a}
        for hops in range(most + 1):
            if b in level:
                return hops, level[b]
            after = {}
            for v, path in sorted(level.items(), key=lambda x: x[1]):
                for w in near[v] - seen:
                    after[w] = min(after.get(w, ["~"]), path + [w])
            seen |= set(after)
            level = after

    written, settle = [], neighbourhood.settle
    monkeypatch.setattr(neighbourhood, "settle", lambda df: written.append(settle(df)) or written[-1])
    e = spark.createDataFrame([(a, b) for a in near for b in near[a] if a < b], "src string, dst string")
    p = spark.createDataFrame(pairs, "a string, b string")
    for most in (1, 2, 4, 5) if ends == 6 else (5,):
        want = {(a, b, x[0], tuple(x[1])) for a, b in pairs if (x := first(a, b, most))}
        got = neighbourhood.shortest(p, e, most, ends).collect()
        assert len(got) == len(want) and {(x.a, x.b, x.hops, tuple(x.path)) for x in got} == want
    if ends == 4_096:
        assert max(x.count() for x in written if {"v", "path"} <= set(x.columns)) <= len(vs) ** 2
        assert not any({"a", "v"} <= set(x.columns) for x in written)


def test_companies_meet_alike_bids_by_the_fewer_rows(spark, monkeypatch):
    """A company of few descriptions joins its own pairs, one of many the pairs that are alike; both give what nested loops give."""
    from plumbline.operators import forensics

    used = [(c, d, 1 + (c + d) % 3) for c, ds in ((1, range(3)), (2, range(0, 60, 2)), (3, [50]), (4, range(90, 95))) for d in ds]
    alike = [(0, k, k % 4 == 1) for k in range(1, 40)] + [(2, 8, True), (4, 6, False), (50, 60, True)]
    split, settle = [], forensics.settle
    monkeypatch.setattr(forensics, "settle", lambda df: split.append(settle(df)) or split[-1])
    found = forensics.alike_pairs(spark.createDataFrame(used, "comp long, id long, n long"), spark.createDataFrame(alike, "a long, b long, close boolean"))
    n = {(c, d): k for c, d, k in used}
    want = sorted((c, close, n[c, a] * n[c, b]) for c in (1, 2, 3, 4) for a, b, close in alike if (c, a) in n and (c, b) in n)
    assert sorted(map(tuple, found.collect())) == want
    assert {(r.comp, r.own) for r in split[0].select("comp", "own").distinct().collect()} == {(1, True), (2, False), (3, True)}


def test_sets_against_another_table(spark, tables):
    """All pairs by force; words that no set of the first table holds are dropped before words are ordered, and texts are cut once."""
    import random

    from plumbline.functions.text import similar_pairs

    r = random.Random(5)
    draw = lambda n, most: {k: frozenset(f"w{int(r.random() ** 2 * most):02}" for _ in range(r.randrange(1, 12))) for k in range(n)}
    x, y = draw(30, 20), draw(60, 40)
    y[60] = x[0]
    frame = lambda sets: spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "id long, words array<string>")
    for least in (0.4, 0.5, 1.0):
        got = similar_pairs(frame(x), least, frame(y))
        want = {(a, b) for a in x for b in y if len(x[a] & y[b]) / len(x[a] | y[b]) >= least}
        assert want and sorted((p.a, p.b) for p in got.collect()) == sorted(want)
    plan = registry.QUERIES["dt08_shadow_draft"](spark, tables()[0])._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and "regexp_extract_all" not in plan


def test_postings_are_written_once(spark, tmp_path, monkeypatch):
    """No state but the index itself is written; the sizes are those of the entries, of both batches."""
    from plumbline.operators import stored_index as si

    monkeypatch.setattr(si, "settle", None)
    texts = [(f"{k}", " ".join(f"w{j % (k % 13 + 1)}" for j in range(k % 31))) for k in range(200)]
    for part in (texts[:90], texts[90:]):
        si.append(spark.createDataFrame([("L", *x) for x in part], "label string, id string, text string"), str(tmp_path / "i"))
    sizes = spark.read.parquet(str(tmp_path / "i" / "sizes")).agg(F.sum("entries"), F.sum("words")).first()
    assert tuple(sizes) == (sum(x != "" for _, x in texts), sum(len(x.split()) for _, x in texts))


def test_components_join_numbers(spark, monkeypatch):
    """Rounds join and group numbers instead of names, and numbers that two vertices share are drawn anew."""
    from plumbline.operators import graph

    tables = []
    monkeypatch.setattr(graph, "LAST", 3)
    settle = graph.settle
    monkeypatch.setattr(graph, "settle", lambda df: tables.append(dict(df.dtypes)) or settle(df))
    ends = [(f"v{a}", f"v{b}") for a, b in [(k, k + 1) for k in range(40) if k % 9] + [(k, 7 * k % 40) for k in range(0, 40, 8)] + [(50, 50), (51, 51)]]
    e = spark.createDataFrame(sorted({p for a, b in ends for p in ((a, b), (b, a))}), "src string, dst string")
    want = {v: v for pair in ends for v in pair}
    for _ in want:
        for a, b in ends:
            want[a] = want[b] = min(want[a], want[b])
    assert {r.id: r.root for r in graph.labels(e).collect()} == want
    rounds = [t for t in tables if {"a", "up"} <= set(t) or {"a", "b"} == set(t)]
    assert rounds and all(t[c] == "bigint" for t in rounds for c in t if c != "moved")
    few = lambda *c: real(*c) % 64
    real = F.xxhash64
    monkeypatch.setattr(graph.F, "xxhash64", few)
    own, _ = graph.coded(e.filter("src in ('v1', 'v2', 'v3', 'v4', 'v5', 'v50', 'v6', 'v7', 'v8')"))
    assert own.select("v").distinct().count() == own.count()


def test_betweenness_folds_and_discards(spark, monkeypatch):
    """Leaves and vertices with the same neighbours are no sources of their own, and the states of a batch are gone after it."""
    from test_network import check_betweenness, frame, near_of

    from plumbline.operators import graph, network

    seen = []
    real = network.dependencies
    monkeypatch.setattr(network, "dependencies", lambda sources, near: seen.append(sources.count()) or real(sources, near))
    gone = []
    monkeypatch.setattr(network, "discard", lambda s, within: gone.append(within) or graph.discard(s, within))
    edges = [(f"p{k}", h) for k in range(30) for h in ("h1", "h2")] + [("h1", f"leaf{k}") for k in range(20)] + [("h2", "x"), ("x", "y"), ("y", "h3"), ("h3", "z"), ("a", "b")]
    near = near_of(edges)
    check_betweenness(near, {r.id: r.score for r in network.betweenness_of(frame(spark, edges)).collect()})
    # h1, h2, one of the thirty, x, y and h3
    assert sum(seen) == 6
    folder = graph.shared_folder(spark).removeprefix("file:")
    assert gone and not any(os.path.exists(f"{folder}/plumbline/{within}") for within in gone)
    pivots = ["p3", "p4", "leaf1", "leaf2", "y", "a"]
    got = {r.id: r.score for r in network.betweenness_of(frame(spark, edges), spark.createDataFrame([(v,) for v in pivots], "id string")).collect()}
    check_betweenness(near, got, pivots)


def test_communities_take_few_rounds(spark, monkeypatch):
    """The last edges are merged in one task instead of by rounds, by weights and loops; before that a level takes no more rounds than bring something."""
    from test_network import frame, greedy, near_of, planted, quality

    from plumbline.operators import network

    rounds = []
    real = network._options
    monkeypatch.setattr(network, "_options", lambda *a: rounds.append(1) or real(*a))
    edges = planted(5, 4, 5)
    near = near_of(edges)
    best = quality(near, greedy(near))
    got = {r.id: r.community for r in network.communities_of(frame(spark, edges), 0).collect()}
    assert not rounds and set(got) == set(near) and quality(near, got) >= best - 1e-9
    monkeypatch.setattr(network, "LAST", 40)
    got = {r.id: r.community for r in network.communities_of(frame(spark, edges), 0).collect()}
    assert 0 < len(rounds) < 20 and set(got) == set(near) and quality(near, got) >= best - 0.05
    assert network.merge_greedily([(1, 1, 4.0), (1, 2, 1.0), (3, 3, 6.0)], 12.0) == {1: 1, 2: 1, 3: 3}
