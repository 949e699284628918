"""Betweenness, communities and bridges against plain forms on small, random and large graphs."""

import itertools
import random
from collections import defaultdict

import pytest

from plumbline.operators import network
from plumbline.plans.tables import Tables

FIXTURE = [("P1", "C1"), ("P1", "C2"), ("P2", "C3"), ("C1", "K1"), ("C2", "K1"), ("C3", "K2"), ("M1", "K1"), ("M1", "K2"), ("P1", "P2")]


def frame(spark, edges):
    both = {p for a, b in edges if a != b for p in ((a, b), (b, a))}
    return spark.createDataFrame(sorted(both), "src string, dst string")


def near_of(edges):
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    return near


def brandes(near, sources):
    score = dict.fromkeys(near, 0.0)
    for s in sources:
        depth, order, paths = {s: 0}, [s], defaultdict(int, {s: 1})
        for v in order:
            for w in near[v]:
                if w not in depth:
                    depth[w] = depth[v] + 1
                    order.append(w)
                if depth[w] == depth[v] + 1:
                    paths[w] += paths[v]
        d = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if depth[v] == depth[w] - 1:
                    d[v] += paths[v] / paths[w] * (1 + d[w])
            if w != s:
                score[w] += d[w]
    return score


def component(near, s):
    seen, todo = {s}, [s]
    while todo:
        for w in near[todo.pop()] - seen:
            seen.add(w)
            todo.append(w)
    return seen


def randomly(seed, n, m):
    r = random.Random(seed)
    return [(f"v{r.randrange(n):04}", f"v{r.randrange(n):04}") for _ in range(m)]


def check_betweenness(near, got, sources=None):
    assert set(got) == set(near)
    scores = brandes(near, sources or near)
    for part in {frozenset(component(near, v)) for v in near}:
        n, used = len(part), len(part & set(sources or near))
        for v in part:
            want = scores[v] / ((n - 1) * (n - 2)) * n / used if n > 2 and used else 0.0
            assert got[v] == pytest.approx(want, abs=2e-8)


def test_betweenness(spark, monkeypatch):
    """The fixture, and a random graph of several components in small batches, chunks and places."""
    got = {r.id: r.score for r in network.betweenness_of(frame(spark, FIXTURE)).collect()}
    check_betweenness(near_of(FIXTURE), got)
    assert all(0 <= x <= 1 for x in got.values())
    for name, value in (("STATES", 1500), ("CHUNK", 3), ("HEAVY", 2), ("SALTS", 4)):
        monkeypatch.setattr(network, name, value)
    edges = randomly(1, 40, 44) + [("hub", f"v{k:04}") for k in range(0, 40, 3)]
    check_betweenness(near_of(edges), {r.id: r.score for r in network.betweenness_of(frame(spark, edges)).collect()})


def test_betweenness_of_a_large_component(spark):
    """5,000 vertices in one component with a hub that a third of them meet; 12 of them as sources."""
    edges = randomly(2, 5000, 9000) + [(f"v{k:04}", f"v{k + 1:04}") for k in range(4999)] + [("v0000", f"v{k:04}") for k in range(0, 5000, 3)]
    near = near_of(edges)
    sources = sorted(near)[::420]
    assert len(component(near, "v0000")) == 5000
    pivots = spark.createDataFrame([(s,) for s in sources], "id string")
    check_betweenness(near, {r.id: r.score for r in network.betweenness_of(frame(spark, edges), pivots).collect()}, sources)


def quality(near, community):
    m2 = sum(map(len, near.values()))
    k = defaultdict(int)
    for v, ns in near.items():
        k[community[v]] += len(ns)
    return sum(community[a] == community[b] for a in near for b in near[a]) / m2 - sum((x / m2) ** 2 for x in k.values())


def greedy(near):
    """Merge the pair of the greatest gain until none gains, trying all pairs."""
    community = {v: v for v in near}
    while True:
        now, best = quality(near, community), None
        for a, b in itertools.combinations(sorted(set(community.values())), 2):
            q = quality(near, {v: a if c == b else c for v, c in community.items()})
            if q > now + 1e-12 and (best is None or q > best[0] + 1e-12):
                best = (q, a, b)
        if not best:
            return community
        community = {v: best[1] if c == best[2] else c for v, c in community.items()}


def planted(seed, groups, size):
    r = random.Random(seed)
    names = [[f"g{g}n{k:02}" for k in range(size)] for g in range(groups)]
    edges = [(a, b) for g in names for a, b in itertools.combinations(g, 2) if r.random() < 0.6]
    return edges + [(r.choice(names[g]), r.choice(names[(g + 1) % groups])) for g in range(groups)]


@pytest.mark.parametrize("small", [network.SMALL, 0])
def test_communities(spark, small):
    """Not below greedy merging, by both ways; every vertex has one community, named by its smallest member."""
    edges = FIXTURE + planted(5, 2, 6) if small else FIXTURE
    near = near_of(edges)
    e = frame(spark, edges)
    found = network.communities_of(e, small)
    got = {r.id: r.community for r in found.collect()}
    assert set(got) == set(near) and found.count() == len(near)
    assert all(got[v] == min(w for w in near if got[w] == got[v]) for v in near)
    assert quality(near, got) >= quality(near, greedy(near)) - 1e-6
    assert network.modularity(e, found) == pytest.approx(quality(near, got))


def test_few_vertices_have_no_communities(spark, monkeypatch):
    monkeypatch.setattr(network, "undirected", lambda t: frame(spark, [("a", "b"), ("b", "c")]))
    assert network.communities(None).count() == 0
    monkeypatch.setattr(network, "undirected", lambda t: frame(spark, FIXTURE))
    rows = network.communities(None).collect()
    assert rows and all(r.n >= 2 and r.large == (r.n >= 5) for r in rows)
    monkeypatch.setattr(network, "undirected", lambda t: frame(spark, FIXTURE).limit(0))
    assert network.communities(None).count() == 0 and network.bridges(None).count() == 0 and network.betweenness(None).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_bridges(spark, seed, monkeypatch):
    monkeypatch.setattr(network, "SIBLINGS", 2)
    edges = randomly(seed, 40, 44) + [("hub", f"leaf{k}") for k in range(9)] + [("hub", "v0001")]
    near = near_of(edges)
    want = set()
    for a, b in {tuple(sorted(p)) for p in edges if p[0] != p[1]}:
        near[a].remove(b)
        near[b].remove(a)
        if b not in component(near, a):
            want.add((a, b))
        near[a].add(b)
        near[b].add(a)
    got = [tuple(r) for r in network.bridges_of(frame(spark, edges)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_queries(spark, sf_dir):
    """The whole projection."""
    t = Tables(spark, sf_dir)
    near = near_of([(r.src, r.dst) for r in network.undirected(t).collect()])
    check_betweenness(near, {r.id: r.score for r in network.betweenness(t).collect()})
    got = {(r.a, r.b) for r in network.bridges(t).collect()}
    leaves = {tuple(sorted((v, next(iter(ns))))) for v, ns in near.items() if len(ns) == 1}
    assert leaves <= got
