"""Graph algorithms as iterated joins; each round's state is cut by a table written to the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.patterns import edges
from plumbline.plans.registry import query
from plumbline.plans.tables import Tables


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a local master a temporary one where that is unset."""
    context = spark.sparkContext
    found = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="plumbline-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def settle(df: DataFrame, within: str = "") -> DataFrame:
    """Ends the lineage with a table written to the shared folder, or to one within it that can be discarded as a whole.

    A checkpoint would keep the plan's estimate of the size, which is a product over its joins: over rounds that join their own state the
    number itself grows without bound, and the driver with it. A written table has the size of its files."""
    folder = f"{shared_folder(df.sparkSession)}/plumbline/{within + '/' if within else ''}{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def discard(spark: SparkSession, within: str) -> None:
    """Removes the tables that were settled within a folder of their own."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/plumbline/{within}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def undirected(t: Tables) -> DataFrame:
    # pairs are made distinct one way, then turned; least and greatest would leave a missing end out
    e = edges(t).select("src", "dst")
    turned = F.col("src") > F.col("dst")
    pairs = e.select(F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("a"), F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("b")).distinct()
    ends = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    return pairs.select(F.inline(F.array_distinct(ends)))


@query("jn09_paths", """, e AS (SELECT src, dst FROM owns), p AS (SELECT src, dst, 1 AS hops, [src || '>' || dst] AS used FROM e UNION ALL SELECT p.src, e.dst, p.hops + 1, list_append(p.used, e.src || '>' || e.dst) FROM p JOIN e ON p.dst = e.src WHERE p.hops < 3 AND NOT list_contains(p.used, e.src || '>' || e.dst)) SELECT src, dst, CAST(hops AS INTEGER) AS hops FROM p""")
def paths(t: Tables, depth: int = 3) -> DataFrame:
    """Trails of up to `depth` relationships: a node may return, a relationship may not."""
    e = t.owns.withColumn("edge", F.concat_ws(">", "src", "dst"))
    out = step = e.select("src", "dst", F.lit(1).alias("hops"), F.array("edge").alias("used"))
    for k in range(2, depth + 1):
        nxt = e.select(F.col("src").alias("dst"), F.col("dst").alias("to"), "edge")
        step = step.join(nxt, "dst").filter(~F.array_contains("used", F.col("edge"))).select("src", F.col("to").alias("dst"), F.lit(k).alias("hops"), F.concat("used", F.array("edge")).alias("used"))
        out = out.union(step)
    return out.select("src", "dst", "hops")


@query("jn10_shortest_paths", """, e AS (SELECT 'p' || pol AS a, 'c' || comp AS b FROM director UNION SELECT 'c' || comp, 'p' || pol FROM director UNION SELECT 'c' || src, 'c' || dst FROM owns UNION SELECT 'c' || dst, 'c' || src FROM owns), r AS (SELECT min(a) AS id, 0 AS d FROM e UNION SELECT e.b, r.d + 1 FROM r JOIN e ON e.a = r.id WHERE r.d < 5) SELECT id, CAST(min(d) AS INTEGER) AS hops FROM r WHERE id IS NOT NULL GROUP BY id""")
def shortest_paths(t: Tables, most: int = 5) -> DataFrame:
    """Hops from the first vertex, by a frontier that meets only unseen vertices."""
    e = undirected(t)
    seen = frontier = e.agg(F.min("src").alias("id")).filter("id is not null").withColumn("hops", F.lit(0))
    for k in range(1, most + 1):
        frontier = frontier.join(e, frontier.id == e.src).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("hops", F.lit(k))
        frontier = settle(frontier)
        seen = seen.union(frontier)
        if frontier.isEmpty():
            break
    return seen


@query("gr05_cycles", """, c AS (SELECT src AS start, dst AS here, 1 AS n, [src] AS seen FROM owns UNION ALL SELECT c.start, o.dst, c.n + 1, list_append(c.seen, c.here) FROM c JOIN owns o ON c.here = o.src WHERE c.n < 6 AND c.here > c.start AND NOT list_contains(c.seen, c.here)) SELECT start, CAST(n AS INTEGER) AS length FROM c WHERE here = start AND n >= 2""")
def cycles(t: Tables, most: int = 6) -> DataFrame:
    """Elementary cycles, each once: the start is its smallest node."""
    step = t.owns.select(F.col("src").alias("start"), F.col("dst").alias("at"), F.array("src").alias("seen"))
    out = None
    for n in range(2, most + 1):
        step = step.filter("at > start and not array_contains(seen, at)").join(t.owns, F.col("at") == F.col("src")).select("start", F.col("dst").alias("to"), F.concat("seen", F.array("at")).alias("seen")).withColumnRenamed("to", "at")
        closed = step.filter("at = start").select("start", F.lit(n).alias("length"))
        out = closed if out is None else out.union(closed)
    return out


#: Edges, both ways, from which on the rest of a contraction is done in one task.
LAST = 20_000


def _joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """a and up (the vertex that it has become) of the vertices of few edges, each with one edge (src, dst) of the forest."""
    up: dict[str, str] = {}
    tree = []

    def top(v: str) -> str:
        while v in up:
            up[v] = v = up.get(up[v], up[v])
        return v

    for frame in frames:
        for a, b, src, dst in zip(frame.a, frame.b, frame.src, frame.dst, strict=True):
            x, y = top(a), top(b)
            if x != y:
                up[max(x, y)] = min(x, y)
                tree.append((src, dst))
    yield pd.DataFrame({"a": list(up), "up": [top(v) for v in list(up)], "src": [t[0] for t in tree], "dst": [t[1] for t in tree]}, dtype=object)


def contracted(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels (id and root, the smallest vertex of its component) and tree (src, dst: a spanning forest's edges, each once) of the settled edges e (src, dst, both ways).

    In each round every vertex with a neighbour of a lower hash joins the lowest one, and what has joined becomes one vertex; edges within
    it and parallel ones fall away. Half of the vertices or more go in a round, so rounds grow with the logarithm of the vertices, whatever
    the depth; the last LAST edges are done in one task."""
    live = e.filter("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"), "src", "dst")
    tops, trees = [], []
    while n := live.count():
        if n <= LAST:
            joined = settle(live.coalesce(1).mapInPandas(_joined, "a string, up string, src string, dst string"))
            trees.append(joined.select("src", "dst"))
            tops.append(joined.select("a", "up"))
            break
        rank = lambda c, r=len(tops): F.struct(F.xxhash64(c, F.lit(r)).alias("h"), F.col(c).alias("v"))
        lowest = live.groupBy("a").agg(F.min(F.struct(rank("b").alias("to"), "src", "dst")).alias("m"))
        joined = settle(lowest.filter(F.col("m.to") < rank("a")).select("a", F.col("m.to.v").alias("up"), "m.src", "m.dst"))
        trees.append(joined.select("src", "dst"))
        top = joined.select("a", "up")
        while True:
            # two doublings a round
            for _ in range(2):
                beyond = top.select(F.col("a").alias("up"), F.col("up").alias("beyond"))
                after = top.select("a", "up").join(beyond, "up", "left").select("a", F.coalesce("beyond", "up").alias("up"), F.col("beyond").isNotNull().alias("moved"))
                top = after.select("a", "up")
            after = settle(after)
            top = after.select("a", "up")
            if after.filter("moved").isEmpty():
                break
        tops.append(top)
        moved = live.join(top.withColumnRenamed("up", "_a"), "a", "left").join(top.select(F.col("a").alias("b"), F.col("up").alias("_b")), "b", "left")
        moved = moved.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"), "src", "dst").filter("a <> b")
        live = settle(moved.groupBy("a", "b").agg(F.min(F.struct("src", "dst")).alias("e")).select("a", "b", "e.src", "e.dst"))
    own = e.select(F.col("src").alias("id")).distinct()
    if not tops:
        return settle(own.withColumn("root", F.col("id"))), e.limit(0)
    found = tops[-1]
    for top in reversed(tops[:-1]):
        up = top.join(found.select(F.col("a").alias("up"), F.col("up").alias("root")), "up", "left").select("a", F.coalesce("root", "up").alias("up"))
        found = settle(up.union(found))
    placed = own.join(found.withColumnRenamed("a", "id"), "id", "left").select("id", F.coalesce("up", "id").alias("up"))
    least = placed.groupBy("up").agg(F.min("id").alias("root"))
    return settle(placed.join(least, "up").select("id", "root")), settle(reduce(DataFrame.union, trees))


def coded(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """own (id, v: a number of its own for every vertex) and the edges of e (src, dst, both ways) by numbers, one way each (a, b), without loops."""
    ids = e.filter("src is not null").select(F.col("src").alias("id")).distinct()
    seed = 0
    while True:
        number = lambda c, s=seed: F.xxhash64(F.lit(s), F.col(c))
        own = settle(ids.select("id", number("id").alias("v")))
        # numbers are drawn anew if two vertices have the same
        if own.groupBy("v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
            return own, settle(e.filter("src < dst").select(number("src").alias("a"), number("dst").alias("b")).distinct())
        seed += 1


def _united(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """a and up (the least vertex that it is joined to) of the vertices of few edges (a, b)."""
    up: dict[int, int] = {}

    def top(v: int) -> int:
        while v in up:
            up[v] = v = up.get(up[v], up[v])
        return v

    for frame in frames:
        for a, b in zip(frame.a.tolist(), frame.b.tolist(), strict=True):
            x, y = top(a), top(b)
            if x != y:
                up[max(x, y)] = min(x, y)
    yield pd.DataFrame({"a": list(up), "up": [top(v) for v in list(up)]}, dtype="int64")


def joined_to(live: DataFrame) -> DataFrame | None:
    """a and up of the vertices of the settled edges (a, b: numbers, one way) that are not the one that stands for their component; none without edges.

    Rounds are those of `contracted`, over numbers alone and without a forest. Ranks are the numbers with some bits turned, so the
    lowest neighbour is a least number."""
    tops = []
    while n := live.count():
        if n <= LAST:
            tops.append(settle(live.coalesce(1).mapInPandas(_united, "a long, up long")))
            break
        turned = F.xxhash64(F.lit(len(tops)))
        rank = lambda c: F.col(c).bitwiseXOR(turned)
        ends = live.select("a", rank("b").alias("to")).union(live.select(F.col("b").alias("a"), rank("a").alias("to")))
        lowest = ends.groupBy("a").agg(F.min("to").alias("to")).filter(F.col("to") < rank("a"))
        top = settle(lowest.select("a", rank("to").alias("up")))
        while True:
            # two doublings a round
            for _ in range(2):
                beyond = top.select(F.col("a").alias("up"), F.col("up").alias("beyond"))
                after = top.select("a", "up").join(beyond, "up", "left").select("a", F.coalesce("beyond", "up").alias("up"), F.col("beyond").isNotNull().alias("moved"))
                top = after.select("a", "up")
            after = settle(after)
            top = after.select("a", "up")
            if after.filter("moved").isEmpty():
                break
        tops.append(top)
        moved = live.join(top.withColumnRenamed("up", "_a"), "a", "left").join(top.select(F.col("a").alias("b"), F.col("up").alias("_b")), "b", "left")
        moved = moved.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).filter("a <> b")
        live = settle(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if not tops:
        return None
    found = tops[-1]
    for top in reversed(tops[:-1]):
        up = top.join(found.select(F.col("a").alias("up"), F.col("up").alias("root")), "up", "left").select("a", F.coalesce("root", "up").alias("up"))
        found = settle(up.union(found))
    return found


def labels(e: DataFrame) -> DataFrame:
    """id and root, the smallest vertex of its component, of the settled edges e (src, dst, both ways)."""
    own, live = coded(e)
    found = joined_to(live)
    if found is None:
        return settle(own.select("id", F.col("id").alias("root")))
    placed = own.join(found.withColumnRenamed("a", "v"), "v", "left").select("id", F.coalesce("up", "v").alias("up"))
    least = placed.groupBy("up").agg(F.min("id").alias("root"))
    return settle(placed.join(least, "up").select("id", "root"))


@query("gr04_components", """, e AS (SELECT 'p' || pol AS a, 'c' || comp AS b FROM director UNION SELECT 'c' || comp, 'p' || pol FROM director UNION SELECT 'c' || src, 'c' || dst FROM owns UNION SELECT 'c' || dst, 'c' || src FROM owns), r AS (SELECT a AS id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id) SELECT root, count(*) AS n FROM (SELECT id, min(root) AS root FROM r GROUP BY id) GROUP BY root""")
def component_sizes(t: Tables) -> DataFrame:
    """Connected components by contraction."""
    return labels(settle(undirected(t))).groupBy("root").agg(F.count(F.lit(1)).alias("n"))


@query("gr01_pagerank")
def pagerank(t: Tables, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """PageRank with uniform redistribution of dangling mass until the ranks move by less than nodes x tolerance; parallel edges count once."""
    return pagerank_of(edges(t).select("src", "dst"), damping, rounds, tolerance)


def pagerank_of(e: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    e = settle(e.distinct())
    nodes = settle(e.select(F.col("src").alias("id")).union(e.select("dst")).distinct())
    n = nodes.count()
    out = settle(e.join(e.groupBy("src").agg(F.count(F.lit(1)).alias("degree")), "src"))
    rank = nodes.withColumn("rank", F.lit(1.0 / max(1, n)))
    for _ in range(rounds):
        sent = out.join(rank.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("degree")).alias("got"))
        new = nodes.join(sent, "id", "left").select("id", F.coalesce("got", F.lit(0.0)).alias("got"))
        lost = new.agg((1 - F.sum("got")).alias("lost"))
        after = settle(new.crossJoin(F.broadcast(lost)).select("id", ((1 - damping) / n + damping * (F.col("got") + F.col("lost") / n)).alias("rank")))
        moved = after.join(rank.withColumnRenamed("rank", "before"), "id").agg(F.sum(F.abs(F.col("rank") - F.col("before")))).first()[0]
        rank = after
        if moved is None or moved < n * tolerance:
            break
    return rank.select("id", F.round("rank", 8).alias("rank"))


@query("gr08_ego_role")
def ego_role(t: Tables) -> DataFrame:
    """Each company's part in its own neighbourhood: degree, betweenness among its neighbours' pairs (those not linked themselves), and whether it is above .3.

    In the graph of a vertex and its neighbours, the vertex lies between a pair of neighbours on one of 1 + common paths, unless they are linked."""
    e = settle(undirected(t))
    first = e.filter("src like 'c%'").select(F.col("src").alias("ego"), F.col("dst").alias("a"))
    degree = first.groupBy("ego").agg(F.count(F.lit(1)).alias("degree"))
    # links among the neighbours
    inner = first.join(e.select(F.col("src").alias("a"), F.col("dst").alias("b")), "a").join(first.withColumnRenamed("a", "b"), ["ego", "b"], "left_semi").select("ego", "a", "b")
    two = inner.join(inner.select("ego", F.col("a").alias("b"), F.col("b").alias("c")), ["ego", "b"]).filter("a < c").groupBy("ego", "a", "c").agg(F.count(F.lit(1)).alias("common"))
    linked = inner.filter("a < b").select("ego", "a", F.col("b").alias("c"))
    near = two.join(linked, ["ego", "a", "c"], "left_anti").groupBy("ego").agg(F.sum(1 / (1 + F.col("common"))).alias("some"), F.count(F.lit(1)).alias("pairs"))
    direct = linked.groupBy("ego").agg(F.count(F.lit(1)).alias("links"))
    x = degree.join(near, "ego", "left").join(direct, "ego", "left").fillna(0, ["some", "pairs", "links"])
    pairs = F.col("degree") * (F.col("degree") - 1) / 2
    # the other pairs have no path but through the vertex
    score = F.when(pairs > 0, (pairs - F.col("links") - F.col("pairs") + F.col("some")) / pairs).otherwise(0.0)
    return x.select("ego", "degree", F.round(score, 6).alias("betweenness"), (score > 0.3).alias("broker"))


#: Edges of surroundings that come many to a batch, as matrices; larger ones are measured by their edges, each in a group of its own.
EGO_EDGES = 500
#: Numbers that are held at once for the betweenness in a larger one, and vectors for its connectivity.
EGO_STATES, EGO_VECTORS = 4_000_000, 30


def ego_graphs(egos: DataFrame, e: DataFrame) -> DataFrame:
    """ego, a and b: all edges around each ego (ego), its own ones and its neighbours', each once."""
    e = e.filter("src <> dst")
    own = e.join(egos.select(F.col("ego").alias("src")), "src").select(F.col("src").alias("ego"), F.col("src").alias("a"), F.col("dst").alias("b"))
    beyond = own.select("ego", F.col("b").alias("src")).join(e, "src").filter("dst <> ego").select("ego", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return own.union(beyond.distinct())


SPECTRUM = "ego string, n long, edges long, fiedler double, bridges long, betweenness double, degree long"


def _bridges(near: np.ndarray) -> int:
    return _bridges_of([np.flatnonzero(row).tolist() for row in near])


def _bridges_of(near: list[list[int]]) -> int:
    """Edges of one graph whose removal parts their ends, by the least place that each subtree of a depth-first search reaches."""
    n, found = len(near), 0
    place, low = [-1] * n, [0] * n
    for root in range(n):
        if place[root] >= 0:
            continue
        place[root] = low[root] = 0
        seen, path = 1, [(root, -1, iter(near[root]))]
        while path:
            v, parent, rest = path[-1]
            for w in rest:
                if place[w] < 0:
                    place[w] = low[w] = seen
                    seen += 1
                    path.append((w, v, iter(near[w])))
                    break
                if w != parent:
                    low[v] = min(low[v], place[w])
            else:
                path.pop()
                if parent >= 0:
                    low[parent] = min(low[parent], low[v])
                    found += low[v] == place[v]
    return found


def _between(near: np.ndarray, x: int) -> float:
    """The share of the shortest paths between two others that pass x, over ordered pairs; all sources advance together, level by level."""
    n = len(near)
    distance, paths, level, k = np.where(np.eye(n) > 0, 0, -1), np.eye(n), np.eye(n), 0
    while level.any():
        k += 1
        level = np.where(distance < 0, near @ level, 0)
        distance[level > 0] = k
        paths += level
    between = 0.0
    for s in range(n):
        if s != x and distance[x, s] > 0:
            on = (distance[:, x] > 0) & (distance[:, s] == distance[x, s] + distance[:, x])
            on[s] = False
            between += float((paths[x, s] * paths[:, x][on] / paths[:, s][on]).sum())
    pairs_of_others = (n - 1) * (n - 2)
    return round(between / pairs_of_others, 6) if pairs_of_others else 0.0


def _spectrum(ego: str, a: np.ndarray, b: np.ndarray, whole: bool) -> tuple:
    """Of one small graph: its algebraic connectivity and, if whole, its bridges and the betweenness of the ego; the ego's degree."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = ends[: len(a)], ends[len(a) :]
    near = np.zeros((len(names), len(names)))
    near[i, j] = near[j, i] = 1
    values = np.linalg.eigvalsh(np.diag(near.sum(axis=1)) - near)
    x = int(np.searchsorted(names, ego))
    return ego, len(names), len(a), round(max(0.0, float(values[1])), 6), _bridges(near) if whole else None, _between(near, x) if whole else None, int(near[x].sum())


def _connectivity(around: Callable[[np.ndarray], np.ndarray], degree: np.ndarray) -> float:
    """The second eigenvalue of the Laplacian of one connected graph, by Lanczos steps on its inverse; around sums a vector over each vertex's neighbours.

    Each step is solved by conjugate gradients; after EGO_VECTORS of them they begin anew from the best vector, until the value stays."""
    n = len(degree)

    def solved(q: np.ndarray) -> np.ndarray:
        z, r = np.zeros(n), q
        y = r / degree
        p, ry = y, r @ y
        for _ in range(10 * n):
            to = degree * p - around(p)
            step = ry / (p @ to)
            z, r = z + step * p, r - step * to
            r = r - r.mean()
            y = r / degree
            if r @ y < 1e-22 or np.linalg.norm(r) < 1e-11:
                break
            p, ry = y + (r @ y) / ry * p, r @ y
        return z - z.mean()

    q = np.random.default_rng(0).standard_normal(n)
    last = 0.0
    while True:
        q = q - q.mean()
        basis, alpha, beta = [q / np.linalg.norm(q)], [], []
        while True:
            z = solved(basis[-1])
            alpha.append(z @ basis[-1])
            for _ in range(2):
                for v in basis:
                    z = z - (z @ v) * v
            rest = np.linalg.norm(z)
            if len(basis) >= min(EGO_VECTORS, n - 1) or rest < 1e-8 * max(alpha):
                break
            beta.append(rest)
            basis.append(z / rest)
        values, vectors = np.linalg.eigh(np.diag(alpha) + np.diag(beta, 1) + np.diag(beta, -1))
        if abs(values[-1] - last) <= 1e-8 * values[-1]:
            return float(1 / values[-1])
        last, q = values[-1], np.array(basis).T @ vectors[:, -1]


def _large_spectrum(ego: str, a: np.ndarray, b: np.ndarray, whole: bool) -> tuple:
    """The measures of `_spectrum` by the edges of one graph: memory grows with these, and betweenness takes some sources at a time."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    n, x = len(names), int(np.searchsorted(names, ego))
    i, j = ends[: len(a)], ends[len(a) :]
    source, to = np.concatenate([i, j]), np.concatenate([j, i])
    order = np.argsort(source, kind="stable")
    to, degree = to[order], np.bincount(source, minlength=n)
    start = np.concatenate([[0], np.cumsum(degree)])
    around = lambda v: np.add.reduceat(v[to], start[:-1], axis=0)
    fiedler = round(max(0.0, _connectivity(around, degree.astype(float))), 6)
    if not whole:
        return ego, n, len(a), fiedler, None, None, int(degree[x])

    def reached(sources: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        level = np.zeros((n, len(sources)))
        level[sources, np.arange(len(sources))] = 1
        distance, paths, k = np.where(level > 0, 0, -1), level.copy(), 0
        while level.any():
            k += 1
            level = np.where(distance < 0, around(level), 0)
            distance[level > 0] = k
            paths += level
        return distance, paths

    distance, paths = (m[:, 0] for m in reached(np.array([x])))
    others = np.flatnonzero(np.arange(n) != x)
    between, width = 0.0, max(1, EGO_STATES // len(to))
    for s in np.split(others, range(width, len(others), width)):
        far, ways = reached(s)
        on = far == distance[:, None] + distance[s]
        on[x] = False
        on[s, np.arange(len(s))] = False
        between += float(np.where(on, paths[:, None] * paths[s] / ways, 0).sum())
    pairs_of_others = (n - 1) * (n - 2)
    lists = [v.tolist() for v in np.split(to, start[1:-1])]
    return ego, n, len(a), fiedler, _bridges_of(lists), round(between / pairs_of_others, 6) if pairs_of_others else 0.0, int(degree[x])


def spectra(t: Tables, whole: bool = True) -> DataFrame:
    """The measures of every company's surroundings; without `whole` neither bridges nor betweenness. Graphs of at most EGO_EDGES edges come many to a batch."""
    columns = [c.split()[0] for c in SPECTRUM.split(", ")]

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([_spectrum(ego, a, b, whole) for ego, a, b in zip(frame.ego, frame.a, frame.b, strict=True)], columns=columns)

    def measure_large(rows: pa.Table) -> pa.Table:
        found = _large_spectrum(rows["ego"][0].as_py(), rows["a"].to_numpy(), rows["b"].to_numpy(), whole)
        types = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
        return pa.table({c.split()[0]: pa.array([v], types[c.split()[1]]) for c, v in zip(SPECTRUM.split(", "), found, strict=True)})

    e = settle(undirected(t))
    near = settle(ego_graphs(e.filter("src like 'c%'").select(F.col("src").alias("ego")).distinct(), e))
    large = settle(near.groupBy("ego").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > EGO_EDGES).select("ego"))
    some = not large.isEmpty()
    small = near.join(large, "ego", "left_anti") if some else near
    found = small.groupBy("ego").agg(F.collect_list(F.struct("a", "b")).alias("ends")).select("ego", "ends.a", "ends.b").mapInPandas(measure, SPECTRUM)
    return found.union(near.join(large, "ego", "left_semi").groupBy("ego").applyInArrow(measure_large, SPECTRUM)) if some else found


@query("gr06_ego_spectrum")
def ego_spectrum(t: Tables) -> DataFrame:
    """Second Laplacian eigenvalue of the graph around each company, and its band."""
    band = F.when(F.col("fiedler") < 0.1, "fragile").when(F.col("fiedler") < 0.5, "loose").otherwise("tight")
    return spectra(t, whole=False).select("ego", "n", "fiedler", band.alias("band"))


@query("dt18_spectral_role")
def spectral_role(t: Tables) -> DataFrame:
    """Each company's role by the connectivity of its surroundings, with their bridges and its own part in them, and the findings' severities."""
    poor, fair = F.col("fiedler") < 0.1, F.col("fiedler") < 0.5
    x = spectra(t).withColumn("connectivity", F.when(poor, "POORLY_CONNECTED").when(fair, "MODERATELY_CONNECTED").otherwise("WELL_CONNECTED"))
    x = x.withColumn("role", F.when(poor, "bridge_entity").when(fair, "peripheral_entity").otherwise("core_entity"))
    found = F.array_compact(F.array(F.when(poor, "structural_bridge HIGH"), F.when(F.col("betweenness") > 0.3, "high_betweenness MODERATE")))
    return x.withColumn("findings", F.array_join(found, "; "))


@query("gr03_label_communities")
def label_communities(t: Tables, rounds: int = 5) -> DataFrame:
    """Communities by synchronous label propagation, ties to the smaller label: the scalable form of modularity search."""
    from pyspark.sql import Window

    e = settle(undirected(t))
    label = e.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id"))
    for _ in range(rounds):
        votes = e.join(label.withColumnsRenamed({"id": "dst"}), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.count(F.lit(1)).alias("n"))
        w = Window.partitionBy("id").orderBy(F.col("n").desc(), "label")
        label = settle(votes.withColumn("k", F.row_number().over(w)).filter("k = 1").select("id", "label"))
    return label.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").withColumn("large", F.col("n") >= 5)
