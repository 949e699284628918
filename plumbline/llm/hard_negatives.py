"""Hard-negative mining by dual-tree search.

Problem. Each anchor's positives are its best `positives` other rows of its label, by inner
product. For each positive, the negatives are the best `negatives` rows of other labels whose
score lies between LEAST percent of the positive's score and the positive's score.

Trees. A block of rows is a ball tree: nodes halve their rows along the direction of widest
spread and keep centre, radius and the norms' bound; leaves hold up to LEAF rows. For two
nodes the inner products of all their rows lie within <c1, c2> +- (|c1| r2 + |c2| r1 + r1 r2).

Dual descent. Anchors and candidates of a block pair each have a tree, and pairs of nodes are
descended together, level by level: a pair falls, with all its anchors, where its interval
cannot reach the score windows that its anchors ask for. What is left is, for each anchor leaf,
a list of candidate leaves by falling upper bound; they are scored exactly until the bound
falls below the worst score that the leaf's anchors still keep, which prunes the rest at once.

Scale. Anchors and candidates are dealt to blocks, and each pair of blocks is one group:
memory is two blocks, nothing is broadcast, and a pair returns at most k rows an anchor (or an
anchor and positive), of which windows take the best. Candidates are copied once per block of
MOST_ANCHORS anchors. Positives meet within their label, whose blocks follow from its counts, so
a label with a third of all rows is as many blocks as it needs. Rows are dealt to blocks by their hash.

Defined results: rows with a null vec_id or label, or a vector that is null, empty or holds a
null or non-finite component take no part; shorter vectors count zeros for what they lack. Equal
scores go to the smaller vec_id. Repeated rows count each as candidates, so they may fill several
ranks; an anchor that is repeated is one anchor for each of its (label, vector) and is no
candidate of its own vec_id. Scores beyond 64-bit integers rank by their end; where products
could leave the exact range of doubles they are made in unbounded integers. An empty table, or one without anchors, gives no rows; other columns of the
table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import cut

SCALE = 256
#: Percent of the positive's score that a negative must reach.
LEAST = 80
LEAF = 128
ANCHOR_LEAF = 16
LEAST_ANCHORS, MOST_ANCHORS = 128, 2_048
CANDIDATE_BLOCK = 32_768
#: Groups wanted before blocks of anchors grow.
GROUPS = 256
#: Sums of products are exact in doubles below EXACT, and times the rows of a block they fit an integer key below KEYED.
EXACT, KEYED = 1 << 52, 1 << 61
_END = (1 << 63) - 1


def integers(vectors: DataFrame, scale: int = SCALE, labels: int = 10, shift_every: int = 7) -> DataFrame:
    """vec_id, label and v: floor(scale x component) of the rows that take part; each shift_every-th vec_id gets the next label."""
    e = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    fine = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))
    vec_id, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    label = F.when(vec_id % shift_every == 0, F.pmod(label + 1, F.lit(labels))).otherwise(label)
    return rows.select(vec_id.alias("vec_id"), label.alias("label"), F.transform(e, lambda x: F.floor(x * scale).cast("long")).alias("v"))


class Ball:
    """A ball tree over the rows of a matrix: arrays of nodes, children behind their parents; `order` lists rows by leaf."""

    def __init__(self, v: np.ndarray, leaf: int):
        self.order = np.arange(len(v))
        lows, highs, kids, centres, radii = [0], [len(v)], [], [], []
        k = 0
        while k < len(lows):
            low, high = lows[k], highs[k]
            rows = v[self.order[low:high]]
            centre = rows.mean(axis=0)
            away = rows - centre
            centres.append(centre)
            radii.append(float(np.sqrt((away * away).sum(axis=1).max())))
            if high - low > leaf:
                # the widest direction, near enough: towards the row that is farthest from the centre
                far = away[int((away * away).sum(axis=1).argmax())]
                half = (high - low) // 2
                self.order[low:high] = self.order[low:high][np.argpartition(rows @ far, half)]
                kids.append(len(lows))
                lows += [low, low + half]
                highs += [low + half, high]
            else:
                kids.append(-1)
            k += 1
        self.low, self.high, self.kids = np.array(lows), np.array(highs), np.array(kids)
        self.centre, self.radius = np.array(centres), np.array(radii)
        self.norm = np.sqrt((self.centre * self.centre).sum(axis=1))

    def over(self, x: np.ndarray, f: np.ufunc) -> np.ndarray:
        """f over the rows of each node."""
        x = x[self.order]
        return np.array([f.reduce(x[a:b]) for a, b in zip(self.low, self.high, strict=True)])


def interval(a: Ball, b: Ball, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner products of the rows of a's nodes p and b's nodes q, with room for rounding."""
    mid = np.einsum("ij,ij->i", a.centre[p], b.centre[q])
    wide = a.norm[p] * b.radius[q] + b.norm[q] * a.radius[p] + a.radius[p] * b.radius[q]
    wide += 1e-9 * (1 + np.abs(mid) + wide + a.norm[p] * b.norm[q])
    return mid - wide, mid + wide


def leaf_pairs(a: Ball, b: Ball, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaf pairs (of a, of b) whose interval meets the window [least, most] of a's node, and their upper bounds."""
    p, q = np.zeros(1, np.int64), np.zeros(1, np.int64)
    found = []
    while len(p):
        low, high = interval(a, b, p, q)
        live = (high >= least[p]) & (low <= most[p])
        p, q, high = p[live], q[live], high[live]
        split_a, split_b = a.kids[p] >= 0, b.kids[q] >= 0
        done = ~split_a & ~split_b
        found.append((p[done], q[done], high[done]))
        # the larger ball is opened first
        open_a = split_a & (~split_b | (a.radius[p] >= b.radius[q]))
        open_b = ~done & ~open_a
        pa, qa, pb, qb = p[open_a], q[open_a], p[open_b], q[open_b]
        p = np.concatenate([a.kids[pa], a.kids[pa] + 1, pb, pb])
        q = np.concatenate([qa, qa, b.kids[qb], b.kids[qb] + 1])
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for k, x in enumerate(column):
        out[k, : len(x)] = x
    return out


def search(anchors: pd.DataFrame, windows: list[np.ndarray], rows: pd.DataFrame, k: int, same: bool) -> Iterator[tuple[int, int, int, int]]:
    """(anchor, window, vec_id, score): for each window of each anchor its k best rows.

    windows: for each anchor an array of (least, most) scores. same: rows of the anchor's label but its own vec_id, else rows of other labels."""
    if not len(anchors) or not len(rows):
        return
    width = int(max(anchors.v.map(len).max(), rows.v.map(len).max()))
    x, y = _matrix(anchors.v, width), _matrix(rows.v, width)
    ids, labels = rows.vec_id.to_numpy(np.int64), rows.label.to_numpy(np.int64)
    own, own_label = anchors.vec_id.to_numpy(np.int64), anchors.label.to_numpy(np.int64)
    most = max(1, -int(x.min()), int(x.max())) * max(1, -int(y.min()), int(y.max())) * width
    if most >= EXACT or most * len(rows) >= KEYED:
        yield from _search_large(own, own_label, windows, x, ids, labels, y, k, same)
        return
    # rows in the order of vec_id: an integer key of score and place orders rows as asked
    order = np.argsort(ids, kind="stable")
    ids, labels, y = ids[order], labels[order], y[order].astype(np.float64)
    x, n = x.astype(np.float64), len(ids)
    key = lambda score, place: score * n + (n - 1 - place)
    a, b = Ball(x, ANCHOR_LEAF), Ball(y, LEAF)
    count = np.array([len(w) for w in windows])
    first = np.concatenate([[0], np.cumsum(count)])
    flat = np.concatenate(windows) if first[-1] else np.zeros((0, 2), np.int64)
    of = np.repeat(np.arange(len(own)), count)
    lowest = np.full(len(own), np.inf)
    highest = np.full(len(own), -np.inf)
    np.minimum.at(lowest, of, flat[:, 0])
    np.maximum.at(highest, of, flat[:, 1])
    best = np.full((len(flat), k), -1 - (1 << 62), np.int64)
    p, q, high = leaf_pairs(a, b, a.over(lowest, np.minimum), a.over(highest, np.maximum))
    by_leaf = np.lexsort((-high, p))
    p, q, high = p[by_leaf], q[by_leaf], high[by_leaf]
    starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]]) if len(p) else []
    for s, e in zip(starts, [*starts[1:], len(p)], strict=True):
        group = a.order[a.low[p[s]] : a.high[p[s]]]
        asked = np.concatenate([np.arange(first[g], first[g + 1]) for g in group])
        if not len(asked):
            continue
        at = np.repeat(np.arange(len(group)), count[group])
        least, most = flat[asked, :1], flat[asked, 1:]
        for leaf, bound in zip(q[s:e], high[s:e], strict=True):
            # a row enters a window's best only above its floor: the window's end or the worst that is kept
            floor = np.maximum(best[asked].min(axis=1) // n, least[:, 0])
            if bound < floor.min():
                break
            members = b.order[b.low[leaf] : b.high[leaf]]
            score = np.rint(x[group] @ y[members].T).astype(np.int64)
            fits = (own_label[group][:, None] == labels[members][None, :]) & (own[group][:, None] != ids[members][None, :]) if same else own_label[group][:, None] != labels[members][None, :]
            lines = np.flatnonzero((np.where(fits, score, -1 - (1 << 61)).max(axis=1))[at] >= floor)
            if not len(lines):
                continue
            mine = score[at[lines]]
            inside = fits[at[lines]] & (mine >= least[lines]) & (mine <= most[lines])
            keyed = np.where(inside, key(mine, members[None, :]), -1 - (1 << 62))
            both = np.concatenate([best[asked[lines]], keyed], axis=1)
            best[asked[lines]] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
    window, slot = np.nonzero(best > -1 - (1 << 62))
    for w, value in zip(window.tolist(), best[window, slot].tolist(), strict=True):
        yield int(of[w]), int(w - first[of[w]]), int(ids[n - 1 - value % n]), value // n


def _search_large(own, own_label, windows, x, ids, labels, y, k, same) -> Iterator[tuple[int, int, int, int]]:
    """The same in unbounded integers, an anchor at a time."""
    y = y.astype(object)
    for g, anchor in enumerate(x.astype(object)):
        score = [max(-_END - 1, min(_END, int(s))) for s in y @ anchor]
        for w, (least, most) in enumerate(windows[g].tolist()):
            fits = [(-s, i) for s, i, lab in zip(score, ids.tolist(), labels.tolist(), strict=True) if (lab == own_label[g]) == same and (not same or i != own[g]) and least <= s <= most]
            yield from ((g, w, i, -s) for s, i in sorted(fits)[:k])


def _pairs(anchors: DataFrame, rows: DataFrame, by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Anchors and rows with the blocks qb and cb of every group that they belong to, within equal values of `by`."""
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / F.lit(CANDIDATE_BLOCK)))
    size = lambda m, cbs: F.least(F.lit(MOST_ANCHORS), F.greatest(F.lit(LEAST_ANCHORS), F.ceil(m * cbs / GROUPS)))
    if by:
        counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).join(anchors.groupBy(by).agg(F.count(F.lit(1)).alias("m")), by)
        shape = counts.withColumn("_cbs", blocks(F.col("n")).cast("int"))
        shape = cut(shape.select(by, "_cbs", F.greatest(F.lit(1), F.ceil(F.col("m") / size(F.col("m"), F.col("_cbs")))).cast("int").alias("_qbs")))
        anchors, rows = anchors.join(shape, by), rows.join(shape, by)
    else:
        cbs = max(1, -(-rows.count() // CANDIDATE_BLOCK))
        m = anchors.count()
        qbs = max(1, -(-m // min(MOST_ANCHORS, max(LEAST_ANCHORS, -(-m * cbs // GROUPS)))))
        anchors, rows = (df.withColumn("_cbs", F.lit(cbs)).withColumn("_qbs", F.lit(qbs)) for df in (anchors, rows))
    dealt = lambda n, salt: F.pmod(F.xxhash64("vec_id", "v", F.lit(salt)), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = anchors.withColumn("qb", dealt("_qbs", 1)).withColumn("cb", upto("_cbs")).drop("_cbs", "_qbs")
    right = rows.withColumn("cb", dealt("_cbs", 2)).withColumn("qb", upto("_qbs")).drop("_cbs", "_qbs")
    return left, right


def best_positives(vectors: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """anchor (its number), positive_id, positive_score and place: for each anchor its k best other rows of its label."""
    left, right = _pairs(anchors, vectors, "label")

    def pair(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        every = np.array([[-_END - 1, _END]], np.int64)
        found = [(int(q.anchor.iloc[g]), i, s) for g, _, i, s in search(q, [every] * len(q), c, k, True)]
        return pd.DataFrame(found, columns=["anchor", "positive_id", "positive_score"])

    best = left.groupBy("label", "qb", "cb").cogroup(right.groupBy("label", "qb", "cb")).applyInPandas(pair, "anchor long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor").orderBy(F.col("positive_score").desc(), "positive_id")
    return best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, least: int = LEAST) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and scores, of vectors and anchors (vec_id, label, v)."""
    vectors = cut(vectors)
    anchors = cut(anchors.distinct().withColumn("anchor", F.monotonically_increasing_id()))
    found = cut(best_positives(vectors, anchors, positives))
    asked = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("asked"))
    asked = asked.select("anchor", F.col("asked.place").alias("places"), F.col("asked.positive_score").alias("scores"))
    left, right = _pairs(anchors.join(asked, "anchor"), vectors)

    def pair(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        q = q.reset_index(drop=True)
        # 100 negative >= least positive, in whole numbers and without leaving the range
        windows = [np.array([(-(-least * int(s) // 100), int(s)) for s in row], np.int64) for row in q.scores]
        rows = [(int(q.anchor[g]), int(q.places[g][w]), i, s) for g, w, i, s in search(q, windows, c, negatives, False)]
        return pd.DataFrame(rows, columns=["anchor", "place", "negative_id", "negative_score"])

    best = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(pair, "anchor long, place int, negative_id long, negative_score long")
    order = Window.partitionBy("anchor", "place").orderBy(F.col("negative_score").desc(), "negative_id")
    best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    named = found.join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    return best.join(named, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine_table(embeddings: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5) -> DataFrame:
    """Hard negatives of the rows whose vec_id is divisible by `every`."""
    v = integers(embeddings)
    return hard_negatives(v, v.filter(F.col("vec_id") % every == 0), positives, negatives)
