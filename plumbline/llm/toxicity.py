"""Toxicity: maximum-scoring segments over token log-odds with Dirichlet priors, calibrated by extreme values.

Model. A word's chance to stand in a toxic document is estimated from how many labelled
toxic and clean documents hold it, with a Dirichlet (two classes: beta) prior whose mean
is that of the word's prefix, whose prior in turn is the next shorter prefix, down to the
corpus rate. Words and prefixes are hashed into BUCKETS counters, so the model's size is
fixed whatever the corpus. A token's score is its log-odds against the corpus rate, less
DRIFT, so that clean text has negative drift.

Segments. All maximal scoring segments of a text are found in one linear scan (Ruzzo and
Tompa's stack). A segment of score S among n tokens has E-value K n exp(-lambda S);
lambda solves E[exp(lambda s)] = 1 over the clean calibration texts, and K and the final
logistic curve are fitted on calibration rows that gave no counts. A document's score is
the curve at its evidence: the largest normalised segment and the sum of the significant ones.

Distribution. Training takes a sample of at most SAMPLE labelled rows, chosen by a hash of
doc_id (a documented bound; rows of the held-out fold never), broadcast as ids; their texts
are written once and read by the training passes. Counts are summed per bucket before they
reach the driver (at most BUCKETS rows); calibration returns two numbers a sampled row. Scoring is map-only.

Defined results: null and empty texts score as texts without evidence; texts with the same
words score the same; a null doc_id is never held out nor learned from; long texts are scored
whole; of several labels of a doc_id the larger counts; where no usable labels exist every
score is 0 and predicted 0.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut, released

BUCKETS = 1 << 18
SAMPLE = 20_000
PREFIXES = (3, 4, 5, 6, 7)
PRIOR = 8.0
DRIFT = 1.0
CAP = 6.0
FOLDS = 5
CACHE_WORDS = 200_000

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


def features(word: str) -> list[int]:
    """Buckets from the shortest prefix to the word itself."""
    return [*(bucket(f"{k}:{word[:k]}") for k in PREFIXES if len(word) > k), bucket(f"w:{word}")]


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")).cast("long") % FOLDS


class Model:
    """Counts of documents per bucket and class, and the calibration."""

    def __init__(self, toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float):
        self.toxic, self.clean = toxic, clean
        self.rate = (n_toxic + 1) / (n_toxic + n_clean + 2)
        self.base = math.log(self.rate / (1 - self.rate))
        self.lam, self.k, self.curve = 1.0, 1.0, (-4.0, 1.0, 0.0)
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def token(self, word: str) -> float:
        rate = self.rate
        for b in features(word):
            rate = (self.toxic[b] + PRIOR * rate) / (self.toxic[b] + self.clean[b] + PRIOR)
        return float(min(CAP, max(-CAP, math.log(rate / (1 - rate)) - self.base))) - DRIFT

    def tokens(self, text: str) -> list[float]:
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        out = []
        for w in words_of(text):
            s = known.get(w)
            if s is None:
                s = known[w] = self.token(w)
            out.append(s)
        return out

    def evidence(self, text: str) -> tuple[float, float, list[tuple[int, int, float]]]:
        """The largest normalised segment score, the sum of the significant ones, and those segments."""
        return self.weigh(self.tokens(text))

    def weigh(self, scores: list[float]) -> tuple[float, float, list[tuple[int, int, float]]]:
        """The same of a text's token scores."""
        found = segments(scores)
        if not found:
            return 0.0, 0.0, []
        shift = math.log(max(self.k, 1e-9)) + math.log(max(2, len(scores)))
        bits = [(a, b, self.lam * s - shift) for a, b, s in found]
        kept = [x for x in bits if x[2] > 0]
        return max(0.0, max(x[2] for x in bits)), sum(x[2] for x in kept), kept

    def curve_at(self, best: float, total: float) -> float:
        z = self.curve[0] + self.curve[1] * math.sqrt(best) + self.curve[2] * math.log1p(total)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def score(self, text: str) -> float:
        return self.curve_at(*self.evidence(text)[:2])


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score), by one scan with a stack."""
    out: list[list] = []  # start, end, sum before, sum after
    total = 0.0
    for i, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        new = [i, i + 1, total, total + s]
        total += s
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= new[2]:
                j -= 1
            if j < 0 or out[j][3] >= new[3]:
                out.append(new)
                break
            new = [out[j][0], new[1], out[j][2], new[3]]
            del out[j:]
    return [(a, b, after - before) for a, b, before, after in out]


def _fit_lambda(samples: np.ndarray) -> float:
    """The positive root of E[exp(lambda s)] = 1, by bisection."""
    low, high = 1e-3, 8.0
    value = lambda x: float(np.mean(np.exp(np.minimum(x * samples, 50)))) - 1
    if not len(samples) or samples.max() <= 0 or value(low) >= 0:
        return 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + 1e-2 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def calibrate(best: np.ndarray, total: np.ndarray, toxic: np.ndarray) -> tuple[float, ...]:
    """The curve over both kinds of evidence; more evidence never lowers a score, so a kind with a negative weight is left out."""
    x = np.column_stack([np.sqrt(best), np.log1p(total)])
    both = _logistic(x, toxic)
    if both[1] >= 0 and both[2] >= 0:
        return both
    k = 1 if both[1] < 0 else 0
    one = _logistic(x[:, k : k + 1], toxic)
    return (one[0], 0.0, max(0.0, one[1])) if k else (one[0], max(0.0, one[1]), 0.0)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fits on at most `sample` labelled rows outside the held-out fold; None where a class is missing."""
    rows = (
        labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
        .filter(F.col("_id").isNotNull() & F.col("_toxic").isin(0, 1) & (fold(F.col("_id")) != 0))
        .groupBy("_id")
        .agg(F.max("_toxic").alias("_toxic"))
        .withColumn("_order", F.xxhash64("_id", F.lit(11)))
        .orderBy("_order", "_id")
        .limit(sample)
        .withColumn("_part", F.pmod("_order", F.lit(10)).cast("int"))
        .select("_id", "_toxic", "_part")
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text")).filter("_id is not null")
    chosen = cut(texts.join(F.broadcast(rows), "_id").select("_toxic", "_part", "_text"))

    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, BUCKETS), np.int64)
        n = [0, 0]
        for batch in batches:
            for toxic, part, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part < 7:
                    seen[toxic, list({b for w in set(words_of(text or "")) for b in features(w)})] += 1
                    n[toxic] += 1
        used = np.flatnonzero(seen.any(axis=0))
        ids = np.concatenate([[-1], used])
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(ids, pa.int64()), "toxic": pa.array(np.concatenate([[n[1]], seen[1, used]]), pa.int64()), "clean": pa.array(np.concatenate([[n[0]], seen[0, used]]), pa.int64())})

    counts = chosen.mapInArrow(count, "bucket long, toxic long, clean long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toPandas()
    totals = counts[counts.bucket == -1]
    counts = counts[counts.bucket >= 0]
    if totals.empty or int(totals.toxic.iloc[0]) == 0 or int(totals.clean.iloc[0]) == 0:
        return None
    toxic, clean = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32)
    toxic[counts.bucket], clean[counts.bucket] = counts.toxic, counts.clean
    model = Model(toxic, clean, float(totals.toxic.iloc[0]), float(totals.clean.iloc[0]))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    # The calibration rows: first the token scores of clean ones, as a histogram; then each row's evidence.
    edges = np.linspace(-CAP - DRIFT, CAP - DRIFT, 481)

    @released
    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(edges) - 1, np.int64)
        for batch in batches:
            for toxic, part, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part >= 7 and not toxic:
                    total += np.histogram(sent.value.tokens(text or ""), edges)[0]
        sent.value.known.clear()
        yield pa.RecordBatch.from_pydict({"bin": pa.array(range(len(total)), pa.int64()), "n": pa.array(total, pa.int64())})

    bins = chosen.mapInArrow(histogram, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas().sort_values("bin")
    weight = bins.n.to_numpy()
    if not weight.sum():
        return None
    middle = (edges[:-1] + edges[1:]) / 2
    # expand the histogram to at most a million draws in proportion
    share = np.maximum(1, np.round(weight / weight.sum() * 1e6)).astype(int) * (weight > 0)
    model.lam = _fit_lambda(np.repeat(middle, share))

    def measure(fit: Model, best_only: bool) -> pd.DataFrame:
        """Per calibration row: toxic, n words and the evidence under `fit`: the best segment's score alone, or the normalised best and the significant sum."""
        held = docs.sparkSession.sparkContext.broadcast(fit)

        @released
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = held.value
            for batch in batches:
                found = []
                for toxic, part, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if part >= 7:
                        scores = m.tokens(text or "")
                        best, total = (max((s for _, _, s in segments(scores)), default=0.0), 0.0) if best_only else m.weigh(scores)[:2]
                        found.append((toxic, len(scores), best, total))
                yield pa.RecordBatch.from_pydict({n: pa.array([r[k] for r in found], kind) for k, (n, kind) in enumerate((("toxic", pa.int64()), ("n", pa.int64()), ("best", pa.float64()), ("total", pa.float64())))})
            m.known.clear()

        return chosen.mapInArrow(run, "toxic long, n long, best double, total double").toPandas()

    rows = measure(model, True)
    # mean of a Gumbel variable: (log(K n) + 0.5772) / lambda
    quiet = rows[(rows.toxic == 0) & (rows.best > 0)]
    if len(quiet):
        model.k = float(np.exp(np.median(model.lam * quiet.best - np.log(np.maximum(2, quiet.n))) - 0.3665))
    rows = measure(model, False)
    model.curve = calibrate(rows.best.to_numpy(float), rows.total.to_numpy(float), rows.toxic.to_numpy(float))
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted and n_passages of every row of docs."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    if model is None:
        return base.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(0).cast("long").alias("n_passages"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            found = [m.evidence(t) for t in texts]
            scores = [m.curve_at(best, total) for best, total, _ in found]
            passages = [len(kept) if s >= 0.5 else 0 for (_, _, kept), s in zip(found, scores, strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "held_out": batch.column(1), "score": pa.array(scores, pa.float64()), "predicted": pa.array([int(s >= 0.5) for s in scores], pa.int32()), "n_passages": pa.array(passages, pa.int64())})
        m.known.clear()

    return base.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_passages long")


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """Every significant passage: doc_id, first word, word after the last, normalised score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, a, b, s) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for a, b, s in sent.value.evidence(t or "")[2]]
            yield pa.RecordBatch.from_pydict({n: pa.array([r[k] for r in rows], kind) for k, (n, kind) in enumerate((("doc_id", pa.int64()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("score", pa.float64())))})

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, first_word long, end_word long, score double")


def keep_clean(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns."""
    if model is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([sent.value.score(t or "") < 0.5 for t in batch.column(at).to_pylist()], pa.bool_()))
        sent.value.known.clear()

    return docs.mapInArrow(run, docs.schema)
