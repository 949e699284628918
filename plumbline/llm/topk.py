"""Exact top-k by inner product over a bit-sliced index.

Index. A block of candidates holds its integer attributes as bit slices: slice b of
attribute j is a bitmap over the block's rows with bit b of the attribute's quantised
value (the attribute less its least value in the block, shifted to BITS bits).

Search. For a query the slices of all attributes are added with bitmap arithmetic, each as
often and as far shifted as the quantised query component has bits; for a negative
component the complement slices are added, so every term is non-negative. The sum is again
a stack of bitmaps. Rows are selected from its most significant slice downward: rows with a
one in a slice are surely above those without, so the set of the k highest quantised sums
is narrowed slice by slice. The quantisation error of a query is bounded exactly, so every
row whose sum is within that bound of the k-th is resolved by the exact integer product.

Scale. Queries and candidates are cut into blocks and each pair of blocks is one group, which
builds its index once for all queries of the block: memory is two blocks, nothing is
broadcast, and each pair returns at most k rows a query, from which the last window takes the
k best. Blocks of queries grow with the work, up to MOST_QUERIES, so that on large tables the
candidates are copied (and indexed) once per MOST_QUERIES queries.

Defined results: vectors that are null, empty or hold a null or non-finite component take
no part, nor does a null vec_id; shorter vectors count zeros for what they lack; a row with
the query's own vec_id is its own; equal scores go to the smaller vec_id. Components beyond
the range of 64-bit integers count as its end; products beyond it rank exactly, and their
score is shown as its end. Repeated rows are candidates each, but one query; query rows that share a
vec_id and differ in vector get a ranking each; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import cut

SCALE = 1024
BITS = 7
#: Query components keep their highest 16 bits in the slices' sum.
QUERY_BITS = 16
LEAST_QUERIES, MOST_QUERIES = 128, 4_096
#: Groups wanted before blocks of queries grow.
GROUPS = 256
#: Beyond this size of a component the sums of products are done in unbounded integers.
LARGE = 1 << 26
CANDIDATE_BLOCK = 32_768


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v: floor(scale x component), of the vectors that take part."""
    e = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    fine = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, lambda x: F.floor(x * scale).cast("long")).alias("v"))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for k, x in enumerate(column):
        out[k, : len(x)] = x
    return out


class SlicedBlock:
    """Bit slices of a block of integer vectors."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, bits: int = BITS):
        self.ids, self.v, self.n = ids, v, len(ids)
        self.large = bool(((v > LARGE) | (v < -LARGE)).any())
        if self.large:
            return
        self.low = v.min(axis=0)
        span = int((v.max(axis=0) - self.low).max())
        self.bits = bits
        self.shift = max(0, span.bit_length() - bits)
        u = (v - self.low) >> self.shift
        words = -(-self.n // 64)
        self.slices = np.zeros((v.shape[1], bits, words), np.uint64)
        for b in range(bits):
            packed = np.packbits(((u >> b) & 1).astype(np.uint8), axis=0, bitorder="little")
            flat = np.zeros((v.shape[1], words * 8), np.uint8)
            flat[:, : packed.shape[0]] = packed.T
            self.slices[:, b] = flat.view(np.uint64)
        valid = np.zeros(words * 8, np.uint8)
        valid[: -(-self.n // 8)] = np.packbits(np.ones(self.n, np.uint8), bitorder="little")
        self.valid = valid.view(np.uint64)

    def sums(self, weights: np.ndarray) -> list[np.ndarray]:
        """The slices of sum |w_j| u_j (u_j complemented for negative weights), by ripple-carry addition of bitmaps."""
        total: list[np.ndarray] = []

        def add(slices: np.ndarray, at: int) -> None:
            carry = None
            for k in range(at, at + len(slices)):
                while len(total) <= k:
                    total.append(np.zeros_like(self.valid))
                a, b = total[k], slices[k - at]
                half = a ^ b
                if carry is None:
                    total[k], carry = half, a & b
                else:
                    total[k], carry = half ^ carry, (a & b) | (half & carry)
            k = at + len(slices)
            while carry.any():
                if len(total) <= k:
                    total.append(np.zeros_like(self.valid))
                total[k], carry = total[k] ^ carry, total[k] & carry
                k += 1

        for j in np.flatnonzero(weights):
            w = int(weights[j])
            own = self.slices[j] if w > 0 else ~self.slices[j] & self.valid
            w = abs(w)
            for b in range(w.bit_length()):
                if w >> b & 1:
                    add(own, b)
        return total

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: self.n])

    def values(self, total: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
        """The sums of some rows, read back from the slices."""
        word, bit = rows >> 6, (rows & 63).astype(np.uint64)
        out = np.zeros(len(rows), np.int64)
        for k, s in enumerate(total):
            out |= ((s[word] >> bit) & np.uint64(1)).astype(np.int64) << k
        return out

    def at_least(self, total: list[np.ndarray], threshold: int) -> np.ndarray:
        """Bitmap of the rows whose sum is threshold or more: one pass over the slices."""
        if threshold <= 0:
            return self.valid.copy()
        if threshold >> len(total):
            return np.zeros_like(self.valid)
        above, equal = np.zeros_like(self.valid), self.valid.copy()
        for k in range(len(total) - 1, -1, -1):
            if threshold >> k & 1:
                equal &= total[k]
            else:
                above |= equal & total[k]
                equal &= ~total[k]
        return above | equal

    def kth(self, total: list[np.ndarray], k: int, allowed: np.ndarray) -> int:
        """The k-th highest sum among the allowed rows, found from the most significant slice downward."""
        value, equal, want = 0, allowed.copy(), k
        for s in range(len(total) - 1, -1, -1):
            ones = equal & total[s]
            n = int(np.bitwise_count(ones).sum())
            if n >= want:
                equal, value = ones, value | 1 << s
            else:
                want -= n
                equal &= ~total[s]
        return value

    def search(self, query_id: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (vec_id, score) but for the query's own rows."""
        if self.large or ((q > LARGE) | (q < -LARGE)).any():
            rows = np.flatnonzero(self.ids != query_id)
            exact = self.v[rows].astype(object) @ q.astype(object)
            best = sorted(zip([-int(x) for x in exact], self.ids[rows].tolist(), strict=True))[:k]
            return [(i, max(-(1 << 63), min((1 << 63) - 1, -x))) for x, i in best]
        top = int(np.abs(q).max()) if len(q) else 0
        cut_bits = max(0, top.bit_length() - QUERY_BITS)
        weights = np.sign(q) * (np.abs(q) >> cut_bits)
        allowed = self.valid.copy()
        own = np.flatnonzero(self.ids == query_id)
        for r in own:
            allowed[r >> 6] &= ~(np.uint64(1) << np.uint64(r & 63))
        n = self.n - len(own)
        if n <= k or not weights.any():
            rows = self._rows(allowed)
        else:
            total = self.sums(weights)
            # The attribute is low + 2^shift u + r with 0 <= r < 2^shift and the component 2^cut w + g with 0 <= g < 2^cut. Up to a
            # constant, a row's product is 2^(shift + cut) times its sum plus an error whose spread is at most sum(|q| 2^shift + g 2^shift most_u).
            most_u = (1 << self.bits) - 1
            unit = 1 << (self.shift + cut_bits)
            rest = np.abs(q) - (np.abs(q) >> cut_bits << cut_bits)
            error = int((np.abs(q) << self.shift).sum() + (rest << self.shift).sum() * most_u)
            slack = -(-error // unit) + 1
            threshold = self.kth(total, k, allowed) - slack
            rows = self._rows(self.at_least(total, threshold) & allowed)
        score = self.v[rows] @ q
        order = np.lexsort((self.ids[rows], -score))[:k]
        return [(int(self.ids[rows[i]]), int(score[i])) for i in order]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, query_block: int | None = None, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score: for each query (vec_id, v) its k best of vectors (vec_id, v)."""
    vectors, queries = cut(vectors), cut(queries.select("vec_id", "v").distinct().withColumn("query", F.monotonically_increasing_id()))
    n_candidates, n = max(1, -(-vectors.count() // candidate_block)), queries.count()
    query_block = query_block or min(MOST_QUERIES, max(LEAST_QUERIES, -(-n * n_candidates // GROUPS)))
    n_queries = max(1, -(-n // query_block))
    block = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    left = queries.select(block(n_queries, 1).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_candidates - 1))).alias("cb"), "query", F.col("vec_id").alias("query_id"), "v")
    right = vectors.select(F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))).alias("qb"), block(n_candidates, 2).alias("cb"), "vec_id", "v")

    def pair(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(c):
            width = max(q.v.map(len).max(), c.v.map(len).max())
            sliced = SlicedBlock(c.vec_id.to_numpy(np.int64), _matrix(c.v, width))
            for query, query_id, v in zip(q["query"].to_numpy(np.int64), q.query_id.to_numpy(np.int64), _matrix(q.v, width), strict=True):
                found += [(int(query), int(query_id), i, s) for i, s in sliced.search(int(query_id), v, k)]
        return pd.DataFrame(found, columns=["query", "query_id", "vec_id", "score"])

    best = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(pair, "query long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k_of_table(embeddings: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """The queries are the rows whose vec_id is divisible by `every`."""
    v = integers(embeddings)
    return top_k(v, v.filter(F.col("vec_id") % every == 0), k)
