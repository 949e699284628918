"""Near duplicates by Order MinHash, verified by banded alignment.

Similarity. A text's k-mers are its runs of five words (lower case, letters and digits),
each labelled with its occurrence number, so repeats count. Two texts are near copies if
L / (n1 + n2 - L) >= 0.8, where n are their numbers of k-mers and L the longest sequence of
k-mers that both hold in the same order: the Jaccard similarity of labelled k-mers that an
edit leaves in place. For edits without moved passages it is the plain Jaccard similarity.

Sketch. Each of SKETCHES hash functions picks the PICKS smallest labelled k-mers and keeps
them in text order; equal picks in equal order make two texts candidates. At similarity 0.8
a sketch agrees with probability near 0.8^PICKS, so all SKETCHES miss with about 1e-5.

Steps. (1) Texts with equal words are one class (hash of the words, 128 bits), whatever
their number. (2) Each class meets, in each sketch's bucket, the bucket's smallest class if
their lengths allow the similarity: links grow with the classes, not with the square of a
bucket. Candidates are verified by alignment of the
k-mer sequences within the band that the similarity leaves possible; a profile of about
n / 2 counters (a lower bound of the difference) first rules out pairs that cannot reach it. (3) Verified links
are joined into components. (4) Buckets that still hold classes of several components are
compared across components, pair by pair up to BLOCK members and with ROUNDS further heads
beyond; then components are joined again. (5) Buckets of more than BLOCK members that even then
hold several components are compared exactly, cell by cell: a cell is two blocks of a bucket, whose
profiles are compared at once; the pairs left are aligned, or where a cell has many of them its
common k-mers are counted at once and pairs that have enough of them are aligned. No bucket
keeps an uncompared pair of two components. The result is the connected components of verified links.

Scale. Sketching is map-only; buckets, links and labels are narrow rows keyed by hashes;
only texts that are in a candidate pair are read again. Lineage is cut by written tables.
Nothing is collected but counts that end the loop.

Defined results: a text without words is in a class of its own; a text of fewer than five
words is one k-mer, so only texts of equal words are its copies; repeated rows are
copies; rows that share a doc_id and differ in text are different texts, each compared for
itself; a null doc_id is in no group unless its words equal those of a row that has one, and
its class_id is null. Of the rows of a group keep_one keeps that of the smallest doc_id, of
several texts with it the one with the smallest hash, and of its repeated rows the one that
is first as JSON; rows with a null doc_id or without words always stay.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import batches_of, cut, released, text_of

WORDS = 5
SIMILARITY = 0.8
SKETCHES = 24
PICKS = 4
#: Open members of a bucket that are compared pair by pair; beyond it, further heads come first and cells do the rest.
BLOCK = 24
ROUNDS = 3
#: Members and k-mers of a block of a cell, on average.
CELL_MEMBERS = 512
CELL_KMERS = 1_000_000
#: Pairs that a cell hands on for alignment; with more of them it is compared as a whole.
CELL_PAIRS = 4096
#: Bins of a profile, least and most, as powers of two.
BINS = (6, 13)
#: Rows of an Arrow batch that hold profiles or sequences.
WIDE_ROWS = 512
#: Hash values that one step of sketching holds.
HASHED = 1 << 20
_WORD = re.compile(r"\w+")
#: Odd multipliers of the hash functions come from this generator.
_MULTIPLIERS = np.random.default_rng(977).integers(1, 2**63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_word_hash: dict[str, int] = {}


def kmers(words: list[str]) -> np.ndarray:
    """64-bit hashes of the occurrence-labelled runs of five words, in text order."""
    if not words:
        return np.zeros(0, np.uint64)
    known = _word_hash
    if len(known) > 300_000:
        known.clear()
    digest = xxhash.xxh3_64_intdigest
    values = []
    for w in words:
        h = known.get(w)
        if h is None:
            h = known[w] = digest(w)
        values.append(h)
    x = np.array(values, np.uint64)
    n = max(1, len(x) - WORDS + 1)
    run = np.zeros(n, np.uint64)
    for k in range(min(WORDS, len(x))):
        run = _mix(run * np.uint64(0x9E3779B97F4A7C15) + x[k : k + n])
    order = np.argsort(run, kind="stable")
    ordered = run[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    label = np.empty(n, np.uint64)
    label[order] = (np.arange(n) - start).astype(np.uint64)
    return _mix(run + label * np.uint64(0xC2B2AE3D27D4EB4F))


def sketch(k: np.ndarray) -> np.ndarray:
    """One key for each hash function: the PICKS smallest k-mers under it, in text order."""
    picks = min(PICKS, len(k))
    out = np.arange(1, SKETCHES + 1, dtype=np.uint64)
    step = max(1, HASHED // len(k))
    for low in range(0, SKETCHES, step):
        h = k * _MULTIPLIERS[low : low + step, None]
        h ^= h >> np.uint64(29)
        at = np.sort(np.argpartition(h, picks - 1, axis=1)[:, :picks], axis=1) if len(k) > picks else np.broadcast_to(np.arange(len(k)), h.shape)
        for v in np.take_along_axis(h, at, axis=1).T:
            key = out[low : low + step] * np.uint64(0x9E3779B97F4A7C15) + v
            out[low : low + step] = key ^ (key >> np.uint64(32))
    return out


def profile(k: np.ndarray) -> bytes | None:
    """How many k-mers fall into each of about n / 2 bins by their highest bits, one byte a bin; None where a bin overflows."""
    bits = min(BINS[1], max(BINS[0], (len(k) // 2).bit_length()))
    counts = np.bincount((k >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else None


def spread_of(n: np.ndarray | int, similarity: float) -> np.ndarray | int:
    """The most k-mers in which two texts of n k-mers together may differ at that similarity."""
    return n - 2 * np.ceil(similarity * n / (1 + similarity) - 1e-9).astype(np.int64)


def folded(p: np.ndarray, bins: int) -> np.ndarray:
    return p.reshape(*p.shape[:-1], bins, -1).sum(axis=-1)


def apart(x: bytes | None, y: bytes | None) -> int:
    """A lower bound of the number of k-mers that only one of two texts has: the bins' counts differ by no more."""
    if x is None or y is None:
        return 0
    a, b = np.frombuffer(x, np.uint8).astype(np.int32), np.frombuffer(y, np.uint8).astype(np.int32)
    bins = min(len(a), len(b))
    return int(np.abs(folded(a, bins) - folded(b, bins)).sum())


def alignment(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> float:
    """Ordered similarity of two labelled k-mer sequences, exact where it is at least `similarity`, else 0.

    At that similarity the sequences differ in at most `band` k-mers, so matches lie within `band` of the diagonal; among these the
    longest common subsequence is a longest increasing one, as labelled k-mers occur once."""
    n = len(a) + len(b)
    if not len(a) or not len(b) or min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return 0.0
    need = int(np.ceil(similarity * n / (1 + similarity) - 1e-9))
    band = n - 2 * need
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    if len(i) < need:
        return 0.0
    j = j[np.argsort(i, kind="stable")]
    if np.all(j[1:] > j[:-1]):
        length = len(j)
    else:
        tails: list[int] = []
        for x in j.tolist():
            at = bisect_left(tails, x)
            if at == len(tails):
                tails.append(x)
            else:
                tails[at] = x
        length = len(tails)
    return length / (n - length) if length >= need else 0.0


def name_of(words: list[str]) -> str:
    """The name of a class: the 128-bit hash of its words."""
    return xxhash.xxh3_128_hexdigest(" ".join(words))


def node_of(name: str) -> int:
    """A class's node: the high 64 bits of its name, signed."""
    return int.from_bytes(bytes.fromhex(name[:16]), "big", signed=True)


def classes_of(docs: DataFrame) -> DataFrame:
    """id, h (hash of the text), class (hex of the words' 128-bit hash; null without words), node, n k-mers, the sketch and the profile, of every row of docs."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, keys, profiles = [], [], [], []
            for text in batch.column(2).to_pylist():
                w = words_of(text)
                names.append(name_of(w) if w else None)
                k = kmers(w)
                sizes.append(len(k))
                keys.append(sketch(k).view(np.int64) if len(k) else None)
                profiles.append(profile(k) if len(k) else None)
            nodes = [None if x is None else node_of(x) for x in names]
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "h": batch.column(1), "class": pa.array(names, pa.string()), "node": pa.array(nodes, pa.int64()), "n": pa.array(sizes, pa.int32()), "keys": pa.array(keys, pa.list_(pa.int64())), "profile": pa.array(profiles, pa.binary())})
        _word_hash.clear()

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text_of()).alias("h"), text_of().alias("text"))
    return rows.mapInArrow(run, "id long, h long, class string, node long, n int, keys array<long>, profile binary")


def components(links: DataFrame) -> DataFrame:
    """node and root: the smallest node of each connected component of links (a, b), by alternating large and small stars; each round halves the depth."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while True:
        # large star: every larger neighbour of u goes to the smallest of u and its neighbours
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        after = cut(small)
        moved = after.exceptAll(edges).limit(1).count() + edges.exceptAll(after).limit(1).count()
        edges = after
        if not moved:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def sequences_of(docs: DataFrame, nodes: DataFrame, known: DataFrame) -> DataFrame:
    """id (node) and k-mer sequence of the nodes (id, distinct). Only their texts are read, by the doc_ids of `known` (id, doc); the wanted ones are a written table, so that Spark knows its size and picks the join."""
    wanted = cut(known.select("id", "doc").join(nodes, "id", "left_semi"))
    texts = docs.selectExpr("cast(doc_id as bigint) doc", "cast(text as string) text").join(wanted, "doc").select("id", "text")

    @released
    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = words_of(text or "")
                # another text of the same doc_id is another node
                if w and node_of(name_of(w)) == node:
                    ids.append(node)
                    # 32 bits are enough for a sequence: a pair's k-mers are few against 2^32, and a chance match must also lie in order and band
                    found.append((kmers(w) >> np.uint64(32)).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "seq": pa.array(found, pa.binary())})
        _word_hash.clear()

    with batches_of(docs.sparkSession, WIDE_ROWS):
        found = cut(texts.mapInArrow(sequences, "id long, seq binary"))
    # repeated rows of a doc_id have equal sequences
    if found.count() > wanted.count():
        found = cut(found.groupBy("id").agg(F.first("seq").alias("seq")))
    return found


def unique(raw: bytes) -> np.ndarray:
    """The sequence with chance repeats of its 32-bit k-mers told apart, as labelled k-mers occur once."""
    k = np.frombuffer(raw, np.uint32).astype(np.uint64)
    order = np.argsort(k, kind="stable")
    s = k[order]
    start = np.maximum.accumulate(np.where(np.r_[True, s[1:] != s[:-1]], np.arange(len(s)), 0))
    k[order] += (np.arange(len(s)) - start).astype(np.uint64) << np.uint64(32)
    return k


def possible(pairs: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose profiles leave the similarity possible; written. An exact bound: no pair of that similarity goes."""
    sided = pairs.select("a", "b")
    for k in ("a", "b"):
        sided = sided.join(known.select(F.col("id").alias(k), F.col("n").alias(f"{k}_n"), F.col("profile").alias(f"{k}_profile")), k)

    @released
    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("a_n").to_numpy().astype(np.int64) + batch.column("b_n").to_numpy()
            most = spread_of(n, similarity)
            fine = [apart(x, y) <= m for x, y, m in zip(batch.column("a_profile").to_pylist(), batch.column("b_profile").to_pylist(), most, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(fine, pa.bool_()))

    with batches_of(pairs.sparkSession, WIDE_ROWS):
        return cut(sided.mapInArrow(test, "a long, b long"))


def aligned(docs: DataFrame, pairs: DataFrame, known: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of nodes whose texts align; written."""
    found = sequences_of(docs, pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), known)
    sided = pairs.join(found.select(F.col("id").alias("a"), F.col("seq").alias("x")), "a").join(found.select(F.col("id").alias("b"), F.col("seq").alias("y")), "b")

    @released
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            close = [alignment(unique(x[k].as_buffer()), unique(y[k].as_buffer()), similarity) >= similarity for k in range(len(batch))]
            yield batch.select(["a", "b"]).filter(pa.array(close, pa.bool_()))

    with batches_of(docs.sparkSession, WIDE_ROWS):
        return cut(sided.select("a", "b", "x", "y").mapInArrow(align, "a long, b long"))


def verify(docs: DataFrame, pairs: DataFrame, known: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of nodes whose texts align; only texts of pairs whose profiles allow it are read."""
    return aligned(docs, possible(pairs, known, similarity), known, similarity)


def close_profiles(n: list[int], profiles: list[bytes | None], left: list[int], right: list[int], similarity: float, slab: int = 1 << 22) -> np.ndarray:
    """Whether the profiles of left x right leave the similarity possible, as a matrix."""
    size = np.array(n, np.int64)
    a, b = size[left][:, None], size[right][None, :]
    fine = np.minimum(a, b) >= similarity * np.maximum(a, b)
    most = spread_of(a + b, similarity)
    held = [[k for k, i in enumerate(side) if profiles[i] is not None] for side in (left, right)]
    widths = sorted({len(profiles[i]) for i in (*left, *right) if profiles[i] is not None})
    of = lambda side, at, width: ([k for k in at if len(profiles[side[k]]) == width])
    for p in widths:
        rows = of(left, held[0], p)
        for q in widths:
            columns = of(right, held[1], q)
            bins = min(p, q)
            if not rows or not columns:
                continue
            x, y = (folded(np.stack([np.frombuffer(profiles[side[k]], np.uint8) for k in at]).astype(np.int32), bins).astype(np.int16) for side, at in ((left, rows), (right, columns)))
            step = max(1, slab // (len(columns) * bins))
            for low in range(0, len(rows), step):
                part = rows[low : low + step]
                gap = np.abs(x[low : low + step, None, :] - y[None, :, :]).sum(axis=2, dtype=np.int64)
                fine[np.ix_(part, columns)] &= gap <= most[np.ix_(part, columns)]
    return fine


def common_kmers(left: list[np.ndarray], right: list[np.ndarray], slab: int = 4096) -> np.ndarray:
    """The numbers of k-mers that each sequence of left shares with each of right, by products of slabs of the incidence matrices."""
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.float32)
    places = []
    for side in (left, right):
        row = np.repeat(np.arange(len(side)), [len(k) for k in side])
        k = np.concatenate(side)
        at = np.searchsorted(shared, k)
        held = at < len(shared)
        held[held] = shared[at[held]] == k[held]
        order = np.argsort(at[held], kind="stable")
        places.append((row[held][order], at[held][order], len(side)))
    for low in range(0, len(shared), slab):
        width = min(slab, len(shared) - low)
        parts = []
        for row, at, size in places:
            a, b = np.searchsorted(at, [low, low + width])
            x = np.zeros((size, width), np.float32)
            x[row[a:b], at[a:b] - low] = 1
            parts.append(x)
        out += parts[0] @ parts[1].T
    return out


def cell_links(ids: list[int], roots: list[int], codes: list[int], seqs: list[bytes], left: int, right: int, similarity: float) -> list[tuple[int, int]]:
    """Links that join all components of a cell that any aligned pair of its two blocks joins; pairs joined by earlier links are skipped."""
    k = [unique(x) for x in seqs]
    x, y = ([i for i, c in enumerate(codes) if c == side] for side in (left, right))
    if not x or not y:
        return []
    common = common_kmers([k[i] for i in x], [k[j] for j in y])
    n = np.array([len(v) for v in k])
    both = n[x][:, None] + n[y][None, :]
    enough = (common >= np.ceil(similarity * both / (1 + similarity) - 1e-9)) & (np.array(roots)[x][:, None] != np.array(roots)[y][None, :])
    parent: dict[int, int] = {}

    def top(r: int) -> int:
        while parent.get(r, r) != r:
            r = parent[r] = parent.get(parent[r], parent[r])
        return r

    out = []
    for p, q in zip(*np.nonzero(enough), strict=True):
        i, j = x[p], y[q]
        a, b = top(roots[i]), top(roots[j])
        if a != b and alignment(k[i], k[j], similarity) >= similarity:
            parent[max(a, b)] = min(a, b)
            out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def cells(docs: DataFrame, open_: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) across components in the buckets of open_ (bucket, id, n, root), every pair of different roots compared.

    The fullest component of a bucket needs no comparison within itself, so its blocks meet the other members' blocks only. A cell first
    compares profiles; the few pairs that these leave are aligned one by one, and a cell that is left more than CELL_PAIRS takes the k-mers."""
    sizes = open_.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("k"))
    blocks = lambda m, k: F.greatest(F.lit(1), F.ceil(m / CELL_MEMBERS), F.ceil(k / CELL_KMERS)).cast("int")
    shape = sizes.groupBy("bucket").agg(F.max(F.struct("m", "k", "root")).alias("full"), F.sum("m").alias("m"), F.sum("k").alias("k"))
    shape = cut(shape.select("bucket", F.col("full.root").alias("_full"), blocks(F.col("m") - F.col("full.m"), F.col("k") - F.col("full.k")).alias("_others"), blocks(F.col("full.m"), F.col("full.k")).alias("_fulls")))
    drawn = lambda k: F.pmod(F.xxhash64("id"), F.col(k)).cast("int")
    other = F.col("root") != F.col("_full")
    placed = open_.join(shape, "bucket").withColumn("code", F.when(other, drawn("_others")).otherwise(F.col("_others") + drawn("_fulls")))
    meets = F.sequence(F.lit(0), F.when(other, F.col("_others") + F.col("_fulls") - 1).otherwise(F.col("_others") - 1))
    placed = placed.select("bucket", "id", "n", "root", "code", F.explode(meets).alias("with"))
    placed = cut(placed.select("bucket", F.least("code", "with").alias("left"), F.greatest("code", "with").alias("right"), "id", "n", "root", "code"))
    cell = ["bucket", "left", "right"]

    def sift(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        t = table.select(["id", "n", "root", "code", "profile"]).to_pydict()
        x, y = ([i for i, c in enumerate(t["code"]) if c == k.as_py()] for k in key[1:])
        ids, roots = np.array(t["id"], np.int64), np.array(t["root"], np.int64)
        a = b = np.zeros(0, np.int64)
        if x and y:
            p, q = np.nonzero(close_profiles(t["n"], t["profile"], x, y, similarity) & (roots[x][:, None] != roots[y][None, :]))
            a, b = ids[np.array(x)[p]], ids[np.array(y)[q]]
            if key[1] == key[2]:
                a, b = a[p < q], b[p < q]
        if len(a) > CELL_PAIRS:
            return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "left": pa.array([key[1].as_py()], pa.int32()), "right": pa.array([key[2].as_py()], pa.int32()), "a": pa.array([None], pa.int64()), "b": pa.array([None], pa.int64())})
        none = pa.nulls(len(a), pa.int64())
        return pa.table({"bucket": none, "left": none.cast(pa.int32()), "right": none.cast(pa.int32()), "a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    with batches_of(docs.sparkSession, WIDE_ROWS):
        sifted = cut(placed.join(known.select("id", "profile"), "id").groupBy(*cell).applyInArrow(sift, "bucket long, left int, right int, a long, b long"))
    links = aligned(docs, cut(sifted.filter("a is not null").select("a", "b").distinct()), known, similarity)
    whole = sifted.filter("bucket is not null").select(*cell)
    if whole.isEmpty():
        return links

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        t = table.select(["id", "root", "code", "seq"]).to_pydict()
        found = cell_links(t["id"], t["root"], t["code"], t["seq"], key[1].as_py(), key[2].as_py(), similarity)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    dealt = cut(placed.join(whole, cell, "left_semi"))
    dealt = dealt.join(sequences_of(docs, dealt.select("id").distinct(), known), "id")
    return links.union(dealt.groupBy(*cell).applyInArrow(compare, "a long, b long")).distinct()


def grouped(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """For every row of docs: id, h (hash of its text), class, its group's first row (struct of id and h), copy_id, n_copies and n_links; written."""
    with batches_of(docs.sparkSession, 4 * WIDE_ROWS):
        rows = cut(classes_of(docs))
    # one row a class; the sketches of equal texts are equal. A class without any doc_id is in no pair
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "h"))).alias("first")
    classes = cut(rows.filter("class is not null").groupBy("class").agg(first, F.count(F.lit(1)).alias("n_copies"), F.first("node").alias("node"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("profile").alias("profile")))
    known = classes.filter("first is not null").select(F.col("node").alias("id"), F.col("first.id").alias("doc"), "n", "profile")
    alike = lambda a, b: F.least(a, b) >= F.lit(similarity) * F.greatest(a, b)
    spread = classes.filter("first is not null").select(F.col("node").alias("id"), "n", F.posexplode("keys").alias("_i", "_key")).select("id", "n", F.xxhash64("_i", "_key").alias("bucket"))
    crowded = cut(spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"))
    members = cut(spread.join(crowded, "bucket"))
    # the head of a bucket is the member whose other buckets are fullest: an original before its edited copies
    central = cut(members.groupBy("id").agg(F.sum("members").alias("weight")))
    weighed = cut(members.join(central, "id").select("bucket", "id", "n", "weight"))
    heads = cut(weighed.groupBy("bucket").agg(F.min(F.struct((-F.col("weight")).alias("weight"), "id", "n")).alias("head")))
    stars = weighed.join(heads, "bucket").filter((F.col("id") != F.col("head.id")) & alike(F.col("n"), F.col("head.n")))
    stars = cut(stars.select(F.least("id", "head.id").alias("a"), F.greatest("id", "head.id").alias("b")).distinct())
    links = cut(verify(docs, stars, known, similarity))
    found = cut(components(links))

    # across components: classes of one bucket that are not joined yet. In buckets of up to BLOCK open members each is compared with each
    # member of another component; in fuller ones ROUNDS further heads, drawn by hashes, are compared with all members
    labelled = weighed.join(found.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", "n", F.coalesce("root", "id").alias("root"))
    mixed = labelled.groupBy("bucket").agg(F.min("root").alias("_low"), F.max("root").alias("_high"), F.count(F.lit(1)).alias("_size")).filter("_low <> _high").select("bucket", "_size")
    open_ = cut(labelled.join(mixed, "bucket"))
    sides = [open_.filter(F.col("_size") <= BLOCK).select("bucket", F.col("id").alias(f"{k}_id"), F.col("root").alias(f"{k}_root"), F.col("n").alias(f"{k}_n")) for k in ("a", "b")]
    across = sides[0].join(sides[1], "bucket").filter((F.col("a_root") < F.col("b_root")) & alike(F.col("a_n"), F.col("b_n"))).select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))
    full = open_.filter(F.col("_size") > BLOCK)
    for k in range(ROUNDS):
        chosen = full.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("h"), "id", "n", "root")).alias("head"))
        other = full.join(chosen, "bucket").filter((F.col("root") != F.col("head.root")) & alike(F.col("n"), F.col("head.n")))
        across = across.union(other.select(F.least("id", "head.id").alias("a"), F.greatest("id", "head.id").alias("b")))
    across = cut(across.distinct().join(stars, ["a", "b"], "left_anti"))
    if not across.isEmpty():
        links = cut(links.union(verify(docs, across, known, similarity)))
        found = cut(components(links))

    # full buckets that still hold several components: every pair of different ones, cell by cell
    left = full.drop("root", "_size").join(found.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", "n", F.coalesce("root", "id").alias("root"))
    still = left.groupBy("bucket").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).filter("_low <> _high").select("bucket")
    left = cut(left.join(still, "bucket"))
    if not left.isEmpty():
        # a pair compared before differs in root, so it did not align and does not again
        links = cut(links.union(cells(docs, left, known, similarity)))
        found = cut(components(links))

    degree = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    named = classes.select("class", "node", "first", "n_copies").join(found, "node", "left").join(degree, "node", "left")
    named = cut(named.select("class", "first", F.when(F.col("first").isNotNull(), F.coalesce("root", "node")).alias("root"), "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
    groups = named.filter("root is not null").groupBy("root").agg(F.min("first").alias("group"))
    named = cut(named.join(groups, "root", "left").select("class", F.col("first.id").alias("copy_id"), "group", "n_copies", "n_links"))
    return cut(rows.select("id", "h", "class").join(named, "class", "left"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its near copies), copy_id (smallest doc_id of equal words), n_copies and n_links of every row of docs."""
    return grouped(docs, similarity).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id").isNotNull(), F.coalesce("group.id", "id")).alias("class_id"),
        F.when(F.col("id").isNotNull(), F.coalesce("copy_id", "id")).alias("copy_id"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, with all columns, that are the first of their near copies; of repeated rows one."""
    found = grouped(docs, similarity).filter("id is not null and group is not null")
    first = (F.col("id") == F.col("group.id")) & (F.col("h") == F.col("group.h"))
    drop = found.filter(~first).select("id", "h").distinct()
    repeated = found.filter(first).groupBy("id", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", "h")
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text_of()).alias("h"))
    kept = keyed.join(drop, ["id", "h"], "left_anti")
    if not repeated.isEmpty():
        once = kept.join(repeated, ["id", "h"], "left_semi").groupBy("id", "h").agg(F.min_by("row", F.to_json("row")).alias("row"))
        kept = kept.join(repeated, ["id", "h"], "left_anti").select("row").union(once.select("row"))
    return kept.select("row.*")
