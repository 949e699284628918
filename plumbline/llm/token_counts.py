"""Token counts that follow edits: per document a segment tree over its pre-tokens; an edit re-encodes only the region it touches.

Tree. The text is cut into pre-tokens; leaves hold up to LEAF of them with their lengths
and token counts, inner nodes the sums of characters and tokens, so a count and the leaf
at a position take a path from the root.

Edit. Pre-tokens that end LOOK characters or more before the edit cannot change, as the
pattern looks no further; scanning starts at the first other one and goes on past the edit
until a new pre-token begins where an old one began, for from there on both cuts agree.
Only the pre-tokens in between are encoded; their leaf is replaced and the sums on the
path to the root are updated.

Stored trees. `trees` gives each document's text with its leaves as two packed columns, to be written
beside the documents; `apply_edits` joins a table of edits to them, loads a tree without encoding
anything, and gives the edited texts with their trees, to be written as the next version.

Distribution: `count_with_edits` is map-only over Arrow batches, and a tree lives as long as its document's
row; `apply_edits` shuffles by doc_id, and all edits of one document come to its row. The counts of pre-tokens
are kept in a bounded table. Whole texts, no prefixes.

Defined results: null counts as empty (no tokens); edits beyond the text are cut to it;
overlapping edits apply one after another, each to the text that the last one left; in a table of
edits those of a document go by seq, then start, end and new, every row that shares the doc_id gets
them, and a null doc_id gets none; repeated rows give equal counts; an empty table gives no rows; other
columns, also those named like a result, are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 64
LOOK = 4
CACHE = 200_000
#: Texts that the registered query's edits put in.
NEW_TEXTS = ("", " an inserted phrase, with marks.", "x1y2\n\n  tail")


class Counter:
    """Cuts text into pre-tokens and counts a pre-token's tokens."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("plumbline", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}
        #: Pre-tokens counted anew by edits, for figures and tests.
        self.recounted = 0

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            n = self.known[piece] = len(self.encoding.encode_ordinary(piece))
        return n


class Node:
    """An inner node (left, right) or a leaf (sizes, counts)."""

    __slots__ = ("chars", "counts", "left", "right", "sizes", "tokens")

    def __init__(self, left=None, right=None, sizes=None, counts=None):
        self.left, self.right, self.sizes, self.counts = left, right, sizes, counts
        self.refresh()

    def refresh(self) -> None:
        if self.left is None:
            self.chars, self.tokens = sum(self.sizes), sum(self.counts)
        else:
            self.chars, self.tokens = self.left.chars + self.right.chars, self.left.tokens + self.right.tokens


def build(sizes: list[int], counts: list[int]) -> Node:
    if len(sizes) <= LEAF:
        return Node(sizes=sizes, counts=counts)
    leaves = -(-len(sizes) // LEAF)
    middle = leaves // 2 * LEAF
    return Node(build(sizes[:middle], counts[:middle]), build(sizes[middle:], counts[middle:]))


def replace(node: Node, start: int, end: int, sizes: list[int], counts: list[int]) -> Node:
    """The tree with the pre-tokens of characters [start, end) (whole ones) replaced; only nodes on the way are touched."""
    if node.left is None:
        at, i = 0, 0
        while i < len(node.sizes) and at < start:
            at += node.sizes[i]
            i += 1
        j = i
        while j < len(node.sizes) and at < end:
            at += node.sizes[j]
            j += 1
        new_sizes, new_counts = node.sizes[:i] + sizes + node.sizes[j:], node.counts[:i] + counts + node.counts[j:]
        return build(new_sizes, new_counts) if len(new_sizes) > 2 * LEAF else Node(sizes=new_sizes, counts=new_counts)
    cut = node.left.chars
    if end <= cut and (start < cut or not node.right.chars):
        node.left = replace(node.left, start, end, sizes, counts)
    elif start >= cut:
        node.right = replace(node.right, start - cut, end - cut, sizes, counts)
    else:
        node.right = replace(node.right, 0, end - cut, [], [])
        node.left = replace(node.left, start, cut, sizes, counts)
    node.refresh()
    return node


class TokenTree:
    """A text with its token count under edits."""

    def __init__(self, text: str, counter: Counter, leaves: tuple[list[int], list[int]] | None = None):
        """Encodes the text, unless the sizes and counts of its pre-tokens are given."""
        self.text, self.counter = text, counter
        if leaves is None:
            pieces = counter.pattern.findall(text)
            leaves = list(map(len, pieces)), list(map(counter.count, pieces))
        self.root = build(*leaves)

    def leaves(self) -> tuple[list[int], list[int]]:
        """Sizes and counts of all pre-tokens in order."""
        sizes, counts, todo = [], [], [self.root]
        while todo:
            node = todo.pop()
            if node.left is None:
                sizes += node.sizes
                counts += node.counts
            else:
                todo += [node.right, node.left]
        return sizes, counts

    @property
    def tokens(self) -> int:
        return self.root.tokens

    def start_of(self, position: int) -> int:
        """Where the pre-token that holds the position begins."""
        node, at = self.root, 0
        while node.left is not None:
            if position < at + node.left.chars or not node.right.chars:
                node = node.left
            else:
                at += node.left.chars
                node = node.right
        for size in node.sizes:
            if position < at + size:
                break
            at += size
        return at

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces characters [start, end) by new."""
        n = len(self.text)
        start = max(0, min(start, n))
        end = max(start, min(end, n))
        first = self.start_of(max(0, start - LOOK)) if n else 0
        text = self.text[:start] + new + self.text[end:]
        shift = len(new) - (end - start)
        pieces, at = [], first
        match = self.counter.pattern.match
        last = n
        while at < len(text):
            old = at - shift
            if at >= start + len(new) and old <= n and old >= end and (old == n or self.start_of(old) == old):
                last = old
                break
            piece = match(text, at)[0]
            pieces.append(piece)
            at += len(piece)
        self.counter.recounted += len(pieces)
        self.text = text
        self.root = replace(self.root, first, last, list(map(len, pieces)), list(map(self.counter.count, pieces)))


_counters: dict[str, Counter] = {}


def counter(path: str, pattern: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path, pattern)
    return _counters[path]


def sample_edits(doc_id: int, n: int) -> list[tuple[int, int, str]]:
    """The registered query's edits of a document with n characters: three places that follow from doc_id."""
    return [((doc_id * 7919 + k * 104_729) % (n + 1), (doc_id * 7919 + k * 104_729) % (n + 1) + (doc_id + k * 5) % 12, NEW_TEXTS[k]) for k in range(3)]


def count_with_edits(docs: DataFrame, path: str, pattern: str, edits=sample_edits) -> DataFrame:
    """doc_id, n_tokens of the text, n_edited after edits(doc_id, length), n_recounted pre-tokens, of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path, pattern)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tree = TokenTree(text or "", c)
                before, seen = tree.tokens, c.recounted
                for start, end, new in edits(doc_id or 0, len(tree.text)):
                    tree.edit(start, end, new)
                rows.append((before, tree.tokens, c.recounted - seen))
            names = ("n_tokens", "n_edited", "n_recounted")
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)} | {x: pa.array([r[k] for r in rows], pa.int64()) for k, x in enumerate(names)})

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n_tokens long, n_edited long, n_recounted long")


def pack(values: list[int]) -> bytes:
    """Non-negative numbers in the narrowest of 1, 2, 4 bytes each, after a byte that tells which."""
    x = np.asarray(values, np.uint32)
    width = 1 if not len(x) or x.max() < 1 << 8 else 2 if x.max() < 1 << 16 else 4
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def unpack(raw: bytes) -> list[int]:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).tolist()


TREE = "doc_id long, text string, sizes binary, counts binary, n_tokens long, n_recounted long"


def _tree_batch(doc_ids: pa.Array, rows: list[tuple[TokenTree, int]]) -> pa.RecordBatch:
    leaves = [t.leaves() for t, _ in rows]
    columns = {"doc_id": doc_ids, "text": pa.array([t.text for t, _ in rows], pa.string()), "sizes": pa.array([pack(x) for x, _ in leaves], pa.binary()), "counts": pa.array([pack(x) for _, x in leaves], pa.binary())}
    return pa.RecordBatch.from_pydict(columns | {"n_tokens": pa.array([t.tokens for t, _ in rows], pa.int64()), "n_recounted": pa.array([n for _, n in rows], pa.int64())})


def trees(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Every document with its tree: TREE, to be written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path, pattern)
        for batch in batches:
            yield _tree_batch(batch.column(0), [(TokenTree(text or "", c), 0) for text in batch.column(1).to_pylist()])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, TREE)


def apply_edits(stored: DataFrame, edits: DataFrame, path: str, pattern: str) -> DataFrame:
    """The next version of stored trees after edits (doc_id, seq, start, end, new), with the pre-tokens that each document had counted anew."""
    edit = F.struct("seq", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.coalesce("new", F.lit("")).alias("new"))
    listed = edits.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.sort_array(F.collect_list(edit)).alias("edits"))
    both = stored.join(listed, "doc_id", "left").select("doc_id", "text", "sizes", "counts", F.col("edits.start").alias("start"), F.col("edits.end").alias("end"), F.col("edits.new").alias("new"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path, pattern)
        for batch in batches:
            rows = []
            for _, text, sizes, counts, *edit in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                tree, before = TokenTree(text, c, (unpack(sizes), unpack(counts))), c.recounted
                for start, end, new in zip(*(x or () for x in edit), strict=True):
                    tree.edit(start, end, new)
                rows.append((tree, c.recounted - before))
            yield _tree_batch(batch.column(0), rows)

    return both.mapInArrow(run, TREE)
