"""Conversation structure repair by error-correcting Earley parsing.

Grammar. The role initials of a well-formed conversation are `(s?(ua)+)?`, written left-linear so
that every item of a chart starts at 0 and a chart needs only its last column:

    C -> e | P      P -> U a      U -> u | S u | P u      S -> s

Error productions carry costs: a row is kept (K, 0), reroled to the terminal that is wanted
(R, 2) or deleted (D, 3; the only way for blank and duplicate rows), and a wanted `u` or `a` is
inserted (I, 2). A truncated row that stays costs 1 more. Every chart item retains its least
(cost, audit), where the audit is the string of edits; the completed item of C gives the repair.
Two audits of one cost over the same rows are never prefixes of each other, so the least audit of
an item stays least whatever follows. What all live items' audits share is moved out of the
items, which keeps them short.

Long conversations. Rows are sorted by range over the whole table, so a long conversation lies
in several partitions. Each partition parses its part of a conversation from every item that it
could be entered with; the parts' (cost, audit) tables are then joined in order, by the same
rule. A part costs its rows; only the parts' tables and, for the repaired rows, the stream of the
conversation meet in one task, which holds the audit (a byte a row) and a batch of rows at a time.

Faults. The first that applies to a row, in the order of turn (nulls first), role and text: blank
(no character but white space), duplicate (role and text seen earlier in the conversation),
truncated (last character that is not white space is none of `.!?`).

Defined results: null turns come first; rows of equal turn are taken by role and text; null roles and
texts count as one space; rows with a null conv_id are one conversation; repeated rows are
duplicates; long texts are read whole and held one batch at a time; a conversation without rows
has an empty repair; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut

#: The costs of the contract.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
OK, CUT_OFF, DUPLICATE, BLANK = 0, 1, 2, 3
#: Left-linear: a production's first symbol may be a nonterminal, all others are terminals.
GRAMMAR = {"C": [(), ("P",)], "P": [("U", "a")], "U": [("u",), ("S", "u"), ("P", "u")], "S": [("s",)]}
START, GOAL = "", "C"
#: Where a part of a conversation may be entered: before any row that stays, or behind a completed S, U or P.
ENTRIES = (START, "S", "U", "P")
_FILL = set(ROLES)

Item = tuple[str, tuple[str, ...], int]
Score = tuple[int, str]

#: Items that wait for a nonterminal, and predicted items that wait for a terminal.
_WAITING: dict[str, list[Item]] = {}
_PREDICTED: list[Item] = []
for _left, _rights in GRAMMAR.items():
    for _right in _rights:
        if _right and _right[0] in GRAMMAR:
            _WAITING.setdefault(_right[0], []).append((_left, _right, 1))
        elif _right and _left != GOAL:
            _PREDICTED.append((_left, _right, 0))


class Chart:
    """The last column of an error-correcting Earley chart over one part of a conversation, entered with one item."""

    def __init__(self, entry: str = START):
        self.done: list[str] = []
        if entry == START:
            seed: dict[Item, Score] = {item: (0, "") for item in _PREDICTED}
        else:
            seed = {(entry, ("",), 1): (0, "")}
        self.items = self._closed(seed)

    def _closed(self, found: dict[Item, Score]) -> dict[Item, Score]:
        """Completion and insertion, cheapest items first, so that each is final when it is taken."""
        heap = [(score, item) for item, score in found.items()]
        heapq.heapify(heap)
        final: dict[Item, Score] = {}
        while heap:
            score, item = heapq.heappop(heap)
            if item in final:
                continue
            final[item] = score
            left, right, dot = item
            if dot == len(right):
                for waiting in _WAITING.get(left, ()):
                    if waiting not in final:
                        heapq.heappush(heap, (score, waiting))
            elif right[dot] in _FILL:
                after = (left, right, dot + 1)
                if after not in final:
                    heapq.heappush(heap, ((score[0] + INSERT, score[1] + "I"), after))
        return final

    def read(self, initial: str, fault: int) -> None:
        """One row: its kernel is scanned (kept or reroled) and deleted, then closed."""
        found: dict[Item, Score] = {}

        def offer(item: Item, score: Score) -> None:
            if item not in found or score < found[item]:
                found[item] = score

        stays = 1 if fault == CUT_OFF else 0
        for item, (cost, audit) in self.items.items():
            if item[0] == GOAL:
                continue
            offer(item, (cost + DELETE, audit + "D"))
            left, right, dot = item
            if fault < DUPLICATE and dot < len(right):
                if right[dot] == initial:
                    offer((left, right, dot + 1), (cost + stays, audit + "K"))
                if right[dot] in _FILL:
                    offer((left, right, dot + 1), (cost + REROLE + stays, audit + "R"))
        found = self._closed(found)
        # an item that a completed P and a deletion beat for good can be in no repair
        whole = found.get(("P", ("U", "a"), 2))
        if whole:
            found = {item: score for item, score in found.items() if score[0] <= whole[0] + DELETE}
        audits = [audit for _, audit in found.values()]
        low, high = min(audits), max(audits)
        shared = 0
        for x, y in zip(low, high, strict=False):
            if x != y:
                break
            shared += 1
        if shared:
            self.done.append(low[:shared])
            found = {item: (cost, audit[shared:]) for item, (cost, audit) in found.items()}
        self.items = found

    def exits(self) -> dict[str, Score]:
        """The least (cost, audit) with which the part leaves each nonterminal completed, or nothing kept at all."""
        before = "".join(self.done)
        best: dict[str, Score] = {}
        for (left, right, dot), (cost, audit) in self.items.items():
            name = left if dot == len(right) else START if dot == 0 else None
            if name is not None and (name not in best or (cost, audit) < best[name]):
                best[name] = (cost, audit)
        return {name: (cost, before + audit) for name, (cost, audit) in best.items() if name != GOAL}


def joined(parts: Iterable[dict[str, dict[str, Score]]]) -> Score:
    """The least (cost, audit) of a whole conversation from its parts, each a table entry -> exit -> (cost, audit)."""
    done: list[str] = []
    at: dict[str, Score] = {START: (0, "")}
    for part in parts:
        after: dict[str, Score] = {}
        for entry, (cost, audit) in at.items():
            for leave, (more, rest) in part[entry].items():
                score = (cost + more, audit + rest)
                if leave not in after or score < after[leave]:
                    after[leave] = score
        audits = [audit for _, audit in after.values()]
        low, high = min(audits), max(audits)
        shared = next((k for k, (x, y) in enumerate(zip(low, high, strict=False)) if x != y), min(len(low), len(high)))
        done.append(low[:shared])
        at = {k: (cost, audit[shared:]) for k, (cost, audit) in after.items()}
    # C -> e, C -> P
    cost, audit = min(at[k] for k in (START, "P") if k in at)
    return cost, "".join(done) + audit


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after the contract's damage, drawn by crc32 of `conv_id:turn`."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    text = F.when(draw == 1, "").when(draw == 2, F.regexp_replace(word("text"), "[.!?]", "")).otherwise(word("text"))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(draw == 4, "user").otherwise(word("role")).alias("role"), text.alias("text"), draw.alias("_draw"))
    return rows.filter("_draw <> 0").withColumn("_copies", F.explode(F.when(F.col("_draw") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_draw", "_copies")


def faults(rows: DataFrame) -> DataFrame:
    """Distinct conv_id, turn, role, text with `first` and `rest`, the faults of the first of the n equal rows and of the others; written.

    Equal rows are counted, and a text's first place is a least value, before anything is shuffled, so neither a hot text nor a hot conversation is one task."""
    ws = r"\x20\x09-\x0D"
    equal = cut(rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n")).withColumn("_said", F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    earliest = equal.groupBy("conv_id", "_said").agg(F.min(turn).alias("_first"), F.count(F.lit(1)).alias("_times")).filter("_times > 1").select(F.col("conv_id").alias("_conv"), F.col("_said").alias("_key"), "_first")
    here = equal.join(earliest, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_said") == F.col("_key")), "left").drop("_conv", "_key")
    seen = F.coalesce(turn != F.col("_first"), F.lit(False))
    blank = ~F.col("text").rlike(f"[^{ws}]")
    fault = F.when(blank, BLANK).when(seen, DUPLICATE).when(~F.col("text").rlike(f"[.!?][{ws}]*\\z"), CUT_OFF).otherwise(OK)
    return cut(here.select("conv_id", "turn", "role", "text", "n", fault.alias("first"), F.when(blank, BLANK).otherwise(DUPLICATE).alias("rest")))


def ordered(found: DataFrame) -> DataFrame:
    """Sorted by conversation, turn, role and text over the whole table."""
    keys = ["conv_id", "turn", "role", "text"]
    return found.repartitionByRange(*keys).sortWithinPartitions(*keys)


PART = "conv_id long, part int, entry string, leave string, cost long, audit string, illegal long, head string, tail string"


def parts(found: DataFrame) -> DataFrame:
    """The parts of every conversation: one row for each entry and exit, with the illegal neighbours within the part and its first and last initial."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in PART.split(", ")]
        out: dict[str, list] = {k: [] for k in names}

        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True)

        for k, (conv, group) in enumerate(groupby(rows(), key=lambda r: r[1])):
            # only the first conversation of a partition may have begun in the one before
            charts = {entry: Chart(entry) for entry in (ENTRIES if k == 0 else (START,))}
            illegal, head, last = 0, None, None
            for part, _, initial, n, first, rest in group:
                for copy in range(n):
                    if last is None:
                        head = initial
                    elif last + initial not in ("su", "ua", "au"):
                        illegal += 1
                    last = initial
                    for chart in charts.values():
                        chart.read(initial, rest if copy else first)
            for entry, chart in charts.items():
                for leave, (cost, audit) in chart.exits().items():
                    for name, value in zip(names, (conv, part, entry, leave, cost, audit, illegal, head, last), strict=True):
                        out[name].append(value)
            if len(out["part"]) > 5000:
                yield _batch(out, _PART_TYPES)
                out = {k: [] for k in names}
        if out["part"]:
            yield _batch(out, _PART_TYPES)

    rows = ordered(found).select(F.spark_partition_id().alias("part"), F.col("conv_id").cast("long"), F.substring("role", 1, 1).alias("initial"), "n", "first", "rest")
    return cut(rows.mapInArrow(run, PART))


_PART_TYPES = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]


def _batch(out: dict[str, list], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out.values(), types, strict=True)], names=list(out))


HEAD, PIECE, ROW, DONE = 0, 1, 2, 3
REPAIRED = "conv_id long, kind int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, position long, turn long, role string, text string, edit string"
_REPAIRED_TYPES = [pa.int64(), pa.int32(), *[pa.int64()] * 6, pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]


def _stream(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """One stream a conversation: its counts, its parts in order, then its rows in order."""
    found = faults(rows)
    conv = F.col("conv_id").cast("long").alias("conv_id")
    # counts of each fault and the gaps, from the rows
    sums = lambda f: F.sum(F.when(F.col("first") == f, 1).otherwise(0) + F.when(F.col("rest") == f, F.col("n") - 1).otherwise(0))
    turns = found.groupBy("conv_id", "turn").agg(*(sums(f).alias(k) for k, f in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", CUT_OFF))))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    counts = turns.groupBy(conv).agg(gaps.alias("gaps"), *(F.sum(k).alias(k) for k in ("blank", "duplicate", "truncated")))
    none = conversations.select(conv).distinct().select("conv_id", *(F.lit(0).cast("long").alias(k) for k in ("gaps", "blank", "duplicate", "truncated")))
    heads = counts.union(none).select("conv_id", F.lit(HEAD).alias("kind"), "gaps", "blank", "duplicate", "truncated")
    pieces = parts(found).withColumn("kind", F.lit(PIECE))
    lines = found.select(conv, F.lit(ROW).alias("kind"), "turn", "role", "text", "n", "first", "rest")
    every = heads.unionByName(pieces, True).unionByName(lines, True)
    order = ["conv_id", "kind", "part", "turn", "role", "text"]
    columns = ["conv_id", "kind", "gaps", "blank", "duplicate", "truncated", "part", "entry", "leave", "cost", "audit", "illegal", "head", "tail", "turn", "role", "text", "n"]
    return every.repartition("conv_id").sortWithinPartitions(*order).select(*columns)


def _mend(group: Iterator[tuple]) -> Iterator[tuple]:
    """The repaired rows of one conversation, then its row of counts, from its stream."""
    counts = [0, 0, 0, 0]
    tables: list[tuple[int, dict]] = []
    illegal, tail = 0, None
    state: tuple[int, str] | None = None
    place = position = 0
    conv = turn = role = None

    def settle() -> tuple[int, str]:
        return joined(t for _, t in tables) if tables else (0, "")

    # what the repair wants next, by the initials of the rows that stay
    wanted = {"": "u", "s": "u", "u": "a", "a": "u"}
    last = ""
    for conv, kind, g, b, d, t, part, entry, leave, cost, audit, bad, head, end, turn, role, text, n in group:
        if kind == HEAD:
            counts = [max(x, y) for x, y in zip(counts, (g, b, d, t), strict=True)]
        elif kind == PIECE:
            if not tables or tables[-1][0] != part:
                tables.append((part, {}))
                illegal += bad + (tail is not None and tail + head not in ("su", "ua", "au"))
                tail = end
            tables[-1][1].setdefault(entry, {})[leave] = (cost, audit)
        else:
            if state is None:
                state, tables = settle(), []
            for _ in range(n):
                while state[1][place] == "I":
                    last = wanted[last]
                    yield (conv, ROW, None, None, None, None, None, None, None, position, None, ROLES[last], "", "I")
                    place, position = place + 1, position + 1
                edit = state[1][place]
                place += 1
                if edit != "D":
                    last = wanted[last] if edit == "R" else role[:1]
                    yield (conv, ROW, None, None, None, None, None, None, None, position, turn, ROLES[last] if edit == "R" else role, text, edit)
                    position += 1
    if state is None:
        state = settle()
    for _ in range(place, len(state[1])):
        last = wanted[last]
        yield (conv, ROW, None, None, None, None, None, None, None, position, None, ROLES[last], "", "I")
        position += 1
    yield (conv, DONE, *counts, illegal, *state, None, None, None, None, None)


def _mended(stream: DataFrame, digest: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True)

        out, size = [], 0
        for _, group in groupby(rows(), key=lambda r: r[0]):
            sha = hashlib.sha256()
            for row in _mend(group):
                if digest and row[1] == ROW:
                    sha.update((("\n" if row[9] else "") + f"{row[11]}:{row[12]}").encode())
                    continue
                out.append((*row[:-1], sha.hexdigest()) if row[1] == DONE else row)
                size += len(row[12] or "") + len(row[8] or "") + 100
                if size > 1 << 22:
                    yield _columns(out)
                    out, size = [], 0
        if out:
            yield _columns(out)

    return stream.mapInArrow(run, REPAIRED)


def _columns(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in REPAIRED.split(", ")]
    return _batch(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)), _REPAIRED_TYPES)


def repair(conversations: DataFrame) -> DataFrame:
    """The repaired rows: conv_id, position, turn (null if inserted), role, text and edit (K, R or I)."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), word("role"), word("text"))
    return _mended(_stream(conversations, rows), False).filter(F.col("kind") == ROW).select("conv_id", "position", "turn", "role", "text", "edit")


def repair_digests(conversations: DataFrame, damage: bool = True) -> DataFrame:
    """A row for each conversation of the table: its faults, cost, audit and the digest of its repair, after the contract's damage."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = damaged(conversations) if damage else conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), word("role"), word("text"))
    done = _mended(_stream(conversations, rows), True)
    return done.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("edit").alias("repaired_sha256"))
