"""License scans: one Aho-Corasick pass finds notice phrases and identifier tags; a shunting-yard parser evaluates the tags' and/or/with expressions.

Map-only over Arrow batches: each worker builds the automaton once; memory is one text
at a time. The automaton runs over the text's words for the base phrases and the further notices, runs
of consecutive words, and over the lower-cased text for the tag. The expression after a tag is read token by
token where it stands, no further than it goes and never past another tag, so a text takes time in
proportion to its length, however many tags a line has.

Defined results: a null text counts as empty (no words, no labels, score 0); a tag whose
expression does not parse, or meets another tag, adds no label; a label's score is the strength of its
evidence and a text's score that of its best label, less when an `or` leaves a choice. Very long texts
are read whole; repeated rows and repeated or null doc_ids give a row each; an empty table gives no rows;
other columns, also those named like a result, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of the contract: phrase and label.
BASE_PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Further notice phrases and their labels.
NOTICE_PHRASES = (
    ("gnu general public license version 2", "gpl-2"),
    ("gnu general public license version 3", "gpl-3"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license version 2", "mpl-2"),
    ("bsd 2 clause", "bsd-2-clause"),
    ("bsd 3 clause", "bsd-3-clause"),
    ("cc by sa", "cc-by-sa"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("isc license", "isc"),
    ("all rights reserved", "all-rights-reserved"),
)

TAG = "spdx-license-identifier:"

#: Identifiers of tags and the labels they share with the phrases.
IDENTIFIERS = {
    "mit": "mit",
    "apache-2.0": "apache-2",
    "cc-by-nc-4.0": "cc-by-nc",
    "cc-by-sa-4.0": "cc-by-sa",
    "gpl-2.0": "gpl-2",
    "gpl-2.0-only": "gpl-2",
    "gpl-2.0-or-later": "gpl-2",
    "gpl-3.0": "gpl-3",
    "gpl-3.0-only": "gpl-3",
    "gpl-3.0-or-later": "gpl-3",
    "lgpl-2.1-only": "lgpl",
    "lgpl-3.0-only": "lgpl",
    "agpl-3.0-only": "agpl",
    "mpl-2.0": "mpl-2",
    "bsd-2-clause": "bsd-2-clause",
    "bsd-3-clause": "bsd-3-clause",
    "isc": "isc",
}

_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[ \t]*(\(|\)|[a-z0-9.+:-]+)")

#: ASCII lower case, and all that is no word byte to a space; bytes above 127 stay.
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))

STRENGTH = {"tag": 1.0, "base": 0.95, "notice": 0.9}


def tokens(text: str, at: int = 0) -> Iterator[str]:
    """Parentheses, operators and identifiers from a place on, to the end of the line or the first other character."""
    while token := _TOKEN.match(text, at):
        at = token.end()
        yield token[1]


def parse(text: str, at: int = 0) -> list[str] | None:
    """The expression at a place of the text in postfix order, by a shunting yard; None where there is none. What follows a complete one on the line is text."""
    out: list[str] = []
    stack: list[str] = []
    want = True  # an operand comes next
    for token in tokens(text, at):
        if token == "(":
            if not want:
                break
            stack.append(token)
        elif token == ")":
            if want or "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif token in _PRECEDENCE:
            if want:
                return None
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[token]:
                out.append(stack.pop())
            stack.append(token)
            want = True
        else:
            if not want or TAG in token:
                break
            out.append(token)
            want = False
    if want or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(postfix: list[str]) -> tuple[frozenset[str], float]:
    """Labels that the expression names and its certainty: `and` joins, `or` halves (a choice is open), `with` keeps the licence and drops the exception."""
    stack: list[tuple[frozenset[str], float]] = []
    for token in postfix:
        if token in _PRECEDENCE:
            right, left = stack.pop(), stack.pop()
            if token == "with":
                stack.append(left)
            elif token == "and":
                stack.append((left[0] | right[0], min(left[1], right[1])))
            else:
                stack.append((left[0] | right[0], max(left[1], right[1]) / 2))
        else:
            label = IDENTIFIERS.get(token.rstrip("+"), token if token.startswith("licenseref-") else None)
            stack.append((frozenset([label]) if label else frozenset(), 1.0 if label else 0.0))
    return stack[0]


def automaton():
    """The phrases between spaces, and the tag, in one Aho-Corasick automaton."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, phrases in (("base", BASE_PHRASES), ("notice", NOTICE_PHRASES)):
        for phrase, label in phrases:
            found.add_word(f" {phrase} ", (kind, label, len(phrase) + 2))
    # no word holds its colon, so it is found in texts only, as phrases' spaces and words are in words
    found.add_word(TAG, ("tag", "", len(TAG)))
    found.make_automaton()
    return found


def scan(text: str, machine) -> dict:
    """Words, places, labels and score of one text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.translate(_FOLD).split()
    joined = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    starts, base, labels, best = [], set(), set(), 0.0
    for end, (kind, label, size) in machine.iter(joined):
        if kind == "base":
            starts.append(end + 1 - size)
            base.add(label)
        labels.add(label)
        best = max(best, STRENGTH[kind])
    folded = raw.lower().decode("utf-8", "surrogatepass")
    for end, (kind, *_) in machine.iter(folded):
        postfix = parse(folded, end + 1) if kind == "tag" else None
        if postfix:
            named, sure = evaluate(postfix)
            labels |= named
            best = max(best, sure * STRENGTH["tag"])
    place = lambda c: joined.count(" ", 0, c)
    return {
        "n_words": len(words),
        "n_base": len(starts),
        "first_word": place(min(starts)) if starts else None,
        "last_word": place(max(starts)) if starts else None,
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(labels)),
        "score": best,
    }


RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id and the columns of RESULT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in batches:
            rows = [scan(t or "", machine) for t in batch.column(1).to_pylist()]
            columns = {"doc_id": batch.column(0)}
            for name, kind in (("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())):
                columns[name] = pa.array([r[name] for r in rows], kind)
            yield pa.RecordBatch.from_pydict(columns)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, f"doc_id long, {RESULT}")
