"""Quality rules: a threshold table compiled into one projection.

Every ratio is a built-in expression over the whole text, so the scan, the measures and
the verdict are one map-only stage: no shuffle, no user function, nothing collected.

Defined results: a null text counts as empty; a text without words fails (fewer than
MIN_WORDS words); repeated rows are judged one by one; columns of the input other than
those asked for with `keep` are ignored, so their names cannot clash.
Two different 3-word windows count as the same only if their 64-bit hashes collide
within one text (below 1e-10 for a text of 20,000 words).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import text_of

SYMBOLS = "#*$%&|<>"

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to a in is that it for on with as by at be this are from or an was "
    "le la les de des du un une et en est que qui dans pour par sur au pas avec "
    "der die das und ist von mit den dem ein eine zu im auf für nicht sich auch des "
    "el los las una del y con para su se lo al como más o no"
).split()

#: The threshold table: measure, least, most (None: open). A document is kept if all rows hold.
THRESHOLDS: tuple[tuple[str, float | None, float | None], ...] = (
    ("n_words", 50, None),
    ("mean_word_chars", 2.0, 14.0),
    ("symbol_ratio", None, 0.5),
    ("repeat_ratio", None, 0.5),
    ("dup_line_ratio", None, 0.5),
    ("stop_ratio", 0.01, None),
    ("pipe_ratio", None, 0.3),
    ("shout_ratio", None, 0.5),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once: a lambda variable is bound, whereas a column used inside a lambda would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Up to so many different repeated windows are looked up in a list; more are found by sorting. Both ways give the same places.
LISTED = 48


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more: hash each window, find the hashes that repeat by sorting, and sum what their places cover."""
    n = F.size(words)
    windows = F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), 1, n - 2)

    def repeated(hashes: Column) -> Column:
        ordered = F.sort_array(hashes)
        return let(ordered, lambda s: F.array_distinct(F.filter(s, lambda x, j: (j > 0) & (F.get(s, F.greatest(j - 1, F.lit(0))) == x))))

    def sorted_places(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        beside = lambda s, x, j: F.coalesce((j >= 0) & (F.get(s, j)["h"] == x["h"]), F.lit(False))
        return let(pairs, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, j: beside(s, x, j - 1) | beside(s, x, j + 1)), lambda x: x["i"])))

    def listed_places(hashes: Column, found: Column) -> Column:
        at = F.transform(hashes, lambda h, i: F.when(F.array_contains(found, h), i))
        return F.filter(at, lambda i: i.isNotNull())

    def covered(places: Column) -> Column:
        step = lambda p, j: F.least(F.lit(3), F.coalesce(F.get(places, j + 1) - p, F.lit(3)))
        return F.aggregate(F.transform(places, step), F.lit(0).cast("long"), lambda a, x: a + x)

    def count(hashes: Column) -> Column:
        return let(
            repeated(hashes),
            lambda found: F.when(F.size(found) == 0, F.lit(0).cast("long"))
            .when(F.size(found) <= LISTED, let(listed_places(hashes, found), covered))
            .otherwise(let(sorted_places(hashes), covered)),
        )

    return F.when(n < 4, F.lit(0).cast("long")).otherwise(let(windows, count))


def _of_words(words: Column) -> Column:
    return F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("chars"),
        _repeat_words(words).alias("n_repeat_words"),
        F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).alias("n_stop"),
    )


def _of_lines(lines: Column) -> Column:
    return F.struct(F.size(lines).alias("n"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("dup"))


def measures(text: Column) -> list[tuple[str, Column]]:
    """(name, expression) in order: an expression may use the names before it."""
    n, without = F.col("n_words").cast("double"), lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    ratio = lambda a, b: F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))
    return [
        ("_w", let(F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != ""), _of_words)),
        ("_l", let(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), _of_lines)),
        ("n_words", F.col("_w.n_words")),
        ("word_chars", F.col("_w.chars")),
        ("n_symbols", without(SYMBOLS).cast("long")),
        ("n_dup_lines", F.col("_l.dup")),
        ("n_repeat_words", F.col("_w.n_repeat_words")),
        ("mean_word_chars", ratio(F.col("word_chars"), n)),
        ("symbol_ratio", ratio(F.col("n_symbols"), F.col("word_chars"))),
        ("repeat_ratio", ratio(F.col("n_repeat_words"), n)),
        ("dup_line_ratio", ratio(F.col("n_dup_lines"), F.col("_l.n"))),
        ("stop_ratio", ratio(F.col("_w.n_stop"), n)),
        ("pipe_ratio", ratio(F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit(""))), n)),
        ("shout_ratio", ratio((F.length(text) - F.length(F.replace(text, F.lit("!!"), F.lit("")))) / 2, n)),
    ]


def verdict(thresholds=THRESHOLDS) -> Column:
    """The threshold table as one boolean expression over the measures."""
    out = F.lit(True)
    for name, least, most in thresholds:
        if least is not None:
            out = out & (F.col(name) >= F.lit(least))
        if most is not None:
            out = out & (F.col(name) <= F.lit(most))
    return out


def judge(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), thresholds=THRESHOLDS) -> DataFrame:
    """The columns `keep`, every measure, base_failed and kept, one row per row of docs."""
    out = docs.select(*keep, text_of().alias("_raw"))
    for name, expression in measures(F.col("_raw")):
        out = out.withColumn(name, expression)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(thresholds))
    return out.drop("_raw", "_w", "_l")
