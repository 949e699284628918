"""Personal data: base kinds by expressions, further identifiers by bootstrapped contextual extraction. Built-in functions only.

Base. Each kind's leftmost, non-overlapping matches are found by splitting the text at the
pattern and summing the lengths of pieces and matches, so places are code points without a
user function. The patterns start only where a match can start (a look-behind) and use
possessive repeats, so they accept what the plain patterns accept in time linear in the text.

Bootstrapping. Every token with a digit or an at sign is an instance with its place, a
coarse shape and its contexts: the word before, the two words before, the word after.
(context, shape) is a lexical pattern. Seeds score 1: instances inside a base span, and long
strings of hexadecimal digits (SECRET), the form of keys and tokens. ROUNDS times, a
pattern's confidence is the mean score of its instances, shrunk by SHRINK instances of score
0, and the score of an instance that is no seed is 1 - product(1 - confidence) over its
confident patterns. Instances outside base spans with at least two confident patterns and a
score of ACCEPT or more become spans of kind `id`, so a seed's form alone, in a context that
does not recur, is not enough; base spans always stay.

Scale. One pass reads the texts and writes narrow rows (base spans, instances) to the
shared folder; pattern scores are sums by key with partial aggregation; nothing is collected
or broadcast beyond what Spark decides from sizes it knows.

Defined results: null and empty texts have no spans (base_sha256 of the empty string);
repeated rows get equal results; instances of one text are scored in all rows that have it;
columns other than doc_id and text are ignored; a long text takes time in proportion to its
length and (times the root) to its matches; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut, text_of

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
_HOST = "[A-Za-z0-9-]++"

#: kind -> (pattern, characters without which there is no match)
PATTERNS = {
    "email": (rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@{_HOST}(?:\.{_HOST})++", r"@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9]"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}

_SPACE = r"\x20\x09-\x0D"
TOKEN = rf"(?<![^{_SPACE}])[^{_SPACE}0-9@]*+[0-9@][^{_SPACE}]*+"

#: Fixed value: the form of secrets that are seeds.
SECRET = "^[0-9a-f]{32,}$"
#: Matches whose places are summed in one block.
RUN = 256

ROUNDS = 2
SHRINK = 3.0
CONFIDENT = 0.8
ACCEPT = 0.95
SPAN = "array<struct<kind:string,start:int,end:int>>"


def let(value: Column, body) -> Column:
    """body(value), evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(sizes: Column) -> Column:
    """For each size the sum of those before it: within blocks of RUN, then over the blocks, so that no long array is copied once per element."""
    none = F.array().cast("array<int>")

    def within(b: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), none.alias("all"))
        return F.aggregate(F.slice(sizes, b * RUN + 1, F.lit(RUN)), zero, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")))

    def over(acc: Column, b: Column) -> Column:
        return F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["all"], F.array(F.transform(b["all"], lambda s: s + acc["at"]))).alias("all"))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / RUN).cast("int")), within)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("all"))
    return F.flatten(F.aggregate(blocks, zero, over)["all"])


def matches(text: Column, pattern: str, around: bool = False) -> Column:
    """array<struct<start, end, m>> of all matches, in code points, end exclusive; with `around` also the text between the match before the last and this one, and from it to the next one's end."""
    kind = "array<struct<start:int,end:int,m:string" + (",left:string,right:string>>" if around else ">>")

    def placed(found: Column, gaps: Column) -> Column:
        sizes = F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))

        def row(before: Column, m: Column, i: Column) -> Column:
            start = F.get(before, i) + F.length(F.get(gaps, i))
            parts = [start.alias("start"), (start + F.length(m)).alias("end"), m.alias("m")]
            if around:
                part = lambda array, k: F.coalesce(F.get(array, k), F.lit(""))
                parts.append(F.concat(part(found, i - 2), part(gaps, i - 1), part(found, i - 1), F.get(gaps, i)).alias("left"))
                parts.append(F.concat(F.get(gaps, i + 1), part(found, i + 1)).alias("right"))
            return F.struct(*parts)

        return let(sizes, lambda z: let(running(z), lambda before: F.transform(found, lambda m, i: row(before, m, i))))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, F.array().cast(kind)).otherwise(let(F.split(text, pattern, -1), lambda gaps: placed(found, gaps))))


def _small_parts(m: Column) -> Column:
    part = lambda p: let(F.ltrim(p, F.lit("0")), lambda x: (F.length(x) < 3) | ((F.length(x) == 3) & (x <= F.lit("255"))))
    return F.forall(F.split(m, r"\."), part)


def _luhn(m: Column) -> Column:
    def valid(digits: Column) -> Column:
        n = F.length(digits)

        def add(acc: Column, i: Column) -> Column:
            d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
            return acc + F.when(i % 2 == 0, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

        return F.when(n.between(16, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))

    return let(F.translate(m, " -", ""), valid)


TESTS = {
    "email": lambda m: F.lit(True),
    "ip": _small_parts,
    "card": _luhn,
    "phone": lambda m: F.length(F.translate(m, "+ ().-", "")).between(8, 15),
}


def base_spans(text: Column, kind: str) -> Column:
    """array<struct<kind, start, end>> of one base kind, in order."""
    pattern, needs = PATTERNS[kind]
    found = F.filter(matches(text, pattern), lambda x: TESTS[kind](x["m"]))
    spans = F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return F.when(text.rlike(needs), spans).otherwise(F.array().cast(SPAN))


def instances(text: Column) -> Column:
    """array<struct<start, end, core, before, before2, after>> of the tokens with a digit or an at sign, without the marks around them."""

    def context(x: Column) -> Column:
        core = F.regexp_extract(x["m"], r"[\p{L}0-9](?:.*[\p{L}0-9])?", 0)
        start = x["start"] + F.greatest(F.instr(x["m"], core) - 1, F.lit(0))
        word = lambda words, k: F.coalesce(F.get(words, F.size(words) - k), F.lit(""))

        def named(words: Column) -> Column:
            return F.struct(
                start.alias("start"),
                (start + F.length(core)).alias("end"),
                core.alias("core"),
                F.lower(word(words, 1)).alias("before"),
                F.lower(F.when(F.size(words) > 1, F.concat(word(words, 2), F.lit(" "), word(words, 1))).otherwise("")).alias("before2"),
                F.lower(F.regexp_extract(x["right"], rf"^[{_SPACE}]*+([^{_SPACE}]++)", 1)).alias("after"),
            )

        return let(F.filter(F.split(x["left"], rf"[{_SPACE}]+"), lambda w: w != ""), named)

    return F.when(text.rlike("[0-9@]"), F.filter(F.transform(matches(text, TOKEN, True), context), lambda x: F.length(x["core"]) >= 4))


def shape(core: Column) -> Column:
    """Coarse shape: runs of letters and digits mixed to *, digit runs to 9, letter runs to a."""
    mixed = F.regexp_replace(core, r"(?<![\p{L}0-9])(?:[0-9]++\p{L}|\p{L}++[0-9])[\p{L}0-9]*+", "*")
    return F.regexp_replace(F.regexp_replace(mixed, "[0-9]+", "9"), r"\p{L}+", "a")


def find(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, h (hash of the text), base spans and instances, written to the shared folder."""
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return cut(rows.select("doc_id", F.xxhash64("text").alias("h"), *[base_spans(text, k).alias(k) for k in KINDS], instances(text).alias("instances")))


def discover(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, h and spans (kind id) of the instances that confident patterns extract."""
    base = F.concat(*KINDS)
    each = found.filter(F.size("instances") > 0).select("doc_id", "h", base.alias("base"), F.explode("instances").alias("x"))
    inside = F.exists("base", lambda b: (b["start"] < F.col("x.end")) & (F.col("x.start") < b["end"]))
    each = cut(each.select("doc_id", "h", F.col("x.start").alias("start"), F.col("x.end").alias("end"), inside.alias("base"), (inside | F.col("x.core").rlike(SECRET)).alias("seed"), shape(F.col("x.core")).alias("shape"), "x.before", "x.before2", "x.after").distinct())
    contexts = F.array(*[F.struct(F.lit(k).alias("side"), F.col(k).alias("word")) for k in ("before", "before2", "after")])
    nodes = each.select("doc_id", "h", "start", "end", "base", "seed", F.explode(contexts).alias("c"), "shape").filter("trim(c.word) <> ''").select("doc_id", "h", "start", "end", "base", "seed", F.xxhash64("c.side", "c.word", "shape").alias("pattern"))
    key = ["doc_id", "h", "start", "end"]
    scored = nodes.withColumn("score", F.col("seed").cast("double"))
    for _ in range(rounds):
        patterns = scored.groupBy("pattern").agg((F.sum("score") / (F.count(F.lit(1)) + SHRINK)).alias("confidence")).filter(F.col("confidence") >= CONFIDENT)
        loose = nodes.filter("not base").join(patterns, "pattern")
        reached = cut(loose.groupBy(*key).agg((1 - F.exp(F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.9999)))))).alias("reach"), F.count(F.lit(1)).alias("support")))
        same = [nodes[k].eqNullSafe(reached[k]) for k in key]
        scored = nodes.join(reached, [*same, ~nodes.seed], "left").select(*[nodes[k] for k in key], "seed", "pattern", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("reach", F.lit(0.0))).alias("score"))
    taken = reached.filter((F.col("reach") >= ACCEPT) & (F.col("support") >= 2))
    return taken.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set(F.struct(F.lit("id").alias("kind"), "start", "end"))).alias("extra"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def with_extra(found: DataFrame) -> DataFrame:
    """found with `extra`: the spans that bootstrapping adds."""
    extra = cut(discover(found))
    joined = found.join(extra, found.doc_id.eqNullSafe(extra.doc_id) & (found.h == extra.h), "left")
    return joined.select(found.doc_id, found.h, *KINDS, F.coalesce("extra", F.array().cast(SPAN)).alias("extra"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts per base kind, n_extra, base_sha256 and spans of every row of docs."""
    base = F.concat(*KINDS)
    return with_extra(find(docs)).select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.size("extra").cast("long").alias("n_extra"),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.concat(base, "extra")).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """The columns of docs, every span in text replaced by its kind in angle brackets and n_chars (if there) counted anew; overlapping spans go as one, named by the first."""
    extra = cut(discover(find(docs)))
    keyed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"), text_of().alias("_text")).withColumn("_h", F.xxhash64("_text"))
    joined = keyed.join(extra, keyed._id.eqNullSafe(extra.doc_id) & (keyed._h == extra.h), "left").select("_row", "_text", "extra")
    text = F.col("_text")
    spans = F.concat(*[base_spans(text, k) for k in KINDS], F.coalesce("extra", F.array().cast(SPAN)))
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def cover(sorted_spans: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

        def step(acc: Column, s: Column) -> Column:
            gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
            new = F.concat(acc["out"], F.array(gap, F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], new).otherwise(acc["out"]).alias("out"))

        end = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
        return F.when(F.size(sorted_spans) == 0, text).otherwise(F.aggregate(sorted_spans, zero, step, end))

    cleaned = joined.withColumn("_new", F.when(F.col("_row.text").isNotNull(), let(ordered, cover)))
    columns = []
    for name in docs.columns:
        if name == "text":
            columns.append(F.col("_new").alias("text"))
        elif name == "n_chars":
            columns.append(F.length("_new").cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        else:
            columns.append(F.col(f"_row.`{name}`"))
    return cleaned.select(*columns)
