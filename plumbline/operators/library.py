"""The named query library, remaining functions, loaders and resolution forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import patterns, resolution
from plumbline.plans.registry import query
from plumbline.plans.tables import Tables

#: Name -> (risk, plan), the library run by name.
LIBRARY: dict[str, tuple[str, Callable[..., DataFrame]]] = {
    "politician_company_contracts": ("HIGH", patterns.director_contracts),
    "repeated_contract_winners": ("MEDIUM", patterns.repeated_winners),
    "ministry_audit_flags": ("MEDIUM", lambda t, **k: ministry_flags(t, **k)),
    "scheme_irregularities": ("HIGH", patterns.scheme_flags),
    "politicians_with_cases": ("MEDIUM", lambda t, **k: with_cases(t, **k)),
    "politician_profile": ("INFO", patterns.politician_profile),
    "high_value_contracts": ("HIGH", patterns.high_value_contracts),
    "node_counts": ("INFO", patterns.node_counts),
    "relationship_counts": ("INFO", patterns.relationship_counts),
}


def run_named(t: Tables, name: str, **parameters) -> DataFrame:
    """A query of the library with its parameters; an unknown name gives no rows."""
    if name not in LIBRARY:
        return t.spark.createDataFrame([], "name string")
    return LIBRARY[name][1](t, **parameters)


@query("lib_named_query", """SELECT c.name AS company, w.contract, a.ministry, w.amount FROM won w JOIN company c USING (comp) JOIN awarded a USING (contract) WHERE w.amount >= 60000 ORDER BY w.amount DESC, w.contract, company LIMIT 50""")
def q_named(t: Tables) -> DataFrame:
    return run_named(t, "high_value_contracts", least=60_000)


@query("lib_ministry_flags", """SELECT a.ministry, count(*) AS flags, round(sum(w.amount), 4) AS amount FROM won w JOIN awarded a USING (contract) WHERE w.amount > 80000 GROUP BY a.ministry ORDER BY flags DESC, a.ministry LIMIT 20""")
def ministry_flags(t: Tables) -> DataFrame:
    x = t.won.filter("amount > 80000").join(t.awarded, "contract").groupBy("ministry").agg(F.count(F.lit(1)).alias("flags"), F.round(F.sum("amount"), 4).alias("amount"))
    return x.orderBy(F.col("flags").desc(), "ministry").limit(20)


@query("lib_with_cases", """SELECT pol, count(*) AS cases FROM event WHERE kind = 'error' GROUP BY pol HAVING count(*) > 0 ORDER BY cases DESC, pol LIMIT 50""")
def with_cases(t: Tables) -> DataFrame:
    return t.event.filter("kind = 'error'").groupBy("pol").agg(F.count(F.lit(1)).alias("cases")).orderBy(F.col("cases").desc(), "pol").limit(50)


#: States by code; a name without spaces counts as its state.
STATES = {
    "tn": "Tamil Nadu", "mh": "Maharashtra", "dl": "Delhi", "ka": "Karnataka", "up": "Uttar Pradesh",
    "wb": "West Bengal", "rj": "Rajasthan", "mp": "Madhya Pradesh", "gj": "Gujarat", "ap": "Andhra Pradesh",
    "ts": "Telangana", "kl": "Kerala", "pb": "Punjab", "hr": "Haryana", "br": "Bihar", "or": "Odisha",
    "as": "Assam", "jh": "Jharkhand", "hp": "Himachal Pradesh", "uk": "Uttarakhand", "ct": "Chhattisgarh",
    "ga": "Goa", "mn": "Manipur", "ml": "Meghalaya", "mz": "Mizoram", "nl": "Nagaland", "tr": "Tripura",
    "sk": "Sikkim", "ar": "Arunachal Pradesh",
}


def clean_state(c: Column) -> Column:
    """The state of a code or of a name without its spaces, else the text in title case."""
    known = STATES | {v.lower().replace(" ", ""): v for k, v in STATES.items() if k != "ar"}
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(names[F.regexp_replace(F.lower(F.trim(c)), r"\s+", "")], F.initcap(c))


_STATE_SQL = " ".join(f"WHEN lower(replace(x, ' ', '')) IN ('{k}', '{v.lower().replace(' ', '')}') THEN '{v}'" for k, v in STATES.items())


@query("sc04_clean_state", f"""SELECT x, CASE {_STATE_SQL} ELSE x END AS clean FROM (SELECT DISTINCT CASE c_custkey % 4 WHEN 0 THEN {list(STATES)}[c_custkey % 29 + 1] WHEN 1 THEN ' ' || upper({list(STATES)}[c_custkey % 29 + 1]) WHEN 2 THEN {list(STATES.values())}[c_custkey % 28 + 1] ELSE 'Elsewhere' END AS x FROM customer)""".replace("lower(replace(x", "lower(replace(x"))
def q_clean_state(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    codes, names = F.array(*map(F.lit, STATES)), F.array(*map(F.lit, STATES.values()))
    code = F.get(codes, (k % 29).cast("int"))
    x = F.when(k % 4 == 0, code).when(k % 4 == 1, F.concat(F.lit(" "), F.upper(code))).when(k % 4 == 2, F.get(names, (k % 28).cast("int"))).otherwise("Elsewhere")
    return t.raw("customer").select(x.alias("x")).distinct().select("x", clean_state(F.col("x")).alias("clean"))


@query("sc05_clean_record", """SELECT contract, lower(trim(buyer)) AS buyer, round(total / 10000000, 6) AS crore FROM contract""")
def clean_record(t: Tables) -> DataFrame:
    return t.contract.select("contract", F.lower(F.trim("buyer")).alias("buyer"), F.round(F.col("total") / 1e7, 6).alias("crore"))


@query("sc10_key_score", """, k AS (SELECT comp, 'K' || comp // 3 AS pan, CASE WHEN comp % 2 = 0 THEN 'C' || comp % 3 END AS cin FROM company) SELECT a.comp AS a, b.comp AS b, CASE WHEN a.cin IS NOT NULL AND b.cin IS NOT NULL THEN CASE WHEN a.cin = b.cin THEN 1.0 ELSE 0.0 END ELSE 1.0 END AS score FROM k a JOIN k b ON a.comp < b.comp AND a.pan = b.pan""")
def q_key_score(t: Tables) -> DataFrame:
    """The first key that both have decides; companies meet on an equal key."""
    raw = t.company.select(F.col("comp").alias("seq"), "name", F.concat(F.lit(" k"), F.expr("comp div 3").cast("string")).alias("pan"), F.when(F.col("comp") % 2 == 0, F.concat(F.lit("c"), (F.col("comp") % 3).cast("string"))).alias("cin"))
    k = resolution.with_keys(raw).withColumn("meet", F.get("keys", F.lit(1)))
    a, b = (k.select(F.col("seq").alias(n), F.col("keys").alias(f"k{n}"), "meet") for n in ("a", "b"))
    return a.join(b, "meet").filter("a < b").select("a", "b", resolution.key_score(F.col("ka"), F.col("kb")).alias("score"))


@query("sc11_combined_score")
def combined_score(t: Tables) -> DataFrame:
    """Keys first, then equal names, then .6 Jaro-Winkler + .4 Jaccard."""
    return resolution.scored_pairs(resolution.part_records(t))


@query("sc19_search_variants", """SELECT p_partkey, list_sort(list_distinct([lower(p_name), regexp_replace(lower(p_name), '[aeiou]', '', 'g')])) AS variants FROM part""")
def search_variants(t: Tables) -> DataFrame:
    x = F.lower("p_name")
    return t.raw("part").select("p_partkey", F.sort_array(F.array_distinct(F.array(x, F.regexp_replace(x, "[aeiou]", "")))).alias("variants"))


@query("sc20_labels", """SELECT pol, CASE WHEN assets < 0 THEN 'niedrig' WHEN assets < 5000 THEN 'mittel' ELSE 'HIGH' END AS label FROM politician""")
def translated_labels(t: Tables) -> DataFrame:
    """A level in another language, where the table lacks it in the first."""
    known = F.create_map(F.lit("LOW"), F.lit("niedrig"), F.lit("MODERATE"), F.lit("mittel"))
    level = F.when(F.col("assets") < 0, "LOW").when(F.col("assets") < 5000, "MODERATE").otherwise("HIGH")
    return t.politician.select("pol", level.alias("level")).select("pol", F.coalesce(known[F.col("level")], "level").alias("label"))


def sections_of(text: Column, size: int = 500) -> Column:
    """Sentences packed greedily into sections of at most `size` characters; a longer sentence is a section of its own."""
    sentences = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda x: x != "")
    zero = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("done"))

    def pack(acc: Column, x: Column) -> Column:
        fits = (acc["open"] == "") | (F.length(acc["open"]) + 1 + F.length(x) <= size)
        joined = F.when(acc["open"] == "", x).otherwise(F.concat(acc["open"], F.lit(" "), x))
        return F.struct(F.when(fits, joined).otherwise(x).alias("open"), F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"))

    return F.aggregate(sentences, zero, pack, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


SECTIONS_SQL = "s AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')) AS x, generate_subscripts(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> ''), 1) AS k FROM benchmark), r AS (SELECT item_id, k, 1 AS section, length(trim(x)) AS used FROM s WHERE k = 1 UNION ALL SELECT s.item_id, s.k, CASE WHEN r.used + 1 + length(trim(s.x)) <= 120 THEN r.section ELSE r.section + 1 END, CASE WHEN r.used + 1 + length(trim(s.x)) <= 120 THEN r.used + 1 + length(trim(s.x)) ELSE length(trim(s.x)) END FROM r JOIN s ON s.item_id = r.item_id AND s.k = r.k + 1)"


@query("sc23_sections", f""", {SECTIONS_SQL} SELECT item_id, CAST(section AS INTEGER) AS section, CAST(max(used) AS INTEGER) AS chars FROM r GROUP BY item_id, section""")
def sections(t: Tables, size: int = 120) -> DataFrame:
    x = t.raw("benchmark").select("item_id", F.posexplode(sections_of(F.col("text"), size)).alias("section", "x"))
    return x.select("item_id", (F.col("section") + 1).alias("section"), F.length("x").alias("chars"))


#: Words that carry no topic.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with",
    "by", "from", "is", "are", "was", "were", "be", "been", "being", "have", "has",
    "had", "do", "does", "did", "will", "would", "could", "should", "may", "might",
    "shall", "can", "that", "this", "these", "those", "it", "its", "their", "which",
)


def topic_words(text: Column) -> Column:
    """Distinct words of three letters or more but the stop words."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), lambda x: F.length(x) >= 3)
    return F.array_except(words, F.array(*map(F.lit, STOP_WORDS)))


@query("sc24_stop_worded", f"""SELECT item_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) >= 3 AND NOT list_contains({list(STOP_WORDS)}, x)))) AS words FROM benchmark""")
def stop_worded(t: Tables) -> DataFrame:
    return t.raw("benchmark").select("item_id", F.sort_array(topic_words(F.col("text"))).alias("words"))


#: Signs of hesitation.
HESITATIONS = (
    r"\b(might|may|could|possibly|perhaps|arguably|potentially)\b",
    r"\b(unclear|uncertain|ambiguous|inconclusive|questionable)\b",
    r"\b(it seems|it appears|it is possible|one could argue)\b",
    r"\b(however|although|but|yet|nevertheless|on the other hand)\b",
    r"\b(limited|partial|insufficient|incomplete|weak)\b",
)


_HESITATION_SQL = " + ".join(f"len(regexp_extract_all(x, '{p}'))" for p in HESITATIONS)


@query("sc28_hesitations", f"""SELECT event_id, CAST({_HESITATION_SQL} AS INTEGER) AS n FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'it seems weak, but ' ELSE 'perhaps unclear: ' END || lower(event_type) || ' may-be limited' AS x FROM events)""")
def hesitations(t: Tables) -> DataFrame:
    x = F.concat(F.when(F.col("event_id") % 3 == 0, "it seems weak, but ").otherwise("perhaps unclear: "), F.lower("event_type"), F.lit(" may-be limited"))
    total = sum((F.regexp_count(x, F.lit(p)) for p in HESITATIONS[1:]), F.regexp_count(x, F.lit(HESITATIONS[0])))
    return t.raw("events").select("event_id", total.alias("n"))


@query("wn11_band_severity", """SELECT contract, CASE WHEN gap <= 30 // 3 THEN 'HIGH' WHEN gap <= 30 // 2 THEN 'MODERATE' WHEN gap <= 30 THEN 'LOW' END AS severity FROM (SELECT contract, date_diff('day', lag(day) OVER (PARTITION BY cust ORDER BY day, contract), day) AS gap FROM contract)""")
def band_severity(t: Tables, window: int = 30) -> DataFrame:
    gap = F.datediff("day", F.lag("day").over(Window.partitionBy("cust").orderBy("day", "contract")))
    return t.contract.withColumn("gap", gap).select("contract", F.when(F.col("gap") <= window // 3, "HIGH").when(F.col("gap") <= window // 2, "MODERATE").when(F.col("gap") <= window, "LOW").alias("severity"))


@query("gr10_bridge_indicator", """, n AS (SELECT 'c' || comp AS id, 'p' || pol AS nb FROM director UNION SELECT 'c' || src, 'c' || dst FROM owns UNION SELECT 'c' || dst, 'c' || src FROM owns) SELECT id, count(*) AS degree, count(DISTINCT left(nb, 1)) >= 2 AS bridge FROM n GROUP BY id""")
def bridge_indicator(t: Tables) -> DataFrame:
    n = patterns.neighbours(t).filter("id like 'c%'").select("id", "neighbour").distinct()
    return n.groupBy("id").agg(F.count(F.lit(1)).alias("degree"), (F.count_distinct(F.substring("neighbour", 1, 1)) >= 2).alias("bridge"))
