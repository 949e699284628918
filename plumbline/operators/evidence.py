"""Further detectors, evidence handling and the named query library."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import patterns
from plumbline.operators.investigate import FINDINGS, findings
from plumbline.plans.registry import query
from plumbline.plans.tables import Tables


@query("flt05_coalesce", """SELECT p.pol, coalesce(min(d.comp), -1) AS first_company FROM politician p LEFT JOIN director d USING (pol) GROUP BY p.pol""")
def coalesce_projection(t: Tables) -> DataFrame:
    return t.politician.select("pol").join(t.director.groupBy("pol").agg(F.min("comp").alias("c")), "pol", "left").select("pol", F.coalesce("c", F.lit(-1)).alias("first_company"))


@query("flt07_in_list", """SELECT comp FROM company WHERE state IN ('NATION_3', 'NATION_4') OR ends_with(name, '7') OR capital >= 9000""")
def in_list(t: Tables) -> DataFrame:
    return t.company.filter(F.col("state").isin("NATION_3", "NATION_4") | F.endswith("name", F.lit("7")) | (F.col("capital") >= 9000)).select("comp")


@query("flt10_any_not_null", """SELECT event_id FROM events WHERE coalesce(json_extract_string(props, '$.k'), json_extract_string(props, '$.date')) IS NOT NULL""")
def any_not_null(t: Tables) -> DataFrame:
    return t.raw("events").filter(F.coalesce(F.get_json_object("props", "$.k"), F.get_json_object("props", "$.date")).isNotNull()).select("event_id")


@query("flt11_input_guard", """SELECT item_id, length(text) <= 200 AND NOT regexp_matches(text, '\\b(CREATE|DELETE|DROP|MERGE|SET)\\b') AS accepted FROM benchmark""")
def input_guard(t: Tables, most: int = 200) -> DataFrame:
    fine = (F.length("text") <= most) & ~F.col("text").rlike(r"\b(CREATE|DELETE|DROP|MERGE|SET)\b")
    return t.raw("benchmark").select("item_id", fine.alias("accepted"))


@query("jn18_best_match", """, w AS (SELECT item_id, list_distinct(string_split(lower(text), ' ')) AS w FROM benchmark), s AS (SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.w, b.w)) AS n FROM w a JOIN w b ON a.item_id <> b.item_id) SELECT a, b, n FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS k FROM s WHERE n > 0) WHERE k = 1""")
def best_match(t: Tables) -> DataFrame:
    """The text that shares most different words; texts meet on words."""
    w = t.raw("benchmark").select("item_id", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("w"))
    a, b = (w.withColumnRenamed("item_id", k) for k in ("a", "b"))
    n = a.join(b, "w").filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    top = Window.partitionBy("a").orderBy(F.col("n").desc(), "b")
    return n.withColumn("k", F.row_number().over(top)).filter("k = 1").select("a", "b", "n")


@query("ag06_distinct_branches", """SELECT p.pol, count(DISTINCT d.comp) AS companies, count(DISTINCT c.contract) AS contracts, count(DISTINCT e.kind) AS kinds FROM politician p LEFT JOIN director d USING (pol) LEFT JOIN contract c ON c.cust = p.pol LEFT JOIN (SELECT DISTINCT pol, kind FROM event) e ON e.pol = p.pol GROUP BY p.pol""")
def distinct_branches(t: Tables) -> DataFrame:
    """Each branch is counted before the join."""
    parts = ((t.director, "pol", "comp", "companies"), (t.contract, "cust", "contract", "contracts"), (t.event, "pol", "kind", "kinds"))
    out = t.politician.select("pol")
    for df, key, what, name in parts:
        out = out.join(df.groupBy(F.col(key).alias("pol")).agg(F.count_distinct(what).alias(name)), "pol", "left")
    return out.select("pol", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("companies", "contracts", "kinds")])


@query("ag19_evidence_dedupe", """SELECT DISTINCT source, lang FROM documents""")
def evidence_dedupe(t: Tables) -> DataFrame:
    return t.raw("documents").dropDuplicates(["source", "lang"]).select("source", "lang")


@query("ag21_alias_stats", """SELECT count(*) AS aliases, count(DISTINCT kind) AS ids, round(count(DISTINCT kind) / count(*), 6) AS ratio FROM event""")
def alias_stats(t: Tables) -> DataFrame:
    return t.event.agg(F.count(F.lit(1)).alias("aliases"), F.count_distinct("kind").alias("ids")).withColumn("ratio", F.round(F.col("ids") / F.col("aliases"), 6))


@query("ag23_source_diversity", """SELECT lang, count(DISTINCT source) AS sources FROM documents GROUP BY lang""")
def source_diversity(t: Tables) -> DataFrame:
    return t.raw("documents").groupBy("lang").agg(F.count_distinct("source").alias("sources"))


@query("ag24_case_stats", FINDINGS + " SELECT type, count(*) AS n, CAST(sum(CASE WHEN severity = 'HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS confirmed, CAST(sum(CASE WHEN severity <> 'HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS open FROM f GROUP BY type")
def case_stats(t: Tables) -> DataFrame:
    high = F.sum(F.when(F.col("severity") == "HIGH", 1).otherwise(0))
    return findings(t).groupBy("type").agg(F.count(F.lit(1)).alias("n"), high.alias("confirmed"), (F.count(F.lit(1)) - high).alias("open"))


@query("wn04_granger_lags", """, s AS (SELECT pol, value, lag(value, 1) OVER w AS v1, lag(value, 2) OVER w AS v2, count(*) OVER (PARTITION BY pol) AS n FROM event WINDOW w AS (PARTITION BY pol ORDER BY ts, event_id)) SELECT pol, round(sum((value - v1) ** 2), 6) AS rss1, round(sum((value - (v1 + v2) / 2) ** 2), 6) AS rss2 FROM s WHERE n >= 8 AND v2 IS NOT NULL GROUP BY pol""")
def granger_lags(t: Tables, least: int = 8) -> DataFrame:
    w = Window.partitionBy("pol").orderBy("ts", "event_id")
    s = t.event.select("pol", "value", F.lag("value", 1).over(w).alias("v1"), F.lag("value", 2).over(w).alias("v2"), F.count(F.lit(1)).over(Window.partitionBy("pol")).alias("n"))
    square = lambda x: F.round(F.sum(x * x), 6)
    return s.filter((F.col("n") >= least) & F.col("v2").isNotNull()).groupBy("pol").agg(square(F.col("value") - F.col("v1")).alias("rss1"), square(F.col("value") - (F.col("v1") + F.col("v2")) / 2).alias("rss2"))


@query("wn06_adjacent_gap", """SELECT contract, CAST(date_diff('day', day, lead(day) OVER (PARTITION BY cust ORDER BY day, contract)) AS INTEGER) AS gap FROM contract""")
def adjacent_gap(t: Tables) -> DataFrame:
    w = Window.partitionBy("cust").orderBy("day", "contract")
    return t.contract.select("contract", F.datediff(F.lead("day").over(w), "day").alias("gap"))


@query("dt08_shared_passages", """, d AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), b AS (SELECT line, count(*) AS n FROM d WHERE length(line) >= 40 GROUP BY line HAVING count(*) >= 2) SELECT md5(line) AS line, n FROM b""")
def shared_passages(t: Tables, least: int = 40) -> DataFrame:
    lines = t.raw("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(F.length("line") >= least).distinct()
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select(F.md5("line").alias("line"), "n")


@query("dt11_cover_bids", """, g AS (SELECT comp, amount, lead(amount) OVER (PARTITION BY comp ORDER BY amount) - amount AS gap FROM won) SELECT comp, count(*) AS bids, max(gap) < 0.1 * stddev_pop(amount) AS cover FROM g GROUP BY comp HAVING count(*) >= 3""")
def cover_bids(t: Tables) -> DataFrame:
    g = t.won.withColumn("gap", F.lead("amount").over(Window.partitionBy("comp").orderBy("amount")) - F.col("amount"))
    return g.groupBy("comp").agg(F.count(F.lit(1)).alias("bids"), (F.max("gap") < 0.1 * F.stddev_pop("amount")).alias("cover")).filter("bids >= 3")


@query("dt21_biography", """SELECT pol, string_agg(kind || ': ' || n, '; ' ORDER BY kind) AS text FROM (SELECT pol, kind, count(*) AS n FROM event GROUP BY 1, 2) GROUP BY pol""")
def biography(t: Tables) -> DataFrame:
    k = t.event.groupBy("pol", "kind").agg(F.count(F.lit(1)).alias("n"))
    parts = F.sort_array(F.collect_list(F.concat("kind", F.lit(": "), F.col("n").cast("string"))))
    return k.groupBy("pol").agg(F.array_join(parts, "; ").alias("text"))


@query("gr09_ego_edges", """SELECT DISTINCT d.pol AS ego, o.src, o.dst FROM director d JOIN owns o ON d.comp IN (o.src, o.dst)""")
def ego_edges(t: Tables) -> DataFrame:
    ends = t.owns.select("src", "dst", F.explode(F.array("src", "dst")).alias("comp"))
    return t.director.join(ends, "comp").select(F.col("pol").alias("ego"), "src", "dst").distinct()
