"""Forensic detectors, set-at-a-time: one DataFrame of all entities in, one scored DataFrame out."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.plans.registry import query
from plumbline.plans.tables import Tables

#: Upper bounds of the risk levels.
LEVELS = (("LOW", 30), ("MODERATE", 60), ("HIGH", 80), ("VERY_HIGH", 100))


def level(score: Column) -> Column:
    out = F.lit(LEVELS[-1][0])
    for name, most in reversed(LEVELS[:-1]):
        out = F.when(score <= most, name).otherwise(out)
    return out


def _risk_parts(t: Tables) -> DataFrame:
    """Per person: contracts won by directed companies, own orders, a digit in the assets, late line items as cases."""
    won = t.won.groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
    directed = t.director.join(won, "comp").groupBy("pol").agg(F.sum("n").alias("directed"))
    own = t.contract.groupBy(F.col("cust").alias("pol")).agg(F.count(F.lit(1)).alias("own"), F.sum(F.when(F.col("total") > 300_000, 1).otherwise(0)).alias("cases"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return t.politician.join(directed, "pol", "left").join(own, "pol", "left").select("pol", "party", "assets", zero("directed").alias("directed"), zero("own").alias("own"), zero("cases").alias("cases"))


def named_in_audits(names: DataFrame, t: Tables) -> DataFrame:
    """id and audits: how many audit titles contain each of the names (id, name)."""
    from plumbline.operators.loaders import contains_join

    found = contains_join(t.audit_title.select(F.col("doc_id").alias("id"), F.col("title").alias("name")), names.select(F.col("id").alias("mid"), F.col("name").alias("mention")))
    return found.groupBy(F.col("mid").alias("id")).agg(F.count(F.lit(1)).alias("audits"))


_PERSON = """, won_n AS (SELECT comp, count(*) AS n FROM won GROUP BY comp), d AS (SELECT pol, CAST(sum(n) AS BIGINT) AS directed FROM director JOIN won_n USING (comp) GROUP BY pol), o AS (SELECT cust AS pol, count(*) AS own, CAST(sum(CASE WHEN total > 300000 THEN 1 ELSE 0 END) AS BIGINT) AS cases FROM contract GROUP BY cust), au AS (SELECT pol, count(*) AS audits FROM audit_title JOIN politician ON contains(lower(title), lower(name)) GROUP BY pol), px AS (SELECT p.pol, least(10 * coalesce(directed, 0), 35) AS contracts, least(8 * coalesce(own, 0), 25) AS own, least(10 * coalesce(audits, 0), 20) AS audit, CASE WHEN regexp_matches(CAST(assets AS VARCHAR), '[0-9]') THEN 5 ELSE 0 END AS assets, least(3 * coalesce(cases, 0), 5) AS cases FROM politician p LEFT JOIN d USING (pol) LEFT JOIN o USING (pol) LEFT JOIN au USING (pol)), ps AS (SELECT *, contracts + own + audit + assets + cases AS s FROM px)"""


@query("dt01_risk_score", _PERSON + """ SELECT pol, CAST(least(s, 100) AS BIGINT) AS score, CASE WHEN s <= 30 THEN 'LOW' WHEN s <= 60 THEN 'MODERATE' WHEN s <= 80 THEN 'HIGH' ELSE 'VERY_HIGH' END AS level FROM ps""")
def risk_score(t: Tables) -> DataFrame:
    """Five indicators, each capped, summed: directed companies' contracts, own ones, audits that name the person, declared assets, cases."""
    x = _risk_parts(t).join(named_in_audits(t.politician.select(F.col("pol").alias("id"), "name"), t).withColumnRenamed("id", "pol"), "pol", "left")
    audits = F.least(10 * F.coalesce("audits", F.lit(0)), F.lit(20))
    raw = F.least(10 * F.col("directed"), F.lit(35)) + F.least(8 * F.col("own"), F.lit(25)) + audits + F.when(F.col("assets").cast("string").rlike("[0-9]"), 5).otherwise(0) + F.least(3 * F.col("cases"), F.lit(5))
    return x.select("pol", F.least(raw, F.lit(100)).cast("long").alias("score")).withColumn("level", level(F.col("score")))


@query("dt03_batch_ranking", _PERSON + """, ca AS (SELECT comp, count(*) AS audits FROM audit_title JOIN company ON contains(lower(title), lower(name)) GROUP BY comp), b AS (SELECT 'person' AS kind, pol AS id, least(s, 100) AS score FROM ps UNION ALL SELECT 'company', comp, least(8 * coalesce(n, 0), 25) + least(10 * coalesce(audits, 0), 20) FROM company LEFT JOIN won_n USING (comp) LEFT JOIN ca USING (comp)) SELECT kind, id, CAST(score AS BIGINT) AS score, CAST(row_number() OVER (PARTITION BY kind ORDER BY score DESC, id) AS INTEGER) AS place FROM b QUALIFY row_number() OVER (PARTITION BY kind ORDER BY score DESC, id) <= 50""")
def batch_ranking(t: Tables, most: int = 50) -> DataFrame:
    """The people and the companies of the highest risk scores; a company's indicators are its own contracts and the audits that name it."""
    people = risk_score(t).select(F.lit("person").alias("kind"), F.col("pol").alias("id"), "score")
    won = t.won.groupBy(F.col("comp").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    names = t.company.select(F.col("comp").alias("id"), "name")
    x = names.join(won, "id", "left").join(named_in_audits(names, t), "id", "left")
    score = F.least(8 * F.coalesce("n", F.lit(0)), F.lit(25)) + F.least(10 * F.coalesce("audits", F.lit(0)), F.lit(20))
    ranked = people.union(x.select(F.lit("company"), "id", score.cast("long")))
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.col("score").desc(), "id"))
    return ranked.withColumn("place", place).filter(F.col("place") <= most)


@query("dt05_shadow_director", """, ad AS (SELECT comp, CASE WHEN comp % 2 = 0 THEN ' ' || upper(state) ELSE state END || ' road ' || comp // 7 % 2 AS address FROM company), a AS (SELECT lower(trim(address)) AS address, count(*) AS n FROM ad GROUP BY 1 HAVING count(*) >= 3), m AS (SELECT pol, count(*) AS n FROM director GROUP BY pol HAVING count(*) >= 10) SELECT 'address' AS kind, address AS id, n FROM a UNION ALL SELECT 'person', CAST(pol AS VARCHAR), n FROM m""")
def shadow_director(t: Tables, shared: int = 3, seats: int = 10) -> DataFrame:
    """Addresses, but for case and margins, of three companies and more; people of ten directorships and more. The tables have no addresses: they are put together from state and number."""
    address = F.concat(F.when(F.col("comp") % 2 == 0, F.concat(F.lit(" "), F.upper("state"))).otherwise(F.col("state")), F.lit(" road "), F.expr("comp div 7 % 2").cast("string"))
    a = t.company.select(F.lower(F.trim(address)).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= shared)
    people = t.director.groupBy("pol").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= seats)
    return a.select(F.lit("address").alias("kind"), "id", "n").union(people.select(F.lit("person"), F.col("pol").cast("string"), "n"))


@query("dt07_benford", """, d AS (SELECT CAST(left(ltrim(replace(printf('%.2f', o_totalprice), '.', ''), '0'), 1) AS INTEGER) AS digit FROM orders WHERE o_totalprice >= 1), n AS (SELECT count(*) AS n FROM d), x AS (SELECT g.digit, (SELECT count(*) FROM d WHERE d.digit = g.digit) AS observed, n * log10(1 + 1.0 / g.digit) AS expected, n FROM (SELECT unnest(generate_series(1, 9)) AS digit) g, n) SELECT CAST(digit AS INTEGER) AS digit, observed, round(expected, 4) AS expected, round(sum((observed - expected) ** 2 / expected) OVER (), 4) AS chi_squared, abs(observed / n - expected / n) > 0.05 AS deviates FROM x""")
def benford(t: Tables) -> DataFrame:
    """Leading digits against Benford's law; the significant digit is that of the value itself, so 0.045 would give 4."""
    v = t.raw("orders").filter("o_totalprice >= 1").select(F.substring(F.ltrim(F.translate(F.format_string("%.2f", "o_totalprice"), ".", ""), F.lit("0")), 1, 1).cast("int").alias("digit"))
    seen = v.groupBy("digit").agg(F.count(F.lit(1)).alias("observed"))
    law = t.spark.range(1, 10).select(F.col("id").cast("int").alias("digit"), F.log10(1 + 1.0 / F.col("id")).alias("p"))
    x = law.join(seen, "digit", "left").withColumn("observed", F.coalesce("observed", F.lit(0)))
    all_ = Window.partitionBy()
    x = x.withColumn("n", F.sum("observed").over(all_)).withColumn("expected", F.col("n") * F.col("p"))
    return x.select("digit", "observed", F.round("expected", 4).alias("expected"), F.round(F.sum((F.col("observed") - F.col("expected")) ** 2 / F.col("expected")).over(all_), 4).alias("chi_squared"), (F.abs(F.col("observed") / F.col("n") - F.col("p")) > 0.05).alias("deviates"))


def _yearly(t: Tables) -> DataFrame:
    return t.contract.groupBy(F.col("cust").alias("pol"), F.year("day").alias("year")).agg(F.sum("total").alias("assets"))


YEARLY = "yearly AS (SELECT cust AS pol, year(day) AS year, sum(total) AS assets FROM contract GROUP BY 1, 2)"


@query("wn02_surge", f""", {YEARLY} SELECT pol, year, round(assets / prev, 4) AS ratio FROM (SELECT *, lag(assets) OVER (PARTITION BY pol ORDER BY year) AS prev FROM yearly) WHERE prev > 0 AND assets / prev > 1.5""")
def surge(t: Tables, ratio: float = 1.5) -> DataFrame:
    x = _yearly(t).withColumn("prev", F.lag("assets").over(Window.partitionBy("pol").orderBy("year")))
    return x.filter((F.col("prev") > 0) & (F.col("assets") / F.col("prev") > ratio)).select("pol", "year", F.round(F.col("assets") / F.col("prev"), 4).alias("ratio"))


@query("wn03_first_last", f""", {YEARLY} SELECT pol, round(min_by(assets, year), 2) AS first_assets, round(max_by(assets, year), 2) AS last_assets, CAST(max(year) - min(year) AS INTEGER) AS years FROM yearly GROUP BY pol""")
def first_last(t: Tables) -> DataFrame:
    return _yearly(t).groupBy("pol").agg(F.round(F.min_by("assets", "year"), 2).alias("first_assets"), F.round(F.max_by("assets", "year"), 2).alias("last_assets"), (F.max("year") - F.min("year")).alias("years"))


#: Fixed values of the filter: process and measurement noise, first variance.
KALMAN_Q, KALMAN_R, KALMAN_P = 0.001, 0.01, 1.0


@query("wn01_kalman", f""", {YEARLY}, s AS (SELECT pol, year, assets / 100000.0 AS z, row_number() OVER (PARTITION BY pol ORDER BY year) AS k FROM yearly), r AS (SELECT pol, k, z AS x, 1.0::DOUBLE AS p, 0.0::DOUBLE AS residual FROM s WHERE k = 1 UNION ALL SELECT s.pol, s.k, r.x + (r.p + 0.001) / (r.p + 0.001 + 0.01) * (s.z - r.x), (1 - (r.p + 0.001) / (r.p + 0.001 + 0.01)) * (r.p + 0.001), greatest(r.residual, abs(s.z - r.x)) FROM r JOIN s ON s.pol = r.pol AND s.k = r.k + 1) SELECT pol, round(max_by(x, k), 5) AS state, round(max(residual), 5) AS residual FROM r GROUP BY pol""")
def kalman(t: Tables) -> DataFrame:
    """A scalar Kalman filter folded over each person's ordered series by aggregate()."""
    series = _yearly(t).groupBy("pol").agg(F.sort_array(F.collect_list(F.struct("year", (F.col("assets") / 100_000.0).alias("z")))).alias("s"))
    start = F.struct(F.get("s", F.lit(0))["z"].alias("x"), F.lit(KALMAN_P).alias("p"), F.lit(0.0).alias("residual"))

    def step(a: Column, o: Column) -> Column:
        p = a["p"] + KALMAN_Q
        gain = p / (p + KALMAN_R)
        return F.struct((a["x"] + gain * (o["z"] - a["x"])).alias("x"), ((1 - gain) * p).alias("p"), F.greatest(a["residual"], F.abs(o["z"] - a["x"])).alias("residual"))

    end = F.aggregate(F.slice("s", F.lit(2), F.size("s")), start, step)
    return series.select("pol", end.alias("e")).select("pol", F.round("e.x", 5).alias("state"), F.round("e.residual", 5).alias("residual"))


@query("dt12_cartel_rotation", """, v AS (SELECT a.ministry, w.comp, count(*) AS n FROM won w JOIN awarded a USING (contract) GROUP BY 1, 2), s AS (SELECT ministry, comp, n / sum(n) OVER (PARTITION BY ministry) AS share, count(*) OVER (PARTITION BY ministry) AS vendors FROM v) SELECT ministry, vendors, round(greatest(0, 1 - 10 * vendors * avg((share - 1.0 / vendors) ** 2)), 6) AS rotation FROM s WHERE vendors >= 3 GROUP BY ministry, vendors""")
def cartel_rotation(t: Tables) -> DataFrame:
    w = Window.partitionBy("ministry")
    v = t.won.join(t.awarded, "contract").groupBy("ministry", "comp").agg(F.count(F.lit(1)).alias("n"))
    s = v.select("ministry", (F.col("n") / F.sum("n").over(w)).alias("share"), F.count(F.lit(1)).over(w).alias("vendors")).filter("vendors >= 3")
    return s.groupBy("ministry", "vendors").agg(F.round(F.greatest(F.lit(0.0), 1 - 10 * F.first("vendors") * F.avg((F.col("share") - 1 / F.col("vendors")) ** 2)), 6).alias("rotation"))


@query("dt16_event_study", """, e AS (SELECT pol, ts, value, kind FROM event) SELECT p.pol, CAST(sum(CASE WHEN date_diff('day', CAST(p.ts AS DATE), CAST(q.ts AS DATE)) BETWEEN -5 AND -1 THEN 1 ELSE 0 END) AS BIGINT) AS before, CAST(sum(CASE WHEN date_diff('day', CAST(p.ts AS DATE), CAST(q.ts AS DATE)) BETWEEN 0 AND 5 THEN 1 ELSE 0 END) AS BIGINT) AS after FROM e p JOIN e q ON p.pol = q.pol AND p.kind = 'signup' AND q.kind = 'purchase' GROUP BY p.pol""")
def event_study(t: Tables, days: int = 5) -> DataFrame:
    """Purchases in the days before and after a person's signups; each signup meets the days of its window only."""
    p = t.event.filter("kind = 'signup'").groupBy("pol", F.to_date("ts").alias("p")).agg(F.count(F.lit(1)).alias("m"))
    q = t.event.filter("kind = 'purchase'").groupBy("pol", F.to_date("ts").alias("q")).agg(F.count(F.lit(1)).alias("n"))
    near = p.select("pol", "m", F.explode(F.sequence(F.lit(-days), F.lit(days))).alias("gap"), "p").select("pol", "m", "gap", F.date_add("p", F.col("gap")).alias("q")).join(q, ["pol", "q"])
    seen = near.groupBy("pol").agg(*(F.sum(F.when(side, F.col("m") * F.col("n")).otherwise(0)).alias(name) for name, side in (("before", F.col("gap") < 0), ("after", F.col("gap") >= 0))))
    both = p.select("pol").distinct().join(q.select("pol"), "pol", "left_semi")
    return both.join(seen, "pol", "left").select("pol", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))


@query("dt17_fourier", """, s AS (SELECT cust AS pol, total / 1000.0 AS v, row_number() OVER (PARTITION BY cust ORDER BY day, contract) - 1 AS i, count(*) OVER (PARTITION BY cust) AS n, avg(total / 1000.0) OVER (PARTITION BY cust) AS m FROM contract), f AS (SELECT pol, k, n, sum((v - m) * cos(2 * pi() * k * i / n)) AS re, sum((v - m) * sin(2 * pi() * k * i / n)) AS im FROM s, LATERAL (SELECT unnest(generate_series(1, n // 2)) AS k) WHERE n >= 4 GROUP BY pol, k, n), w AS (SELECT pol, k, n, re * re + im * im AS power FROM f) SELECT pol, round(max(power) / sum(power), 4) AS share FROM w GROUP BY pol""")
def fourier(t: Tables, least: int = 4) -> DataFrame:
    """Share of the strongest frequency in a person's ordered contract series; the transform is a group sum over (person, frequency)."""
    own = Window.partitionBy("cust")
    s = t.contract.select(F.col("cust").alias("pol"), (F.col("total") / 1000.0).alias("v"), (F.row_number().over(own.orderBy("day", "contract")) - 1).alias("i"), F.count(F.lit(1)).over(own).alias("n"), F.avg(F.col("total") / 1000.0).over(own).alias("m")).filter(F.col("n") >= least)
    x = s.withColumn("k", F.explode(F.sequence(F.lit(1), F.floor(F.col("n") / 2))))
    angle = 2 * math.pi * F.col("k") * F.col("i") / F.col("n")
    f = x.groupBy("pol", "k").agg(F.sum((F.col("v") - F.col("m")) * F.cos(angle)).alias("re"), F.sum((F.col("v") - F.col("m")) * F.sin(angle)).alias("im"))
    return f.select("pol", (F.col("re") ** 2 + F.col("im") ** 2).alias("power")).groupBy("pol").agg(F.round(F.max("power") / F.sum("power"), 4).alias("share"))


#: Pairs of event kinds that converge within so many days.
RULES = (("signup", "purchase", 3), ("click", "purchase", 1), ("view", "error", 1))


@query("dt19_convergence", """, r AS (SELECT * FROM (VALUES ('signup', 'purchase', 3), ('click', 'purchase', 1), ('view', 'error', 1)) v(a, b, w)), d AS (SELECT DISTINCT pol, kind, CAST(ts AS DATE) AS day FROM event) SELECT x.pol, r.a, r.b, x.day AS day, CAST(date_diff('day', x.day, y.day) AS INTEGER) AS gap, CASE WHEN date_diff('day', x.day, y.day) <= r.w // 3 THEN 'HIGH' WHEN date_diff('day', x.day, y.day) <= r.w // 2 THEN 'MODERATE' ELSE 'LOW' END AS severity FROM r JOIN d x ON x.kind = r.a JOIN d y ON y.kind = r.b AND y.pol = x.pol AND date_diff('day', x.day, y.day) BETWEEN 0 AND r.w""")
def convergence(t: Tables) -> DataFrame:
    """A band join of typed events: the rules (a fixed handful) are broadcast, the events meet by person and by day buckets, so each meets only its window."""
    rules = F.broadcast(t.spark.createDataFrame(list(RULES), "a string, b string, w int"))
    d = t.event.select("pol", "kind", F.to_date("ts").alias("day")).distinct()
    x = d.withColumnRenamed("kind", "a").join(rules, "a").withColumn("next", F.explode(F.expr("sequence(day, date_add(day, w))")))
    y = d.select("pol", F.col("kind").alias("b"), F.col("day").alias("next"))
    gap = F.datediff("next", "day")
    severity = F.when(gap <= F.floor(F.col("w") / 3), "HIGH").when(gap <= F.floor(F.col("w") / 2), "MODERATE").otherwise("LOW")
    return x.join(y, ["pol", "b", "next"]).select("pol", "a", "b", "day", gap.alias("gap"), severity.alias("severity"))


@query("dt20_timeline", """SELECT pol, 'order' AS source, CAST(day AS VARCHAR) AS at, buyer AS title FROM (SELECT cust AS pol, day, buyer FROM contract) UNION ALL SELECT pol, 'event', CAST(CAST(ts AS DATE) AS VARCHAR), kind FROM event""")
def timeline(t: Tables) -> DataFrame:
    return t.contract.select(F.col("cust").alias("pol"), F.lit("order").alias("source"), F.col("day").cast("string").alias("at"), F.col("buyer").alias("title")).union(t.event.select("pol", F.lit("event"), F.to_date("ts").cast("string"), "kind"))


@query("dt33_report_hash", """SELECT pol, sha256(CAST(pol AS VARCHAR) || '|' || name || '|' || party) AS hash FROM politician""")
def report_hash(t: Tables) -> DataFrame:
    return t.politician.select("pol", F.sha2(F.concat_ws("|", F.col("pol").cast("string"), "name", "party"), 256).alias("hash"))


#: Hashes that one node of a day's tree takes; three levels hold a billion entries a day.
FAN, LEVELS_OF_TREE = 1_024, 3


@query("dt34_audit_roots", f""", l0 AS (SELECT CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS k, sha256(CAST(event_id AS VARCHAR) || kind) AS h FROM event){''.join(f", l{i + 1} AS (SELECT day, k // {FAN} AS k, sha256(string_agg(h, '|' ORDER BY k)) AS h FROM l{i} GROUP BY 1, 2)" for i in range(LEVELS_OF_TREE))} SELECT day, h AS root FROM l{LEVELS_OF_TREE}""")
def audit_roots(t: Tables) -> DataFrame:
    """The root of each day's hash tree over its entries in order: a node hashes up to FAN hashes, so no row holds a busy day."""
    place = F.row_number().over(Window.partitionBy("day").orderBy("ts", "event_id")) - 1
    h = t.event.select(F.to_date("ts").alias("day"), "ts", "event_id", F.sha2(F.concat(F.col("event_id").cast("string"), "kind"), 256).alias("h")).withColumn("k", place.cast("long"))
    for _ in range(LEVELS_OF_TREE):
        node = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), "|"), 256)
        h = h.groupBy("day", F.expr(f"k div {FAN}").alias("_up")).agg(node.alias("h")).withColumnRenamed("_up", "k")
    return h.select("day", F.col("h").alias("root"))


@query("wn10_rate_limit", """SELECT event_id, count(*) OVER (PARTITION BY pol ORDER BY epoch(ts) RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS n FROM (SELECT event_id, pol, CAST(date_trunc('second', ts) AS TIMESTAMP) AS ts FROM event)""")
def rate_limit(t: Tables, seconds: int = 3600) -> DataFrame:
    w = Window.partitionBy("pol").orderBy("s").rangeBetween(-(seconds - 1), 0)
    return t.event.select("event_id", "pol", F.unix_timestamp("ts").alias("s")).select("event_id", F.count(F.lit(1)).over(w).alias("n"))


@query("wn07_znormalise", """SELECT doc_id, round((n_chars - avg(n_chars) OVER ()) / stddev_pop(n_chars) OVER (), 5) AS z FROM documents""")
def znormalise(t: Tables) -> DataFrame:
    d = t.raw("documents")
    stats = F.broadcast(d.agg(F.avg("n_chars").alias("m"), F.stddev_pop("n_chars").alias("s")))
    return d.crossJoin(stats).select("doc_id", F.round((F.col("n_chars") - F.col("m")) / F.col("s"), 5).alias("z"))


@query("dt30_schema_drift", """SELECT k AS field, count(*) AS n, min(event_id) AS sample FROM (SELECT event_id, unnest(json_keys(props)) AS k FROM events) GROUP BY k""")
def schema_drift(t: Tables, known: tuple[str, ...] = ()) -> DataFrame:
    keys = t.raw("events").select("event_id", F.explode(F.json_object_keys("props")).alias("field"))
    return keys.filter(~F.col("field").isin(*known) if known else F.lit(True)).groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("sample"))


@query("dt32_similar_cases", """, k AS (SELECT DISTINCT pol, kind FROM event), q AS (SELECT kind FROM k WHERE pol = (SELECT min(pol) FROM event)) SELECT pol, count(*) AS overlap FROM k JOIN q USING (kind) GROUP BY pol ORDER BY overlap DESC, pol LIMIT 10""")
def similar_cases(t: Tables) -> DataFrame:
    k = t.event.select("pol", "kind").distinct()
    least = t.event.agg(F.min("pol").alias("pol"))
    q = k.join(least, "pol", "left_semi").select("kind")
    return k.join(q, "kind").groupBy("pol").agg(F.count(F.lit(1)).alias("overlap")).orderBy(F.col("overlap").desc(), "pol").limit(10)
