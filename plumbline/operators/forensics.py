"""Forensic detectors with their full rules, over all entities at once.

Self-joins by a person's or company's group are replaced by counts per group less the own row, or by windows; band joins meet in
buckets of the band's width."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import cosine_pairs, jaccard, skip_bigrams, similar_pairs, word_shares, FUNCTION_WORDS, SKIP_SQL
from plumbline.operators.graph import settle
from plumbline.operators.library import topic_words, sections_of
from plumbline.plans.registry import query
from plumbline.plans.tables import Tables

#: Weights of the factors of hidden ownership.
BENAMI_WEIGHTS = {"director_age": 0.25, "surname_network": 0.25, "address_cluster": 0.20, "company_age": 0.20, "single_director": 0.10}
YOUNG = 25


def director_facts(t: Tables) -> DataFrame:
    """pol, comp, nk of the company, surname and whether the person is young, for each directorship."""
    who = t.politician.select("pol", F.substring("name", -1, 1).alias("surname"), (20 + F.col("pol") % 60 < YOUNG).cast("int").alias("young"))
    return t.director.join(who, "pol").join(t.company.select("comp", "nk"), "comp")


def first_contracts(t: Tables) -> DataFrame:
    """comp, registered (first shipping day of its line items) and first_day (of its first contract)."""
    first = t.won.join(t.contract, "contract").groupBy("comp").agg(F.min("day").alias("first_day"))
    registered = t.raw("lineitem").groupBy(F.col("l_suppkey").alias("comp")).agg(F.min(F.to_date("l_shipdate")).alias("registered"))
    return first.join(registered, "comp")


_FACTS = """, df AS (SELECT d.pol, d.comp, c.nk, right(p.name, 1) AS surname, CASE WHEN 20 + p.pol % 60 < 25 THEN 1 ELSE 0 END AS young FROM director d JOIN politician p USING (pol) JOIN company c USING (comp)), fc AS (SELECT comp, min(day) AS first_day FROM won JOIN contract USING (contract) GROUP BY comp), rg AS (SELECT l_suppkey AS comp, min(CAST(l_shipdate AS DATE)) AS registered FROM lineitem GROUP BY 1)"""


@query("dt09_benami", _FACTS + """, pr AS (SELECT a.pol, sum(b.young) AS young, sum(CASE WHEN a.surname = b.surname THEN 1 ELSE 0 END) AS same FROM df a JOIN df b ON a.comp = b.comp AND a.pol <> b.pol GROUP BY a.pol), ad AS (SELECT pol, max(n) AS most FROM (SELECT pol, nk, count(*) AS n FROM df GROUP BY 1, 2) GROUP BY pol), ag AS (SELECT df.pol, count(*) AS n FROM df JOIN fc USING (comp) JOIN rg USING (comp) WHERE date_diff('day', registered, first_day) BETWEEN 0 AND 179 GROUP BY 1), sg AS (SELECT pol, count(*) AS n FROM df WHERE comp IN (SELECT comp FROM df GROUP BY comp HAVING count(*) = 1) GROUP BY 1), sc AS (SELECT ad.pol, 100 * (0.25 * least(1, 0.3 * coalesce(young, 0)) + 0.25 * least(1, 0.2 * coalesce(same, 0)) + 0.20 * least(1, CASE WHEN most >= 3 THEN (most - 2) * 0.2 ELSE 0 END) + 0.20 * least(1, 0.35 * coalesce(ag.n, 0)) + 0.10 * least(1, 0.25 * coalesce(sg.n, 0))) AS s FROM ad LEFT JOIN pr USING (pol) LEFT JOIN ag USING (pol) LEFT JOIN sg USING (pol)) SELECT pol, round(CAST(s AS DOUBLE), 1) AS score, CASE WHEN s >= 65 THEN 'HIGH' WHEN s >= 40 THEN 'MODERATE' ELSE 'LOW' END AS level FROM sc""")
def benami(t: Tables) -> DataFrame:
    """Five factors of hidden ownership, weighed: young co-directors, shared surnames, one address, young companies, sole directors."""
    d = director_facts(t)
    # co-directors are counted per company, less the person's own row
    whole, kin = Window.partitionBy("comp"), Window.partitionBy("comp", "surname")
    young, fellows, same = F.sum("young").over(whole) - F.col("young"), F.count(F.lit(1)).over(whole), F.count(F.lit(1)).over(kin) - 1
    gap = F.datediff("first_day", "registered")
    each = d.withColumns({"_young": young, "_n": fellows, "_same": same}).join(first_contracts(t), "comp", "left")
    zero = F.lit(0)
    n = each.groupBy("pol").agg(F.sum("_young").alias("y"), F.sum("_same").alias("s"), F.count(F.when(gap.between(0, 179), 1)).alias("c"), F.count(F.when(F.col("_n") == 1, 1)).alias("g"))
    address = d.groupBy("pol", "nk").agg(F.count(F.lit(1)).alias("n")).groupBy("pol").agg(F.max("n").alias("most"))
    one = F.lit(1.0)
    factors = {
        "director_age": F.least(one, 0.3 * F.col("y")),
        "surname_network": F.least(one, 0.2 * F.col("s")),
        "address_cluster": F.least(one, F.when(F.col("most") >= 3, (F.col("most") - 2) * 0.2).otherwise(zero)),
        "company_age": F.least(one, 0.35 * F.col("c")),
        "single_director": F.least(one, 0.25 * F.col("g")),
    }
    score = 100 * sum((w * factors[k] for k, w in BENAMI_WEIGHTS.items()), F.lit(0.0))
    x = n.join(address, "pol").select("pol", score.alias("s"))
    return x.select("pol", F.round("s", 1).alias("score"), F.when(F.col("s") >= 65, "HIGH").when(F.col("s") >= 40, "MODERATE").otherwise("LOW").alias("level"))


_GHOST = """, gn AS (SELECT comp, count(*) AS n, sum(amount) AS value FROM won GROUP BY comp), gd AS (SELECT comp, count(*) AS directors FROM director GROUP BY comp), au AS (SELECT DISTINCT doc_id // 2 AS named FROM documents JOIN labels USING (doc_id)), gs AS (SELECT k.comp, (CASE WHEN date_diff('day', registered, first_day) BETWEEN 0 AND 90 THEN 30 ELSE 0 END) + (CASE WHEN k.comp IN (SELECT named FROM au) THEN 0 ELSE 20 END) + (CASE WHEN coalesce(directors, 1) = 1 THEN 20 ELSE 0 END) + (CASE WHEN value > 10 * capital THEN 20 ELSE 0 END) + (CASE WHEN n = 1 THEN 10 ELSE 0 END) AS s FROM company k LEFT JOIN fc USING (comp) LEFT JOIN rg USING (comp) LEFT JOIN gd USING (comp) LEFT JOIN gn USING (comp))"""


def audit_mentions(t: Tables) -> DataFrame:
    """named and n: how many audit reports hold each number as a word of their title."""
    titles = t.raw("documents").join(t.raw("labels").select("doc_id"), "doc_id").selectExpr("'report ' || (doc_id div 2) title")
    return titles.select(F.explode(F.split("title", " ")).alias("w")).select(F.col("w").try_cast("long").alias("named")).filter("named is not null").groupBy("named").agg(F.count(F.lit(1)).alias("n"))


def ghost_scores(t: Tables) -> DataFrame:
    won = t.won.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("value"))
    directors = t.director.groupBy("comp").agg(F.count(F.lit(1)).alias("directors"))
    named = audit_mentions(t).select(F.col("named").alias("comp"), F.lit(True).alias("audited"))
    x = t.company.join(first_contracts(t), "comp", "left").join(directors, "comp", "left").join(won, "comp", "left").join(named, "comp", "left")
    points = lambda c, n: F.when(c, n).otherwise(0)
    gap = F.datediff("first_day", "registered")
    score = points(gap.between(0, 90), 30) + points(F.col("audited").isNull(), 20) + points(F.coalesce("directors", F.lit(1)) == 1, 20) + points(F.col("value") > 10 * F.col("capital"), 20) + points(F.col("n") == 1, 10)
    return x.select("comp", score.alias("score"))


@query("dt04_ghost_company", _FACTS + _GHOST + """ SELECT comp, CAST(s AS INTEGER) AS score, s >= 60 AS flagged FROM gs""")
def ghost_company(t: Tables) -> DataFrame:
    """Contract soon after registration, no audit that names it, a sole director, value far above capital, a single contract."""
    return ghost_scores(t).withColumn("flagged", F.col("score") >= 60)


#: Benford's chi-square at 8 degrees of freedom, as the routes round it.
CHI = 15.5


@query("dt02_route_risk", _FACTS + _GHOST + """, dr AS (SELECT pol, sum(gn.n) AS n, count(*) AS boards, sum(CASE WHEN gs.s >= 70 THEN 1 ELSE 0 END) AS ghosts FROM director LEFT JOIN gn USING (comp) LEFT JOIN gs USING (comp) GROUP BY pol), rp AS (SELECT pol, count(*) AS n FROM (SELECT cust AS pol, buyer, count(*) AS n FROM contract GROUP BY 1, 2) WHERE n >= 2 GROUP BY pol), am AS (SELECT doc_id // 2 AS pol, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1), cs AS (SELECT pol, count(*) AS n FROM event WHERE kind = 'error' GROUP BY pol), dg AS (SELECT cust AS pol, CAST(left(CAST(CAST(floor(total) AS BIGINT) AS VARCHAR), 1) AS INTEGER) AS digit FROM contract WHERE total >= 1), dn AS (SELECT pol, count(*) AS n FROM dg GROUP BY pol HAVING count(*) >= 20), ch AS (SELECT pol, sum((o - e) ** 2 / e) AS chi FROM (SELECT dn.pol, g.digit, dn.n * log10(1 + 1.0 / g.digit) AS e, (SELECT count(*) FROM dg WHERE dg.pol = dn.pol AND dg.digit = g.digit) AS o FROM dn, (SELECT unnest(generate_series(1, 9)) AS digit) g) GROUP BY pol), tt AS (SELECT p.pol, least(10 * coalesce(dr.n, 0), 35) + least(8 * coalesce(rp.n, 0), 25) + least(10 * coalesce(am.n, 0), 20) + least(3 * coalesce(cs.n, 0), 5) + CASE WHEN chi > 15.5 THEN least(chi / 2, 20) ELSE 0 END + least(12 * coalesce(ghosts, 0), 24) + CASE WHEN boards >= 10 THEN least(2 * boards, 15) ELSE 0 END AS s FROM politician p LEFT JOIN dr USING (pol) LEFT JOIN rp USING (pol) LEFT JOIN am USING (pol) LEFT JOIN cs USING (pol) LEFT JOIN ch USING (pol)) SELECT pol, round(least(CAST(s AS DOUBLE), 100), 2) AS score, CASE WHEN s = 0 THEN 'NONE' WHEN s <= 30 THEN 'LOW' WHEN s <= 60 THEN 'MODERATE' WHEN s <= 80 THEN 'HIGH' ELSE 'VERY_HIGH' END AS level FROM tt""")
def route_risk(t: Tables) -> DataFrame:
    """Contracts of directed companies, repeated buyers, audits, cases, digits, ghosts and directorships, each capped."""
    won = t.won.groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
    ghosts = ghost_scores(t).select("comp", (F.col("score") >= 70).cast("int").alias("ghost"))
    directed = t.director.join(won, "comp", "left").join(ghosts, "comp", "left").groupBy("pol").agg(F.sum("n").alias("directed"), F.count(F.lit(1)).alias("boards"), F.sum("ghost").alias("ghosts"))
    repeats = t.contract.groupBy(F.col("cust").alias("pol"), "buyer").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").groupBy("pol").agg(F.count(F.lit(1)).alias("repeats"))
    audits = audit_mentions(t).select(F.col("named").alias("pol"), F.col("n").alias("audits"))
    cases = t.event.filter("kind = 'error'").groupBy("pol").agg(F.count(F.lit(1)).alias("cases"))
    digit = F.substring(F.floor("total").cast("string"), 1, 1).cast("int")
    digits = t.contract.filter("total >= 1").groupBy(F.col("cust").alias("pol")).agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(digit == k, 1)).alias(f"d{k}") for k in range(1, 10)]).filter("n >= 20")
    share = {k: F.col("n") * F.log10(F.lit(1 + 1.0 / k)) for k in range(1, 10)}
    chi = digits.select("pol", sum(((F.col(f"d{k}") - share[k]) ** 2 / share[k] for k in range(2, 10)), (F.col("d1") - share[1]) ** 2 / share[1]).alias("chi"))
    x = t.politician.select("pol")
    for part in (directed, repeats, audits, cases, chi):
        x = x.join(part, "pol", "left")
    capped = lambda c, k, most: F.least(k * F.coalesce(c, F.lit(0)), F.lit(most))
    score = capped("directed", 10, 35) + capped("repeats", 8, 25) + capped("audits", 10, 20) + capped("cases", 3, 5) + capped("ghosts", 12, 24)
    score = score + F.when(F.col("chi") > CHI, F.least(F.col("chi") / 2, F.lit(20.0))).otherwise(0.0) + F.when(F.col("boards") >= 10, capped("boards", 2, 15)).otherwise(0)
    s = x.select("pol", score.cast("double").alias("s"))
    level = F.when(F.col("s") == 0, "NONE").when(F.col("s") <= 30, "LOW").when(F.col("s") <= 60, "MODERATE").when(F.col("s") <= 80, "HIGH").otherwise("VERY_HIGH")
    return s.select("pol", F.round(F.least("s", F.lit(100.0)), 2).alias("score"), level.alias("level"))


@query("dt08_shadow_draft")
def shadow_draft(t: Tables, flagged: float = 39.0, size: int = 500) -> DataFrame:
    """Submissions (benchmark texts) whose sections recur in bills (documents): per section the best Jaccard per cent, the mean of a pair's five best, and whether it passes `flagged`.

    A pair can pass only if one of its sections does, so these pairs are found first; then all their sections count, also those below."""
    part = lambda df, key: df.select(F.col(key).cast("string").alias("k"), F.posexplode(sections_of(F.col("text"), size)).alias("s", "x")).select(F.concat_ws(":", "k", F.col("s").cast("string")).alias("id"), topic_words(F.col("x")).alias("words")).filter(F.size("words") > 0)
    # dealt anew, as a file may be few row groups, and cut into sections once, not once for each of the reads below
    bills = t.raw("documents").select("doc_id", "text").repartition("doc_id")
    ours, theirs = settle(part(t.raw("benchmark"), "item_id")), settle(part(bills, "doc_id"))
    of = lambda c: F.split(c, ":")[0].cast("long")
    met = settle(similar_pairs(ours, flagged / 100, theirs).select(of("a").alias("item_id"), of("b").alias("doc_id")).distinct())
    each = met.join(ours.select(of("id").alias("item_id"), F.col("id").alias("section"), F.col("words").alias("_a")), "item_id").join(theirs.select(of("id").alias("doc_id"), F.col("words").alias("_b")), "doc_id")
    best = each.groupBy("item_id", "doc_id", "section").agg(F.max(jaccard(F.col("_a"), F.col("_b"))).alias("best"))
    ranked = best.withColumn("k", F.row_number().over(Window.partitionBy("item_id", "doc_id").orderBy(F.col("best").desc(), "section"))).filter("k <= 5")
    score = F.round(100 * F.avg("best"), 4)
    return ranked.groupBy("item_id", "doc_id").agg(score.alias("score")).withColumn("flagged", F.col("score") >= flagged)


@query("dt10_affidavit", """, y AS (SELECT cust AS pol, year(day) AS year, sum(total) AS assets FROM contract GROUP BY 1, 2), s AS (SELECT pol, year, assets / 100000.0 AS z, row_number() OVER (PARTITION BY pol ORDER BY year) AS k FROM y), r AS (SELECT pol, k, z AS x, 1.0::DOUBLE AS p, 0 AS alerts, 0.0::DOUBLE AS worst FROM s WHERE k = 1 UNION ALL SELECT s.pol, s.k, r.x + (r.p + 0.001) / (r.p + 0.011) * (s.z - r.x), (1 - (r.p + 0.001) / (r.p + 0.011)) * (r.p + 0.001), r.alerts + CASE WHEN abs(s.z - r.x) > 3 * sqrt(r.p + 0.011) THEN 1 ELSE 0 END, greatest(r.worst, abs(s.z - r.x) / (3 * sqrt(r.p + 0.011))) FROM r JOIN s ON s.pol = r.pol AND s.k = r.k + 1), a AS (SELECT pol, max_by(alerts, k) AS alerts, max(worst) AS worst FROM r GROUP BY pol), g AS (SELECT pol, count(*) AS surges FROM (SELECT *, lag(assets) OVER (PARTITION BY pol ORDER BY year) AS prev FROM y) WHERE prev > 0 AND assets / prev > 1.5 GROUP BY pol), f AS (SELECT pol, min_by(assets, year) AS first, max_by(assets, year) AS last, max(year) - min(year) AS years, count(*) AS n FROM y GROUP BY pol) SELECT pol, CAST(alerts AS INTEGER) AS alerts, CASE WHEN worst > 5 THEN 'VERY_HIGH' WHEN alerts > 0 THEN 'HIGH' ELSE 'LOW' END AS kalman, coalesce(surges, 0) AS surges, CASE WHEN last / (first * power(1.08, years)) > 5 THEN 'VERY_HIGH' WHEN last / (first * power(1.08, years)) > 2 THEN 'HIGH' WHEN last / (first * power(1.08, years)) > 0.5 THEN 'MODERATE' ELSE 'LOW' END AS growth FROM f JOIN a USING (pol) LEFT JOIN g USING (pol) WHERE n >= 2 AND first > 0""")
def affidavit(t: Tables) -> DataFrame:
    """Jumps beyond three standard deviations of a Kalman filter, years of more than half again, and growth against 8 per cent a year."""
    y = t.contract.groupBy(F.col("cust").alias("pol"), F.year("day").alias("year")).agg(F.sum("total").alias("assets"))
    series = y.groupBy("pol").agg(F.sort_array(F.collect_list(F.struct("year", "assets"))).alias("s")).filter(F.size("s") >= 2)
    start = F.struct((F.get("s", F.lit(0))["assets"] / 100_000.0).alias("x"), F.lit(1.0).alias("p"), F.lit(0).alias("alerts"), F.lit(0.0).alias("worst"), F.get("s", F.lit(0))["assets"].alias("prev"), F.lit(0).alias("surges"))

    def step(a: Column, o: Column) -> Column:
        p, z = a["p"] + 0.001, o["assets"] / 100_000.0
        gain, off = p / (p + 0.01), F.abs(o["assets"] / 100_000.0 - a["x"])
        bound = 3 * F.sqrt(p + 0.01)
        surge = (a["prev"] > 0) & (o["assets"] / a["prev"] > 1.5)
        return F.struct((a["x"] + gain * (z - a["x"])).alias("x"), ((1 - gain) * p).alias("p"), (a["alerts"] + (off > bound).cast("int")).alias("alerts"), F.greatest(a["worst"], off / bound).alias("worst"), o["assets"].alias("prev"), (a["surges"] + surge.cast("int")).alias("surges"))

    x = series.select("pol", "s", F.aggregate(F.slice("s", F.lit(2), F.size("s")), start, step).alias("e")).withColumn("first", F.get("s", F.lit(0))).withColumn("last", F.element_at("s", -1)).filter("first.assets > 0")
    ratio = F.col("last.assets") / (F.col("first.assets") * F.pow(F.lit(1.08), F.col("last.year") - F.col("first.year")))
    kalman = F.when(F.col("e.worst") > 5, "VERY_HIGH").when(F.col("e.alerts") > 0, "HIGH").otherwise("LOW")
    return x.select("pol", F.col("e.alerts").alias("alerts"), kalman.alias("kalman"), F.col("e.surges").cast("long").alias("surges"), F.when(ratio > 5, "VERY_HIGH").when(ratio > 2, "HIGH").when(ratio > 0.5, "MODERATE").otherwise("LOW").alias("growth"))


#: Vendors of a block; counters of pairs, and pairs, that a task holds at once.
VENDORS, COUNTERS = 16_384, 4_000_000


def _count_days(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Of one pair of blocks: the pairs of vendors with their common days, counted for some of the first block's vendors at a time."""
    ministry, i, j = (k.as_py() for k in key)
    rows = pa.Table.from_batches(batches)
    days = rows.column("days").combine_chunks()
    n = pc.list_value_length(days).to_numpy(zero_copy_only=False)
    comp, block = (np.repeat(rows.column(c).to_numpy(), n) for c in ("comp", "block"))
    day = pc.list_flatten(days).to_numpy()
    left, right = block == i, block == j
    firsts, x = np.unique(comp[left], return_inverse=True)
    seconds, y = np.unique(comp[right], return_inverse=True)
    by_vendor, by_day = np.argsort(x, kind="stable"), np.argsort(day[right], kind="stable")
    x, on, y, days = x[by_vendor], day[left][by_vendor], y[by_day], day[right][by_day]
    start = np.searchsorted(days, on, "left")
    met = np.searchsorted(days, on, "right") - start
    ends = np.searchsorted(x, np.arange(len(firsts) + 1))
    pairs = np.concatenate([[0], np.cumsum(met)])[ends]
    a = 0
    while a < len(firsts) and len(seconds):
        # one vendor at least
        b = max(a + 1, min(a + COUNTERS // len(seconds), int(np.searchsorted(pairs, pairs[a] + COUNTERS, "right")) - 1, len(firsts)))
        part = slice(ends[a], ends[b])
        n = met[part]
        at = np.repeat(start[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        count = np.bincount(np.repeat((x[part] - a) * len(seconds), n) + y[at], minlength=1)
        often = np.flatnonzero(count >= least)
        u, v, n = firsts[a + often // len(seconds)], seconds[often % len(seconds)], count[often]
        if i == j:
            u, v, n = u[u < v], v[u < v], n[u < v]
        if len(n):
            yield pa.record_batch([pa.repeat(pa.scalar(ministry, pa.string()), len(n)), pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(n.astype("int64"))], ["ministry", "a", "b", "days"])
        a = b


def common_days(d: DataFrame, least: int, vendors: int = VENDORS) -> DataFrame:
    """ministry, a, b and days: the pairs of vendors of d (ministry, comp, day, and n: the ministry's vendors) with so many days in common.

    A ministry's vendors are dealt to blocks of about `vendors`, and each pair of blocks is counted where its rows meet: no pair of vendors
    is shuffled, only the vendors, each one row with all its days, once for each block of their ministry."""

    def count(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _count_days(key, batches, least)

    blocks = F.ceil(F.col("n") / vendors).cast("int")
    x = d.filter("ministry is not null and comp is not null and day is not null").groupBy("ministry", "n", "comp").agg(F.collect_list(F.unix_date("day")).alias("days"))
    x = x.select("ministry", "comp", "days", F.pmod(F.xxhash64("comp"), blocks).cast("int").alias("block"), blocks.alias("k"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    x = x.select("ministry", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.col("comp").cast("long").alias("comp"), "days", "block")
    return x.groupBy("ministry", "i", "j").applyInArrow(count, "ministry string, a long, b long, days long")


@query("dt12_cobid_dates", """, v AS (SELECT a.ministry, count(DISTINCT w.comp) AS vendors FROM won w JOIN awarded a USING (contract) GROUP BY 1 HAVING count(DISTINCT w.comp) >= 3), d AS (SELECT DISTINCT a.ministry, w.comp, c.day FROM won w JOIN contract c USING (contract) JOIN awarded a USING (contract) JOIN v USING (ministry)) SELECT a.ministry, a.comp AS a, b.comp AS b, count(*) AS days FROM d a JOIN d b ON a.ministry = b.ministry AND a.day = b.day AND a.comp < b.comp GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def cobid_dates(t: Tables) -> DataFrame:
    """Vendors of one ministry that win on the same days, twice at least; they meet by ministry and blocks of vendors."""
    d = t.won.join(t.contract.select("contract", "day"), "contract").join(t.awarded, "contract").select("ministry", "comp", "day").distinct()
    vendors = d.groupBy("ministry").agg(F.count_distinct("comp").alias("n")).filter("n >= 3")
    return common_days(d.join(vendors, "ministry"), 2)


@query("dt13_revolving_door", """, e AS (SELECT pol, kind, CAST(ts AS DATE) AS day, count(*) AS n FROM event GROUP BY 1, 2, 3), p AS (SELECT a.pol, a.day AS left_day, min(b.day) AS joined_day FROM e a JOIN e b ON a.pol = b.pol AND a.kind = 'signup' AND b.kind = 'purchase' AND date_diff('day', a.day, b.day) BETWEEN 1 AND 364 GROUP BY 1, 2), x AS (SELECT p.pol, p.left_day, p.joined_day, coalesce(sum(c.n), 0) AS between_ FROM p LEFT JOIN e c ON c.pol = p.pol AND c.kind = 'click' AND c.day > p.left_day AND c.day < p.joined_day GROUP BY 1, 2, 3) SELECT pol, left_day, joined_day, CAST(date_diff('day', left_day, joined_day) AS INTEGER) AS gap, CASE WHEN date_diff('day', left_day, joined_day) < 180 THEN 'HIGH' ELSE 'MODERATE' END AS severity, CAST(between_ AS BIGINT) AS contracts, between_ >= 2 AS linked FROM x""")
def revolving_door(t: Tables) -> DataFrame:
    """Leaving an office and joining within a year, and the contracts between: windows over a person's days, no self-join."""
    n = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    days = t.event.groupBy("pol", F.to_date("ts").alias("day")).agg(n("signup").alias("out"), n("purchase").alias("into"), n("click").alias("c"))
    days = days.withColumn("d", F.unix_date("day"))
    own = Window.partitionBy("pol").orderBy("d")
    days = days.withColumn("before", F.coalesce(F.sum("c").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    days = days.withColumn("next", F.min(F.when(F.col("into") > 0, F.struct("d", "day", "before"))).over(own.rangeBetween(1, 364)))
    gap, between = F.col("next.d") - F.col("d"), F.col("next.before") - F.col("before") - F.col("c")
    x = days.filter("out > 0 and next is not null").select("pol", F.col("day").alias("left_day"), F.col("next.day").alias("joined_day"), gap.alias("gap"), between.alias("contracts"))
    return x.select("pol", "left_day", "joined_day", "gap", F.when(F.col("gap") < 180, "HIGH").otherwise("MODERATE").alias("severity"), "contracts", (F.col("contracts") >= 2).alias("linked"))


#: Days by which the events of the tables lie after their contracts.
SHIFT = 9_500


@query("dt14_director_changes", f""", ch AS (SELECT DISTINCT d.comp, CAST(e.ts AS DATE) - {SHIFT} AS day FROM event e JOIN director d USING (pol) WHERE e.kind = 'signup'), co AS (SELECT w.comp, c.contract, c.day FROM won w JOIN contract c USING (contract)) SELECT ch.comp, count(*) AS pairs, CAST(min(abs(date_diff('day', ch.day, co.day))) AS INTEGER) AS gap FROM ch JOIN co ON ch.comp = co.comp AND abs(date_diff('day', ch.day, co.day)) <= 90 GROUP BY 1""")
def director_changes(t: Tables, days: int = 90) -> DataFrame:
    """Changes of directors within 90 days of a contract: a band join over buckets of 90 days and their neighbours."""
    change = t.event.filter("kind = 'signup'").join(t.director, "pol").select("comp", (F.unix_date(F.to_date("ts")) - SHIFT).alias("x")).distinct()
    contract = t.won.join(t.contract, "contract").select("comp", F.unix_date("day").alias("y"))
    left = change.withColumn("bucket", F.explode(F.array(*[F.floor(F.col("x") / days) + k for k in (-1, 0, 1)])))
    right = contract.withColumn("bucket", F.floor(F.col("y") / days))
    gap = F.abs(F.col("x") - F.col("y"))
    return left.join(right, ["comp", "bucket"]).filter(gap <= days).groupBy("comp").agg(F.count(F.lit(1)).alias("pairs"), F.min(gap).alias("gap"))


@query("dt15_burrows_delta", f""", w AS (SELECT item_id, item_id // 10 AS g, string_split(lower(text), ' ') AS w FROM benchmark), f AS (SELECT item_id, g, unnest({list(FUNCTION_WORDS)}) AS k, unnest(list_transform({list(FUNCTION_WORDS)}, lambda k: len(list_filter(w, lambda x: x = k)) / len(w))) AS v FROM w), z AS (SELECT item_id, g, k, CASE WHEN stddev_pop(v) OVER p > 1e-12 THEN (v - avg(v) OVER p) / stddev_pop(v) OVER p ELSE 0 END AS z FROM f WINDOW p AS (PARTITION BY g, k)) SELECT a.item_id AS a, b.item_id AS b, round(avg(abs(a.z - b.z)), 4) AS delta FROM z a JOIN z b ON a.g = b.g AND a.k = b.k AND a.item_id < b.item_id GROUP BY 1, 2 HAVING avg(abs(a.z - b.z)) < 1.5""")
def burrows_delta(t: Tables, least: float = 1.5) -> DataFrame:
    """Burrows' Delta between the documents of one entity (here ten items): mean difference of the z-scores of function words."""
    v = t.raw("benchmark").select("item_id", F.floor(F.col("item_id") / 10).alias("g"), F.posexplode(word_shares(F.split(F.lower("text"), " "))).alias("k", "v"))
    p = Window.partitionBy("g", "k")
    z = v.withColumn("sd", F.stddev_pop("v").over(p)).select("item_id", "g", "k", F.when(F.col("sd") > 1e-12, (F.col("v") - F.avg("v").over(p)) / F.col("sd")).otherwise(0.0).alias("z"))
    vectors = z.groupBy("g", "item_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "z"))), lambda x: x["z"]).alias("z"))
    a, b = (vectors.select("g", F.col("item_id").alias(n), F.col("z").alias(f"z{n}")) for n in ("a", "b"))
    delta = F.aggregate(F.zip_with("za", "zb", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / len(FUNCTION_WORDS)
    return a.join(b, "g").filter("a < b").select("a", "b", delta.alias("d")).filter(F.col("d") < least).select("a", "b", F.round("d", 4).alias("delta"))


_DRAFTS = "(SELECT item_id, text FROM benchmark UNION ALL SELECT item_id + 100000, text || ' drafted' FROM benchmark)"


@query("dt15_template_pairs", f""", s AS (SELECT item_id, {SKIP_SQL} AS h FROM (SELECT item_id, string_split(lower(text), ' ') AS w FROM {_DRAFTS}) WHERE len(w) >= 3) SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.h, b.h)) / len(list_distinct(list_concat(a.h, b.h))), 6) AS similarity FROM s a JOIN s b ON a.item_id < b.item_id WHERE len(list_intersect(a.h, b.h)) / len(list_distinct(list_concat(a.h, b.h))) >= 0.78""")
def template_pairs(t: Tables, least: float = 0.78) -> DataFrame:
    """Documents from one template: skip bigrams of Jaccard similarity .78 or more."""
    b = t.raw("benchmark")
    both = b.select("item_id", "text").union(b.select(F.col("item_id") + 100_000, F.concat("text", F.lit(" drafted"))))
    sets = both.select(F.col("item_id").alias("id"), F.split(F.lower("text"), " ").alias("w")).filter(F.size("w") >= 3).select("id", skip_bigrams(F.col("w")).alias("words"))
    return similar_pairs(sets, least).select("a", "b", F.round("similarity", 6).alias("similarity"))


_SHADOW = f", dr AS (SELECT (item_id % 100000) // 10 AS g, item_id, text, CASE WHEN (item_id % 100000) // 10 % 2 = 1 THEN 'audit' WHEN item_id < 100000 THEN 'submission' ELSE 'policy' END AS type FROM {_DRAFTS}), hv AS (SELECT g, count(*) FILTER (type = 'submission') > 0 AND count(*) FILTER (type = 'policy') > 0 AS typed, count(*) AS m FROM dr GROUP BY g), sd AS (SELECT g, item_id, text, CASE WHEN typed THEN CASE type WHEN 'submission' THEN 0 WHEN 'policy' THEN 1 END ELSE CASE WHEN row_number() OVER (PARTITION BY g ORDER BY item_id) <= m // 2 THEN 0 ELSE 1 END END AS side FROM dr JOIN hv USING (g) WHERE m >= 2), f AS (SELECT g, item_id, side, w, count(*) AS n FROM (SELECT g, item_id, side, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM sd WHERE side IS NOT NULL) GROUP BY ALL), l AS (SELECT g, item_id, sqrt(sum(n * n)) AS l FROM f GROUP BY ALL), p AS (SELECT a.g, a.item_id AS a, b.item_id AS b, sum(a.n * b.n) AS dot FROM f a JOIN f b ON a.g = b.g AND a.w = b.w AND a.side = 0 AND b.side = 1 GROUP BY ALL), c AS (SELECT p.g, dot / x.l / y.l AS c FROM p JOIN l x ON x.item_id = a AND x.g = p.g JOIN l y ON y.item_id = b AND y.g = p.g)"


@query("dt15_shadow_cosine", _SHADOW + " SELECT g, count(*) AS pairs, round(max(c), 4) AS similarity, max(c) >= 0.72 AS shadow FROM c WHERE c > 0.5 GROUP BY g")
def shadow_cosine(t: Tables, kept: float = 0.5, flagged: float = 0.72) -> DataFrame:
    """Submissions against policies of one entity by the cosine of their words: pairs above .5, the greatest, and whether it reaches .72.
    An entity without submissions or without policies has its documents' first half, by number, compared with the rest."""
    b = t.raw("benchmark")
    both = b.select("item_id", "text").union(b.select(F.col("item_id") + 100_000, F.concat("text", F.lit(" drafted"))))
    d = both.withColumn("g", F.expr("(item_id % 100000) div 10"))
    d = d.withColumn("type", F.when(F.col("g") % 2 == 1, "audit").when(F.col("item_id") < 100_000, "submission").otherwise("policy"))
    w = Window.partitionBy("g")
    has = lambda kind: F.max((F.col("type") == kind).cast("int")).over(w) == 1
    d = d.withColumn("typed", has("submission") & has("policy")).withColumn("m", F.count(F.lit(1)).over(w)).withColumn("k", F.row_number().over(w.orderBy("item_id")))
    half = (F.col("k") > F.floor(F.col("m") / 2)).cast("int")
    side = F.when(F.col("typed"), F.when(F.col("type") == "submission", 0).when(F.col("type") == "policy", 1)).otherwise(half)
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0)))
    f = d.filter("m >= 2").select("g", F.col("item_id").alias("id"), side.alias("side"), words.alias("w")).groupBy("g", "id", "side", "w").agg(F.count(F.lit(1)).alias("n"))
    pairs = cosine_pairs(f.filter("side = 0"), kept, f.filter("side = 1"), ("g",)).filter(F.col("cosine") > kept)
    return pairs.groupBy("g").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.max("cosine"), 4).alias("similarity"), (F.max("cosine") >= flagged).alias("shadow"))


_BIDS = ", bd AS (SELECT l_suppkey AS comp, l_orderkey AS contract, string_agg(p_name, ' ' ORDER BY p_name) AS text FROM (SELECT DISTINCT l_suppkey, l_orderkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1, 2), tx AS (SELECT DISTINCT text FROM bd), f AS (SELECT text, w, count(*) AS n FROM (SELECT text, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM tx) GROUP BY 1, 2), l AS (SELECT text, sqrt(sum(n * n)) AS l FROM f GROUP BY 1), c AS (SELECT a, b, dot / x.l / y.l AS c FROM (SELECT a.text AS a, b.text AS b, sum(a.n * b.n) AS dot FROM f a JOIN f b ON a.w = b.w AND a.text < b.text GROUP BY 1, 2) JOIN l x ON x.text = a JOIN l y ON y.text = b WHERE dot / x.l / y.l > 0.3), n AS (SELECT comp, text, count(*) AS n FROM bd GROUP BY 1, 2), s AS (SELECT comp, sum(n) AS bids, sum(n * (n - 1) // 2) AS same FROM n GROUP BY comp HAVING sum(n) >= 3), x AS (SELECT a.comp, sum(a.n * b.n) AS pairs, sum(CASE WHEN c >= 0.72 THEN a.n * b.n ELSE 0 END) AS suspicious FROM c JOIN n a ON a.text = c.a JOIN n b ON b.text = c.b AND a.comp = b.comp GROUP BY a.comp)"


def alike_pairs(used: DataFrame, alike: DataFrame) -> DataFrame:
    """comp, close and n (pairs of bids) of the pairs of descriptions (alike: a, b, close) that both occur in a company's bids (used: comp, id, n).

    A company meets the pairs by whichever gives fewer rows: all that are alike to one of its descriptions, or all pairs of its own."""
    degree = alike.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("k"))
    rows = used.join(degree, "id", "left").groupBy("comp").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("k"), F.count(F.lit(1)).alias("m"))
    split = settle(used.join(rows, "comp").filter("k > 0").select("comp", "id", "n", (F.col("m") * (F.col("m") - 1) / 2 < F.col("k")).alias("own")))
    side = lambda k, own: split.filter(F.col("own") == own).select("comp", F.col("id").alias(k), F.col("n").alias(f"n{k}"))
    pairs = side("a", True).join(side("b", True), "comp").filter("a < b").join(alike, ["a", "b"])
    pairs = pairs.unionByName(alike.join(side("a", False), "a").join(side("b", False), ["comp", "b"]))
    return pairs.select("comp", "close", (F.col("na") * F.col("nb")).alias("n"))


@query("dt11_bid_pairs", _BIDS + " SELECT comp, CAST(bids AS BIGINT) AS bids, CAST(same + coalesce(pairs, 0) AS BIGINT) AS pairs, CAST(same + coalesce(suspicious, 0) AS BIGINT) AS suspicious, CASE WHEN same + coalesce(suspicious, 0) >= 3 THEN 'HIGH' WHEN same + coalesce(suspicious, 0) >= 1 THEN 'MODERATE' ELSE 'LOW' END AS level FROM s LEFT JOIN x USING (comp)")
def bid_pairs(t: Tables, kept: float = 0.3, flagged: float = 0.72, least: int = 3) -> DataFrame:
    """Of each company with three bids: pairs of bids whose descriptions have a cosine above .3, those at .72 and more, and the level these give.

    A bid is described by the names of its parts. Different descriptions are compared once for all; a company's pairs follow from how
    often it used each, so many equal bids cost one row."""
    named = t.raw("lineitem").join(t.raw("part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    bids = named.groupBy(F.col("l_suppkey").alias("comp"), F.col("l_orderkey").alias("contract")).agg(F.array_join(F.sort_array(F.collect_set("p_name")), " ").alias("text"))
    used = settle(bids.groupBy("comp", "text").agg(F.count(F.lit(1)).alias("n")))
    # descriptions by number from here on, in their order, so that a pair's norms are divided out in the same order
    texts = settle(used.select("text").distinct().orderBy("text").withColumn("id", F.monotonically_increasing_id()))
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0)))
    terms = texts.select("id", words.alias("w")).groupBy("id", "w").agg(F.count(F.lit(1)).alias("n"))
    alike = settle(cosine_pairs(terms, kept).filter(F.col("cosine") > kept).select("a", "b", (F.col("cosine") >= flagged).alias("close")))
    used = settle(used.join(texts, "text").select("comp", "id", "n"))
    found = alike_pairs(used, alike).groupBy("comp").agg(F.sum("n").alias("pairs"), F.sum(F.when(F.col("close"), F.col("n")).otherwise(0)).alias("suspicious"))
    n = F.col("n")
    own = used.groupBy("comp").agg(F.sum("n").alias("bids"), F.sum((n * (n - 1) / 2).cast("long")).alias("same")).filter(F.col("bids") >= least)
    zero = lambda c: F.coalesce(c, F.lit(0))
    x = own.join(found, "comp", "left").select("comp", "bids", (F.col("same") + zero("pairs")).alias("pairs"), (F.col("same") + zero("suspicious")).alias("suspicious"))
    return x.withColumn("level", F.when(F.col("suspicious") >= 3, "HIGH").when(F.col("suspicious") >= 1, "MODERATE").otherwise("LOW"))


_SERIES = """, xs AS (SELECT pol, value AS x, row_number() OVER (PARTITION BY pol ORDER BY ts, event_id) AS k FROM event), ys AS (SELECT cust AS pol, total / 1000.0 AS y, row_number() OVER (PARTITION BY cust ORDER BY day, contract) AS k FROM contract), xy AS (SELECT pol, k, x, y, count(*) OVER (PARTITION BY pol) AS n FROM xs JOIN ys USING (pol, k))"""


def paired_series(t: Tables, least: int = 8) -> DataFrame:
    """pol, k, x (policy events), y (contract values) and n of people with `least` of both."""
    x = t.event.select("pol", F.col("value").alias("x"), F.row_number().over(Window.partitionBy("pol").orderBy("ts", "event_id")).alias("k"))
    y = t.contract.select(F.col("cust").alias("pol"), (F.col("total") / 1000.0).alias("y"), F.row_number().over(Window.partitionBy("cust").orderBy("day", "contract")).alias("k"))
    return x.join(y, ["pol", "k"]).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("pol"))).filter(F.col("n") >= least)


@query("dt16_granger", _SERIES + """, l AS (SELECT pol, n, y, (lag(y, 1) OVER w + lag(y, 2) OVER w) / 2 AS own, (lag(y, 1) OVER w + lag(y, 2) OVER w + lag(x, 1) OVER w + lag(x, 2) OVER w) / 4 AS ab FROM xy WHERE n >= 8 WINDOW w AS (PARTITION BY pol ORDER BY k)), r AS (SELECT pol, n, sum((y - own) ** 2) AS r, sum((y - ab) ** 2) AS u FROM l WHERE own IS NOT NULL GROUP BY pol, n) SELECT pol, round(CASE WHEN u = 0 THEN 0 ELSE greatest(0, ((r - u) / 2) / (u / greatest(n - 5, 1))) END, 4) AS f_stat, CASE WHEN u = 0 THEN FALSE ELSE ((r - u) / 2) / (u / greatest(n - 5, 1)) > 2.5 END AS significant FROM r""")
def granger(t: Tables) -> DataFrame:
    """F statistic of lagged means with and without the other series, lag 2."""
    w = Window.partitionBy("pol").orderBy("k")
    lags = lambda c: F.lag(c, 1).over(w) + F.lag(c, 2).over(w)
    l = paired_series(t).select("pol", "n", "y", (lags("y") / 2).alias("own"), ((lags("y") + lags("x")) / 4).alias("both")).filter("own is not null")
    square = lambda c: F.sum((F.col("y") - F.col(c)) ** 2)
    r = l.groupBy("pol", "n").agg(square("own").alias("r"), square("both").alias("u"))
    f = F.when(F.col("u") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), (F.col("r") - F.col("u")) / 2 / (F.col("u") / F.greatest(F.col("n") - 5, F.lit(1)))))
    return r.select("pol", F.round(f, 4).alias("f_stat"), (f > 2.5).alias("significant"))


@query("dt16_transfer_entropy", _SERIES + """, b AS (SELECT pol, k, CASE WHEN max(x) OVER p = min(x) OVER p THEN 0 ELSE least(CAST(floor((x - min(x) OVER p) / (max(x) OVER p - min(x) OVER p) * 4) AS INTEGER), 3) END AS bx, CASE WHEN max(y) OVER p = min(y) OVER p THEN 0 ELSE least(CAST(floor((y - min(y) OVER p) / (max(y) OVER p - min(y) OVER p) * 4) AS INTEGER), 3) END AS b_y FROM xy WHERE n >= 8 WINDOW p AS (PARTITION BY pol)), s AS (SELECT pol, b_y AS y, lag(b_y) OVER w AS y1, lag(bx) OVER w AS x1 FROM b WINDOW w AS (PARTITION BY pol ORDER BY k)), v AS (SELECT * FROM s WHERE y1 IS NOT NULL), h1 AS (SELECT pol, -sum(c / t * log2(c / m)) AS h FROM (SELECT pol, c, sum(c) OVER (PARTITION BY pol, y1) AS m, sum(c) OVER (PARTITION BY pol) AS t FROM (SELECT pol, y, y1, count(*) AS c FROM v GROUP BY 1, 2, 3)) GROUP BY pol), h2 AS (SELECT pol, -sum(c / t * log2(c / m)) AS h FROM (SELECT pol, c, sum(c) OVER (PARTITION BY pol, y1, x1) AS m, sum(c) OVER (PARTITION BY pol) AS t FROM (SELECT pol, y, y1, x1, count(*) AS c FROM v GROUP BY 1, 2, 3, 4)) GROUP BY pol) SELECT pol, round(greatest(0, h1.h - h2.h), 5) AS te, greatest(0, h1.h - h2.h) > 0.15 AS significant FROM h1 JOIN h2 USING (pol)""")
def transfer_entropy(t: Tables, bins: int = 4) -> DataFrame:
    """What the other series' past tells about the next value beyond its own past, in bits over four equal bins."""
    own = Window.partitionBy("pol")

    def binned(c: str) -> Column:
        low, high = F.min(c).over(own), F.max(c).over(own)
        return F.when(high == low, 0).otherwise(F.least(F.floor((F.col(c) - low) / (high - low) * bins).cast("int"), F.lit(bins - 1)))

    w = own.orderBy("k")
    b = paired_series(t).select("pol", "k", binned("x").alias("bx"), binned("y").alias("y"))
    v = b.select("pol", "y", F.lag("y").over(w).alias("y1"), F.lag("bx").over(w).alias("x1")).filter("y1 is not null")

    def entropy(past: list[str], name: str) -> DataFrame:
        j = v.groupBy("pol", "y", *past).agg(F.count(F.lit(1)).alias("c"))
        j = j.withColumns({"m": F.sum("c").over(Window.partitionBy("pol", *past)), "t": F.sum("c").over(own)})
        return j.groupBy("pol").agg((-F.sum(F.col("c") / F.col("t") * F.log2(F.col("c") / F.col("m")))).alias(name))

    te = F.greatest(F.lit(0.0), F.col("h1") - F.col("h2"))
    return entropy(["y1"], "h1").join(entropy(["y1", "x1"], "h2"), "pol").select("pol", F.round(te, 5).alias("te"), (te > 0.15).alias("significant"))


@query("dt17_periodicity", """, s AS (SELECT cust AS pol, total / 1000.0 AS v, month(day) = 3 AND day(day) >= 25 AS fiscal, row_number() OVER (PARTITION BY cust ORDER BY day, contract) - 1 AS i, count(*) OVER (PARTITION BY cust) AS n, avg(total / 1000.0) OVER (PARTITION BY cust) AS m FROM contract), f AS (SELECT pol, k, n, sum((v - m) * cos(2 * pi() * k * i / n)) AS re, sum((v - m) * sin(2 * pi() * k * i / n)) AS im FROM s, LATERAL (SELECT unnest(generate_series(1, n // 2)) AS k) WHERE n >= 4 GROUP BY pol, k, n), w AS (SELECT pol, k, n, round(re * re + im * im, 6) AS power FROM f), p AS (SELECT pol, n, max(power) / sum(power) AS share, arg_max(k, (power, -k)) AS k FROM w GROUP BY pol, n), y AS (SELECT pol, sum(CASE WHEN fiscal THEN 1 ELSE 0 END) AS hits FROM s GROUP BY pol) SELECT pol, round(share, 4) AS share, CASE WHEN share > 0.6 THEN 'HIGH' WHEN share > 0.3 THEN 'MODERATE' ELSE 'LOW' END AS level, CAST(round(n / k) AS BIGINT) AS period, hits >= 2 AND hits / n > 0.3 AS fiscal_spike FROM p JOIN y USING (pol)""")
def periodicity(t: Tables, least: int = 4) -> DataFrame:
    """Share and period of the strongest frequency of a person's contracts, and whether they crowd at the end of the fiscal year."""
    import math

    own = Window.partitionBy("cust")
    fiscal = ((F.month("day") == 3) & (F.dayofmonth("day") >= 25)).cast("int")
    s = t.contract.select(F.col("cust").alias("pol"), (F.col("total") / 1000.0).alias("v"), fiscal.alias("fiscal"), (F.row_number().over(own.orderBy("day", "contract")) - 1).alias("i"), F.count(F.lit(1)).over(own).alias("n"), F.avg(F.col("total") / 1000.0).over(own).alias("m")).filter(F.col("n") >= least)
    x = s.withColumn("k", F.explode(F.sequence(F.lit(1), F.floor(F.col("n") / 2))))
    angle = 2 * math.pi * F.col("k") * F.col("i") / F.col("n")
    part = lambda f: F.sum((F.col("v") - F.col("m")) * f(angle))
    f = x.groupBy("pol", "k", "n").agg(part(F.cos).alias("re"), part(F.sin).alias("im")).select("pol", "k", "n", F.round(F.col("re") ** 2 + F.col("im") ** 2, 6).alias("power"))
    p = f.groupBy("pol", "n").agg((F.max("power") / F.sum("power")).alias("share"), F.max_by("k", F.struct(F.col("power"), -F.col("k"))).alias("k"))
    hits = s.groupBy("pol").agg(F.sum("fiscal").alias("hits"))
    level = F.when(F.col("share") > 0.6, "HIGH").when(F.col("share") > 0.3, "MODERATE").otherwise("LOW")
    return p.join(hits, "pol").select("pol", F.round("share", 4).alias("share"), level.alias("level"), F.round(F.col("n") / F.col("k")).cast("long").alias("period"), ((F.col("hits") >= 2) & (F.col("hits") / F.col("n") > 0.3)).alias("fiscal_spike"))


#: How strong a relationship is as evidence.
STRENGTH = {"DIRECTOR_OF": "strong", "WON_CONTRACT": "strong", "AWARDED_BY": "strong", "FLAGS": "strong", "AUDITS": "strong", "MEMBER_OF": "medium", "MENTIONED_IN": "weak", "ISSUED_BY": "medium", "CONTESTED_IN": "medium", "ASSOCIATED_WITH": "weak"}


@query("dt27_node_evidence", """, n AS (SELECT 'p' || pol AS id, 'c' || comp AS neighbour, 'DIRECTOR_OF' AS rel FROM director UNION ALL SELECT 'c' || comp, 'p' || pol, 'DIRECTOR_OF' FROM director UNION ALL SELECT 'c' || src, 'c' || dst, 'OWNS' FROM owns UNION ALL SELECT 'c' || dst, 'c' || src, 'OWNS' FROM owns UNION ALL SELECT 'p' || pol, party, 'MEMBER_OF' FROM politician), k AS (SELECT *, CASE rel WHEN 'DIRECTOR_OF' THEN 'strong' WHEN 'MEMBER_OF' THEN 'medium' ELSE 'weak' END AS strength, row_number() OVER (PARTITION BY id ORDER BY rel, neighbour) AS k FROM n) SELECT id, count(*) AS edges, sum(CASE WHEN strength = 'strong' THEN 1 ELSE 0 END)::BIGINT AS strong, CASE WHEN bool_or(strength = 'strong') THEN 'HIGH' WHEN bool_or(strength = 'medium') THEN 'MODERATE' ELSE 'LOW' END AS confidence, CASE WHEN bool_or(rel = 'DIRECTOR_OF') THEN ['contracts of the companies'] ELSE [] END || CASE WHEN bool_or(rel = 'OWNS') THEN ['circular ownership'] ELSE [] END AS leads FROM k WHERE k <= 40 GROUP BY id""")
def node_evidence(t: Tables, most: int = 40) -> DataFrame:
    """Up to 40 edges a node with their strength, the confidence that they give, and what to look at next."""
    from plumbline.operators.patterns import neighbours

    member = t.politician.select(F.concat(F.lit("p"), "pol"), "party", F.lit("MEMBER_OF"))
    known = F.create_map(*[F.lit(x) for pair in STRENGTH.items() for x in pair])
    e = neighbours(t).union(member).withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("rel", "neighbour"))).filter(F.col("k") <= most)
    e = e.withColumn("strength", F.coalesce(known[F.col("rel")], F.lit("weak")))
    has = lambda c, v: F.max((F.col(c) == v).cast("int")) == 1
    x = e.groupBy("id").agg(F.count(F.lit(1)).alias("edges"), F.count(F.when(F.col("strength") == "strong", 1)).alias("strong"), has("strength", "medium").alias("medium"), has("rel", "DIRECTOR_OF").alias("boards"), has("rel", "OWNS").alias("owns"))
    leads = F.array_compact(F.array(F.when(F.col("boards"), "contracts of the companies"), F.when(F.col("owns"), "circular ownership")))
    return x.select("id", "edges", "strong", F.when(F.col("strong") > 0, "HIGH").when(F.col("medium"), "MODERATE").otherwise("LOW").alias("confidence"), leads.alias("leads"))


@query("dt28_motifs", """, r AS (SELECT comp, buyer, count(*) AS n FROM won JOIN contract USING (contract) GROUP BY 1, 2), m AS (SELECT 'politician_company_contract' AS motif, (SELECT count(*) FROM director JOIN won USING (comp)) AS n, 3 AS threshold UNION ALL SELECT 'audit_flagged_ministry_contract', (SELECT count(*) FROM (SELECT DISTINCT 'NATION_' || (doc_id % 40) AS ministry FROM documents JOIN labels USING (doc_id) WHERE toxic = 1) f JOIN awarded USING (ministry)), 2 UNION ALL SELECT 'high_value_single_vendor', (SELECT count(*) FROM r WHERE n >= 3), 1 UNION ALL SELECT 'many_directorships', (SELECT count(*) FROM (SELECT pol FROM director GROUP BY pol HAVING count(*) >= 5)), 1) SELECT motif, n, n >= threshold AS found FROM m""")
def motifs(t: Tables) -> DataFrame:
    """Known motifs, their counts and whether they reach their thresholds."""
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n"))
    per = t.won.groupBy("comp").agg(F.count(F.lit(1)).alias("w"))
    chain = t.director.join(per, "comp").agg(F.coalesce(F.sum("w"), F.lit(0)).alias("n"))
    flagged = t.raw("documents").select("doc_id").join(t.raw("labels").filter("toxic = 1").select("doc_id"), "doc_id").select(F.concat(F.lit("NATION_"), F.col("doc_id") % 40).alias("ministry")).distinct()
    parts = (
        ("politician_company_contract", chain, 3),
        ("audit_flagged_ministry_contract", count(t.awarded.join(flagged, "ministry")), 2),
        ("high_value_single_vendor", count(t.won.join(t.contract, "contract").groupBy("comp", "buyer").agg(F.count(F.lit(1)).alias("k")).filter("k >= 3")), 1),
        ("many_directorships", count(t.director.groupBy("pol").agg(F.count(F.lit(1)).alias("k")).filter("k >= 5")), 1),
    )
    out = None
    for name, df, least in parts:
        one = df.select(F.lit(name).alias("motif"), "n", (F.col("n") >= least).alias("found"))
        out = one if out is None else out.union(one)
    return out


#: The indicators' weights before any outcome.
WEIGHTS = {"politician_company_overlap": 0.35, "contract_concentration": 0.25, "audit_mention_frequency": 0.20, "asset_growth_anomaly": 0.15, "criminal_case_presence": 0.05}


@query("dt29_weights", """, i AS (SELECT p.pol, (SELECT count(*) FROM director d WHERE d.pol = p.pol) > 0 AS a, (SELECT count(*) FROM contract c WHERE c.cust = p.pol) >= 3 AS b, p.pol % 4 = 0 AS c, p.assets > 5000 AS d, (SELECT count(*) FROM event e WHERE e.pol = p.pol AND e.kind = 'error') >= 1 AS e FROM politician p), o AS (SELECT *, CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) + CAST(d AS INT) + CAST(e AS INT) >= 3 AS confirmed FROM i), l AS (SELECT unnest(['politician_company_overlap', 'contract_concentration', 'audit_mention_frequency', 'asset_growth_anomaly', 'criminal_case_presence']) AS indicator, unnest([0.35, 0.25, 0.20, 0.15, 0.05]) AS w, unnest([a, b, c, d, e]) AS fired, confirmed FROM o), s AS (SELECT indicator, CAST(w AS DOUBLE) AS w, sum(CASE WHEN fired AND confirmed THEN 1 ELSE 0 END) AS yes, sum(CASE WHEN fired AND NOT confirmed THEN 1 ELSE 0 END) AS no FROM l GROUP BY 1, 2), n AS (SELECT indicator, CASE WHEN yes + no < 3 THEN w WHEN yes >= no THEN least(0.5, w + 0.01) ELSE greatest(0.01, w - 0.005) END AS w FROM s) SELECT indicator, round(w / sum(w) OVER (), 4) AS weight FROM n""")
def weights(t: Tables) -> DataFrame:
    """Each indicator's weight after the outcomes of the cases where it fired, normalised again."""
    boards = t.director.groupBy("pol").agg(F.lit(True).alias("a"))
    contracts = t.contract.groupBy(F.col("cust").alias("pol")).agg((F.count(F.lit(1)) >= 3).alias("b"))
    cases = t.event.filter("kind = 'error'").groupBy("pol").agg(F.lit(True).alias("e"))
    no = F.lit(False)
    i = t.politician.join(boards, "pol", "left").join(contracts, "pol", "left").join(cases, "pol", "left")
    fired = F.array(F.coalesce("a", no), F.coalesce("b", no), F.col("pol") % 4 == 0, F.col("assets") > 5000, F.coalesce("e", no))
    o = i.select(fired.alias("fired")).withColumn("confirmed", F.size(F.filter("fired", lambda x: x)) >= 3)
    names = F.array(*map(F.lit, WEIGHTS))
    l = o.select("confirmed", F.posexplode("fired").alias("k", "f")).groupBy("k").agg(F.count(F.when(F.col("f") & F.col("confirmed"), 1)).alias("yes"), F.count(F.when(F.col("f") & ~F.col("confirmed"), 1)).alias("no"))
    w = F.get(F.array(*map(F.lit, WEIGHTS.values())), F.col("k"))
    new = F.when(F.col("yes") + F.col("no") < 3, w).when(F.col("yes") >= F.col("no"), F.least(F.lit(0.5), w + 0.01)).otherwise(F.greatest(F.lit(0.01), w - 0.005))
    # five rows
    return l.select(F.get(names, F.col("k")).alias("indicator"), new.alias("w")).select("indicator", F.round(F.col("w") / F.sum("w").over(Window.partitionBy()), 4).alias("weight"))


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query("dt31_source_health", "SELECT label, n, CASE WHEN n = 0 THEN 'fail' WHEN n < 100 THEN 'warn' ELSE 'pass' END AS status FROM (" + " UNION ALL ".join(f"SELECT '{x}' AS label, count(*) AS n FROM {x}" for x in TABLES) + ")")
def source_health(t: Tables) -> DataFrame:
    """Whether each source is there and full enough."""
    out = None
    for name in TABLES:
        one = t.raw(name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("label"), "n")
        out = one if out is None else out.union(one)
    return out.withColumn("status", F.when(F.col("n") == 0, "fail").when(F.col("n") < 100, "warn").otherwise("pass"))


def report_hash(*parts: Column) -> Column:
    """SHA-256 over the parts joined by a pipe."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


@query("dt33_report_verify", """SELECT pol, sha256(pol || '|' || name || '|' || party) AS hash, pol % 5 <> 0 AS verified FROM politician""")
def report_verify(t: Tables) -> DataFrame:
    """Reports are stored with their hash; a look-up by id and a second hash tell whether the snapshot is still the same."""
    p = t.politician.select("pol", "name", "party")
    stored = p.select("pol", report_hash(F.col("pol"), F.col("name"), F.col("party")).alias("hash"))
    now = p.withColumn("party", F.when(F.col("pol") % 5 == 0, F.concat("party", F.lit("?"))).otherwise(F.col("party")))
    return now.join(stored, "pol").select("pol", "hash", (report_hash(F.col("pol"), F.col("name"), F.col("party")) == F.col("hash")).alias("verified"))


def chained(e: DataFrame) -> DataFrame:
    """event_id, pol, seq, payload, previous and hash: each person's entries in order, each hash over the one before and the payload."""
    rows = e.groupBy("pol").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", F.concat(F.col("event_id").cast("string"), F.col("kind")).alias("payload")))).alias("s"))
    zero = F.array().cast("array<string>")
    last = lambda acc: F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(""))
    chain = F.aggregate("s", zero, lambda acc, x: F.concat(acc, F.array(F.sha2(F.concat(last(acc), F.lit("|"), x["payload"]), 256))))
    x = rows.select("pol", "s", chain.alias("c")).select("pol", "c", F.posexplode("s").alias("seq", "x"))
    return x.select("pol", "seq", "x.event_id", "x.payload", F.coalesce(F.get("c", F.col("seq") - 1), F.lit("")).alias("previous"), F.get("c", F.col("seq")).alias("hash"))


@query("wn09_chain_check", """, s AS (SELECT pol, event_id, event_id || kind AS payload, row_number() OVER (PARTITION BY pol ORDER BY ts, event_id) AS k FROM event), r AS (SELECT pol, event_id, k, sha256('|' || payload) AS hash FROM s WHERE k = 1 UNION ALL SELECT s.pol, s.event_id, s.k, sha256(r.hash || '|' || s.payload) FROM r JOIN s ON s.pol = r.pol AND s.k = r.k + 1) SELECT event_id, hash, event_id % 50 <> 0 AS valid FROM r""")
def chain_check(t: Tables) -> DataFrame:
    """The chain with some payloads altered: a row is valid if its hash follows from its payload and the previous row's hash."""
    c = chained(t.event)
    seen = c.withColumn("payload", F.when(F.col("event_id") % 50 == 0, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    before = F.coalesce(F.lag("hash").over(Window.partitionBy("pol").orderBy("seq")), F.lit(""))
    fine = (F.col("previous") == before) & (F.sha2(F.concat("previous", F.lit("|"), "payload"), 256) == F.col("hash"))
    return seen.select("event_id", "hash", fine.alias("valid"))


@query("dt35_profile", """, w AS (SELECT comp, count(*) AS n FROM won GROUP BY comp), d AS (SELECT comp, count(*) AS n FROM director GROUP BY comp), b AS (SELECT pol, count(*) AS n FROM director GROUP BY pol), o AS (SELECT cust AS pol, count(*) AS n FROM contract GROUP BY cust), a AS (SELECT ministry, count(*) AS n FROM awarded GROUP BY 1) SELECT 'p' || pol AS id, 'Politician' AS label, name, coalesce(b.n, 0) AS relations, coalesce(o.n, 0) AS contracts FROM politician LEFT JOIN b USING (pol) LEFT JOIN o USING (pol) UNION ALL SELECT 'c' || comp, 'Company', name, coalesce(d.n, 0), coalesce(w.n, 0) FROM company LEFT JOIN d USING (comp) LEFT JOIN w USING (comp) UNION ALL SELECT ministry, 'Ministry', ministry, 0, n FROM a""")
def profile(t: Tables) -> DataFrame:
    """A profile by label: people with boards and contracts, companies with directors and contracts, anything else with what points to it."""
    n = lambda df, key, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    people = t.politician.join(n(t.director, "pol", "relations"), "pol", "left").join(n(t.contract.withColumnRenamed("cust", "pol"), "pol", "contracts"), "pol", "left")
    firms = t.company.join(n(t.director, "comp", "relations"), "comp", "left").join(n(t.won, "comp", "contracts"), "comp", "left")
    other = n(t.awarded, "ministry", "contracts")
    return (
        people.select(F.concat(F.lit("p"), "pol").alias("id"), F.lit("Politician").alias("label"), "name", zero("relations"), zero("contracts"))
        .union(firms.select(F.concat(F.lit("c"), "comp"), F.lit("Company"), "name", zero("relations"), zero("contracts")))
        .union(other.select("ministry", F.lit("Ministry"), "ministry", F.lit(0).cast("long"), "contracts"))
    )
