"""Graph patterns, filters and aggregations: chains of equi-joins over vertex and edge tables.

Branches of an optional match are aggregated before they are joined, so nothing fans out;
limits carry a tie-break; sums over nothing are 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.plans.registry import query
from plumbline.plans.tables import Tables


@query("jn01_director_contracts", """SELECT p.name AS politician, c.name AS company, w.contract, w.amount FROM director d JOIN politician p USING (pol) JOIN company c USING (comp) JOIN won w USING (comp) ORDER BY w.amount DESC, p.name, w.contract LIMIT 50""")
def director_contracts(t: Tables) -> DataFrame:
    # each directed contract gives a row or more, so none beyond the 50 best of them (and their equals) is in the result
    best = F.rank().over(Window.orderBy(F.col("amount").desc()))
    top = t.won.join(t.director.select("comp").distinct(), "comp", "left_semi").withColumn("_k", best).filter(F.col("_k") <= 50).drop("_k")
    chain = top.join(t.director, "comp").join(t.politician.select("pol", F.col("name").alias("politician")), "pol").join(t.company.select("comp", F.col("name").alias("company")), "comp")
    return chain.select("politician", "company", "contract", "amount").orderBy(F.col("amount").desc(), "politician", "contract").limit(50)


@query("jn02_high_value_contracts", """SELECT c.name AS company, w.contract, a.ministry, w.amount FROM won w JOIN company c USING (comp) JOIN awarded a USING (contract) WHERE w.amount >= 50000 ORDER BY w.amount DESC, w.contract, company LIMIT 50""")
def high_value_contracts(t: Tables, least: float = 50_000) -> DataFrame:
    out = t.won.filter(F.col("amount") >= least).join(t.company.select("comp", F.col("name").alias("company")), "comp").join(t.awarded, "contract")
    return out.select("company", "contract", "ministry", "amount").orderBy(F.col("amount").desc(), "contract", "company").limit(50)


@query("jn03_politician_profile", """SELECT p.pol, p.name, p.party, list_sort(coalesce(d.companies, [])) AS companies, CAST(coalesce(o.n, 0) AS BIGINT) AS n_orders FROM politician p LEFT JOIN (SELECT pol, list(DISTINCT comp) AS companies FROM director GROUP BY pol) d USING (pol) LEFT JOIN (SELECT cust AS pol, count(*) AS n FROM contract GROUP BY cust) o USING (pol) WHERE contains(lower(p.name), '00001')""")
def politician_profile(t: Tables, part: str = "00001") -> DataFrame:
    companies = t.director.groupBy("pol").agg(F.collect_set("comp").alias("companies"))
    orders = t.contract.groupBy(F.col("cust").alias("pol")).agg(F.count(F.lit(1)).alias("n"))
    found = t.politician.filter(F.contains(F.lower("name"), F.lit(part)))
    out = found.join(companies, "pol", "left").join(orders, "pol", "left")
    return out.select("pol", "name", "party", F.sort_array(F.coalesce("companies", F.array().cast("array<bigint>"))).alias("companies"), F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("jn04_exact_name_join", """SELECT p1.pol AS a, p2.pol AS b FROM politician p1 JOIN politician p2 ON lower(p1.name) = lower(p2.name) AND p1.pol <= p2.pol""")
def exact_name_join(t: Tables) -> DataFrame:
    a, b = t.politician.select(F.col("pol").alias("a"), F.lower("name").alias("x")), t.politician.select(F.col("pol").alias("b"), F.lower("name").alias("x"))
    return a.join(b, "x").filter("a <= b").select("a", "b")


#: Places to which a mention's parts are dealt.
PLACES = 64


@query("jn05_contains_join", """SELECT DISTINCT s.comp, p.p_partkey AS part FROM company s JOIN part p ON contains(lower(p.p_name || ' ' || replace(p.p_type, ' ', '') || ' ' || p.p_brand), '#' || (s.comp % 30))""")
def q_contains_join(t: Tables) -> DataFrame:
    """Names that hold a mention, by their rarest runs of characters."""
    from plumbline.operators.loaders import contains_join

    mentions = t.company.select("comp", F.concat(F.lit("#"), (F.col("comp") % 30).cast("string")).alias("mid")).distinct()
    names = t.raw("part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", F.replace("p_type", F.lit(" "), F.lit("")), "p_brand").alias("name"))
    met = contains_join(names, mentions.select("mid", F.col("mid").alias("mention")).distinct())
    # a company has one mention, so pairs are met once; a mention's parts are dealt to PLACES, as there are few mentions and very many pairs
    parts = met.select("mid", F.col("id").alias("part"), F.pmod(F.xxhash64("id"), F.lit(PLACES)).cast("int").alias("place"))
    return mentions.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(PLACES - 1)))).join(parts, ["mid", "place"]).select("comp", "part")


@query("jn07_neighbours", """SELECT id, neighbour, rel FROM (SELECT 'p' || pol AS id, 'c' || comp AS neighbour, 'DIRECTOR_OF' AS rel FROM director UNION ALL SELECT 'c' || comp, 'p' || pol, 'DIRECTOR_OF' FROM director UNION ALL SELECT 'c' || src, 'c' || dst, 'OWNS' FROM owns UNION ALL SELECT 'c' || dst, 'c' || src, 'OWNS' FROM owns)""")
def neighbours(t: Tables) -> DataFrame:
    e = edges(t)
    return e.select(F.col("src").alias("id"), F.col("dst").alias("neighbour"), "rel").union(e.select("dst", "src", "rel"))


def edges(t: Tables) -> DataFrame:
    """The typed edges of the people-and-companies graph."""
    return t.director.select(F.concat(F.lit("p"), "pol").alias("src"), F.concat(F.lit("c"), "comp").alias("dst"), F.lit("DIRECTOR_OF").alias("rel")).union(t.owns.select(F.concat(F.lit("c"), "src"), F.concat(F.lit("c"), "dst"), F.lit("OWNS")))


@query("jn08_two_hops", """SELECT DISTINCT a.pol AS id, b.pol AS target FROM director a JOIN director b USING (comp) WHERE a.pol <> b.pol""")
def two_hops(t: Tables) -> DataFrame:
    a, b = t.director, t.director.withColumnRenamed("pol", "target")
    return a.join(b, "comp").filter("pol <> target").select(F.col("pol").alias("id"), "target").distinct()


@query("jn12_co_directors", """SELECT a.comp, a.pol AS a, b.pol AS b FROM director a JOIN director b ON a.comp = b.comp AND a.pol < b.pol JOIN politician p ON p.pol = a.pol JOIN politician q ON q.pol = b.pol WHERE p.party = q.party""")
def co_directors(t: Tables) -> DataFrame:
    d = t.director.join(t.politician.select("pol", "party"), "pol")
    a, b = d.withColumnRenamed("pol", "a"), d.withColumnRenamed("pol", "b")
    return a.join(b, ["comp", "party"]).filter("a < b").select("comp", "a", "b")


@query("jn15_anti_semi", """SELECT comp, CASE WHEN comp IN (SELECT comp FROM director) THEN 'directed' ELSE 'free' END AS state FROM company""")
def anti_semi(t: Tables) -> DataFrame:
    directed = t.director.select("comp").distinct()
    return t.company.join(directed, "comp", "left_semi").select("comp", F.lit("directed").alias("state")).union(t.company.join(directed, "comp", "left_anti").select("comp", F.lit("free")))


@query("jn16_first_match", """SELECT pol, comp FROM (SELECT p.pol, d.comp, row_number() OVER (PARTITION BY p.pol ORDER BY d.comp) AS k FROM politician p LEFT JOIN director d USING (pol)) WHERE k = 1""")
def first_match(t: Tables) -> DataFrame:
    return t.politician.select("pol").join(t.director.groupBy("pol").agg(F.min("comp").alias("comp")), "pol", "left")


@query("jn20_alias_lookup", """SELECT l_suppkey AS alias, s_name AS name, count(*) AS n FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""")
def alias_lookup(t: Tables) -> DataFrame:
    counted = t.raw("lineitem").groupBy(F.col("l_suppkey").alias("alias")).agg(F.count(F.lit(1)).alias("n"))
    return counted.join(t.raw("supplier").select(F.col("s_suppkey").alias("alias"), F.col("s_name").alias("name")), "alias", "left").select("alias", "name", "n")


@query("ag01_repeated_winners", """SELECT c.name AS company, a.ministry, count(*) AS n, round(sum(w.amount), 4) AS total FROM won w JOIN company c USING (comp) JOIN awarded a USING (contract) GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY n DESC, total DESC, company, a.ministry LIMIT 20""")
def repeated_winners(t: Tables) -> DataFrame:
    out = t.won.join(t.awarded, "contract").groupBy("comp", "ministry").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 4).alias("total")).filter("n >= 2")
    return out.join(t.company.select("comp", F.col("name").alias("company")), "comp").select("company", "ministry", "n", "total").orderBy(F.col("n").desc(), F.col("total").desc(), "company", "ministry").limit(20)


@query("ag02_scheme_flags", """SELECT scheme, count(*) AS n, CAST(sum(flag) AS BIGINT) AS flagged, round(sum(amount), 4) AS amount FROM audit GROUP BY scheme ORDER BY amount DESC, scheme LIMIT 20""")
def scheme_flags(t: Tables) -> DataFrame:
    return t.audit.groupBy("scheme").agg(F.count(F.lit(1)).alias("n"), F.sum("flag").alias("flagged"), F.round(F.sum("amount"), 4).alias("amount")).orderBy(F.col("amount").desc(), "scheme").limit(20)


@query("ag03_node_counts", """SELECT 'Politician' AS label, count(*) AS n FROM politician UNION ALL SELECT 'Company', count(*) FROM company UNION ALL SELECT 'Contract', count(*) FROM contract UNION ALL SELECT 'AuditReport', count(*) FROM audit""")
def node_counts(t: Tables) -> DataFrame:
    parts = [(n, df) for n, df in (("Politician", t.politician), ("Company", t.company), ("Contract", t.contract), ("AuditReport", t.audit))]
    out = None
    for n, df in parts:
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("label"), "n")
        out = one if out is None else out.union(one)
    return out


@query("ag03_relationship_counts", """SELECT 'DIRECTOR_OF' AS rel, count(*) AS n FROM director UNION ALL SELECT 'WON_CONTRACT', count(*) FROM won UNION ALL SELECT 'AWARDED_BY', count(*) FROM awarded UNION ALL SELECT 'OWNS', count(*) FROM owns""")
def relationship_counts(t: Tables) -> DataFrame:
    out = None
    for n, df in (("DIRECTOR_OF", t.director), ("WON_CONTRACT", t.won), ("AWARDED_BY", t.awarded), ("OWNS", t.owns)):
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("rel"), "n")
        out = one if out is None else out.union(one)
    return out


@query("ag04_sum_or_zero", """SELECT p.pol, CAST(count(w.contract) AS BIGINT) AS n, round(coalesce(sum(w.amount), 0), 4) AS total FROM politician p LEFT JOIN director d USING (pol) LEFT JOIN won w USING (comp) GROUP BY p.pol""")
def sum_or_zero(t: Tables) -> DataFrame:
    per_company = t.won.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"))
    per_person = t.director.join(per_company, "comp").groupBy("pol").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return t.politician.select("pol").join(per_person, "pol", "left").select("pol", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("total", F.lit(0.0)), 4).alias("total"))


@query("ag05_buyers", """SELECT w.comp, count(DISTINCT c.buyer) AS buyers, count(*) AS n, max_by(c.buyer, c.total) AS largest FROM won w JOIN contract c USING (contract) GROUP BY w.comp""")
def buyers(t: Tables) -> DataFrame:
    return t.won.join(t.contract, "contract").groupBy("comp").agg(F.count_distinct("buyer").alias("buyers"), F.count(F.lit(1)).alias("n"), F.max_by("buyer", "total").alias("largest"))


@query("ag07_collect", """SELECT party, count(DISTINCT state) AS n_states, list_sort(list(DISTINCT state)) AS states FROM politician GROUP BY party""")
def collect(t: Tables) -> DataFrame:
    return t.politician.groupBy("party").agg(F.count_distinct("state").alias("n_states"), F.sort_array(F.collect_set("state")).alias("states"))


@query("ag08_company_contracts", """SELECT w.comp, min(c.day) AS first_day, count(*) AS n, round(sum(w.amount), 4) AS total FROM won w JOIN contract c USING (contract) GROUP BY w.comp""")
def company_contracts(t: Tables) -> DataFrame:
    return t.won.join(t.contract, "contract").groupBy("comp").agg(F.min("day").alias("first_day"), F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 4).alias("total"))


@query("ag09_zscore_outliers", """SELECT comp, contract, round((amount - m) / s, 4) AS z FROM (SELECT *, avg(amount) OVER (PARTITION BY comp) AS m, stddev_samp(amount) OVER (PARTITION BY comp) AS s, count(*) OVER (PARTITION BY comp) AS n FROM won) WHERE n >= 3 AND s > 0 AND abs(amount - m) / s > 2.5""")
def zscore_outliers(t: Tables, sigma: float = 2.5) -> DataFrame:
    w = Window.partitionBy("comp")
    x = t.won.withColumns({"m": F.avg("amount").over(w), "s": F.stddev_samp("amount").over(w), "n": F.count(F.lit(1)).over(w)})
    return x.filter((F.col("n") >= 3) & (F.col("s") > 0) & (F.abs(F.col("amount") - F.col("m")) / F.col("s") > sigma)).select("comp", "contract", F.round((F.col("amount") - F.col("m")) / F.col("s"), 4).alias("z"))


@query("ag10_bid_spread", """SELECT comp, round(stddev_pop(amount), 3) AS sd, round(max(gap), 4) AS max_gap FROM (SELECT comp, amount, amount - lag(amount) OVER (PARTITION BY comp ORDER BY amount) AS gap FROM won) GROUP BY comp""")
def bid_spread(t: Tables) -> DataFrame:
    gap = F.col("amount") - F.lag("amount").over(Window.partitionBy("comp").orderBy("amount"))
    return t.won.select("comp", "amount", gap.alias("gap")).groupBy("comp").agg(F.round(F.stddev_pop("amount"), 3).alias("sd"), F.round(F.max("gap"), 4).alias("max_gap"))


@query("ag13_entropy", """, j AS (SELECT kind, hour(ts) // 6 AS part, count(*) AS n FROM event GROUP BY 1, 2), m AS (SELECT part, sum(n) AS n FROM j GROUP BY 1), tot AS (SELECT sum(n) AS n FROM j) SELECT round(-sum((j.n / tot.n) * log2(j.n / m.n)), 6) AS conditional_entropy FROM j JOIN m USING (part), tot""")
def entropy(t: Tables) -> DataFrame:
    j = t.event.groupBy("kind", F.floor(F.hour("ts") / 6).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    j = j.withColumns({"m": F.sum("n").over(Window.partitionBy("part")), "all": F.sum("n").over(Window.partitionBy())})
    return j.agg(F.round(-F.sum(F.col("n") / F.col("all") * F.log2(F.col("n") / F.col("m"))), 6).alias("conditional_entropy"))


@query("ag14_shared_addresses", """SELECT lower(trim(state)) AS address, count(*) AS n, list_sort(list(comp)) AS companies FROM company WHERE length(state) >= 5 GROUP BY 1 HAVING count(*) >= 3""")
def shared_addresses(t: Tables) -> DataFrame:
    return t.company.filter(F.length("state") >= 5).groupBy(F.lower(F.trim("state")).alias("address")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("comp")).alias("companies")).filter("n >= 3")


@query("ag15_directorships", """SELECT pol, count(DISTINCT comp) AS n FROM director GROUP BY pol HAVING count(DISTINCT comp) >= 2""")
def directorships(t: Tables, least: int = 2) -> DataFrame:
    return t.director.groupBy("pol").agg(F.count_distinct("comp").alias("n")).filter(F.col("n") >= least)


@query("ag16_count_of_groups", """SELECT n, count(*) AS persons FROM (SELECT pol, count(*) AS n FROM director GROUP BY pol) GROUP BY n""")
def count_of_groups(t: Tables) -> DataFrame:
    return t.director.groupBy("pol").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("persons"))


@query("ag17_degree_diversity", """SELECT id, count(*) AS degree, count(DISTINCT rel || left(neighbour, 1)) AS kinds FROM (SELECT 'p' || pol AS id, 'c' || comp AS neighbour, 'DIRECTOR_OF' AS rel FROM director UNION ALL SELECT 'c' || comp, 'p' || pol, 'DIRECTOR_OF' FROM director UNION ALL SELECT 'c' || src, 'c' || dst, 'OWNS' FROM owns UNION ALL SELECT 'c' || dst, 'c' || src, 'OWNS' FROM owns) GROUP BY id""")
def degree_diversity(t: Tables) -> DataFrame:
    return neighbours(t).groupBy("id").agg(F.count(F.lit(1)).alias("degree"), F.count_distinct(F.concat("rel", F.substring("neighbour", 1, 1))).alias("kinds"))


@query("ag20_mode", """SELECT pol, kind, n FROM (SELECT pol, kind, count(*) AS n, row_number() OVER (PARTITION BY pol ORDER BY count(*) DESC, min(event_id)) AS k FROM event GROUP BY pol, kind) WHERE k = 1""")
def mode(t: Tables) -> DataFrame:
    x = t.event.groupBy("pol", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))
    w = Window.partitionBy("pol").orderBy(F.col("n").desc(), "first")
    return x.withColumn("k", F.row_number().over(w)).filter("k = 1").select("pol", "kind", "n")


@query("ag22_source_summary", """SELECT source, count(*) AS n, count(DISTINCT lang) AS languages, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source""")
def source_summary(t: Tables) -> DataFrame:
    return t.raw("documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lang").alias("languages"), F.sum("n_chars").alias("chars"))


@query("ag26_events_by_day", """SELECT CAST(ts AS DATE) AS day, kind, count(*) AS n, round(sum(value), 3) AS total FROM event GROUP BY 1, 2""")
def events_by_day(t: Tables) -> DataFrame:
    return t.event.groupBy(F.to_date("ts").alias("day"), "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("ext_rollup", """SELECT a.ministry, year(c.day) AS year, count(*) AS n FROM awarded a JOIN contract c USING (contract) GROUP BY ROLLUP (a.ministry, year(c.day))""")
def rollup(t: Tables) -> DataFrame:
    return t.awarded.join(t.contract, "contract").rollup("ministry", F.year("day").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query("flt01_point_lookup", """SELECT pol, name, party FROM politician WHERE pol = 7""")
def point_lookup(t: Tables, pol: int = 7) -> DataFrame:
    return t.politician.filter(F.col("pol") == pol).select("pol", "name", "party")


@query("flt02_contains", """SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'bl')""")
def contains(t: Tables, part: str = "bl") -> DataFrame:
    return t.raw("part").filter(F.contains(F.lower("p_name"), F.lit(part))).select("p_partkey", "p_name")


@query("flt03_word_boundary", """SELECT doc_id FROM documents WHERE contains(lower(text), ' the ') OR starts_with(lower(text), 'the ') OR ends_with(lower(text), ' the')""")
def word_boundary(t: Tables, word: str = "the") -> DataFrame:
    x = F.lower("text")
    return t.raw("documents").filter(F.contains(x, F.lit(f" {word} ")) | F.startswith(x, F.lit(f"{word} ")) | F.endswith(x, F.lit(f" {word}"))).select("doc_id")


@query("flt04_array_any", """SELECT p_partkey FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda x: starts_with(x, 'b'))) > 0""")
def array_any(t: Tables) -> DataFrame:
    return t.raw("part").filter(F.exists(F.split("p_name", " "), lambda x: F.startswith(x, F.lit("b")))).select("p_partkey")


@query("flt06_cast_predicate", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) > 50""")
def cast_predicate(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return t.raw("events").filter(k > 50).select("event_id", k.alias("k"))


@query("flt08_date_range", """SELECT contract, day FROM contract WHERE day BETWEEN DATE '1996-01-01' AND DATE '1996-03-31'""")
def date_range(t: Tables) -> DataFrame:
    return t.contract.filter(F.col("day").between(F.lit("1996-01-01").cast("date"), F.lit("1996-03-31").cast("date"))).select("contract", "day")


@query("flt09_date_gap", """SELECT l_orderkey, l_linenumber, l_shipdate, CAST(abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS INTEGER) AS gap FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) <= 30""")
def date_gap(t: Tables, days: int = 30) -> DataFrame:
    gap = F.abs(F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")))
    return t.raw("lineitem").join(t.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey")).filter(gap <= days).select("l_orderkey", "l_linenumber", "l_shipdate", gap.alias("gap"))


@query("flt12_high_alert", """SELECT doc_id, n FROM (SELECT doc_id, CAST(len(list_filter(['license', 'token', 'idiot', 'scum', 'trash', 'public'], lambda k: contains(lower(text), k))) AS INTEGER) AS n FROM documents) WHERE n >= 2""")
def high_alert(t: Tables) -> DataFrame:
    words = F.array(*map(F.lit, ("license", "token", "idiot", "scum", "trash", "public")))
    return t.raw("documents").select("doc_id", F.lower("text").alias("x")).select("doc_id", F.size(F.filter(words, lambda k: F.contains(F.col("x"), k))).alias("n")).filter("n >= 2")


@query("flt13_tolerant_dates", """SELECT p_partkey, TRY_CAST(p_size || '' AS INTEGER) AS size FROM part WHERE TRY_CAST('2024-' || lpad(CAST(p_size AS VARCHAR), 2, '0') || '-01' AS DATE) IS NOT NULL""")
def tolerant_dates(t: Tables) -> DataFrame:
    day = F.try_to_timestamp(F.concat(F.lit("2024-"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit("-01")), F.lit("yyyy-MM-dd"))
    return t.raw("part").filter(day.isNotNull()).select("p_partkey", F.col("p_size").alias("size"))


@query("set_union_distinct", """SELECT state FROM politician UNION SELECT state FROM company""")
def set_union(t: Tables) -> DataFrame:
    return t.politician.select("state").union(t.company.select("state")).distinct()


@query("set_intersect_except", """SELECT state, 'both' AS side FROM (SELECT state FROM politician INTERSECT SELECT state FROM company) UNION ALL SELECT state, 'people' FROM (SELECT state FROM politician EXCEPT SELECT state FROM company)""")
def set_intersect(t: Tables) -> DataFrame:
    a, b = t.politician.select("state"), t.company.select("state")
    return a.intersect(b).withColumn("side", F.lit("both")).union(a.distinct().join(b, "state", "left_anti").withColumn("side", F.lit("people")))


@query("wn08_keep_first", """SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2""")
def keep_first(t: Tables) -> DataFrame:
    return t.raw("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
