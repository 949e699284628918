"""Fifteen investigators, their synthesis, the adversarial check, the debate and the layered investigation.

All investigators read one row of facts per person; their findings are one array, exploded once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import forensics, loaders
from plumbline.operators.detectors import risk_score
from plumbline.plans import registry
from plumbline.plans.registry import query
from plumbline.plans.tables import Tables

TOP_SCHEMES = 5


def facts(t: Tables) -> DataFrame:
    """One row a person: what their companies won, their own contracts, cases, audits, press, listings and detectors say."""
    won = t.won.groupBy("comp").agg(F.sum("amount").alias("total"), F.count(F.lit(1)).alias("n"))
    boards = t.director.join(won, "comp", "left").join(t.company.select("comp", "capital"), "comp")
    boards = boards.groupBy("pol").agg(F.sum("total").alias("won_total"), F.sum("n").alias("won_n"), F.count_distinct("comp").alias("companies"), F.count(F.when(F.col("capital") < 0, 1)).alias("inactive"))
    own = t.contract.groupBy(F.col("cust").alias("pol")).agg(F.count(F.lit(1)).alias("own"), F.count_distinct("buyer").alias("buyers"))
    cases = t.event.filter("kind = 'error'").groupBy("pol").agg(F.count(F.lit(1)).alias("cases"))
    audits = t.raw("documents").join(t.raw("labels").select("doc_id"), "doc_id").select(F.expr("doc_id div 2").alias("pol"), "source", F.col("n_chars").alias("amount"))
    schemes = t.raw("documents").join(t.raw("labels").filter("toxic = 1").select("doc_id"), "doc_id").filter("source is not null").groupBy("source").agg(F.sum("n_chars").alias("s")).orderBy(F.col("s").desc(), "source").limit(TOP_SCHEMES)
    audited = audits.join(schemes.select("source", F.lit(1).alias("top")), "source", "left").groupBy("pol").agg(F.sum("amount").alias("audited"), F.count("top").alias("top_schemes"))
    press = t.raw("benchmark").groupBy(F.col("item_id").alias("pol")).agg(F.count(F.lit(1)).alias("press"))
    listed = lambda df, name: df.select(F.substring("src", 2, 30).cast("long").alias("pol")).distinct().withColumn(name, F.lit(1))
    detectors = (
        forensics.affidavit(t).select("pol", "kalman"),
        forensics.benami(t).select("pol", F.col("level").alias("benami")),
        forensics.periodicity(t).select("pol", F.col("level").alias("period")),
    )
    # the parts meet in one grouping by person, not in a join each; each is dealt anew, to one partition more than it has been grouped in,
    # or else Spark would compute the same person's parts in one task, with the memory of all
    n = int(t.spark.conf.get("spark.sql.shuffle.partitions")) + 1
    parts = [p.repartition(n, "pol") for p in (boards, own, cases, audited, press, listed(loaders.offshore(t), "offshore"), listed(loaders.sanctioned(t), "sanctioned"), *detectors)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    known = every.groupBy("pol").agg(*[F.max(c).alias(c) for c in every.columns if c != "pol"])
    x = t.politician.select("pol", "party", "assets").join(known, "pol", "left")
    return x.fillna(0, ["won_total", "won_n", "companies", "inactive", "own", "buyers", "cases", "audited", "top_schemes", "press", "offshore", "sanctioned"])


_D = registry.ORACLES
FACTS = f""", wn AS (SELECT comp, sum(amount) AS total, count(*) AS n FROM won GROUP BY comp), bo AS (SELECT pol, sum(total) AS won_total, sum(n) AS won_n, count(DISTINCT comp) AS companies, sum(CASE WHEN capital < 0 THEN 1 ELSE 0 END) AS inactive FROM director LEFT JOIN wn USING (comp) JOIN company USING (comp) GROUP BY pol), ow AS (SELECT cust AS pol, count(*) AS own, count(DISTINCT buyer) AS buyers FROM contract GROUP BY cust), cs AS (SELECT pol, count(*) AS cases FROM event WHERE kind = 'error' GROUP BY pol), sch AS (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND source IS NOT NULL GROUP BY source ORDER BY sum(n_chars) DESC, source LIMIT {TOP_SCHEMES}), au AS (SELECT doc_id // 2 AS pol, sum(n_chars) AS audited, sum(CASE WHEN source IN (SELECT source FROM sch) THEN 1 ELSE 0 END) AS top_schemes FROM documents JOIN labels USING (doc_id) GROUP BY 1), pr AS (SELECT item_id AS pol, count(*) AS press FROM benchmark GROUP BY 1), ofs AS (SELECT DISTINCT CAST(substr(src, 2) AS BIGINT) AS pol FROM ({_D['ld16_associated_with']})), san AS (SELECT DISTINCT CAST(substr(src, 2) AS BIGINT) AS pol FROM ({_D['ld17_associated_with']})), kal AS ({_D['dt10_affidavit']}), ben AS ({_D['dt09_benami']}), per AS ({_D['dt17_periodicity']}), x AS (SELECT p.pol, p.assets, coalesce(won_total, 0) AS won_total, coalesce(won_n, 0) AS won_n, coalesce(companies, 0) AS companies, coalesce(inactive, 0) AS inactive, coalesce(own, 0) AS own, coalesce(buyers, 0) AS buyers, coalesce(cases, 0) AS cases, coalesce(audited, 0) AS audited, coalesce(top_schemes, 0) AS top_schemes, coalesce(press, 0) AS press, ofs.pol IS NOT NULL AS offshore, san.pol IS NOT NULL AS sanctioned, kalman, ben.level AS benami, per.level AS period FROM politician p LEFT JOIN bo USING (pol) LEFT JOIN ow USING (pol) LEFT JOIN cs USING (pol) LEFT JOIN au USING (pol) LEFT JOIN pr USING (pol) LEFT JOIN ofs ON ofs.pol = p.pol LEFT JOIN san ON san.pol = p.pol LEFT JOIN kal ON kal.pol = p.pol LEFT JOIN ben ON ben.pol = p.pol LEFT JOIN per ON per.pol = p.pol)"""

#: The rules: investigator, type, severity and condition, in SQL that both engines read.
RULES = (
    ("financial", "CONTRACTS", "HIGH", "won_total > 100000"),
    ("financial", "AUDIT", "HIGH", "audited > 5000"),
    ("political", "CASES", "MODERATE", "cases > 0"),
    ("corporate", "DIRECTORSHIPS", "HIGH", "companies > 5"),
    ("corporate", "DIRECTORSHIPS", "MODERATE", "companies <= 5 AND inactive > 0"),
    ("judicial", "CASES", "HIGH", "cases >= 3"),
    ("procurement", "CONTRACTS", "HIGH", "buyers = 1 AND own >= 3"),
    ("network", "DIRECTORSHIPS", "MODERATE", "companies >= 2 AND own > 0"),
    ("international", "OFFSHORE", "HIGH", "offshore_"),
    ("international", "OFFSHORE", "VERY_HIGH", "sanctioned_"),
    ("media", "AUDIT", "LOW", "press > 0"),
    ("historical", "CONTRACTS", "MODERATE", "won_n + own >= 2"),
    ("public_interest", "AUDIT", "MODERATE", "top_schemes > 0"),
    ("doubt", "GAPS", "LOW", "(CASE WHEN companies > 0 AND won_n = 0 THEN 1 ELSE 0 END) + (CASE WHEN own = 0 THEN 1 ELSE 0 END) + (CASE WHEN cases > 0 AND audited = 0 THEN 1 ELSE 0 END) >= 2"),
    ("asset", "WEALTH", "LOW", "assets > 9000"),
    ("affidavit", "WEALTH", "VERY_HIGH", "kalman = 'VERY_HIGH'"),
    ("affidavit", "WEALTH", "HIGH", "kalman = 'HIGH'"),
    ("benami", "DIRECTORSHIPS", "HIGH", "benami = 'HIGH'"),
    ("benami", "DIRECTORSHIPS", "MODERATE", "benami = 'MODERATE'"),
    ("math", "CONTRACTS", "MODERATE", "period IN ('HIGH', 'MODERATE')"),
)
#: What speaks for a person.
POSITIVE = (("corporate", "companies BETWEEN 1 AND 3 AND inactive = 0"), ("procurement", "buyers >= 3 AND own >= 5"))


def _spark(rule: str) -> str:
    return rule.replace("offshore_", "offshore = 1").replace("sanctioned_", "sanctioned = 1")


def _duck(rule: str) -> str:
    return rule.replace("offshore_", "offshore").replace("sanctioned_", "sanctioned")


def findings(t: Tables) -> DataFrame:
    """pol, investigator, type, severity and positives (how many findings speak for the person)."""
    hit = [F.when(F.expr(_spark(rule)), F.struct(F.lit(who).alias("investigator"), F.lit(kind).alias("type"), F.lit(severity).alias("severity"))) for who, kind, severity, rule in RULES]
    positive = sum((F.expr(rule).cast("int") for _, rule in POSITIVE[1:]), F.expr(POSITIVE[0][1]).cast("int"))
    found = facts(t).select("pol", positive.alias("positives"), F.explode(F.array_compact(F.array(*hit))).alias("f"))
    return found.select("pol", "f.investigator", "f.type", "f.severity", "positives")


FINDINGS = FACTS + ", f AS (" + " UNION ALL ".join(f"SELECT pol, '{who}' AS investigator, '{kind}' AS type, '{severity}' AS severity, " + " + ".join(f"CASE WHEN {r} THEN 1 ELSE 0 END" for _, r in POSITIVE) + f" AS positives FROM x WHERE {_duck(rule)}" for who, kind, severity, rule in RULES) + ")"


@query("dt23_findings", FINDINGS + " SELECT pol, investigator, type, severity, CAST(positives AS INTEGER) AS positives FROM f")
def q_findings(t: Tables) -> DataFrame:
    return findings(t)


def synthesise(found: DataFrame, least: int = 2) -> DataFrame:
    """Findings that several investigators share: HIGH from three on, else MODERATE."""
    votes = found.groupBy("pol", "type").agg(F.count_distinct("investigator").alias("votes"), F.sort_array(F.collect_set("investigator")).alias("investigators"))
    return votes.filter(F.col("votes") >= least).withColumn("confidence", F.when(F.col("votes") >= 3, "HIGH").otherwise("MODERATE"))


SYNTHESIS = " SELECT pol, type, count(DISTINCT investigator) AS votes, list_sort(list(DISTINCT investigator)) AS investigators, CASE WHEN count(DISTINCT investigator) >= 3 THEN 'HIGH' ELSE 'MODERATE' END AS confidence FROM f GROUP BY pol, type HAVING count(DISTINCT investigator) >= 2"


@query("dt24_synthesis", FINDINGS + SYNTHESIS)
def q_synthesis(t: Tables) -> DataFrame:
    return synthesise(findings(t))


#: Chance that a counter-explanation holds, by severity.
CONTRA = {"LOW": 0.45, "MODERATE": 0.30, "HIGH": 0.15}


def contra(severity: Column, evidence: Column) -> Column:
    """The chance of a counter-explanation: by severity, .15 more for each piece of counter-evidence up to .4, at most .9."""
    out = F.lit(0.25)
    for name, value in CONTRA.items():
        out = F.when(severity == name, value).otherwise(out)
    return F.least(F.lit(0.9), out + F.least(F.lit(0.4), 0.15 * evidence))


_VERDICT = "CASE WHEN ratio >= 3 THEN 'SUPPORTED' WHEN ratio >= 1.5 THEN 'LIKELY' WHEN ratio >= 0.8 THEN 'CONTESTED' ELSE 'WEAK' END"


@query("dt25_adversarial", FINDINGS + f", c AS (SELECT *, least(0.9, CASE severity WHEN 'LOW' THEN 0.45 WHEN 'MODERATE' THEN 0.30 WHEN 'HIGH' THEN 0.15 ELSE 0.25 END + least(0.4, 0.15 * positives)) AS c FROM f), r AS (SELECT *, CAST(greatest(0.1, 1 - 0.4 * c) AS DOUBLE) / CAST(c AS DOUBLE) AS ratio FROM c), v AS (SELECT *, {_VERDICT} AS verdict FROM r), m AS (SELECT pol, verdict, row_number() OVER (PARTITION BY pol ORDER BY count(*) DESC, verdict) AS k FROM v GROUP BY pol, verdict) SELECT v.pol, investigator, type, round(ratio, 4) AS ratio, v.verdict, m.verdict AS overall FROM v JOIN m ON m.pol = v.pol AND m.k = 1")
def adversarial(t: Tables) -> DataFrame:
    """Each finding against its counter-explanation, and the verdict that most findings of the person get."""
    c = contra(F.col("severity"), F.col("positives"))
    x = findings(t).withColumn("ratio", F.greatest(F.lit(0.1), 1 - 0.4 * c) / c).withColumn("verdict", F.expr(_VERDICT))
    own = Window.partitionBy("pol")
    x = x.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("pol", "verdict")))
    overall = F.min(F.struct(-F.col("_n"), F.col("verdict").alias("verdict"))).over(own)["verdict"]
    return x.select("pol", "investigator", "type", F.round("ratio", 4).alias("ratio"), "verdict", overall.alias("overall"))


#: The agents of the debate in their order, with their scepticism; who sits at a simple and at a moderate table.
AGENTS = (("logical_analyst", 0.4), ("skeptic", 0.9), ("pattern_hunter", 0.3), ("timeline_analyst", 0.4), ("financial_analyst", 0.5), ("contrarian", 0.8), ("risk_analyst", 0.3))
TABLES_OF = {"simple": ("logical_analyst", "skeptic", "risk_analyst"), "moderate": ("logical_analyst", "skeptic", "pattern_hunter", "financial_analyst", "risk_analyst"), "complex": tuple(a for a, _ in AGENTS)}
ROUNDS, DRIFT, PRESSURE = 3, 0.85, 0.12


@query("dt26_debate")
def debate(t: Tables) -> DataFrame:
    """Three rounds of agents over a person's findings. All that the rounds depend on is the table and the number of grave findings (0, 1
    or 2 and more), so they are played once for each of these and joined to the people."""
    high = F.count(F.when(F.col("severity").isin("HIGH", "VERY_HIGH"), 1))
    cases = findings(t).groupBy("pol").agg(F.count(F.lit(1)).alias("n"), F.least(high, F.lit(2)).cast("int").alias("high"))
    complexity = F.when((F.col("n") <= 1) & (F.col("high") == 0), "simple").when((F.col("high") >= 2) | (F.col("n") >= 4), "complex").otherwise("moderate")
    cases = cases.select("pol", complexity.alias("complexity"), "high")
    rows = [(c, h, k, a, s) for c, seats in TABLES_OF.items() for h in range(3) for k, (a, s) in enumerate(AGENTS) if a in seats]
    x = t.spark.createDataFrame(rows, "complexity string, high int, seat int, agent string, scepticism double")
    verdict = F.when(F.col("agent").isin("skeptic", "contrarian"), "REQUIRES_FURTHER_EVIDENCE").when(F.col("agent") == "risk_analyst", F.when(F.col("high") >= 1, "ELEVATED_RISK").otherwise("LOW_RISK")).otherwise(F.when(F.col("high") >= 1, "FINDINGS_SUPPORTED").otherwise("INCONCLUSIVE"))
    table = Window.partitionBy("complexity", "high")
    x = x.withColumn("verdict", verdict).withColumn("agents", F.count(F.lit(1)).over(table)).withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("complexity", "high", "verdict")))
    dissent = F.col("agents") - F.col("same") > F.floor(F.col("agents") / 2)
    step = F.when(dissent, F.when(F.col("scepticism") < 0.5, 0.05).otherwise(-0.03)).otherwise(0.03)
    x = x.withColumn("confidence", F.round(F.when(F.col("high") >= 2, 0.7).otherwise(0.5) * (1 - F.col("scepticism") * 0.3), 3))
    for k in range(1, ROUNDS + 1):
        x = x.withColumn("confidence", F.round(F.least(F.lit(0.95), F.greatest(F.lit(0.05), F.col("confidence") + step)), 3))
        x = x.withColumn("drift", F.round(F.greatest(F.lit(0.0), 1 - 5 * F.stddev_pop("confidence").over(table)), 3))
        if k < ROUNDS:
            pressed = (F.col("drift") > DRIFT) & F.col("agent").isin("skeptic", "contrarian")
            x = x.withColumn("confidence", F.when(pressed, F.greatest(F.lit(0.05), F.col("confidence") - PRESSURE)).otherwise(F.col("confidence")))
    # the most common verdict, the first seen of equal ones
    top = F.min(F.struct((-F.col("same")).alias("same"), "seat", "verdict"))
    dissents = F.count(F.when(dissent & F.col("agent").isin("skeptic", "contrarian"), 1))
    s = x.groupBy("complexity", "high").agg(top.alias("top"), F.first("agents").alias("agents"), F.avg("confidence").alias("c"), F.max("drift").alias("drift"), dissents.alias("dissents"))
    rate = -F.col("top.same") / F.col("agents")
    overall = F.when((rate >= 0.8) & (F.col("c") >= 0.6), "STRONG_CONSENSUS").when(rate >= 0.6, "MODERATE_CONSENSUS").when(rate >= 0.4, "WEAK_CONSENSUS").otherwise("NO_CONSENSUS")
    s = s.select("complexity", "high", F.col("top.verdict").alias("verdict"), "agents", F.round(rate, 3).alias("agreement"), F.round("c", 3).alias("confidence"), "drift", "dissents", overall.alias("overall"))
    # nine rows
    return cases.join(F.broadcast(s), ["complexity", "high"]).drop("high")


_LAYERS = "l AS (SELECT DISTINCT pol, 1 AS layer FROM director UNION SELECT DISTINCT a.pol, 2 FROM director a JOIN director b ON a.comp = b.comp AND a.pol <> b.pol UNION SELECT DISTINCT pol, 3 FROM f UNION SELECT pol, 4 FROM event UNION SELECT cust, 4 FROM contract UNION SELECT pol, 5 FROM director GROUP BY pol HAVING count(*) >= 2 UNION SELECT pol, 6 FROM (SELECT DISTINCT pol, 'd' AS s FROM director UNION SELECT cust, 'c' FROM contract UNION SELECT pol, 'e' FROM event) GROUP BY pol HAVING count(*) >= 2)"


@query("dt22_layers", FINDINGS + f", {_LAYERS} SELECT pol, count(*) AS layers, CASE WHEN count(*) >= 4 THEN 85 WHEN count(*) >= 2 THEN 55 ELSE 25 END AS confidence FROM l WHERE pol IN (SELECT pol FROM politician) GROUP BY pol")
def layers(t: Tables) -> DataFrame:
    """Six layers: relations, second steps, patterns, timeline, influence, different sources; confidence by how many have data."""
    shared = t.director.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("comp")
    boards = t.director.groupBy("pol").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    own, events = t.contract.select(F.col("cust").alias("pol")), t.event.select("pol")
    sources = t.director.select("pol", F.lit("d").alias("s")).union(own.withColumn("s", F.lit("c"))).union(events.withColumn("s", F.lit("e"))).groupBy("pol").agg(F.count_distinct("s").alias("n")).filter("n >= 2")
    parts = (t.director, t.director.join(shared, "comp", "left_semi"), findings(t), own.union(events), boards, sources)
    out = None
    for k, df in enumerate(parts, 1):
        one = df.select("pol", F.lit(k).alias("layer"))
        out = one if out is None else out.union(one)
    n = out.join(t.politician.select("pol"), "pol", "left_semi").groupBy("pol").agg(F.count_distinct("layer").alias("layers"))
    return n.withColumn("confidence", F.when(F.col("layers") >= 4, 85).when(F.col("layers") >= 2, 55).otherwise(25))


@query("dt36_dossier", FINDINGS + f", syn AS ({SYNTHESIS}), rk AS ({_D['dt01_risk_score']}), tl AS (SELECT pol, count(*) AS n FROM event GROUP BY pol) SELECT rk.pol, rk.score, rk.level, coalesce(s.n, 0) AS shared, coalesce(s.types, []) AS types, coalesce(tl.n, 0) AS events, sha256(rk.pol || '|' || rk.score || '|' || rk.level || '|' || coalesce(array_to_string(s.types, ','), '')) AS hash FROM rk LEFT JOIN (SELECT pol, count(*) AS n, list_sort(list(type)) AS types FROM syn GROUP BY pol) s ON s.pol = rk.pol LEFT JOIN tl ON tl.pol = rk.pol")
def dossier(t: Tables) -> DataFrame:
    """A person's report: risk, shared findings, size of the timeline, and the hash to verify it by."""
    shared = synthesise(findings(t)).groupBy("pol").agg(F.count(F.lit(1)).alias("shared"), F.sort_array(F.collect_list("type")).alias("types"))
    events = t.event.groupBy("pol").agg(F.count(F.lit(1)).alias("events"))
    x = risk_score(t).join(shared, "pol", "left").join(events, "pol", "left")
    types = F.coalesce("types", F.array().cast("array<string>"))
    digest = forensics.report_hash(F.col("pol"), F.col("score"), F.col("level"), F.array_join(types, ","))
    return x.select("pol", "score", "level", F.coalesce("shared", F.lit(0)).alias("shared"), types.alias("types"), F.coalesce("events", F.lit(0)).alias("events"), digest.alias("hash"))
