"""Search: an inverted index with BM25, label scans, variants, type filters."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.plans.registry import query
from plumbline.plans.tables import Tables

K1, B = 1.2, 0.75


def bm25(index: DataFrame, lengths: DataFrame, words: list[str]) -> DataFrame:
    """index: (doc_id, w, n) rows; only the query's postings are read past the filter."""
    n = lengths.agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("mean"))
    postings = index.filter(F.col("w").isin(words))
    df = postings.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    x = postings.join(df, "w").join(lengths, "doc_id").crossJoin(F.broadcast(n))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("n") * (K1 + 1) / (F.col("n") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return x.groupBy("doc_id").agg(F.round(F.sum(idf * tf), 6).alias("score"))


def entries(t: Tables) -> DataFrame:
    """label, id and text of everything that can be searched: every label's name and descriptive fields."""
    one = lambda df, label, key, *fields: df.select(F.lit(label).alias("label"), F.col(key).cast("string").alias("id"), F.concat_ws(" ", *fields).alias("text"))
    parts = [
        one(t.politician, "Politician", "pol", "name", "party", "state"),
        one(t.company, "Company", "comp", "name", "state"),
        one(t.raw("documents"), "AuditReport", "doc_id", "text"),
        one(t.raw("benchmark"), "PressRelease", "item_id", "text"),
        one(t.raw("part"), "RegulatoryOrder", "p_partkey", "p_name", "p_brand", "p_type"),
        one(t.raw("pages"), "DataGovDocument", "page_id", "url"),
        one(t.nation, "LocalBody", "n_nationkey", "n_name"),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


def inverted_index(e: DataFrame) -> DataFrame:
    """doc_id (struct of label and id), w, n and length: postings to write once and partition by word."""
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "")
    x = e.select(F.struct("label", "id").alias("doc_id"), words.alias("ws")).filter(F.size("ws") > 0)
    return x.select("doc_id", F.size("ws").alias("length"), F.explode("ws").alias("w")).groupBy("doc_id", "length", "w").agg(F.count(F.lit(1)).alias("n"))


_ENTRIES = "e AS (SELECT 'Politician' AS label, CAST(pol AS VARCHAR) AS id, name || ' ' || party || ' ' || state AS text FROM politician UNION ALL SELECT 'Company', CAST(comp AS VARCHAR), name || ' ' || state FROM company UNION ALL SELECT 'AuditReport', CAST(doc_id AS VARCHAR), text FROM documents UNION ALL SELECT 'PressRelease', CAST(item_id AS VARCHAR), text FROM benchmark UNION ALL SELECT 'RegulatoryOrder', CAST(p_partkey AS VARCHAR), p_name || ' ' || p_brand || ' ' || p_type FROM part UNION ALL SELECT 'DataGovDocument', CAST(page_id AS VARCHAR), url FROM pages UNION ALL SELECT 'LocalBody', CAST(n_nationkey AS VARCHAR), n_name FROM nation)"


@query("se01_full_text", f""", {_ENTRIES}, w AS (SELECT label, id, unnest(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')) AS w FROM e), i AS (SELECT label, id, w, count(*) AS n FROM w GROUP BY 1, 2, 3), l AS (SELECT label, id, count(*) AS length FROM w GROUP BY 1, 2), m AS (SELECT count(*) AS docs, avg(length) AS mean FROM l), f AS (SELECT w, count(*) AS df FROM i WHERE w IN ('nation_3', 'steel', 'the', 'building') GROUP BY 1) SELECT label, id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM i JOIN f USING (w) JOIN l USING (label, id), m GROUP BY label, id ORDER BY score DESC, label, id LIMIT 20""")
def full_text(t: Tables, words: tuple[str, ...] = ("nation_3", "steel", "the", "building")) -> DataFrame:
    """Ranked search over all labels; only the words' postings are grouped."""
    e = entries(t)
    split = F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "")
    x = e.select(F.struct("label", "id").alias("doc_id"), split.alias("ws")).filter(F.size("ws") > 0)
    lengths = x.select("doc_id", F.size("ws").alias("length"))
    wanted = F.array(*map(F.lit, words))
    index = x.select("doc_id", F.explode(F.filter("ws", lambda w: F.array_contains(wanted, w))).alias("w")).groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("n"))
    return bm25(index, lengths, list(words)).select("doc_id.label", "doc_id.id", "score").orderBy(F.col("score").desc(), "label", "id").limit(20)


#: Searchable labels and the publishers of their records.
SOURCE_MAP = {
    "Politician": "Election Commission of India / MyNeta",
    "Company": "Ministry of Corporate Affairs",
    "AuditReport": "Comptroller and Auditor General",
    "Contract": "Government e-Marketplace",
    "Ministry": "Government of India",
    "Party": "Election Commission of India",
    "Scheme": "NITI Aayog / Ministries",
    "PressRelease": "Press Information Bureau",
    "NGO": "NGO Darpan / NITI Aayog",
    "ElectoralBond": "Election Commission of India",
    "InsolvencyOrder": "Insolvency and Bankruptcy Board",
    "Tender": "Central Public Procurement Portal",
    "RegulatoryOrder": "Securities and Exchange Board of India",
    "EnforcementAction": "Enforcement Directorate",
    "ParliamentQuestion": "Lok Sabha Secretariat",
    "VigilanceCircular": "Central Vigilance Commission",
    "ICIJEntity": "ICIJ Offshore Leaks Database",
    "SanctionedEntity": "OpenSanctions",
    "CourtCase": "National Judicial Data Grid",
    "LocalBody": "Local Government Directory",
    "DataGovDocument": "data.gov.in",
    "CrimeReport": "National Crime Records Bureau",
}


def named_entries(t: Tables) -> DataFrame:
    """label, id and name: people, companies, ministries, parties, schemes, and the names of every loaded source."""
    from plumbline.operators import loaders

    one = lambda df, label, key, name: df.select(F.lit(label).alias("label"), F.col(key).cast("string").alias("id"), F.col(name).cast("string").alias("name"))
    parts = [one(t.politician, "Politician", "pol", "name"), one(t.company, "Company", "comp", "name"), one(t.awarded.select("ministry").distinct(), "Ministry", "ministry", "ministry"), one(t.politician.select("party").distinct(), "Party", "party", "party"), one(t.raw("documents").select("source").distinct(), "Scheme", "source", "source")]
    shown = {"ld05_press_releases": "title", "ld08_regulatory_orders": "title", "ld11_insolvency_orders": "company_name", "ld12_ngos": "name", "ld14_parliament_questions": "member", "ld15_vigilance_circulars": "title", "ld16_icij_entities": "name", "ld17_sanctioned_entities": "name", "ld19_local_bodies": "name", "ld22_datagov_documents": "url"}
    parts += [one(loaders.load(t, k), loaders.SOURCES[k][0], "id", v) for k, v in shown.items()]
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


def _named_sql() -> str:
    from plumbline.plans import registry

    shown = {"ld05_press_releases": "title", "ld08_regulatory_orders": "title", "ld11_insolvency_orders": "company_name", "ld12_ngos": "name", "ld14_parliament_questions": "member", "ld15_vigilance_circulars": "title", "ld16_icij_entities": "name", "ld17_sanctioned_entities": "name", "ld19_local_bodies": "name", "ld22_datagov_documents": "url"}
    parts = ["SELECT 'Politician' AS label, CAST(pol AS VARCHAR) AS id, name FROM politician", "SELECT 'Company', CAST(comp AS VARCHAR), name FROM company", "SELECT DISTINCT 'Ministry', ministry, ministry FROM awarded", "SELECT DISTINCT 'Party', party, party FROM politician", "SELECT DISTINCT 'Scheme', source, source FROM documents"]
    parts += [f"SELECT label, id, CAST({v} AS VARCHAR) FROM ({registry.ORACLES[k]})" for k, v in shown.items()]
    return " UNION ALL ".join(parts)


def scan(t: Tables, q: str, limit: int = 20) -> DataFrame:
    """Names that hold q: per label at most max(10, 2 limit / labels), names that start with it first."""
    own = max(10, 2 * limit // len(SOURCE_MAP))
    rank = [F.startswith(F.lower("name"), F.lit(q)).desc(), "name", "label", "id"]
    found = named_entries(t).filter(F.contains(F.lower("name"), F.lit(q)))
    return found.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy(*rank))).filter(F.col("k") <= own).drop("k").orderBy(*rank).limit(limit)


@query("se02_label_scan", f", e AS ({_named_sql()}), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY starts_with(lower(name), '00') DESC, name, label, id) AS k FROM e WHERE contains(lower(name), '00')) SELECT label, id, name FROM k WHERE k <= 10 ORDER BY starts_with(lower(name), '00') DESC, name, label, id LIMIT 20")
def label_scan(t: Tables, q: str = "00") -> DataFrame:
    return scan(t, q)


def resolve_type(kind: str) -> list[str]:
    """The labels that a type filter means: equal, else starting with it, else the same without one final s, else all."""
    k = kind.lower()
    for word in (k, k[:-1] if k.endswith("s") else k):
        for found in ([x for x in SOURCE_MAP if x.lower() == word], [x for x in SOURCE_MAP if x.lower().startswith(word)]):
            if found and word:
                return found
    return list(SOURCE_MAP)


@query("se03_type_filter", f"""SELECT label, q FROM (VALUES ('company'), ('contracts'), ('p'), ('nothing like it')) w(q), (SELECT unnest({list(SOURCE_MAP)}) AS label) l WHERE q = 'nothing like it' OR (q = 'company' AND label = 'Company') OR (q = 'contracts' AND label = 'Contract') OR (q = 'p' AND starts_with(label, 'P'))""")
def type_filter(t: Tables) -> DataFrame:
    rows = [(label, q) for q in ("company", "contracts", "p", "nothing like it") for label in resolve_type(q)]
    return t.spark.createDataFrame(rows, "label string, q string")


def variants_of(text: str, most: int = 3) -> list[str]:
    """The search variants of a query, the query itself first: lower case, without vowels, without doubled letters."""
    low = text.lower()
    out = [low, re.sub("[aeiou]", "", low), re.sub(r"(.)\1", r"\1", low)]
    return [v for k, v in enumerate(out) if v and v not in out[:k]][:most]


@query("se04_variants", f""", e AS ({_named_sql()}) SELECT DISTINCT label, id FROM e WHERE contains(lower(name), 'brand') OR contains(lower(name), 'brnd') OR contains(lower(name), 'steel') OR contains(lower(name), 'stl') OR contains(lower(name), 'stel')""")
def variants(t: Tables, queries: tuple[str, ...] = ("Brand", "Steel")) -> DataFrame:
    """Search by the first variants of each query over all labels, each entry once."""
    words = F.array(*[F.lit(v) for q in queries for v in variants_of(q)])
    return named_entries(t).filter(F.exists(words, lambda w: F.contains(F.lower("name"), w))).select("label", "id").distinct()


@query("se05_attribution", f", e AS ({_named_sql()}), m AS (SELECT unnest({list(SOURCE_MAP)}) AS label, unnest({list(SOURCE_MAP.values())}) AS source) SELECT label, source, count(e.id) AS n FROM m LEFT JOIN e USING (label) GROUP BY 1, 2")
def attribution(t: Tables) -> DataFrame:
    """Each label's publisher and how many entries it gives."""
    m = t.spark.createDataFrame(list(SOURCE_MAP.items()), "label string, source string")
    n = named_entries(t).groupBy("label").agg(F.count("id").alias("n"))
    return F.broadcast(m).join(n, "label", "left").select("label", "source", F.coalesce("n", F.lit(0)).alias("n"))
