"""Loaders: records of each source become nodes of a label, and edges to the nodes that they name.

A record without its key is skipped; a node's id is hashed from its key; of several records of
a node the last stays. Edges by name go through an index of character runs, not a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import canonical_id
from plumbline.plans.registry import query
from plumbline.plans.tables import Tables

ID = 32
#: Length of the character runs on which names and mentions meet.
RUN = 6
#: Rows of one run beyond which it is common.
HOT = 20_000


def runs(c: Column, length: Column) -> Column:
    """The different runs of that many characters."""
    n = F.length(c) - length + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(c, i, length)))).otherwise(F.array().cast("array<string>"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt to all shuffle partitions, before they are multiplied: as many as there are, however small the rows still are."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def contains_join(names: DataFrame, mentions: DataFrame, hot: int = HOT) -> DataFrame:
    """id and mid of the names (id, name) that hold a mention (mid, mention), ignoring case; blank mentions are in no name.

    Each mention is looked up by its rarest run of RUN characters (of all its characters if it is shorter) among the names' runs, and
    the pairs that meet are tested: the work follows the rarest run, whatever runs are common. Runs of more than `hot` mentions or names
    are few: their counts come to the mentions by broadcast, and the names that have them are dealt to places of `hot` names each."""
    n = spread(names.select("id", F.lower("name").alias("name")), "id")
    m = spread(mentions.select("mid", F.lower(F.trim("mention")).alias("mention")).filter("mention <> ''"), "mid")
    m = m.withColumn("length", F.least(F.length("mention"), F.lit(RUN)))
    # at most RUN lengths
    lengths = F.broadcast(m.select("length").distinct())
    index = n.crossJoin(lengths).select("id", "name", "length", F.explode(runs(F.col("name"), F.col("length"))).alias("run"))
    held = index.groupBy("length", "run").agg(F.count(F.lit(1)).alias("df"))
    wanted = m.select("mid", "mention", "length", F.explode(runs(F.col("mention"), F.col("length"))).alias("run"))
    common = wanted.groupBy("length", "run").agg(F.count(F.lit(1)).alias("asked")).filter(F.col("asked") > hot)
    common = common.join(held, ["length", "run"], "left").select("length", "run", F.coalesce("df", F.lit(0)).alias("known"))
    wanted = wanted.join(F.broadcast(common), ["length", "run"], "left")
    # rows whose count is known meet no run: their key is longer than any
    key = F.when(F.col("known").isNull(), F.col("run")).otherwise(F.concat_ws(" ", "run", "mid"))
    wanted = wanted.withColumn("key", key).join(held.withColumnRenamed("run", "key"), ["length", "key"], "left").select("mid", "mention", "length", "run", F.coalesce("known", "df", F.lit(0)).alias("df"))
    # a run that no name holds is the rarest: such a mention is in no name
    rarest = wanted.groupBy("mid", "mention", "length").agg(F.min(F.struct("df", "run")).alias("x")).filter("x.df > 0")
    places = lambda df: F.ceil(df / hot).cast("int")
    asked = rarest.select("mid", "mention", "length", F.col("x.run").alias("run"), F.explode(F.sequence(F.lit(0), places(F.col("x.df")) - 1)).alias("place"))
    # names of a common run that no mention is looked up by stay where they are
    chosen = rarest.select("length", F.col("x.run").alias("run"), F.lit(1).alias("chosen")).distinct()
    dealt = held.filter(F.col("df") > hot).join(chosen, ["length", "run"], "left").select("length", "run", F.when(F.col("chosen") == 1, places(F.col("df"))).otherwise(0).alias("k"))
    index = index.join(F.broadcast(dealt), ["length", "run"], "left").filter("k is null or k > 0").withColumn("place", F.pmod(F.xxhash64("id"), F.coalesce("k", F.lit(1))).cast("int")).drop("k")
    met = asked.join(index, ["length", "run", "place"])
    return met.filter(F.contains("name", F.col("mention"))).select("id", "mid").distinct()


def nodes(rows: DataFrame, keys: tuple[str, ...], order: str, fields: tuple[str, ...]) -> DataFrame:
    """id and fields of the nodes: records with a blank first key are skipped, the last record (by `order`) of an id stays."""
    kept = rows.filter(F.coalesce(F.trim(F.col(keys[0]).cast("string")), F.lit("")) != "")
    x = kept.select(canonical_id(*[F.col(k) for k in keys], size=ID).alias("id"), F.col(order).alias("_order"), *fields)
    return x.groupBy("id").agg(*[F.max_by(f, "_order").alias(f) for f in fields])


def _hash(keys: tuple[str, ...]) -> str:
    return "left(sha256(" + " || '|' || ".join(f"lower(trim(coalesce(CAST({k} AS VARCHAR), 'none')))" for k in keys) + f"), {ID})"


#: Records of each source over the tables, in SQL that both engines read: name -> (label, table, columns, key columns, order, fields).
SOURCES: dict[str, tuple[str, str, tuple[str, ...], tuple[str, ...], str, tuple[str, ...]]] = {
    "ld05_press_releases": ("PressRelease", "benchmark", ("'release ' || item_id AS title", "'item/' || item_id AS link", "item_id AS k", "length(text) AS chars"), ("title", "link"), "k", ("title", "chars")),
    "ld08_regulatory_orders": ("RegulatoryOrder", "part", ("p_name || ' ' || p_brand AS title", "p_type AS kind", "p_partkey AS k"), ("title",), "k", ("title", "kind")),
    "ld09_enforcement_actions": ("EnforcementAction", "orders", ("CASE WHEN o_orderstatus <> 'F' THEN '' ELSE 'action ' || o_orderkey END AS title", "o_orderkey AS k", "o_custkey AS accused", "o_totalprice AS amount"), ("title",), "k", ("accused", "amount")),
    "ld10_electoral_bonds": ("ElectoralBond", "orders", ("o_orderkey % 5000 AS bond_number", "o_custkey % 50 AS purchaser", "o_orderkey AS k", "o_totalprice AS denomination"), ("bond_number", "purchaser"), "k", ("bond_number", "denomination")),
    "ld11_insolvency_orders": ("InsolvencyOrder", "supplier", ("CASE WHEN s_acctbal < 2000 THEN s_name END AS company_name", "s_suppkey AS k", "s_acctbal AS claims"), ("company_name",), "k", ("company_name", "claims")),
    "ld12_ngos": ("NGO", "customer", ("coalesce(CASE WHEN c_custkey % 2 = 0 THEN 'D' || (c_custkey % 200) END, c_name) AS key", "c_name AS name", "c_custkey AS k"), ("key",), "k", ("name",)),
    "ld14_parliament_questions": ("ParliamentQuestion", "conversations", ("conv_id AS number", "'customer#' || lpad(CAST(conv_id % 90 AS STRING), 9, '0') AS member", "conv_id * 1000 + turn AS k", "role"), ("number", "member"), "k", ("member", "role")),
    "ld15_vigilance_circulars": ("VigilanceCircular", "region", ("coalesce(CASE WHEN r_regionkey % 2 = 0 THEN 'C' || r_regionkey END, r_name) AS key", "r_name AS title", "r_regionkey AS k"), ("key",), "k", ("title",)),
    "ld16_icij_entities": ("ICIJEntity", "part", ("coalesce(CASE WHEN p_size > 10 THEN 'N' || p_partkey END, p_name) AS key", "'omer#' || lpad(CAST(p_partkey AS STRING), 9, '0') AS name", "p_partkey AS k"), ("key",), "k", ("name",)),
    "ld17_sanctioned_entities": ("SanctionedEntity", "supplier", ("coalesce(CASE WHEN s_suppkey % 3 > 0 THEN 'S' || s_suppkey END, s_name) AS key", "'#' || lpad(CAST(s_suppkey * 7 AS STRING), 9, '0') AS name", "s_suppkey AS k"), ("key",), "k", ("name",)),
    "ld18_court_cases": ("CourtCase", "nation", ("n_name AS court", "2000 + n_regionkey AS year", "n_nationkey AS k", "n_nationkey * 3 AS pending"), ("court", "year"), "k", ("pending",)),
    "ld19_local_bodies": ("LocalBody", "nation", ("coalesce(CASE WHEN n_nationkey % 2 = 0 THEN 'LGD' || n_nationkey END, n_name) AS key", "n_name AS name", "n_nationkey AS k"), ("key",), "k", ("name",)),
    "ld20_crime_reports": ("CrimeReport", "orders", ("o_custkey % 25 AS state", "year(o_orderdate) AS year", "o_orderkey AS k", "o_orderpriority AS crime_head"), ("state", "year"), "k", ("state", "year", "crime_head")),
    "ld22_datagov_documents": ("DataGovDocument", "pages", ("coalesce(CASE WHEN page_id % 4 > 0 THEN 'R' || page_id END, url) AS key", "url", "page_id AS k"), ("key",), "k", ("url",)),
}


def records(t: Tables, name: str) -> DataFrame:
    _, table, columns, *_ = SOURCES[name]
    return t.raw(table).selectExpr(*columns)


def _records_sql(name: str) -> str:
    _, table, columns, *_ = SOURCES[name]
    return f"(SELECT {', '.join(columns)} FROM {table})"


def load(t: Tables, name: str) -> DataFrame:
    """The nodes of a source."""
    label, _, _, keys, order, fields = SOURCES[name]
    return nodes(records(t, name), keys, order, fields).withColumn("label", F.lit(label))


def _register(name: str) -> None:
    label, _, _, keys, order, fields = SOURCES[name]
    shown = ", ".join(f"arg_max({f}, {order}) AS {f}" for f in fields)

    @query(name, f"SELECT {_hash(keys)} AS id, {shown}, '{label}' AS label FROM {_records_sql(name)} WHERE trim(coalesce(CAST({keys[0]} AS VARCHAR), '')) <> '' GROUP BY 1")
    def q_load(t: Tables) -> DataFrame:
        return load(t, name)


for _name in SOURCES:
    _register(_name)


def edges_by_name(t: Tables, name: str, mention: str, people: bool, rel: str) -> DataFrame:
    """Edges from the people or companies whose name holds a record's mention to the record's node."""
    _, _, _, keys, *_ = SOURCES[name]
    rows = records(t, name).filter(F.coalesce(F.trim(F.col(keys[0]).cast("string")), F.lit("")) != "")
    found = rows.select(canonical_id(*[F.col(k) for k in keys], size=ID).alias("dst"), F.col(mention).alias("mention")).distinct()
    who = t.politician.select(F.concat(F.lit("p"), "pol").alias("id"), "name") if people else t.company.select(F.concat(F.lit("c"), "comp").alias("id"), "name")
    mentions = found.select("mention").distinct().select(F.col("mention").alias("mid"), "mention")
    met = contains_join(who, mentions)
    return found.withColumnRenamed("mention", "mid").join(met, "mid").select(F.col("id").alias("src"), "dst", F.lit(rel).alias("rel")).distinct()


def _edges_sql(name: str, mention: str, people: bool, rel: str) -> str:
    keys = SOURCES[name][3]
    who = "SELECT 'p' || pol AS id, name FROM politician" if people else "SELECT 'c' || comp AS id, name FROM company"
    return f"SELECT DISTINCT w.id AS src, r.dst, '{rel}' AS rel FROM (SELECT {_hash(keys)} AS dst, {mention} AS mention FROM {_records_sql(name)} WHERE trim(coalesce(CAST({keys[0]} AS VARCHAR), '')) <> '') r JOIN ({who}) w ON trim(r.mention) <> '' AND contains(lower(w.name), lower(trim(r.mention)))"


@query("ld11_has_insolvency", _edges_sql("ld11_insolvency_orders", "company_name", False, "HAS_INSOLVENCY"))
def has_insolvency(t: Tables) -> DataFrame:
    return edges_by_name(t, "ld11_insolvency_orders", "company_name", False, "HAS_INSOLVENCY")


@query("ld14_asked_question", _edges_sql("ld14_parliament_questions", "member", True, "ASKED_QUESTION"))
def asked_question(t: Tables) -> DataFrame:
    return edges_by_name(t, "ld14_parliament_questions", "member", True, "ASKED_QUESTION")


@query("ld16_associated_with", _edges_sql("ld16_icij_entities", "name", True, "ASSOCIATED_WITH"))
def offshore(t: Tables) -> DataFrame:
    return edges_by_name(t, "ld16_icij_entities", "name", True, "ASSOCIATED_WITH")


@query("ld17_associated_with", _edges_sql("ld17_sanctioned_entities", "name", True, "ASSOCIATED_WITH"))
def sanctioned(t: Tables) -> DataFrame:
    return edges_by_name(t, "ld17_sanctioned_entities", "name", True, "ASSOCIATED_WITH")


@query("ld09_subject_of", f"SELECT DISTINCT 'p' || p.pol AS src, {_hash(('title',))} AS dst, 'SUBJECT_OF' AS rel FROM {_records_sql('ld09_enforcement_actions')} r JOIN politician q ON q.pol = r.accused JOIN politician p ON p.name = q.name WHERE trim(title) <> ''")
def subject_of(t: Tables) -> DataFrame:
    """Accused people by the part of their name that the record gives."""
    accused = t.politician.select(F.col("pol").alias("accused"), F.upper(F.substring("name", 4, 100)).alias("mention"))
    rows = records(t, "ld09_enforcement_actions").filter("trim(title) <> ''").join(accused, "accused").select(canonical_id(F.col("title"), size=ID).alias("dst"), "mention").distinct()
    who = t.politician.select(F.concat(F.lit("p"), "pol").alias("id"), "name")
    met = contains_join(who, rows.select(F.col("mention").alias("mid"), "mention").distinct())
    return rows.withColumnRenamed("mention", "mid").join(met, "mid").select(F.col("id").alias("src"), "dst", F.lit("SUBJECT_OF").alias("rel")).distinct()


@query("ld10_bond_edges", f"SELECT DISTINCT {_hash(('purchaser',))} AS src, {_hash(('bond_number', 'purchaser'))} AS dst, 'DONATED_VIA' AS rel FROM {_records_sql('ld10_electoral_bonds')} UNION SELECT {_hash(('bond_number', 'purchaser'))}, {_hash(('party',))}, 'REDEEMED_BY' FROM (SELECT o_orderkey % 5000 AS bond_number, o_custkey % 50 AS purchaser, c_mktsegment AS party FROM orders JOIN customer ON o_custkey = c_custkey)")
def bond_edges(t: Tables) -> DataFrame:
    """Company to bond, and bond to the party that redeemed it."""
    rows = t.raw("orders").join(t.raw("customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"), "left")
    rows = rows.selectExpr("o_orderkey % 5000 bond_number", "o_custkey % 50 purchaser", "c_mktsegment party")
    bond = canonical_id(F.col("bond_number"), F.col("purchaser"), size=ID)
    given = rows.select(canonical_id(F.col("purchaser"), size=ID).alias("src"), bond.alias("dst"), F.lit("DONATED_VIA").alias("rel"))
    return given.union(rows.filter("party <> ''").select(bond, canonical_id(F.col("party"), size=ID), F.lit("REDEEMED_BY"))).distinct()


_AUDIT = "(SELECT d.doc_id, 'report ' || (d.doc_id // 2) AS title, 'doc/' || (d.doc_id // 3) AS url, d.source AS scheme, CAST(d.n_chars AS DOUBLE) AS amount FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def audit_records(t: Tables) -> DataFrame:
    d = t.raw("documents").join(t.raw("labels").select("doc_id"), "doc_id")
    return d.selectExpr("doc_id", "'report ' || (doc_id div 2) title", "'doc/' || (doc_id div 3) url", "source scheme", "cast(n_chars as double) amount")


@query("ld04_audit_reports", f"SELECT {_hash(('title', 'url'))} AS id, arg_max(title, doc_id) AS title, arg_max(scheme, doc_id) AS scheme, arg_max(amount, doc_id) AS amount FROM {_AUDIT} GROUP BY 1")
def load_audits(t: Tables) -> DataFrame:
    return nodes(audit_records(t), ("title", "url"), "doc_id", ("title", "scheme", "amount"))


@query("ld04_flags", f"SELECT DISTINCT {_hash(('title', 'url'))} AS src, {_hash(('scheme',))} AS dst, 'FLAGS' AS rel FROM {_AUDIT} WHERE coalesce(scheme, '') <> ''")
def flags(t: Tables) -> DataFrame:
    rows = audit_records(t).filter("coalesce(scheme, '') <> ''")
    return rows.select(canonical_id(F.col("title"), F.col("url"), size=ID).alias("src"), canonical_id(F.col("scheme"), size=ID).alias("dst"), F.lit("FLAGS").alias("rel")).distinct()


_LINKS = "(SELECT p.pol, d.comp, CASE WHEN p.pol % 10 = 0 THEN upper(p.name) || ' JR' ELSE upper(p.name) END AS person, lower(c.name) AS firm, 0.72 + (p.pol % 25) / 100.0 AS score FROM director d JOIN politician p USING (pol) JOIN company c USING (comp))"


@query("ld06_links", f"SELECT coalesce('p' || p.pol, {_hash(('person',))}) AS src, coalesce('c' || c.comp, {_hash(('firm',))}) AS dst, round(max(score), 4) AS confidence, p.pol IS NULL AS created FROM {_LINKS} l LEFT JOIN politician p ON lower(p.name) = lower(l.person) LEFT JOIN company c ON lower(c.name) = lower(l.firm) GROUP BY 1, 2, 4")
def load_links(t: Tables) -> DataFrame:
    """DIRECTOR_OF with its score: the ends are the nodes of equal names, or new ones."""
    d = t.director.join(t.politician.select("pol", "name"), "pol").join(t.company.select("comp", F.lower("name").alias("firm")), "comp")
    person = F.when(F.col("pol") % 10 == 0, F.concat(F.upper("name"), F.lit(" JR"))).otherwise(F.upper("name"))
    rows = d.select(person.alias("person"), "firm", (0.72 + (F.col("pol") % 25) / 100.0).alias("score"))
    people = t.politician.select(F.concat(F.lit("p"), "pol").alias("pid"), F.lower("name").alias("pn"))
    firms = t.company.select(F.concat(F.lit("c"), "comp").alias("cid"), F.lower("name").alias("cn"))
    met = rows.join(people, F.lower("person") == F.col("pn"), "left").join(firms, F.lower("firm") == F.col("cn"), "left")
    src, dst = F.coalesce("pid", canonical_id(F.col("person"), size=ID)), F.coalesce("cid", canonical_id(F.col("firm"), size=ID))
    return met.groupBy(src.alias("src"), dst.alias("dst"), F.col("pid").isNull().alias("created")).agg(F.round(F.max("score"), 4).alias("confidence"))


@query("ld07_affidavits", """SELECT left(sha256(cust || '|' || year(day)), 32) AS id, 'p' || cust AS src, 'FILED_AFFIDAVIT' AS rel, CAST(year(day) AS INTEGER) AS year, round(sum(total) / 1e7, 6) AS crore FROM contract GROUP BY cust, year(day)""")
def load_affidavits(t: Tables) -> DataFrame:
    """Affidavit nodes, one a person and year, with the edge from the person."""
    y = t.contract.groupBy(F.col("cust").alias("pol"), F.year("day").alias("year")).agg(F.round(F.sum("total") / 1e7, 6).alias("crore"))
    return y.select(canonical_id(F.col("pol"), F.col("year"), size=ID).alias("id"), F.concat(F.lit("p"), "pol").alias("src"), F.lit("FILED_AFFIDAVIT").alias("rel"), "year", "crore")


@query("ld13_tenders", """SELECT left(sha256(CASE WHEN contract % 2 = 0 THEN 't' || contract ELSE 'tender ' || contract END), 32) AS id, left(sha256(lower(ministry)), 32) AS src, 'ISSUED_TENDER' AS rel, n = 1 AS single_bid, CASE WHEN n = 1 THEN 'SINGLE_BID' ELSE '' END AS risk_flag FROM awarded JOIN (SELECT contract, count(*) AS n FROM won GROUP BY contract) USING (contract)""")
def load_tenders(t: Tables) -> DataFrame:
    """Tender nodes by tender id, else title, with the edge from the ministry and the flag of a single bid."""
    bids = t.won.groupBy("contract").agg(F.count(F.lit(1)).alias("n"))
    tender = F.when(F.col("contract") % 2 == 0, F.concat(F.lit("T"), "contract"))
    x = t.awarded.join(bids, "contract")
    return x.select(canonical_id(F.coalesce(tender, F.concat(F.lit("Tender "), "contract")), size=ID).alias("id"), canonical_id(F.col("ministry"), size=ID).alias("src"), F.lit("ISSUED_TENDER").alias("rel"), (F.col("n") == 1).alias("single_bid"), F.when(F.col("n") == 1, "SINGLE_BID").otherwise("").alias("risk_flag"))


_WIKI = "(SELECT 'mer#' || lpad(CAST(n_nationkey * 3 AS STRING), 9, '0') AS item, ['Customer#' || lpad(CAST(n_nationkey AS STRING), 9, '0'), 'no one'] AS aliases, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS occupation FROM nation)"


@query("jn06_either_contains", f"SELECT DISTINCT p.pol, w.item FROM politician p JOIN {_WIKI} w ON contains(lower(p.name), lower(w.item)) OR contains(lower(w.item), lower(p.name)) OR list_contains(list_transform(w.aliases, lambda a: lower(a)), lower(p.name))")
def either_contains(t: Tables) -> DataFrame:
    """Names that hold an item's name, lie in it, or equal one of its aliases."""
    return _wiki_matches(t).select("pol", "item")


def _wiki(t: Tables) -> DataFrame:
    pad = lambda c: F.lpad(c.cast("string"), 9, "0")
    key = F.col("n_nationkey")
    return t.nation.select(F.concat(F.lit("mer#"), pad(key * 3)).alias("item"), F.array(F.concat(F.lit("Customer#"), pad(key)), F.lit("no one")).alias("aliases"), F.when(key % 2 == 0, F.col("n_name")).alias("occupation"))


def _wiki_matches(t: Tables) -> DataFrame:
    w = _wiki(t)
    people = t.politician.select("pol", "name")
    items = w.select(F.col("item").alias("mid"), F.col("item").alias("mention")).distinct()
    forth = contains_join(people.select(F.col("pol").alias("id"), "name"), items).select(F.col("id").alias("pol"), F.col("mid").alias("item"))
    back = contains_join(items.select(F.col("mid").alias("id"), F.col("mention").alias("name")), people.select(F.col("pol").alias("mid"), F.col("name").alias("mention"))).select(F.col("mid").alias("pol"), F.col("id").alias("item"))
    alias = w.select("item", F.explode("aliases").alias("a")).join(people, F.lower("a") == F.lower("name")).select("pol", "item")
    return forth.union(back).union(alias).distinct().join(w.select("item", "occupation"), "item")


@query("ld21_wikidata_enrichments", f"SELECT p.pol, coalesce(m.occupation, p.party) AS occupation FROM politician p LEFT JOIN (SELECT p.pol, max(w.occupation) AS occupation FROM politician p JOIN {_WIKI} w ON contains(lower(p.name), lower(w.item)) OR contains(lower(w.item), lower(p.name)) OR list_contains(list_transform(w.aliases, lambda a: lower(a)), lower(p.name)) GROUP BY p.pol) m ON m.pol = p.pol")
def enrichment(t: Tables) -> DataFrame:
    """Matched items overwrite what they have a value for."""
    found = _wiki_matches(t).groupBy("pol").agg(F.max("occupation").alias("occupation"))
    return t.politician.select("pol", "party").join(found, "pol", "left").select("pol", F.coalesce("occupation", "party").alias("occupation"))


#: The sources that a pipeline's bundle may hold, and their loaders.
DISPATCH = {name.split("_", 1)[1]: name for name in SOURCES}


@query("src12_bundle", " UNION ALL ".join(f"SELECT '{k}' AS source, count(*) AS records, count(DISTINCT {_hash(SOURCES[n][3])}) FILTER (WHERE trim(coalesce(CAST({SOURCES[n][3][0]} AS VARCHAR), '')) <> '') AS nodes FROM {_records_sql(n)}" for k, n in DISPATCH.items()))
def bundle(t: Tables) -> DataFrame:
    """The orchestrated load: every source's records and nodes, in one plan."""
    out = None
    for key, name in DISPATCH.items():
        keys = SOURCES[name][3]
        fine = F.coalesce(F.trim(F.col(keys[0]).cast("string")), F.lit("")) != ""
        one = records(t, name).agg(F.count(F.lit(1)).alias("records"), F.count_distinct(F.when(fine, canonical_id(*[F.col(k) for k in keys], size=ID))).alias("nodes")).select(F.lit(key).alias("source"), "records", "nodes")
        out = one if out is None else out.union(one)
    return out
