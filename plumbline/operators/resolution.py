"""Entity resolution and loading: blocking instead of all pairs, star-greedy clusters, upserts by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import canonical_id, jaro_winkler, jaccard, normalise_name, similar_pairs, tokens
from plumbline.operators.graph import settle
from plumbline.plans.registry import query
from plumbline.plans.tables import Tables

THRESHOLD = 0.72
#: Identifying keys, the first that both records have decides; the first three alone decide against.
KEYS = ("cin", "pan", "gstin", "wikidata_id", "darpan_id", "bond_number", "order_id", "tender_id", "icij_node_id")
AGAINST = 3


def key_of(column: str) -> Column:
    """A key's value, trimmed and upper-case; null where it is blank."""
    return F.nullif(F.upper(F.trim(F.col(column).cast("string"))), F.lit(""))


def with_keys(records: DataFrame) -> DataFrame:
    """seq, name and keys (array over KEYS; what the records lack is null)."""
    return records.select("seq", "name", F.array(*[key_of(k) if k in records.columns else F.lit(None).cast("string") for k in KEYS]).alias("keys"))


def key_score(a: Column, b: Column) -> Column:
    """1 or 0 by the first key that both have; 0 if they share none and the first has one of the deciding keys; else null (names decide)."""
    out = F.when(F.exists(F.slice(a, F.lit(1), F.lit(AGAINST)), lambda x: x.isNotNull()), 0.0)
    for k in reversed(range(len(KEYS))):
        x, y = F.get(a, F.lit(k)), F.get(b, F.lit(k))
        out = F.when(x.isNotNull() & y.isNotNull(), F.when(x == y, 1.0).otherwise(0.0 if k < AGAINST else out)).otherwise(out)
    return out


def name_score(a: Column, b: Column, cosine: Column | None = None) -> Column:
    """Of normalised names: 0 if one is blank, 1 if equal, else .6 Jaro-Winkler + .4 Jaccard, or .3, .2 and .5 of the embeddings' cosine."""
    jac = jaccard(tokens(a), tokens(b))
    mixed = 0.6 * jaro_winkler(a, b) + 0.4 * jac if cosine is None else 0.3 * jaro_winkler(a, b) + 0.2 * jac + 0.5 * cosine
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(mixed)


def scored_pairs(left: DataFrame, right: DataFrame | None = None, kind: str = "person", threshold: float = THRESHOLD) -> DataFrame:
    """i, j and score of the pairs that reach the threshold (above .6); within one table i < j, else i of left and j of right.

    Exact without comparing all: as Jaro-Winkler is 1 at most, the names' Jaccard similarity is (threshold - .6) / .4 at least, so pairs
    come from the words by prefix filtering, and besides from equal keys. Jaro-Winkler runs over these pairs only."""
    one = right is None
    tables = [with_keys(x).select(F.concat(F.lit(side), F.col("seq").cast("string")).alias("id"), "seq", "keys", normalise_name(F.col("name"), kind).alias("norm")) for side, x in (("l", left), ("r", left if one else right))]
    sets = (tables[0] if one else tables[0].union(tables[1])).filter("norm <> ''").select("id", tokens(F.col("norm")).alias("words"))
    found = similar_pairs(sets, (threshold - 0.6) / 0.4).select("a", "b")
    seq = lambda c: F.substring(c, 2, 30).cast("long")
    if one:
        pairs = found.select(F.least(seq("a"), seq("b")).alias("i"), F.greatest(seq("a"), seq("b")).alias("j"))
    else:
        pairs = found.filter("left(a, 1) = 'l' and left(b, 1) = 'r'").select(seq("a").alias("i"), seq("b").alias("j"))
    keyed = [x.select("seq", F.posexplode("keys").alias("k", "v")).filter("v is not null") for x in tables]
    same = keyed[0].select(F.col("seq").alias("i"), "k", "v").join(keyed[1].select(F.col("seq").alias("j"), "k", "v"), ["k", "v"]).select("i", "j")
    pairs = pairs.union(same.filter("i < j") if one else same).distinct()
    a, b = (x.select(F.col("seq").alias(n), F.col("keys").alias(f"k{n}"), F.col("norm").alias(f"n{n}")) for n, x in zip("ij", tables, strict=True))
    whole = pairs.join(a, "i").join(b, "j")
    score = F.coalesce(key_score(F.col("ki"), F.col("kj")), name_score(F.col("ni"), F.col("nj")))
    return whole.select("i", "j", F.round(score, 6).alias("score")).filter(F.col("score") >= threshold)


def star_clusters(records: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """In order, each unused record is a centre and takes later unused records that score against the centre itself: the lexicographically
    first maximal independent set, settled round by round (a record is decided once all its lower neighbours are)."""
    near = settle(pairs.filter(F.col("score") >= threshold).select("i", "j"))
    state = settle(records.select("seq").withColumn("role", F.lit(None).cast("string")).withColumn("centre", F.lit(None).cast("long")))
    while True:
        lower = near.join(state.select(F.col("seq").alias("i"), "role"), "i").groupBy(F.col("j").alias("seq"))
        seen = lower.agg(F.count(F.when(F.col("role").isNull(), 1)).alias("open"), F.min(F.when(F.col("role") == "centre", F.col("i"))).alias("low"))
        x = state.join(seen, "seq", "left")
        first_open = F.coalesce("open", F.lit(0)) == 0
        # a centre below a still open neighbour may come to be: a record is absorbed only when no lower neighbour is open
        role = F.when(F.col("role").isNotNull(), F.col("role")).when(first_open & F.col("low").isNotNull(), "absorbed").when(first_open, "centre")
        centre = F.when(F.col("centre").isNotNull(), F.col("centre")).when(first_open & F.col("role").isNull(), F.coalesce("low", "seq"))
        state = settle(x.select("seq", role.alias("role"), centre.alias("centre")))
        if state.filter("role is null").isEmpty():
            return state.select("seq", "centre")


def canonical(records: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per centre: canonical_id, seq, name and duplicates (seq, name and score, by seq)."""
    named = records.select("seq", "name")
    clusters = star_clusters(records, pairs, threshold).join(named, "seq")
    score = pairs.select(F.col("i").alias("centre"), F.col("j").alias("seq"), "score")
    taken = clusters.filter("seq <> centre").join(score, ["centre", "seq"]).groupBy(F.col("centre").alias("seq")).agg(F.sort_array(F.collect_list(F.struct("seq", "name", "score"))).alias("duplicates"))
    centres = clusters.filter("seq = centre").select("seq", "name").join(taken, "seq", "left")
    empty = F.array().cast("array<struct<seq:bigint,name:string,score:double>>")
    return centres.select(canonical_id(F.col("name")).alias("canonical_id"), "seq", "name", F.coalesce("duplicates", empty).alias("duplicates"))


def part_records(t: Tables) -> DataFrame:
    """Records for resolution: the different part names, in the order of their first part, some with a key."""
    first = t.raw("part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("seq"))
    return settle(first.select("seq", "name", F.when(F.col("seq") % 7 == 0, F.concat(F.lit("k"), (F.col("seq") % 21).cast("string"))).alias("cin")))


@query("er01_star_clusters")
def resolve(t: Tables) -> DataFrame:
    records = part_records(t)
    return canonical(records, settle(scored_pairs(records)))


@query("er02_resolve_by_words")
def resolve_by_words(t: Tables, threshold: float = 0.7) -> DataFrame:
    """The first form of resolution: Jaccard of cleaned names alone."""
    records = part_records(t)
    pairs = similar_pairs(records.select(F.col("seq").alias("id"), tokens(F.col("name")).alias("words")), threshold)
    return canonical(records, settle(pairs.select(F.col("a").alias("i"), F.col("b").alias("j"), F.round("similarity", 6).alias("score"))), threshold)


def find_matches(records: DataFrame, name: str, kind: str = "person", threshold: float = THRESHOLD) -> DataFrame:
    """seq, name and score of the records like `name`, best first."""
    norm = normalise_name(F.lit(name), kind)
    x = records.select("seq", "name", F.round(name_score(normalise_name(F.col("name"), kind), norm), 6).alias("score"))
    return x.filter(F.col("score") >= threshold).orderBy(F.col("score").desc(), "seq")


@query("er03_find_matches")
def q_find_matches(t: Tables, name: str = "Shri Small Ring") -> DataFrame:
    return find_matches(part_records(t), name)


@query("er04_cross_match")
def cross_match(t: Tables) -> DataFrame:
    """Pairs across two tables with the left one's canonical id."""
    left = part_records(t)
    right = settle(t.raw("part").groupBy("p_name").agg(F.max("p_partkey").alias("seq")).select("seq", F.concat(F.lit("Dr. "), F.initcap("p_name"), F.lit(" II")).alias("name")))
    found = scored_pairs(left, right).join(left.select(F.col("seq").alias("i"), F.col("name").alias("a")), "i").join(right.select(F.col("seq").alias("j"), F.col("name").alias("b")), "j")
    return found.select(canonical_id(F.col("a")).alias("canonical_id"), "a", "b", F.round("score", 3).alias("score"))


def resolve_batch(records: DataFrame, most: int = 500, threshold: float = THRESHOLD) -> DataFrame:
    """Resolution of a request's records (seq, name and keys), at most `most` of them."""
    if records.limit(most + 1).count() > most:
        raise ValueError(f"at most {most} records a request")
    return canonical(settle(records), settle(scored_pairs(records, threshold=threshold)), threshold)


@query("er06_resolve_batch")
def q_resolve_batch(t: Tables) -> DataFrame:
    return resolve_batch(t.nation.select(F.col("n_nationkey").cast("long").alias("seq"), F.col("n_name").alias("name")))


@query("er05_alias_graph", """SELECT alias, id FROM (SELECT lower(trim(kind)) AS alias, event_id AS id, row_number() OVER (PARTITION BY lower(trim(kind)) ORDER BY ts DESC, event_id DESC) AS k FROM event) WHERE k = 1""")
def alias_graph(t: Tables) -> DataFrame:
    """Last write wins per alias: a max over (time, id), not a sort."""
    return t.event.groupBy(F.lower(F.trim("kind")).alias("alias")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("id"))


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """MERGE by key: the row of the highest version stays, of equal versions the largest by its other columns."""
    rest = [F.col(c).desc_nulls_last() for c in sorted(old.columns) if c not in (key, version)]
    w = Window.partitionBy(key).orderBy(F.col(version).desc(), *rest)
    return old.unionByName(new).withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


@query("snk02_upsert", """SELECT event_id % 100 AS id, max(event_id) AS version, arg_max(kind, event_id) AS kind FROM event GROUP BY 1""")
def q_upsert(t: Tables) -> DataFrame:
    rows = t.event.select((F.col("event_id") % 100).alias("id"), F.col("event_id").alias("version"), "kind")
    return upsert(rows.filter("version % 2 = 0"), rows.filter("version % 2 = 1"), "id", "version")


@query("snk03_write_back", """SELECT comp, name, coalesce(n, 0) AS degree FROM company LEFT JOIN (SELECT comp, count(*) AS n FROM director GROUP BY comp) USING (comp)""")
def write_back(t: Tables) -> DataFrame:
    degree = t.director.groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
    return t.company.join(degree, "comp", "left").select("comp", "name", F.coalesce("n", F.lit(0)).alias("degree"))


@query("ld01_politicians", """SELECT left(sha256(lower(trim(name)) || '|' || lower(trim(state)) || '|none'), 32) AS id, name, state, party FROM politician WHERE trim(name) <> ''""")
def load_politicians(t: Tables) -> DataFrame:
    return t.politician.filter(F.trim("name") != "").select(canonical_id(F.col("name"), F.col("state"), F.lit(None), size=32).alias("id"), "name", "state", "party").dropDuplicates(["id"])


@query("ld01_member_of", """SELECT pol AS src, left(sha256(lower(party)), 32) AS dst, 'MEMBER_OF' AS rel FROM politician WHERE party <> ''""")
def load_member_of(t: Tables) -> DataFrame:
    return t.politician.filter("party <> ''").select(F.col("pol").alias("src"), canonical_id(F.col("party"), size=32).alias("dst"), F.lit("MEMBER_OF").alias("rel"))


@query("ld02_companies", """SELECT left(sha256(lower(trim(name)) || '|' || lower(trim(state))), 32) AS id, name, round(capital, 2) AS capital FROM company""")
def load_companies(t: Tables) -> DataFrame:
    return t.company.select(canonical_id(F.col("name"), F.col("state"), size=32).alias("id"), "name", F.round("capital", 2).alias("capital")).dropDuplicates(["id"])


@query("ld03_contract_edges", """SELECT CAST(comp AS VARCHAR) AS src, CAST(contract AS VARCHAR) AS dst, 'WON_CONTRACT' AS rel FROM won UNION ALL SELECT CAST(contract AS VARCHAR), ministry, 'AWARDED_BY' FROM awarded""")
def load_contract_edges(t: Tables) -> DataFrame:
    return t.won.select(F.col("comp").cast("string").alias("src"), F.col("contract").cast("string").alias("dst"), F.lit("WON_CONTRACT").alias("rel")).union(t.awarded.select(F.col("contract").cast("string"), "ministry", F.lit("AWARDED_BY")))


@query("ld20_last_per_key", """SELECT pol, CAST(ts AS DATE) AS day, arg_max(kind, event_id) AS kind FROM event GROUP BY 1, 2""")
def load_last_per_key(t: Tables) -> DataFrame:
    return t.event.groupBy("pol", F.to_date("ts").alias("day")).agg(F.max_by("kind", "event_id").alias("kind"))
