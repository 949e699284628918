"""Sources and sinks: landed JSON and HTML as tables, field fallbacks, screening, catalogue."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.plans.registry import query
from plumbline.plans.tables import Tables


@query("src01_json_fields", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_fields(t: Tables) -> DataFrame:
    """A JSON column read with an explicit schema."""
    return t.raw("events").select("event_id", F.from_json("props", "k bigint").alias("j")).select("event_id", F.col("j.k").alias("k"))


@query("src02_html_titles", """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages""")
def html_titles(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("src09_semi_screen", """SELECT comp FROM company WHERE comp IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R')""")
def semi_screen(t: Tables) -> DataFrame:
    return t.company.select("comp").join(t.raw("lineitem").filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("comp")).distinct(), "comp", "left_semi")


def write_json(df: DataFrame, path: str) -> None:
    """A JSON-lines sink."""
    df.write.mode("overwrite").json(path)


def html_rows(html: Column, least: int = 1) -> Column:
    """array<array<string>>: the cells' texts of each table row with at least that many cells."""
    plain = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), r"\s+", " "))
    cells = lambda row: F.transform(F.regexp_extract_all(row, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), plain)
    return F.filter(F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1)), cells), lambda r: F.size(r) >= least)


@query("src03_table_rows", """SELECT p_partkey, p_name AS name, p_brand AS brand FROM part""")
def table_rows(t: Tables) -> DataFrame:
    """Rows of HTML tables: the header goes, short rows go, markup in cells goes."""
    page = F.concat(F.lit("<table><TR><th>Name</th><th>Brand</th></TR><tr><td>short</td></tr>\n<tr class='r'><td> <b>"), "p_name", F.lit("</b>\n</td><td><a href='/x'>"), "p_brand", F.lit("</a></td></tr></table>"))
    rows = t.raw("part").select("p_partkey", html_rows(page, 2).alias("rows"))
    return rows.select("p_partkey", F.posexplode("rows").alias("k", "r")).filter("k > 0").select("p_partkey", F.get("r", F.lit(0)).alias("name"), F.get("r", F.lit(1)).alias("brand"))


@query("src04_links", """SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) || regexp_extract(a, 'href="([^"]*)"', 1) AS link, regexp_extract(a, '>([^<]*)<', 1) AS label FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS a FROM pages) WHERE length(regexp_extract(a, '>([^<]*)<', 1)) >= 4 AND (contains(lower(a), 'th') OR contains(lower(a), 'en'))""")
def links(t: Tables, least: int = 4, words: tuple[str, ...] = ("th", "en")) -> DataFrame:
    """Links with a label of some length whose address or label holds a keyword, made absolute."""
    a = t.raw("pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('<a href="[^"]*">[^<]*</a>'), F.lit(0))).alias("a"))
    label = F.regexp_extract("a", ">([^<]*)<", 1)
    named = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower("a"), w))
    return a.filter((F.length(label) >= least) & named).select("page_id", F.concat(F.regexp_extract("url", "^(https?://[^/]+)", 1), F.regexp_extract("a", 'href="([^"]*)"', 1)).alias("link"), label.alias("label"))


#: The shapes of open-data answers: the array is called records, data or items, and fields go by several names.
ANSWER = "records array<map<string,string>>, data array<map<string,string>>, items array<map<string,string>>"


def open_data(answers: DataFrame, fields: dict[str, tuple[str, ...]], **filters: str) -> DataFrame:
    """Rows of landed JSON answers (column json): each field by the first of its names that is not blank; nameless rows go; filters by field."""
    j = F.from_json("json", ANSWER)
    rows = answers.select("key", F.explode(F.coalesce(j["records"], j["data"], j["items"])).alias("r"))
    value = lambda names: F.coalesce(*[F.nullif(F.trim(F.element_at("r", n)), F.lit("")) for n in names], F.lit(""))
    out = rows.select("key", *[value(names).alias(f) for f, names in fields.items()]).filter("name <> ''")
    for field, wanted in filters.items():
        out = out.filter(F.col(field) == wanted)
    return out


def _answers(t: Tables) -> DataFrame:
    """Suppliers as answers of three services."""
    name, state = F.col("s_name"), F.col("s_nationkey").cast("string")
    row = F.when(F.col("s_suppkey") % 3 == 0, F.create_map(F.lit("seller_name"), name, F.lit("state"), state)).when(F.col("s_suppkey") % 3 == 1, F.create_map(F.lit("seller_name"), F.lit(" "), F.lit("company"), name, F.lit("state_name"), state)).otherwise(F.create_map(F.lit("other"), name, F.lit("state"), state))
    array = F.to_json(F.array(row))
    wrapped = F.concat(F.lit('{"'), F.when(F.col("s_suppkey") % 3 == 0, "records").when(F.col("s_suppkey") % 3 == 1, "data").otherwise("items"), F.lit('":'), array, F.lit("}"))
    return t.raw("supplier").select(F.col("s_suppkey").alias("key"), wrapped.alias("json"))


FIELDS = {"name": ("seller_name", "company", "vendor"), "state": ("state", "state_name")}


@query("src05_open_data", """SELECT s_suppkey AS key, s_name AS name, CAST(s_nationkey AS VARCHAR) AS state FROM supplier WHERE s_suppkey % 3 < 2 AND s_nationkey = 3""")
def q_open_data(t: Tables) -> DataFrame:
    return open_data(_answers(t), FIELDS, state="3")


@query("src06_field_fallback", """SELECT s_suppkey AS key, s_name AS name, CAST(s_nationkey AS VARCHAR) AS state FROM supplier WHERE s_suppkey % 3 < 2""")
def field_fallback(t: Tables) -> DataFrame:
    return open_data(_answers(t), FIELDS)


@query("src07_optional_properties", """SELECT p.pol, p.name, list_sort(coalesce(f.firms, [])) AS firms, list_sort(coalesce(k.kinds, [])) AS kinds FROM politician p LEFT JOIN (SELECT pol, list(DISTINCT name) AS firms FROM director JOIN (SELECT comp, name FROM company) USING (comp) GROUP BY pol) f USING (pol) LEFT JOIN (SELECT pol, list(DISTINCT kind) AS kinds FROM event GROUP BY pol) k USING (pol)""")
def optional_properties(t: Tables) -> DataFrame:
    """Items with optional properties as distinct lists; each property is gathered before the join."""
    firms = t.director.join(t.company.select("comp", F.col("name").alias("firm")), "comp").groupBy("pol").agg(F.collect_set("firm").alias("firms"))
    kinds = t.event.groupBy("pol").agg(F.collect_set("kind").alias("kinds"))
    empty = F.array().cast("array<string>")
    out = t.politician.select("pol", "name").join(firms, "pol", "left").join(kinds, "pol", "left")
    return out.select("pol", "name", *[F.sort_array(F.coalesce(c, empty)).alias(c) for c in ("firms", "kinds")])


#: The list of exposed people, and the lists that sanction.
EXPOSED, SANCTIONS = "pep", ("us_ofac_sdn", "un_sc_sanctions", "eu_fsf")


@query("src08_screening", """SELECT pol, name, pol % 3 = 0 AS exposed, pol % 5 = 0 OR pol % 7 = 0 AS sanctioned FROM politician WHERE pol % 3 = 0 OR pol % 5 = 0 OR pol % 7 = 0""")
def screening(t: Tables) -> DataFrame:
    """Names looked up in lists: exposed and sanctioned by the lists' names; who is in none goes."""
    on = lambda k, name: F.when(F.col("pol") % k == 0, F.struct("pol", "name", F.lit(name).alias("list")))
    entries = t.politician.select(F.explode(F.array_compact(F.array(on(3, EXPOSED), on(5, SANCTIONS[0]), on(7, SANCTIONS[1]), on(2, "wanted")))).alias("e")).select(F.upper("e.name").alias("listed"), "e.list")
    lists = entries.groupBy(F.lower("listed").alias("k")).agg(F.collect_set("list").alias("lists"))
    hit = t.politician.select("pol", "name").join(lists, F.lower("name") == F.col("k"))
    exposed, sanctioned = F.array_contains("lists", EXPOSED), F.arrays_overlap("lists", F.array(*map(F.lit, SANCTIONS)))
    return hit.select("pol", "name", exposed.alias("exposed"), sanctioned.alias("sanctioned")).filter("exposed or sanctioned")


def or_sample(live: DataFrame, sample: DataFrame) -> DataFrame:
    """The live rows, or the sample's where there are none; decided in the plan, without an action."""
    some = live.limit(1).select(F.lit(True).alias("_live"))
    fallback = sample.join(F.broadcast(some), F.lit(True), "left_anti")
    return live.unionByName(fallback)


@query("src10_sample_fallback", """SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT 0, 'sample'""")
def sample_fallback(t: Tables) -> DataFrame:
    """One source that answered and one that did not."""
    sample = t.spark.createDataFrame([(0, "sample")], "id int, name string")
    live = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return or_sample(live, sample).union(or_sample(live.filter("id < 0"), sample))


def seed(spark: SparkSession) -> dict[str, DataFrame]:
    """A small graph to try things on: 10 people, 7 companies, 5 contracts, 4 audits, 5 links."""
    frame = lambda n, schema, row: spark.createDataFrame([row(k) for k in range(n)], schema)
    return {
        "Politician": frame(10, "id string, name string", lambda k: (f"p{k}", f"Person {k}")),
        "Company": frame(7, "id string, name string", lambda k: (f"c{k}", f"Company {k}")),
        "Contract": frame(5, "id string, src string, amount double", lambda k: (f"t{k}", f"c{k}", 10.0 * (k + 1))),
        "AuditReport": frame(4, "id string, title string", lambda k: (f"a{k}", f"Report {k}")),
        "DIRECTOR_OF": frame(5, "src string, dst string", lambda k: (f"p{k}", f"c{k}")),
    }


@query("src11_seed", """SELECT * FROM (VALUES ('Politician', 10), ('Company', 7), ('Contract', 5), ('AuditReport', 4), ('DIRECTOR_OF', 5)) v(label, n)""")
def q_seed(t: Tables) -> DataFrame:
    out = None
    for name, df in seed(t.spark).items():
        one = df.agg(F.count(F.lit(1)).cast("int").alias("n")).select(F.lit(name).alias("label"), "n")
        out = one if out is None else out.union(one)
    return out


@query("snk06_catalogue", """SELECT s.source, coalesce(n, 0) AS n, CASE WHEN n > 0 THEN 'loaded' ELSE 'pending' END AS status, row_number() OVER (ORDER BY coalesce(n, 0) DESC, s.source) AS place FROM (SELECT 'src' || unnest(range(0, 22)) AS source) s LEFT JOIN (SELECT source, count(*) AS n FROM documents GROUP BY source) d USING (source)""")
def catalogue(t: Tables, listed: int = 22) -> DataFrame:
    """The catalogue of sources with their counts, fullest first."""
    names = t.spark.range(listed).select(F.concat(F.lit("src"), "id").alias("source"))
    counts = t.raw("documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    # as many rows as the catalogue lists
    place = F.row_number().over(Window.orderBy(n.desc(), "source")).cast("long")
    return names.join(counts, "source", "left").select("source", n.alias("n"), F.when(F.col("n") > 0, "loaded").otherwise("pending").alias("status"), place.alias("place"))


def sample_of(t: Tables, source: str, most: int = 20) -> DataFrame:
    """The first rows of a source."""
    return t.raw("documents").filter(F.col("source") == source).orderBy("doc_id").limit(most)


def append_audit(df: DataFrame, path: str) -> None:
    """Appends rows (ts, entry) to an audit log whose batches are chained: each batch's root is the hash of the one before and of its
    entries' hashes in order. A batch is one request's entries, so its hashes fit into one row."""
    spark = df.sparkSession
    try:
        last = spark.read.json(f"{path}/roots").orderBy(F.col("batch").desc()).select("batch", "root").first()
    except AnalysisException:
        last = None
    number, previous = (last["batch"] + 1, last["root"]) if last else (0, "")
    rows = df.select("ts", "entry", F.sha2(F.concat_ws("|", F.col("ts").cast("string"), "entry"), 256).alias("hash"), F.lit(number).alias("batch"))
    rows.write.mode("append").json(f"{path}/entries")
    written = spark.read.schema("ts string, entry string, hash string, batch long").json(f"{path}/entries").filter(F.col("batch") == number)
    _roots(written, spark.createDataFrame([(number, previous)], "batch long, previous string")).write.mode("append").json(f"{path}/roots")


def _roots(entries: DataFrame, previous: DataFrame) -> DataFrame:
    joined = entries.groupBy("batch").agg(F.array_join(F.sort_array(F.collect_list("hash")), "|").alias("hashes")).join(previous, "batch")
    return joined.select("batch", "previous", F.sha2(F.concat_ws("|", "previous", "hashes"), 256).alias("root"))


def verify_audit(spark: SparkSession, path: str) -> DataFrame:
    """batch and valid: whether each batch's entries hash to its root and its root follows the one before."""
    entries = spark.read.schema("ts string, entry string, hash string, batch long").json(f"{path}/entries")
    roots = spark.read.schema("batch long, previous string, root string").json(f"{path}/roots")
    again = _roots(entries.withColumn("hash", F.sha2(F.concat_ws("|", "ts", "entry"), 256)), roots.select("batch", "previous")).select("batch", F.col("root").alias("again"))
    before = roots.select((F.col("batch") + 1).alias("batch"), F.col("root").alias("before"))
    x = roots.join(again, "batch", "left").join(before, "batch", "left")
    return x.select("batch", (F.coalesce(F.col("root") == F.col("again"), F.lit(False)) & (F.col("previous") == F.coalesce("before", F.lit("")))).alias("valid"))
