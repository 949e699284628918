"""Every registered query with an oracle gives the oracle's rows; every other one has a test that checks it by force."""

import datetime
import decimal
import os

import duckdb
import pytest

from plumbline.plans import registry

registry.load()
DIR = os.environ.get("PLUMBLINE_TEST_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        name = f.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{f}'")
    return con


def plain(x):
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, float):
        return round(x, 6) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


#: Queries without SQL, and the tests that check them.
BY_FORCE = {
    **dict.fromkeys(("er01_star_clusters", "er02_resolve_by_words", "er03_find_matches", "er04_cross_match", "er06_resolve_batch", "sc09_jaro_winkler", "sc11_combined_score", "dt08_shadow_draft", "dt26_debate"), "test_by_force.py"),
    **dict.fromkeys(("gr01_pagerank", "gr03_label_communities", "gr06_ego_spectrum", "dt18_spectral_role", "gr08_ego_role"), "test_by_force.py"),
    **dict.fromkeys(("gr02_betweenness", "gr03_communities", "gr07_bridges"), "test_network.py"),
}


def test_every_query_is_checked():
    assert set(registry.QUERIES) == set(registry.ORACLES) | set(BY_FORCE)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted((plain(tuple(r)) for r in df.select(*columns).collect()), key=repr)
    rel = duck.sql(registry.ORACLES[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    want = sorted((plain(tuple(r[k] for k in at)) for r in rel.fetchall()), key=repr)
    assert got == want
