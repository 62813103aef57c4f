"""Every registered query with SQL gives the same rows in DuckDB on the smallest tables."""

import decimal

import duckdb
import pytest

from estatelens.plans import catalog, catalog_code, catalog_more  # noqa: F401  the latter two register their queries in the first

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    return round(float(v), 9) if isinstance(v, (float, decimal.Decimal)) else v


def rows(names, data):
    order = [names.index(c) for c in sorted(names)]
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF), duck.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_fuzzy_close_matches_a_plain_loop(spark):
    from difflib import SequenceMatcher

    names = {r[0] for t, c in (("supplier", "s_name"), ("part", "p_name")) for r in duckdb.sql(f"SELECT {c} FROM read_parquet('{SF}/{t}.parquet')").fetchall()}
    want = set()
    for asked in ("red wigdet", "Suplier#000000007"):
        scored = sorted((-round(SequenceMatcher(None, asked.lower(), n.lower()).ratio(), 3), n) for n in names)
        want |= {(asked, n, -r) for r, n in scored[:5] if -r >= 0.7}
    assert {tuple(r) for r in catalog.QUERIES["fuzzy_close"](spark, SF).collect()} == want
