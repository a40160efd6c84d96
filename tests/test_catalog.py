"""Every registered query gives the rows of its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from revlume import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return ""
    if isinstance(v, float):
        return "" if math.isnan(v) else f"{v + 0.0:.8g}"
    return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    ours = catalog.QUERIES[name](spark, SF)
    theirs = duck.sql(catalog.ORACLE_SQL[name])
    assert table(ours.columns, ours.collect()) == table(theirs.columns, theirs.fetchall())


#: Queries that SQL can't express: tested against plain versions (test_similar.py, test_phrases.py, test_mapping.py).
WITHOUT_SQL = {"C19_fuzzy_names", "C13_resolved_matches", "J13_mapped_aspects"}


def test_every_other_query_has_sql():
    assert set(catalog.ORACLE_SQL) == set(catalog.QUERIES) - WITHOUT_SQL


@needs_data
@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_queries_without_sql_run(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
