"""Every query that has SQL, against DuckDB on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from quillon.plans import queries, sql

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    d = duckdb.connect()
    for t in TABLES:
        d.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return d


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_same_rows(spark, sf, duck, name):
    df = queries.queries()[name](spark, sf)
    want = duck.sql(sql.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())


def test_every_query_has_sql_or_a_reason():
    assert set(queries.queries()) - set(sql.oracle_sql()) == {"stable_negative", "word2vec_recall", "lr_scores", "fm_scores", "gbt_scores"}
