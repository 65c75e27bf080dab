"""Every query with SQL against DuckDB, and its independence of partitions."""

import os

import duckdb
import pytest

import __spark_entry__
from tallyspark.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v) if hasattr(v, "isoformat") else v


def rows(columns, found):
    return sorted((tuple(plain(r[c]) for c in columns) for r in found), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_query_equals_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = db.execute(catalog.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]
    assert want or name in ("q17_pagination_stop",)  # a query that finds nothing tests nothing
    got = rows(columns, df.collect())
    assert got == rows(columns, want)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert rows(columns, catalog.QUERIES[name](spark, SF).collect()) == got
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).columns == ["url", "title"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
