"""Each query against its SQL in DuckDB, on the smallest tables."""

import collections
import datetime
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from obspark.operators import records
from obspark.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], collections.Counter(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    got = bag(df.columns, [tuple(r) for r in df.collect()])
    if name not in catalogue.ORACLE_SQL:
        assert sum(got[1].values()) > 0
        return
    x = duck.execute(catalogue.ORACLE_SQL[name])
    assert got == bag([d[0] for d in x.description], x.fetchall())


def test_manifest_of_all_tables(spark, duck, sf):
    """Each table with its rows, and a checksum over all its columns."""
    got = {r["table_name"]: r for r in catalogue.QUERIES["table_manifest"](spark, sf).collect()}
    assert {k: r["n"] for k, r in got.items()} == {t: duck.execute(f"SELECT count(*) FROM {t}").fetchone()[0] for t in TABLES}
    one = records.manifest({"nation": spark.read.parquet(f"{sf}/nation.parquet").withColumn("n_regionkey", F.lit(-1))}).first()
    assert one["checksum"] != got["nation"]["checksum"]
    assert got["nation"]["checksum"] == records.manifest({"nation": spark.read.parquet(f"{sf}/nation.parquet")}).first()["checksum"]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
