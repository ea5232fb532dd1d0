"""Every telemetry query that has SQL gives the same rows in Spark and DuckDB."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from faultline.plans import models, parsing, registry, roundtrips, telemetry  # noqa: F401

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def rows(pdf) -> list[str]:
    columns = sorted(pdf.columns)
    plain = pdf[columns].astype(object).where(pdf[columns].notna(), None)
    return sorted(str(tuple(float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r)) for r in plain.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, duck, name):
    got, want = registry.QUERIES[name](spark, DIR).toPandas(), duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    """Queries without SQL give the same rows twice, from a differently dealt session."""
    rows_of = lambda: sorted(map(str, registry.QUERIES[name](spark, DIR).collect()))
    first = rows_of()
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        assert first and [r[:200] for r in rows_of()] == [r[:200] for r in first]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
