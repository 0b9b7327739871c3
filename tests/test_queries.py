"""Every registered query against its SQL twin on whole tables."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_module
from simsift.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return con


def cell(value):
    if value is None or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return ""
    value = value.item() if hasattr(value, "item") else value
    if isinstance(value, float):
        return str(int(value)) if value == int(value) else repr(round(value, 9))
    return str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name].run(spark, SF_DIR).toPandas()
    want = duck.execute(QUERIES[name].sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_learned_classifier_scores_all_splits(spark):
    got = {r["split"]: r for r in QUERIES["ml1_learned_classifier"].run(spark, SF_DIR).collect()}
    assert set(got) == {"train", "val", "test"}
    assert sum(r["total"] for r in got.values()) == spark.read.parquet(f"{SF_DIR}/events.parquet").count()
    assert got["test"]["accuracy"] > 0.5


def test_entry(spark):
    out = entry_module.entry(spark)
    assert out.columns == ["expected", "predicted", "n"] and out.count() > 0
    assert set(entry_module.oracle_sql()) < set(entry_module.queries())


def test_some_runs_are_inert_and_some_are_not(spark):
    flags = [r["is_inert"] for r in QUERIES["jn2_inert_runs"].run(spark, SF_DIR).collect()]
    assert 0 < sum(flags) < len(flags)
    assert QUERIES["flt1_active_runs"].run(spark, SF_DIR).count() == len(flags) - sum(flags)
