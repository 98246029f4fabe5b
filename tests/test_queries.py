"""Driver queries against their SQL in DuckDB, over the smallest tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from ontime import queries
from ontime.plans.inspect import uses_python

DATA = "/root/testdata/sf0.001"
SLOW = {"lr_cv", "random_search", "kfold_forest"}


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(df: pd.DataFrame) -> list:
    clean = lambda x: None if pd.isna(x) else float(x) + 0.0 if isinstance(x, float) and not math.isnan(x) else x
    return sorted((tuple(clean(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, sql, name):
    df = queries.QUERIES[name](spark, DATA)
    assert not uses_python(df)
    want = sql.execute(queries.ORACLE[name]).df()
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.toPandas()) == rows(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE) - SLOW))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


def test_random_search_takes_every_fold(spark, monkeypatch):
    class Nothing:
        def metrics(self, spark):
            return None

    seen = []
    monkeypatch.setattr(queries.K.TimeFoldValidator, "fit", lambda self, df, folds, time: seen.append(len(folds)) or Nothing())
    queries.random_search(spark, DATA)
    assert seen == [len(queries.day_folds())] == [3]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
