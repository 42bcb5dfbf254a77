"""Every query runs at the smallest size and equals its DuckDB equivalent; plans hold no nested loops."""

import os

import duckdb
import pandas as pd
import pytest

from tracewell import catalog, oracles, queries

catalog.load()
SQL = oracles.SQL | catalog.SQL
QUERIES = queries.QUERIES | catalog.QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


def plain(df):
    def value(v):
        if v is None or pd.api.types.is_scalar(v) and pd.isna(v):
            return None
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return round(float(v), 6) + 0.0
        return str(pd.Timestamp(v)) if hasattr(v, "year") else v

    df = df[sorted(df.columns)]
    return list(df.columns), sorted(([value(v) for v in r] for r in df.astype(object).itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    got = df.toPandas()
    if name in SQL:
        assert plain(got) == plain(db.execute(SQL[name]).df())


def test_span_ground_items_takes_all(spark, tmp_path):
    """More than 40 items, with gaps in their ids, and negative doc_ids."""
    items = [(3 * i + 7, f"passage number {i} of the set") for i in range(60)]
    docs = [(i, f"Here is passage  number {i % 60} of the set.") for i in range(-70, 130)]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["span_ground_items"](spark, str(tmp_path)).toPandas()
    assert set(got.item_id) == {i for i, _ in items} and len(got) == len(docs) and got.grounded.all()
    con = duckdb.connect()
    for t in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert plain(got) == plain(con.execute(SQL["span_ground_items"]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 50
    assert set(e.oracle_sql()) <= set(e.queries())
