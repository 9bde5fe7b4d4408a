"""Every query with SQL gives DuckDB's rows on the smallest data folder."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from stacksift.plans import catalog
from stacksift.plans.views import TABLES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v) -> str:
    if v is None or (not isinstance(v, (list, dict)) and pd.isna(v)):
        return "-"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return repr(float(v))
    return str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(plain(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    want = duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    for c in want.columns:  # DuckDB hands dates out as timestamps
        if str(want[c].dtype).startswith("datetime") and len(got) and not str(got[c].dtype).startswith("datetime"):
            want[c] = want[c].dt.date
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["report_date", "primary_category", "n"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans_have_no_cartesian_product(spark):
    for name in ("jn04_title_match", "jn03_enrich_signals", "wn02_capped_top_k", "flagship_tracked_papers"):
        plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        assert "SinglePartition" not in plan or name == "jn03_enrich_signals"
