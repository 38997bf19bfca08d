"""Driver contract: entry, registry and a few oracle comparisons at sf0.001."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from tests.conftest import SF001
from velora.sources.tables import TABLES


def test_entry_schema(spark):
    df = E.entry(spark)
    assert len(df.columns) == 25 and df.columns[:3] == ["site_id", "hourly_count", "ts"]
    assert df.count() > 0


def test_registry_is_consistent():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 80


def _norm(df):
    df = df.copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(6)
    cols = sorted(df.columns)
    df = df[cols].astype(object)
    df = df.where(df.notna(), None)
    return df.astype(str).sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", ["feature_table", "forecast_recursive", "historical_reference", "correlation_matrix", "chrono_split", "sites_dimension", "append_month_table", "bootstrap_guard", "csv_bulk_read", "saved_pipeline_metrics"])
def test_oracle_at_sf0001(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    got = E.queries()[name](spark, SF001).toPandas()
    exp = con.execute(E.oracle_sql()[name]).df()
    assert len(got) == len(exp)
    assert sorted(got.columns) == sorted(exp.columns)
    for c in got.columns:
        if str(got[c].dtype).startswith("datetime") or str(exp[c].dtype).startswith("datetime"):
            got[c] = pd.to_datetime(got[c]).astype("datetime64[us]")
            exp[c] = pd.to_datetime(exp[c]).astype("datetime64[us]")
        if got[c].dtype == object and exp[c].dtype == bool:
            exp[c] = exp[c].astype(object)
    pd.testing.assert_frame_equal(_norm(got), _norm(exp), check_dtype=False)
