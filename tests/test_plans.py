"""Physical-plan properties that the design relies on at scale."""

import os
import tempfile

from tests.conftest import SF001
from velora.operators.histref import historical_reference
from velora.operators.lags import row_lags
from velora.plans import forecast as fc
from velora.plans import jobs
from velora.sources import tables as tb


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_counts_scan_reads_two_columns(spark):
    plan = _plan(tb.counts(spark, SF001))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in plan or "struct<user_id:bigint,ts:timestamp_ntz>" in plan


def test_lag_windows_are_keyed_by_chunk_not_by_site_alone(spark):
    c = tb.counts(spark, SF001)
    lagged = row_lags(c, "site_id", ["ts", "hourly_count"], "hourly_count")
    lagged.collect()
    plan = _plan(lagged)
    assert "__bucket" in plan and "__chunk" in plan
    # the one row-level window sits on an explicit exchange over the full chunk key
    final = plan.split("Initial Plan")[0]
    assert final.count("REPARTITION_BY_COL") == 1


def test_history_window_pushes_filters_and_prunes_months(spark):
    root = tempfile.mkdtemp(prefix="velora-plan-")
    c = tb.counts(spark, SF001)
    raw_p, w_p, f_p = (os.path.join(root, n) for n in ("raw", "w", "f"))
    c.write.parquet(raw_p)
    tb.weather(c).write.parquet(w_p)
    jobs.feature_table_job(spark, raw_p, w_p, f_p)
    start = fc.forecast_start_value(spark.read.parquet(raw_p))
    plan = _plan(fc.history_window(spark.read.parquet(f_p), start, 30).select("site_id", "ts", "hourly_count"))
    assert "PartitionFilters: [isnotnull(month" in plan
    assert "GreaterThanOrEqual(ts," in plan and "LessThanOrEqual(ts," in plan
    assert "ReadSchema: struct<site_id:bigint,hourly_count:bigint,ts:timestamp_ntz>" in plan


def test_historical_reference_has_no_range_or_cartesian_join(spark):
    cw = tb.counts_wide(spark, SF001)
    plan = _plan(historical_reference(cw, cw))
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert "RangeFrame" in plan or "specifiedwindowframe(RangeFrame" in plan


def test_reference_reads_only_the_days_before_its_targets(spark):
    root = tempfile.mkdtemp(prefix="velora-plan-")
    tb.counts_wide(spark, SF001).write.parquet(root + "/c")
    c = spark.read.parquet(root + "/c")
    plan = _plan(historical_reference(c, c.filter("ts >= '2025-03-01'").limit(5)))
    assert "GreaterThanOrEqual(ts," in plan and "LessThan(ts," in plan


def test_split_and_correlations_are_one_scan(spark):
    from velora.operators.analytics import correlation_matrix
    from velora.plans.features import build_features
    from velora.plans.training import chrono_split

    c = tb.counts(spark, SF001)
    f = build_features(c, tb.weather(c)).checkpoint()
    split = _plan(chrono_split(f))
    assert "Join" not in split and "Window" not in split and "Exchange" not in split
    plan = _plan(correlation_matrix(f))
    assert "Expand" not in plan and plan.count("Scan ExistingRDD") <= 1


def test_a_sites_series_does_not_touch_the_counts(spark):
    from velora.registry import queries as registry

    plan = _plan(registry.queries()["site_series"](spark, SF001))
    assert "events.parquet" not in plan and "Join" not in plan


def test_last_values_ships_n_rows_per_task_and_site(spark):
    from velora.operators.history import last_values

    events = spark.read.parquet(f"{SF001}/events.parquet").selectExpr("user_id AS site_id", "ts", "event_id AS hourly_count")
    plan = _plan(last_values(events))
    assert plan.count("Exchange") == 1
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")  # one on each side
