"""Results do not depend on the session time zone (all stamps are wall-clock NTZ)."""

import datetime as dt

from pyspark.sql import functions as F

from velora.functions.calendar import floor_hour, ntz_lit
from velora.plans import forecast as fc
from velora.plans import serving as sv
from velora.sinks.tables import purge_recent


def _frame(spark):
    base = dt.datetime(2025, 3, 30, 0)  # spans the spring clock change in Europe
    rows = [(s, base + dt.timedelta(hours=h), float(h)) for h in range(6) for s in (1, 2)]
    return spark.createDataFrame(rows, "site_id long, ts timestamp_ntz, hourly_count double").withColumns(
        {"site_name": F.lit("x"), "latitude": F.lit(1.0), "longitude": F.lit(2.0)}
    )


def _run(spark):
    df = _frame(spark)
    t = dt.datetime(2025, 3, 30, 2, 30)  # in the European spring gap
    return (
        [tuple(r) for r in sv.predict_at(df, t).collect()],
        sorted(tuple(r) for r in fc.history_window(df, dt.datetime(2025, 3, 30, 3), 0).select("site_id", "ts").collect()),
        purge_recent(df, dt.datetime(2025, 4, 6, 3), 7).count(),
        df.select(ntz_lit(t).alias("a"), floor_hour(ntz_lit(t)).alias("b")).first(),
    )


def test_same_results_under_any_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        base = _run(spark)
        for zone in ("Europe/Paris", "America/Los_Angeles", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert _run(spark) == base, zone
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert base[3].a == dt.datetime(2025, 3, 30, 2, 30) and base[3].b == dt.datetime(2025, 3, 30, 2, 0)
    assert [r[0] for r in base[0]] == [1, 2] or len(base[0]) == 2
    assert base[1] == [(1, dt.datetime(2025, 3, 30, 3)), (2, dt.datetime(2025, 3, 30, 3))]
    assert base[2] == 6  # hours 0..2 of both sites are older than the cutoff
