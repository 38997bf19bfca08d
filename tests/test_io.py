"""Landed-file sources (S1-S4, S9), sinks and upserts (K1-K14), increments (I1-I6) and the stream."""

import datetime as dt
import json
import os
import tempfile

from pyspark.sql import functions as F

from velora.sinks import tables as sk
from velora.sources import files as fl
from velora.streaming import incremental as inc
from velora.streaming.stream import start_count_ingest


def _dir(prefix):
    return tempfile.mkdtemp(prefix=f"velora-{prefix}-")


CSV_HEADER = "Identifiant du site de comptage;Nom du site de comptage;Identifiant technique compteur;Comptage horaire;Date et heure de comptage;Coordonnées géographiques"


def _write_csv(path, lines, header=CSV_HEADER):
    with open(path, "w", encoding="utf-8") as f:
        f.write(header + "\n" + "\n".join(lines) + "\n")


def test_counts_csv_and_separator(spark):
    d = _dir("csv")
    p = os.path.join(d, "counts.csv")
    _write_csv(
        p,
        [
            "100;Quai A;X1;12;2025-01-01T08:00:00+01:00;48.85,2.35",
            "100;Quai A;X1;abc;2025-01-01T09:00:00+01:00;48.85,2.35",
            "xx;Quai B;X2;3;2025-01-01T09:00:00+01:00;",
        ],
    )
    df = fl.read_counts_csv(spark, p)
    assert df.columns == ["site_id", "site_name", "hourly_count", "ts", "coordinates"]
    assert df.count() == 3
    assert fl.sniff_separator(spark, p) == ";"
    p2 = os.path.join(d, "comma.csv")
    _write_csv(p2, ["1,2"], header="a,b")
    assert fl.sniff_separator(spark, p2) == ","
    assert fl.read_csv_any_sep(spark, p2).columns == ["a", "b"]
    rng = fl.file_date_range(spark, p, "Date et heure de comptage").first()
    assert (rng.first_day, rng.last_day) == ("2025/01/01", "2025/01/01")
    missing = fl.file_date_range(spark, os.path.join(d, "none.csv"), "x").first()
    assert missing.first_day is None and missing.last_day is None


def _page(records, total=None):
    return {"total_count": total or len(records), "results": records}


def _rec(i, name, n, date, lat=48.8, lon=2.3):
    return {"id": str(i), "name": name, "sum_counts": str(n), "date": date, "coordinates": {"lat": lat, "lon": lon}}


def test_pages_and_weather_json(spark):
    d = _dir("pages")
    with open(os.path.join(d, "p1.json"), "w") as f:
        json.dump(_page([_rec(1, "A", 5, "2025-01-01T08:00:00+01:00"), _rec(2, "B", 7, "2025-01-01T08:30:00+01:00")]), f)
    with open(os.path.join(d, "p2.json"), "w") as f:
        json.dump(_page([_rec(1, "A", 6, "2025-01-01T09:00:00+01:00")]), f)
    rows = fl.read_count_pages(spark, d).orderBy("site_id", "ts").collect()
    assert len(rows) == 3 and rows[0].coordinates == "48.8,2.3"
    w = _dir("weather")
    with open(os.path.join(w, "w.json"), "w") as f:
        json.dump({"hourly": {"time": ["2025-01-01T00:00", "2025-01-01T01:00", "bad"], "rain": [0.0, 0.4, 1.0], "snowfall": [0, 0, 0],
                              "apparent_temperature": [1.5, 2.5, 3.5], "wind_speed_10m": [10.0, 20.0, 5.0]}}, f)
    wr = fl.read_weather_json(spark, w).collect()
    assert len(wr) == 3 and wr[1].time == dt.datetime(2025, 1, 1, 1) and wr[1].rain == 0.4 and wr[2].time is None


def test_append_new_upsert_and_guards(spark):
    d = _dir("sink")
    table = os.path.join(d, "raw")
    assert not sk.exists_and_not_empty(spark, table)
    new = spark.createDataFrame(
        [(1, dt.datetime(2025, 1, 1, 8), 5, 0), (1, dt.datetime(2025, 1, 1, 8), 9, 1), (2, dt.datetime(2025, 1, 1, 8), 3, 2), (None, dt.datetime(2025, 1, 1, 9), 1, 3)],
        "site_id long, ts timestamp_ntz, hourly_count long, ingest_seq long",
    )
    assert sk.append_new(spark, table, new) == 2
    assert sk.append_new(spark, table, new) == 0  # idempotent: keys already stored
    stored = {(r.site_id, r.hourly_count) for r in spark.read.parquet(table).collect()}
    assert stored == {(1, 5), (2, 3)}  # first landed copy wins
    assert sk.exists_and_not_empty(spark, table)
    upd = spark.createDataFrame([(2, dt.datetime(2025, 1, 1, 8), 30), (3, dt.datetime(2025, 1, 1, 8), 4)], "site_id long, ts timestamp_ntz, hourly_count long")
    v = sk.upsert_to_new_version(spark, table, upd, ["site_id", "ts"])
    assert {(r.site_id, r.hourly_count) for r in spark.read.parquet(v).collect()} == {(1, 5), (2, 30), (3, 4)}
    purged = sk.purge_recent(spark.read.parquet(v), dt.datetime(2025, 1, 8, 9), 7)
    assert purged.count() == 3 and sk.purge_recent(spark.read.parquet(v), dt.datetime(2025, 1, 8, 7), 7).count() == 0


def test_gaps_and_source_choice(spark):
    raw = spark.createDataFrame([(1, dt.datetime(2025, 1, 10, 5))], "site_id long, ts timestamp_ntz")
    g = inc.count_gap(raw, dt.date(2025, 1, 14)).first()
    assert (g.start_day, g.end_day) == (dt.date(2025, 1, 11), dt.date(2025, 1, 13))
    assert inc.count_gap(raw, dt.date(2025, 1, 11)).count() == 0  # max >= yesterday
    empty = spark.createDataFrame([], "site_id long, ts timestamp_ntz")
    assert inc.count_gap(empty, dt.date(2025, 1, 3)).first().start_day == dt.date(2020, 1, 1)
    assert inc.landed_days(inc.count_gap(raw, dt.date(2025, 1, 14))).count() == 3
    weather = spark.createDataFrame([(dt.datetime(2025, 1, 8, 23),)], "time timestamp_ntz")
    wg = inc.weather_gap(raw, weather).first()
    assert (wg.start_day, wg.end_day) == (dt.date(2025, 1, 9), dt.date(2025, 1, 10))
    assert inc.weather_source("2025-01-09", "2025-01-10") == "archive"
    assert inc.weather_source("2025-01-10", "2025-01-10") == "forecast"


def test_bootstrap_guard(spark):
    d = _dir("boot")
    p = os.path.join(d, "counts.csv")
    _write_csv(p, ["100;Quai A;X1;12;2025-01-01T08:00:00+01:00;48.85,2.35", "100;Quai A;X1;4;2025-01-01T08:00:00+01:00;48.85,2.35"])
    table = os.path.join(d, "raw")
    assert inc.bootstrap_counts(spark, p, table) == 1
    assert inc.bootstrap_counts(spark, p, table) == 0  # already populated


def test_stream_ingest_available_now(spark):
    landing, table, ckpt = _dir("land"), os.path.join(_dir("tbl"), "raw"), _dir("ckpt")
    with open(os.path.join(landing, "p1.json"), "w") as f:
        json.dump(_page([_rec(1, "A", 5, "2025-01-01T08:00:00+01:00"), _rec(1, "A", 8, "2025-01-01T08:10:00+01:00"), _rec(2, "B", 7, "2025-01-01T09:00:00")]), f)
    q = start_count_ingest(spark, landing, table, ckpt)
    q.awaitTermination(120)
    first = spark.read.parquet(table).count()
    assert first == 2  # two distinct (site, hour) keys
    with open(os.path.join(landing, "p2.json"), "w") as f:
        json.dump(_page([_rec(1, "A", 9, "2025-01-01T08:00:00"), _rec(3, "C", 1, "2025-01-01T10:00:00")]), f)
    q = start_count_ingest(spark, landing, table, ckpt)
    q.awaitTermination(120)
    assert spark.read.parquet(table).count() == 3  # only the new key landed


def test_late_pages_are_taken_over_several_batches(spark):
    landing, table, ckpt = _dir("land"), os.path.join(_dir("tbl"), "raw"), _dir("ckpt")
    for k, day in enumerate(("2025-03-20", "2025-03-01", "2025-02-01")):
        with open(os.path.join(landing, f"p{k}.json"), "w") as f:
            json.dump(_page([_rec(1, "A", k, f"{day}T08:00:00"), _rec(1, "A", 9, f"{day}T08:30:00")]), f)
        start_count_ingest(spark, landing, table, ckpt, max_files=1).awaitTermination(120)
    got = {str(r.ts)[:10] for r in spark.read.parquet(table).collect()}
    assert got == {"2025-03-20", "2025-03-01", "2025-02-01"} and spark.read.parquet(table).count() == 3


def test_append_new_keeps_the_month_layout(spark):
    d = _dir("month")
    table = os.path.join(d, "raw")
    schema = "site_id long, ts timestamp_ntz, hourly_count long"
    sk.write_by_month(spark.createDataFrame([(1, dt.datetime(2025, 1, 31, 23), 5)], schema), table)
    new = spark.createDataFrame([(1, dt.datetime(2025, 1, 31, 23), 9), (1, dt.datetime(2025, 2, 1, 0), 6), (2, dt.datetime(2025, 1, 1, 0), 7)], schema)
    assert sk.append_new(spark, table, new) == 2
    assert sk.append_new(spark, table, sk.with_month(new)) == 0
    rows = {(r.site_id, r.hourly_count, r.month) for r in spark.read.parquet(table).collect()}
    assert rows == {(1, 5, "2025-01"), (1, 6, "2025-02"), (2, 7, "2025-01")}
    assert sorted(n for n in os.listdir(d) if "staging" in n) == []


def test_upsert_keeps_one_row_per_key_and_months_are_rewritten_alone(spark):
    d = _dir("ups")
    schema = "site_id long, ts timestamp_ntz, hourly_count long"
    t = dt.datetime
    old = spark.createDataFrame([(1, t(2025, 1, 5), 1), (1, t(2025, 2, 5), 2), (2, t(2025, 2, 6), 3)], schema)
    new = spark.createDataFrame([(1, t(2025, 2, 5), 20), (1, t(2025, 2, 5), 21), (3, t(2025, 3, 1), 4)], schema)
    assert sorted(r.hourly_count for r in sk.upsert(old, new, ["site_id", "ts"]).collect()) == [1, 3, 4, 21]
    table = os.path.join(d, "fc")
    sk.write_by_month(old, table)
    january = os.listdir(os.path.join(table, "month=2025-01"))
    assert sk.upsert_months(spark, table, new, ["site_id", "ts"]) == ["2025-02", "2025-03"]
    assert os.listdir(os.path.join(table, "month=2025-01")) == january
    assert sorted(r.hourly_count for r in spark.read.parquet(table).collect()) == [1, 3, 4, 21]


def test_a_shared_checkpoint_folder_is_required_on_a_cluster():
    import pytest

    from velora.session import ensure_checkpoint_dir

    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    fake = type("S", (), {"sparkContext": Context(), "conf": Conf()})()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(fake)


def test_empty_landing_folder_gives_empty_frame(spark):
    d = _dir("empty")
    df = fl.read_count_pages(spark, d)
    assert df.count() == 0 and df.columns == ["site_id", "site_name", "hourly_count", "ts", "coordinates"]
