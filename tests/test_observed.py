"""Checks from the load's own pass: counts of bad text, warnings and errors."""

import os
import tempfile

import pytest

from velora.operators.observed import load_observed

TEXT = "site_id string, ts string, hourly_count string, site_name string"
ROWS = [
    ("1", "2025-01-01T08:00:00+01:00", "5", "A"), ("1", "2025-01-01T08:00:00+01:00", "5", "A"), ("2", "2025-01-02T09:00:00", "n/a", "B"),
    (None, "2025-01-01T08:00:00", "1", "C"), (" ", "2025-01-03T08:00:00", "", "C"), ("x", "2025-01-04T08:00:00", None, "C"),
    ("3", "soon", "4", "D"), ("3", None, "4", "D"),
]


def _table():
    return os.path.join(tempfile.mkdtemp(prefix="velora-obs-"), "raw")


def test_counts_of_bad_text_come_with_the_write(spark):
    path = _table()
    with pytest.warns(UserWarning, match="unreadable text in 8 landed rows"):
        got = load_observed(spark, spark.createDataFrame(ROWS, TEXT), path)
    last = got.pop("last_ts"), got.pop("first_ts")
    assert [str(x) for x in last] == ["2025-01-02 09:00:00", "2025-01-01 08:00:00"]
    assert got == {
        "rows": 8, "missing_ids": 2, "unreadable_ids": 1, "missing_times": 1, "unreadable_times": 1, "missing_counts": 2,
        "unreadable_counts": 1, "kept": 3, "kept_counts": 2, "appended": 2,
    }
    assert spark.read.parquet(path).count() == 2


def test_good_rows_give_no_warning_and_load_once(spark, recwarn):
    path, rows = _table(), spark.createDataFrame(ROWS[:2], TEXT)
    assert [load_observed(spark, rows, path)["appended"] for _ in range(2)] == [1, 0]
    assert not [w for w in recwarn if "unreadable" in str(w.message)]


def test_rows_without_any_key_are_an_error_and_none_is_fine(spark):
    path = _table()
    with pytest.raises(ValueError, match="none of 4 landed rows"):
        load_observed(spark, spark.createDataFrame(ROWS[3:5] + ROWS[6:], TEXT), path)
    assert not os.path.exists(path)
    assert load_observed(spark, spark.createDataFrame([], TEXT), path)["rows"] == 0


def test_the_landed_rows_are_read_once(spark, monkeypatch):
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            reads.add(len(b))
            yield b

    text = spark.createDataFrame(ROWS[:3], TEXT).mapInPandas(count, TEXT)
    with pytest.warns(UserWarning):
        load_observed(spark, text, _table())
    assert reads.value == 3
