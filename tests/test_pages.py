"""Bad pages and mixed CSV dialects: nothing that lands is lost without a trace."""

import json
import os
import tempfile

import pytest

from velora.plans import jobs  # noqa: F401
from velora.sources import files as fl
from velora.sources import pages as pg
from velora.streaming.incremental import update_counts_from_pages
from velora.streaming.stream import start_count_ingest


def _rec(i, n=1, hour=8, lat=48.8):
    return {"id": str(i), "name": f"S{i}", "sum_counts": str(n), "date": f"2025-01-01T{hour:02d}:00:00+01:00", "coordinates": {"lat": lat, "lon": 2.0}}


GOOD = json.dumps({"total_count": 5, "results": [_rec(1), _rec(2)]})
CASES = {
    "good.json": (GOOD, 5, 2, None),
    "none.json": ('{"total_count": 0, "results": []}', 0, 0, None),
    "zero.json": ('{"total_count": 0}', 0, 0, None),
    "cut.json": (GOOD[:90], None, 0, "unreadable"),
    "two.json": (GOOD + GOOD, None, 0, "unreadable"),
    "blank.json": ("   ", None, 0, "unreadable"),
    "array.json": ("[1, 2]", None, 0, "unreadable"),
    "null.json": ("null", None, 0, "unreadable"),
    "text.json": ("<html>busy</html>", None, 0, "unreadable"),
    "unlisted.json": ('{"total_count": 3}', 3, 0, "unreadable"),
    "odd.json": ('{"total_count": 3, "results": {"a": 1}}', 3, 0, "unreadable"),
    "latitude.json": (json.dumps({"total_count": 5, "results": [_rec(3), _rec(4, lat="x")]}), 5, 2, "damaged fields"),
    "hole.json": (json.dumps({"total_count": 5, "results": [None, _rec(5)]}), 5, 1, "damaged fields"),
}


def _land(folder, names, sub=""):
    os.makedirs(os.path.join(folder, sub), exist_ok=True)
    for n in names:
        with open(os.path.join(folder, sub, n), "w") as f:
            f.write(CASES[n][0])


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="pages-")


def test_each_kind_of_page(spark, folder):
    _land(folder, CASES)
    pages = pg.parse_pages(pg.page_texts(spark, folder))
    got = {r.file.rsplit("/", 1)[1]: (r.announced, r.landed, r.reason) for r in pg.page_report(pages).collect()}
    assert {k: v[1:] for k, v in got.items()} == {k: v[2:] for k, v in CASES.items()}
    assert all(got[k][0] == v[1] for k, v in CASES.items() if k not in ("two.json",))
    kept = {r.file.rsplit("/", 1)[1]: r.text for r in pg.quarantined(pages).collect()}
    assert kept == {k: v[0] for k, v in CASES.items() if v[3]}
    assert sorted(r.site_id for r in pg.page_records(pages).collect()) == ["1", "2", "3", "4", "5"]
    assert fl.read_count_pages(spark, folder).count() == 5


def test_totals_name_the_missing_records(spark, folder):
    _land(folder, ["good.json", "cut.json"], "day=2025-01-01")
    _land(folder, ["text.json"], "day=2025-01-02")
    _land(folder, ["good.json"])  # no folder: the day of its first record
    rows = pg.request_totals(pg.parse_pages(pg.page_texts(spark, folder))).collect()
    got = {r.request: (r.pages, r.announced, r.landed, r.bad_pages, r.missing, r.complete) for r in rows}
    assert got == {
        "day=2025-01-01": (2, 5, 2, 1, 3, False),
        "day=2025-01-02": (1, None, 0, 1, None, False),
        "2025-01-01": (1, 5, 2, 0, 3, False),
    }


def test_batch_load_keeps_bad_texts_once(spark, folder):
    _land(folder, ["good.json", "cut.json", "hole.json"], "in")
    table = f"{folder}/raw"
    assert update_counts_from_pages(spark, f"{folder}/in", table) == 3
    assert update_counts_from_pages(spark, f"{folder}/in", table) == 0
    bad = spark.read.parquet(f"{table}_quarantine")
    assert sorted((r.reason, r.text) for r in bad.collect()) == [("damaged fields", CASES["hole.json"][0]), ("unreadable", CASES["cut.json"][0])]


def test_stream_keeps_bad_texts_and_takes_the_mended_page(spark, folder):
    landing, table = f"{folder}/in", f"{folder}/raw"
    _land(landing, ["cut.json", "hole.json"])
    for _ in range(2):
        start_count_ingest(spark, landing, table, f"{folder}/ckpt").awaitTermination()
    assert spark.read.parquet(f"{table}_quarantine").count() == 2 and spark.read.parquet(table).count() == 1
    _land(landing, ["good.json"])
    start_count_ingest(spark, landing, table, f"{folder}/ckpt").awaitTermination()
    assert sorted(r.site_id for r in spark.read.parquet(table).collect()) == [1, 2, 5]
    assert spark.read.parquet(f"{table}_quarantine").count() == 2


def test_only_bad_or_no_pages(spark, folder):
    _land(folder, ["text.json"], "in")
    assert update_counts_from_pages(spark, f"{folder}/in", f"{folder}/raw") == 0
    os.makedirs(f"{folder}/empty")
    assert fl.read_count_pages(spark, f"{folder}/empty").collect() == []


def _write(folder, name, text):
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        f.write(text)


def test_separator_and_columns_per_file(spark, folder):
    _write(folder, "a.csv", "a;b\n1;2\n\n3;x,y\n")
    _write(folder, "b.csv", "B,c,a\n4,5,6\n\"7,7\",,8\n")
    _write(folder, "c.csv", "﻿a\n9\n")
    _write(folder, "d.csv", "b;a\n")
    _write(folder, "e.csv", "")
    df = fl.read_csv_any_sep(spark, folder)
    assert [c.lower() for c in df.columns] == ["a", "b", "c"]
    got = sorted(tuple(r) for r in df.select("a", "b", "c").fillna("-").collect())
    assert got == [("1", "2", "-"), ("3", "x,y", "-"), ("6", "4", "5"), ("8", "7,7", "-"), ("9", "-", "-")]


def test_counts_of_two_dialects(spark, folder):
    _write(folder, "a.csv", "Identifiant du site de comptage;Nom du site de comptage;Comptage horaire;Date et heure de comptage;Coordonnées géographiques\n1;A;2;2025-01-01T08:00:00+01:00;48.8,2.3\n")
    _write(folder, "b.csv", "comptage_horaire,coordonnees_geographiques,nom_du_site_de_comptage,identifiant_du_site_de_comptage,date_et_heure_de_comptage\n3,\"48.9,2.4\",B,2,2025-01-01T09:00:00+01:00\n")
    rows = sorted(tuple(r) for r in fl.read_counts_any_csv(spark, folder).collect())
    assert rows == [("1", "A", "2", "2025-01-01T08:00:00+01:00", "48.8,2.3"), ("2", "B", "3", "2025-01-01T09:00:00+01:00", "48.9,2.4")]
    _write(folder, "b.csv", "x,y\n1,2\n")
    os.remove(f"{folder}/a.csv")
    with pytest.raises(ValueError):
        fl.read_counts_any_csv(spark, folder)


def test_header_of_a_split_file_is_found(spark, folder):
    """A file read in several tasks: rows of the later blocks follow the header of the first."""
    _write(folder, "long.csv", "a,b\n" + "".join(f"{i},{i}\n" for i in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert spark.read.text(folder).rdd.getNumPartitions() > 1
        df = fl.read_csv_any_sep(spark, folder)
        assert df.selectExpr("count(*)", "sum(a)", "sum(b)").first()[:] == (20_000, 199_990_000.0, 199_990_000.0)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
