"""A16 from the stored index: equal to the brute force after late landings, and without raw rows or windows in its plan."""

import datetime as dt
import os
import random
import tempfile

from pyspark.sql import functions as F

from tests.test_histref import _brute
from tests.test_plans import _plan
from velora.operators import histindex as hx
from velora.operators.histref import historical_reference
from velora.sinks import tables as sk

TYPE = "site_id long, ts timestamp_ntz, hourly_count long"
BASE = dt.datetime(2025, 1, 1)


def _case(seed):
    r = random.Random(seed)
    rows = [(s, BASE + dt.timedelta(hours=r.randint(0, 24 * 150)), r.choice([None, 1, 2, 3, 7, 10])) for s in (1, 2) for _ in range(700)]
    rows += [(3, BASE + dt.timedelta(days=k), k) for k in range(0, 150, 9)] + rows[:20]  # a sparse site, and repeated rows
    targets = [(r.choice((1, 2, 3)), BASE + dt.timedelta(hours=r.randint(0, 24 * 170))) for _ in range(300)]
    targets += [(1, BASE + dt.timedelta(days=k)) for k in (0, 28, 56, 57, 84, 112, 205, 206, 207, 240)] + [(9, BASE), *targets[:5]]
    return rows, targets


def _check(got, want):
    got = {(r.site_id, r.ts): (r.level, r.n, r.reference) for r in got.collect()}
    assert set(got) == set(want)
    for k, (level, n, v) in want.items():
        assert got[k][:2] == (level, n) and abs(got[k][2] - v) < 1e-9, k
    return {v[0] for v in want.values()}


def test_late_landings_equal_brute_force(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="velora-hx-"), "index")
    rows, targets = _case(3)
    tg = spark.createDataFrame(targets, TYPE.rsplit(",", 1)[0])
    late = [x for x in rows if x[1] < BASE + dt.timedelta(days=20)]
    first = [x for x in rows if BASE + dt.timedelta(days=20) <= x[1] < BASE + dt.timedelta(days=110)]
    rest = [x for x in rows if x[1] >= BASE + dt.timedelta(days=110)]
    seen = []
    for part in (first, rest, late, [(None, BASE, 1), (4, None, 1)], []):
        hx.land_index(spark, spark.createDataFrame(part, TYPE), path)
        seen += [x for x in part if None not in x[:2]]
        levels = _check(hx.reference_from_index(spark.read.parquet(path), tg), _brute(seen, targets))
    assert levels == {1, 2, 3, 4}


def test_equals_the_direct_form_and_an_unstored_index(spark):
    rows, targets = _case(5)
    raw, tg = spark.createDataFrame(rows, TYPE), spark.createDataFrame(targets, TYPE.rsplit(",", 1)[0])
    a = hx.reference_from_index(hx.build_index(raw), tg)
    b = historical_reference(raw, tg)
    assert a.columns == b.columns
    assert sorted(a.collect()) == sorted(b.collect())


def test_empty_index_and_targets(spark):
    rows, targets = _case(6)
    none = spark.createDataFrame([], TYPE)
    assert hx.reference_from_index(hx.build_index(none), spark.createDataFrame(targets, TYPE.rsplit(",", 1)[0])).collect() == []
    assert hx.reference_from_index(hx.build_index(spark.createDataFrame(rows, TYPE)), none).collect() == []


def test_look_ups_have_no_window_and_read_their_months_only(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="velora-hx-"), "index")
    rows, _ = _case(7)
    hx.land_index(spark, spark.createDataFrame(rows, TYPE), path)
    tg = spark.createDataFrame([(1, BASE + dt.timedelta(days=130, hours=5))], "site_id long, ts timestamp_ntz")
    plan = _plan(hx.reference_from_index(spark.read.parquet(path), tg))
    assert "Window" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    assert "PartitionFilters: [isnotnull(month" in plan


def test_a_late_row_rewrites_the_months_of_its_block(spark):
    root = tempfile.mkdtemp(prefix="velora-hx-")
    path = os.path.join(root, "index")
    rows, _ = _case(8)
    hx.land_index(spark, spark.createDataFrame(rows, TYPE), path)

    def files():
        return {(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}

    before = files()
    hx.land_index(spark, spark.createDataFrame([(1, BASE + dt.timedelta(days=60), 5)], TYPE), path)
    months = {os.path.basename(d) for d, _ in before ^ files()}
    start = spark.range(1).select(F.date_format(hx._block_start(F.unix_date(F.lit(BASE.date() + dt.timedelta(days=60)))), "yyyy-MM")).first()[0]
    assert months == {f"month={start}"}
    assert os.listdir(root) == ["index"]
    assert sk.recover_months(spark, path) is False
