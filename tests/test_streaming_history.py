"""W8 as streaming state: after out-of-order runs equal to the newest values of all rows."""

import datetime as dt
import json
import os
import random
import tempfile

import pandas as pd

from tests.test_io import _page, _rec
from velora.operators.history import last_values
from velora.streaming.history import newest_pairs, start_history_stream, stored_history

T0 = dt.datetime(2025, 1, 1)


def test_newest_pairs_equal_a_sort_of_all_rows():
    r = random.Random(4)
    state, seen = ([], []), {}
    for _ in range(30):
        rows = [(r.randrange(400), float(r.randrange(9))) for _ in range(r.randrange(60))]
        cut = r.randrange(len(rows) + 1)
        state = newest_pairs(state, iter([pd.DataFrame(x, columns=["hour", "count"]) for x in (rows[:cut], rows[cut:]) if x]), 24)
        batch = {}
        for h, c in rows:
            batch[h] = min(c, batch.get(h, c))
        seen = batch | seen
        want = sorted(seen.items())[-24:]
        assert list(zip(*state)) == want


def test_three_out_of_order_runs_equal_last_values(spark):
    root = tempfile.mkdtemp(prefix="velora-hs-")
    landing = os.path.join(root, "landing")
    os.mkdir(landing)
    r = random.Random(5)
    rows = {(s, h): r.randrange(50) for s, n in ((1, 90), (2, 24), (3, 5), (4, 1)) for h in r.sample(range(900), n)}
    keys = list(rows)
    r.shuffle(keys)
    for k in range(3):
        recs = [_rec(s, "A", rows[s, h], (T0 + dt.timedelta(hours=h)).isoformat()) for s, h in keys[k::3]]
        recs += [_rec(1, "A", 999, (T0 + dt.timedelta(hours=h)).isoformat()) for s, h in keys[(k - 1) % 3 :: 3] if s == 1 and k]  # stored hours again
        recs += [_rec(None, "A", 1, T0.isoformat()), _rec(5, "A", None, T0.isoformat()), _rec(5, "A", 3, None)]
        for part in range(2):
            with open(os.path.join(landing, f"p{k}{part}.json"), "w") as f:
                json.dump(_page(recs[part::2]), f)
        start_history_stream(spark, landing, f"{root}/table", f"{root}/checkpoint", max_files=1 if k == 0 else 1000).awaitTermination()
    raw = spark.createDataFrame([(s, T0 + dt.timedelta(hours=h), v) for (s, h), v in rows.items()], "site_id long, ts timestamp_ntz, hourly_count long")
    assert sorted(stored_history(spark, f"{root}/table").collect()) == sorted(last_values(raw).collect())
    since = T0 + dt.timedelta(hours=600)
    want = sorted(last_values(raw.filter(raw.ts >= since)).collect())
    assert sorted(stored_history(spark, f"{root}/table", since).collect()) == want
    start_history_stream(spark, landing, f"{root}/table", f"{root}/checkpoint").awaitTermination()  # nothing new
    assert stored_history(spark, f"{root}/table").count() == 4
    assert not [x for x in os.listdir(root) if "staging" in x]


def test_no_pages_give_no_rows(spark):
    root = tempfile.mkdtemp(prefix="velora-hs-")
    os.mkdir(f"{root}/landing")
    start_history_stream(spark, f"{root}/landing", f"{root}/table", f"{root}/checkpoint").awaitTermination()
    assert stored_history(spark, f"{root}/table").collect() == []
