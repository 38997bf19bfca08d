import hashlib
import random
import re

import pytest

from tests.conftest import SF001
from tests.llm.helpers import docs
from velora.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def slow(rows, items, window=13):
    grams = {}
    for item, text in items:
        w = words(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1) if w else ():
            grams.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    out = []
    for d, text in rows:
        w = words(text)
        hit, found = set(), set()
        for k in {len(g) for g in grams}:
            for i in range(len(w) - k + 1):
                who = grams.get(tuple(w[i : i + k]))
                if who:
                    hit |= set(range(i, i + k))
                    found |= who
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def report(spark, rows, items, **kw):
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = D.decontamination_report(docs(spark, rows, extra=["match", "n_words"]), bench, **kw).drop("spans", "items")
    return sorted((tuple(r) for r in got.collect()), key=str)


def random_case(seed):
    r = random.Random(seed)
    letters = "abc"
    items = [(i, " ".join(r.choice(letters) for _ in range(r.choice([1, 2, 3, 5, 8, 20])))) for i in range(12)]
    items += [(50, items[0][1]), (51, None), (52, "  ,, "), (53, items[7][1].upper())]
    rows = [(i, ", ".join(r.choice(letters + "x") for _ in range(r.choice([0, 1, 4, 30, 80])))) for i in range(30)]
    rows += [(90, None), (91, ""), (92, "é É x"), (None, items[3][1]), (3, rows[3][1])]
    return rows, items


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force_with_small_windows(spark, seed):
    rows, items = random_case(seed)
    bench = [(i, words(t)) for i, t in items]
    a = D.Automaton.build([(str(i), w) for i, w in bench], window=4)
    for d, text in rows:
        spans, found = a.match(words(text))
        assert all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
        got = (d, len(words(text)), sum(b - a for a, b in spans), len(found))
        assert got == slow([(d, text)], items, window=4)[0][:4]


def test_report_equals_brute_force(spark):
    rows, items = random_case(9)
    assert report(spark, rows, items, window=4) == slow(rows, items, window=4)


def test_tables_equal_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").select("item_id", "text").collect()]
    want = slow(rows, items)
    assert report(spark, rows, items) == want
    assert any(x[5] for x in want)


@pytest.mark.parametrize("pass_bytes", [1, 6000, 1 << 20])
def test_blocks_give_the_same(spark, pass_bytes):
    rows, items = random_case(2)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    one = D.with_matches(docs(spark, rows), bench, window=4).select("doc_id", "match").collect()
    many = D.with_matches(docs(spark, rows), bench, window=4, block_words=15, pass_bytes=pass_bytes).select("doc_id", "match").collect()
    assert sorted(map(str, one)) == sorted(map(str, many))


def test_blocks_are_bounded_and_hold_every_window(spark):
    rows, items = random_case(5)
    r = random.Random(1)
    long = (70, " ".join(r.choice("abcdefgh") for _ in range(500)))
    bench = spark.createDataFrame([*items, long, long, (None, "a a b")], "item_id bigint, text string")
    pieces = D.benchmark_pieces(bench, window=4, block_words=15).collect()
    assert all(0 < r.n <= 15 and r.n == len(r.words.split(" ")) for r in pieces)
    assert len(pieces) == len({(r.item, r.words) for r in pieces})
    w = words(long[1])
    want = {tuple(w[i : i + 4]) for i in range(len(w) - 3)}
    own = [r.words.split(" ") for r in pieces if r.item == "70"]
    assert {tuple(p[i : i + 4]) for p in own for i in range(len(p) - 3)} == want and all(len(p) >= 4 for p in own)
    blocks = D.build_blocks(bench, window=4, block_words=15)
    assert blocks.count() > 30 and blocks.count() == blocks.select("key").distinct().count()
    for b in D.passes(blocks, pass_bytes=50_000):
        assert all(max(a.length) <= 15 for a in b.value.automata())


def test_empty_tables(spark):
    rows, items = random_case(1)
    assert report(spark, [], items) == []
    assert all(x[2:4] == (0, 0) and not x[5] for x in report(spark, rows, []))


def test_contaminated_rows_go_and_spans_are_cut(spark):
    item = " ".join(f"k{i}" for i in range(15))
    clean = " ".join(f"c{i}" for i in range(100))
    rows = [(1, clean), (2, f"{clean}, {item.upper()}! end"), (3, " ".join([clean] * 4) + " " + item), (4, None), (2, item)]
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    df = docs(spark, rows)
    kept = D.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.text) == sorted([rows[0], rows[2]])
    cut = {(r.doc_id, r.text): r.removed_words for r in D.remove_spans(df, bench, min_span=16).collect()}
    assert cut == {(1, clean): 0, (2, f"{clean}, ! end"): 15, (3, rows[2][1]): 0, (4, None): 0, (2, ""): 15}
    assert D.remove_spans(df, bench).filter("doc_id = 3").first().removed_words == 15
