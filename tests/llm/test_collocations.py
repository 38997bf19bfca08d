import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import docs
from velora.llm import collocations as C

UPPER = {c: c + 32 for c in range(65, 91)}


def brute_counts(rows, max_words=5):
    """Counts of all phrases and words per language by plain loops; rows are (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    return f, n


def brute(rows, least, max_words=5, top=2000):
    f, n = brute_counts(rows, max_words)
    f = {k: v for k, v in f.items() if v >= least}
    out = {}
    for (lang, w), a in f.items():
        if len(w) < 2:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        inside = any(
            lang2 == lang and len(x) > len(w) and 100 * b >= 100 * a and any(x[i : i + len(w)] == w for i in range(len(x) - len(w) + 1))
            for (lang2, x), b in f.items()
        )
        if not inside:
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted(
        (lang, i, p.decode(), -a, left, right, n[lang], -s)
        for lang, rows in out.items()
        for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)
    )


def frame(spark, rows, **kw):
    return docs(spark, [(i, t, lang) for i, (lang, t) in enumerate(rows)], **kw)


def made(seed, n=300):
    r = random.Random(seed)
    words = ["a", "b", "C", "the", "The", "é", "x\x1fy", "\x00", "中"]
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!", "?;", "\x0b", "\r", "\x85", "\xa0"]
    rows = []
    for _ in range(n):
        text = "".join(r.choice(words) + r.choice(marks) for _ in range(r.randint(0, 30)))
        rows.append((r.choice(["en", "en", "en", None, "und", ""]), text))
    return rows + [("en", None), (None, None), ("de", ""), ("en", " .. \t"), *rows[:20]]


@pytest.mark.parametrize("seed,least", [(1, 3), (2, 12), (3, 1)])
def test_equals_brute_force(spark, monkeypatch, seed, least):
    rows = made(seed, 120 if least == 1 else 300)
    monkeypatch.setattr(C, "BLOCK_BYTES", 500)
    got = C.collocations(frame(spark, rows, extra=("phrase", "a", "n", "fp")).repartition(4), least=least)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, least)


def test_small_blocks_and_a_full_bitmap_give_the_same(spark):
    """With 64 places nearly all fingerprints collide in the bitmap: counts by text stay exact."""
    rows = made(5)
    want = {(lang, " ".join(w)): a for (lang, w), a in brute_counts(rows)[0].items() if a >= 4}
    for bits, block in ((6, 200), (C.BITS, 1 << 20)):
        got = C.frequent_phrases(frame(spark, rows), least=4, bits=bits, block_bytes=block).filter("phrase IS NOT NULL").collect()
        assert {(r.lang, r.phrase): r.a for r in got} == want and len(got) == len(want)


def test_equal_fingerprints_are_told_apart(spark, monkeypatch):
    """With one fingerprint for everything, verification against the words still separates phrases."""
    monkeypatch.setattr(C.xxhash, "xxh3_64_intdigest", lambda w: 7)
    rows = [("en", "a b c d")] * 6 + [("en", "x y")] * 5
    block = C.Block(*C._numbered([(lang, t.encode()) for lang, t in rows]))
    at = block.starts(2)
    assert len(set(block.fingerprints(at, 2).tolist())) == 1
    first, counts = block.phrases(at, 2)
    assert sorted((block.text(i, 2), n) for i, n in zip(first.tolist(), counts.tolist())) == [(b"a b", 6), (b"b c", 6), (b"c d", 6), (b"x y", 5)]


def test_fingerprints_depend_on_words_only():
    one = C.Block(*C._numbered([("en", b"p q. the old house stood. z"), ("de", b"the old house")]))
    two = C.Block(*C._numbered([("fr", b"u"), ("en", b"THE Old\thouse")]))
    at = {one.text(i, 3): one.fingerprints(np.array([i]), 3)[0] for i in one.starts(3).tolist() if one.lang[i] == 0}
    (i,) = two.starts(3).tolist()
    assert two.fingerprints(np.array([i]), 3)[0] == at[b"the old house"] != at[b"old house stood"]
    (j,) = [k for k in one.starts(3).tolist() if one.lang[k] == 1]
    assert one.fingerprints(np.array([j]), 3)[0] != at[b"the old house"]


def test_products_beyond_64_bits_are_exact(spark):
    big = 3_037_000_500
    rows = [("en", "p q", 2, big), ("en", "p", 1, big + 1), ("en", "q", 1, big + 2), ("en", None, 0, 9 * 10**12)]
    table = spark.createDataFrame(rows, "lang string, phrase string, words int, a long")
    original = C.frequent_phrases
    try:
        C.frequent_phrases = lambda *a, **k: table
        (row,) = C.collocations(table).collect()
    finally:
        C.frequent_phrases = original
    assert row.score == 1000 * big * 9 * 10**12 // ((big + 1) * (big + 2))


def test_long_text_and_empty_table(spark):
    rows = [("en", "lorem ipsum " * 60_000), ("en", "w" * 1_000_000), ("en", "lorem ipsum dolor")]
    got = C.collocations(frame(spark, rows)).collect()
    assert [(r.phrase, r.a) for r in got if r.rank <= 2] == [tuple(x[2:4]) for x in brute(rows, 100) if x[1] <= 2]
    assert C.collocations(frame(spark, rows).limit(0)).collect() == []
