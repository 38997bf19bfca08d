import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SF01
from tests.llm.helpers import docs
from velora.llm import language_id as L


def grams(text):
    plain = " " + L._NOT_LETTERS.sub(" ", text.lower()).strip() + " "
    return {plain[i : i + n] for n in range(1, L.MAX_N + 1) for i in range(len(plain) - n + 1)}


def test_spectrum_counts_distinct_grams():
    for text in ("Über den Fluß, 42 x", "a", "aaaa aaaa", "日本語 text"):
        slots = L.spectrum(text)
        assert len(slots) == len(set(slots.tolist())) == len(grams(text))


def kernel(x, y):
    return len(grams(x) & grams(y)) / (len(grams(x)) * len(grams(y))) ** 0.5


def test_scores_equal_kernel_ridge_on_gram_sets():
    """k(x, L) a with (K_mn W K_nm + c K_mm) a = K_mn W Y: the same regression without slots, map or table."""
    rng = np.random.default_rng(1)
    word = lambda p: " ".join("".join(rng.choice(list(p), 4)) for _ in range(8))
    samples = [(lang, word(p)) for lang, p, n in (("a", "abc", 14), ("b", "bcd", 9), ("c", "xyz", 5)) for _ in range(n)]
    tests = [word("abc"), word("bcd"), word("xyz"), word("abcd"), "zz", "no known gram: qqq"]
    texts = [t for _, t in samples] + tests
    assert len(set.union(*map(grams, texts))) == len({int(s) for t in texts for s in L.spectrum(t)})  # no two grams share a slot
    landmarks = [t for lang in "abc" for t in [t for x, t in samples if x == lang][:4]]
    k_nm = np.array([[kernel(t, m) for m in landmarks] for _, t in samples])
    k_mm = np.array([[kernel(t, m) for m in landmarks] for t in landmarks])
    y = np.array([[float(lang == x) for x in "abc"] for lang, _ in samples])
    w = np.diag([len(samples) / (3 * sum(x == lang for x, _ in samples)) for lang, _ in samples])
    a = np.linalg.solve(k_nm.T @ w @ k_nm + L.RIDGE * len(samples) / 3 * k_mm, k_nm.T @ w @ y)
    want = np.array([[kernel(t, m) for m in landmarks] for t in tests]) @ a

    model = L.fit([(lang, L.spectrum(t)) for lang, t in samples], landmarks=12)
    assert model.languages == ["a", "b", "c"]
    assert np.allclose(model.scores([L.spectrum(t) for t in tests]), want, atol=1e-4)
    assert want[:3].argmax(axis=1).tolist() == [0, 1, 2]


def test_held_out_accuracy_and_fold(spark):
    df = spark.read.parquet(f"{SF01}/documents.parquet")
    got = L.language_report(df).join(df.select("doc_id", "lang", "text"), "doc_id")
    r = got.filter("held_out and lang_pred <> 'und'").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double")), F.count("*")).first()
    assert r[1] > 150 and r[0] > 0.97
    bad = got.filter((F.col("held_out") != (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)) | ~F.col("score").between(0, 1))
    assert bad.count() == 0


def test_nulls_ties_and_extra_columns(spark):
    en, de = "the cat and the dog were here " * 3, "der hund und die katze waren da " * 3
    rows = [(i, en if i % 2 else de, "en" if i % 2 else "de") for i in range(40)]
    rows += [(100, None, "en"), (101, "", None), (102, "12 ? 4²", "de"), (103, "the " * 50_000, None), (None, en, "en"), (3, en, "en")]
    got = L.language_report(docs(spark, rows, extra=["language", "score", "held_out"])).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and by[100].score == 0
    assert by[103].lang_pred == "en" and by[None].lang_pred == "en" and by[None].held_out is False
    assert all(r.lang_pred == ("en" if r.doc_id % 2 else "de") for r in got if r.doc_id is not None and r.doc_id < 40)


def test_no_labels_and_empty(spark):
    assert {r.lang_pred for r in L.language_report(docs(spark, [(1, "some text", None)])).collect()} == {"und"}
    assert L.language_report(docs(spark, [])).collect() == []


def test_every_language_is_learned_and_long_texts_too(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(110):
        words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(30)]
        rows += [(8 * k + i, " ".join(rng.permutation(words)) * (60 if k == 0 else 1), f"l{k:03}") for i in range(6)]
    model = L.train(docs(spark, rows))
    assert len(model.languages) == 110
    got = L.predict(docs(spark, rows), model).select("lang", "language.lang_pred").collect()
    assert sum(r[0] == r[1] for r in got) >= 0.98 * len(got)
