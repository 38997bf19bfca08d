import hashlib

from pyspark.sql import functions as F

from tests.llm.helpers import docs, plan_of
from velora.llm import fingerprints as P


def sketch(text):
    w = [x for x in (text or "").lower().replace("\t", " ").replace("\n", " ").split(" ") if x]
    grams = [" ".join(w[i : i + 5]) for i in range(len(w) - 4)] or ([" ".join(w)] if w else [])
    h = {hashlib.md5(g.encode()).hexdigest()[:16] for g in grams}
    return sorted({x for x in h if x < "2"} or ({min(h)} if h else set()))


def near(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0


def slow(rows):
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for i, (d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        k = len(t) // 2
        e = t[: len(t) - k] + nxt[:k]
        s = sketch(t), sketch(e), sketch(nxt)
        row = (d, len(t), hashlib.sha256(e.encode()).hexdigest(), "".join(s[0]), "".join(s[1]), near(s[0], s[1]), near(s[0], s[2]))
        out.append(row)
    return sorted(out, key=str)


def rows():
    out = [(3 * i, " ".join(f"W{(i * j) % 37}é" for j in range(5 + 3 * i))) for i in range(40)]
    return [*out, (1, None), (2, ""), (4, "x"), (5, "a b c"), (5, "a b c"), (5, "another text"), (None, "no id at all"), (None, None), (10**15, "😀" * 9)]


def test_report_equals_brute_force(spark):
    df = P.fingerprint_report(docs(spark, rows(), extra=["sketch", "halo", "fingerprint"]))
    assert "Python" not in plan_of(df) and "Arrow" not in plan_of(df)
    assert sorted((tuple(r) for r in df.collect()), key=str) == slow(rows())


def test_one_row_follows_itself_and_empty_table(spark):
    one = [(1, "a b c d e f g h")]
    assert [tuple(r) for r in P.fingerprint_report(docs(spark, one)).collect()] == slow(one)
    assert P.fingerprint_report(docs(spark, [])).collect() == []


def test_merge_and_containment(spark):
    a = " ".join(f"a{i}" for i in range(400))
    b = " ".join(f"b{i}" for i in range(4000))
    df = docs(spark, [(1, a), (2, b), (3, "one two")])
    s = {r.doc_id: r.s for r in P.with_sketch(df, "text", "s").collect()}
    assert s[1] == sketch(a) and s[3] == sketch("one two") and len(s[3]) == 1
    pair = spark.createDataFrame([(s[1], s[2], sketch(a + " " + b), s[3])], "a array<string>, b array<string>, ab array<string>, c array<string>")
    got = pair.select(P.containment(F.col("a"), F.col("ab")), P.merge(F.col("a"), F.col("b")), P.merge(F.col("a"), F.col("c"))).first()
    assert got[0] == 1.0 and set(got[1]) == set(s[1]) | set(s[2]) and got[2] == s[1]
