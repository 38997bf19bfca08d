import random

import xxhash

from tests.llm.helpers import docs
from velora.llm import simhash


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 3 and group[j] < group[i]:
                    group[i], changed = group[j], True
    ids = {}
    for g, (d, _) in zip(group, rows):
        if d is not None:
            ids[g] = min(d, ids.get(g, d))
    return sorted(((d, f"{f:016x}", ids.get(g)) for (d, _), f, g in zip(rows, fps, group)), key=str)


def base(n, seed):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(400)}" for _ in range(n))


def rows():
    out = []
    for k in range(12):
        text = base(300, k)
        words = text.split(" ")
        out.append((100 - k, text))
        for j in range(4):  # near copies: a word or two changed
            w = list(words)
            w[j * 50] = "changed"
            out.append((200 + 10 * k + j, "  \t".join(w).upper() if j == 3 else " ".join(w)))
    out += [(1, None), (2, ""), (3, " \n\t "), (None, None), (7, "one"), (8, "ONE"), (8, "ONE"), (9, "one two"), (10, "é É ÉÉ"), (None, "only null id here")]
    return out


def test_fingerprints_and_components_equal_brute_force(spark):
    r = rows()
    got = simhash.simhash_components(docs(spark, r, extra=["fp", "component", "component_id"])).collect()
    assert sorted(((x[0], x[1], x[2]) for x in got), key=str) == slow_components(r)


def test_every_pair_within_three_bits_is_met(spark):
    r = random.Random(5)
    fps = {0, (1 << 64) - 1}
    for _ in range(60):
        f = r.getrandbits(64)
        fps.add(f)
        for d in range(5):
            g = f
            for b in r.sample(range(64), d):
                g ^= 1 << b
            fps.add(g)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    want = {(a, b) for a in map(signed, fps) for b in map(signed, fps) if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3}
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp bigint")
    for segments in (2, 3, 4):
        got = {(x.a, x.b) for x in simhash.near_pairs(df, 3, segments).collect()}
        assert got == want


def test_a_chain_is_one_component(spark):
    from velora.llm.common import connected_components

    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7)]
    got = dict(connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_one_row_of_each_group_stays(spark):
    r = rows() + [rows()[0]]
    df = docs(spark, r, extra=["__x", "keep_id"])
    got = simhash.drop_near_copies(df)
    assert got.columns == df.columns
    kept = sorted((x.doc_id is None, x.doc_id or 0) for x in got.collect())
    want = {}
    for _, fp, comp in slow_components(r):
        want.setdefault((comp, fp if comp is None else ""), None)
    assert kept == sorted((c is None, c or 0) for c, _ in want)


def test_empty_table(spark):
    df = docs(spark, [])
    assert simhash.simhash_components(df).collect() == []
    assert simhash.drop_near_copies(df).collect() == []
