import itertools
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SF001, SF01
from velora.llm import chat as C

TURNS = [
    [("system", ["You are helpful."]), ("user", ["User: hi?", "and this"]), ("assistant", ["Assistant: " + "long answer. " * 30, "more", "", "end."])],
    [("user", ["Human: what is it?"]), ("assistant", ["AI: it is " + "very " * 60, "yes."]), ("user", ["Human: ok?"]), ("assistant", ["AI: bye " * 20])],
]


def tallied(conversations):
    """Brute force of the counts: conversations of (role, lines) turns, walked line by line."""
    turns, lines = Counter(), Counter()
    for conv in conversations:
        before, more = None, None
        for role, texts in conv:
            if role not in C.ROLES:
                before, more = None, None
                continue
            r = C.ROLES.index(role)
            turns[before, more, r] += 1
            for i, text in enumerate(texts):
                lines[(r, min(i, 2), *C.observe(text))] += 1
            before, more = r, len(texts) > 1
    return turns, lines


def model():
    return C.fit(*tallied(TURNS * 20))


def test_counts_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    pool = ["User: a?", "b", "AI: " + "c " * 40, "", "System: d", "e " * 200, "f.", "x:"]
    roles = ["user", "assistant", "system", "tool"]
    convs = {c: [(roles[rng.integers(0, 4)], [pool[i] for i in rng.integers(0, 8, rng.integers(1, 5))]) for _ in range(n)] for c, n in enumerate([1, 2, 300, 7, 40, 9, 30, 12])}
    rows = [(c, t, i, x, role) for c, conv in convs.items() for t, (role, texts) in enumerate(conv) for i, x in enumerate(texts)]
    rows += [(None, 0, 0, "User: x", "user"), (0, None, 0, "User: x", "user"), (0, 5, 0, "x", None)]
    df = spark.createDataFrame(rows, "conv_id bigint, part bigint, line_no bigint, line string, role string")
    turns, lines = tallied(conv for c, conv in convs.items() if zlib.crc32(str(c).encode()) % 4 != 2)
    assert C.counts(df.withColumn("before", F.lit("clash"))) == (turns, lines)
    again = C.counts(df.unionByName(df).filter("conv_id = 2"))  # repeated rows: the same turns, lines twice
    once = C.counts(df.filter("conv_id = 2"))
    assert again[0] == once[0] and again[1] == {k: 2 * n for k, n in once[1].items()}


def slow_states(m, lines):
    """Viterbi by a table of best scores and whole paths; of equal ones the path with the first states."""
    best = {s: (m.start[s], [s]) for s in range(6)}
    for i, line in enumerate(lines):
        if i:
            best = {s: max(((v + m.step[p, s], [*path, s]) for p, (v, path) in best.items()), key=lambda x: x[0]) for s in range(6)}
        o = C.observe(line)
        best = {s: (v + sum(t[s, x] for t, x in zip(m.emit, o)), path) for s, (v, path) in best.items()}
    return max(best.values(), key=lambda x: x[0])[1]


def slow_report(rows):
    """Brute force of ``chat_report`` for rows (conv_id, turn, role, text) with distinct keys: conv -> (roles of turns, text)."""
    convs = {}
    for c, t, role, text in sorted(rows):
        convs.setdefault(c, []).append((t, role, text))
    shown, labelled = {}, []
    for c, turns in convs.items():
        style = zlib.crc32(str(c).encode()) % len(C.STYLES)
        texts = []
        for t, role, text in turns:
            bare = style == len(C.STYLES) - 1 and zlib.crc32(f"{c}:{t}".encode()) % 3 != 0
            texts.append((("" if bare else C.STYLES[style].get(role, "")) + text).split("\n"))
        shown[c] = [x for lines in texts for x in lines]
        if zlib.crc32(str(c).encode()) % 4 != 2:
            labelled.append([(role, lines) for (_, role, _), lines in zip(turns, texts)])
    m = C.fit(*tallied(labelled))
    out = {}
    for c, lines in shown.items():
        roles, text = [], ""
        for i, (s, line) in enumerate(zip(slow_states(m, lines), lines)):
            role, first = C.STATES[s]
            if first:
                text += ("<|end|>\n" if i else "") + f"<|{role}|>\n"
                roles.append(role)
            text += (C.marker(line)[1] if first else line) + "\n"
        out[c] = roles, text
    return out


def test_report_equals_brute_force(spark):
    conv = spark.read.parquet(f"{SF001}/conversations.parquet").select("conv_id", "turn", "role", "text").dropna().dropDuplicates(["conv_id", "turn"])
    conv = spark.createDataFrame(rows := [tuple(r) for r in conv.collect()], conv.schema)
    want = slow_report(rows)
    got = {}
    for r in C.chat_report(conv).orderBy("conv_id", "part", "line_no").collect():
        roles, text = got.setdefault(r.conv_id, ([], ""))
        got[r.conv_id] = [*roles, r.role] if r.starts else roles, text + r.rendered
    turns = {k: sorted(t for c, t, *_ in rows if c == k) for k in want}
    whole = [k for k, t in turns.items() if t == list(range(t[0], t[0] + len(t)))]
    assert len(whole) == len(want) and got == want


def test_markers():
    assert C.marker("### Human: hi") == ("user", "hi")
    assert C.marker("[sys]: x") == ("system", "x") and C.marker("A: b")[0] == "assistant"
    assert C.marker("as in: no") == (None, "as in: no") and C.marker("nothing") == (None, "nothing")


def test_viterbi_is_the_best_path():
    m = model()
    scores = m.scores(["User: hi?", "and", "AI: " + "x " * 50, "done."])

    def value(path):
        v = m.start[path[0]] + scores[0, path[0]]
        return v + sum(m.step[a, b] + scores[i + 1, b] for i, (a, b) in enumerate(zip(path, path[1:])))

    best = max(itertools.product(range(6), repeat=4), key=value)
    assert abs(value(C.viterbi(m, scores, None, None)) - value(best)) < 1e-9


def test_chunks_decode_like_the_whole():
    m, rng = model(), np.random.default_rng(2)
    pool = ["User: a?", "b", "AI: " + "c " * 40, "", "System: d", "e " * 200, "f."]
    lines = [pool[i] for i in rng.integers(0, len(pool), 60)]
    scores = m.scores(lines)
    whole = C.viterbi(m, scores, None, None)
    cuts = [0, 1, 2, 17, 40, 60]
    parts = [scores[a:b] for a, b in zip(cuts, cuts[1:])]
    first = m.start + parts[0][0]
    for row in parts[0][1:]:
        first = (first[:, None] + m.step).max(axis=0) + row
    ends = C.borders(m, first, [C.transfer(m, p) for p in parts[1:]])
    got = []
    for p, enter, leave in zip(parts, [None, *ends], ends):
        got += C.viterbi(m, p, enter, leave)
    assert got == whole


def lines_frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, part bigint, line_no bigint, line string")


def test_long_conversations_parse_like_one_pass(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK_LINES", 5)
    m = model()
    rng = np.random.default_rng(3)
    pool = ["User: a?", "b", "AI: " + "c " * 40, "", "System: d", "f."]
    rows = [(c, i // 3, i % 3, pool[rng.integers(0, len(pool))]) for c, n in ((1, 200), (2, 3), (3, 1), (4, 31)) for i in range(n)]
    got = C.parse(lines_frame(spark, rows), m).orderBy("conv_id", "part", "line_no").collect()
    for conv in (1, 2, 3, 4):
        lines = [r[3] for r in sorted(r for r in rows if r[0] == conv)]
        want = "".join(x[-1] for x in C._pieces(m, conv, [0] * len(lines), list(range(len(lines))), lines, -1, -1))
        assert "".join(r.rendered for r in got if r.conv_id == conv) == want
        assert sum(r.n_lines for r in got if r.conv_id == conv) == len(lines)


def test_roles_of_held_out_conversations(spark):
    conv = spark.read.parquet(f"{SF01}/conversations.parquet")
    got = C.chat_report(conv).filter(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4 == 2)
    truth = conv.select("conv_id", F.col("turn").alias("part"), F.col("role").alias("true_role"))
    firsts = got.filter("line_no = 0").join(truth, ["conv_id", "part"])
    r = firsts.agg(F.avg((F.col("role") == F.col("true_role")).cast("int")), F.count("*")).first()
    turns = truth.filter(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4 == 2).count()
    assert r[0] > 0.95 and r[1] > 0.9 * turns


def test_nulls_repeats_and_empty(spark):
    rows = [(1, 0, 0, "User: x"), (1, 0, 0, "User: x"), (1, None, None, None), (None, 1, 0, "AI: y"), (5, 0, 0, "w " * 300_000)]
    got = C.parse(lines_frame(spark, rows).withColumn("role", F.lit("clash")), model()).collect()
    assert sum(r.n_lines for r in got) == 5 and {r.conv_id for r in got} == {1, None, 5}
    assert C.parse(lines_frame(spark, []), model()).collect() == []
    conv = spark.createDataFrame([(1, 0, None, None), (None, None, "user", "hi"), (1, 1, "tool", "x\ny")], "conv_id bigint, turn bigint, role string, text string")
    assert sum(r.n_lines for r in C.chat_report(conv.withColumn("part", F.lit(1))).collect()) == 4
    assert C.chat_report(conv.limit(0)).collect() == []
