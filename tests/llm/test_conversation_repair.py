import hashlib
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SF001
from velora.llm import conversation_repair as R

TYPE = "conv_id long, turn long, role string, text string"
FORM = re.compile("(s?(ua)+)?")


def exhaustive(kinds, inserts=4):
    """(cost, audit) by trying every edit string with up to ``inserts`` insertions against the regular expression."""
    best = None
    for rows in itertools.product("KRD", repeat=len(kinds)):
        if any(k == "-" and e != "D" for k, e in zip(kinds, rows)):
            continue
        for n in range(inserts + 1):
            for gaps in itertools.combinations_with_replacement(range(len(kinds) + 1), n):
                edits = []
                for i in range(len(kinds) + 1):
                    edits += [("I", "")] * gaps.count(i)
                    edits += [(rows[i], kinds[i])] if i < len(kinds) else []
                audit = "".join(e for e, _ in edits)
                cost = sum({"K": 0, "R": 3, "D": 4, "I": 3}[e] + (3 if e in "KR" and k.isupper() else 0) for e, k in edits)
                if best is not None and (cost, audit) >= best:
                    continue
                options = [["u", "a"] if e in "IR" else [k.lower()] for e, k in edits if e != "D"]
                if any(FORM.fullmatch("".join(x)) for x in itertools.product(*options)):
                    best = (cost, audit)
    return best


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="suaxSUA-", max_size=4))
def test_cells_give_the_cheapest_edits(kinds):
    assert R.cheapest(R.parse(kinds)) == exhaustive(kinds)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="suaxSUAX-", min_size=2, max_size=40), st.data())
def test_any_split_gives_the_same_cell(kinds, data):
    at = data.draw(st.integers(1, len(kinds) - 1))
    assert R.combine(R.parse(kinds[:at]), R.parse(kinds[at:])) == R.parse(kinds)


def cyk(kinds):
    """Textbook form: every span, every split, shortest spans first."""
    n = len(kinds)
    cell = {(i, i + 1): R.terminal(k) for i, k in enumerate(kinds)}
    for width in range(2, n + 1):
        for i in range(n - width + 1):
            found = [R.combine(cell[i, k], cell[k, i + width]) for k in range(i + 1, i + width)]
            cell[i, i + width] = [min((c for c in x if c is not None), default=None) for x in zip(*found)]
    return cell[0, n]


def test_equals_cyk_over_all_splits():
    r = random.Random(4)
    for _ in range(40):
        kinds = "".join(r.choice("suaUAx-") for _ in range(r.randint(1, 14)))
        assert R.parse(kinds) == cyk(kinds)


def slow_report(rows):
    """The report by plain loops, with a shortest-path search over (row, state) for cost and audit."""
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        convs[conv] += [(turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    out = []
    for conv, got in convs.items():
        got.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        blank = duplicate = truncated = 0
        seen, kinds = set(), []
        for _, role, text in got:
            solid = re.findall("[^\x20\x09-\x0d]", text)
            k = role[:1] if role[:1] in tuple("sua") else "x"
            if not solid:
                blank, k = blank + 1, "-"
            elif (role, text) in seen:
                duplicate, k = duplicate + 1, "-"
            elif solid[-1] not in ".!?":
                truncated, k = truncated + 1, k.upper()
            seen.add((role, text))
            kinds.append(k)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(got, got[1:]))
        turns = [t for t, _, _ in got if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = shortest(kinds)
        lines, state, left = [], "", iter(got)
        for e in audit:
            _, role, text = (None, "", "") if e == "I" else next(left)
            if e == "D":
                continue
            role = role if e == "K" else "assistant" if state == "u" else "user"
            state = role[0]
            lines.append(f"{role}:{text}")
        assert FORM.fullmatch("".join(x[0] for x in lines))
        out.append((conv, gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def shortest(kinds):
    """Cost to the end by Bellman iteration, then the ASCII-least walk along cheapest steps."""
    n, states = len(kinds), ["", "s", "u", "a"]
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def moves(i, p):
        for c in "ua":
            if (p, c) in step:
                yield 3, "I", i, c
        if i < n:
            yield 4, "D", i + 1, p
            k = kinds[i]
            if k != "-":
                extra = 3 if k.isupper() else 0
                if (p, k.lower()) in step:
                    yield extra, "K", i + 1, k.lower()
                for c in "ua":
                    if (p, c) in step:
                        yield 3 + extra, "R", i + 1, c

    left = {(n, p): 0 if p in ("", "a") else 10**9 for p in states}
    for i in range(n, -1, -1):
        for p in states:
            left.setdefault((i, p), 10**9)
        for _ in range(4):
            for p in states:
                left[i, p] = min([left[i, p]] + [c + left[j, q] for c, _, j, q in moves(i, p) if (j, q) in left])
    i, p, audit, cost = 0, "", "", left[0, ""]
    while not (i == n and left[i, p] == 0):
        _, e, c, i, p = min((e, e, c, j, q) for c, e, j, q in moves(i, p) if c + left[j, q] == left[i, p])
        audit += e
    return cost, audit


def made(seed):
    r = random.Random(seed)
    texts = ["Yes.", "yes", "No! ", "What?\n", "", " \t", "a.b", "é!", "x" * 500 + ".", "..."]
    roles = ["user", "assistant", "system", "tool", "unknown", "", None]
    rows = []
    for conv in [*range(60), None, -5]:
        for turn in range(r.randint(0, 12)):
            t = r.choice([turn, turn, turn, turn, None, turn * 3, 2])
            rows.append((conv, t, r.choice(roles + ["user", "assistant"] * 6), r.choice([*texts, None])))
    return rows + rows[:15]


@pytest.mark.parametrize("seed,span_rows", [(1, 4096), (2, 3), (3, 1)])
def test_report_equals_brute_force(spark, seed, span_rows):
    rows = made(seed)
    frame = spark.createDataFrame(rows, TYPE).selectExpr("*", "'x' AS audit", "1 AS seq", "2 AS copies").repartition(5)
    got = R.repair_report(frame, span_rows).collect()
    assert sorted((tuple(r) for r in got), key=str) == slow_report(rows)


def test_whole_table_equals_brute_force(spark):
    table = spark.read.parquet(f"{SF001}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in R.repair_report(table).collect()), key=str) == slow_report(rows)


def test_a_conversation_over_many_tasks(spark):
    """One conversation holds most rows: it is dealt over all tasks, and its spans meet as cells only."""
    roles = ["user", "assistant", "system", "user", "assistant", "user"]
    rows = [(1, i, roles[i % 6], f"line {i % 700}{'.' if i % 5 else ''}") for i in range(20_000)] + [(2, 0, "user", "Hi.")]
    frame = spark.createDataFrame(rows, TYPE)
    got = R.repair_report(frame, 100).collect()
    assert sorted((tuple(r) for r in got), key=str) == slow_report(rows)


def test_repeated_rows_long_texts_and_empty_table(spark):
    rows = [(1, 0, "user", "Again?")] * 5000 + [(1, 1, "assistant", "y" * 1_000_000), (2, None, None, None), (3, 1, "user", "\n\x1c")]
    frame = spark.createDataFrame(rows, TYPE)
    assert sorted((tuple(r) for r in R.repair_report(frame).collect()), key=str) == slow_report(rows)
    assert R.repair_report(frame.limit(0)).collect() == []


def test_only_dropped_rows(spark):
    (turn,) = [t for t in range(200) if zlib.crc32(f"9:{t}".encode()) % 20 == 0][:1]
    (row,) = R.repair_report(spark.createDataFrame([(9, turn, "user", "Hi.")], TYPE)).collect()
    assert tuple(row) == (9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
