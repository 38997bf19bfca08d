import hashlib

from tests.llm.helpers import docs, plan_of
from velora.llm import mixing as M


def fill(budget, children):
    """children: name -> (weight, capacity); hands what full children leave to the others until nothing moves."""
    got = dict.fromkeys(children, 0.0)
    open_ = {k for k, (w, c) in children.items() if w > 0}
    while open_:
        rest = budget - sum(got.values())
        total = sum(children[k][0] for k in open_)
        x = {k: got[k] + rest * children[k][0] / total for k in open_}
        full = {k for k in open_ if x[k] >= children[k][1]}
        if not full:
            got.update(x)
            break
        # the one that is full first
        k = min(full, key=lambda k: children[k][1] / children[k][0])
        got = {j: (0.0 if j in open_ else v) for j, v in got.items()}
        got[k] = children[k][1]
        open_.remove(k)
    return got


def slow(rows, mix):
    leaf, member = {}, {}
    for d, text, lang, source in rows:
        s = source or "unknown"
        dom = "other" if not s[-1].isdigit() else "web" if int(s[-1]) % 2 == 0 else "books"
        key = (dom, lang or "unknown", s)
        n = len((text or "").split())
        leaf[key] = leaf.get(key, 0) + n
        member.setdefault(key, []).append((d, n))
    weight = lambda level, name: mix.weights.get(level, {}).get(name, 1.0)

    def capacity(prefix):
        return sum(
            n * mix.max_epochs for k, n in leaf.items() if k[: len(prefix)] == prefix and all(weight(x, y) > 0 for x, y in zip(M.LEVELS, k))
        )

    budgets = {(): sum(leaf.values()) * mix.budget_share}
    for depth, level in enumerate(M.LEVELS):
        nxt = {}
        for parent, b in budgets.items():
            kids = {k[: depth + 1] for k in leaf if k[:depth] == parent}
            nxt |= fill(b, {k: (weight(level, k[-1]), capacity(k)) for k in kids})
        budgets = nxt
    out = []
    for key, b in budgets.items():
        b = int(b + 1e-6)
        total = leaf[key]
        free = all(weight(x, y) > 0 for x, y in zip(M.LEVELS, key))
        passes = b // total if total else int(mix.max_epochs) if free else 0
        out += [(d, *key, n, e) for d, n in member[key] for e in range(passes)]
        rest = b - passes * total
        name = lambda d: hashlib.md5(f"{mix.seed}:{passes}:{'' if d is None else d}".encode()).hexdigest()  # noqa: E731, B023
        for d, n in member[key]:
            if sum(m for x, m in member[key] if name(x) < name(d)) < rest:
                out.append((d, *key, n, passes))
    return sorted(out, key=str)


def rows():
    out = [(i, "w " * (5 + i % 11), ["en", "de", None][i % 3], f"src{i % 5}") for i in range(300)]
    out += [(1000 + i, "hot words here " * 3, "en", "src0") for i in range(400)]
    out += [(5, "again", "en", "src1"), (5, "again", "en", "src1"), (None, "no id", "en", "src2"), (7, None, "de", None), (8, "", "fr", "blog")]
    return out


MIXES = [
    M.Mixture(budget_share=0.3, max_epochs=1),
    M.Mixture({"domain": {"web": 0.9, "books": 0.1}, "language": {"de": 5.0}, "source": {"src3": 0.0}}, 0.8, 2),
    M.Mixture({"domain": {"books": 9.0}}, 2.5, 3, "other seed"),
    M.Mixture({"domain": {"web": 0.0}}, 1.0, 1),
]


def test_report_equals_brute_force(spark):
    df = docs(spark, rows(), extra=["domain", "passes", "epoch"])
    for mix in MIXES:
        got = M.mixture_report(df, mix)
        assert "Python" not in plan_of(got)
        assert sorted((tuple(r) for r in got.collect()), key=str) == slow(rows(), mix)


def test_mix_returns_whole_rows(spark):
    df = docs(spark, rows(), extra=["domain", "language"])
    got = M.mix(df, MIXES[1])
    assert got.columns == [*df.columns, "epoch"]
    assert sorted(str((r.doc_id, r.epoch)) for r in got.collect()) == sorted(str((r[0], r[5])) for r in slow(rows(), MIXES[1]))
    assert M.mix(df, MIXES[1], epoch=None).columns == df.columns


def test_empty_table(spark):
    assert M.mixture_report(docs(spark, []), MIXES[0]).collect() == []
    assert M.mix(docs(spark, []), MIXES[0]).collect() == []


def test_leaves_without_tokens_are_read(spark):
    df = docs(spark, [(1, None, "en", "src1"), (2, "", "en", "src1"), (3, " \n", "de", "src2"), (4, "two words", "en", "src3"), (5, None, None, None)])
    mix = M.Mixture(weights={}, budget_share=2.0, max_epochs=2)
    got = sorted((r.doc_id, r.epoch) for r in M.mix(df, mix).collect())
    assert got == [(i, e) for i in range(1, 6) for e in (0, 1)]
    nothing = M.Mixture(weights={"source": {"src2": 0.0}}, budget_share=2.0, max_epochs=2)
    assert {r.doc_id for r in M.mix(df, nothing).collect()} == {1, 2, 4, 5}
