"""Benchmark decontamination with a generalised suffix automaton (operator 8).

The normalised words of the test items form one automaton over word ids. The
words of a training text stream through it: after each word the automaton holds
the longest suffix read so far that occurs in some item, and its length. A
length of at least ``window`` means that the last ``window`` words are a window
of an item; an item shorter than that counts when it occurs whole. All words of
such occurrences are hit.

The benchmark is cut into blocks of at most ``block_words`` words (a longer item
into pieces that keep its windows). Tasks build one automaton a block and store
it in the shared folder. A pass over the documents reads them against as many
automata as ``pass_bytes`` pickled bytes hold, so that what is broadcast at once
is bounded by parameters and not by the benchmark; with several passes the
matches so far are stored in between. The hit intervals of all blocks are united.
"""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velora.llm.common import stored

WINDOW = 13
COVERAGE = 20  # contaminated if COVERAGE * hit words >= words
BLOCK_WORDS = 200_000
PASS_BYTES = 64 << 20
#: Fixed by the contract: ASCII digits and letters, and everything beyond ASCII.
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

MATCH_TYPE = (
    T.StructType()
    .add("spans", T.ArrayType(T.ArrayType(T.IntegerType())))
    .add("items", T.ArrayType(T.StringType()))
    .add("n_words", T.LongType())
)


def lowered(text: str) -> str:
    """A-Z lower-cased; all else, and so every position, stays."""
    if text.isascii():
        return text.lower()
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def words_of(text: str | None) -> list[str]:
    return [] if text is None else WORD.findall(lowered(text))


@dataclass
class Automaton:
    """Generalised suffix automaton; ``whole``/``windows`` answer a position in one look-up each."""

    window: int = WINDOW
    vocabulary: dict[str, int] = field(default_factory=dict)
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    #: state -> longest-first (length, items) of short items that end there; state -> items of its window
    whole: list[tuple] = field(default_factory=list)
    windows: list[tuple] = field(default_factory=list)

    def _extend(self, last: int, c: int) -> int:
        step, link, length = self.step, self.link, self.length
        at = step[last].get(c)
        if at is not None and length[at] == length[last] + 1:
            return at
        if at is not None:
            return self._split(last, at, c)
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p != -1:
            q = step[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, q, c)
        return new

    def _split(self, p: int, q: int, c: int) -> int:
        """A copy of state q for the strings that reach it from p on."""
        copy = len(self.step)
        self.step.append(dict(self.step[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = copy
        while p != -1 and self.step[p].get(c) == q:
            self.step[p][c] = copy
            p = self.link[p]
        return copy

    @classmethod
    def build(cls, items: list[tuple[str, list[str]]], window: int = WINDOW) -> Automaton:
        self = cls(window=window)
        ids = []
        for item, words in items:
            row = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            ids.append((item, row))
            last = 0
            for c in row:
                last = self._extend(last, c)
        self._annotate(ids)
        return self

    def _annotate(self, items: list[tuple[str, list[int]]]) -> None:
        n, window = len(self.step), self.window
        short: dict[int, set[str]] = {}
        wide: dict[int, set[str]] = {}
        for item, row in items:
            if not row:
                continue
            s = 0
            if len(row) < window:
                for c in row:
                    s = self.step[s][c]
                short.setdefault(s, set()).add((len(row), item))
                continue
            for k, c in enumerate(row):
                s = self.step[s][c]
                if k + 1 < window:
                    continue
                while self.length[self.link[s]] >= window:  # the state of the last ``window`` words
                    s = self.link[s]
                wide.setdefault(s, set()).add(item)
        self.whole, self.windows = [()] * n, [()] * n
        for s in sorted(range(1, n), key=self.length.__getitem__):  # a link is shorter, so it comes first
            own = tuple(sorted(short.get(s, ()), key=lambda x: (-x[0], x[1])))
            self.whole[s] = own + self.whole[self.link[s]]
            self.windows[s] = tuple(sorted(wide[s])) if s in wide else self.windows[self.link[s]]

    def match(self, words: list[str]) -> tuple[list[list[int]], set[str]]:
        """Disjoint hit spans [from, to) in order, and the items with occurring windows."""
        ids, step, link, length, window = self.vocabulary.get, self.step, self.link, self.length, self.window
        whole, windows = self.whole, self.windows
        spans: list[list[int]] = []
        items: set[str] = set()
        s = n = 0
        seen = -1
        for i, w in enumerate(words):
            c = ids(w)
            if c is None:
                s = n = 0
                continue
            to = step[s].get(c)
            if to is None:
                while s and to is None:
                    s = link[s]
                    to = step[s].get(c)
                if to is None:
                    s = n = 0
                    continue
                n = length[s]
            s = to
            n += 1
            hit = 0
            if n >= window:
                hit = window
                if s != seen:
                    items.update(windows[s])
                    seen = s
            for k, item in whole[s]:
                if k <= n:
                    items.add(item)
                    hit = max(hit, k)
            if hit:
                lo = i + 1 - hit
                while spans and spans[-1][1] >= lo:
                    lo = min(lo, spans.pop()[0])
                spans.append([lo, i + 1])
        return spans, items


def benchmark_pieces(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Distinct (item, words, n): item texts as words joined by blanks, of at most ``block_words`` words.

    A longer item is cut into pieces that overlap by ``window`` - 1 words, so
    that its pieces have exactly its windows. Null ids are empty texts.
    """
    most = max(block_words, window)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for item, text in zip(df["item"], df["text"]):
                words = words_of(text)
                starts = range(0, max(len(words) - window, 0) + 1, most - window + 1) if words else ()
                rows += [(item, " ".join(words[i : i + most]), min(most, len(words) - i)) for i in starts]
            yield pd.DataFrame(rows, columns=["item", "words", "n"])

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return items.mapInPandas(cut, "item string, words string, n long").distinct()


def build_blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Stored automata of the whole benchmark: key, size (bytes), automaton (pickled).

    Pieces are dealt to blocks by hash; a task builds the automata of a block,
    one part for every ``block_words`` words or less.
    """
    pieces = stored(benchmark_pieces(benchmark, window, block_words), "benchmark-pieces")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    # three quarters full on average, so that few blocks need a second part
    n = 1 if total <= block_words else math.ceil(4 * total / (3 * block_words))

    def build(df: pd.DataFrame) -> pd.DataFrame:
        parts: list[list[tuple[str, list[str]]]] = []
        size = 0
        for item, words, k in zip(df["item"], df["words"], df["n"]):
            if not parts or size + k > block_words:
                parts.append([])
                size = 0
            parts[-1].append((item, words.split(" ")))
            size += k
        blobs = [pickle.dumps(Automaton.build(p, window), protocol=pickle.HIGHEST_PROTOCOL) for p in parts]
        block = int(df["block"].iloc[0])
        return pd.DataFrame({"key": [f"{block}-{k}" for k in range(len(blobs))], "size": [len(b) for b in blobs], "automaton": blobs})

    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(n)))
    return stored(dealt.groupBy("block").applyInPandas(build, "key string, size long, automaton binary"), "benchmark-automata")


class Packed:
    """Pickled automata that a worker unpacks at first use and keeps with its broadcast."""

    def __init__(self, blobs: list[bytes]):
        self.blobs = blobs
        self.ready: list[Automaton] | None = None

    def automata(self) -> list[Automaton]:
        if self.ready is None:
            self.ready, self.blobs = [pickle.loads(b) for b in self.blobs], []
        return self.ready


def passes(blocks: DataFrame, pass_bytes: int = PASS_BYTES) -> Iterator[Broadcast]:
    """Broadcasts of as many stored automata as ``pass_bytes`` allow (one at least), until all were sent.

    Only numbers and sizes are listed on the driver; it holds the bytes of one
    pass at a time and unpacks none. An empty benchmark gives one empty pass.
    """
    sc = blocks.sparkSession.sparkContext
    groups: list[list[str]] = [[]]
    room = pass_bytes
    for r in blocks.select("key", "size").orderBy("key").collect():
        if groups[-1] and r["size"] > room:
            groups.append([])
            room = pass_bytes
        groups[-1].append(r["key"])
        room -= r["size"]
    for keys in groups:
        found = blocks.filter(F.col("key").isin(keys)).select("automaton").collect() if keys else []
        yield sc.broadcast(Packed([bytes(r["automaton"]) for r in found]))


def _united(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def with_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    out: str = "match",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """Adds struct ``out``: spans (word positions [from, to), united), items (ids as text), n_words.

    Null and empty texts have no words. An empty benchmark matches nothing.
    Items without words are no windows. Items of equal text all count.
    """
    for k, block in enumerate(passes(build_blocks(benchmark, window, block_words), pass_bytes)):
        found = _finder(block)
        if k == 0:
            docs = docs.withColumn(out, found(F.col(text)))
            continue
        docs = stored(docs, "benchmark-matches").withColumn("__more", found(F.col(text)))
        docs = docs.withColumn(out, _merge(F.col(out), F.col("__more"))).drop("__more")
    return docs


def _finder(block: Broadcast):
    @F.pandas_udf(MATCH_TYPE)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automata = block.value.automata()
        for texts in batches:
            rows = []
            for t in texts:
                words = words_of(t)
                found = [a.match(words) for a in automata]
                spans = found[0][0] if len(found) == 1 else _united([s for f in found for s in f[0]])
                rows.append((spans, sorted(set().union(*(f[1] for f in found))), len(words)))
            yield pd.DataFrame(rows, columns=["spans", "items", "n_words"])

    return find


@F.pandas_udf(MATCH_TYPE)
def _merge(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
    spans = [_united([list(s) for s in (*a, *b)]) for a, b in zip(one["spans"], two["spans"])]
    items = [sorted({*a, *b}) for a, b in zip(one["items"], two["items"])]
    return pd.DataFrame({"spans": spans, "items": items, "n_words": one["n_words"]})


def hit_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + (s[1] - s[0]).cast("long"))


def decontamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items."""
    m = with_matches(docs.select("doc_id", "text"), benchmark, window=window).select("doc_id", "match.*")
    m = m.withColumn("n_hit", hit_words(F.col("spans")))
    return m.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * coverage >= F.col("n_words"))).alias("contaminated"),
        "spans",
        "items",
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE
) -> DataFrame:
    """Drops rows whose hit words make up 1/``coverage`` of the words or more; the others stay as they are."""
    m = with_matches(docs, benchmark, out="__match", window=window)
    hit = hit_words(F.col("__match.spans"))
    return m.filter(~((hit > 0) & (hit * coverage >= F.col("__match.n_words")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def remove_spans(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    coverage: int = COVERAGE,
    min_span: int = WINDOW,
    text: str = "text",
) -> DataFrame:
    """Cuts matched spans out of ``text``; returns the columns of ``docs`` plus ``removed_words``.

    A span goes if it has at least ``min_span`` words, or if all spans of the
    text together reach the coverage limit. The characters from the first to
    the last word of the span go; a null text stays null.
    """

    @F.pandas_udf("text string, removed bigint")
    def cut(texts: pd.Series, match: pd.DataFrame) -> pd.DataFrame:
        out = []
        for t, spans, n in zip(texts, match["spans"], match["n_words"]):
            spans = [] if t is None else [list(s) for s in spans]
            if sum(b - a for a, b in spans) * coverage < n:
                spans = [s for s in spans if s[1] - s[0] >= min_span]
            if not spans:
                out.append((t, 0))
                continue
            places = [m.span() for m in WORD.finditer(lowered(t))]
            kept, at = [], 0
            for a, b in spans:
                kept.append(t[at : places[a][0]])
                at = places[b - 1][1]
            out.append(("".join([*kept, t[at:]]), sum(b - a for a, b in spans)))
        return pd.DataFrame(out, columns=["text", "removed"])

    m = with_matches(docs, benchmark, text=text, out="__match", window=window).withColumn("__cut", cut(F.col(text), F.col("__match")))
    cols = [F.col("__cut.text").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return m.select(*cols, F.col("__cut.removed").alias("removed_words"))


_SQL_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
#: DuckDB SQL for the report over ``documents`` and ``benchmark``: all windows of all documents against all windows of all items.
REPORT_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, w, least({WINDOW}, len(w)) AS k FROM (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b)
),
dw AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)
),
hits AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (k, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {COVERAGE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
