"""Phrase collocation mining with Rabin-Karp fingerprints (operator 13).

Texts are cut into pieces at punctuation and pieces into words. A phrase is a
run of 1 to ``max_words`` words inside a piece; the frequent ones (``least``
occurrences or more in a language) are counted exactly and those of two or more
words are scored by their weakest cut.

1. Every task takes its texts in blocks and numbers each block's words; the
   numbered blocks are stored, so that texts are cut once. One running
   polynomial over the words' hashes gives the fingerprint of every n-gram as a
   difference of two prefixes (numpy, 64 bits, odd base; language and length are
   mixed in). A block hands on each fingerprint once, with its count. Spark adds
   the counts up and keeps the fingerprints that reach ``least``; no phrase is
   written out yet. First come one and two words, then longer ones, and only
   where each of their word pairs can be frequent.
2. Which pairs can be, a task reads from a bitmap of ``2 ** bits`` places, in
   which the frequent fingerprints are set. Its size is fixed (8 MB for 26 bits),
   whatever the corpus. A place that is set for another fingerprint lets a few
   rows more through; none is lost.
3. The last pass verifies: of the n-grams that the bitmap lets through, those
   with the same words (compared by their numbers, not by fingerprint) are one
   phrase; the first occurrence in the block is the pointer from which its text
   is read. Counts are summed by text. Two phrases with one fingerprint are
   therefore told apart, and only what may be frequent ever becomes text.

Scores come from joins of the frequent phrases with themselves, in exact
decimals. No step holds a language or the corpus in one task: blocks are bounded
by ``BLOCK_BYTES`` and one text, and a fingerprint in all texts reaches the
shuffle as one row per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velora.llm.common import stored

LEAST = 100
MAX_WORDS = 5
TOP = 2000
BITS = 26
BLOCK_BYTES = 1 << 20
ROWS = 1 << 16
UNKNOWN = "und"
#: odd multipliers of the prefix polynomial and of the mixing step
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_SHIFT = np.uint64(29)
#: A-Z to a-z, a tab to a blank, and every piece mark to a full stop, which no word can hold then
_NORMAL = bytes.maketrans(
    bytes(range(65, 91)) + b"\t" + b",;:!?\n\x0b\x0c\r", bytes(range(97, 123)) + b" " + b"." * 9
)


class _Numbers(dict):
    """Numbers words in the order in which they are first met; number 0 is the piece mark."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _numbered(texts: list[tuple[str, bytes]]) -> tuple[list[str], bytes, bytes, bytes, bytes]:
    """Languages, distinct words, the words' numbers one after the other, and each text's language and length.

    A mark (number 0) ends every piece and every text.
    """
    numbers = _Numbers({b".": 0})
    langs: dict[str, int] = {}
    ids, of = [], []
    for lang, text in texts:
        words = [w for w in text.translate(_NORMAL).replace(b".", b" . ").split(b" ") if w]
        words.append(b".")
        ids.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.int32, count=len(words)))
        of.append(langs.setdefault(lang, len(langs)))
    sizes = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids))
    width = np.uint16 if len(numbers) <= 1 << 16 else np.int32
    return list(langs), b" ".join(numbers), np.concatenate(ids).astype(width).tobytes(), np.array(of, dtype=np.int32).tobytes(), sizes.tobytes()


class Block:
    """The words of some texts, one after the other, with a mark between pieces and texts."""

    def __init__(self, langs: list[str], words: bytes, ids: bytes, of: bytes, sizes: bytes):
        self.words = words.split(b" ")
        self.langs = langs
        self.ids = np.frombuffer(ids, dtype=np.uint16 if len(self.words) <= 1 << 16 else np.int32).astype(np.int64)
        self.lang = np.repeat(np.frombuffer(of, dtype=np.int32), np.frombuffer(sizes, dtype=np.int32)).astype(np.int64)
        # the position of the piece mark that ends the piece of each position
        marks = np.flatnonzero(self.ids == 0)
        self.end = np.repeat(marks, np.diff(marks, prepend=-1))
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), dtype=np.uint64, count=len(self.words))
        salts = np.fromiter((xxhash.xxh3_64_intdigest(x.encode()) for x in langs), dtype=np.uint64, count=len(langs))
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(len(self.ids), _BASE, dtype=np.uint64))
            self.prefix = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(hashes[self.ids] * power, dtype=np.uint64)])
            # inverse powers bring a difference of prefixes back to its position (an odd base has an inverse)
            self.back = np.cumprod(np.full(len(self.ids), np.uint64(pow(int(_BASE), -1, 1 << 64)), dtype=np.uint64))
        self.salt = salts[self.lang]

    def starts(self, n: int) -> np.ndarray:
        """Positions at which n words of one piece begin."""
        at = np.arange(len(self.ids))
        return at[at + n <= self.end]

    def fingerprints(self, at: np.ndarray, n: int) -> np.ndarray:
        """Fingerprints of the n words from each position."""
        with np.errstate(over="ignore"):
            h = (self.prefix[at + n] - self.prefix[at]) * self.back[at] + self.salt[at] * np.uint64(2 * n + 1)
            h = (h ^ (h >> _SHIFT)) * _MIX
            return h ^ (h >> _SHIFT)

    def phrases(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the n-grams at ``at``: a pointer to the first of each distinct one, and its number of occurrences.

        Words are compared by their numbers, one further word at a time, so that equal fingerprints prove nothing.
        """
        same = self.lang[at]
        for j in range(n):
            _, same = np.unique(same * len(self.words) + self.ids[at + j], return_inverse=True)
        _, first, count = np.unique(same, return_index=True, return_counts=True)
        return at[first], count

    def text(self, at: int, n: int) -> bytes:
        return b" ".join([self.words[i] for i in self.ids[at : at + n]])


def _cut(block_bytes: int):
    """Texts to numbered blocks of about ``block_bytes``; a longer text is a block of its own or the end of one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, bytes]] = []
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                held.append((lang.as_py(), text.as_py()))
                size += len(held[-1][1])
                if size >= block_bytes:
                    yield _packed(held)
                    held, size = [], 0
        if held:
            yield _packed(held)

    return cut


def _packed(texts: list[tuple[str, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(_BLOCK.names, _numbered(texts)))], schema=_BLOCK)


_BLOCK = pa.schema([("langs", pa.list_(pa.string())), ("words", pa.binary()), ("ids", pa.binary()), ("of", pa.binary()), ("sizes", pa.binary())])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Block(*(c[i].as_py() for c in batch.columns))


def _is_set(bitmap: np.ndarray, fingerprints: np.ndarray) -> np.ndarray:
    place = fingerprints & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _pairs_allow(block: Block, bitmap: np.ndarray, max_words: int) -> Iterator[tuple[int, np.ndarray]]:
    """For 3 to ``max_words`` words: the positions at which every pair of neighbouring words may be frequent."""
    pair = np.zeros(len(block.ids) + max_words, dtype=bool)
    at = block.starts(2)
    pair[at] = _is_set(bitmap, block.fingerprints(at, 2))
    for n in range(3, max_words + 1):
        at = block.starts(n)
        for j in range(n - 1):
            at = at[pair[at + j]]
        yield n, at


def _count(max_words: int, bitmap=None):
    """Distinct fingerprints of each block with their counts: of 1 and 2 words, or (given the bitmap) of 3 and more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            some = ((n, block.starts(n)) for n in (1, 2)) if bitmap is None else _pairs_allow(block, bitmap.value, max_words)
            for n, at in some:
                found, counts = np.unique(block.fingerprints(at, n), return_counts=True)
                rows = pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts)], names=["fp", "n"])
                yield from (rows.slice(i, ROWS) for i in range(0, rows.num_rows, ROWS))

    return count


def _verify(max_words: int, bitmap):
    """The n-grams that the bitmap lets through, by text, and one row (null phrase) of all words per language."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            allowed = bitmap.value
            total = np.bincount(block.lang[block.ids != 0], minlength=len(block.langs))
            yield _rows(block.langs, [None] * len(total), total, 0)
            for n in range(1, max_words + 1):
                at = block.starts(n)
                at = at[_is_set(allowed, block.fingerprints(at, n))]
                first, counts = block.phrases(at, n)
                yield _rows([block.langs[i] for i in block.lang[first]], [block.text(i, n) for i in first.tolist()], counts, n)

    return verify


def _rows(lang: list, phrase: list, counts: np.ndarray, n: int) -> pa.RecordBatch:
    size = pa.array(np.full(len(phrase), n, dtype=np.int32))
    columns = [pa.array(lang, pa.string()), pa.array(phrase, pa.binary()), size, pa.array(counts.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "words", "n"])


def _bitmap(fingerprints: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2 ** bits places with the fingerprints' last bits set, merged in Spark: at most 2 ** (bits - 6) rows come here."""
    place = F.col("fp").bitwiseAND((1 << bits) - 1)
    word = F.shiftright(place, 6)
    bit = F.expr("shiftleft(1L, CAST(fp & 63 AS INT))")
    merged = fingerprints.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("set")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[merged["word"].to_numpy()] = merged["set"].to_numpy().view(np.uint64)
    return out


def frequent_phrases(
    docs: DataFrame, least: int = LEAST, max_words: int = MAX_WORDS, bits: int = BITS, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Stored table (lang, phrase, words, a): every phrase of 1 to ``max_words`` words with a >= ``least`` occurrences
    in its language, and per language one row with a null phrase, 0 words and a = all words.

    A null lang counts as ``und`` and a null text as empty; repeated rows count
    each time. An empty table gives no rows. Other columns are ignored.
    """
    if least < 1 or max_words < 2 or bits < 6:
        raise ValueError("least must be at least 1, max_words at least 2 and bits at least 6")
    sc = docs.sparkSession.sparkContext
    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"),
        F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")).alias("text"),
    )

    blocks = stored(texts.mapInArrow(_cut(block_bytes), "langs array<string>, words binary, ids binary, of binary, sizes binary"), "phrase-blocks")

    def frequent(bitmap, name: str) -> DataFrame:
        partial = blocks.mapInArrow(_count(max_words, bitmap), "fp bigint, n bigint")
        return stored(partial.groupBy("fp").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("fp"), name)

    short = _bitmap(frequent(None, "phrases-short"), bits)
    allowed = short
    if max_words > 2:
        allowed = short | _bitmap(frequent(sc.broadcast(short), "phrases-long"), bits)
    found = blocks.mapInArrow(_verify(max_words, sc.broadcast(allowed)), "lang string, phrase binary, words int, n bigint")
    sums = found.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("a")).filter(F.col("phrase").isNull() | (F.col("a") >= least))
    return stored(sums.withColumn("phrase", F.col("phrase").cast("string")), "phrases")


def collocations(docs: DataFrame, least: int = LEAST, max_words: int = MAX_WORDS, top: int = TOP, cover: int = 100, bits: int = BITS) -> DataFrame:
    """The best ``top`` phrases of 2 to ``max_words`` words per language: lang, rank, phrase, a, l, r, n, score.

    n is the number of the language's words, l and r the counts of the phrase's
    two parts at its weakest cut, the one with the lowest floor(1000 a n / (l r));
    of equal ones the first. A phrase inside a longer one with at least
    ``cover`` percent of its count is left out; the longer one may itself be left
    out. As a phrase is never rarer than a longer one around it, it is enough to
    look at phrases longer by one word. Ties in score go to the higher a, then
    to the first phrase in UTF-8 order. Nulls and repeats as ``frequent_phrases``.
    """
    table = frequent_phrases(docs, least, max_words, bits)
    phrases = table.filter(F.col("phrase").isNotNull())
    totals = table.filter(F.col("phrase").isNull()).select("lang", F.col("a").alias("n"))
    long = phrases.filter("words >= 2")

    cuts = (
        long.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
        .withColumn("first", F.expr("substring_index(phrase, ' ', k)"))
        .withColumn("rest", F.expr("substring_index(phrase, ' ', k - words)"))
    )
    left = phrases.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    exact = "decimal(19,0)"
    cuts = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang")
    cuts = cuts.withColumn("score", F.expr(f"(CAST(a AS {exact}) * CAST(n AS decimal(18,0)) * 1000BD) div (CAST(l AS {exact}) * CAST(r AS decimal(18,0)))"))
    weakest = cuts.groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("a").alias("a"), F.first("n").alias("n")
    )

    around = long.filter("words >= 3").select(
        "lang",
        F.explode(F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)"))).alias("phrase"),
        F.col("a").alias("longer"),
    )
    around = around.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = weakest.join(around, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(cover) * F.col("a"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n",
        F.col("cut.score").alias("score"),
    )


def report_sql(least: int = LEAST, max_words: int = MAX_WORDS, top: int = TOP) -> str:
    """DuckDB SQL for ``collocations``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH pieces AS (
  SELECT coalesce(lang, '{UNKNOWN}') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
cut AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]'), lambda w: w <> '') AS w FROM pieces),
n_words AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM cut GROUP BY lang),
grams AS (
  SELECT lang, g AS words, array_to_string(w[i:i + g - 1], ' ') AS phrase
  FROM (SELECT lang, w, g, unnest(range(1, len(w) - g + 2)) AS i FROM cut, range(1, {max_words + 1}) AS t(g) WHERE len(w) >= g)),
f AS (SELECT lang, phrase, words, count(*)::HUGEINT AS a FROM grams GROUP BY ALL HAVING count(*) >= {least}),
long AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE words >= 2),
parts AS (
  SELECT lang, phrase, words, a, k, array_to_string(w[1:k], ' ') AS p, array_to_string(w[k + 1:words], ' ') AS q
  FROM (SELECT *, unnest(range(1, words)) AS k FROM long)),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r, n, (1000::HUGEINT * c.a * n) // (x.a * y.a) AS score
  FROM parts c JOIN f x ON x.lang = c.lang AND x.phrase = c.p JOIN f y ON y.lang = c.lang AND y.phrase = c.q JOIN n_words t ON t.lang = c.lang),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_runs AS (
  SELECT lang, array_to_string(w[i:i + g - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, a, words, g, unnest(range(1, words - g + 2)) AS i FROM long, range(2, {max_words}) AS t(g) WHERE g < words) GROUP BY 1, 2),
kept AS (SELECT s.* FROM weakest s LEFT JOIN inner_runs i ON i.lang = s.lang AND i.phrase = s.phrase WHERE i.longer IS NULL OR 100 * i.longer < 100 * s.a)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= {top}"""
