"""Toxicity by cumulative-link ordinal regression (operator 6).

Severity has grades 0 (clean) to K. The model is P(grade >= k | x) =
sigmoid(w . x - t_k) with t_1 < ... < t_K: one weight vector shared by all
thresholds. x holds, for every known word and word beginning (3 to 5 letters),
log2(1 + count), and log2(1 + words) of the text: its weight is never above 0,
so a longer text needs more typical words. The result is the expected grade,
sum over k of P(grade >= k).

Where the labels only say toxic or not, ``graded`` spreads the toxic sample
over three grades by how many of its words are typical of toxic texts (thirds
of that number; texts without such a word get the lowest grade).

The features are the ``MAX_FEATURES`` that tell toxic texts best from others by
the numbers of texts they occur in, counted over all labelled rows; those that
chance explains are left out. The weights are fitted on a bounded sample of labelled
rows of any length (``PER_CLASS`` of each class). Every row is scored on its whole
text. The model has that many floats, which is what is broadcast.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velora.llm.common import bounded_sample, stored

PER_CLASS = 2000
MAX_FEATURES = 1000
MIN_DOCS = 4
RATIO = 5.0
#: A feature counts in full if chance would give less than exp(-SURE) such features among all that were tried,
#: else the less, the weaker its evidence; below LEAST_TRUST it is left out.
SURE = 3.0
SHARPNESS = 4
LEAST_TRUST = 0.05
L2 = 1e-3
GRADES = 3
REJECT_AT = 0.5
_BEGINNINGS = (3, 4, 5)
_WORD = re.compile(r"[^\W\d_]+")
_KNOWN_WORDS = 300_000


def features_of(word: str) -> list[int]:
    """Ids (64-bit hashes) of a word and its beginnings."""
    out = [xxhash.xxh64_intdigest(word, 1)]
    out += [xxhash.xxh64_intdigest(word[:k], k) for k in _BEGINNINGS if len(word) >= k]
    return out


def words_of(text: str | None) -> list[str]:
    return [] if text is None else _WORD.findall(text.lower())


def counted(text: str | None) -> Counter:
    """Feature counts of a text."""
    counts: Counter = Counter()
    for word, n in Counter(words_of(text)).items():
        for f in features_of(word):
            counts[f] += n
    return counts


@dataclass(frozen=True)
class OrdinalModel:
    weights: dict[int, float]
    thresholds: np.ndarray
    length: float = 0.0  # weight of log2(1 + words), at most 0

    def cumulative(self, z: float) -> np.ndarray:
        """P(grade >= k) for k = 1..K."""
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds - z, -60, 60)))


def fit_ordinal(
    x: np.ndarray,
    grade: np.ndarray,
    top: int,
    l2: float = L2,
    steps: int = 400,
    weight: np.ndarray | None = None,
    falling: int | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds t_1 < ... < t_top that maximise the penalised likelihood (Adam, full batch).

    The weight of column ``falling`` is kept at or below 0.
    """
    n, d = x.shape
    weight = np.ones(n) if weight is None else weight * (n / weight.sum())
    at_least = grade[:, None] >= np.arange(1, top + 1)
    params = np.zeros(d + top)
    share = np.clip((weight[:, None] * at_least).mean(axis=0), 1e-3, 1 - 1e-3)
    start = np.log((1 - share) / share)
    params[d] = start[0]
    params[d + 1 :] = np.log(np.maximum(np.diff(start), 0.1))
    m, v = np.zeros_like(params), np.zeros_like(params)

    def thresholds(p: np.ndarray) -> np.ndarray:
        return np.cumsum(np.concatenate([p[d : d + 1], np.exp(p[d + 1 :])]))

    rows = np.arange(n)
    for i in range(1, steps + 1):
        t = thresholds(params)
        upper = 1 / (1 + np.exp(np.clip(t - (x @ params[:d])[:, None], -60, 60)))  # P(grade >= k)
        full = np.concatenate([np.ones((n, 1)), upper, np.zeros((n, 1))], axis=1)
        p = np.maximum(full[rows, grade] - full[rows, grade + 1], 1e-9)
        slope = np.concatenate([np.zeros((n, 1)), upper * (1 - upper), np.zeros((n, 1))], axis=1)
        lo, hi = weight * slope[rows, grade] / p, weight * slope[rows, grade + 1] / p
        grad = np.zeros_like(params)
        grad[:d] = -(x.T @ (lo - hi)) / n + l2 * params[:d]
        per_t = np.zeros(top + 2)  # d(-loglik)/dt_k
        np.add.at(per_t, grade, lo)
        np.add.at(per_t, grade + 1, -hi)
        per_t = per_t[1 : top + 1] / n
        later = np.cumsum(per_t[::-1])[::-1]
        grad[d] = later[0]
        grad[d + 1 :] = later[1:] * np.exp(params[d + 1 :])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params - 0.05 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-9)
        if falling is not None:
            params[falling] = min(params[falling], 0.0)
    return params[:d], thresholds(params)


@dataclass(frozen=True)
class Sample:
    """Labelled rows as sparse counts: entry e says that row ``row[e]`` has feature ``ids[column[e]]`` ``count[e]`` times."""

    toxic: np.ndarray
    ids: np.ndarray
    row: np.ndarray
    column: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> Sample:
        """From (toxic 0/1, feature ids, counts) per row."""
        ids, column = np.unique(np.concatenate([r[1] for r in rows]), return_inverse=True)
        row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[1]) for r in rows])
        return cls(np.array([r[0] for r in rows]), ids, row, column.astype(np.int32), np.concatenate([r[2] for r in rows]))

    def documents(self, of: np.ndarray) -> np.ndarray:
        """Per feature, the number of rows of ``of`` (a 0/1 mark per row) that have it."""
        return np.bincount(self.column, weights=of[self.row], minlength=len(self.ids))


def graded(s: Sample, top: int = GRADES) -> np.ndarray:
    """Grades from 0/1 labels: toxic rows in ``top`` equal parts by how often features typical of toxic rows occur."""
    n1, n0 = max(1, int(s.toxic.sum())), max(1, int((1 - s.toxic).sum()))
    in_toxic, in_clean = s.documents(s.toxic), s.documents(1 - s.toxic)
    typical = (in_toxic >= MIN_DOCS) & (in_toxic / n1 > 10 * (in_clean + 0.5) / n0)
    amount = np.bincount(s.row, weights=s.count * typical[s.column], minlength=len(s.toxic))
    grade = np.zeros(len(s.toxic), dtype=np.int64)
    own = amount[s.toxic == 1]
    if len(own):
        cuts = np.quantile(own, np.arange(1, top) / top)
        grade[s.toxic == 1] = 1 + np.searchsorted(cuts, own, side="right").clip(0, top - 1) * (own > 0)
    return grade


def evidence(a, c, n1: int, n0: int, log: Callable):  # noqa: ANN001, ANN201
    """-log of the (Chernoff) bound on the chance of ``a`` toxic ones among a + c texts. Arrays or Columns."""
    share = n1 / (n1 + n0)
    return a * log((a + 1e-9) / ((a + c) * share)) + c * log((c + 1e-9) / ((a + c) * (1 - share)))


def trust(a, c, n1: int, n0: int, tried: int, log: Callable, least: Callable):  # noqa: ANN001, ANN201
    """Share (0 to 1) of a feature's weight that its evidence supports among ``tried`` features. Arrays or Columns.

    The fit sees the feature scaled by it, so that the penalty holds down what few labels say. There is no number
    of labels below which nothing is learned.
    """
    return least(evidence(a, c, n1, n0, log) / (float(np.log(max(1, tried))) + SURE), 1.0) ** SHARPNESS


def telling(a, c, n1: int, n0: int):  # noqa: ANN001, ANN201
    """Whether a feature in ``a`` of n1 toxic and ``c`` of n0 clean texts is often enough in toxic ones, and RATIO times as often as in clean ones."""
    return (a >= MIN_DOCS) & (a / n1 >= (c + 0.5) * (RATIO / n0))


def chi_square(a, c, n1: int, n0: int):  # noqa: ANN001, ANN201
    n = n1 + n0
    return (a - (a + c) * (n1 / n)) * (a - (a + c) * (n1 / n)) / ((a + c) * (n - (a + c)) + 1.0)


def choose(s: Sample) -> tuple[np.ndarray, np.ndarray]:
    """The features to use, and how far to trust them, where the sample is all there is."""
    n1, n0 = int(s.toxic.sum()), int((1 - s.toxic).sum())
    a, c = s.documents(s.toxic), s.documents(1 - s.toxic)
    order = np.lexsort((s.ids, -chi_square(a, c, n1, n0)))
    sure = trust(a, c, n1, n0, int((a + c >= MIN_DOCS).sum()), np.log, np.minimum)
    ok = telling(a, c, n1, n0) & (sure >= LEAST_TRUST)
    best = order[ok[order]][:MAX_FEATURES]
    return s.ids[best], sure[best]


def fit(
    rows: list[tuple[int, np.ndarray, np.ndarray]],
    top: int = GRADES,
    chosen: tuple[np.ndarray, np.ndarray] | None = None,
    words: np.ndarray | None = None,
) -> OrdinalModel | None:
    """Fits on (toxic 0/1, feature ids, counts) per row; None unless both classes occur.

    ``chosen``: the features to use and their trust, by default those ``choose`` finds in the rows. ``words``: number of
    words per row.
    """
    if len({r[0] for r in rows}) < 2:
        return None
    s = Sample.of(rows)
    n, n1 = len(rows), int(s.toxic.sum())
    chosen, sure = choose(s) if chosen is None else chosen
    known = np.flatnonzero(np.isin(chosen, s.ids))
    known = known[np.argsort(chosen[known])]
    chosen, sure = chosen[known], sure[known]
    place = np.full(len(s.ids), -1)
    place[np.searchsorted(s.ids, chosen)] = np.arange(len(chosen))
    x = np.zeros((n, len(chosen) + 1))
    at = place[s.column] >= 0
    x[s.row[at], place[s.column[at]]] = np.log2(1 + s.count[at]) * sure[place[s.column[at]]]
    if words is not None:
        x[:, -1] = np.log2(1 + words)
    weight = np.where(s.toxic == 1, 1 / n1, 1 / (n - n1))  # classes count alike
    weights, thresholds = fit_ordinal(x, graded(s, top), top, weight=weight, falling=len(chosen))
    return OrdinalModel({int(f): float(w) for f, w in zip(chosen, weights[:-1] * sure)}, thresholds, float(weights[-1]))


def frequencies(labelled: DataFrame) -> DataFrame:
    """f, a, c: in how many toxic and clean texts a feature (as a signed 64-bit id) occurs, over all rows.

    The row whose f is null has the numbers of texts; features of fewer than MIN_DOCS texts are left out.
    """

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def distinct(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, list[int]] = {}
        for texts in batches:
            out = []
            for t in texts:
                ids: set[int] = set()
                for word in set(words_of(t)):
                    hits = known.get(word)
                    if hits is None:
                        if len(known) >= _KNOWN_WORDS:
                            known.clear()
                        hits = known[word] = features_of(word)
                    ids.update(hits)
                out.append(np.fromiter(ids, dtype="<u8", count=len(ids)).view("<i8"))
            yield pd.Series(out, dtype=object)

    f = F.explode(F.concat(distinct("text"), F.array(F.lit(None).cast("long"))))
    counts = labelled.select("toxic", f.alias("f")).groupBy("f").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("c"))
    return counts.filter(F.col("f").isNull() | (F.col("a") + F.col("c") >= MIN_DOCS))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> OrdinalModel | None:
    """Fits on documents with a non-null ``toxic`` label; of contradicting labels of one document the larger counts."""
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    marks = marks.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    # only the different words of a text cross the shuffle; its words are the same, as none has white space
    once = F.concat_ws(" ", F.array_distinct(F.split("text", "[ \\t\\n\\r]+")))
    labelled = texts.select("doc_id", once.alias("text")).join(marks.hint("merge"), "doc_id")
    terms = stored(frequencies(labelled), "toxicity-terms")
    total = terms.filter("f is null").first()
    if total is None or not total["a"] or not total["c"]:
        return None
    n1, n0, tried = total["a"], total["c"], terms.filter("f is not null").count()
    a, c = F.col("a"), F.col("c")
    best = terms.filter(F.col("f").isNotNull() & telling(a, c, n1, n0))
    best = best.withColumn("sure", trust(a, c, n1, n0, tried, F.log, lambda x, y: F.least(x, F.lit(y)))).filter(F.col("sure") >= LEAST_TRUST)
    best = best.orderBy(chi_square(a, c, n1, n0).desc(), "f").limit(MAX_FEATURES).select("f", "sure").collect()
    chosen = np.array([r["f"] for r in best], dtype="<i8").view("<u8"), np.array([r["sure"] for r in best])

    few = bounded_sample(marks, "toxic", "doc_id", 2 * per_class)  # at most four times per_class ids
    sample = bounded_sample(texts.join(F.broadcast(few), "doc_id"), "toxic", "doc_id", per_class)
    wanted = frozenset(chosen[0].tolist())

    @F.pandas_udf(T.StructType().add("ids", T.BinaryType()).add("counts", T.BinaryType()).add("words", T.LongType()))
    def extract(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            c = {f: n for f, n in counted(t).items() if f in wanted}
            rows.append((np.array(list(c), dtype="<u8").tobytes(), np.array(list(c.values()), dtype="<u4").tobytes(), len(words_of(t))))
        return pd.DataFrame(rows, columns=["ids", "counts", "words"])

    found = sample.select("toxic", "doc_id", extract(F.col("text")).alias("x")).collect()
    found.sort(key=lambda r: (r["doc_id"], r["toxic"], r["x"]["ids"]))
    rows = [(r["toxic"], np.frombuffer(r["x"]["ids"], dtype="<u8"), np.frombuffer(r["x"]["counts"], dtype="<u4")) for r in found]
    return fit(rows, chosen=chosen, words=np.array([r["x"]["words"] for r in found]))


def with_severity(docs: DataFrame, model: OrdinalModel | None, text: str = "text", out: str = "toxicity") -> DataFrame:
    """Adds struct ``out``: severity (expected grade), p_toxic (P(grade >= 1)), grade (the most probable).

    Null and empty texts are scored on no words. Without a model all are 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = T.StructType().add("severity", T.DoubleType()).add("p_toxic", T.DoubleType()).add("grade", T.IntegerType())

    @F.pandas_udf(kind)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        known: dict[str, tuple[int, ...]] = {}
        for texts in batches:
            rows = []
            for t in texts:
                if m is None:
                    rows.append((0.0, 0.0, 0))
                    continue
                counts: Counter = Counter()
                words = words_of(t)
                for word in words:
                    hits = known.get(word)
                    if hits is None:
                        if len(known) >= _KNOWN_WORDS:
                            known.clear()
                        hits = known[word] = tuple(f for f in features_of(word) if f in m.weights)
                    if hits:
                        counts.update(hits)
                z = sum(m.weights[f] * np.log2(1 + c) for f, c in counts.items())
                p = m.cumulative(z + m.length * np.log2(1 + len(words)))
                each = np.concatenate([[1.0], p]) - np.concatenate([p, [0.0]])
                rows.append((float(p.sum()), float(p[0]), int(each.argmax())))
            yield pd.DataFrame(rows, columns=["severity", "p_toxic", "grade"])

    return docs.withColumn(out, score(F.col(text)))


def rejected(toxicity: str = "toxicity", at: float = REJECT_AT) -> Column:
    return F.col(f"{toxicity}.p_toxic") >= at


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, severity, p_toxic, grade, toxic of every row of ``docs``."""
    scored = with_severity(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", "toxicity.*", rejected().alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, as they are."""
    scored = with_severity(docs, train(docs, labels), out="__toxicity")
    return scored.filter(~rejected("__toxicity")).select(*[F.col(f"`{c}`") for c in docs.columns])
