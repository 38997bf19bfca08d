"""Language identification with string kernels (operator 1).

Two texts are as alike as the character n-grams (n = 1..4, all lengths blended)
that occur in both: the presence kernel k(x, y) = |g(x) & g(y)| / sqrt(|g(x)| |g(y)|).
N-grams are told apart by a hash of ``SLOT_BITS`` bits.

Nystroem: with landmarks l_1..l_m and their kernel matrix K_mm, a text has the
features K(x, L) K_mm^(-1/2). One ridge regression per language against the
rest is fitted on them. Landmark matrix, Nystroem map and coefficients are
linear, so they are multiplied out once into a table (slot x language); a batch
of texts is scored by one product of its sparse presence matrix with it.

The model is fitted on a bounded sample: at most ``PER_LANGUAGE`` rows of each
language and ``MAX_SAMPLE`` in all, but two of each language at least, of texts of
any length. Every language that labels a text is learned; every row is scored on
its whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velora.llm.common import bounded_sample, is_held_out

SLOT_BITS = 18
MAX_N = 4
PER_LANGUAGE = 300
MAX_SAMPLE = 2000
LANDMARKS = 256
RIDGE = 1e-2
UNKNOWN = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)


def has_letter(text: str | None) -> bool:
    return text is not None and next(filter(str.isalpha, text), None) is not None


def spectrum(text: str, seen: np.ndarray | None = None) -> np.ndarray:
    """Slots of the distinct n-grams of the lower-cased text, other than letters read as one blank.

    ``seen`` is scratch space of 2^SLOT_BITS int64 that may be used again.
    """
    seen = np.empty(1 << SLOT_BITS, dtype=np.int64) if seen is None else seen
    plain = " " + _NOT_LETTERS.sub(" ", text.lower()).strip() + " "
    codes = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    gram, slots = codes, []
    for n in range(1, MAX_N + 1):
        if n > 1:
            gram = gram[:-1] * _BASE + codes[n - 1 :]
        slots.append((gram + np.uint64(n)) * _ODD >> np.uint64(64 - SLOT_BITS))
    slot = np.concatenate(slots).astype(np.int64)
    place = np.arange(len(slot))
    seen[slot] = place  # of equal slots the last one stays
    return slot[seen[slot] == place]


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # slots x languages, float32

    def scores(self, spectra: list[np.ndarray]) -> np.ndarray:
        """One row per text: the regressions' values; 1 is the language, 0 another."""
        sizes = np.array([len(s) for s in spectra])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        sums = np.add.reduceat(self.table[np.concatenate(spectra)], starts, axis=0)
        return sums / np.sqrt(sizes)[:, None]


def fit(samples: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel | None:
    """Fits on (language, spectrum) pairs; landmarks are dealt evenly over the languages, in the order given."""
    languages = sorted({lang for lang, _ in samples})
    if not languages:
        return None
    per = max(1, landmarks // len(languages))
    chosen: list[int] = []
    for lang in languages:
        chosen += [i for i, (x, _) in enumerate(samples) if x == lang][:per]
    present = np.zeros((len(chosen), 1 << SLOT_BITS), dtype=bool)
    for row, i in enumerate(chosen):
        present[row, samples[i][1]] = True
    norms = np.sqrt([len(samples[i][1]) for i in chosen])
    kernel = np.array([present[:, s].sum(axis=1) / (norms * np.sqrt(len(s))) for _, s in samples])
    values, vectors = np.linalg.eigh(kernel[chosen])
    good = values > 1e-8 * values[-1]
    nystroem = vectors[:, good] / np.sqrt(values[good])
    features = kernel @ nystroem
    target = np.array([[float(lang == x) for x in languages] for lang, _ in samples])
    n = len(samples)
    weights = np.sqrt(n / (len(languages) * target.sum(axis=0)))[target.argmax(axis=1)][:, None]  # languages count alike
    fw = features * weights
    coefficients = np.linalg.solve(fw.T @ fw + ridge * n * np.eye(fw.shape[1]) / len(languages), fw.T @ (target * weights))
    per_landmark = ((nystroem @ coefficients) / norms[:, None]).astype(np.float32)
    table = np.zeros((1 << SLOT_BITS, len(languages)), dtype=np.float32)
    for row in range(len(chosen)):
        table[present[row]] += per_landmark[row]
    return LanguageModel(languages, table)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel | None:
    """Fits on a bounded sample of ``docs``, its labels in ``lang``; None without labelled texts."""
    usable = docs.select(doc_id, text, lang).filter(F.col(lang).isNotNull() & F.col(text).rlike("\\p{L}"))
    labels = usable.select(lang).distinct().count()
    if not labels:
        return None
    per = max(2, min(PER_LANGUAGE, MAX_SAMPLE // labels))
    sample = bounded_sample(usable, lang, doc_id, per, labels)

    @F.pandas_udf(T.BinaryType())
    def slots(texts: pd.Series) -> pd.Series:
        return pd.Series([spectrum(t).astype("<i4").tobytes() for t in texts], dtype=object)

    rows = sample.select(lang, F.xxhash64(doc_id).alias("h"), slots(F.col(text)).alias("slots")).collect()
    rows.sort(key=lambda r: (r[0], r["h"], r["slots"]))
    return fit([(r[0], np.frombuffer(r["slots"], dtype="<i4")) for r in rows])


def predict(docs: DataFrame, model: LanguageModel | None, text: str = "text", out: str = "language") -> DataFrame:
    """Adds struct ``out``: lang_pred, score (the winner's regression value, cut to 0..1).

    Null texts and texts without a letter are 'und' with score 0, as is every
    text without a model. Equal scores go to the first language by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^SLOT_BITS x languages floats: 1 MB a language
    kind = T.StructType().add("lang_pred", T.StringType()).add("score", T.DoubleType())

    @F.pandas_udf(kind)
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        seen = np.empty(1 << SLOT_BITS, dtype=np.int64)
        for texts in batches:
            found = [(UNKNOWN, 0.0)] * len(texts)
            at = [i for i, t in enumerate(texts) if m is not None and has_letter(t)]
            for k in range(0, len(at), 64):
                few = at[k : k + 64]
                values = m.scores([spectrum(texts.iloc[i], seen) for i in few])
                for i, row in zip(few, values):
                    best = int(row.argmax())
                    found[i] = (m.languages[best], float(min(1.0, max(0.0, row[best]))))
            yield pd.DataFrame(found, columns=["lang_pred", "score"])

    return docs.withColumn(out, guess(F.col(text)))


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learned only from rows that are not held out.

    Rows with a null doc_id are never held out. Repeated rows are scored alike.
    """
    docs = docs.select("doc_id", "text", "lang")
    model = train(docs.filter(~is_held_out()))
    scored = predict(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", is_held_out().alias("held_out"), "language.lang_pred", "language.score")
