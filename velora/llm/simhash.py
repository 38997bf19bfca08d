"""SimHash near duplicates by multi-index hashing (operator 9).

A fingerprint has 64 bits. It is cut into segments; two fingerprints at most d
bits apart agree, but for floor(d / segments) bits, on one segment at least.
So every fingerprint is stored once per segment under its segment value, and
looks up the small Hamming ball around each of its own segment values. Matches
are verified on all 64 bits. A pair of values that differ in r bits is met from
one side only: a probe flips bits that are 0 in the probing value, or is the
value itself, which halves the balls without losing a pair of radius 0 or 1.

Only distinct fingerprints are indexed: a group of copies, however large, is
one row there, and its members are joined back by fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velora.llm.common import connected_components, row_key, stored

SHINGLE_WORDS = 3
MAX_BITS = 3
SEGMENTS = 2
HASH_SEED = 42
_BLOCK = 1 << 16


def _words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at ASCII white space (space, 09-0D)."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit SimHash; bit set if it is set in over half the shingle hashes. No words: 0."""
    words = _words(text)
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = [b" ".join(t) for t in zip(*(words[i:] for i in range(width)))]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(shingles), _BLOCK):
        hashes = np.array([xxhash.xxh64_intdigest(s, HASH_SEED) for s in shingles[at : at + _BLOCK]], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles)).view(">i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fp", width: int = SHINGLE_WORDS) -> DataFrame:
    """Adds the signed 64-bit fingerprint of ``text``; a null text counts as empty."""

    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    return docs.withColumn(out, fp(F.col(text)))


def _segments(n: int) -> list[tuple[int, int]]:
    """(shift, bits) of n segments that cover 64 bits."""
    cuts = [64 * i // n for i in range(n + 1)]
    return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:])]


def _entry(k: int, value: Column) -> Column:
    return F.struct(F.lit(k).cast("byte").alias("seg"), value.alias("val"))


def _ball(k: int, value: Column, flips: list[int], one_sided: bool) -> Column:
    """The entries around a segment value; one-sided: only flips of bits that are 0 in it."""
    ball = F.array(*[F.lit(m).cast("long") for m in flips])
    if one_sided:
        ball = F.filter(ball, lambda m: value.bitwiseAND(m) == 0)
    return F.transform(ball, lambda m: _entry(k, value.bitwiseXOR(m)))


def near_pairs(fps: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints ``fp`` at most ``max_bits`` apart. A pair may repeat."""
    radius = max_bits // segments
    tables, probes = [], []
    for k, (shift, bits) in enumerate(_segments(segments)):
        value = F.shiftrightunsigned(F.col("fp"), shift).bitwiseAND(F.lit((1 << bits) - 1))
        tables.append(_entry(k, value))
        flips = [0] + [sum(1 << i for i in c) for r in range(1, radius + 1) for c in combinations(range(bits), r)]
        probes.append(_ball(k, value, flips, one_sided=radius <= 1))
    index = fps.select(F.col("fp").alias("a"), F.explode(F.array(*tables)).alias("s")).select("a", "s.seg", "s.val")
    probe = fps.select(F.col("fp").alias("b"), F.explode(F.flatten(F.array(*probes))).alias("s")).select("b", "s.seg", "s.val")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return (
        probe.join(index, ["seg", "val"])
        .filter((F.col("a") != F.col("b")) & near)
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    )


def components(keyed: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> DataFrame:
    """(fp, component_id) for every distinct ``fp`` of ``keyed`` (doc_id, fp).

    component_id is the smallest doc_id whose fingerprint can be reached over
    links of at most ``max_bits`` bits; null where no document there has an id.
    """
    firsts = stored(keyed.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-fps")
    nodes = connected_components(near_pairs(firsts.select("fp"), max_bits, segments), "simhash-cc")
    labelled = firsts.join(nodes, firsts.fp == nodes.node, "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("component")
    )
    smallest = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return labelled.join(smallest, "component").select("fp", "component", "component_id")


def simhash_components(
    docs: DataFrame, width: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, segments: int = SEGMENTS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Null and empty texts have fingerprint 0 and link to each other. Repeated
    rows stay repeated. A null doc_id gets the smallest id of its component.
    An empty table gives no rows; other columns are ignored.
    """
    keyed = stored(with_fingerprint(docs.select("doc_id", "text"), width=width).select("doc_id", "fp"), "simhash-docs")
    groups = components(keyed, max_bits, segments)
    return keyed.join(groups, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_copies(
    docs: DataFrame, width: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, segments: int = SEGMENTS
) -> DataFrame:
    """Keeps one row of each component: the smallest doc_id (ids before null), then the smallest row key.

    Returns the columns of ``docs``. Of fully repeated rows one stays.
    """
    cols = docs.columns
    key = row_key(*[F.col(f"`{c}`") for c in cols if c not in ("doc_id",)])
    keyed = stored(
        with_fingerprint(docs.select("doc_id", "text", key.alias("rk")), width=width).select("doc_id", "rk", "fp"),
        "simhash-rows",
    )
    groups = components(keyed, max_bits, segments)
    keep = stored(
        keyed.join(groups.select("fp", "component"), "fp")
        .groupBy("component")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rk")).alias("w"))
        .select(F.col("w.doc_id").alias("keep_id"), F.col("w.rk").alias("keep_rk")),
        "simhash-keep",
    )
    marked = docs.withColumn("__rk", key)
    kept = marked.join(
        keep,
        marked["doc_id"].eqNullSafe(keep["keep_id"]) & (marked["__rk"] == keep["keep_rk"]),
        "left_semi",
    )
    return kept.dropDuplicates(["doc_id", "__rk"]).select(*[F.col(f"`{c}`") for c in cols])
