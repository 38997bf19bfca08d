"""Threshold-scaled document sketches (operator 7). DataFrame and SQL functions only.

A text's sketch holds the hashes of all its word shingles that lie below a
fixed fraction of the hash range, whatever the size of the text; so sketches of
very unequal texts compare without bias, and the sketch of a union is the union
of the sketches. A text all of whose hashes lie above the limit keeps its
smallest one, so that only a text without words has an empty sketch; ``merge``
keeps that rule.

Hashes are the first 16 hex digits of MD5 over the shingle's UTF-8 bytes; the
limit is a prefix of hex digits ("2": one eighth).
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
LIMIT = "2"  # hashes below 0x2000000000000000: one in eight
DIGITS = 16
BUCKETS_PER_PARTITION = 8
_SPACE = "[ \\t\\n\\x0B\\f\\r]+"


def words(text: Column) -> Column:
    """Lower-cased words between ASCII white space; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPACE), lambda w: w != "")


def shingles(w: Column, width: int = SHINGLE_WORDS) -> Column:
    """Space-joined runs of ``width`` words; all words if there are fewer; none without words."""
    runs = F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.array_join(F.slice(w, i, width), " "))
    return F.when(F.size(w) >= width, runs).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))


def _scaled(hashes: Column, limit: str) -> Column:
    low = F.filter(hashes, lambda h: h < limit)
    smallest = F.when(F.size(hashes) > 0, F.array(F.array_min(hashes))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.when(F.size(low) > 0, F.array_distinct(low)).otherwise(smallest))


def with_sketch(df: DataFrame, text: str, out: str, width: int = SHINGLE_WORDS, limit: str = LIMIT) -> DataFrame:
    """Adds the sorted sketch of ``text`` (array of hex hashes); null counts as empty."""
    # each step is a column of its own, so that it is evaluated once per row
    return (
        df.withColumn("__words", words(F.col(text)))
        .withColumn("__hashes", F.transform(shingles(F.col("__words"), width), lambda s: F.substring(F.md5(s.cast("binary")), 1, DIGITS)))
        .drop("__words")
        .withColumn(out, _scaled(F.col("__hashes"), limit))
        .drop("__hashes")
    )


def merge(a: Column, b: Column, limit: str = LIMIT) -> Column:
    """The sketch of two texts' shingles together."""
    return _scaled(F.array_union(a, b), limit)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches; two empty ones are alike."""
    total = F.size(F.array_union(a, b))
    return F.when(total > 0, F.size(F.array_intersect(a, b)) / total).otherwise(F.lit(1.0))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has too; null if a is empty."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def _buckets(docs: DataFrame) -> tuple[Bucketizer, list[tuple]]:
    """Ranges of doc_id of about equal size, and (bucket, largest id) of each from high ids to low."""
    spark = docs.sparkSession
    n = BUCKETS_PER_PARTITION * max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ids = docs.select(F.col("doc_id").cast("double").alias("__id"), "doc_id")
    cuts = ids.agg(F.percentile_approx("__id", [k / n for k in range(1, n)], 10 * n)).first()[0] if n > 1 else None
    splits = [-math.inf, *sorted({0.0, *(cuts or [])}), math.inf]
    bucketizer = Bucketizer(splits=splits, inputCol="__id", outputCol="__bucket", handleInvalid="keep")
    largest = _bucketed(bucketizer, docs.select("doc_id")).groupBy("__bucket").agg(F.max("doc_id").alias("largest"))
    found = sorted(((r[0], r[1]) for r in largest.collect()), reverse=True)  # at most n + 1 rows
    return bucketizer, found


def _bucketed(bucketizer: Bucketizer, docs: DataFrame) -> DataFrame:
    """Adds __bucket; rows without an id get -1, below all others."""
    out = bucketizer.transform(docs.withColumn("__id", F.col("doc_id").cast("double")))
    return out.withColumn("__bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("__bucket").cast("int"))).drop("__id")


def _unpacked(packed: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.hex(packed)), F.lit(f"[0-9a-f]{{{DIGITS}}}"), F.lit(0))


def with_next(docs: DataFrame, limit: str = LIMIT, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, text, sketch, next_text, next_sketch): the next row in descending doc_id, then text; after the last the first.

    Null ids come last; null texts are empty. Rows are dealt by ranges of
    doc_id; the first row of each range is copied to the range before it, so
    that a window per range sees every neighbour and each text is shuffled once.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bucketizer, found = _buckets(docs)
    follows = [
        (first, bucket, int(k + 1 == len(found)) + 1)
        for k, (bucket, _) in enumerate(found)
        for _, first in [found[(k + 1) % len(found)]]
    ]
    halos = spark.createDataFrame(follows, "first_id bigint, to_bucket int, halo int")
    own = _bucketed(bucketizer, docs).withColumn("halo", F.lit(0))
    copies = docs.join(F.broadcast(halos), F.col("doc_id").eqNullSafe(F.col("first_id"))).select(  # one row per range
        "doc_id", "text", F.col("to_bucket").alias("__bucket"), "halo"
    )
    rows = with_sketch(own.unionByName(copies), "text", "sketch", width, limit)
    rows = rows.withColumn("sketch", F.unhex(F.array_join("sketch", "")))  # 8 bytes a hash through the shuffle
    order = Window.partitionBy("__bucket").orderBy("halo", F.col("doc_id").desc_nulls_last(), "text")
    return (
        rows.withColumn("__next", F.lead(F.struct("text", "sketch")).over(order))
        .filter("halo = 0")
        .select(
            "doc_id",
            "text",
            _unpacked(F.col("sketch")).alias("sketch"),
            F.col("__next.text").alias("next_text"),
            _unpacked(F.col("__next.sketch")).alias("next_sketch"),
        )
    )


def fingerprint_report(docs: DataFrame, limit: str = LIMIT, width: int = SHINGLE_WORDS) -> DataFrame:
    """One row per row of ``docs``: the sketch of its text and of its edited text, and their likeness.

    In the edited text the last floor(n_chars / 2) code points give way to as
    many first ones (or all) of the next document. Columns: doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    Empty and null texts have an empty fingerprint. Other columns are ignored.
    """
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), (n - half).cast("int")), F.substr("next_text", F.lit(1), half))
    rows = with_next(docs, limit, width).withColumn("n_chars", n.cast("long")).withColumn("edited", edited).drop("text", "next_text")
    rows = with_sketch(rows, "edited", "edited_sketch", width, limit)
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.array_join("sketch", "").alias("fingerprint"),
        F.array_join("edited_sketch", "").alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def _sql_sketch(text: str) -> str:
    w = f"list_filter(string_split_regex(lower({text}), '[ \\t\\n\\x0b\\x0c\\r]+'), lambda w: w <> '')"
    s = (
        f"list_transform([{w}], lambda v: CASE WHEN len(v) >= {SHINGLE_WORDS} THEN "
        f"list_transform(range(1, len(v) - {SHINGLE_WORDS - 2}), lambda i: array_to_string(v[i:i + {SHINGLE_WORDS - 1}], ' ')) "
        "WHEN len(v) > 0 THEN [array_to_string(v, ' ')] ELSE [] END)[1]"
    )
    h = f"list_distinct(list_transform({s}, lambda s: substr(md5(s), 1, {DIGITS})))"
    return (
        f"list_transform([{h}], lambda h: list_sort(CASE WHEN len(list_filter(h, lambda x: x < '{LIMIT}')) > 0 "
        f"THEN list_filter(h, lambda x: x < '{LIMIT}') WHEN len(h) > 0 THEN [list_min(h)] ELSE [] END))[1]"
    )


def _sql_likeness(a: str, b: str) -> str:
    union = f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN {union} = 0 THEN 1.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / {union} END"


REPORT_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (
  SELECT doc_id, text, length(text) AS n,
    coalesce(lead(text) OVER w, first_value(text) OVER (ORDER BY doc_id DESC NULLS LAST, text)) AS next_text
  FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, text)
),
e AS (
  SELECT doc_id, n, text, next_text,
    concat(substring(text, 1, (n - n // 2)::BIGINT), substring(next_text, 1, (n // 2)::BIGINT)) AS edited
  FROM n
),
s AS (
  SELECT doc_id, n, edited, {_sql_sketch("text")} AS sketch, {_sql_sketch("edited")} AS edited_sketch,
    {_sql_sketch("next_text")} AS next_sketch
  FROM e
)
SELECT doc_id, n::BIGINT AS n_chars, sha256(edited) AS edited_sha256, array_to_string(sketch, '') AS fingerprint,
  array_to_string(edited_sketch, '') AS edited_fingerprint,
  {_sql_likeness("sketch", "edited_sketch")} AS near_edited, {_sql_likeness("sketch", "next_sketch")} AS near_next
FROM s
"""
