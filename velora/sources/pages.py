"""Landed feed pages with a channel for bad ones.

A page is a file ``{total_count, results: [...]}``: some records of one request
and the number of records that the whole request has. The feed is complete when
the records landed for a request reach the number its pages announce. A page
that cannot be read, or only in part, is kept with its whole text and a reason;
the batch load and the stream put such texts into a quarantine table, from
which a page can be mended and landed again.

Files are read as whole texts, one row per file, and parsed once. A file of no
bytes has no row: Spark's readers leave such files out, and there is no text to
keep. What its request lacks shows in ``request_totals``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velora.functions.scalar import coord_text
from velora.operators.quality import rename_columns

# The feed's field names, mapped to ours.
PAGE_FIELDS = {"id": "site_id", "name": "site_name", "sum_counts": "hourly_count", "date": "ts", "coordinates": "coordinates"}
COUNT_TEXT_COLUMNS = ["site_id", "site_name", "hourly_count", "ts", "coordinates"]

RECORD = "struct<id: string, name: string, sum_counts: string, date: string, coordinates: struct<lat: double, lon: double>>"
_PARSED = f"page struct<total_count: bigint, results: array<{RECORD}>>, bad string"

UNREADABLE = "unreadable"
DAMAGED = "damaged fields"


def page_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of every file below ``path``, folders of the form ``key=value`` included."""
    text = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def page_text_stream(spark: SparkSession, path: str, max_files: int) -> DataFrame:
    """The same as a stream of newly landed files."""
    source = spark.readStream.option("wholetext", True).option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files)
    return source.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def parse_pages(texts: DataFrame) -> DataFrame:
    """(file, text, request, announced, results, reason): one row per page, good or bad.

    ``reason`` is NULL for a good page; ``unreadable`` if there is no list of
    records (text cut off, not one JSON object, another type); ``damaged
    fields`` if records are there but some record is null or some field has
    another type. The records of a damaged page count, an unreadable page has none.
    ``request`` is the folder ``key=value`` nearest to the root of the file's
    path, else the day of the page's first record.

    The text is parsed as a member of an object, so that anything behind the
    first JSON value is an error and not left out.
    """
    parsed = F.from_json(F.concat(F.lit('{"page":'), F.col("text"), F.lit("}")), _PARSED, {"columnNameOfCorruptRecord": "bad"})
    p = texts.select("file", "text", parsed.alias("p"))
    results, announced, bad = F.col("p.page.results"), F.col("p.page.total_count"), F.col("p.bad").isNotNull()
    nothing_announced = results.isNull() & ~bad & F.coalesce(announced == 0, F.lit(False))
    reason = F.when(nothing_announced, None).when(results.isNull(), UNREADABLE).when(bad | F.exists(results, lambda r: r.isNull()), DAMAGED)
    folder = F.nullif(F.regexp_extract("file", "/([A-Za-z_][A-Za-z0-9_]*=[^/]*)/", 1), F.lit(""))
    first_day = F.substring(F.try_element_at(results, F.lit(1))["date"], 1, 10)
    return p.select(
        "file", "text", F.coalesce(folder, first_day).alias("request"), announced.alias("announced"),
        F.filter(results, lambda r: r.isNotNull()).alias("results"), reason.alias("reason"),
    )


def page_records(pages: DataFrame) -> DataFrame:
    """C7 + U1: the count text rows of all pages that have records."""
    rec = pages.select(F.explode("results").alias("r")).select("r.*")
    rec = rec.withColumn("coordinates", coord_text(F.col("coordinates.lat"), F.col("coordinates.lon")))
    return rename_columns(rec, PAGE_FIELDS).select(*[F.col(c).cast("string") for c in COUNT_TEXT_COLUMNS])


def quarantined(pages: DataFrame) -> DataFrame:
    """(file, request, reason, text) of the bad pages."""
    return pages.filter("reason IS NOT NULL").select("file", "request", "reason", "text")


def page_report(pages: DataFrame) -> DataFrame:
    """Per file: request, announced, landed (records read), reason."""
    return pages.select("file", "request", "announced", F.coalesce(F.size("results"), F.lit(0)).cast("long").alias("landed"), "reason")


def request_totals(pages: DataFrame) -> DataFrame:
    """Per request: pages, announced, landed, missing records and bad pages; ``complete`` if it lacks nothing it announces.

    Every page of a request announces the same total; if they differ (the feed
    grew meanwhile) the largest counts. A request of which no page can be read
    announces NULL, misses an unknown number (NULL) and is not complete.
    """
    r = page_report(pages).groupBy("request").agg(
        F.count(F.lit(1)).alias("pages"),
        F.max("announced").alias("announced"),
        F.sum("landed").alias("landed"),
        F.count("reason").alias("bad_pages"),
    )
    missing = F.when(F.col("announced").isNotNull(), F.greatest(F.col("announced") - F.col("landed"), F.lit(0).cast("long")))
    return r.withColumn("missing", missing).withColumn("complete", F.coalesce(missing == 0, F.lit(False)))
