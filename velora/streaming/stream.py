"""The count feed as a Structured Streaming job over a landing folder.

``readStream`` watches the folder where feed pages (JSON) land; each
micro-batch is typed and floored, then appended through ``foreachBatch`` with
the same conflict-ignoring rule as the batch path (``append_new``: keys already
stored are skipped, repeated keys of a batch keep the first). Rows of any age
are taken: there is no watermark, and no state is kept between batches. The
checkpoint folder makes the stream resumable after a driver or executor loss:
the file source records which files were processed, and ``append_new`` makes a
replayed batch idempotent. ``max_files`` bounds a micro-batch, so a backlog is
read in many batches.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velora.functions.calendar import floor_hour
from velora.operators.quality import coerce_counts, drop_null_keys
from velora.sinks.tables import append_new
from velora.sources.pages import page_records, page_text_stream, parse_pages, quarantined

MAX_FILES = 1000


def count_stream(spark: SparkSession, landing: str, max_files: int = MAX_FILES) -> DataFrame:
    """Typed, floored count rows from a landing folder of JSON pages (a streaming frame)."""
    return page_counts(parse_pages(page_text_stream(spark, landing, max_files)))


def page_counts(pages: DataFrame) -> DataFrame:
    """P3, P4, P7 on the records of parsed pages."""
    return drop_null_keys(coerce_counts(page_records(pages))).withColumn("ts", floor_hour("ts"))


def start_count_ingest(
    spark: SparkSession, landing: str, table_path: str, checkpoint: str, available_now: bool = True, max_files: int = MAX_FILES,
    quarantine_path: str | None = None,
):
    """Run the stream into the raw table; returns the StreamingQuery.

    ``checkpoint`` must be a shared folder (the cluster's checkpoint location).
    ``append_new`` writes the candidate rows of a batch once and works on the
    written copy, so a batch is never held in memory. Texts of bad pages go to
    ``quarantine_path`` (default: beside the table), a file once, however often
    a batch is run.
    """
    bad_path = quarantine_path or f"{table_path.rstrip('/')}_quarantine"

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        pages = parse_pages(batch).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            append_new(batch.sparkSession, table_path, page_counts(pages).withColumn("ingest_seq", F.lit(batch_id)))
            append_new(batch.sparkSession, bad_path, quarantined(pages), keys=("file",), ts=None)
        finally:
            pages.unpersist()

    texts = page_text_stream(spark, landing, max_files)
    w = texts.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
