"""Scans of landed files.

Network paging and downloads are not part of the engine: the feeds are read
from files already landed in a folder (one JSON page or one CSV per file).
Every reader gives Spark an explicit schema (no inference pass) and returns
the canonical count columns ``site_id, site_name, hourly_count, ts,
coordinates`` as text, ready for ``quality.coerce_counts``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velora.functions.calendar import floor_hour
from velora.operators.quality import standard_names
from velora.sources.pages import COUNT_TEXT_COLUMNS, page_records, page_texts, parse_pages

# The bulk export's header names for the five kept columns, mapped to ours.
CSV_COLUMNS = {
    "identifiant_du_site_de_comptage": "site_id",
    "nom_du_site_de_comptage": "site_name",
    "comptage_horaire": "hourly_count",
    "date_et_heure_de_comptage": "ts",
    "coordonnées_géographiques": "coordinates",
    "coordonnees_geographiques": "coordinates",
}
WEATHER_FIELDS = ("time", "rain", "snowfall", "apparent_temperature", "wind_speed_10m")


def read_counts_csv(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """Delimited bulk export, header row, every column read as text; 5 columns kept.

    Input splits play the role of the reference's 50k-row chunks.
    """
    raw = spark.read.option("sep", sep).option("header", True).option("inferSchema", False).option("encoding", "UTF-8").csv(path)
    return _kept_columns(raw)


def _kept_columns(raw: DataFrame) -> DataFrame:
    """The five count columns as text, whatever way the header spells them (a row's first non-NULL one counts)."""
    spelled: dict[str, list[Column]] = {}
    for c, name in zip(raw.columns, standard_names(raw.columns)):
        spelled.setdefault(CSV_COLUMNS.get(name, name), []).append(F.col("`" + c.replace("`", "``") + "`"))
    missing = [c for c in COUNT_TEXT_COLUMNS if c not in spelled]
    if missing:
        raise ValueError(f"count export lacks columns {missing}")
    return raw.select(*[F.coalesce(*spelled[c]).cast("string").alias(c) for c in COUNT_TEXT_COLUMNS])


def sniff_separator(spark: SparkSession, path: str) -> str:
    """S2: ';' or ',' of a single file, from its header line (one line read)."""
    first = spark.read.text(path).limit(1).collect()
    line = (first[0][0] or "") if first else ""
    return ";" if line.count(";") > line.count(",") else ","


_SEPARATORS = (";", ",")
_START = "\ufeff"  # byte order mark


def _fields(line: Column, sep: Column, n: int) -> Column:
    """The first n fields of a CSV line as a struct of texts, under the separator of its file."""
    schema = ", ".join(f"f{i} string" for i in range(n))
    parsed = [F.from_csv(line, schema, {"sep": s}) for s in _SEPARATORS]
    return F.when(sep == _SEPARATORS[0], parsed[0]).otherwise(parsed[1])


def file_dialects(spark: SparkSession, path: str) -> DataFrame:
    """Per file its header line and separator (``;`` if the header has more of them than commas).

    The header is the first line of the file's first block; the rows of one
    block are in order within their task, so the smallest row number is it.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__at"),
        F.monotonically_increasing_id().alias("__n"), "value",
    )
    header = lines.filter("__at = 0").groupBy("file").agg(F.min_by("value", "__n").alias("header"))
    count = [F.length("header") - F.length(F.replace("header", F.lit(s), F.lit(""))) for s in _SEPARATORS]
    return header.withColumn("sep", F.when(count[0] > count[1], _SEPARATORS[0]).otherwise(_SEPARATORS[1]))


def read_csv_any_sep(spark: SparkSession, path: str) -> DataFrame:
    """CSV files of any mixture of separators, column orders and column sets, joined by column name in any case (all text).

    Each file's header gives its separator and the place of each column; a
    column that a file lacks is NULL in its rows. Lines that repeat their file's
    header, and empty lines, are left out. A quoted field may hold separators
    but no line break. Only the names of the columns reach the driver.
    """
    dialects = file_dialects(spark, path)
    heads = dialects.withColumn("header", F.ltrim("header", F.lit(_START)))
    widths = [F.size(F.split(F.col("header"), s)) for s in _SEPARATORS]
    width = heads.agg(F.max(F.greatest(*widths))).first()[0]
    if width is None:
        return spark.createDataFrame([], "value string").select()
    as_array = F.array(*[F.col(f"p.f{i}") for i in range(width)])
    heads = heads.withColumn("p", _fields(F.col("header"), F.col("sep"), width)).select("file", "sep", as_array.alias("names"))
    each = heads.select(F.posexplode("names").alias("i", "name")).filter("name IS NOT NULL")
    names = [r["name"] for r in each.groupBy(F.lower("name")).agg(F.min_by("name", F.struct("i", "name")).alias("name"), F.min("i").alias("i")).orderBy("i", F.lower("name")).collect()]
    small = F.transform("names", F.lower)
    places = [F.array_position(small, F.lit(n.lower())).cast("int").alias(f"__{i}") for i, n in enumerate(names)]
    places = heads.select("file", "sep", *places).join(dialects.select("file", "header"), "file")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    rows = lines.join(places, "file").filter((F.col("value") != F.col("header")) & (F.trim("value") != ""))
    rows = rows.withColumn("p", _fields(F.col("value"), F.col("sep"), width)).withColumn("f", as_array)
    found = [F.when(F.col(f"__{i}") > 0, F.try_element_at("f", F.nullif(F.col(f"__{i}"), F.lit(0)))).alias(n) for i, n in enumerate(names)]
    return rows.select(*found)


def read_counts_any_csv(spark: SparkSession, path: str) -> DataFrame:
    """S1 + S2: a folder of count exports in any of the dialects, the five kept columns as text."""
    return _kept_columns(read_csv_any_sep(spark, path))


def read_count_pages(spark: SparkSession, path: str) -> DataFrame:
    """S3 + C7 + U1: landed JSON pages ``{total_count, results: [...]}`` -> count text rows.

    The union of all pages (and days) is the set of files under ``path``; an
    empty folder gives an empty frame. ``sources.pages`` tells which pages are
    bad and which requests lack records.
    """
    return page_records(parse_pages(page_texts(spark, path)))


WEATHER_SCHEMA = T.StructType(
    [
        T.StructField(
            "hourly",
            T.StructType(
                [T.StructField("time", T.ArrayType(T.StringType()))]
                + [T.StructField(f, T.ArrayType(T.DoubleType())) for f in WEATHER_FIELDS[1:]]
            ),
        )
    ]
)


def read_weather_json(spark: SparkSession, path: str) -> DataFrame:
    """Column-array JSON ``{hourly: {time: [...], rain: [...], ...}}`` -> one row per hour.

    Stamps lose any zone suffix (clock time kept), are floored to the hour;
    unparsable stamps become NULL (Q6 counts them).
    """
    doc = spark.read.schema(WEATHER_SCHEMA).option("multiLine", True).json(path)
    zipped = doc.select(F.inline(F.arrays_zip(*[F.col(f"hourly.{f}").alias(f) for f in WEATHER_FIELDS])))
    t = F.regexp_replace(F.col("time"), r"(Z|[+-]\d{2}:?\d{2})$", "").try_cast("timestamp_ntz")
    return zipped.withColumn("time", floor_hour(t))


def file_date_range(spark: SparkSession, path: str, column: str, sep: str = ";") -> DataFrame:
    """First and last date of one CSV column, as ``yyyy/MM/dd``; an absent file gives NULLs."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    empty = spark.range(1).select(F.lit(None).cast("string").alias("first_day"), F.lit(None).cast("string").alias("last_day"))
    if not fs.exists(jvm_path):
        return empty
    df = spark.read.option("sep", sep).option("header", True).csv(path).select(F.col(f"`{column}`").alias("__d"))
    d = F.col("__d").try_cast("timestamp_ntz")
    return date_range(df.select(d.alias("__d")), "__d")


def date_range(df: DataFrame, col: str) -> DataFrame:
    """S9 on a frame: first/last date of a stamp column as ``yyyy/MM/dd``."""
    return df.agg(
        F.date_format(F.min(col), "yyyy/MM/dd").alias("first_day"), F.date_format(F.max(col), "yyyy/MM/dd").alias("last_day")
    )


def latest_rows(df: DataFrame, n: int | None = None, ts: str = "ts") -> DataFrame:
    """Newest first, optionally the first ``n`` (planned as TakeOrderedAndProject)."""
    out = df.orderBy(F.col(ts).desc(), *[F.col(c) for c in df.columns if c != ts])
    return out.limit(n) if n else out


def site_rows(df: DataFrame, site_id: int, columns: list[str] | None = None, ts: str = "ts") -> DataFrame:
    """One site's rows in time order; the predicate reaches the Parquet scan."""
    out = df.filter(F.col("site_id") == F.lit(site_id))
    if columns:
        out = out.select(*dict.fromkeys(["site_id", ts, *columns]))
    return out.orderBy(ts)
