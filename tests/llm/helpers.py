"""Small frames shared by the operator tests."""

from pyspark.sql import types as T

DOCS = (
    T.StructType()
    .add("doc_id", T.LongType())
    .add("text", T.StringType())
    .add("lang", T.StringType())
    .add("source", T.StringType())
    .add("n_chars", T.LongType())
)


def docs(spark, rows, extra=()):
    """A frame like `documents` from (doc_id, text[, lang[, source]]); ``extra`` names additional text columns."""
    full = []
    for r in rows:
        doc_id, text, lang, source = (*r, *(None,) * (4 - len(r)))
        full.append((doc_id, text, lang, source, None if text is None else len(text)))
    df = spark.createDataFrame(full, DOCS)
    for name in extra:
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit("x"))
    return df


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()
