"""Training-data pipeline over `documents`: five stages, each one operator of velora.llm.

A stage takes (spark, docs, sf_dir) and returns a frame; it is written as
Parquet into the shared folder and read back as the next one's ``docs``. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from velora.llm import decontaminate, mixing, simhash, token_files, toxicity
from velora.llm.common import fresh_folder, stored, table

#: The pipeline reads every kept document at most once; the budget is a share of the tokens that come in.
MIXTURE = mixing.Mixture(
    weights={"domain": {"web": 0.5, "books": 0.5}, "language": {"en": 0.5, "de": 0.25, "fr": 0.25, "es": 0.25}},
    budget_share=0.9,
    max_epochs=1,
    seed="pipeline-1",
)
TOKENIZER = "byte_bpe_50k.json"


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, the one with the smallest id."""
    return simhash.drop_near_copies(docs)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark windows in a twentieth of their words or more go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each leaf of the domain-language-source tree gives a prefix of its seeded order."""
    return mixing.mix(docs, MIXTURE, epoch=None)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, and their index: doc_id, start, n_tokens, ids_crc32."""
    folder = fresh_folder(spark, "pipeline-tokens")
    token_files.write_token_files(docs, folder, public_tokenizers.path(TOKENIZER))
    return token_files.read_index(spark, folder)


STAGES = [
    ("toxicity", toxic),
    ("near duplicates", near_copies),
    ("decontamination", contaminated),
    ("mixing", mixed),
    ("token files", tokens),
]

#: SQL can't express the regression, XXH64 or the tokenizer; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
