"""One query per operator, over whole tables, with production parameters; and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from velora.llm import (
    chat, collocations, conversation_repair, decontaminate, fingerprints, language_id, mixing, piece_tokens, secret_scan, simhash, token_files, toxicity, warc,
)
from velora.llm.common import fresh_folder, table

TOKENIZER = "byte_bpe_50k.json"
PIECE_MODEL = "piece_bpe_32k.model"
MIXTURE = mixing.Mixture(
    weights={
        "domain": {"web": 0.6, "books": 0.4},
        "language": {"en": 0.5, "de": 0.3, "fr": 0.1, "es": 0.1},
        "source": {"src0": 3.0},
    },
    budget_share=0.8,
    max_epochs=2,
)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_report(table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "tokens")
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(TOKENIZER))
    return token_files.read_index(spark, folder)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.build_derivatives(warc.responses_of_pages(table(spark, sf_dir, "pages")))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture_report(table(spark, sf_dir, "documents"), MIXTURE)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_report(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = decontaminate.decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return report.drop("spans", "items")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_report(table(spark, sf_dir, "conversations"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_tokens.piece_report(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_report(table(spark, sf_dir, "conversations"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_language_id, op2_token_files, op3_secret_scan, op4_warc, op5_mixing,
        op6_toxicity, op7_fingerprints, op8_decontamination, op9_simhash, op10_chat,
        op11_sentencepiece, op12_conversation_repair, op13_collocations,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_mixing": mixing.report_sql(MIXTURE),
        "op7_fingerprints": fingerprints.REPORT_SQL,
        "op8_decontamination": decontaminate.REPORT_SQL,
        "op13_collocations": collocations.report_sql(),
    }
