"""The registered queries: each applies one operator, with its production
parameters, to its whole table.  Oracle SQL where DuckDB can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shopstat.llm import bpe, chat_format, collocations, decontaminate, license_scan, packing, passages, pii, quality_rules, simhash, url_filter, warc, whitening
from shopstat.llm.common import table
from shopstat.llm.oracle import ORACLE

Query = Callable[[SparkSession, str], DataFrame]

VOCABULARY = "byte_bpe_50k.tiktoken"
WORD_VOCABULARY, END_ID = "word_bpe_49k.json", 2
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"

# The contract's url rules (host, path, verdict).
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality_rules.quality_rules(docs, keep=["doc_id"]).select(
        "_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def _chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # the contract's conversation -1, made of control strings
    extra = spark.createDataFrame([(-1, i, role, CONTROL_TEXT) for i, role in enumerate(("user", "assistant"))], turns.schema)
    return chat_format.report(turns.unionByName(extra), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def _simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(spark, table(spark, sf_dir, "pages"))


def _pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def _bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.report(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def _licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, url_filter.RULE_SCHEMA)
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select(
        "page_id", "host", "path", "rule", "verdict")


def _whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(table(spark, sf_dir, "embeddings"))


def _collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def _packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY), END_ID)


def build_queries() -> dict[str, Query]:
    return {
        "op1_quality_rules": _quality,
        "op2_repeated_passages": _passages,
        "op3_chat_windows": _chat,
        "op4_simhash": _simhash,
        "op5_pii": _pii,
        "op6_bpe": _bpe,
        "op7_license_scan": _licenses,
        "op8_decontaminate": _leaks,
        "op9_warc": _warc,
        "op10_url_filter": _urls,
        "op11_whitening": _whitening,
        "op12_collocations": _collocations,
        "op13_packing": _packing,
    }


def build_oracle() -> dict[str, str]:
    return ORACLE
