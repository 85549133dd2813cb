"""Small frames and brute-force forms shared by the tests of this folder."""

from __future__ import annotations

import re

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "labels", "conversations", "embeddings")
DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"

# nulls in any column, empty and long texts, repeated rows, ties
EDGE_TEXTS = [None, "", " \n\t", "one", "one two", "the same text twice over", "the same text twice over",
              "word " * 20_000, "x" * 50_000, "a\nb\na\nb\n\n \n", "é ß 日本 😀 İ", "  nbsp\u0085next"]


def edge_docs(spark):
    rows = [(i, t, "en" if i % 3 else None, "s" if i % 2 else None, None if t is None else len(t)) for i, t in enumerate(EDGE_TEXTS)]
    rows += [(None, "no id here", "en", "s", 1), (5, EDGE_TEXTS[5], "en", "s", 24)]
    return spark.createDataFrame(rows, DOC_SCHEMA)


def clashing(df):
    """The same rows with columns named as operators name theirs."""
    from pyspark.sql import functions as F
    return df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(
        ("n_words", "kept", "base_failed", "ids", "spans", "fp", "root", "_row", "_w", "_text", "_rid", "host", "rule", "metric", "level", "_base", "_id"))])


def duck(sf=SF):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
