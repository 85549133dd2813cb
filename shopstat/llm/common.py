"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopstat.session import ensure_checkpoint_dir
from shopstat.sources.versions import delete

# The word and white-space classes of the contracts.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

SIEVE_BITS = 1 << 24        # 2 MB
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SCRATCH = "shopstat-scratch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder under the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{SCRATCH}/{uuid.uuid4().hex}/{label}"


def materialise(df: DataFrame, label: str, free: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage (a lost executor costs no recomputation of what lies
    before), evaluates expensive columns once for several readers, and gives
    the planner the written size, so that joins broadcast it only below
    Spark's own limit.  With ``free`` the shuffle files of this write go as
    soon as it is done, not when the driver next collects its garbage.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    if free:
        spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if free:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the scratch tables that ``frames`` read, once nothing else will:
    they must read tables of ``materialise`` only."""
    for df in frames:
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        if any(f"/{SCRATCH}/" not in f for f in folders):
            raise ValueError("only scratch tables can be discarded")
        for folder in folders:
            delete(df.sparkSession, folder)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also when the
    body uses it inside a lambda (which would otherwise repeat it per element)."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """All words of a text as an array; null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def pack(df: DataFrame, name: str = "_row") -> Column:
    """All columns of ``df`` in one struct, so that columns an operator adds
    can't clash with columns the caller brought."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def sieved(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``df`` with ``_maybe``: false only for rows whose ``key`` is surely not
    among ``keys``.

    The keys' hashes set bits of a bitmap of ``SIEVE_BITS``, at most 512 rows
    of 4 kB however many keys there are, which is joined by broadcast.  Wide
    rows (texts) that can't have a partner then stay out of a shuffle join.
    With very many keys the bitmap fills up and more rows are let through,
    which costs time, never rows.
    """
    def bit(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(SIEVE_BITS)) + 1
    bitmap = keys.select(bit(F.col(key)).alias("_b")).groupBy(F.bitmap_bucket_number("_b").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_b")).alias("_bits"))
    byte = F.conv(F.hex(F.expr("substring(_bits, CAST(_place DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    placed = df.withColumns({"_bucket": F.bitmap_bucket_number(bit(F.col(key))), "_place": F.bitmap_bit_position(bit(F.col(key)))})
    found = F.coalesce(F.getbit(byte, (F.col("_place") % 8).cast("int")) == 1, F.lit(False))
    return placed.join(F.broadcast(bitmap), "_bucket", "left").select(*df.columns, found.alias("_maybe"))


def without(df: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` isn't among ``dropped``.  Only rows that
    may be are joined; the others pass as they are."""
    marked = sieved(df, dropped, key)
    passed = marked.filter("NOT _maybe").drop("_maybe")
    return passed.unionByName(marked.filter("_maybe").drop("_maybe").join(dropped.select(key), key, "left_anti").select(*df.columns))
