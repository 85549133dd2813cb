"""Typed sinks: schema conformance and table writes."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def money(c: Column, precision: int = 18, scale: int = 2) -> Column:
    """Number -> DECIMAL(precision, scale), rounding half up.

    A double is first snapped to 9 decimals so that binary noise (123.455
    stored as 123.45499999...) does not decide the rounding.
    """
    return c.cast(T.DecimalType(38, 9)).cast(T.DecimalType(precision, scale))


def conform(df: DataFrame, schema: T.StructType, lenient: bool = False) -> DataFrame:
    """Select the schema's columns in order, cast to the declared types.

    Strict mode uses ``cast`` (ANSI on: a bad value raises); ``lenient``
    uses ``try_cast`` (bad value -> null).  Columns missing from ``df``
    become typed nulls.
    """
    cols = []
    for f in schema.fields:
        if f.name not in df.columns:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        src = F.col(f.name)
        if isinstance(f.dataType, T.DecimalType) and isinstance(df.schema[f.name].dataType,
                                                                 (T.DoubleType, T.FloatType)):
            src = src.cast(T.DecimalType(38, 9))
        cast = src.try_cast(f.dataType) if lenient else src.cast(f.dataType)
        cols.append(cast.alias(f.name))
    return df.select(*cols)


def write_table(df: DataFrame, path: str | None = None, table: str | None = None,
                fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] = (), bucket_by: Sequence[str] = (),
                num_buckets: int = 64, sort_by: Sequence[str] = ()) -> None:
    """Write a table.  Overwriting writes the new rows beside the old ones
    first and changes places only when that has succeeded, so a failing write
    leaves the old table as it was (and the new rows may come from the old
    ones).  ``bucket_by``/``sort_by`` lay the table out for joins and lookups
    on a key (needs a catalog table name)."""
    spark = df.sparkSession
    if mode == "overwrite" and not table:
        _replace_folder(df, path, fmt, partition_by)
        return
    if mode == "overwrite" and spark.catalog.tableExists(table):
        new, fresh = f"{table}__{uuid.uuid4().hex[:12]}", None if path is None else f"{path}__{uuid.uuid4().hex[:12]}"
        try:
            write_table(df, fresh, new, fmt, "errorifexists", partition_by, bucket_by, num_buckets, sort_by)
        except Exception:
            spark.sql(f"DROP TABLE IF EXISTS {new}")
            raise
        spark.sql(f"DROP TABLE {table}")
        spark.sql(f"ALTER TABLE {new} RENAME TO {table.split('.')[-1]}")
        return
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if bucket_by:
        if not table:
            raise ValueError("bucketing needs a catalog table name")
        w = w.bucketBy(num_buckets, *bucket_by)
        if sort_by:
            w = w.sortBy(*sort_by)
    if table:
        if path:
            w = w.option("path", path)
        w.saveAsTable(table)
    else:
        w.save(path)


def _replace_folder(df: DataFrame, path: str, fmt: str, partition_by: Sequence[str]) -> None:
    """Write to a new folder next to ``path``, then rename: old out, new in."""
    spark, mark = df.sparkSession, uuid.uuid4().hex[:12]
    new, old = f"{path.rstrip('/')}__new-{mark}", f"{path.rstrip('/')}__old-{mark}"
    paths = {k: spark._jvm.org.apache.hadoop.fs.Path(k) for k in (path, new, old)}
    fs = paths[path].getFileSystem(spark._jsc.hadoopConfiguration())
    w = df.write.mode("errorifexists").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    try:
        w.save(new)
    except Exception:
        fs.delete(paths[new], True)
        raise
    if fs.exists(paths[path]) and not fs.rename(paths[path], paths[old]):
        raise OSError(f"{path} could not be put aside")
    if not fs.rename(paths[new], paths[path]):
        raise OSError(f"{new} could not be renamed to {path}")
    fs.delete(paths[old], True)


def write_jdbc(df: DataFrame, url: str, table: str, batch_size: int = 10_000, mode: str = "overwrite",
               properties: dict[str, str] | None = None, num_connections: int | None = None,
               truncate: bool = True) -> None:
    """Replace a database table through JDBC, inserting in batches.

    Each task writes its partition in one transaction with ``batch_size``
    rows per round trip; ``num_connections`` caps concurrent writers (the
    rows are repartitioned, so the plan before keeps its tasks).  With ``truncate`` an existing table keeps its
    definition (and keys/indexes) and only its rows are replaced.
    """
    out = df.repartition(num_connections) if num_connections else df
    w = (out.write.format("jdbc").mode(mode).option("url", url).option("dbtable", table)
         .option("batchsize", str(batch_size)).option("truncate", str(truncate).lower()))
    for k, v in (properties or {}).items():
        w = w.option(k, v)
    w.save()


def tables_exist(spark: SparkSession, names: Sequence[str]) -> dict[str, bool]:
    return {n: spark.catalog.tableExists(n) for n in names}


def require_tables(spark: SparkSession, paths: dict[str, str]) -> None:
    """Raise unless every written table can be read and has columns."""
    for name, path in paths.items():
        try:
            columns = spark.read.parquet(path).columns
        except Exception as e:
            raise ValueError(f"{name} is missing at {path}") from e
        if not columns:
            raise ValueError(f"{name} at {path} has no columns")
