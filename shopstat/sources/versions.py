"""Tables that are replaced in one step.

``publish`` writes a table as a new version beside the old ones and makes it
the current one by a single last step; ``read_current`` reads the newest
published version.  Whatever stops a replacement, a reader finds the old
rows or the new ones, never none and never a mixture.

* In a folder, ``root/versions/<version>`` holds the rows and an empty file
  ``root/published/<version>`` says that they are whole.  Making an empty
  file is one step on every file system, so no rename is needed.
* In the catalogue, the table's name is a view of a version table, and
  ``CREATE OR REPLACE VIEW`` is one step of the catalogue.  A view keeps the
  bucket layout of the table under it, so joins on the bucket keys need no
  shuffle.

The version before the current one is kept for readers that have begun;
older ones are removed after the replacement.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

KEPT = 2


def _place(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder in order; none where there is no folder."""
    fs, p = _place(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _place(spark, path)
    fs.delete(p, True)


def _mark(spark: SparkSession, path: str) -> None:
    fs, p = _place(spark, path)
    fs.create(p, False).close()


def _next(versions: Sequence[str]) -> str:
    newest = max((int(v.split("_")[0]) for v in versions), default=0)
    return f"{newest + 1:08d}_{uuid.uuid4().hex[:12]}"


def current(spark: SparkSession, root: str) -> str | None:
    """The folder of the newest published version, or None."""
    published = names_in(spark, f"{root}/published")
    return f"{root}/versions/{published[-1]}" if published else None


def read_current(spark: SparkSession, root: str, fmt: str = "parquet") -> DataFrame:
    folder = current(spark, root)
    if folder is None:
        raise ValueError(f"no version of {root} has been published")
    return spark.read.format(fmt).load(folder)


def publish(df: DataFrame, root: str, partition_by: Sequence[str] = (), fmt: str = "parquet") -> str:
    """Make ``df`` the current version of the table in folder ``root``;
    return the version's folder.  The rows may come from an older version."""
    spark = df.sparkSession
    version = _next(names_in(spark, f"{root}/versions"))
    folder = f"{root}/versions/{version}"
    w = df.write.mode("errorifexists").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    try:
        w.save(folder)
    except Exception:
        delete(spark, folder)
        raise
    _mark(spark, f"{root}/published/{version}")
    _forget(spark, root)
    return folder


def _forget(spark: SparkSession, root: str) -> None:
    """Remove what lies before the kept versions: markers first, then rows
    (also those of writes that were given up)."""
    published = names_in(spark, f"{root}/published")
    for version in published[:-KEPT]:
        delete(spark, f"{root}/published/{version}")
    for version in names_in(spark, f"{root}/versions"):
        if version < published[-KEPT:][0]:
            delete(spark, f"{root}/versions/{version}")


def _quoted(name: str) -> str:
    return ".".join(f"`{part}`" for part in name.split("."))


def current_table(spark: SparkSession, name: str) -> str | None:
    """The version table that the view ``name`` reads, or None."""
    if not spark.catalog.tableExists(name):
        return None
    told = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {_quoted(name)}").collect()}
    if told.get("Type") != "VIEW":
        raise ValueError(f"{name} is a table; drop or rename it before publishing versions under its name")
    return ".".join(re.findall(r"`([^`]+)`", told["View Text"]))


def publish_table(df: DataFrame, name: str, bucket_by: Sequence[str], num_buckets: int, root: str | None = None,
                  fmt: str = "parquet") -> str:
    """Make ``df`` the rows of the catalogue name ``name``, bucketed and
    sorted by ``bucket_by``; return the version table.  Rows are dealt out
    by the bucket keys first, so a bucket is one sorted file however many
    tasks there were.  With ``root`` the files lie below that folder."""
    spark, before = df.sparkSession, current_table(df.sparkSession, name)
    database, short = (name.split(".") if "." in name else (spark.catalog.currentDatabase(), name))
    stem = f"{short}__v"
    known = [t.name for t in spark.catalog.listTables(database) if t.name.startswith(stem)]
    version = _next([t[len(stem):] for t in known])
    full = f"{database}.{stem}{version}"
    w = (df.repartition(num_buckets, *bucket_by).write.mode("errorifexists").format(fmt)
         .bucketBy(num_buckets, *bucket_by).sortBy(*bucket_by))
    if root:
        w = w.option("path", f"{root}/{stem}{version}")
    try:
        w.saveAsTable(full)
    except Exception:
        _drop(spark, full, root)
        raise
    spark.sql(f"CREATE OR REPLACE VIEW {_quoted(name)} AS SELECT * FROM {_quoted(full)}")
    for t in known:
        if f"{database}.{t}" != before:
            _drop(spark, f"{database}.{t}", root)
    return full


def _drop(spark: SparkSession, table: str, root: str | None) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {_quoted(table)}")
    if root:
        delete(spark, f"{root}/{table.split('.')[-1]}")
