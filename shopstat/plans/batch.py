"""Ordered build of the shop's tables, one write job per table.

Stages run in order; each publishes its table as a version (``sources.
versions``) and later stages read the written tables back, which also cuts
the lineage (an executor lost later never forces recomputation from the raw
inputs).  The key contracts are checked on the written tables before the
marts are built from them.  A failing stage stops the build with the stage
name in the error.

A build that is started again skips what is finished: each stage leaves a
manifest with a fingerprint of its inputs (names, sizes and times of the
files it reads, or the versions of the tables, and the package's own code),
the version written and its row count.  A stage runs when its fingerprint
or its table has changed.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shopstat.operators import marts, nested, quality, sessions
from shopstat.operators.ranking import sequence_number
from shopstat.plans.metrics import Roles
from shopstat.sources import versions
from shopstat.sources.sinks import conform, require_tables

# Table names of the build.
TABLES = {
    "transactions": "rd_transactions",
    "transactions_prods": "rd_transactions_prods",
    "events_add_to_cart": "rd_events_add_to_cart",
    "products": "rd_prods",
    "customers": "rd_customers",
    "sessions": "rd_sessions",
}
# Key columns of each table; text keys have at most 36 characters.
KEYS = {
    "rd_transactions": ["booking_id"],
    "rd_transactions_prods": ["id"],
    "rd_events_add_to_cart": ["event_id"],
    "rd_prods": ["prod_id"],
    "rd_customers": ["customer_id"],
    "rd_sessions": ["session_id", "traffic_source"],
}
# Which columns the tables are joined on; transactions meet lines on the
# booking and sessions on the session, so they have a second layout.
JOIN_KEYS = {
    "rd_transactions": ["booking_id"],
    "rd_transactions_prods": ["booking_id"],
    "rd_sessions": ["session_id"],
    "transactions_by_session": ["session_id"],
}
CODE = ("functions", "operators", "plans", "sources")


class StageError(RuntimeError):
    pass


@dataclass(frozen=True)
class Manifest:
    """What a finished stage has written."""

    stage: str
    table: str
    fingerprint: str
    version: str
    rows: int


def _lines(source) -> DataFrame:
    """Product lines with declared types and a dense line id."""
    lines = conform(nested.booking_lines(source.tx_raw_with_lines, strict=True, keep_empty=True), source.lines_schema)
    return sequence_number(lines, [], lines.columns, "id")


def _code_digest() -> str:
    package, h = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), hashlib.sha256()
    for part in CODE:
        for name in sorted(os.listdir(os.path.join(package, part))):
            if name.endswith(".py"):
                with open(os.path.join(package, part, name), "rb") as f:
                    h.update(name.encode() + b"\0" + f.read())
    return h.hexdigest()


def _files(spark: SparkSession, path: str) -> list[str]:
    """Name, size and time of every file at or below a path (listed only)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return [f"{path} is missing"]
    out, found = [], fs.listFiles(p, True)
    while found.hasNext():
        f = found.next()
        out.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return sorted(out)


def fingerprint(*parts) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


class _Build:
    """The tables and manifests of one output folder."""

    def __init__(self, spark: SparkSession, out_dir: str, database: str | None, buckets: int):
        self.spark, self.out_dir, self.database, self.buckets = spark, out_dir.rstrip("/"), database, buckets
        self.code, self.done = _code_digest(), {}

    def _bucketed(self, table: str) -> bool:
        return self.database is not None and table in JOIN_KEYS

    def where(self, table: str) -> str:
        return f"{self.database}.{table}" if self._bucketed(table) else f"{self.out_dir}/{table}"

    def read(self, table: str) -> DataFrame:
        if self._bucketed(table):
            return self.spark.table(self.where(table))
        return self.spark.read.parquet(self.done[table].version)

    def _current(self, table: str) -> str | None:
        if self._bucketed(table):
            return versions.current_table(self.spark, self.where(table))
        return versions.current(self.spark, self.where(table))

    def _manifest_path(self, table: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.out_dir}/manifest/{table}.json")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _finished(self, stage: str, table: str, mark: str) -> Manifest | None:
        """The manifest of a stage that needn't run again.  One that can't
        be read (its writing was interrupted) counts as none."""
        fs, p = self._manifest_path(table)
        if not fs.exists(p):
            return None
        try:
            stream = fs.open(p)
            m = Manifest(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            stream.close()
        except (Py4JJavaError, TypeError, ValueError):
            return None
        return m if (m.stage, m.fingerprint) == (stage, mark) and m.version == self._current(table) else None

    def _note(self, m: Manifest) -> None:
        fs, p = self._manifest_path(m.table)
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(asdict(m)).encode()))
        out.close()

    def run(self, stage: str, table: str, inputs, make: Callable[[], DataFrame]) -> None:
        mark = fingerprint(stage, table, inputs, self.code, self.buckets if self._bucketed(table) else 0)
        m = self._finished(stage, table, mark)
        if m is None:
            try:
                seen = Observation(f"rows of {table}")
                df = make().observe(seen, F.count(F.lit(1)).alias("rows"))
                if self._bucketed(table):
                    version = versions.publish_table(df, self.where(table), JOIN_KEYS[table], self.buckets, self.out_dir)
                else:
                    version = versions.publish(df, self.where(table))
                m = Manifest(stage, table, mark, version, seen.get["rows"])
                self._note(m)
            except Exception as e:  # noqa: BLE001
                raise StageError(f"stage {stage} ({table}) failed: {e}") from e
        self.done[table] = m

    def versions_of(self, *tables: str) -> list[str]:
        return [self.done[t].version for t in tables]

    def check_keys(self) -> None:
        """Check the key contracts of tables whose present version hasn't
        passed yet; a check that passed leaves a marker."""
        for table, keys in KEYS.items():
            name = f"{table}-{fingerprint(self.done[table].version, keys)[:16]}"
            if name not in versions.names_in(self.spark, f"{self.out_dir}/manifest/keys"):
                quality.assert_keys(self.read(table), keys, table)
                versions._mark(self.spark, f"{self.out_dir}/manifest/keys/{name}")


def build_tables(spark: SparkSession, source, out_dir: str, check_keys: bool = True, database: str | None = None,
                 buckets: int = 64) -> dict[str, str]:
    """Write every table and both marts; return name -> folder of the
    current version.

    ``source`` is a ``Roles`` or ``ShopFiles`` object, or the path of a
    driver data folder.  With a catalogue ``database``, the tables of
    ``JOIN_KEYS`` are catalogue tables in ``buckets`` sorted buckets by those
    keys (and the name returned is theirs), so joining them on written tables
    needs no shuffle.  Choose ``buckets`` for about 256 MB each.
    """
    if isinstance(source, str):
        source = Roles(spark, source)
    events, b = source.events, _Build(spark, out_dir, database, buckets)
    stages: dict[str, Callable[[], DataFrame]] = {
        "transactions": lambda: source.tx,
        "transactions_prods": lambda: _lines(source),
        "events_add_to_cart": lambda: source.cart_events,
        "products": lambda: source.products,
        "customers": lambda: source.customers,
        "sessions": lambda: source.sessions,
    }
    for stage, make in stages.items():
        files = [_files(spark, p) for p in source.stage_inputs(stage)]
        b.run(stage, TABLES[stage], [files, source.options], make)
    if check_keys:
        b.check_keys()
    if database is not None:
        by_session = "transactions_by_session"
        b.run(by_session, by_session, b.versions_of("rd_transactions"),
              lambda: b.read("rd_transactions").filter("session_id IS NOT NULL"))

    def dm_transactions() -> DataFrame:
        lines = b.read("rd_transactions_prods").filter("product_id IS NOT NULL")
        summary = marts.booking_product_summary(lines, b.read("rd_prods"))
        return marts.dm_transactions(b.read("rd_transactions"), b.read("rd_customers"), summary)

    b.run("dm_transactions", "dm_transactions",
          b.versions_of("rd_transactions", "rd_transactions_prods", "rd_prods", "rd_customers"), dm_transactions)
    b.run("dm_sessions", "dm_sessions", [b.versions_of("rd_sessions"), events.counted, events.markers],
          lambda: sessions.session_flags(b.read("rd_sessions"), events.counted, events.markers))
    folders = {t: m.version for t, m in b.done.items() if not b._bucketed(t)}
    require_tables(spark, folders)
    return {t: folders.get(t, b.where(t)) for t in b.done}


def register_views(spark: SparkSession, paths: dict[str, str]) -> list[str]:
    """Expose every written table as a temporary view of the same name."""
    for name, p in paths.items():
        (spark.read.parquet(p) if "/" in p else spark.table(p)).createOrReplaceTempView(name)
    return [n for n in paths if spark.catalog.tableExists(n)]
