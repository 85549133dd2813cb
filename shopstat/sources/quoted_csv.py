"""Quoted CSV in many tasks.

A line break inside quotes makes a record of several lines, so a reader that
starts in the middle of a file can't tell where records begin.  Here it can:

1. One aggregate over the lines counts the quotes of every byte range (a scan
   split): whether their number is odd, and whether any line has an odd number.
2. A running parity over the ranges of a file (one small row per range, on
   the driver) says which ranges begin inside quotes.
3. A second scan passes the lines of each range, in order, through an Arrow
   step that only counts quotes: lines are joined while a quote is open.  The
   first line of a file is its header.
4. Records that cross ranges (known from step 2; usually none) are put
   together from their pieces by one grouping of those pieces alone.
5. Spark's own ``from_csv`` takes the records apart.

Lines end in ``\\n`` or ``\\r\\n``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RECORD = "record string, _key string, _at bigint, _n bigint"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))


def ranges(spark: SparkSession, path: str) -> list[dict]:
    """One entry per range of a file, in order: whether it begins inside
    quotes (``open``), the name of the record that crosses into it (``lead``)
    and of the record that crosses out of it (``tail``), if any."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    found = _lines(spark, path).groupBy("_file", "_start").agg(
        (F.sum(quotes) % 2).alias("odd"), F.max(quotes % 2).alias("turns")).collect()
    out, opened, name, last = [], False, None, None
    for r in sorted(found, key=lambda r: (r["_file"], r["_start"])):
        if r["_file"] != last:
            opened, name, last = False, None, r["_file"]
        entry = {"file": r["_file"], "start": r["_start"], "open": opened, "lead": name if opened else None}
        if r["odd"]:
            opened = not opened
        if not opened:
            name = None
        elif not (entry["open"] and not r["turns"]):     # a record that begins here is still open at the end
            name = f"{r['_file']}@{r['_start']}"
        entry["tail"] = name
        out.append(entry)
    return out


def _join_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (value, range number, open, lead, tail) to records; pieces of
    records that cross ranges carry the record's name."""
    where, inside, held, waiting, header = None, False, [], False, False
    lead = tail = None
    pieces: list[tuple] = []

    def rest() -> list[tuple]:
        # what is still held when a range ends belongs to the record that leaves it
        nonlocal held, waiting
        kept = [("\n".join(held), lead if waiting else tail, where, -1 if header else 0)] if held else []
        held, waiting = [], False
        return kept

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()),
                                           pa.array(columns[3], pa.int64())], names=["record", "_key", "_at", "_n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        if batch.column("_range").null_count:
            raise ValueError("the scan's splits changed between two passes over the files")
        number = batch.column("_range").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            part = batch.slice(a, b - a)
            if number[a] != where:
                pieces += rest()
                where, inside = int(number[a]), part.column("_open")[0].as_py()
                lead, tail = part.column("_lead")[0].as_py(), part.column("_tail")[0].as_py()
                waiting, header = inside, part.column("_first")[0].as_py()
            value = part.column("value")
            odd = (pc.count_substring(value, '"').to_numpy(zero_copy_only=False) & 1).astype(np.int64)
            after = (np.cumsum(odd) + inside) % 2 == 1               # inside quotes behind each line
            before = np.append(inside, after[:-1])
            whole = ~before & ~after
            if header and whole[0]:
                whole[0], header, skip = False, False, 0
            else:
                skip = -1
            rows = []
            for i in np.flatnonzero(~whole).tolist():
                if i == skip:
                    continue
                held.append(value[i].as_py())
                if not after[i]:
                    text = "\n".join(held)
                    if waiting:
                        pieces.append((text, lead, where, 0))
                    elif header:
                        header = False
                    else:
                        rows.append((text, None, None, None))
                    held, waiting = [], False
            inside = bool(after[-1])
            plain = value.filter(pa.array(whole))
            if len(plain):
                none = pa.nulls(len(plain), pa.int64())
                yield pa.RecordBatch.from_arrays([plain, pa.nulls(len(plain), pa.string()), none, none], names=["record", "_key", "_at", "_n"])
            if rows:
                yield batch_of(rows)
        if pieces:
            yield batch_of(pieces)
            pieces = []
    pieces += rest()
    if pieces:
        yield batch_of(pieces)


def records(spark: SparkSession, path: str) -> DataFrame:
    """``record``: the text of every record of the files in ``path`` but their
    headers, line breaks inside quotes kept, in as many tasks as the files
    have splits.  A quote that is never closed makes the rest of its file one
    record, as for any reader."""
    found = ranges(spark, path)
    schema = "_file string, _start bigint, _range bigint, _open boolean, _lead string, _tail string, _first boolean"
    firsts: dict[str, int] = {}
    for i, r in enumerate(found):
        firsts.setdefault(r["file"], i)
    table = spark.createDataFrame([(r["file"], r["start"], i, r["open"], r["lead"], r["tail"], firsts[r["file"]] == i)
                                   for i, r in enumerate(found)], schema)
    # one small row per scan split
    lines = _lines(spark, path).join(F.broadcast(table), ["_file", "_start"], "left")

    def joined(some: DataFrame) -> DataFrame:
        return some.select("value", "_range", "_open", "_lead", "_tail", "_first").mapInArrow(_join_lines, _RECORD)
    out = joined(lines).filter("_key IS NULL").select("record")
    if any(r["tail"] for r in found):
        pieces = joined(lines.filter("_lead IS NOT NULL OR _tail IS NOT NULL")).filter("_key IS NOT NULL")
        crossing = pieces.groupBy("_key").agg(F.min("_n").alias("_least"), F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("_at", "record"))), lambda p: p["record"]), "\n").alias("record"))
        out = out.unionByName(crossing.filter("_least = 0").select("record"))        # -1: a header
    return out.select(F.rtrim("record", F.lit("\r")).alias("record")).filter("record <> ''")
