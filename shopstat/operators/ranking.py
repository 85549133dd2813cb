"""Sequence numbers without putting a whole group in one task.

``row_number() OVER (PARTITION BY p ORDER BY o)`` hash-partitions on ``p``,
so a key holding a third of the rows is numbered by a single task, and a
global numbering (no ``p``) runs entirely in one task.  Here the rows are
instead range-partitioned on ``(p, o)``: Spark samples split points, so a
hot key is spread over many partitions.  Each partition numbers its rows
locally (Arrow batches through ``mapInArrow``), reports how its last key
ends, and a table with one row per partition (see
``session.cluster_conf`` for how many there are) turns those into offsets
for keys that continue from earlier partitions.

The order columns should make the order total; among exact ties numbers are
assigned in an arbitrary but consistent way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopstat.session import ensure_checkpoint_dir

_KIND = "_sq_kind"       # 0 = data row, 1 = partition summary row
_PID = "_sq_pid"
_LOCAL = "_sq_local"
_TAIL = "_sq_tail"


def _same_as_previous(rb: pa.RecordBatch, part_cols: list[str]) -> np.ndarray:
    """Null-safe "row key equals the previous row's key" per row, compared
    exactly in Arrow (no float conversion of large integer keys)."""
    n = rb.num_rows
    same = np.ones(n, dtype=bool)
    for c in part_cols:
        col = rb.column(c)
        prev = pa.concat_arrays([pa.nulls(1, col.type), col.slice(0, n - 1)])
        eq = pc.fill_null(pc.equal(col, prev), False)
        if pa.types.is_floating(col.type):          # all NaN are one key, as in a window
            eq = pc.or_(eq, pc.and_(pc.fill_null(pc.is_nan(col), False), pc.fill_null(pc.is_nan(prev), False)))
        both_null = pc.and_(pc.is_null(col), pc.is_null(prev))
        same &= pc.or_(eq, both_null).to_numpy(zero_copy_only=False)
    return same


def _key_of(rb: pa.RecordBatch, part_cols: list[str], i: int) -> tuple:
    return tuple(rb.column(c)[i] for c in part_cols)


def _key_equal(a: tuple, b: tuple) -> bool:
    def same(x, y) -> bool:
        if not (x.is_valid and y.is_valid):
            return x.is_valid == y.is_valid
        u, v = x.as_py(), y.as_py()
        return u == v or (u != u and v != v)        # NaN equals NaN, as in a window
    return all(same(x, y) for x, y in zip(a, b))


def _number_partitions(part_cols: list[str]):
    """Per partition: local row numbers per key run, plus one summary row.

    Works on Arrow record batches; only the key columns are read, every
    other column passes through untouched.
    """
    extra = [_KIND, _PID, _LOCAL, _TAIL]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        carry_key, carry_n = None, 0
        last = None
        for rb in batches:
            n = rb.num_rows
            if n == 0:
                continue
            same = _same_as_previous(rb, part_cols)
            same[0] = carry_key is not None and _key_equal(_key_of(rb, part_cols, 0), carry_key)
            gid = np.cumsum(~same)
            # position within the run: index minus the index where the run starts
            starts = np.flatnonzero(~same)
            idx = np.arange(n)
            run_start = np.zeros(n, dtype=np.int64)
            if len(starts):
                run_start = starts[np.maximum(np.searchsorted(starts, idx, side="right") - 1, 0)]
                run_start = np.where(idx < starts[0], 0, run_start)
            local = (idx - run_start + 1).astype(np.int64)
            if same[0]:
                local[gid == 0] += carry_n
            carry_key = _key_of(rb, part_cols, n - 1)
            carry_n = int(local[-1])
            last = rb.slice(n - 1, 1)
            yield pa.RecordBatch.from_arrays(
                list(rb.columns) + [pa.array(np.zeros(n, dtype=np.int32)), pa.array(np.full(n, pid, dtype=np.int32)),
                                    pa.array(local), pa.nulls(n, pa.int64())],
                names=list(rb.schema.names) + extra)
        if last is not None:
            # one summary row per partition: its last key and how many rows
            # of that key the partition holds; other columns null
            cols = [last.column(i) if f.name in part_cols else pa.nulls(1, f.type)
                    for i, f in enumerate(last.schema)]
            yield pa.RecordBatch.from_arrays(
                cols + [pa.array([1], pa.int32()), pa.array([pid], pa.int32()), pa.array([0], pa.int64()),
                        pa.array([carry_n], pa.int64())],
                names=list(last.schema.names) + extra)
    return run


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df``.  The write re-runs the cheap Arrow
    numbering over the same shuffle output (same split points), which
    measured faster than caching the rows first."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sequence_number(df: DataFrame, partition_cols: Sequence[str], order_cols: Sequence[Column | str],
                    out_col: str = "row_number", num_partitions: int | None = None) -> DataFrame:
    """Add ``out_col`` = 1-based row number within ``partition_cols`` by ``order_cols``.

    Equivalent to ``row_number().over(Window.partitionBy(*p).orderBy(*o))``
    but balanced across tasks however the keys are skewed.  With no
    ``partition_cols`` it numbers the whole table (dense ids from 1).
    """
    part_cols = list(partition_cols)
    order = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    sort_keys = [F.col(c) for c in part_cols] + order
    # An explicit partition count keeps AQE from coalescing these partitions,
    # so both consumers below see the same partition ids.
    n_parts = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n_parts, *sort_keys).sortWithinPartitions(*sort_keys)

    out_schema = T.StructType(
        [T.StructField(f.name, f.dataType, True) for f in df.schema.fields]
        + [T.StructField(_KIND, T.IntegerType()), T.StructField(_PID, T.IntegerType()),
           T.StructField(_LOCAL, T.LongType()), T.StructField(_TAIL, T.LongType())]
    )
    # Both consumers below (data rows and partition summaries) must read one
    # materialisation: two independent range exchanges would sample their
    # split points separately.  A reliable checkpoint in the shared
    # checkpoint folder fixes the numbered rows (and survives executor loss)
    # whatever happens to the cache later.
    mapped = checkpointed(ranged.mapInArrow(_number_partitions(part_cols), out_schema))

    # Offsets, computed on one row per partition.
    summary = mapped.filter(F.col(_KIND) == 1).select(
        F.col(_PID).alias("_o_pid"), *[F.col(c).alias(f"_o_{c}") for c in part_cols], F.col(_TAIL)
    )
    by_key = Window.partitionBy(*[f"_o_{c}" for c in part_cols]).orderBy("_o_pid")
    by_pid = Window.orderBy("_o_pid")
    offsets = summary.select(
        F.lead("_o_pid").over(by_pid).alias("_o_next_pid"),
        *[f"_o_{c}" for c in part_cols],
        F.sum(_TAIL).over(by_key.rowsBetween(Window.unboundedPreceding, 0)).alias("_o_offset"),
    ).filter(F.col("_o_next_pid").isNotNull())

    data = mapped.filter(F.col(_KIND) == 0)
    cond = F.col(_PID) == F.col("_o_next_pid")
    for c in part_cols:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    # ``offsets`` has at most one row per range partition: safe to broadcast.
    joined = data.join(F.broadcast(offsets), cond, "left")
    numbered = joined.withColumn(out_col, F.col(_LOCAL) + F.coalesce(F.col("_o_offset"), F.lit(0)))
    return numbered.select(*df.columns, out_col)


# -- exact quantiles --------------------------------------------------------
LOG_STEPS = 15              # buckets per doubling in the first pass
CELLS = 1 << 13             # buckets of all intervals together in the passes after it
EXACT_ROWS = 1 << 16        # so many rows or fewer are counted by value


def not_missing(df: DataFrame, col: str) -> Column:
    """Neither null nor NaN: what summaries take for a value."""
    c = F.col(f"`{col}`")
    floating = isinstance(df.schema[col].dataType, (T.DoubleType, T.FloatType))
    return c.isNotNull() & ~F.isnan(c) if floating else c.isNotNull()


def sql_double(x: float | None) -> str:
    """A double as SQL text, exactly."""
    return "CAST(NULL AS DOUBLE)" if x is None else f"CAST('{float(x)!r}' AS DOUBLE)"


def _log_bucket(x: Column) -> Column:
    """A bucket number that never falls as ``x`` rises, fine enough for
    numbers of any size; infinities have their own."""
    size = F.floor((F.log2(F.abs(x)) + 1080) * LOG_STEPS) + 1
    size = F.when(F.abs(x) == float("inf"), F.lit(1 << 20)).when(x == 0, F.lit(0)).otherwise(size)
    return (F.when(x < 0, -size).otherwise(size)).cast("int")


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, dict[float, float]]:
    """Exact quantiles with linear interpolation of several numeric columns;
    nulls and NaN are skipped, a column without values has none.

    Selection by counting, without sorting: one pass counts the rows of each
    logarithmic bucket (with its smallest and largest value), and only the
    buckets that hold a wanted position are looked at again, each pass cutting
    them into ``CELLS`` equal parts, until a part holds one value or so few
    rows that they are counted by value.  Every pass is one aggregate of one
    scan, reduced in the tasks; at most the buckets (some 60,000 a column
    where values of all magnitudes occur, else some hundred) are shuffled and
    fetched, whatever the number of rows.
    """
    probs = [float(q) for q in probs]

    # all columns' values in one scan: (number of the column, value)
    if len(cols) == 1:
        values = df.filter(not_missing(df, cols[0])).select(F.lit(0).alias("_s"), F.col(f"`{cols[0]}`").cast("double").alias("_x"))
    else:
        values = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("_s"), F.when(not_missing(df, c), F.col(f"`{c}`").cast("double")).alias("_x"))
                                              for i, c in enumerate(cols)]))).filter("_x IS NOT NULL")

    def counted(found: DataFrame, of: str, part: str) -> dict[int, tuple]:
        """Per ``of``: smallest and largest value and row count of each ``part``."""
        rows = found.groupBy(of, part).agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.count(F.lit(1)).alias("n")).toArrow()
        key, lo, hi, n = (rows.column(c).to_numpy() for c in (of, "lo", "hi", "n"))
        return {int(k): (lo[key == k], hi[key == k], n[key == k]) for k in np.unique(key)}

    def sort_out(i: int, parts: tuple, before: int) -> None:
        """Which of the parts of a stretch after ``before`` rows hold a wanted position."""
        order = np.argsort(parts[0], kind="stable")
        lo, hi, n = (p[order] for p in parts)
        ends = before + np.cumsum(n)
        places = np.array(sorted({p for q in probs for p in (math.floor((total[i] - 1) * q), math.ceil((total[i] - 1) * q)) if before <= p < ends[-1]}))
        for k in np.unique(np.searchsorted(ends, places, side="right")):
            cell = (float(lo[k]), float(hi[k]), int(n[k]), int(ends[k] - n[k]))
            (done[i] if cell[0] == cell[1] else open_cells).append(cell if cell[0] == cell[1] else (i, *cell))

    first = counted(values.withColumn("_b", _log_bucket(F.col("_x"))), "_s", "_b")
    total = {i: int(first[i][2].sum()) if i in first else 0 for i in range(len(cols))}
    done: dict[int, list] = {i: [] for i in range(len(cols))}
    open_cells: list = []
    for i, parts in first.items():
        sort_out(i, parts, 0)
    while open_cells:
        cells, open_cells = open_cells, []
        few, steps = sum(c[3] for c in cells) <= EXACT_ROWS, max(2, CELLS // len(cells))
        whens = []
        for k, (i, lo, hi, *_rest) in enumerate(cells):
            # halves first: the width of an interval may exceed the largest double
            half = hi / 2 - lo / 2
            share = f"(_x / 2 - {sql_double(lo / 2)}) / {sql_double(half)}" if half > 0 else f"if(_x > {sql_double(lo)}, 1D, 0D)"
            part = "_x" if few else f"CAST(least(floor({share} * {steps}), {steps - 1}) AS DOUBLE)"
            whens.append(f"WHEN _s = {i} AND _x >= {sql_double(lo)} AND _x <= {sql_double(hi)} THEN named_struct('_c', {k}, '_p', {part})")
        place = F.expr(f"CASE {' '.join(whens)} END")
        found = counted(values.select("_x", place.alias("_at")).filter("_at IS NOT NULL").select("_x", "_at._c", "_at._p"), "_c", "_p")
        for k, parts in found.items():
            sort_out(cells[k][0], parts, cells[k][4])

    def value(i: int, q: float) -> float:
        h = (total[i] - 1) * q
        low, high = (next(c[0] for c in done[i] if c[3] <= p < c[3] + c[2]) for p in (math.floor(h), math.ceil(h)))
        return low if low == high else low + (h - math.floor(h)) * (high - low)
    return {c: {q: value(i, q) for q in probs} if total[i] else {} for i, c in enumerate(cols)}


def value_partitions(df: DataFrame, value_col: str, groups: Sequence[str] = (),
                     num_partitions: int | None = None) -> DataFrame:
    """``(*groups, _v, _c, _part)``: every distinct value with its count,
    range-partitioned in value order and checkpointed with the partition number.

    Counting first (map-side) leaves one row per distinct value, so a value
    that a third of all rows share is one row here and can't fill a range
    partition.
    """
    groups = list(groups)
    counts = (df.filter(not_missing(df, value_col)).select(*groups, F.col(f"`{value_col}`").cast("double").alias("_v"))
              .groupBy(*groups, "_v").agg(F.count(F.lit(1)).alias("_c")))
    n_parts = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(counts.repartitionByRange(n_parts, *groups, "_v").withColumn("_part", F.spark_partition_id()))


def exact_quantiles(df: DataFrame, value_col: str, probs: Sequence[float],
                    group_cols: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation between order statistics.

    Rows ``(*group_cols, q, value)``; nulls and NaN are skipped.  Without
    groups they are selected by counting (``column_quantiles``).  With groups,
    of which there may be many, the distinct values lie in range partitions;
    each partition's total says which partitions hold the wanted positions,
    and only those are accumulated, instead of a value->count map per group
    in one final task.
    """
    groups = list(group_cols)
    if not groups:
        found = column_quantiles(df, [value_col], probs)[value_col]
        return df.sparkSession.createDataFrame([(float(q), found[float(q)]) for q in probs if found], "q double, value double")
    placed = value_partitions(df, value_col, groups)
    by_group = Window.partitionBy(*groups)
    parts = placed.groupBy("_part", *groups).agg(F.sum("_c").alias("_pc")).select(
        F.col("_part").alias("_wp"), *[F.col(g).alias(f"_w_{g}") for g in groups], "_pc",
        (F.sum("_pc").over(by_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_pc")).alias("_before"),
        F.sum("_pc").over(by_group).alias("_n"))
    h = [(F.col("_n") - 1) * F.lit(float(q)) for q in probs]
    wanted = F.array(*[F.struct(F.lit(float(q)).alias("q"), hq.alias("h"), (F.floor(hq) + 1).alias("lo"), (F.ceil(hq) + 1).alias("hi"))
                       for q, hq in zip(probs, h)])

    def between(p: Column, low: Column, high: Column) -> Column:
        return (p > low) & (p <= high)
    here = F.filter(wanted, lambda w: between(w["lo"], F.col("_before"), F.col("_before") + F.col("_pc"))
                    | between(w["hi"], F.col("_before"), F.col("_before") + F.col("_pc")))
    needed = parts.select("_wp", *[f"_w_{g}" for g in groups], "_before", here.alias("_w")).filter(F.size("_w") > 0)
    cond = F.col("_part") == F.col("_wp")
    for g in groups:
        cond = cond & F.col(g).eqNullSafe(F.col(f"_w_{g}"))
    inside = Window.partitionBy("_part", *groups).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    running = placed.join(needed, cond).withColumn("_upto", F.col("_before") + F.sum("_c").over(inside))

    def holds(p: Column) -> Column:
        return between(p, F.col("_upto") - F.col("_c"), F.col("_upto"))
    hits = running.select(*groups, "_v", "_c", "_upto", F.explode(F.filter("_w", lambda w: holds(w["lo"]) | holds(w["hi"]))).alias("w"))
    per_q = hits.groupBy(*groups, "w.q").agg(
        F.first("w.h").alias("h"),
        F.max(F.when(holds(F.col("w.lo")), F.col("_v"))).alias("v_lo"),
        F.max(F.when(holds(F.col("w.hi")), F.col("_v"))).alias("v_hi"),
    )
    return per_q.select(
        *groups, "q",
        (F.col("v_lo") + (F.col("h") - F.floor("h")) * (F.col("v_hi") - F.col("v_lo"))).alias("value"),
    )
