"""Profiling: column inventory, summaries, quantiles, box statistics,
outliers, histograms, frequency tables, daily trends, head/tail, samples."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopstat.operators.ranking import column_quantiles, exact_quantiles, not_missing, sql_double

# Quantile levels of the order-value report.
REPORT_QUANTILES = [0, 0.01, 0.05, 0.25, 0.50, 0.75, 0.90, 0.95, 0.97, 0.99, 0.995, 0.997, 0.999, 1]


def column_profile(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False,
                   distinct_of: Sequence[str] | None = None) -> DataFrame:
    """Per column: type, non-null count, null count, exact distinct count.

    Types, nulls and non-nulls are one aggregate row without a shuffle of
    values; each distinct count is an aggregate of its own column in its own
    type, reduced map-side, reading that column only.  ``approx`` uses
    HyperLogLog sketches in the one aggregate instead (no shuffle of values).
    ``distinct_of`` names the columns to count distinct values of (all by
    default; the others show null).
    """
    cols = list(cols or df.columns)
    wanted = set(cols if distinct_of is None else distinct_of)

    def rows(i: int, c: str) -> Column:
        d = F.col(f"_d{i}") if approx and c in wanted else F.lit(None).cast("bigint")
        return F.struct(F.lit(c).alias("column_name"), F.lit(df.schema[c].dataType.simpleString()).alias("data_type"),
                        F.col(f"_v{i}").alias("non_null"), (F.col("_n") - F.col(f"_v{i}")).alias("nulls"), d.alias("_approx"))

    aggs = [F.count(F.lit(1)).alias("_n")] + [F.count(c).alias(f"_v{i}") for i, c in enumerate(cols)]
    if approx:
        aggs += [F.approx_count_distinct(c).alias(f"_d{i}") for i, c in enumerate(cols) if c in wanted]
    table = df.agg(*aggs).select(F.explode(F.array(*[rows(i, c) for i, c in enumerate(cols)])).alias("r")).select("r.*")
    if approx or not wanted:
        return table.withColumnRenamed("_approx", "distinct_values")
    exact = reduce(DataFrame.unionByName, [
        df.groupBy(c).agg(F.lit(1).alias("_one")).agg(F.lit(c).alias("column_name"), F.count(c).alias("distinct_values"))
        for c in cols if c in wanted])
    return table.drop("_approx").join(F.broadcast(exact), "column_name", "left")


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, std, min, exact quartiles, max per numeric column; nulls
    and NaN don't count.  A column without values has a row of nulls."""
    def number(c: str) -> Column:
        return F.when(not_missing(df, c), F.col(f"`{c}`").cast("double"))
    stats = {"count": "count", "mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
    numbers = df.select(*[number(c).alias(f"_{i}") for i, c in enumerate(cols)])
    one = numbers.selectExpr(*[f"{f}(_{i}) AS _{i}_{name}" for i in range(len(cols)) for name, f in stats.items()])
    quartiles = column_quantiles(df, cols, [0.25, 0.5, 0.75])

    def row(i: int, c: str) -> str:
        p25, p50, p75 = (sql_double(quartiles[c].get(q)) for q in (0.25, 0.5, 0.75))
        return f"{i}, _{i}_count, _{i}_mean, _{i}_std, _{i}_min, {p25}, {p50}, {p75}, _{i}_max"
    rows = one.selectExpr(f"stack({len(cols)}, {', '.join(row(i, c) for i, c in enumerate(cols))}) AS (i, count, mean, std, min, p25, p50, p75, max)")
    names = F.array(*[F.lit(c) for c in cols])
    return rows.select(names[F.col("i")].alias("column_name"), "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def quantile_table(df: DataFrame, col: str, probs: Sequence[float] = REPORT_QUANTILES,
                   approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """Quantiles of ``col``: exact (linear interpolation) by default;
    ``approx`` uses ``percentile_approx`` (one pass, bounded memory, rank
    error about 1/accuracy, values are sample points, no interpolation)."""
    if not approx:
        return exact_quantiles(df, col, probs)
    arr = df.agg(F.percentile_approx(F.col(col).cast("double"), [float(q) for q in probs], accuracy).alias("a"))
    return arr.select(F.explode(F.arrays_zip(F.array(*[F.lit(float(q)) for q in probs]).alias("q"),
                                             F.col("a").alias("value"))).alias("z")).select("z.q", "z.value")


def _fence_values(df: DataFrame, col: str, k: float) -> dict[str, float]:
    """The quartiles and fences (a handful of numbers, inlined into later
    plans as literals); empty without values."""
    found = column_quantiles(df, [col], [0.25, 0.5, 0.75])[col]
    if not found:
        return {}
    q1, median, q3 = (found[q] for q in (0.25, 0.5, 0.75))
    return {"q1": q1, "median": median, "q3": q3, "iqr": q3 - q1, "lower_fence": q1 - k * (q3 - q1), "upper_fence": q3 + k * (q3 - q1)}


def outliers_iqr(df: DataFrame, col: str, k: float = 1.5) -> DataFrame:
    """Rows outside ``[q1 - k*iqr, q3 + k*iqr]``; NaN is no value and no outlier."""
    f = _fence_values(df, col, k)
    x = F.col(f"`{col}`")
    if not f:
        return df.filter(F.lit(False))          # no values, no fences, no outliers
    return df.filter(not_missing(df, col)).filter((x < F.lit(f["lower_fence"])) | (x > F.lit(f["upper_fence"])))


def box_stats(df: DataFrame, col: str, k: float = 1.5) -> DataFrame:
    """Quartiles, fences, whiskers (extreme values inside the fences) and
    the number of fliers: one scan of the data after the quartiles.  NaN
    doesn't count."""
    names = ["q1", "median", "q3", "iqr", "lower_fence", "upper_fence"]
    f = _fence_values(df, col, k)
    vals = {n: f.get(n) for n in names}
    x = F.when(not_missing(df, col), F.col(f"`{col}`").cast("double"))
    inside = (x >= F.lit(vals["lower_fence"]).cast("double")) & (x <= F.lit(vals["upper_fence"]).cast("double"))
    stats = df.agg(
        F.min(F.when(inside, x)).alias("whisker_low"),
        F.max(F.when(inside, x)).alias("whisker_high"),
        F.count_if(x.isNotNull() & ~F.coalesce(inside, F.lit(False))).alias("fliers"),
    )
    return stats.select(*[F.lit(vals[n]).cast("double").alias(n) for n in names],
                        "whisker_low", "whisker_high", "fliers")


def _numeric(df: DataFrame, col: str) -> Column:
    if isinstance(df.schema[col].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_timestamp(F.col(col).cast("timestamp"))
    return F.col(col).cast("double")


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Equal-width bins between min and max; the max falls in the last bin.
    Timestamps are binned on epoch seconds.  Every bin has a row with its
    edges, empty ones too; a single value gets a range of one around it; a
    column without values has no bins.  Null, NaN and infinite values are in
    no bin."""
    x = _numeric(df, col)
    v = df.filter(not_missing(df, col)).select(x.alias("_x")).filter(F.abs("_x") < float("inf"))
    bounds = v.agg(F.min("_x").alias("lo"), F.max("_x").alias("hi")).first()
    if bounds["lo"] is None:
        lo_value = hi_value = 0.0
    elif bounds["lo"] == bounds["hi"]:
        lo_value, hi_value = bounds["lo"] - 0.5, bounds["hi"] + 0.5
    else:
        lo_value, hi_value = bounds["lo"], bounds["hi"]
    lo, hi = F.lit(lo_value).cast("double"), F.lit(hi_value).cast("double")
    b = F.least(F.floor((F.col("_x") - lo) * F.lit(bins) / (hi - lo)) + 1, F.lit(bins)).cast("int")
    counts = v.select(b.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("cnt"))
    every = df.sparkSession.range(1, 1 if bounds["lo"] is None else bins + 1, 1, 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select(
        "bin", (lo + (hi - lo) * (F.col("bin") - 1) / bins).alias("bin_start"), (lo + (hi - lo) * F.col("bin") / bins).alias("bin_end"),
        F.coalesce("cnt", F.lit(0)).cast("bigint").alias("cnt"))


def value_counts(df: DataFrame, col: str, dropna: bool = True, by_key: bool = False,
                 count_col: str = "cnt") -> DataFrame:
    """Frequency table: most frequent first, or in key order with nulls last."""
    d = df.filter(F.col(col).isNotNull()) if dropna else df
    counts = d.groupBy(col).agg(F.count(F.lit(1)).alias(count_col))
    if by_key:
        return counts.orderBy(F.col(col).asc_nulls_last())
    return counts.orderBy(F.col(count_col).desc(), F.col(col).asc_nulls_last())


def count_by(df: DataFrame, key: str, value: str, count_col: str = "cnt") -> DataFrame:
    """Non-null ``value`` count per non-null ``key``, in key order."""
    return (df.filter(F.col(key).isNotNull()).groupBy(key)
            .agg(F.count(value).alias(count_col)).orderBy(key))


def birth_year_counts(customers: DataFrame, birth_col: str = "birthdate", id_col: str = "customer_id") -> DataFrame:
    """Customers per birth year, 'Unknown' for missing dates, sorted by year
    with 'Unknown' last."""
    year = F.coalesce(F.year(F.col(birth_col)).cast("string"), F.lit("Unknown"))
    counts = customers.groupBy(year.alias("birth_year")).agg(F.count(id_col).alias("count_customers"))
    return counts.orderBy(F.coalesce(F.col("birth_year").try_cast("int"), F.lit(9999)))


def event_ratio(events: DataFrame, name_col: str = "event_name", id_col: str = "event_id",
                session_col: str = "session_id") -> DataFrame:
    """Per event name: events, distinct sessions and events per session
    (rounded half to even, 1 decimal)."""
    return (events.filter(F.col(name_col).isNotNull()).groupBy(name_col).agg(
        F.count(id_col).alias("event_count"), F.countDistinct(session_col).alias("session_unique"))
        .withColumn("ratio", F.bround(F.try_divide(F.col("event_count"), F.col("session_unique")), 1))
        .orderBy(name_col))


def daily_counts(df: DataFrame, ts_col: str, method_col: str, date_col: str = "day") -> DataFrame:
    """Rows per day and method, for every method that occurs, 0 where it is
    absent on a day.  Days without any row do not appear.  The list of
    methods is one row made from the daily counts, so no method is fixed
    beforehand."""
    counts = (df.filter(F.col(method_col).isNotNull())
              .groupBy(F.to_date(F.col(ts_col)).alias(date_col), F.col(method_col)).agg(F.count(F.lit(1)).alias("cnt")))
    methods = counts.agg(F.collect_set(method_col).alias("_methods"))
    # per day: the methods present with their counts, then the absent ones with 0
    per_day = counts.groupBy(date_col).agg(F.map_from_entries(F.collect_list(F.struct(method_col, "cnt"))).alias("_present"))
    full = per_day.join(F.broadcast(methods)).select(date_col, "_present", F.explode("_methods").alias(method_col))
    return full.select(date_col, method_col, F.coalesce(F.try_element_at("_present", F.col(method_col)), F.lit(0)).cast("bigint").alias("cnt"))


def rolling_mean(daily: DataFrame, window: int = 7, date_col: str = "day", method_col: str = "payment_method") -> DataFrame:
    """Trailing mean over the last ``window`` rows present (not calendar
    days) per method; null until ``window`` rows exist.  Runs on the daily
    table, whose size is days x methods."""
    long = daily.select(date_col, method_col, "cnt")
    w = Window.partitionBy(method_col).orderBy(date_col).rowsBetween(-(window - 1), 0)
    return long.select(
        date_col, method_col, "cnt",
        F.when(F.count(F.lit(1)).over(w) == window, F.avg("cnt").over(w)).alias(f"rolling_{window}"),
    )


def head_tail(df: DataFrame, order_cols: Sequence[str], n: int = 5) -> DataFrame:
    """First and last ``n`` rows by an explicit order (tables have no row
    order).  Each side is a per-partition top-n merged once."""
    head = df.orderBy(*[F.col(c).asc() for c in order_cols]).limit(n).withColumn("part", F.lit("head"))
    tail = df.orderBy(*[F.col(c).desc() for c in order_cols]).limit(n).withColumn("part", F.lit("tail"))
    return head.unionByName(tail)


def sample_rows(df: DataFrame, key_col: str, n: int, seed: int = 42) -> DataFrame:
    """A repeatable sample of exactly ``n`` rows: the ``n`` smallest MD5 of
    key and seed, ties by key (per-partition top-n, then one merge of
    n x partitions)."""
    mixed = F.md5(F.concat_ws(":", F.col(key_col).cast("string"), F.lit(str(seed))))
    return df.orderBy(mixed, F.col(key_col)).limit(n)
