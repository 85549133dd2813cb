"""Data-quality checks: keys, values, placeholders, orphans, duplicates,
reconciliation, once-per-session events."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopstat.functions.text import PLACEHOLDER_TOKENS, sql_len
from shopstat.sources.sinks import money


def key_report(df: DataFrame, key: str, table: str) -> DataFrame:
    """One row: rows, null keys, surplus rows over distinct keys, longest key."""
    return df.agg(
        F.lit(table).alias("table_name"),
        F.lit(key).alias("key_column"),
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(key).isNull()).alias("null_keys"),
        (F.count(F.lit(1)) - F.countDistinct(key)).alias("duplicate_keys"),
        F.max(sql_len(F.col(key))).alias("max_key_len"),
    )


def key_quality(tables: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """Key report of several ``(name, df, key)`` tables, one row each."""
    return reduce(DataFrame.unionByName, [key_report(df, key, name) for name, df, key in tables])


def assert_keys(df: DataFrame, key: str | Sequence[str], table: str = "table", max_len: int = 36) -> None:
    """Raise when the key (one column or several) has nulls or duplicates, or
    a text key is longer than ``max_len`` (the primary-key contract)."""
    keys = [key] if isinstance(key, str) else list(key)
    any_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    too_long = reduce(lambda a, b: a | b, [sql_len(F.col(k)) > max_len for k in keys])
    # groups are counted map-side first, so a very common key is one row
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    r = groups.agg(F.coalesce(F.sum(F.when(any_null, F.col("_n"))), F.lit(0)).alias("nulls"),
                   F.coalesce(F.sum(F.when(~any_null, F.col("_n") - 1)), F.lit(0)).alias("repeats"),
                   F.count_if(too_long).alias("long")).first()
    if r["nulls"] or r["repeats"] or r["long"]:
        raise ValueError(f"{table}.{'+'.join(keys)}: {r['nulls']} null, {r['repeats']} duplicate, {r['long']} too long keys")


def value_quality(lines: DataFrame) -> DataFrame:
    """Negative quantities and prices, and amounts that are not quantity x
    price (a missing operand counts as a mismatch)."""
    expected = F.col("quantity") * F.col("item_price")
    return lines.agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("quantity") < 0).alias("negative_quantity"),
        F.count_if(F.col("item_price") < 0).alias("negative_price"),
        F.count_if(F.coalesce(F.col("product_amount") != expected, F.lit(True))).alias("wrong_amount"),
    )


def placeholder_values(df: DataFrame, cols: Sequence[str], tokens=PLACEHOLDER_TOKENS) -> DataFrame:
    """Per column: nulls and trimmed values that are placeholders.  One scan."""
    aggs = []
    for c in cols:
        aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}__null"),
                 F.count_if(F.trim(F.col(c).cast("string")).isin(list(tokens))).alias(f"{c}__ph")]
    wide = df.agg(*aggs)
    stacked = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__null").alias("null_cnt"),
                 F.col(f"{c}__ph").alias("placeholder_cnt"))
        for c in cols
    ])).alias("r")
    return wide.select(stacked).select("r.*")


def orphan_lines(lines: DataFrame, products: DataFrame, key: str = "product_id",
                 product_key: str = "prod_id") -> DataFrame:
    """Lines whose product is not in the product table (null matches null).
    An anti join keeps or drops each line once whatever the duplicates on
    the product side, so no de-duplication (and its shuffle) is needed."""
    p = products.select(F.col(product_key).alias("_pk"))
    return lines.join(p, lines[key].eqNullSafe(p["_pk"]), "left_anti")


def duplicate_members(df: DataFrame, keys: Sequence[str], count_col: str = "dup_count") -> DataFrame:
    """Every row of a key group that has more than one row.

    Counts are a grouped aggregate (reduced map-side), joined back only for
    the duplicated keys; AQE splits a skewed key on the large side.
    """
    counts = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_col))
              .filter(F.col(count_col) > 1)
              .select(*[F.col(k).alias(f"_d_{k}") for k in keys], count_col))
    cond = reduce(lambda a, b: a & b, [df[k].eqNullSafe(counts[f"_d_{k}"]) for k in keys])
    return df.join(counts, cond).drop(*[f"_d_{k}" for k in keys])


def reconcile_totals(tx: DataFrame, lines: DataFrame) -> DataFrame:
    """Tally of ``total - fee + promo - sum(lines)`` per booking, as exact
    decimals; bookings without lines have no difference and drop out."""
    # each amount is a decimal before it is summed: the order of summation can't move a cent
    sums = lines.groupBy("booking_id").agg(F.sum(money(F.col("product_amount"))).cast("decimal(18,2)").alias("products_total"))
    check = tx.select("booking_id", "total_amount", "shipment_fee", "promo_amount").join(sums, "booking_id", "left")
    diff = (F.col("total_amount") - F.col("shipment_fee") + F.col("promo_amount") - F.col("products_total"))
    return (check.select(diff.alias("difference"))
            .filter(F.col("difference").isNotNull())
            .groupBy("difference").agg(F.count(F.lit(1)).alias("bookings")))


def once_per_session(events: DataFrame, event_name: str, session_col: str = "session_id",
                     name_col: str = "event_name") -> DataFrame:
    """For one event: occurrences, distinct sessions, occurrences without a session."""
    ev = events.filter(F.col(name_col) == F.lit(event_name))
    return ev.agg(
        F.lit(event_name).alias("event_name"),
        F.count(F.lit(1)).alias("total"),
        F.countDistinct(session_col).alias("unique_sessions"),
        F.count_if(F.col(session_col).isNull()).alias("missing_sessions"),
    )
