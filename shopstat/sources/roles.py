"""Role views: the shop's logical inputs expressed over the given tables.

The shop works on five raw inputs (transactions, their product lines,
products, customers, click events).  Here each one is a DataFrame derived
from the parquet tables of a data folder.  Derived columns follow one fixed
rule per column so that Spark and the SQL oracle compute the same thing.

Nothing else in the package names a parquet table: operators take these
DataFrames and column names as parameters.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopstat.functions.text import concat_key

# Event roles in the click stream.
COUNTED_EVENTS = ["click", "view", "error"]   # count, first and last time per session
MARKER_EVENTS = ["signup", "purchase"]         # first time only
STEP2_EVENTS = ["click", "view"]
STEP3_EVENTS = ["signup"]
BOOKING_EVENT = "purchase"
CART_EVENT = "signup"                          # the event whose attributes become a table


@dataclass(frozen=True)
class EventRoles:
    """Which events a source counts, marks and takes as steps."""
    counted: Sequence[str]
    markers: Sequence[str]
    step2: Sequence[str]
    step3: Sequence[str]
    booking: str
    cart: str


EVENTS = EventRoles(COUNTED_EVENTS, MARKER_EVENTS, STEP2_EVENTS, STEP3_EVENTS, BOOKING_EVENT, CART_EVENT)

# The two groups compared by the statistical tests.
SEGMENT_GROUPS = ("BUILDING", "MACHINERY")
SOURCE_GROUPS = ("WEB", "MOBILE")
MENS_PRODUCT_TYPE = "ECONOMY"                  # products flagged as 'Men'


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def transactions(spark: SparkSession, sf_dir: str, with_metadata: bool = False) -> DataFrame:
    """One row per booking (an order).

    ``with_metadata`` adds ``product_metadata``: the booking's lines as the
    text of a Python list of dicts, the raw format of the shop's export.
    """
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    df = o.select(
        k.alias("booking_id"),
        F.col("o_custkey").alias("session_id"),
        F.col("o_custkey").alias("customer_id"),
        F.expr("timestampadd(SECOND, o_orderkey * 7919 % 86400, o_orderdate)").alias("created_at"),
        F.expr("timestampadd(HOUR, (o_orderkey % 10) * 24 + o_orderkey % 24, o_orderdate)")
        .alias("shipment_date_limit"),
        F.when(k % 5 == 0, F.lit(0.0)).otherwise(F.col("o_totalprice") * 0.01).alias("shipment_fee"),
        F.when(k % 3 == 0, F.col("o_totalprice") * 0.05).otherwise(F.lit(0.0)).alias("promo_amount"),
        F.when(k % 3 == 0, F.concat(F.lit("PROMO"), (k % 4).cast("string"))).alias("promo_code"),
        F.col("o_orderpriority").alias("payment_method"),
        F.col("o_orderstatus").alias("payment_status"),
        F.col("o_totalprice").alias("total_amount"),
    )
    if with_metadata:
        # one text cell per booking: grows with the data, so never broadcast
        meta = _metadata_text(lines(spark, sf_dir)).hint("merge")
        df = df.join(meta, "booking_id", "left")
    return df


def _metadata_text(line_df: DataFrame) -> DataFrame:
    """Render each booking's lines as ``[{'product_id': 1, ...}, ...]``.

    This rebuilds the raw input format (one text cell per booking); the
    parsing operators in ``operators.nested`` turn it back into rows.
    """
    # Each element is formatted row by row (inside generated code) before
    # grouping; elements are sorted for a deterministic text.
    item = F.concat(
        F.lit("{'product_id': "), F.col("product_id").cast("string"),
        F.lit(", 'quantity': "), F.col("quantity").cast("string"),
        F.lit(", 'item_price': "), F.col("item_price").cast("string"), F.lit("}"),
    )
    return line_df.select("booking_id", item.alias("_item")).groupBy("booking_id").agg(
        F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("_item")), ", "), F.lit("]"))
        .alias("product_metadata")
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product lines of bookings."""
    li = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("bigint")
    return li.select(
        F.col("l_orderkey").alias("booking_id"),
        F.col("l_partkey").alias("product_id"),
        q.alias("quantity"),
        F.col("l_extendedprice").alias("item_price"),
        (q * F.col("l_extendedprice")).alias("product_amount"),
    )


def _word(c: Column, i: int) -> Column:
    return F.get(F.split(c, " "), i)


def products_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product list with the raw column names of the shop's product file."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_type") == MENS_PRODUCT_TYPE, F.lit("Men")).otherwise(F.lit("Women")).alias("gender"),
        F.col("p_type").alias("masterCategory"),
        F.col("p_brand").alias("subCategory"),
        _word(F.col("p_name"), 1).alias("articleType"),
        _word(F.col("p_name"), 0).alias("baseColour"),
        F.lit(None).cast("string").alias("season"),
        (F.lit(2010) + F.col("p_size") % 10).cast("bigint").alias("year"),
        F.lit(None).cast("string").alias("usage"),
        F.col("p_name").alias("productDisplayName"),
    )


def category_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category renaming lookup (original 'master-sub-article' -> new names).

    Derived by rule from the distinct category triples of the product table;
    its size is bounded by the category vocabulary, not by the product count.
    """
    p = products_raw(spark, sf_dir).select("masterCategory", "subCategory", "articleType").distinct()
    return p.select(
        concat_key(F.col("masterCategory"), F.col("subCategory"), F.col("articleType"))
        .alias("original_name_concat"),
        _capitalize(F.col("masterCategory")).alias("masterCategory_new"),
        F.regexp_replace("subCategory", "#", " ").alias("subCategory_new"),
        _capitalize(F.col("articleType")).alias("articleType_new"),
    )


def _capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_mktsegment").alias("segment"),
        F.when(F.col("c_custkey") % 50 == 0, F.lit(None).cast("date"))
        .otherwise(F.date_add(F.lit("1940-01-01").cast("date"), (F.col("c_custkey") * 37 % 25000).cast("int")))
        .alias("birthdate"),
        F.col("c_nationkey").cast("string").alias("home_location"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Click stream."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id"),
        F.col("user_id").alias("session_id"),
        F.col("event_type").alias("event_name"),
        F.col("ts").alias("event_time"),
        F.when(F.col("user_id") % 2 == 0, F.lit("WEB")).otherwise(F.lit("MOBILE")).alias("traffic_source"),
        F.col("props").alias("event_metadata"),
        F.col("value"),
    )
