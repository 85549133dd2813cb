"""Raw inputs -> typed, cleaned tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopstat.functions.text import concat_key
from shopstat.functions.timeparts import days_elapsed, floor_second, parse_timestamp
from shopstat.sources.sinks import conform

# Declared types of the tables.  Booking, session and event ids are text in
# the shop's exports; ``with_ids`` gives the same schema for sources whose
# ids are numbers.
TRANSACTIONS_SCHEMA = T.StructType([
    T.StructField("booking_id", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("customer_id", T.LongType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("shipment_date_limit", T.TimestampNTZType()),
    T.StructField("days_to_shipment", T.IntegerType()),
    T.StructField("promo_flag", T.IntegerType()),
    T.StructField("promo_amount", T.DecimalType(18, 2)),
    T.StructField("promo_code", T.StringType()),
    T.StructField("payment_method", T.StringType()),
    T.StructField("payment_status", T.StringType()),
    T.StructField("shipment_fee", T.DecimalType(18, 2)),
    T.StructField("total_amount", T.DecimalType(18, 2)),
    T.StructField("has_free_shipping", T.IntegerType()),
    T.StructField("has_promo", T.IntegerType()),
])

PRODUCTS_SCHEMA = T.StructType([
    T.StructField("prod_id", T.LongType()),
    T.StructField("prod_name", T.StringType()),
    T.StructField("category_level_1", T.StringType()),
    T.StructField("category_level_2", T.StringType()),
    T.StructField("category_level_3", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("baseColour", T.StringType()),
    T.StructField("season", T.StringType()),
    T.StructField("year", T.LongType()),
    T.StructField("usage", T.StringType()),
])

CUSTOMERS_SCHEMA = T.StructType([
    T.StructField("customer_id", T.LongType()),
    T.StructField("gender", T.StringType()),
    T.StructField("birthdate", T.TimestampNTZType()),
    T.StructField("device_type", T.StringType()),
    T.StructField("device_version", T.StringType()),
    T.StructField("home_location", T.StringType()),
])

LINES_SCHEMA = T.StructType([
    T.StructField("booking_id", T.StringType()),
    T.StructField("product_id", T.LongType()),
    T.StructField("quantity", T.LongType()),
    T.StructField("item_price", T.LongType()),
    T.StructField("product_amount", T.LongType()),
])

CART_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("event_time", T.TimestampNTZType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("traffic_source", T.StringType()),
    T.StructField("prod_id", T.LongType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("item_price", T.DecimalType(10, 2)),
    T.StructField("prod_amount", T.DecimalType(10, 2)),
])


def sessions_schema(counted: Sequence[str], markers: Sequence[str]) -> T.StructType:
    """Session table: counts are integers, times have no zone."""
    fields = [T.StructField("session_id", T.StringType()), T.StructField("traffic_source", T.StringType())]
    for e in sorted(set(counted) | set(markers)):
        if e in counted:
            fields += [T.StructField(f"{e}_cnt", T.IntegerType()), T.StructField(f"{e}_first_time", T.TimestampNTZType()),
                       T.StructField(f"{e}_last_time", T.TimestampNTZType())]
        else:
            fields.append(T.StructField(f"{e}_time", T.TimestampNTZType()))
    return T.StructType(fields + [T.StructField("session_events_cnt", T.IntegerType())] + [
        T.StructField(c, T.TimestampNTZType()) for c in ("session_start_time", "session_end_time", "step2_time", "step3_time")])


def with_ids(schema: T.StructType, id_type: T.DataType) -> T.StructType:
    ids = {"booking_id", "session_id", "event_id"}
    return T.StructType([T.StructField(f.name, id_type if f.name in ids else f.dataType) for f in schema.fields])


def flag(cond: Column) -> Column:
    """Boolean -> 0/1 where an unknown (null) comparison counts as 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def as_timestamp(df: DataFrame, name: str) -> Column:
    """Text is parsed strictly; an existing timestamp is kept."""
    c = F.col(name)
    if isinstance(df.schema[name].dataType, T.StringType):
        return parse_timestamp(c)
    return c.cast("timestamp_ntz")


def transactions_clean(tx: DataFrame, id_type: T.DataType = T.StringType()) -> DataFrame:
    """Timestamps parsed and floored to seconds, flags, elapsed days to the
    shipment limit, money as DECIMAL(18,2)."""
    created = floor_second(as_timestamp(tx, "created_at"))
    limit = floor_second(as_timestamp(tx, "shipment_date_limit"))
    df = tx.withColumns({"created_at": created, "shipment_date_limit": limit})
    df = df.withColumns({
        "has_free_shipping": flag(F.col("shipment_fee") == 0),
        "has_promo": flag(F.col("promo_amount") > 0),
        "promo_flag": flag(F.col("promo_amount") > 0),
        "days_to_shipment": days_elapsed(F.col("created_at"), F.col("shipment_date_limit")),
    })
    return conform(df, with_ids(TRANSACTIONS_SCHEMA, id_type))


def customers_clean(customers: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Customers with their declared columns (missing ones null); ``extra``
    names text columns to keep besides, such as a segment."""
    df = customers.withColumn("birthdate", as_timestamp(customers, "birthdate"))
    return conform(df, T.StructType(CUSTOMERS_SCHEMA.fields + [T.StructField(c, T.StringType()) for c in extra]))


def strip_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def products_clean(products: DataFrame, lookup: DataFrame, fill_not_set: bool = False) -> DataFrame:
    """Products with categories renamed through the lookup.

    The lookup is matched on 'master-sub-article' (a missing level prints as
    ``nan``); unmatched products keep null new categories.  How the join
    runs is left to the planner, which broadcasts the lookup only if its
    size, known or measured at run time, is below Spark's limit.
    """
    p = strip_column_names(products)
    p = p.withColumn("categories_concat",
                     concat_key(F.col("masterCategory"), F.col("subCategory"), F.col("articleType")))
    lk = lookup.select("original_name_concat", "masterCategory_new", "subCategory_new", "articleType_new")
    joined = p.join(lk, p["categories_concat"] == lk["original_name_concat"], "left")
    out = joined.select(
        F.col("id").alias("prod_id"),
        F.col("productDisplayName").alias("prod_name"),
        F.col("masterCategory_new").alias("category_level_1"),
        F.col("subCategory_new").alias("category_level_2"),
        F.col("articleType_new").alias("category_level_3"),
        "gender", "baseColour", "season", "year", "usage",
    )
    if fill_not_set:
        out = out.na.fill("Not set", subset=["season", "usage"])
    return conform(out, PRODUCTS_SCHEMA)
