"""Booking-level aggregates and the transaction mart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopstat.functions.bands import age_category, amount_category
from shopstat.functions.timeparts import days_between_boundaries
from shopstat.operators.ranking import checkpointed, sequence_number


def order_quantity(lines: DataFrame, id_col: str = "booking_id") -> DataFrame:
    """Units per booking."""
    return lines.groupBy(id_col).agg(F.sum("quantity").cast("bigint").alias("total_quantity"))


def order_unique_products(lines: DataFrame, id_col: str = "booking_id", approx: bool = False,
                          pre_partition: bool = True) -> DataFrame:
    """Distinct products per booking (``approx``: HyperLogLog estimate).

    The lines are dealt out by booking once, and both steps of the distinct
    count (and a later join on the booking) use that one exchange.
    ``pre_partition=False`` reduces (booking, product) pairs before the
    shuffle instead, for inputs where single bookings are huge.
    """
    agg = F.approx_count_distinct("product_id") if approx else F.countDistinct("product_id")
    if pre_partition and not approx:
        lines = lines.select(id_col, "product_id").repartition(F.col(id_col))
    return lines.groupBy(id_col).agg(agg.alias("unique_prods"))


def booking_product_summary(lines: DataFrame, products: DataFrame, mens_label: str = "Men") -> DataFrame:
    """Per booking over lines of known products: distinct products, units,
    and whether any product is a men's product."""
    known = lines.join(products.select("prod_id", "gender"), lines["product_id"] == products["prod_id"])
    return known.groupBy("booking_id").agg(
        F.countDistinct("product_id").alias("dist_prod_id"),
        F.sum("quantity").cast("bigint").alias("prods_cnt"),
        F.max(F.when(F.col("gender") == F.lit(mens_label), 1).otherwise(0)).alias("has_mens_prods"),
    )


def booking_numbers(tx: DataFrame, customer_col: str = "customer_id", time_col: str = "created_at",
                    id_col: str = "booking_id", out_col: str = "booking_number") -> DataFrame:
    """Booking sequence per customer by time (ties broken by booking id)."""
    return sequence_number(tx, [customer_col], [time_col, id_col], out_col)


def dm_transactions(tx: DataFrame, customers: DataFrame, summary: DataFrame,
                    with_booking_number: bool = True) -> DataFrame:
    """Transaction mart: bookings of known customers with at least one known
    product, with bands, delivery days, product counts and booking number
    (numbered after those joins).

    The mart's rows are written once with a row id of their own (so the lines
    are joined and summed once), only customer, time, booking id and row id
    pass through the numbering, and the numbers are joined back on the row
    id: rows that share a booking id or a customer stay as many as the joins
    make them, and each gets its own number.  The numbering is materialised
    when the mart is built, so consumers that do not need ``booking_number``
    should pass ``with_booking_number=False`` and keep the plan lazy
    (Catalyst then prunes the unused columns too).
    """
    c = customers.select("customer_id", "birthdate")
    joined = tx.join(c, "customer_id").join(summary, "booking_id")
    mart = joined.select(
        F.col("created_at").alias("created_dt"),
        "booking_id", "customer_id", "session_id", "payment_method", "payment_status",
        "promo_code", "promo_amount", "shipment_fee", "shipment_date_limit", "total_amount",
        amount_category(F.col("total_amount")).alias("total_amount_category"),
        F.when(F.col("promo_amount") > 0, 1).otherwise(0).alias("has_promo"),
        days_between_boundaries(F.col("created_at"), F.col("shipment_date_limit")).alias("days_to_delivery"),
        age_category(F.col("birthdate"), F.col("created_at")).alias("customer_age_category"),
        "dist_prod_id", "prods_cnt", "has_mens_prods",
    )
    if not with_booking_number:
        return mart
    written = checkpointed(mart.withColumn("_row", F.monotonically_increasing_id()))
    keys = written.select("customer_id", "created_dt", "booking_id", "_row")
    numbers = booking_numbers(keys, time_col="created_dt").select("_row", "booking_number")
    return written.join(numbers, "_row").select(*mart.columns, "booking_number")
