"""Query catalogue: one entry per operator, each ``(spark, sf_dir) -> DataFrame``.

Floating-point outputs are rounded half to even to 6 decimals so that
results compare across engines whose summation order differs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopstat.functions.bands import age_category, age_years, amount_category
from shopstat.operators import marts, nested, profile, quality, sessions
from shopstat.operators.ranking import sequence_number
from shopstat.plans import metrics
from shopstat.plans.metrics import Roles
from shopstat.sources import roles

AGE_AS_OF = "1999-06-30"
DIGITS = 6

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Presentation for cross-engine comparison: doubles rounded half to
    even; decimals (money) as rounded doubles; dates as ISO text.  Written
    tables keep their declared types."""
    def present(f: T.StructField):
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            return F.bround(F.col(f.name).cast("double"), digits).alias(f.name)
        if isinstance(f.dataType, T.DateType):
            return F.date_format(F.col(f.name), "yyyy-MM-dd").alias(f.name)
        return F.col(f.name)
    return df.select(*[present(f) for f in df.schema.fields])


def _q(build: Callable[[Roles], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(build(Roles(spark, sf_dir)))
    return run


METRIC_KEYS = {1: "order_value", 2: "items", 3: "clicks", 4: "delivery_cost", 5: "unique_products"}


def _ttest_queries() -> dict[str, Query]:
    out = {}
    for mid, name in METRIC_KEYS.items():
        for grouping in ("segment", "source"):
            out[f"ttest_{name}_by_{grouping}"] = _q(lambda r, m=mid, g=grouping: metrics.ttest(m, g, r))
    return out


def _age_category(r: Roles) -> DataFrame:
    at = F.lit(AGE_AS_OF).cast("date")
    return r.customers.select(
        "customer_id", "birthdate",
        age_years(F.col("birthdate"), at).alias("age_years"),
        age_category(F.col("birthdate"), at).alias("age_category"),
    )


def _key_quality(r: Roles) -> DataFrame:
    """Every table's key, each from the narrowest view that has it."""
    session_rows = (r.clicks.select("session_id", "traffic_source")
                    .filter("session_id IS NOT NULL AND traffic_source IS NOT NULL").distinct())
    kq = quality.key_quality([
        ("transactions", r.tx_raw, "booking_id"),
        ("customers", r.customers, "customer_id"),
        ("products", r.product_genders, "prod_id"),
        ("sessions", session_rows, "session_id"),
        ("events_add_to_cart", r.clicks.filter(F.col("event_name") == r.events.cart), "event_id"),
    ])
    return kq.withColumn("max_key_len", F.col("max_key_len").cast("bigint"))


def _sql_source(r: Roles) -> DataFrame:
    flags = sessions.session_flags(r.sessions, roles.COUNTED_EVENTS, roles.MARKER_EVENTS)
    # the frame is handed to the query itself: no view of the session is replaced
    return r.spark.sql("""
        SELECT traffic_source,
               count(*) AS sessions,
               sum(has_click) AS click_sessions,
               sum(has_purchase) AS booked_sessions,
               avg(session_events_cnt) AS avg_events
        FROM {flags}
        GROUP BY traffic_source
    """, flags=flags)


ORPHAN_EVERY, ORPHAN_SHIFT = 97, 10_000_000


def _lines_with_orphans(r: Roles) -> DataFrame:
    """The driver tables have no orphan lines, so for this check the products
    of every 97th booking are moved out of the product table's range."""
    orphaned = F.col("booking_id") % ORPHAN_EVERY == 0
    return r.lines.withColumn("product_id", F.when(orphaned, F.col("product_id") + ORPHAN_SHIFT).otherwise(F.col("product_id")))


def _varied_events(r: Roles) -> DataFrame:
    """The driver's events have one attribute; here others are added by rule,
    some rows as literals that JSON lacks (a hexadecimal number and a
    trailing comma)."""
    i, k = F.col("event_id"), F.get_json_object("event_metadata", "$.k").cast("bigint")
    number = F.when(i % 97 == 0, F.concat(F.lit("0x"), F.lower(F.hex(k)))).otherwise(k.cast("string"))
    text = F.concat(
        F.lit("{"), F.when(i % 4 != 0, F.concat(F.lit("'k': "), number, F.lit(", "))).otherwise(""),
        F.when(i % 3 == 0, F.concat(F.lit("'label': 'None or L"), (i % 7).cast("string"), F.lit("', "))).otherwise(""),
        F.when(i % 5 == 0, F.concat(F.lit("'half': "), (i % 100).cast("string"), F.lit(".5, "))).otherwise(""),
        F.when(i % 11 == 0, F.lit("'mixed': 'many', ")).when(i % 11 == 1, F.lit("'mixed': 12, ")).otherwise(""),
        F.lit("'seen': "), F.when(i % 2 == 0, F.lit("1")).otherwise("None"), F.when(i % 97 == 0, F.lit(",}")).otherwise("}"))
    return r.clicks.withColumn("event_metadata", F.when(i % 13 != 0, text))


def _literal_lines(r: Roles) -> DataFrame:
    """Bookings whose product lists are tuples or end in a comma, besides plain ones."""
    text, k = F.col("product_metadata"), F.col("booking_id")
    inner = F.expr("substring(product_metadata, 2, length(product_metadata) - 2)")
    return r.tx_raw_with_lines.select("booking_id", F.when(k % 50 == 0, F.concat(F.lit("("), inner, F.lit(",)")))
                                      .when(k % 50 == 1, F.concat(F.lit("["), inner, F.lit(",]"))).otherwise(text).alias("product_metadata"))


def _daily(r: Roles) -> DataFrame:
    return profile.daily_counts(r.tx, "created_at", "payment_method")


def build_queries() -> dict[str, Query]:
    q: dict[str, Query] = {}
    q.update(_ttest_queries())
    q.update({
        "chi2_by_segment": _q(lambda r: metrics.chi_square("segment", r)),
        "chi2_by_source": _q(lambda r: metrics.chi_square("source", r)),
        "moments_order_value": _q(lambda r: metrics.moments(1, "segment", r)),
        "order_quantity": _q(lambda r: marts.order_quantity(r.lines)),
        "order_unique_products": _q(lambda r: marts.order_unique_products(r.lines)),
        "payment_customer_counts": _q(lambda r: metrics.payment_customers("segment", r)),
        "contingency_cells": _q(metrics.contingency_all_segments),
        "chi2_all_segments": _q(lambda r: metrics.stats.chi_square_cells(
            metrics.contingency_all_segments(r), "payment_method", "segment")),
        "crosstab_counts": _q(lambda r: metrics.crosstab("segment", r)),
        "crosstab_percent": _q(lambda r: metrics.stats.crosstab_percent(
            metrics.crosstab("segment", r), "payment_method", metrics.GROUPINGS["segment"])),
        "age_category": _q(_age_category),
        "amount_category": _q(lambda r: r.tx.select(
            "booking_id", "total_amount", amount_category(F.col("total_amount")).alias("total_amount_category"))),
        "dm_transactions": _q(lambda r: r.dm_transactions),
        "dm_sessions": _q(lambda r: sessions.session_flags(r.sessions, roles.COUNTED_EVENTS, roles.MARKER_EVENTS)),
        "session_rollup": _q(lambda r: r.sessions),
        "funnel": _q(lambda r: sessions.funnel(r.sessions, roles.BOOKING_EVENT)),
        "booking_number": _q(lambda r: marts.booking_numbers(
            r.tx.select("booking_id", "customer_id", "created_at"))),
        "days_elapsed": _q(lambda r: profile.count_by(r.tx, "days_to_shipment", "booking_id")),
        "transactions_clean": _q(lambda r: r.tx),
        "customers_clean": _q(lambda r: r.customers),
        "products_clean": _q(lambda r: r.products),
        "transaction_lines": _q(lambda r: nested.booking_lines(r.tx_raw_with_lines, strict=True, keep_empty=True)),
        "transaction_lines_strict": _q(lambda r: nested.booking_lines(
            r.tx_raw_with_lines, strict=False, keep_empty=False)),
        "transaction_lines_literals": _q(lambda r: nested.booking_lines(_literal_lines(r), strict=True, keep_empty=False)),
        "events_add_to_cart": _q(lambda r: r.cart_events),
        "events_open_attributes": _q(lambda r: nested.event_attributes(_varied_events(r), r.events.cart)),
        "line_ids": _q(lambda r: sequence_number(
            r.lines, [], ["booking_id", "product_id", "quantity", "item_price"], "id")),
        "key_quality": _q(_key_quality),
        "value_quality": _q(lambda r: quality.value_quality(r.lines)),
        "placeholder_values": _q(lambda r: quality.placeholder_values(
            r.tx, ["payment_method", "payment_status", "promo_code"])),
        "orphan_lines": _q(lambda r: quality.orphan_lines(_lines_with_orphans(r), r.product_genders)),
        "duplicate_lines": _q(lambda r: quality.duplicate_members(r.lines, ["booking_id", "product_id"])),
        "reconcile_totals": _q(lambda r: quality.reconcile_totals(r.tx, r.lines)),
        "once_per_session": _q(lambda r: quality.once_per_session(r.clicks, roles.BOOKING_EVENT)),
        "column_profile": _q(lambda r: profile.column_profile(r.tx)),
        "describe_orders": _q(lambda r: profile.describe(r.tx, ["total_amount", "shipment_fee", "promo_amount"])),
        "quantiles_order_value": _q(lambda r: profile.quantile_table(r.tx, "total_amount")),
        "box_stats": _q(lambda r: profile.box_stats(r.lines, "product_amount")),
        "outliers_iqr": _q(lambda r: profile.outliers_iqr(r.lines, "product_amount")),
        "ship_histogram": _q(lambda r: profile.histogram(r.tx, "shipment_date_limit", 50)),
        "value_counts_status": _q(lambda r: profile.value_counts(r.tx, "payment_status")),
        "value_counts_with_nulls": _q(lambda r: profile.value_counts(r.tx, "promo_code", dropna=False, by_key=True)),
        "count_by_colour": _q(lambda r: profile.count_by(r.products, "baseColour", "prod_id")),
        "customers_by_birth_year": _q(lambda r: profile.birth_year_counts(r.customers)),
        "event_ratio": _q(lambda r: profile.event_ratio(r.clicks)),
        "daily_method_counts": _q(_daily),
        "daily_method_rolling7": _q(lambda r: profile.rolling_mean(_daily(r), 7)),
        "head_orders": _q(lambda r: profile.head_tail(
            r.tx.select("booking_id", "created_at", "total_amount"), ["booking_id"], 5)),
        "sample_events": _q(lambda r: profile.sample_rows(r.clicks, "event_id", 20)),
        "sql_source": _q(_sql_source),
    })
    return q
