"""Metric registry for the group comparisons.

Each metric builds a per-unit frame ``(grp, value)`` for a grouping; the
moments and the test are written once (``operators.stats``).  Lines are
aggregated per booking before any dimension join.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopstat.functions.text import norm_label
from shopstat.operators import clean, marts, nested, sessions, stats
from shopstat.sources import roles

# Metric ids and labels.
METRIC_LABELS = {
    1: "Average order value",
    2: "Number of items per order",
    3: "Number of clicks before booking",
    4: "Average delivery cost",
    5: "Number of unique products",
}
CLICK_EVENT = "click"
# attributes of the driver tables' cart event
CART_ATTRIBUTES = T.StructType([T.StructField("k", T.LongType())])
GROUPINGS = {"segment": roles.SEGMENT_GROUPS, "source": roles.SOURCE_GROUPS}


class Roles:
    """The shop's tables for one data folder, built lazily.  The driver
    tables' ids are numbers and their prices have cents."""

    events = roles.EVENTS
    id_type: T.DataType = T.LongType()
    lines_schema = T.StructType([T.StructField(f.name, T.LongType() if f.name == "booking_id" else T.DoubleType()
                                               if f.name in ("item_price", "product_amount") else f.dataType)
                                 for f in clean.LINES_SCHEMA.fields])

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    options: list = []

    def stage_inputs(self, stage: str) -> list[str]:
        """The files that a stage of the build reads: any of the folder."""
        return [self.sf_dir]

    @cached_property
    def tx_raw(self) -> DataFrame:
        return roles.transactions(self.spark, self.sf_dir)

    @cached_property
    def tx_raw_with_lines(self) -> DataFrame:
        return roles.transactions(self.spark, self.sf_dir, with_metadata=True)

    @cached_property
    def tx(self) -> DataFrame:
        return clean.transactions_clean(self.tx_raw, self.id_type)

    @cached_property
    def lines(self) -> DataFrame:
        return roles.lines(self.spark, self.sf_dir)

    @cached_property
    def customers(self) -> DataFrame:
        return clean.customers_clean(roles.customers(self.spark, self.sf_dir), extra=["segment"])

    @cached_property
    def products(self) -> DataFrame:
        return clean.products_clean(roles.products_raw(self.spark, self.sf_dir),
                                    roles.category_lookup(self.spark, self.sf_dir))

    @cached_property
    def clicks(self) -> DataFrame:
        return sessions.clean_clicks(roles.events(self.spark, self.sf_dir))

    @cached_property
    def cart_events(self) -> DataFrame:
        return nested.event_attributes(self.clicks, self.events.cart, CART_ATTRIBUTES)

    @cached_property
    def sessions(self) -> DataFrame:
        return sessions.session_rollup(self.clicks, roles.COUNTED_EVENTS, roles.MARKER_EVENTS,
                                       roles.STEP2_EVENTS, roles.STEP3_EVENTS)

    @cached_property
    def product_genders(self) -> DataFrame:
        """``prod_id, gender`` of every product.  The category lookup join
        keeps every product row (its keys are unique) and does not touch
        these columns, so the marts use this lean view."""
        raw = roles.products_raw(self.spark, self.sf_dir)
        return raw.select(F.col("id").alias("prod_id"), "gender")

    @cached_property
    def product_summary(self) -> DataFrame:
        return marts.booking_product_summary(self.lines, self.product_genders)

    @cached_property
    def dm_transactions(self) -> DataFrame:
        return marts.dm_transactions(self.tx, self.customers, self.product_summary)

    @cached_property
    def dm_transactions_base(self) -> DataFrame:
        """The mart without the booking number (lazy, prunable)."""
        return marts.dm_transactions(self.tx, self.customers, self.product_summary, with_booking_number=False)


def _grouped(units: DataFrame, grouping: str, r: Roles) -> DataFrame:
    if grouping == "segment":
        dim = r.customers.select("customer_id", F.col("segment").alias("grp"))
        return units.join(dim, "customer_id").select("grp", "value")
    dim = r.sessions.select("session_id", F.col("traffic_source").alias("grp"))
    return units.join(dim, "session_id").select("grp", "value")


def unit_frame(metric_id: int, grouping: str, r: Roles) -> DataFrame:
    """Per-unit values of a metric with the unit's group label."""
    keys = r.tx.select("booking_id", "customer_id", "session_id")
    if metric_id == 1:
        units = r.tx.select("customer_id", "session_id", F.col("total_amount").alias("value"))
    elif metric_id == 4:
        units = r.tx.select("customer_id", "session_id", F.col("shipment_fee").alias("value"))
    elif metric_id == 2:
        units = keys.join(marts.order_quantity(r.lines), "booking_id").withColumnRenamed("total_quantity", "value")
    elif metric_id == 5:
        units = keys.join(marts.order_unique_products(r.lines), "booking_id").withColumnRenamed("unique_prods", "value")
    elif metric_id == 3:
        clicks = r.sessions.select("session_id", "traffic_source", F.col(f"{CLICK_EVENT}_cnt").alias("value"))
        if grouping == "source":
            # every session, booked or not
            return clicks.select(F.col("traffic_source").alias("grp"), "value")
        units = clicks.join(r.tx.select("session_id", "customer_id"), "session_id")
    else:
        raise KeyError(f"unknown metric {metric_id}")
    return _grouped(units, grouping, r)


def ttest(metric_id: int, grouping: str, r: Roles) -> DataFrame:
    g1, g2 = GROUPINGS[grouping]
    return stats.welch_ttest(unit_frame(metric_id, grouping, r), "grp", "value", g1, g2,
                             metric=METRIC_LABELS[metric_id])


def moments(metric_id: int, grouping: str, r: Roles) -> DataFrame:
    return stats.moments(unit_frame(metric_id, grouping, r), "grp", "value", GROUPINGS[grouping])


def payment_customers(grouping: str, r: Roles) -> DataFrame:
    """Rows per (payment method, group, customer) with their booking count.

    By segment the rows come from the transaction mart (bookings with known
    products only); by source from all bookings joined to sessions.
    """
    groups = list(GROUPINGS[grouping])
    c = r.customers.select("customer_id", F.col("segment").alias("grp"))
    if grouping == "segment":
        base = r.dm_transactions_base.select("payment_method", "customer_id").join(c, "customer_id")
    else:
        s = r.sessions.select("session_id", F.col("traffic_source").alias("grp"))
        base = (r.tx.select("payment_method", "session_id", "customer_id").join(s, "session_id")
                .join(r.customers.select("customer_id"), "customer_id"))
    return (base.withColumn("grp", norm_label(F.col("grp")))
            .filter(F.col("grp").isin([g.strip().upper() for g in groups]))
            .groupBy("payment_method", "grp", "customer_id")
            .agg(F.count(F.lit(1)).alias("transactions_cnt")))


def crosstab(grouping: str, r: Roles) -> DataFrame:
    return stats.crosstab(payment_customers(grouping, r), "payment_method", "grp", GROUPINGS[grouping])


def chi_square(grouping: str, r: Roles) -> DataFrame:
    title = "Segment" if grouping == "segment" else "Traffic source"
    return stats.chi_square(crosstab(grouping, r), "payment_method", GROUPINGS[grouping],
                            question=f"Does the share of payment methods differ across {title}?")


def contingency_all_segments(r: Roles) -> DataFrame:
    """Customers per payment method and segment, for every segment there is."""
    c = r.customers.select("customer_id", "segment")
    base = r.tx.select("payment_method", "customer_id").join(c, "customer_id").distinct()
    return stats.contingency(base, "payment_method", "segment")
