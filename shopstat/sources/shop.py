"""The shop's own raw files as a source for the build.

``ShopFiles`` reads transactions, click stream, products and customers from
CSV exports and the category lookup from CSV or Parquet, with the schemas
and event roles below.  It offers the same attributes as ``plans.metrics.
Roles`` (the driver tables), so either can be given to ``build_tables``.
"""

from __future__ import annotations

import os
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from shopstat.operators import clean, nested, sessions
from shopstat.sources.files import read_csv_typed, read_lookup, read_ragged_csv
from shopstat.sources.roles import EventRoles

# Event roles of the shop's click stream.
SHOP_EVENTS = EventRoles(
    counted=["ADD_TO_CART", "CLICK", "HOMEPAGE", "ITEM_DETAIL", "PROMO_PAGE", "SCROLL", "SEARCH"],
    markers=["ADD_PROMO", "BOOKING"],
    step2=["CLICK", "SCROLL", "SEARCH", "ITEM_DETAIL", "PROMO_PAGE"],
    step3=["ADD_TO_CART", "ADD_PROMO"],
    booking="BOOKING",
    cart="ADD_TO_CART",
)


def _schema(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


# Columns of the raw files.
TRANSACTIONS_RAW = ("booking_id string, session_id string, customer_id bigint, created_at string, shipment_date_limit string, "
                    "shipment_fee double, promo_amount double, promo_code string, payment_method string, payment_status string, "
                    "total_amount double, product_metadata string")
CLICKS_RAW = "event_id string, session_id string, event_name string, event_time timestamp, traffic_source string, event_metadata string"
CUSTOMERS_RAW = "customer_id bigint, gender string, birthdate string, device_type string, device_version string, home_location string"
FILES = {"transactions": "transactions.csv", "clicks": "click_stream.csv", "products": "product.csv", "customers": "customer.csv"}


class ShopFiles:
    """Lazy views of the files in ``data_dir``."""

    events = SHOP_EVENTS
    id_type: T.DataType = T.StringType()
    lines_schema = clean.LINES_SCHEMA

    def __init__(self, spark: SparkSession, data_dir: str, lookup_path: str, lookup_format: str = "csv",
                 lenient: bool = False, multi_line: bool = True):
        self.spark, self.data_dir = spark, data_dir
        self.lookup_path, self.lookup_format = lookup_path, lookup_format
        self.lenient, self.multi_line = lenient, multi_line

    @property
    def options(self) -> list:
        return [self.lookup_format, self.lenient, self.multi_line]

    def stage_inputs(self, stage: str) -> list[str]:
        """The files that a stage of the build reads."""
        reads = {"transactions": "transactions", "transactions_prods": "transactions", "events_add_to_cart": "clicks",
                 "products": "products", "customers": "customers", "sessions": "clicks"}
        file = os.path.join(self.data_dir, FILES[reads[stage]])
        return [file, self.lookup_path] if stage == "products" else [file]

    def _read(self, name: str, ddl: str) -> DataFrame:
        return read_csv_typed(self.spark, os.path.join(self.data_dir, FILES[name]), _schema(ddl),
                              lenient=self.lenient, multi_line=self.multi_line)

    @cached_property
    def tx_raw_with_lines(self) -> DataFrame:
        return self._read("transactions", TRANSACTIONS_RAW)

    @cached_property
    def tx(self) -> DataFrame:
        return clean.transactions_clean(self.tx_raw_with_lines, self.id_type)

    @cached_property
    def clicks(self) -> DataFrame:
        return sessions.clean_clicks(self._read("clicks", CLICKS_RAW))

    @cached_property
    def cart_events(self) -> DataFrame:
        return clean.conform(nested.cart_events(self.clicks, self.events.cart, strict=not self.lenient), clean.CART_SCHEMA)

    @cached_property
    def products(self) -> DataFrame:
        raw = read_ragged_csv(self.spark, os.path.join(self.data_dir, FILES["products"]),
                              types={"id": T.LongType(), "year": T.LongType()})
        return clean.products_clean(raw, read_lookup(self.spark, self.lookup_path, self.lookup_format))

    @cached_property
    def customers(self) -> DataFrame:
        return clean.customers_clean(self._read("customers", CUSTOMERS_RAW))

    @cached_property
    def sessions(self) -> DataFrame:
        e = self.events
        rolled = sessions.session_rollup(self.clicks, e.counted, e.markers, e.step2, e.step3)
        return clean.conform(rolled, clean.sessions_schema(e.counted, e.markers))
