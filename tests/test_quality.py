import pytest
from pyspark.sql import functions as F

from shopstat.operators.quality import (assert_keys, duplicate_members, key_report, once_per_session,
                                        orphan_lines, placeholder_values, reconcile_totals, value_quality)


def test_key_report_dup_null_blank_padded(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("bb  ",), ("ccc",)], "k string")
    r = key_report(df, "k", "t").first()
    assert (r.rows, r.null_keys, r.duplicate_keys, r.max_key_len) == (5, 1, 2, 3)
    with pytest.raises(ValueError):
        assert_keys(df, "k", "t")
    assert_keys(spark.createDataFrame([("x",), ("y",)], "k string"), "k")


def test_value_quality(spark):
    lines = spark.createDataFrame(
        [(1, 2, 3.0, 6.0), (-1, 2, 3.0, 6.0), (1, 1, -2.0, -2.0), (1, None, 3.0, None), (1, 2, 3.0, 7.0)],
        "booking_id long, quantity long, item_price double, product_amount double")
    r = value_quality(lines).first()
    assert (r.negative_quantity, r.negative_price, r.wrong_amount) == (0, 1, 2)


def test_placeholders(spark):
    df = spark.createDataFrame([(" None ",), ("?",), ("0",), ("",), (None,), ("ok",)], "c string")
    r = placeholder_values(df, ["c"]).first()
    assert (r.column_name, r.null_cnt, r.placeholder_cnt) == ("c", 1, 4)


def test_orphans_null_matches_null(spark):
    lines = spark.createDataFrame([(1, 10), (2, 11), (3, None)], "booking_id long, product_id long")
    prods = spark.createDataFrame([(10,), (None,)], "prod_id long")
    assert [r.booking_id for r in orphan_lines(lines, prods).collect()] == [2]


def test_duplicate_members_all_rows(spark):
    df = spark.createDataFrame([(1, 5, 1.0), (1, 5, 2.0), (1, 6, 1.0), (None, 7, 1.0), (None, 7, 3.0)],
                               "booking_id long, product_id long, v double")
    got = [(r.booking_id, r.product_id, r.v, r.dup_count) for r in
           duplicate_members(df, ["booking_id", "product_id"]).collect()]
    assert len(got) == 4 and all(r[3] == 2 for r in got)


def test_reconcile(spark):
    tx = spark.createDataFrame([(1, 100.0, 5.0, 0.0), (2, 100.0, 0.0, 10.0), (3, 50.0, 0.0, 0.0)],
                               "booking_id long, total_amount double, shipment_fee double, promo_amount double")
    tx = tx.select("booking_id", *[F.col(c).cast("decimal(18,2)").alias(c)
                                   for c in ("total_amount", "shipment_fee", "promo_amount")])
    lines = spark.createDataFrame([(1, 95.0), (2, 109.99)], "booking_id long, product_amount double")
    got = {float(r.difference): r.bookings for r in reconcile_totals(tx, lines).collect()}
    assert got == {0.0: 1, 0.01: 1}     # exact match, off by a cent; booking 3 has no lines


def test_once_per_session(spark):
    ev = spark.createDataFrame([(1, "b"), (1, "b"), (2, "b"), (None, "b"), (3, "a")], "session_id long, event_name string")
    r = once_per_session(ev, "b").first()
    assert (r.total, r.unique_sessions, r.missing_sessions) == (4, 2, 1)
