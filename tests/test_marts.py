import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from shopstat.operators import clean, marts


def _mart_inputs(spark):
    day = dt.datetime(2020, 1, 1)
    rows = [(b, "s", c, day + dt.timedelta(days=d), day, 1.0, 0.0, None, "CARD", "OK", 10.0) for b, c, d in
            [("b1", 1, 0), ("b2", 1, 1), ("b2", 1, 1), ("b2", 2, 5), ("b3", 2, 3), ("b4", 3, 0), ("b5", 9, 0)]]
    tx = clean.transactions_clean(spark.createDataFrame(
        rows, "booking_id string, session_id string, customer_id bigint, created_at timestamp_ntz, shipment_date_limit timestamp_ntz, "
              "shipment_fee double, promo_amount double, promo_code string, payment_method string, payment_status string, total_amount double"))
    customers = spark.createDataFrame([(1, dt.date(1980, 1, 1)), (2, None), (3, None), (3, dt.date(1990, 1, 1))], "customer_id bigint, birthdate date")
    lines = spark.createDataFrame([("b1", 1, 1), ("b2", 1, 2), ("b2", 2, 1), ("b3", 1, 1), ("b4", 2, 1), ("b5", 1, 1)], "booking_id string, product_id bigint, quantity bigint")
    products = spark.createDataFrame([(1, "Men"), (2, "Women")], "prod_id bigint, gender string")
    return tx, customers, lines, products


def test_repeated_booking_and_customer_ids_keep_their_rows(spark):
    tx, customers, lines, products = _mart_inputs(spark)
    summary = marts.booking_product_summary(lines, products)
    base = marts.dm_transactions(tx, customers, summary, with_booking_number=False)
    numbered = marts.dm_transactions(tx, customers, summary)
    assert numbered.count() == base.count() == 7        # b4's customer stands twice, b5's is unknown
    order = Window.partitionBy("customer_id").orderBy("created_dt", "booking_id")
    want = base.withColumn("booking_number", F.row_number().over(order))
    key = ["customer_id", "created_dt", "booking_id", "booking_number"]
    assert sorted(map(tuple, numbered.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))


def test_lines_are_read_once(spark, tmpdir_path):
    tx, customers, lines, products = _mart_inputs(spark)
    lines.write.parquet(f"{tmpdir_path}/lines")
    summary = marts.booking_product_summary(spark.read.parquet(f"{tmpdir_path}/lines"), products)
    mart = marts.dm_transactions(tx, customers, summary)
    plan = mart._jdf.queryExecution().optimizedPlan().toString()
    assert "product_id" not in plan and "lines" not in plan      # the written mart stands in for the joins
