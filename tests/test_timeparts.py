import datetime as dt

from pyspark.sql import functions as F

from shopstat.functions.timeparts import days_between_boundaries, days_elapsed, floor_second, parse_timestamp


def test_days_boundaries_vs_elapsed(spark):
    rows = [(dt.datetime(2024, 1, 1, 23, 59, 59), dt.datetime(2024, 1, 2, 0, 0, 1)),
            (dt.datetime(2024, 1, 1, 12, 0, 1), dt.datetime(2024, 1, 1, 12, 0, 0)),
            (dt.datetime(2024, 1, 1, 0, 0, 0), dt.datetime(2024, 1, 3, 0, 0, 0))]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    got = df.select(days_between_boundaries(F.col("a"), F.col("b")).alias("d"),
                    days_elapsed(F.col("a"), F.col("b")).alias("e")).collect()
    assert [(r.d, r.e) for r in got] == [(1, 0), (0, -1), (2, 2)]


def test_floor_second_and_parse(spark):
    df = spark.createDataFrame([("2024-03-01 10:11:12.987",), ("not a time",)], "t string")
    got = df.select(floor_second(parse_timestamp(F.col("t"), lenient=True)).alias("x")).collect()
    assert got[0].x == dt.datetime(2024, 3, 1, 10, 11, 12)
    assert got[1].x is None
    assert dict(df.select(floor_second(parse_timestamp(F.col("t"), lenient=True)).alias("x")).dtypes)["x"] \
        == "timestamp_ntz"
