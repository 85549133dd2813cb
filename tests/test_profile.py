import datetime as dt

import pytest

from shopstat.operators import profile
from shopstat.operators.profile import (birth_year_counts, box_stats, column_profile, count_by, daily_counts,
                                        describe, event_ratio, head_tail, histogram, outliers_iqr,
                                        rolling_mean, sample_rows, value_counts)


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 5, 9, 10]], "x double")
    got = {r.bin: r.cnt for r in histogram(df, "x", 10).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0, 6: 1, 7: 0, 8: 0, 9: 0, 10: 2}
    edges = {r.bin: (r.bin_start, r.bin_end) for r in histogram(df, "x", 10).collect()}
    assert edges[1] == (0.0, 1.0) and edges[10] == (9.0, 10.0)


def test_histogram_of_one_value_and_of_none(spark):
    one = spark.createDataFrame([(5.0,), (5.0,), (None,)], "x double")
    got = histogram(one, "x", 4).orderBy("bin").collect()
    assert [r.cnt for r in got] == [0, 0, 2, 0] and (got[0].bin_start, got[3].bin_end) == (4.5, 5.5)
    assert histogram(one.filter("x IS NULL"), "x", 4).collect() == []


def test_histogram_timestamps(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(t0,), (t0 + dt.timedelta(days=1),)], "t timestamp_ntz")
    assert {r.bin: r.cnt for r in histogram(df, "t", 50).collect() if r.cnt} == {1: 1, 50: 1}


def test_box_and_outliers(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 100.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r = box_stats(df, "x").first()
    assert (r.q1, r.median, r.q3) == (3.0, 5.0, 7.0)
    assert (r.lower_fence, r.upper_fence, r.whisker_low, r.whisker_high, r.fliers) == (-3.0, 13.0, 1.0, 8.0, 1)
    assert [o.x for o in outliers_iqr(df, "x").collect()] == [100.0]


def test_describe_and_profile(spark):
    df = spark.createDataFrame([(1, 2.0, "a"), (2, None, "a"), (3, 4.0, None)], "a int, b double, c string")
    d = {r.column_name: r for r in describe(df, ["a", "b"]).collect()}
    assert d["a"]["count"] == 3 and d["a"].p50 == 2.0 and d["b"]["count"] == 2 and d["b"].p25 == 2.5
    p = {r.column_name: r for r in column_profile(df).collect()}
    assert (p["b"].non_null, p["b"].nulls, p["c"].distinct_values, p["a"].data_type) == (2, 1, 1, "int")


def test_value_counts_and_count_by(spark):
    df = spark.createDataFrame([("x", 1), ("y", 2), ("x", None), (None, 3)], "k string, v int")
    assert [(r.k, r.cnt) for r in value_counts(df, "k").collect()] == [("x", 2), ("y", 1)]
    assert [(r.k, r.cnt) for r in value_counts(df, "k", dropna=False, by_key=True).collect()] == \
        [("x", 2), ("y", 1), (None, 1)]
    assert [(r.k, r.cnt) for r in count_by(df, "k", "v").collect()] == [("x", 1), ("y", 1)]


def test_birth_years_unknown_last(spark):
    df = spark.createDataFrame([(1, dt.datetime(1990, 5, 1)), (2, None), (3, dt.datetime(1980, 1, 1)),
                                (4, dt.datetime(1990, 1, 1))], "customer_id long, birthdate timestamp_ntz")
    assert [(r.birth_year, r.count_customers) for r in birth_year_counts(df).collect()] == \
        [("1980", 1), ("1990", 2), ("Unknown", 1)]


def test_daily_and_rolling(spark):
    base = dt.datetime(2024, 1, 1, 12)
    rows = []
    for d in list(range(5)) + [9, 10, 11]:       # gap in dates; rows present, not calendar days
        rows += [(base + dt.timedelta(days=d), "A")] * (d + 1)
        if d % 2 == 0:
            rows.append((base + dt.timedelta(days=d), "B"))
    df = spark.createDataFrame(rows, "ts timestamp_ntz, m string")
    daily = daily_counts(df, "ts", "m").withColumnRenamed("m", "payment_method")
    assert daily.count() == 16
    r = {(x.day, x.payment_method): x for x in rolling_mean(daily, 7).collect()}
    day = lambda d: (base + dt.timedelta(days=d)).date()
    assert r[(day(4), "A")].rolling_7 is None
    # rows present: days 0,1,2,3,4,9,10,11
    assert r[(day(10), "A")].rolling_7 == pytest.approx((1 + 2 + 3 + 4 + 5 + 10 + 11) / 7)
    assert r[(day(11), "A")].rolling_7 == pytest.approx((2 + 3 + 4 + 5 + 10 + 11 + 12) / 7)
    assert r[(day(11), "B")].rolling_7 == pytest.approx(3 / 7)
    assert r[(day(1), "B")].cnt == 0


def test_ratio_head_tail_sample(spark):
    ev = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "a", 2), (4, "b", 1)],
                               "event_id long, event_name string, session_id long")
    assert [(r.event_name, r.ratio) for r in event_ratio(ev).collect()] == [("a", 1.5), ("b", 1.0)]
    ht = head_tail(ev, ["event_id"], 2).collect()
    assert sorted((r.part, r.event_id) for r in ht) == [("head", 1), ("head", 2), ("tail", 3), ("tail", 4)]
    s1 = [r.event_id for r in sample_rows(ev, "event_id", 2).collect()]
    assert s1 == [r.event_id for r in sample_rows(ev, "event_id", 2).collect()] and len(s1) == 2


def test_approximate_modes(spark):
    from shopstat.operators.marts import order_unique_products
    from shopstat.operators.profile import quantile_table
    df = spark.range(0, 1001).selectExpr("id % 10 AS booking_id", "id AS product_id", "CAST(id AS DOUBLE) AS x")
    got = {r.q: r.value for r in quantile_table(df, "x", [0.0, 0.5, 1.0], approx=True).collect()}
    assert got[0.0] == 0.0 and got[1.0] == 1000.0 and abs(got[0.5] - 500.0) <= 1.0
    exact = {r.booking_id: r.unique_prods for r in order_unique_products(df).collect()}
    approx = {r.booking_id: r.unique_prods for r in order_unique_products(df, approx=True).collect()}
    assert all(abs(approx[k] - exact[k]) <= 0.1 * exact[k] for k in exact)
    p = {r.column_name: r.distinct_values for r in column_profile(df, approx=True).collect()}
    assert p["booking_id"] == 10


def test_daily_counts_cover_every_method(spark):
    day = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(day, "1-URGENT"), (day, "6-NEW"), (day, "6-NEW"), (day + dt.timedelta(days=1), None), (None, "6-NEW")],
                               "ts timestamp_ntz, m string")
    got = {(r.day, r.m): r.cnt for r in daily_counts(df, "ts", "m").collect()}
    assert got[(day.date(), "6-NEW")] == 2 and got[(day.date(), "1-URGENT")] == 1
    assert daily_counts(df.limit(0), "ts", "m").collect() == []


def test_column_profile_counts_only_what_is_asked(spark):
    df = spark.createDataFrame([(1, 0.0, "a"), (1, -0.0, None)], "a int, b double, c string")
    p = {r.column_name: r for r in column_profile(df, distinct_of=["a", "b"]).collect()}
    assert (p["a"].distinct_values, p["b"].distinct_values, p["c"].distinct_values) == (1, 1, None)
    assert p["c"].nulls == 1
    plan = column_profile(df, distinct_of=[])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan            # nulls and types need no shuffle of values


def test_appended_rows_are_seen(spark, tmpdir_path):
    import os
    import shutil

    from shopstat.plans.catalog import build_queries
    src = "/root/testdata/sf0.001"
    for t in ("orders", "lineitem"):
        os.makedirs(os.path.join(tmpdir_path, f"{t}.parquet"))
        shutil.copy(f"{src}/{t}.parquet", os.path.join(tmpdir_path, f"{t}.parquet", "a.parquet"))
    count = lambda: sum(r.cnt for r in build_queries()["value_counts_status"](spark, tmpdir_path).collect())
    first = count()
    shutil.copy(f"{src}/orders.parquet", os.path.join(tmpdir_path, "orders.parquet", "b.parquet"))
    assert count() == 2 * first


def test_nan_is_missing(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 4.0, nan, None)], "v double")
    row = profile.describe(df, ["v"]).first()
    assert (row["count"], row["mean"], row["max"], row["p50"]) == (4, 2.5, 4.0, 2.5)
    box = profile.box_stats(df, "v").first()
    assert (box.median, box.whisker_low, box.whisker_high, box.fliers) == (2.5, 1.0, 4.0, 0)
    assert profile.outliers_iqr(spark.createDataFrame([(v,) for v in (1.0, 1.0, 2.0, 2.0, nan, 90.0)], "v double"), "v").collect()[0].v == 90.0
    bins = profile.histogram(spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 4.0, nan, inf, -inf)], "v double"), "v", 3).orderBy("bin").collect()
    assert [(b.bin_start, b.bin_end, b.cnt) for b in bins] == [(1.0, 2.0, 1), (2.0, 3.0, 1), (3.0, 4.0, 2)]
    empty = profile.describe(spark.createDataFrame([(nan,)], "v double"), ["v"]).first()
    assert empty["count"] == 0 and empty["p50"] is None and profile.histogram(spark.createDataFrame([(nan,)], "v double"), "v").count() == 0
