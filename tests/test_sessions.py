import datetime as dt

from pyspark.sql import functions as F

from shopstat.operators.sessions import clean_clicks, funnel, session_flags, session_rollup

COUNTED, MARKERS, STEP2, STEP3 = ["click", "view"], ["purchase", "signup"], ["click", "view"], ["signup"]
T0 = dt.datetime(2024, 1, 1, 10, 0, 0)


def _events(spark):
    rows = [
        (1, 100, "click", T0.replace(microsecond=900000), "WEB"),
        (2, 100, "click", T0.replace(second=5), "MOBILE"),        # same session, second source
        (3, 100, "view", T0.replace(second=7), "WEB"),
        (4, 100, "signup", T0.replace(second=9), "WEB"),
        (5, 100, "other", T0.replace(second=11), "WEB"),          # outside all sets
        (6, 100, "click", None, "WEB"),                           # no time: not counted, id counted
        (7, None, "click", T0, "WEB"),                            # no session: ignored
        (8, 200, "purchase", T0.replace(minute=5), "MOBILE"),
        (9, 100, "view", T0.replace(second=20), None),            # no source: totals only
    ]
    df = spark.createDataFrame(rows, "event_id long, session_id long, event_name string, "
                                     "event_time timestamp_ntz, traffic_source string")
    return clean_clicks(df)


def test_rollup_semantics(spark):
    s = session_rollup(_events(spark), COUNTED, MARKERS, STEP2, STEP3)
    rows = {(r.session_id, r.traffic_source): r for r in s.collect()}
    assert set(rows) == {(100, "WEB"), (100, "MOBILE"), (200, "MOBILE")}
    web = rows[(100, "WEB")]
    assert web.click_cnt == 1 and web.view_cnt == 1
    assert web.click_first_time == T0                      # sub-second floored
    assert web.signup_time == T0.replace(second=9) and web.purchase_time is None
    # session-wide totals span both sources and the source-less event
    for key in [(100, "WEB"), (100, "MOBILE")]:
        r = rows[key]
        assert r.session_events_cnt == 7
        assert r.session_start_time == T0 and r.session_end_time == T0.replace(second=20)
        assert r.step2_time == T0 and r.step3_time == T0.replace(second=9)
    assert rows[(100, "MOBILE")].click_cnt == 1


def test_rollup_totals_equal_sum_over_sources(spark):
    ev = _events(spark).filter(F.col("traffic_source").isNotNull() & F.col("session_id").isNotNull())
    s = session_rollup(ev, COUNTED, MARKERS, STEP2, STEP3)
    per_session = s.groupBy("session_id").agg(F.sum("click_cnt").alias("c")).orderBy("session_id").collect()
    direct = (ev.filter((F.col("event_name") == "click") & F.col("event_time").isNotNull())
              .groupBy("session_id").count().orderBy("session_id").collect())
    assert [(r.session_id, r.c) for r in per_session if r.c] == [(r.session_id, r["count"]) for r in direct]


def test_flags_and_funnel(spark):
    s = session_rollup(_events(spark), COUNTED, MARKERS, STEP2, STEP3)
    f = {(r.session_id, r.traffic_source): r for r in session_flags(s, COUNTED, MARKERS).collect()}
    assert f[(100, "WEB")].has_click == 1 and f[(100, "WEB")].has_signup == 1 and f[(100, "WEB")].has_purchase == 0
    assert f[(200, "MOBILE")].has_purchase == 1 and f[(200, "MOBILE")].has_click == 0
    fun = {r.traffic_source: r for r in funnel(s, "purchase").collect()}
    assert fun["MOBILE"].sessions == 2 and fun["MOBILE"].booking_sessions == 1 and fun["WEB"].step3_sessions == 1


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


def test_rollup_plan_exchanges(spark):
    ev = _events(spark)
    default = session_rollup(ev, COUNTED, MARKERS, STEP2, STEP3)
    one = session_rollup(ev, COUNTED, MARKERS, STEP2, STEP3, pre_partition=True)
    assert _exchanges(default) == 2
    assert _exchanges(one) == 1
    assert sorted(map(tuple, default.collect())) == sorted(map(tuple, one.collect()))
