"""Click events rolled up into sessions.

The rollup is one conditional aggregate on ``(session, source)`` followed by
a window over the aggregated rows on ``session``: one scan and two
exchanges, the first of which moves partial aggregates rather than events.
A session holding a third of all events is reduced map-side before any
shuffle, and the window only sees one row per (session, source).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopstat.functions.timeparts import floor_second


def clean_clicks(events: DataFrame, time_col: str = "event_time") -> DataFrame:
    """Event times floored to whole seconds (wall clock, UTC)."""
    return events.withColumn(time_col, floor_second(F.col(time_col)))


def event_aggregates(counted: Sequence[str], markers: Sequence[str], step2: Sequence[str], step3: Sequence[str],
                     name: Column, ts: Column, event_id: Column, totals: Sequence[str]) -> list[Column]:
    """Per event its count and times, then the totals under the given names:
    events, first and last time, first time of each step set."""
    aggs = []
    for e in sorted(set(counted) | set(markers)):
        t_e = F.when(name == F.lit(e), ts)
        if e in markers and e not in counted:
            aggs.append(F.min(t_e).alias(f"{e}_time"))
        else:
            aggs += [F.count(t_e).cast("int").alias(f"{e}_cnt"), F.min(t_e).alias(f"{e}_first_time"),
                     F.max(t_e).alias(f"{e}_last_time")]
    values = [F.count(event_id).cast("int"), F.min(ts), F.max(ts), F.min(F.when(name.isin(list(step2)), ts)),
              F.min(F.when(name.isin(list(step3)), ts))]
    return aggs + [v.alias(n) for v, n in zip(values, totals)]


def session_rollup(
    events: DataFrame,
    counted: Sequence[str],
    markers: Sequence[str],
    step2: Sequence[str],
    step3: Sequence[str],
    session_col: str = "session_id",
    source_col: str = "traffic_source",
    name_col: str = "event_name",
    time_col: str = "event_time",
    id_col: str = "event_id",
    pre_partition: bool = False,
) -> DataFrame:
    """One row per (session, traffic source).

    For each counted event ``e``: ``e_cnt`` (events of that name with a
    time), ``e_first_time``, ``e_last_time``; for each marker event only
    ``e_time`` (first).  Session-wide columns, computed across all sources of
    the session: ``session_events_cnt`` (event ids), ``session_start_time``,
    ``session_end_time``, ``step2_time``, ``step3_time`` (first event of
    each step set).  Rows without a session are ignored; rows without a
    source count towards the session totals but get no row of their own.

    ``pre_partition`` shuffles raw events by session first (one exchange
    instead of two); it is only better when sessions are small and evenly
    sized, since it gives up the map-side reduction.
    """
    name, ts = F.col(name_col), F.col(time_col)
    ev = events.filter(F.col(session_col).isNotNull())
    if pre_partition:
        ev = ev.repartition(session_col)
    aggs = event_aggregates(counted, markers, step2, step3, name, ts, F.col(id_col),
                            ("_ids", "_start", "_end", "_step2", "_step3"))
    per_source = ev.groupBy(session_col, source_col).agg(*aggs)
    w = Window.partitionBy(session_col)
    rolled = per_source.withColumns({
        "session_events_cnt": F.sum("_ids").over(w).cast("int"),
        "session_start_time": F.min("_start").over(w),
        "session_end_time": F.max("_end").over(w),
        "step2_time": F.min("_step2").over(w),
        "step3_time": F.min("_step3").over(w),
    })
    return rolled.filter(F.col(source_col).isNotNull()).drop("_ids", "_start", "_end", "_step2", "_step3")


def session_flags(sessions: DataFrame, counted: Sequence[str], markers: Sequence[str],
                  session_col: str = "session_id", source_col: str = "traffic_source") -> DataFrame:
    """0/1 flags per event: a counted event occurred / a marker has a time."""
    flags = []
    for e in sorted(set(counted) | set(markers)):
        if e in counted:
            cond = F.col(f"{e}_cnt") > 0
        else:
            cond = F.col(f"{e}_time").isNotNull()
        flags.append(F.when(cond, 1).otherwise(0).alias(f"has_{e}"))
    return sessions.select(
        session_col, source_col, *flags,
        "session_events_cnt", "session_start_time", "session_end_time",
    )


def funnel(sessions: DataFrame, booking_event: str, source_col: str = "traffic_source") -> DataFrame:
    """Sessions reaching each step (start -> step 2 -> step 3 -> booking) per source."""
    return sessions.groupBy(source_col).agg(
        F.count(F.lit(1)).alias("sessions"),
        F.count("session_start_time").alias("started"),
        F.count("step2_time").alias("step2_sessions"),
        F.count("step3_time").alias("step3_sessions"),
        F.count(f"{booking_event}_time").alias("booking_sessions"),
    )
