"""Incremental session rollup with Structured Streaming.

The batch rollup (``operators.sessions.session_rollup``) trusts the source's
session ids and reads the whole click stream.  For a live stream the state
of a session must expire: here sessions are ``session_window``s of the
event time per (session id, source), closed by the watermark, so each
session is emitted once (append mode) and its state dropped.  All
aggregates are count/min/max, hence incremental.

Differences from the batch rollup: events without a time cannot be placed
in a window and are ignored, and session-wide totals across sources are
not computed (each row covers one source).
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shopstat.operators.sessions import clean_clicks, event_aggregates


def streaming_session_rollup(
    events: DataFrame,
    counted: Sequence[str],
    markers: Sequence[str],
    step2: Sequence[str],
    step3: Sequence[str],
    gap: str = "30 minutes",
    watermark: str = "1 hour",
    session_col: str = "session_id",
    source_col: str = "traffic_source",
    name_col: str = "event_name",
    time_col: str = "event_time",
    id_col: str = "event_id",
) -> DataFrame:
    """Streaming DataFrame: one row per closed session window."""
    name, ts = F.col(name_col), F.col(time_col)
    # Watermarks need a zone-aware timestamp; with the session in UTC the
    # cast keeps the instant, and outputs are cast back to wall clock.
    ev = (clean_clicks(events, time_col)
          .withColumn(time_col, F.col(time_col).cast("timestamp"))
          .filter(F.col(session_col).isNotNull() & F.col(source_col).isNotNull() & ts.isNotNull())
          .withWatermark(time_col, watermark))
    aggs = event_aggregates(counted, markers, step2, step3, name, ts, F.col(id_col), (
        "session_events_cnt", "session_start_time", "session_end_time", "step2_time", "step3_time"))
    rolled = (ev.groupBy(F.session_window(ts, gap).alias("session_window"), session_col, source_col)
              .agg(*aggs))
    return rolled.select(*[
        F.col(f.name).cast("timestamp_ntz").alias(f.name) if f.dataType.typeName() == "timestamp"
        else F.col(f.name) for f in rolled.schema.fields])


def start_rollup(spark: SparkSession, rolled: DataFrame, sink_path: str,
                 checkpoint_location: str | None = None, available_now: bool = False) -> StreamingQuery:
    """Append closed sessions to a Parquet table.

    The query's progress is kept under ``checkpoint_location`` (default: a
    folder inside the session's ``spark.checkpoint.dir``), so a restarted
    job resumes exactly where it stopped.
    """
    if checkpoint_location is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            raise ValueError("set spark.checkpoint.dir or pass checkpoint_location")
        checkpoint_location = os.path.join(base, "session_rollup_stream")
    out = (rolled.withColumn("window_start", F.col("session_window.start").cast("timestamp_ntz"))
           .withColumn("window_end", F.col("session_window.end").cast("timestamp_ntz")).drop("session_window"))
    writer = (out.writeStream.outputMode("append").format("parquet")
              .option("path", sink_path).option("checkpointLocation", checkpoint_location))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
