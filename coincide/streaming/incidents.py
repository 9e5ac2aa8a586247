"""STX1 and STX2: incidents and flood alerts while events come in.

Both keep state per open session or window and give it up once the watermark, the latest event time
less ``delay_us``, has passed its end. So state is bounded by the rows of that delay (and of the gap or
window), however long the stream runs, and every result appears once, complete, in append mode. A row
that is older than the watermark of an earlier trigger is late and left out. The latest event time is that
of the rows a rule looks at (disruptions, frames); Spark keeps it in whole milliseconds, rounded down.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coincide.operators.incidents import rollup
from coincide.schema import disruptions, frames

EVENT_TIME = "event_time"
MERGE_EARLY = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def timed(events: DataFrame, delay_us: int) -> DataFrame:
    """Events with their time as a timestamp that carries the watermark."""
    return events.withColumn(EVENT_TIME, F.timestamp_micros("ts_us")).withWatermark(EVENT_TIME, f"{delay_us} microseconds")


def incident_stream(events: DataFrame, gap_us: int, delay_us: int) -> DataFrame:
    """STX1: the rows of ``incidents``, each as soon as nothing can join it any more.

    An incident goes on as long as no pause is *longer* than the gap, which is when sessions merge. A row at or
    before the watermark is late: it is left out if its session would be over, else it may stand alone.
    A case's sessions meet in one task; run it under ``sessions_merged_early``, so that these are not its rows.
    """
    session = F.session_window(EVENT_TIME, f"{gap_us} microseconds")
    start = F.min("ts_us").alias("start_us")
    return (
        timed(disruptions(events), delay_us)
        .groupBy("case_id", session)
        .agg(start, *rollup())
        .drop("session_window")
    )


@contextmanager
def sessions_merged_early(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside merge the sessions of a task before the shuffle, which else moves a session for
    every row; the session's own setting holds again afterwards."""
    before = spark.conf.get(MERGE_EARLY, None)
    spark.conf.set(MERGE_EARLY, "true")
    try:
        yield
    finally:
        spark.conf.set(MERGE_EARLY, before) if before else spark.conf.unset(MERGE_EARLY)


def flood_alerts(
    events: DataFrame, window_us: int, threshold: int, slide_us: int, delay_us: int
) -> DataFrame:
    """STX2: windows of ``window_us + slide_us`` that start every ``slide_us`` and hold ``threshold`` frames.

    DV03 looks at the ``window_us`` before each frame. A window one slide longer holds any such stretch
    whole, so no flood goes without an alert; in turn an alert may come from frames that are up to one
    slide further apart than a flood allows. Alerts are windows, not bursts: a long flood raises many.
    """
    window = F.window(EVENT_TIME, f"{window_us + slide_us} microseconds", f"{slide_us} microseconds")
    return (
        timed(frames(events), delay_us)
        .groupBy("case_id", window)
        .agg(F.count(F.lit(1)).alias("n_frames"))
        .where(F.col("n_frames") >= threshold)
        .select("case_id", F.unix_micros("window.start").alias("start_us"), F.unix_micros("window.end").alias("end_us"), "n_frames")
    )
