"""Queries that read the ``events`` table as a stream and append their rows to files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from coincide.params import micros
from coincide.plans.eventmap import canonical, read_events
from coincide.plans.queries import FLOOD_K, FLOOD_WINDOW, FRAMES, SIX_HOURS, WIDE_GAP, query
from coincide.plans.text_queries import _notifications
from coincide.session import shared_dir
from coincide.streaming import incidents as live
from coincide.streaming import motion

DELAY, SLIDE, SLOT = micros(60), micros(300), micros(3600)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = read_events(spark, sf_dir).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def landed(rows: DataFrame) -> DataFrame:
    """What the stream has appended once its input is read and the watermark has settled."""
    spark = rows.sparkSession
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    motion.write_events(rows, f"{out}/rows", f"{out}/checkpoint", "parquet").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/rows")


@query
def stx1_incidents(spark, sf_dir):
    """Incidents that the last watermark has closed."""
    seen = canonical(event_stream(spark, sf_dir), view_resets=True, types=("error", "view"))
    with live.sessions_merged_early(spark):
        found = landed(live.incident_stream(seen, WIDE_GAP, DELAY))
    return found.selectExpr(
        "case_id", "start_us", "end_us", "n_events", "array_join(kinds, ',') AS kinds", "array_join(src_macs, ',') AS src_macs",
        "array_join(client_macs, ',') AS client_macs", "array_join(cast(reason_codes AS array<string>), ',') AS reason_codes",
        "array_join(sources, ',') AS sources", "has_deauth",
    )


@query
def stx2_alerts(spark, sf_dir):
    """Windows with as many frames as a flood, on a grid of five minutes."""
    seen = canonical(event_stream(spark, sf_dir), types=FRAMES)
    return landed(live.flood_alerts(seen, FLOOD_WINDOW, FLOOD_K, SLIDE, DELAY))


@query
def str02_ordered(spark, sf_dir):
    """Motion events debounced in order of time, as far as the last watermark reaches."""
    seen = motion.motion_events(_notifications(event_stream(spark, sf_dir)))
    with motion.rocksdb_state(spark):
        kept = landed(motion.debounce_ordered(seen, SIX_HOURS, DELAY, SLOT))
    return kept.select("camera", "ts_us", "seq")
