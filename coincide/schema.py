"""The canonical event table that every source produces and every operator reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Kinds and categories of events.
CAMERA = "camera"
DISRUPTION = "disruption"
CONTEXT = "context"
DISRUPTION_KINDS = ("deauth", "disassoc", "client_drop", "link_reset", "alert")
FRAME_KINDS = ("deauth", "disassoc")
DROP_KINDS = ("client_drop", "link_reset")
BROADCAST = "ff:ff:ff:ff:ff:ff"

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("case_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts_us", T.LongType()),
        T.StructField("ts_utc", T.TimestampType()),
        T.StructField("ts_local", T.TimestampNTZType()),
        T.StructField("utc_offset", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("subtype", T.StringType()),
        T.StructField("src_mac", T.StringType()),
        T.StructField("dst_mac", T.StringType()),
        T.StructField("bssid", T.StringType()),
        T.StructField("client_mac", T.StringType()),
        T.StructField("reason_code", T.IntegerType()),
        T.StructField("reason_text", T.StringType()),
        T.StructField("channel", T.IntegerType()),
        T.StructField("signal", T.IntegerType()),
        T.StructField("plate", T.StringType()),
        T.StructField("make", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("notes", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("source_kind", T.StringType()),
        T.StructField("source_ref", T.StringType()),
        T.StructField("raw", T.StringType()),
    ]
)

# Rows derived from other rows sort after every ingested row of the same instant.
DERIVED_SEQ = 1 << 62


def categorize(kind: Column) -> Column:
    """FN06: category of an event kind."""
    return (
        F.when(kind == CAMERA, CAMERA)
        .when(kind.isin(*DISRUPTION_KINDS), DISRUPTION)
        .otherwise(CONTEXT)
    )


def conform(df: DataFrame) -> DataFrame:
    """Give ``df`` exactly the canonical columns, filling absent ones with NULL."""
    have = set(df.columns)
    return df.selectExpr(
        *[
            f"CAST({f.name if f.name in have else 'NULL'} AS {f.dataType.simpleString()}) AS {f.name}"
            for f in EVENT_SCHEMA
        ]
    )


def anchors(events: DataFrame) -> DataFrame:
    """FL01: rows of the anchor stream."""
    return events.filter(F.col("category") == CAMERA)


def is_disruption() -> Column:
    return F.col("category") == DISRUPTION


def disruptions(events: DataFrame) -> DataFrame:
    """FL02: rows of the disruption stream."""
    return events.filter(is_disruption())


def is_frame() -> Column:
    return F.col("kind").isin(*FRAME_KINDS)


def frames(events: DataFrame) -> DataFrame:
    """FL03: deauthentication and disassociation frames."""
    return events.filter(is_frame())


def is_drop() -> Column:
    return F.col("kind").isin(*DROP_KINDS)


def drops(events: DataFrame) -> DataFrame:
    """FL04: client drops and link resets."""
    return events.filter(is_drop())


def in_period(ts: Column, lo: Column, hi: Column) -> Column:
    """FL05: inclusive at both ends."""
    return (ts >= lo) & (ts <= hi)
