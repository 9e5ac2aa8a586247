"""SRC06 / SRC08 / FN20 / EX02: tables of frames and of anchor events, columns found by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coincide.functions.display import text
from coincide.functions.frames import frame_kind, int_or_none
from coincide.functions.let import once
from coincide.functions.mac import client_of_target, norm_mac
from coincide.functions.reasons import reason_text
from coincide.functions.times import finalize, parse_any
from coincide.params import AnalysisParams, micros
from coincide.schema import BROADCAST, categorize
from coincide.sources.lines import lines_in_place, records_of

# The names each field goes by.
FRAME_FIELDS = {
    "timestamp": (
        "timestamp", "time", "ts", "datetime", "date_time", "created_at", "first_seen", "seen_at",
        "frame.time_epoch", "frame.time", "_ws.col.time",
    ),
    "src_mac": (
        "transmitter", "transmitter_address", "source", "source_mac", "src", "src_mac", "sender",
        "station", "addr2", "wlan.ta", "wlan.sa", "transmitter_mac",
    ),
    "dst_mac": (
        "destination", "destination_address", "dest", "dst", "dst_mac", "receiver",
        "receiver_address", "target", "addr1", "wlan.da", "wlan.ra", "destination_mac",
    ),
    "bssid": ("bssid", "ap", "ap_mac", "addr3", "wlan.bssid", "access_point"),
    "subtype": (
        "subtype", "frame_subtype", "type", "frame_type", "wlan.fc.type_subtype", "frametype",
        "kind", "event", "event_type", "alert_type",
    ),
    "reason_code": (
        "reason", "reason_code", "wlan.fixed.reason_code", "wlan_mgt.fixed.reason_code",
        "reasoncode",
    ),
    "channel": ("channel", "chan", "wlan_radio.channel", "frequency"),
    "signal": ("signal", "rssi", "signal_strength", "wlan_radio.signal_dbm", "power", "signal_dbm"),
    "ssid": ("ssid", "essid", "network", "wlan.ssid"),
}
CAMERA_FIELDS = {
    "timestamp": (
        "timestamp", "time", "datetime", "date_time", "event_time", "ts", "date", "start",
        "start_time", "recorded", "captured",
    ),
    "plate": ("plate", "license", "license_plate", "tag", "reg", "registration", "plate_number"),
    "make": ("make", "manufacturer", "vehicle_make", "brand"),
    "model": ("model", "vehicle_model", "type", "vehicle_type"),
    "notes": (
        "notes", "note", "comment", "comments", "description", "detail", "details", "remarks",
        "observation",
    ),
    "clip": ("clip", "file", "filename", "video", "path", "recording", "clip_path"),
}
HEADERLESS_CAMERA = ("timestamp", "plate", "make", "model", "notes")
BROADCAST_NOTE = "broadcast deauth - disconnects every client on the BSS"

def read_records(spark: SparkSession, paths: list[str], delimiter: str = ",", chunks: int | None = None) -> DataFrame:
    """(path, mtime_us, row_no, fields) of delimited files, with all columns and blank cells.

    Files stay splittable although quoted cells may hold line breaks; blank lines count as rows.
    ``chunks`` deals the files into so many groups that are read one beside the other.
    """
    return records_of(lines_in_place(spark, paths), delimiter, chunks)


def clean_header(fields: Column) -> Column:
    return F.transform(
        fields,
        lambda h: F.lower(F.replace(F.trim(F.regexp_replace(h, '^﻿?\\s*"?|"?\\s*$', "")), F.lit(" "), F.lit("_"))),
    )


def synonym_map(
    header: Column, fields: dict[str, tuple[str, ...]], overrides: dict[str, str] | None = None
) -> Column:
    """FN20 / EX02: field to 1-based position of the first column that goes by one of its names."""
    overrides = overrides or {}

    def position(field: str, names: tuple[str, ...]) -> Column:
        found = F.array_position(F.transform(header, lambda h: h.isin(*names)), True)
        if field in overrides:
            wanted = F.array_position(header, overrides[field].strip().lower().replace(" ", "_"))
            found = F.when(wanted > 0, wanted).otherwise(found)
        return F.nullif(found, F.lit(0)).cast("int")

    return F.struct(*[position(f, names).alias(f) for f, names in fields.items()])


def _mapped(
    records: DataFrame, fields: dict[str, tuple[str, ...]], overrides: dict[str, str] | None = None
) -> DataFrame:
    """Records with ``at`` (positions of the file's fields), one lookup row per file.

    Cells and positions are computed once: filters on them stay above that work and are not copied
    into a filter of every row of the input.
    """
    heads = records.filter("row_no = 1").select("path", F.col("fields").alias("header"))
    headers = once(heads, "at", synonym_map(clean_header(F.col("header")), fields, overrides))
    others = [c for c in records.columns if c != "fields"]
    split = once(records.select(*others, F.col("fields").alias("split")), "fields", F.col("split")).drop("split")
    return split.join(headers, "path")


def _cell(field: str) -> Column:
    return F.coalesce(F.trim(F.get("fields", F.col(f"at.{field}") - 1)), F.lit(""))


def _blank() -> Column:
    return ~F.exists("fields", lambda f: F.trim(f) != "")


def _year(params: AnalysisParams) -> Column:
    return F.lit(params.log_year) if params.log_year else F.year(F.current_timestamp())


def frame_rows(
    records: DataFrame, params: AnalysisParams, overrides: dict[str, str] | None = None
) -> DataFrame:
    """SRC06: deauthentication and disassociation rows of a frame table."""
    mapped = _mapped(records, FRAME_FIELDS, overrides).filter(
        _unusable() | (F.col("at.timestamp").isNotNull() & (F.col("row_no") > 1) & ~_blank())
    )
    when = finalize(
        parse_any(_cell("timestamp"), _year(params)), params.timezone, params.assume_offset
    )
    dated = once(
        mapped,
        "x",
        F.struct(when.alias("when"), frame_kind(_cell("subtype"), _cell("reason_code")).alias("kind")),
    )
    target, reason = norm_mac(_cell("dst_mac")), int_or_none(_cell("reason_code"))
    return dated.filter(F.col("x.when").isNull() | F.col("x.kind").isNotNull()).select(
        "x.when.*",
        "x.kind",
        categorize(F.col("x.kind")).alias("category"),
        norm_mac(_cell("src_mac")).alias("src_mac"),
        target.alias("dst_mac"),
        norm_mac(_cell("bssid")).alias("bssid"),
        client_of_target(target).alias("client_mac"),
        reason.alias("reason_code"),
        reason_text(reason).alias("reason_text"),
        int_or_none(_cell("channel")).alias("channel"),
        int_or_none(_cell("signal")).alias("signal"),
        F.when(target == BROADCAST, BROADCAST_NOTE).otherwise(text(_cell("ssid"))).alias("notes"),
        *_lineage(",", "nzyme_csv", F.col("x.when").isNotNull()),
        _reject(F.col("x.when")),
    )


def _unusable() -> Column:
    """The header row of a file without a time column; it stands for the whole file."""
    return F.col("at.timestamp").isNull() & (F.col("row_no") == 1)


def _reject(when: Column) -> Column:
    return (
        F.when(F.col("at.timestamp").isNull(), "no timestamp column")
        .when(when.isNull(), "unreadable timestamp")
        .alias("reject")
    )


def _lineage(delimiter: str, kind: str, read: Column) -> list[Column]:
    ref = F.concat(F.lit("row "), F.col("row_no").cast("string"))
    return [
        F.col("path").alias("source_file"),
        F.col("row_no").alias("ordinal"),
        F.when(read, ref).alias("source_ref"),
        F.array_join("fields", delimiter).alias("raw"),
        F.lit(kind).alias("source_kind"),
    ]


def camera_rows(records: DataFrame, params: AnalysisParams, delimiter: str = ",") -> DataFrame:
    """SRC08: anchor events of a pass log, with or without a header row."""
    mapped = _mapped(records, CAMERA_FIELDS)
    bare = F.col("at.timestamp").isNull()
    first_reads = parse_any(F.get("header", F.lit(0)), _year(params)).isNotNull()
    fixed = F.struct(
        *[
            F.lit(HEADERLESS_CAMERA.index(f) + 1 if f in HEADERLESS_CAMERA else None).cast("int").alias(f)
            for f in CAMERA_FIELDS
        ]
    )
    placed = once(mapped, "headerless", bare & first_reads).withColumn(
        "at", F.when(F.col("headerless"), fixed).otherwise(F.col("at"))
    )
    body = (F.col("headerless") | (F.col("row_no") > 1)) & ~_blank()
    rows = placed.filter(_unusable() | (F.col("at.timestamp").isNotNull() & body))
    when = finalize(
        parse_any(_cell("timestamp"), _year(params)),
        params.timezone,
        params.assume_offset,
        micros(params.camera_clock_offset_s),
    )
    clip = F.when(_cell("clip") != "", F.concat(F.lit(" [clip: "), _cell("clip"), F.lit("]")))
    dated = F.col("when").isNotNull()

    def known(value: Column, name: str) -> Column:
        return F.when(dated, value).alias(name)

    return once(rows, "when", when).select(
        "when.*",
        known(F.lit("camera"), "kind"),
        known(F.lit("camera"), "category"),
        *[known(text(_cell(f)), f) for f in ("plate", "make", "model")],
        known(text(F.concat(_cell("notes"), F.coalesce(clip, F.lit("")))), "notes"),
        *_lineage(delimiter, "camera_csv", dated),
        _reject(F.col("when")),
    )


def read_frames(
    spark: SparkSession,
    paths: list[str],
    params: AnalysisParams,
    overrides: dict[str, str] | None = None,
) -> DataFrame:
    return frame_rows(read_records(spark, paths), params, overrides)


def read_camera(spark: SparkSession, paths: list[str], params: AnalysisParams) -> DataFrame:
    tabs = [p for p in paths if p.lower().endswith(".tsv")]
    commas = [p for p in paths if p not in tabs]
    parts = [
        camera_rows(read_records(spark, some, sep), params, sep)
        for some, sep in ((commas, ","), (tabs, "\t"))
        if some
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
