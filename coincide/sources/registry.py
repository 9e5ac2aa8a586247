"""SRC13 / EX01: which format each file is in.

A format is an id, the roles it may fill, a score over the head of a file and a reader. Adding
one means calling :func:`register`; detection and ingest read the registry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coincide.functions.times import clip_time
from coincide.params import AnalysisParams
from coincide.sources import airodump, api_json, capture, clips, delimited, kismet, syslog
from coincide.sources.delimited import CAMERA_FIELDS, FRAME_FIELDS, clean_header, synonym_map

Reader = Callable[[SparkSession, list[str], AnalysisParams], DataFrame]

# Roles of inputs, bytes looked at, and the score below which a match is weak.
LOGS, CAPTURES, ANCHORS = "opnsense-log", "wifi-capture", "camera-events"
HEAD_BYTES = 16_384
WEAK = 0.5


@dataclass(frozen=True)
class Format:
    id: str
    role: str
    describes: str
    score: Callable[[], Column]
    read: Reader


FORMATS: dict[str, Format] = {}


def register(fmt: Format) -> None:
    FORMATS[fmt.id] = fmt


def catalog(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, mtime_us, length, head) of all files below ``paths``; only heads are read."""
    files = clips.list_files(spark, paths)
    schema = "path string, mtime_us bigint, length bigint, head binary"

    def read_heads(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as pafs

        for part in parts:
            heads = []
            for path in part["path"]:
                system, inner = pafs.FileSystem.from_uri(capture.uri_of(path))
                with system.open_input_stream(inner) as fh:
                    heads.append(fh.read(HEAD_BYTES))
            yield part.assign(head=heads)

    return files.mapInPandas(read_heads, schema)


def _name() -> Column:
    return F.lower(F.element_at(F.split("path", "/"), -1))


def _text() -> Column:
    return F.make_valid_utf8(F.col("head").cast("string"))


def _first_line() -> Column:
    return F.split(_text(), r"\r\n|\n|\r")[0]


def _header() -> Column:
    return clean_header(F.split(_first_line(), ","))


def _has(*words: str) -> Column:
    low = F.lower(_text())
    return reduce(lambda a, b: a | b, [low.contains(w) for w in words])


def _best(*scored: tuple[Column, float]) -> Column:
    return F.greatest(*[F.when(test, score).otherwise(0.0) for test, score in scored])


def _capture_score() -> Column:
    magic = F.hex(F.substring("head", 1, 4))
    return F.when(
        magic.isin("D4C3B2A1", "A1B2C3D4", "4D3CB2A1", "A1B23C4D", "0A0D0D0A"), 1.0
    ).otherwise(0.0)


def _kismet_score() -> Column:
    def table(name: str) -> Column:
        return _text().rlike(f"(?i)CREATE TABLE [\"'`]?{name}\\b")

    devices = table("devices") | table("packets")
    sqlite = F.substring(F.hex("head"), 1, 30) == "53514C69746520666F726D61742033"
    return (
        F.when(~sqlite, 0.0)
        .when(devices & (table("KISMET") | table("alerts")), 1.0)
        .when(table("packets") & table("alerts"), 0.8)
        .otherwise(0.0)
    )


def _api_score() -> Column:
    marked = _text().rlike(r'"\w+_fetch"\s*:\s*1') & _text().contains('"rows"')
    return F.when(_name().endswith(".json") & (marked | _text().rlike(r'"\w+_fetch"\s*:\s*1')), 0.98).otherwise(0.0)


def _syslog_score() -> Column:
    upper = _text()
    named = _best(
        (_has("dnsmasq"), 0.9),
        (_has("dhcpd") & upper.contains("DHCP"), 0.85),
        (_has("kea-dhcp") | upper.contains("DHCP4_LEASE"), 0.9),
        (_has("hostapd", "wpa_supplicant"), 0.8),
        (_has("opnsense"), 0.75),
    )
    framed = _first_line().rlike(syslog.RFC3164_LINE) | _first_line().rlike(syslog.RFC5424)
    return F.when(named > 0, named).when(framed, 0.4).otherwise(0.0)


def _camera_score() -> Column:
    at = synonym_map(_header(), CAMERA_FIELDS)
    vehicle = at["plate"].isNotNull() | at["make"].isNotNull() | at["model"].isNotNull()
    timed = at["timestamp"].isNotNull()
    noted = at["notes"].isNotNull() & (F.size(F.split(_first_line(), ",")) <= 6)
    return F.when(timed & vehicle, 0.95).when(timed & noted, 0.7).otherwise(0.0)


def _station_score() -> Column:
    text = _text()
    aps = text.contains("BSSID") & text.contains("First time seen") & text.contains("ESSID")
    stations = text.contains("Station MAC") & text.contains("Power")
    return F.when(aps, 0.95).when(stations, 0.9).otherwise(0.0)


def _frame_score() -> Column:
    at = synonym_map(_header(), FRAME_FIELDS)
    reason = at["reason_code"].isNotNull()
    about_frames = at["subtype"].isNotNull() | reason | _has("deauth")
    addressed = reason & (at["src_mac"].isNotNull() | at["dst_mac"].isNotNull())
    return F.when(~(at["timestamp"].isNotNull() & about_frames), 0.0).otherwise(
        F.greatest(
            F.when(_has("nzyme"), 0.95).otherwise(0.55), F.when(addressed, 0.8).otherwise(0.0)
        )
    )


def _clip_score() -> Column:
    media = _name().rlike(r"\.(" + "|".join(clips.EXTENSIONS) + ")$")
    dated = clip_time(F.element_at(F.split("path", "/"), -1)).isNotNull()
    return F.when(media & dated, 0.9).when(media, 0.4).otherwise(0.0)


for _fmt in (
    Format("pcap80211", CAPTURES, "802.11 capture (pcap/pcapng)", _capture_score, capture.read_captures),
    Format("kismet", CAPTURES, "IDS capture database", _kismet_score, kismet.read_kismet),
    Format("opnsense_api", LOGS, "log rows saved from a firewall API", _api_score, api_json.read_api),
    Format("opnsense", LOGS, "DHCP and system log", _syslog_score, syslog.read_syslog),
    Format("camera_csv", ANCHORS, "pass log", _camera_score, delimited.read_camera),
    Format("airodump_csv", CAPTURES, "station table", _station_score, airodump.read_stations),
    Format("nzyme_csv", CAPTURES, "802.11 frame table", _frame_score, delimited.read_frames),
    Format("camera_clips", ANCHORS, "recorded clips", _clip_score, clips.read_clips),
):
    register(_fmt)


def detect(files: DataFrame, role: str | None = None, forced: str | None = None) -> DataFrame:
    """Add ``parser`` and ``score``: the best format of a role, the earlier registered on ties."""
    if forced is not None:
        if forced not in FORMATS:
            raise ValueError(f"unknown format {forced!r}; there are {', '.join(sorted(FORMATS))}")
        return files.withColumns({"parser": F.lit(forced), "score": F.lit(1.0)})
    ranked = [f for f in FORMATS.values() if role is None or f.role == role]
    scored = F.array_max(
        F.array(
            *[
                F.struct(
                    F.coalesce(f.score(), F.lit(0.0)).alias("score"),
                    F.lit(-i).alias("rank"),
                    F.lit(f.id).alias("id"),
                )
                for i, f in enumerate(ranked)
            ]
        )
    )
    best = files.withColumn("best", scored)
    return best.withColumns(
        {
            "parser": F.when(F.col("best.score") > 0, F.col("best.id")),
            "score": F.col("best.score"),
        }
    ).drop("best")
