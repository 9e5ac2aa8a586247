"""Queries over functions, sources, sinks and streams; their texts and bytes are spelled from
the events table by Spark and read back."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coincide.functions import display, frames, mac, reasons, times
from coincide.functions.let import once
from coincide.operators import floods as fl
from coincide.operators.incidents import incidents
from coincide.params import AnalysisParams
from coincide.plans import report, sinks
from coincide.plans.eventmap import client_mac, prop_k, read_events
from coincide.plans.queries import (
    FLOOD_K,
    FLOOD_WINDOW,
    FRAMES,
    GAP,
    PARAMS,
    PASSES,
    WIDE_GAP,
    _matches,
    big,
    events,
    query,
)
from coincide.schema import anchors
from coincide.session import durable, shared_dir, spread
from coincide.sources import (
    airodump,
    api_json,
    capture,
    clips,
    delimited,
    ingest,
    kismet,
    registry,
    syslog,
)
from coincide.sources.lines import uri_of
from coincide.streaming import motion

NY = AnalysisParams(timezone="America/New_York", log_year=2024)
YEAR_START_US = 1_704_067_200_000_000
FILE_ROWS, POINTS, CAPTURE_ROWS = 20_000, 500, 1500
FILLER = [f"x{i}" for i in range(300)]
RADIOTAP_HEAD = "00000f002e000000" + "0002"


def spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the columns from which texts are spelled."""
    raw = spread(read_events(spark, sf_dir))
    return raw.select(
        "event_id", "user_id", "event_type", "ts", "value",
        prop_k().alias("k"),
        client_mac().alias("mac"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
    )


def stamp(fmt: str) -> Column:
    return F.date_format("ts", fmt)


def pick(on: Column, *choices: Column) -> Column:
    """The choice numbered ``on`` modulo their count."""
    out = F.lit(None).cast("string")
    for i, choice in reversed(list(enumerate(choices))):
        out = F.when(on % len(choices) == i, choice).otherwise(out)
    return out


@query
def fn01_norm_mac(spark, sf_dir):
    m = F.col("mac")
    text = pick(
        F.col("k"), m, F.upper(F.replace(m, F.lit(":"), F.lit("-"))), F.replace(m, F.lit(":"), F.lit("")),
        F.concat(F.lit(" "), m, F.lit(" ")), F.substring(m, 1, 14), F.lit("(not associated)"),
        F.lit("FF:FF:FF:FF:FF:FF"), F.lit("01:00:5e:00:00:fb"),
    )
    t = F.col("text")
    return spelled(spark, sf_dir).withColumn("text", text).select(
        "event_id", mac.norm_mac(t).alias("mac"), mac.is_group_addressed(t).alias("is_group"),
        mac.is_broadcast(t).alias("is_broadcast"), mac.client_of_target(t).alias("client"),
    )


@query
def fn02_mac_in_text(spark, sf_dir):
    text = F.concat(F.lit("STA "), F.upper("mac"), F.lit(" of aa:bb:cc:dd:ee:ff left, code "), F.col("k").cast("string"))
    return spelled(spark, sf_dir).select("event_id", mac.mac_in_text(text).alias("mac"))


@query
def fn05_reason_text(spark, sf_dir):
    k = F.col("k")
    return spelled(spark, sf_dir).select(
        "event_id", reasons.reason_text(k).alias("reason"), reasons.is_signature(k).alias("signature")
    )


@query
def fn07_parse_iso(spark, sf_dir):
    text = F.concat(
        pick(F.col("k"), stamp("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), stamp("yyyy-MM-dd HH:mm:ss,SSSSSS")),
        pick(F.col("user_id"), F.lit("Z"), F.lit("-04:00"), F.lit("+0530")),
    )
    at = times.finalize(times.parse_isoish(text), "UTC")
    return spelled(spark, sf_dir).select("event_id", at["ts_us"].alias("ts_us"), at["utc_offset"].alias("utc_offset"))


@query
def fn10_parse_any(spark, sf_dir):
    text = pick(
        F.col("k"),
        stamp("yyyy-MM-dd HH:mm:ss"), stamp("MMM dd HH:mm:ss"),
        F.call_function("div", F.col("us"), F.lit(1_000_000)).cast("string"),
        F.call_function("div", F.col("us"), F.lit(1_000)).cast("string"),
        F.concat(F.lit("cam_"), stamp("yyyyMMdd_HHmmss")), stamp("MM/dd/yyyy hh:mm:ss a"),
        stamp("yyyy/MM/dd HH:mm:ss"), F.lit("not a time"), stamp("MM/dd/yyyy HH:mm:ss"), stamp("dd/MM/yyyy HH:mm:ss"),
    )
    at = times.finalize(times.parse_any(text, F.lit(2024)), "UTC")
    return spelled(spark, sf_dir).select("event_id", at["ts_us"].alias("ts_us"))


def _yearly() -> Column:
    """Wall-clock readings spread over the year, some of them in the hours of a clock change."""
    hours = F.col("event_id") * 37 % 8784
    return F.lit(YEAR_START_US) + hours * F.lit(3_600_000_000) + F.col("us") % 3_600_000_000


@query
def fn11_localize(spark, sf_dir):
    at = times.finalize(F.struct(F.col("wall").alias("wall_us"), F.lit(None).cast("int").alias("offset_s")), "America/New_York")
    return spelled(spark, sf_dir).withColumn("wall", _yearly()).select(
        "event_id", at["ts_us"].alias("ts_us"), F.unix_micros(at["ts_local"].cast("timestamp")).alias("local_us")
    )


@query
def fn12_dst_edge(spark, sf_dir):
    return spelled(spark, sf_dir).withColumn("wall", _yearly()).select(
        "event_id", times.dst_edge(F.col("wall"), "America/New_York").alias("edge")
    )


@query
def tk08_dst_examples(spark, sf_dir):
    readings = spelled(spark, sf_dir).select(_yearly().alias("wall_us"))
    counts, examples = ingest.dst_report(readings, "America/New_York")
    return examples.join(counts, "edge", "left").select("wall_us", "edge", "n")


@query
def fn13_year(spark, sf_dir):
    """A stamp without a year takes the file's, and the one before if it would lie in the future."""
    reference = F.col("us") + (F.col("k").cast("bigint") - 20) * F.lit(86_400_000_000)
    read = times.parse_rfc3164(stamp("MMM dd HH:mm:ss"), times.year_in(reference, "UTC"))
    at = times.finalize(times.rewind_if_future(read, reference, "UTC"), "UTC")
    return spelled(spark, sf_dir).select("event_id", at["ts_us"].alias("ts_us"))


@query
def fn14_clip_time(spark, sf_dir):
    name = pick(
        F.col("k"),
        F.concat(stamp("yyyyMMdd_HHmmss"), F.lit(".mp4")), F.concat(F.lit("ip_01_"), stamp("yyyyMMddHHmmss"), F.lit("000.mp4")),
        F.concat(F.lit("NVR_ch1_main_"), stamp("yyyyMMddHHmmss"), F.lit(".dav")),
        F.concat(stamp("yyyy-MM-dd_HH.mm.ss"), F.lit("_cam1.mp4")), F.concat(stamp("yyyy-MM-dd'T'HH-mm-ss"), F.lit(".mkv")),
        F.concat(F.call_function("div", F.col("us"), F.lit(1_000_000)).cast("string"), F.lit(".jpg")), F.lit("holiday.mp4"),
    )
    clip = times.clip_time(name)
    return spelled(spark, sf_dir).select(
        "event_id", clip["stamp"]["wall_us"].alias("ts_us"), clip["pattern"].alias("pattern")
    )


@query
def fn18_humanize(spark, sf_dir):
    size = F.col("us") % F.lit(10_000_000_000)
    delta = F.when(F.col("k") % 7 == 0, F.lit(0)).when(F.col("k") % 7 == 1, size % 1_000_000).when(
        F.col("k") % 7 == 2, -(size % 90_000_000)
    ).when(F.col("k") % 7 == 3, size % 5_400_000_000).when(F.col("k") % 7 == 4, -size).when(F.col("k") % 7 == 5, size)
    return spelled(spark, sf_dir).select("event_id", display.humanize_delta(delta).alias("text"))


@query
def fn19_text(spark, sf_dir):
    text = pick(F.col("k"), F.lit(" NaN "), F.lit("None"), F.lit("<NA>"), F.lit("nat"), F.lit("  "), F.concat(F.lit(" "), F.col("event_type")))
    return spelled(spark, sf_dir).select("event_id", display.text(text).alias("text"), display.cell(text).alias("cell"))


@query
def fn21_frame_fields(spark, sf_dir):
    token = pick(F.col("k"), F.lit("Deauthentication"), F.lit("0x000C"), F.lit("disassoc"), F.lit("0x0a"), F.lit("beacon"), F.lit(""))
    code = pick(F.col("user_id"), F.col("k").cast("string"), F.concat(F.lit("0x"), F.lower(F.hex("k"))), F.concat(F.col("k").cast("string"), F.lit(".0")), F.lit(""), F.lit("x"))
    mhz = (F.when(F.col("k") % 3 == 0, 2412 + F.col("k") % 15 * 5).when(F.col("k") % 3 == 1, 5000 + F.col("k") * 5).otherwise(5955 + F.col("k") * 20)).cast("int")
    return spelled(spark, sf_dir).select(
        "event_id", frames.frame_kind(token, code).alias("kind"), big(frames.int_or_none(code)).alias("code"),
        big(frames.channel_of(mhz)).alias("channel"),
    )


@query
def fn27_numbers(spark, sf_dir):
    v = F.col("value")
    p = v / F.lit(7e3) * F.when(F.col("k") % 2 == 0, 1.0).otherwise(1e-6)
    return spelled(spark, sf_dir).select(
        "event_id", display.p_text(p).alias("p"), display.number_text(v / 7).alias("number"),
        display.lift_text(F.when(F.col("k") == 3, F.lit(float("inf"))).otherwise(v / 7)).alias("lift"),
        display.general(p, 3).alias("general"),
    )


def _log_line() -> Column:
    """A log line per event: framing by user, message by event type."""
    op = F.when(F.col("event_type") == "signup", "DISCOVER").otherwise("ACK")
    dhcp = F.concat(F.lit("DHCP"), op, F.lit("(igb1) 192.168.1."), F.col("k").cast("string"), F.lit(" "), F.col("mac"))
    isc = F.concat(F.lit("DHCP"), op, F.lit(" from "), F.col("mac"), F.lit(" via igb1"))
    lost = F.concat(F.lit("wlan0: STA "), F.col("mac"), F.lit(" IEEE 802.11: disassociated"))
    gone = F.concat(F.lit("AP-STA-DISCONNECTED "), F.col("mac"), F.lit(" reason="), F.col("k").cast("string"))
    label = pick(F.col("k"), F.lit("DHCP4_LEASE_ALLOC"), F.lit("DHCP4_LEASE_RENEW"), F.lit("DHCP4_RELEASE"))
    kea = F.concat(label, F.lit(" [hwtype=1 "), F.upper("mac"), F.lit("], cid=[x], tid=0x1: lease 10.0.0.1"))
    lease = F.col("event_type").isin("signup", "click")
    message = F.when(lease, F.when(F.col("user_id") % 3 == 1, isc).otherwise(dhcp)).when(
        F.col("event_type") == "view", lost
    ).when(F.col("event_type") == "error", gone).otherwise("all quiet")
    proc = F.when(lease, F.when(F.col("user_id") % 3 == 1, "dhcpd").otherwise("dnsmasq-dhcp")).otherwise("hostapd")
    framed = F.concat(
        F.lit("<134>1 "), stamp("yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("-05:00 fw "), proc, F.lit(" 12 - [meta s=\"1\"] "), message
    )
    bsd = F.concat(stamp("MMM dd HH:mm:ss"), F.lit(" fw "), proc, F.lit("[12]: "), message)
    file = F.concat(stamp("yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" INFO  [kea-dhcp4.leases/7] "), kea)
    return F.when(F.col("k") == 99, "--- rotated ---").when(F.col("user_id") % 3 == 0, framed).when(
        F.col("user_id") % 3 == 1, bsd
    ).otherwise(file)


def _lines(spark, sf_dir) -> DataFrame:
    # Spelled once: the reader's filter on lines is not copied below the exchange of the events.
    return once(spelled(spark, sf_dir), "line", _log_line()).select(
        F.lit("fw.log").alias("path"), (F.lit(YEAR_START_US) + F.lit(40 * 86_400_000_000)).alias("mtime_us"),
        F.col("event_id").alias("line_no"), "line",
    )


@query
def src01_syslog(spark, sf_dir):
    """SRC01-SRC04 on a log of one line per event."""
    rows = syslog.syslog_rows(_lines(spark, sf_dir), NY)
    return rows.select(
        F.col("ordinal").alias("event_id"), "ts_us", "kind", "category", "subtype", "client_mac",
        big("reason_code").alias("reason_code"), "notes", "reject",
    )


@query
def src15_quality(spark, sf_dir):
    rows = syslog.syslog_rows(_lines(spark, sf_dir), NY)
    files = rows.select(F.col("source_file").alias("path")).distinct().withColumns(
        {"parser": F.lit("opnsense"), "score": F.lit(0.4)}
    )
    return ingest.quality(rows, files)


@query
def src05_api_rows(spark, sf_dir):
    lease = F.col("event_type").isin("signup", "click")
    op = F.when(F.col("event_type") == "signup", "DISCOVER").otherwise("REQUEST")
    body = F.when(lease, F.concat(F.lit("DHCP"), op, F.lit("(igb1) "), F.col("mac"))).otherwise(
        F.concat(F.lit("STA "), F.col("mac"), F.lit(" IEEE 802.11: disassociated"))
    )
    proc = F.when(lease, "dnsmasq-dhcp").otherwise("hostapd")
    folded = F.col("k") % 2 == 0
    fields = {
        "timestamp": F.when(F.col("user_id") % 2 == 0, stamp("yyyy-MM-dd'T'HH:mm:ss")),
        "time": F.when(F.col("user_id") % 2 == 1, F.call_function("div", F.col("us"), F.lit(1_000_000)).cast("string")),
        "line": F.when(folded, F.concat(proc, F.lit("[7]: "), body)),
        "message": F.when(~folded, body),
        "process": F.when(~folded, proc),
    }
    names = (*api_json.TIME_FIELDS, *api_json.MESSAGE_FIELDS, *api_json.PROCESS_FIELDS)
    row = F.struct(*[fields.get(n, F.lit(None).cast("string")).alias(n) for n in names])
    envelopes = spelled(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("path"), F.array(row).alias("rows"),
        F.struct(F.lit("dhcp").alias("label"), F.lit("x").alias("scope")).alias("request"),
    )
    return api_json.api_rows(envelopes, PARAMS).select(
        F.col("source_file").cast("bigint").alias("event_id"), "ts_us", "kind", "subtype", "client_mac", "raw", "source_ref"
    )


def _records(spark, sf_dir, header: list[str], cells: list[Column]) -> DataFrame:
    """One file per user: a header row and a row per event."""
    rows = spelled(spark, sf_dir)
    path = F.concat(F.lit("f"), F.col("user_id").cast("string"))
    head = rows.select(path.alias("path"), F.lit(1).cast("bigint").alias("row_no"), F.array(*[F.lit(h) for h in header]).alias("fields")).distinct()
    body = rows.select(path.alias("path"), (F.col("event_id") + 2).alias("row_no"), F.array(*cells).alias("fields"))
    return head.unionByName(body)


@query
def src06_frame_table(spark, sf_dir):
    header = ["Frame Subtype", "Time", "Transmitter", "wlan.da", "Reason Code", "RSSI", "chan", "SSID"]
    target = F.when(F.col("k") % 3 == 0, "FF:FF:FF:FF:FF:FF").otherwise(F.upper("mac"))
    cells = [
        pick(F.col("k"), F.lit("deauth"), F.lit("disassoc"), F.lit("probe")), stamp("yyyy-MM-dd HH:mm:ss.SSS"), F.col("mac"), target,
        F.col("k").cast("string"), F.concat(F.lit("-"), F.col("k").cast("string")), F.lit("6"), F.lit("home"),
    ]
    rows = delimited.frame_rows(_records(spark, sf_dir, header, cells).withColumn("mtime_us", F.lit(0)), PARAMS)
    return rows.select(
        (F.col("ordinal") - 2).alias("event_id"), "ts_us", "kind", "src_mac", "dst_mac", "client_mac",
        big("reason_code").alias("reason_code"), big("signal").alias("signal"), "notes", "source_ref",
    )


@query
def src08_pass_log(spark, sf_dir):
    header = ["Date Time", "License Plate", "Brand", "vehicle type", "Remarks", "Clip"]
    cells = [
        F.when(F.col("k") == 42, "later").otherwise(stamp("yyyy-MM-dd HH:mm:ss")), F.concat(F.lit("P"), F.col("user_id").cast("string")),
        F.lit("Ford"), F.lit(""), F.col("event_type"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("c"), F.col("k").cast("string"))).otherwise(""),
    ]
    params = AnalysisParams(timezone="America/New_York", log_year=2024, camera_clock_offset_s=1.5)
    rows = delimited.camera_rows(_records(spark, sf_dir, header, cells).withColumn("mtime_us", F.lit(0)), params)
    return rows.select(
        (F.col("ordinal") - 2).alias("event_id"), "ts_us", "plate", "make", "model", "notes", "source_ref", "reject"
    )


def _files_of(spark, body: DataFrame, head: list[str]) -> str:
    """Write lines (event_id, line) as text files of ``FILE_ROWS`` events each below ``head``."""
    folder = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    rows = body.select(F.call_function("div", F.col("event_id"), F.lit(FILE_ROWS)).alias("f"), "event_id", "line")
    # One row per file and head line.
    heads = F.array(*[F.struct(F.lit(i - len(head)).cast("bigint").alias("event_id"), F.lit(h).alias("line")) for i, h in enumerate(head)])
    first = rows.select("f").distinct().select("f", F.explode(heads).alias("h")).select("f", "h.*")
    lines = rows.unionByName(first).repartition("f").sortWithinPartitions("f", "event_id")
    lines.select("f", "line").write.partitionBy("f").option("compression", "none").text(folder)
    return folder


def _row_of_file() -> list[Column]:
    """The file that a row came from, and its number there."""
    return [F.regexp_extract("source_file", "/f=(\\d+)/", 1).cast("bigint").alias("f"), big("ordinal").alias("row_no")]


def _quoted(*parts: Column) -> Column:
    """A cell with quotes, a delimiter and a line break in it."""
    return F.concat(F.lit('"'), *parts, F.lit('"'))


@query
def src06_frame_files(spark, sf_dir):
    """SRC06 through the reader: 300 columns, blank cells, a quoted line break, a blank line."""
    header = [*FILLER, "Frame Subtype", "Time", "Transmitter", "wlan.da", "Reason Code", "RSSI", "chan", "SSID", "BSSID"]
    target = F.when(F.col("k") % 7 == 0, "").when(F.col("k") % 3 == 0, "FF:FF:FF:FF:FF:FF").otherwise(F.upper("mac"))
    cells = [
        *[F.lit("")] * len(FILLER), pick(F.col("k"), F.lit("deauth"), F.lit("disassoc"), F.lit("probe")), stamp("yyyy-MM-dd HH:mm:ss.SSS"),
        F.when(F.col("k") % 5 == 0, "").otherwise(F.col("mac")), target, F.when(F.col("k") % 4 == 1, "").otherwise(F.col("k").cast("string")),
        F.concat(F.lit("-"), F.col("k").cast("string")), F.lit(""),
        F.when(F.col("k") % 6 == 0, _quoted(F.lit('ho""me, x\ny'))).otherwise("home"), F.when(F.col("k") % 2 == 0, F.upper("mac")).otherwise(""),
    ]
    body = spelled(spark, sf_dir).select("event_id", F.concat_ws(",", *cells).alias("line"))
    rows = delimited.read_frames(spark, [_files_of(spark, body, [",".join(header), ""])], PARAMS)
    return rows.select(
        *_row_of_file(), "ts_us", "kind", "src_mac", "dst_mac", "bssid", "client_mac", big("reason_code").alias("reason_code"),
        big("signal").alias("signal"), big("channel").alias("channel"), "notes",
    )


@query
def src08_pass_files(spark, sf_dir):
    """SRC08 through the reader: blank plates and makes, quoted notes with a line break."""
    header = [*FILLER, "Date Time", "License Plate", "Brand", "vehicle type", "Remarks", "Clip"]
    cells = [
        *[F.lit("")] * len(FILLER), F.when(F.col("k") == 42, "later").otherwise(stamp("yyyy-MM-dd HH:mm:ss")),
        F.when(F.col("k") % 3 == 0, "").otherwise(F.concat(F.lit("P"), F.col("user_id").cast("string"))),
        F.when(F.col("k") % 4 == 0, "").otherwise("Ford"), F.lit("T"),
        F.when(F.col("k") % 5 == 0, _quoted(F.lit('a, ""b""\n'), F.col("event_type"))).otherwise(F.col("event_type")),
        F.when(F.col("k") % 2 == 0, F.concat(F.lit("c"), F.col("k").cast("string"))).otherwise(""),
    ]
    body = spelled(spark, sf_dir).select("event_id", F.concat_ws(",", *cells).alias("line"))
    rows = delimited.read_camera(spark, [_files_of(spark, body, [",".join(header), ""])], PARAMS)
    return rows.select(*_row_of_file(), "ts_us", "plate", "make", "model", "notes", "reject")


@query
def src07_station_files(spark, sf_dir):
    """SRC07 through the reader: blank powers and packet counts, a blank cipher of the access point."""
    head = [
        "BSSID, First time seen, Last time seen, channel, Speed, Privacy, Cipher, Authentication, Power, # beacons, # IV, LAN IP, ID-length, ESSID, Key",
        "AA:BB:CC:00:00:01, 2024-01-01 00:00:00, 2024-01-01 00:00:00, 6, 130, WPA2,, PSK, -40, 10, 0, 0.0.0.0, 4, home, ", "",
        "Station MAC, First time seen, Last time seen, Power, # packets, BSSID, Probed ESSIDs",
    ]
    k = F.col("k").cast("string")
    cells = [
        F.upper("mac"), stamp("yyyy-MM-dd HH:mm:ss"), stamp("yyyy-MM-dd HH:mm:ss"), F.when(F.col("k") % 7 == 0, "").otherwise(F.concat(F.lit(" -"), k)),
        F.when(F.col("k") % 3 == 1, "").otherwise(F.concat(F.lit(" "), k)), F.when(F.col("k") % 2 == 0, "AA:BB:CC:00:00:01").otherwise("(not associated) "), F.lit(""),
    ]
    body = spelled(spark, sf_dir).select("event_id", F.concat_ws(",", *cells).alias("line"))
    rows = airodump.read_stations(spark, [_files_of(spark, body, head)], PARAMS)
    return rows.select(*_row_of_file(), "ts_us", "client_mac", "bssid", big("signal").alias("signal"), "notes")


@query
def src01_log_files(spark, sf_dir):
    """SRC01 through the reader, line numbers included."""
    body = spelled(spark, sf_dir).select("event_id", _log_line().alias("line"))
    rows = syslog.read_syslog(spark, [_files_of(spark, body, [""])], NY)
    return rows.filter("reject IS NULL").select(*_row_of_file(), "kind", "category", "subtype", "client_mac", "notes")


@query
def src07_stations(spark, sf_dir):
    """A station table with a line per event below its header, and one access point above it."""
    line = F.concat(
        F.upper("mac"), F.lit(", "), stamp("yyyy-MM-dd HH:mm:ss"), F.lit(", "), stamp("yyyy-MM-dd HH:mm:ss"), F.lit(", -"), F.col("k").cast("string"),
        F.lit(", "), F.col("k").cast("string"), F.lit(", "), F.when(F.col("k") % 2 == 0, "AA:BB:CC:00:00:01").otherwise("(not associated) "), F.lit(", home"),
    )
    rows = spelled(spark, sf_dir).select((F.col("event_id") + 4).alias("line_no"), line.alias("line"))
    head = [
        (1, "BSSID, First time seen, Last time seen, channel, Speed, Privacy, Cipher, Authentication, Power, # beacons, # IV, LAN IP, ID-length, ESSID, Key"),
        (2, "AA:BB:CC:00:00:01, 2024-01-01 00:00:00, 2024-01-01 00:00:00, 6, 130, WPA2, CCMP, PSK, -40, 10, 0, 0.0.0.0, 4, home, "),
        (3, "Station MAC, First time seen, Last time seen, Power, # packets, BSSID, Probed ESSIDs"),
    ]
    lines = rows.unionByName(spark.createDataFrame(head, "line_no bigint, line string")).withColumn("path", F.lit("a.csv"))
    return airodump.station_rows(lines, PARAMS).select(
        (F.col("ordinal") - 4).alias("event_id"), "ts_us", "client_mac", "bssid", big("signal").alias("signal"), "notes"
    )


@query
def src09_clips(spark, sf_dir):
    name = pick(F.col("k"), stamp("yyyyMMdd_HHmmss"), stamp("yyyy-MM-dd'T'HH-mm-ss"), F.lit("clip"))
    files = spelled(spark, sf_dir).select(
        F.concat(F.lit("/cam/"), F.col("event_id").cast("string"), F.lit("/"), name, pick(F.col("user_id"), F.lit(".mp4"), F.lit(".JPG"), F.lit(".txt"))).alias("path"),
        F.col("us").alias("mtime_us"),
    )
    rows = clips.clip_rows(files, PARAMS)
    return rows.select(F.split("source_file", "/")[2].cast("bigint").alias("event_id"), "ts_us", "notes", "pattern")


@query
def agg11_clip_patterns(spark, sf_dir):
    files = spelled(spark, sf_dir).select(
        F.concat(F.lit("/"), pick(F.col("k"), stamp("yyyyMMdd_HHmmss"), stamp("yyyy-MM-dd'T'HH-mm-ss"), F.lit("clip")), F.lit(".mp4")).alias("path"),
        F.col("us").alias("mtime_us"),
    )
    return clips.pattern_counts(clips.clip_rows(files, PARAMS))


def _packet() -> Column:
    """A radiotap deauth, disassoc or beacon frame per event; every fifth one is protected."""
    control = pick(F.col("user_id"), F.lit("C0"), F.lit("A0"), F.lit("80"))
    flags = F.when(F.col("k") % 5 == 0, "40").otherwise("00")
    target = F.when(F.col("k") % 3 == 0, "FFFFFFFFFFFF").otherwise(F.replace("mac", F.lit(":"), F.lit("")))
    signal = F.lpad(F.hex(256 - F.col("k") - 1), 2, "0")
    reason = F.lpad(F.hex("k"), 2, "0")
    return F.unhex(
        F.concat(
            F.lit(RADIOTAP_HEAD), F.lit("85090000"), signal, control, flags, F.lit("0000"), target, F.lit("DEADBEEF0001"), F.lit("AABBCC000001"),
            F.lit("0000"), reason, F.lit("00"),
        )
    )


@query
def src11_frames(spark, sf_dir):
    packets = spelled(spark, sf_dir).select(
        F.lit("a.pcap").alias("path"), F.col("event_id").alias("packet_no"), F.col("us").alias("ts_us"), F.lit(127).alias("dlt"), _packet().alias("data")
    )
    rows = capture.frame_events(capture.decode_frames(packets), PARAMS, "pcap80211", "packet ")
    return rows.select(
        F.col("ordinal").alias("event_id"), "ts_us", "kind", "src_mac", "dst_mac", "bssid", "client_mac",
        big("reason_code").alias("reason_code"), big("signal").alias("signal"), big("channel").alias("channel"), "source_ref",
    )


def _write_captures(spark, sf_dir) -> str:
    """Capture files of ``CAPTURE_ROWS`` events each, classic and sectioned in turn, with damage in the
    middle of every fourth one."""
    folder = f"{shared_dir(spark)}/captures-{uuid.uuid4().hex}"
    rows = spelled(spark, sf_dir).select(
        F.call_function("div", F.col("event_id"), F.lit(CAPTURE_ROWS)).alias("f"), "event_id", "us", _packet().alias("data"))

    def write(part):
        import struct

        import pandas as pd
        import pyarrow.fs as pafs

        number = int(part["f"].iloc[0])
        ordered = list(part.sort_values("event_id")[["us", "data"]].itertuples(index=False))
        if number % 2:
            block = lambda kind, body: struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)
            pieces = [block(6, struct.pack("<IIIII", 0, us >> 32, us & 0xFFFFFFFF, len(d), len(d)) + d + b"\0" * (-len(d) % 4)) for us, d in ordered]
            head = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 127, 0, 65535))
        else:
            pieces = [struct.pack(">IIII", us // 1_000_000, us % 1_000_000, len(d), len(d)) + d for us, d in ordered]
            head = struct.pack(">IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 127)
        if number % 4 > 1:
            pieces.insert(len(pieces) // 2, b"\xff" * 400)
        system, inner = pafs.FileSystem.from_uri(uri_of(folder) if "://" in uri_of(folder) else f"file://{folder}")
        system.create_dir(inner)
        with system.open_output_stream(f"{inner}/{number}.cap") as out:
            out.write(head + b"".join(pieces))
        return pd.DataFrame({"f": [number]})

    rows.groupBy("f").applyInPandas(write, "f bigint").count()
    return folder


@query
def src10_packets(spark, sf_dir):
    """SRC10 through the reader: classic and sectioned files, some of them damaged."""
    rows = capture.read_captures(spark, [_write_captures(spark, sf_dir)], PARAMS)
    return rows.select(
        F.regexp_extract("source_file", r"(\d+)\.cap$", 1).cast("bigint").alias("f"), big("ordinal").alias("packet_no"), "ts_us", "kind",
        "src_mac", "dst_mac", big("reason_code").alias("reason_code"), big("signal").alias("signal"), "reject",
    )


@query
def src12_alerts(spark, sf_dir):
    name = pick(F.col("k"), F.lit("DEAUTHFLOOD"), F.lit("bcastdiscon"), F.lit("OTHER"))
    text = F.when(F.col("k") % 2 == 0, F.concat(F.lit("seen "), F.col("k").cast("string")))
    source = F.when(F.col("user_id") % 2 == 0, F.col("mac")).otherwise("00:00:00:00:00:00")
    body = F.to_json(F.struct(text.alias("kismet.alert.text"), source.alias("kismet.alert.source_mac")))
    records = spelled(spark, sf_dir).select(
        F.lit("a.kismet").alias("path"), F.lit("alerts").alias("of"), F.col("event_id").alias("row_no"),
        F.call_function("div", F.col("us"), F.lit(1_000_000)).alias("ts_sec"), (F.col("us") % 1_000_000).alias("ts_usec"),
        F.lit(None).cast("int").alias("dlt"), F.lit(None).cast("binary").alias("data"), F.lit(None).cast("int").alias("stored_signal"),
        F.lit("AA-BB-CC-00-00-01").alias("devmac"), name.alias("header"), body.alias("json"),
    )
    return kismet.record_rows(records, PARAMS).select(
        (F.col("ordinal") - F.lit(1 << 35)).alias("event_id"), "ts_us", "kind", "category", "src_mac", "bssid", "notes"
    )


@query
def src13_detect(spark, sf_dir):
    head = pick(
        F.col("k"), _log_line(), F.lit("timestamp,plate,make,model,notes\n"), F.lit("time,subtype,addr1,addr2,reason\n"),
        F.lit("Station MAC, First time seen, Last time seen, Power\n"), F.lit('{"saved_fetch": 1, "rows": []}'), F.lit("nothing known\n"),
    )
    name = pick(F.col("k"), F.lit("a.log"), F.lit("b.csv"), F.lit("c.csv"), F.lit("d.csv"), F.lit("e.json"), F.lit("f.bin"))
    files = spelled(spark, sf_dir).withColumns({"head": head.cast("binary"), "path": F.concat(F.lit("/x/"), name)})
    return registry.detect(files).select("event_id", "parser", "score")


@query
def src16_extract(spark, sf_dir):
    ev = events(spark, sf_dir)
    since, until = ingest.anchor_window(anchors(ev))
    logs = ev.filter("category <> 'camera'")
    return ingest.extract_window(logs, since, until).select("seq", "ts_us", "kind")


@query
def snk01_correlation(spark, sf_dir):
    table = sinks.correlation_table(_matches(spark, sf_dir), "America/New_York")
    return table.select(
        "camera_event_local", "camera_event_utc", "plate", "coincidence", F.round("delta_seconds", 3).alias("delta_seconds"),
        "nearest_disruption_type", "nearest_disruption_local", "deauth_source_mac", big("reason_code").alias("reason_code"),
        "reason_meaning", "affected_client_mac", "within_analysis_period", "camera_source_file",
    )


@query
def snk02_events(spark, sf_dir):
    """The written event table, read back."""
    path = f"{shared_dir(spark)}/events-{uuid.uuid4().hex}"
    sinks.write_events(events(spark, sf_dir, cases=8), path)
    return spark.read.parquet(path).select(
        "case_id", "seq", "ts_us", "kind", "category", "client_mac", F.date_format("event_date", "yyyy-MM-dd").alias("day"))


@query
def snk03_incidents(spark, sf_dir):
    """The incident table written as CSV, read back."""
    path = f"{shared_dir(spark)}/incidents-{uuid.uuid4().hex}"
    sinks.write_table(incidents(events(spark, sf_dir, types=FRAMES), WIDE_GAP), path)
    back = spark.read.option("header", True).csv(path)
    return back.select("case_id", *[F.col(c).cast("bigint").alias(c) for c in ("start_us", "end_us", "n_events")], "kinds")


@query
def snk05_statistics(spark, sf_dir):
    from coincide.plans.queries import WIDTHS, _stats

    return report.statistics_table(_stats(spark, sf_dir, 8, WIDTHS)).select(
        "case_id", "window_us", "coincidences", "baseline", "lift", "rate_ratio", "binomial_p", "fisher_p", "odds_ratio", "weakest_p"
    )


@query
def snk06_timeline(spark, sf_dir):
    return sinks.timeline_buckets(incidents(events(spark, sf_dir, types=FRAMES), GAP))


@query
def snk06_points(spark, sf_dir):
    return sinks.timeline_points(events(spark, sf_dir), POINTS)


@query
def snk06_bands(spark, sf_dir):
    return sinks.timeline_bands(_matches(spark, sf_dir), WIDE_GAP)


@query
def snk07_file_checksums(spark, sf_dir):
    files = sinks.file_checksums(spark, [sf_dir])
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", "sha256")


def _as_files(spark, sf_dir) -> DataFrame:
    return spelled(spark, sf_dir).select(
        F.col("user_id").alias("folder"), F.col("event_id").cast("string").alias("name"), F.col("k").alias("size"),
        F.sha2(F.concat_ws("|", "event_id", "mac", "event_type"), 256).alias("sha256"), "k",
    )


@query
def snk07_listing_checksum(spark, sf_dir):
    return sinks.listing_checksum(_as_files(spark, sf_dir), "folder", "name", "size")


@query
def snk08_verify(spark, sf_dir):
    originals = _as_files(spark, sf_dir)
    changed = F.when(F.col("k") % 10 == 0, F.sha2(F.concat("sha256", F.lit("x")), 256)).otherwise(F.col("sha256"))
    copies = originals.filter("k % 10 <> 1").withColumn("sha256", changed)
    return sinks.verify_checksums(originals, copies).select("name", "status")


@query
def snk04_manifest(spark, sf_dir):
    from coincide.plans.analysis import run_analysis

    done = run_analysis(events(spark, sf_dir, cases=8), PARAMS)
    return report.manifest(done)


@query
def snk04_fields(spark, sf_dir):
    """The fields of a manifest, read back from its text; each source of passes stands for a file."""
    from coincide.plans.analysis import run_analysis

    params = replace(PARAMS, camera_dedupe_s=0.0, flood_window_s=1800.0)
    rows = events(spark, sf_dir, types=PASSES + FRAMES)
    files = anchors(rows).groupBy("case_id", F.col("source_file").alias("path")).agg(
        F.count(F.lit(1)).alias("rows"), F.max("ts_us").alias("mtime_us"))
    files = files.withColumn("sha256", F.sha2(F.concat_ws(":", "path", F.col("rows").cast("string")), 256))
    doubts = anchors(rows).filter("plate IS NULL").groupBy("case_id", "source_file", F.lit("no plate").alias("reason")).agg(
        F.count(F.lit(1)).alias("n"))
    done = run_analysis(rows, params)
    made = done.incidents.groupBy("case_id").agg(F.count(F.lit(1)).alias("rows")).withColumn("path", F.lit("incidents"))
    text = report.manifest(done, files, made, doubts)
    kind = ("verdict struct<label:string>, statistics struct<n_anchors:bigint,n_incidents:bigint,n_coincident:bigint,binom_p:double>, "
            "sensitivity array<struct<window_us:bigint>>, floods struct<total_frames:bigint,broadcast_frames:bigint,signature_frames:bigint,"
            "n_floods:bigint>, first_floods array<struct<n_frames:bigint,top_source:string>>, analysis_period struct<hours:double>, "
            "merged_passes struct<removed:bigint>, inputs struct<n:bigint,listed:array<struct<path:string,rows:bigint,sha256:string>>>, "
            "outputs struct<n:bigint,listed:array<struct<path:string,rows:bigint>>>, "
            "warnings struct<n:bigint,listed:array<struct<source_file:string,reason:string,n:bigint>>>, configuration struct<flood_window_s:double>")
    m = text.select("case_id", F.from_json("manifest", kind).alias("m")).select("case_id", "m.*")

    def joined(of: str, *names: str) -> Column:
        return F.array_join(F.transform(of, lambda x: F.concat_ws(":", *[x[n].cast("string") for n in names])), ",")

    return m.select(
        "case_id", "verdict.label", "statistics.n_anchors", "statistics.n_incidents", "statistics.n_coincident",
        F.round(F.log10("statistics.binom_p"), 5).alias("log10_binom"), joined("sensitivity", "window_us").alias("widths"),
        "floods.total_frames", "floods.broadcast_frames", "floods.signature_frames", "floods.n_floods",
        joined("first_floods", "n_frames", "top_source").alias("first_floods"), F.round("analysis_period.hours", 6).alias("hours"),
        big("merged_passes.removed").alias("removed"), "inputs.n", joined("inputs.listed", "path", "rows", "sha256").alias("inputs"),
        joined("outputs.listed", "path", "rows").alias("outputs"), joined("warnings.listed", "source_file", "reason", "n").alias("warnings"),
        F.col("configuration.flood_window_s").alias("flood_window_s"),
    )


@query
def tk02_top_sources(spark, sf_dir):
    return report.top_sources(fl.frame_tallies(events(spark, sf_dir, types=FRAMES)), 10)


@query
def tk03_reasons(spark, sf_dir):
    return report.reason_table(fl.frame_tallies(events(spark, sf_dir, types=FRAMES))).select(
        "case_id", big("reason_code").alias("reason_code"), "meaning", "n_frames"
    )


@query
def tk04_first_floods(spark, sf_dir):
    rows = durable(fl.flood_frames(events(spark, sf_dir, types=FRAMES), FLOOD_WINDOW, FLOOD_K), "flood-frames")
    return report.first_floods(fl.floods(rows, FLOOD_WINDOW)).select(
        "case_id", "start_us", "n_frames", big("omitted").alias("omitted")
    )


def _notifications(raw: DataFrame) -> DataFrame:
    """Notifications of one camera per user."""
    topic = pick(
        prop_k(), *[F.lit(f"tns1:{t}") for t in motion.MOTION_TOPICS], F.lit("tns1:Device/Trigger/Relay")
    )
    return raw.select(
        F.col("user_id").cast("string").alias("camera"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.col("event_id").alias("seq"), topic.alias("topic"), pick(F.col("event_id"), F.lit("true"), F.lit("Active"), F.lit(None).cast("string"), F.lit("false")).alias("state"),
        F.lit("cam").alias("source"),
    )


@query
def str01_motion_filter(spark, sf_dir):
    return motion.motion_events(_notifications(read_events(spark, sf_dir))).select("camera", "ts_us", "seq", "notes")


@query
def str02_debounce(spark, sf_dir):
    """The live path: the events table as a stream, debounced per camera, appended to files."""
    schema = read_events(spark, sf_dir).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    kept = motion.debounce_stream(motion.motion_events(_notifications(stream)), 6 * 3_600_000_000)
    out = f"{shared_dir(spark)}/motion-{uuid.uuid4().hex}"
    motion.write_events(kept, f"{out}/events", f"{out}/checkpoint", "parquet").awaitTermination()
    return spark.read.schema(motion.OUTPUT).parquet(f"{out}/events").select("camera", "ts_us", "seq")
