"""SRC01-SRC04: DHCP and wireless events in system logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coincide.functions.let import let, once
from coincide.functions.mac import mac_in_text
from coincide.functions.times import (
    finalize,
    group,
    groups,
    parse_isoish,
    parse_rfc3164,
    rewind_if_future,
    year_in,
)
from coincide.params import AnalysisParams
from coincide.schema import categorize
from coincide.sources.lines import nonblank, numbered_lines

# Line framings, message patterns and names, in the order in which they are tried.
RFC5424 = (
    r"^(?:<(\d{1,3})>)?(?:1\s+)?(\d{4}-\d{2}-\d{2}T[\d:.]+(?:Z|[+-]\d{2}:?\d{2})?)\s+"
    r"(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(?:\[([^\]]*)\]|-)\s*(.*)$"
)
RFC3164_LINE = (
    r"^(?:<(\d{1,3})>)?([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}(?:\.\d+)?)\s+"
    r"(\S+)\s+([\w./-]+)(?:\[(\d+)\])?:\s*(.*)$"
)
KEA_FILE = r"^(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?)\s+([A-Z]+)\s+\[([^\]]+)\]\s+(.*)$"
DHCP_OPS = "DISCOVER|REQUEST|ACK|NAK|OFFER|RELEASE|INFORM|DECLINE"
DNSMASQ = rf"DHCP({DHCP_OPS})(?:\(([^)]+)\))?\s+(.*)$"
ISC = rf"DHCP({DHCP_OPS})\b(.*)$"
LEASE_OPS = ("DISCOVER", "REQUEST", "ACK", "OFFER")
KEA_HWADDR = r"hwtype=\d+\s+((?:[0-9a-fA-F]{2}:){5}[0-9a-fA-F]{2})"
KEA_EVENT = (
    r"\b(DHCP4_LEASE_ALLOC|DHCP4_LEASE_RENEW|DHCP4_LEASE_ADVERT|DHCP4_INIT_REBOOT|"
    r"DHCP6_LEASE_ALLOC|DHCP4_PACKET_RECEIVED|DHCP4_RELEASE)\b"
)
KEA_PACKET = r"packet type (DHCP\w+)"
KEA_SUBTYPES = {
    "DHCP4_LEASE_RENEW": "RENEW",
    "DHCP4_LEASE_ALLOC": "ACK",
    "DHCP6_LEASE_ALLOC": "ACK",
    "DHCP4_INIT_REBOOT": "ACK",
    "DHCP4_LEASE_ADVERT": "OFFER",
}
IPV4 = r"\b((?:\d{1,3}\.){3}\d{1,3})\b"
DISCONNECTS = (
    (r"IEEE 802\.11:\s*disassociated", "disassociated"),
    (r"IEEE 802\.11:\s*deauthenticated due to ([^(]+)", "deauthenticated"),
    (r"\bdeauthenticated\b", "deauthenticated"),
    (r"\bdisassociated\b", "disassociated"),
    (r"CTRL-EVENT-DISCONNECTED", "wpa_supplicant disconnect"),
    (r"AP-STA-DISCONNECTED", "hostapd station disconnect"),
    (r"link state changed to DOWN", "interface link down"),
    (r"\bassociation failed\b", "association failure"),
)
ASSOCIATIONS = r"AP-STA-CONNECTED|IEEE 802\.11:\s*associated|CTRL-EVENT-CONNECTED"
REASON = r"(?i)reason[ =:]+(\d{1,2})"
DHCP_PROCS = "dnsmasq|dhcpd|kea|dhcrelay|dhclient"
WIFI_PROCS = "hostapd|wpa_supplicant|kernel|wlan"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return let(F.regexp_extract(text, pattern, group), lambda x: F.when(x != "", x))


def split_syslog(lines: DataFrame, params: AnalysisParams) -> DataFrame:
    """SRC01: add ``stamp``, ``proc`` and ``msg``; NULL for a line of no known framing."""
    line, tz = F.col("line"), params.timezone
    year = F.lit(params.log_year) if params.log_year else year_in(F.col("mtime_us"), tz)

    def framed(stamp: Column, proc: Column, msg: Column) -> Column:
        return let(
            stamp,
            lambda s: F.when(
                s.isNotNull(), F.struct(s.alias("stamp"), proc.alias("proc"), msg.alias("msg"))
            ),
        )

    first = let(
        groups(line, RFC5424, [2, 4, 8]), lambda p: framed(parse_isoish(group(p, 1)), group(p, 2), group(p, 3))
    )
    second = let(
        groups(line, RFC3164_LINE, [2, 4, 6]),
        lambda p: framed(
            rewind_if_future(parse_rfc3164(group(p, 1), year), F.col("mtime_us"), tz), group(p, 2), group(p, 3)
        ),
    )
    third = let(
        groups(line, KEA_FILE, [1, 3, 4]),
        lambda p: framed(parse_isoish(group(p, 1)), F.substring_index(group(p, 2), ".", 1), group(p, 3)),
    )
    return once(lines, "framed", F.coalesce(first, second, third)).select(
        *lines.columns, "framed.stamp", "framed.proc", "framed.msg"
    )


def _wifi() -> Column:
    """SRC04: a disconnect or association line, or NULL."""
    proc, msg = F.lower(F.coalesce("proc", F.lit(""))), F.col("msg")
    relevant = proc.rlike(WIFI_PROCS) | msg.contains("IEEE 802.11") | msg.contains("AP-STA-")
    label = F.lit(None).cast("string")
    for pattern, name in reversed(DISCONNECTS):
        label = F.when(msg.rlike(f"(?i){pattern}"), name).otherwise(label)
    mac = mac_in_text(msg)
    lost = let(
        label,
        lambda name: F.when(
            name.isNotNull(),
            F.struct(
                F.lit("link_reset").alias("kind"),
                F.lit(None).cast("string").alias("subtype"),
                mac.alias("client_mac"),
                mac.alias("dst_mac"),
                _found(msg, REASON).cast("int").alias("reason_code"),
                F.concat(F.coalesce("proc", F.lit("")), F.lit(": "), name).alias("notes"),
            ),
        ),
    )
    gained = F.when(
        msg.rlike(f"(?i){ASSOCIATIONS}"),
        _row("assoc", F.lit(None), mac, F.concat(F.coalesce("proc", F.lit("")), F.lit(": associated"))),
    )
    return F.when(relevant, F.coalesce(lost, gained))


def _row(kind: Column | str, subtype: Column, mac: Column, notes: Column) -> Column:
    return F.struct(
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
        subtype.cast("string").alias("subtype"),
        mac.alias("client_mac"),
        F.lit(None).cast("string").alias("dst_mac"),
        F.lit(None).cast("int").alias("reason_code"),
        notes.alias("notes"),
    )


def _kea() -> Column:
    """SRC03: a lease event of Kea, or NULL without an address."""
    msg = F.col("msg")

    def subtype(label: Column, packet: Column) -> Column:
        by_packet = F.nullif(F.regexp_replace(F.upper(packet), "^DHCP", ""), F.lit(""))
        by_label = F.lit("")
        for name, op in KEA_SUBTYPES.items():
            by_label = F.when(label == name, op).otherwise(by_label)
        return F.when(label == "DHCP4_RELEASE", "RELEASE").otherwise(
            F.coalesce(by_packet, by_label)
        )

    def row(mac: Column, packet: Column, label: Column) -> Column:
        kind = F.when(label == "DHCP4_RELEASE", "context").otherwise("assoc")
        return _row(kind, subtype(label, packet), mac, label)

    mac = F.coalesce(F.lower(_found(msg, KEA_HWADDR)), mac_in_text(msg))
    return let(
        mac,
        lambda m: F.when(
            m.isNotNull(),
            let(
                _found(msg, KEA_PACKET),
                lambda p: let(
                    F.coalesce(_found(msg, KEA_EVENT), p, F.lit("KEA_LEASE")),
                    lambda name: row(m, p, name),
                ),
            ),
        ),
    )


def _dhcp() -> Column:
    """SRC02: a lease event of dnsmasq or ISC dhcpd, or NULL."""
    msg = F.col("msg")
    parts = let(
        groups(msg, DNSMASQ, [1, 3], anywhere=True),
        lambda p: F.when(F.size(p) > 1, p).otherwise(groups(msg, ISC, [1, 2], anywhere=True)),
    )

    def read(p: Column) -> Column:
        address = F.coalesce(F.concat(F.lit(" "), _found(group(p, 2), IPV4)), F.lit(""))
        notes = F.concat(F.lit("DHCP"), group(p, 1), address)
        kind = F.when(group(p, 1).isin(*LEASE_OPS), "assoc").otherwise("context")
        return let(
            F.coalesce(mac_in_text(group(p, 2)), mac_in_text(msg)),
            lambda mac: F.when(mac.isNotNull(), _row(kind, group(p, 1), mac, notes)),
        )

    return let(parts, read)


def message_event() -> Column:
    """SRC02-SRC04 over columns ``proc`` and ``msg``: wireless lines first, then DHCP."""
    proc, msg = F.lower(F.coalesce("proc", F.lit(""))), F.col("msg")
    dhcp = proc.rlike(DHCP_PROCS) | msg.contains("DHCP")
    kea = proc.contains("kea") | msg.contains("DHCP4_") | msg.contains("DHCP6_")
    return F.coalesce(_wifi(), F.when(dhcp & kea, _kea()).when(dhcp, _dhcp()))


EVENT_COLUMNS = ("kind", "subtype", "client_mac", "dst_mac", "reason_code", "notes")


def with_message_events(rows: DataFrame) -> DataFrame:
    """SRC02-SRC04: add the event of each message; its columns are NULL if there is none."""
    event = F.when(F.col("msg").isNotNull(), message_event())
    return (
        once(rows, "event", event)
        .select(*rows.columns, *[F.col(f"event.{c}").alias(c) for c in EVENT_COLUMNS])
        .withColumn(
            "category",
            F.when(F.col("kind") == "link_reset", categorize(F.col("kind"))).when(
                F.col("kind").isNotNull(), "context"
            ),
        )
    )


def syslog_rows(lines: DataFrame, params: AnalysisParams) -> DataFrame:
    """Events of numbered lines; lines of no known framing are kept with a ``reject`` reason."""
    split = split_syslog(nonblank(lines), params)
    dated = once(split, "at", finalize(F.col("stamp"), params.timezone, params.assume_offset))
    return (
        with_message_events(dated)
        .filter(F.col("at").isNull() | F.col("kind").isNotNull())
        .select(
            "at.*",
            "category",
            *EVENT_COLUMNS,
            F.col("path").alias("source_file"),
            F.col("line_no").alias("ordinal"),
            F.concat(F.lit("line "), F.col("line_no").cast("string")).alias("source_ref"),
            F.col("line").alias("raw"),
            F.when(F.col("at").isNull(), "no recognizable syslog timestamp").alias("reject"),
            F.lit("opnsense").alias("source_kind"),
        )
    )


def read_syslog(spark: SparkSession, paths: list[str], params: AnalysisParams) -> DataFrame:
    return syslog_rows(numbered_lines(spark, paths), params)
