"""DV01 / JN04: client drops derived from DHCP lease traffic.

Within one client's lease rows, a drop is the first DISCOVER since the last confirmation, when
that confirmation is recent and no link reset explains the DISCOVER. Confirmations are ACKs, or
ACKs and REQUESTs for a client without any ACK.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coincide.functions.display import fixed
from coincide.operators.ordered import Running, arrange
from coincide.params import MICROS
from coincide.schema import DERIVED_SEQ, conform

_LINEAGE = ("ts_utc", "ts_local", "utc_offset", "source_file", "source_kind", "source_ref", "raw")


def client_drops(
    events: DataFrame, reassoc_us: int, reconnect_us: int, chunks: int | None = None
) -> DataFrame:
    """New canonical ``client_drop`` rows (JN04 applied)."""
    op = F.upper(F.coalesce("subtype", F.lit("")))
    reset = F.col("kind") == "link_reset"
    rows = (
        events.filter(F.col("kind").isin("assoc", "link_reset") & F.col("client_mac").isNotNull())
        .filter(reset | op.isin("ACK", "REQUEST", "DISCOVER"))
        .select(
            "case_id",
            "client_mac",
            "ts_us",
            F.when(reset, 0).otherwise(1).alias("side"),
            "seq",
            F.when(~reset, op).alias("op"),
            # Only a DISCOVER can become a drop, so only it carries its lineage along.
            F.when(~reset & (op == "DISCOVER"), F.struct(*_LINEAGE)).alias("lineage"),
        )
    )
    ordered = arrange(rows, ["case_id", "client_mac"], ["ts_us", "side", "seq"], chunks)
    # Position within the client's rows: grows with the order, across chunks too.
    place = F.col("chunk").cast("bigint") * F.lit(1 << 40) + F.row_number().over(ordered.window())
    ordered = ordered.with_columns({"place": place})

    def last(op_name: str, value: str) -> Running:
        return Running("max", F.when(F.col("op") == op_name, F.col(value)))

    marked = ordered.running(
        before={
            "ack_place": last("ACK", "place"),
            "ack_us": last("ACK", "ts_us"),
            "request_place": last("REQUEST", "place"),
            "request_us": last("REQUEST", "ts_us"),
            "discover_place": last("DISCOVER", "place"),
            "reset_us": Running("max", F.when(F.col("side") == 0, F.col("ts_us"))),
        },
        after={"later_ack_us": last("ACK", "ts_us")},
    ).df.filter(F.col("op") == "DISCOVER")

    has_ack = F.col("ack_us").isNotNull() | F.col("later_ack_us").isNotNull()
    confirmed_place = F.when(has_ack, F.col("ack_place")).otherwise(F.col("request_place"))
    confirmed_us = F.when(has_ack, F.col("ack_us")).otherwise(F.col("request_us"))
    first_attempt = F.col("discover_place").isNull() | (
        F.col("discover_place") < confirmed_place
    )
    gap_us = F.col("ts_us") - confirmed_us
    explained = F.coalesce(F.col("ts_us") - F.col("reset_us") <= reconnect_us, F.lit(False))
    found = marked.filter(
        confirmed_place.isNotNull() & first_attempt & (gap_us <= reassoc_us) & ~explained
    )
    return conform(
        found.select(
            "case_id",
            (F.col("seq") + F.lit(DERIVED_SEQ)).alias("seq"),
            "ts_us",
            *[F.col(f"lineage.{c}").alias(c) for c in _LINEAGE if c != "source_kind"],
            F.concat("lineage.source_kind", F.lit("+derived")).alias("source_kind"),
            F.lit("client_drop").alias("kind"),
            F.lit("disruption").alias("category"),
            F.lit("DISCOVER").alias("subtype"),
            F.col("client_mac").alias("dst_mac"),
            "client_mac",
            F.concat(
                F.lit("restarted DHCP acquisition "),
                fixed(gap_us / MICROS, 1),
                F.lit(" s after a confirmed lease"),
            ).alias("notes"),
        )
    )


def with_client_drops(
    events: DataFrame, reassoc_us: int, reconnect_us: int, chunks: int | None = None
) -> DataFrame:
    """SE01: the events and the drops derived from them."""
    return events.unionByName(client_drops(events, reassoc_us, reconnect_us, chunks))
