"""SRC12: packets and alerts in IDS capture databases (SQLite files)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coincide.functions.mac import norm_mac
from coincide.params import AnalysisParams
from coincide.sources.capture import WIFI_LINKS, decode_frames, frame_events, uri_of
from coincide.sources.clips import list_files

# Alerts that count as disruptions.
ALERTS = {
    "DEAUTHFLOOD": "Kismet detected a flood of deauthentication frames",
    "BCASTDISCON": "Kismet detected a broadcast disconnect (deauth/disassoc to all clients)",
    "DISASSOCTRAFFIC": "Kismet detected disassociation traffic",
    "DEAUTHCODEINVALID": "Deauthentication frame carrying an invalid reason code",
    "NULLPROBERESP": "Malformed probe response consistent with an attack tool",
    "CHANCHANGE": "Access point changed channel unexpectedly",
}
NO_MAC = "00:00:00:00:00:00"

RECORDS = (
    "path string, of string, row_no bigint, ts_sec bigint, ts_usec bigint, dlt int, data binary, "
    "stored_signal int, devmac string, header string, json string"
)


def read_records(spark: SparkSession, paths: list[str], batch: int = 4096) -> DataFrame:
    """Raw packet and alert rows of every database; one task per file.

    Columns differ between versions of the writer, so absent ones are NULL.
    """
    files = list_files(spark, paths).select("path")
    spread = files.repartition(max(spark.sparkContext.defaultParallelism, 1), "path")
    wanted = {
        "packets": ("ts_sec", "ts_usec", "dlt", "packet", "signal"),
        "alerts": ("ts_sec", "ts_usec", "devmac", "header", "json"),
    }
    renamed = {"packet": "data", "signal": "stored_signal"}
    links = ", ".join(map(str, WIFI_LINKS))

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sqlite3

        import pyarrow.fs as pafs

        names = [c.split()[0] for c in RECORDS.split(", ")]
        for part in parts:
            for path in part["path"]:
                system, inner = pafs.FileSystem.from_uri(uri_of(path))
                with system.open_input_stream(inner) as fh, sqlite3.connect(":memory:") as con:
                    con.deserialize(fh.read())
                    for table, columns in wanted.items():
                        present = {r[1] for r in con.execute(f"PRAGMA table_info({table})")}
                        have = [c for c in columns if c in present]
                        if "ts_sec" not in have or (table == "packets" and "packet" not in have):
                            continue
                        where = f" WHERE dlt IN ({links})" if "dlt" in have and table == "packets" else ""
                        cursor = con.execute(f"SELECT {', '.join(have)} FROM {table}{where}")
                        number = 0
                        while rows := cursor.fetchmany(batch):
                            out = pd.DataFrame(rows, columns=[renamed.get(c, c) for c in have])
                            out["path"], out["of"] = path, table
                            out["row_no"] = range(number + 1, number + len(rows) + 1)
                            number += len(rows)
                            yield out.reindex(columns=names).astype(object).where(lambda d: d.notna(), None)

    return spread.mapInPandas(walk, RECORDS)


def record_rows(records: DataFrame, params: AnalysisParams) -> DataFrame:
    """Events of raw rows: frames decoded as from a capture, and disruption alerts."""
    header = F.upper(F.coalesce("header", F.lit("")))
    alert = F.col("of") == "alerts"
    wanted = records.filter(~alert | header.isin(*ALERTS)).select(
        "path",
        "of",
        # Alerts come after every packet of the file.
        (F.col("row_no") + F.when(alert, F.lit(1 << 35)).otherwise(F.lit(0))).alias("packet_no"),
        (F.col("ts_sec") * 1_000_000 + F.coalesce("ts_usec", F.lit(0))).alias("ts_us"),
        F.coalesce("dlt", F.lit(127)).alias("dlt"),
        "data",
        "stored_signal",
        "devmac",
        header.alias("header"),
        "json",
    )
    decoded = decode_frames(wanted, keep=alert).withColumn(
        "signal", F.coalesce(F.nullif("stored_signal", F.lit(0)), "signal")
    )
    meaning = F.create_map(*[F.lit(x) for pair in ALERTS.items() for x in pair])
    detail = F.get_json_object("json", "$['kismet.alert.text']")
    source = F.nullif(
        norm_mac(F.get_json_object("json", "$['kismet.alert.source_mac']")), F.lit(NO_MAC)
    )
    said = F.concat(
        "header",
        F.lit(": "),
        meaning[F.col("header")],
        F.when(F.coalesce(detail, F.lit("")) != "", F.concat(F.lit(" - "), detail)).otherwise(""),
    )
    device = norm_mac(F.col("devmac"))
    # An alert's own columns take the place of a frame's.
    of_alert = {
        "kind": F.lit("alert"),
        "src_mac": F.coalesce(source, device),
        "bssid": device,
        "alert_notes": said,
        "alert_raw": F.col("header"),
    }
    both = decoded.withColumns(
        {
            name: F.when(alert, value).otherwise(
                F.col(name) if name in decoded.columns else F.lit(None)
            )
            for name, value in of_alert.items()
        }
    )
    rows = frame_events(both, params, "kismet", "packets row ", extra=["alert_notes", "alert_raw"])
    number = (F.col("ordinal") - F.lit(1 << 35)).cast("string")
    return rows.withColumns(
        {
            "notes": F.coalesce("alert_notes", "notes"),
            "raw": F.coalesce("alert_raw", "raw"),
            "source_ref": F.when(
                F.col("alert_raw").isNotNull(), F.concat(F.lit("alerts row "), number)
            ).otherwise(F.col("source_ref")),
        }
    ).drop("alert_notes", "alert_raw")


def read_kismet(spark: SparkSession, paths: list[str], params: AnalysisParams) -> DataFrame:
    return record_rows(read_records(spark, paths), params)
