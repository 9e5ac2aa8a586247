"""SRC07: station and access-point tables written next to a capture."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coincide.functions.let import once
from coincide.functions.mac import norm_mac
from coincide.functions.times import finalize, parse_any
from coincide.operators.ordered import Running, arrange
from coincide.params import AnalysisParams
from coincide.sources.lines import cells_of, lines_in_place, nonblank, with_states

# First cells of the two header lines, and field positions.
AP_HEADER, STATION_HEADER = "BSSID,", "Station MAC,"
LAST_SEEN, POWER, PACKETS, STATION_BSSID, ESSID = 2, 3, 4, 5, 13
#: Under no header (0), access points (1) or stations (2): an ordinary line, and the two headers.
HEADERS = np.array([[0, 1, 2], [1, 1, 1], [2, 2, 2]])


def _header() -> Column:
    stripped = F.trim("line")
    return F.when(stripped.startswith(AP_HEADER), 1).when(stripped.startswith(STATION_HEADER), 2)


def station_rows(
    lines: DataFrame, params: AnalysisParams, chunks: int | None = None
) -> DataFrame:
    """Last-seen instants of stations as context events; a row belongs to the header above it."""
    marked = nonblank(lines).select("path", "line_no", "line", _header().alias("header"))
    # The last header's line number and kind as one growing number.
    placed = arrange(marked, ["path"], ["line_no"], chunks).running(
        before={"above": Running("max", F.col("line_no") * 2 + F.col("header") - 1)}
    )
    rows = placed.df.filter("header IS NULL AND above IS NOT NULL").withColumn("is_station", F.col("above") % 2 == 1)
    return _stations(rows, params)


def _stations(lines: DataFrame, params: AnalysisParams) -> DataFrame:
    """From lines below a header, and whether it is that of stations."""
    cells = F.transform(cells_of(F.col("line")), lambda c: F.trim(c))
    rows = lines.withColumn("f", cells).filter("size(f) >= 6")

    def cell(i: int) -> Column:
        return F.get("f", F.lit(i))

    names = (
        rows.filter(~F.col("is_station") & (F.size("f") > ESSID))
        .select("path", norm_mac(cell(0)).alias("bssid"), "line_no", cell(ESSID).alias("essid"))
        .filter("bssid IS NOT NULL")
        .groupBy("path", "bssid")
        .agg(F.max_by("essid", "line_no").alias("essid"))
    )
    year = F.lit(params.log_year) if params.log_year else F.year(F.current_timestamp())
    at = finalize(parse_any(cell(LAST_SEEN), year), params.timezone, params.assume_offset)
    stations = (
        once(rows.filter("is_station"), "at", at)
        .withColumns({"mac": norm_mac(cell(0)), "bssid": norm_mac(cell(STATION_BSSID))})
        .filter("mac IS NOT NULL AND at IS NOT NULL")
        .join(names, ["path", "bssid"], "left")
    )
    packets = F.coalesce(cell(PACKETS).try_cast("int"), F.lit(0)).cast("string")
    network = F.when(
        F.col("bssid").isNotNull(),
        F.rtrim(F.concat(F.lit("; BSSID "), F.coalesce("essid", F.lit("")))),
    ).otherwise("")
    return stations.select(
        "at.*",
        F.lit("context").alias("kind"),
        F.lit("context").alias("category"),
        F.col("mac").alias("client_mac"),
        F.col("mac").alias("src_mac"),
        "bssid",
        cell(POWER).try_cast("int").alias("signal"),
        F.concat(F.lit("airodump last seen; "), packets, F.lit(" frames"), network).alias("notes"),
        F.col("path").alias("source_file"),
        F.col("line_no").alias("ordinal"),
        F.concat(F.lit("line "), F.col("line_no").cast("string")).alias("source_ref"),
        F.col("line").alias("raw"),
        F.lit("airodump_csv").alias("source_kind"),
        F.lit(None).cast("string").alias("reject"),
    )


def read_stations(spark: SparkSession, paths: list[str], params: AnalysisParams) -> DataFrame:
    """As :func:`station_rows`, with the text left in place."""
    lines, _ = with_states(lines_in_place(spark, paths), F.coalesce(_header(), F.lit(0)), HEADERS)
    rows = nonblank(lines).filter(_header().isNull() & (F.col("state") > 0))
    return _stations(rows.withColumn("is_station", F.col("state") == 2), params)
