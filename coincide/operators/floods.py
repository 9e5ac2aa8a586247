"""DV03 / AGG03 / AGG04 / AGG12: floods of deauthentication and disassociation frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coincide.functions.reasons import SIGNATURE_REASONS
from coincide.operators.ordered import Ordered, Running, arrange
from coincide.params import MICROS
from coincide.schema import BROADCAST, frames
from coincide.session import durable


def trailing_counts(
    instants: DataFrame, window_us: int, chunks: int | None = None
) -> Ordered:
    """Frames within the ``window_us`` that ends at each instant, both ends included (WN02).

    The count is the difference of two running totals, one at the instant and one at a probe
    row ``window_us`` earlier, so a dense burst costs no more than any other rows.
    """
    at = instants.select("case_id", "ts_us", F.lit(1).alias("side"), "n", F.col("ts_us").alias("of_us"))
    probe = instants.select(
        "case_id",
        (F.col("ts_us") - window_us).alias("ts_us"),
        F.lit(0).alias("side"),
        F.lit(0).cast("bigint").alias("n"),
        F.col("ts_us").alias("of_us"),
    )
    ordered = arrange(at.unionByName(probe), ["case_id"], ["ts_us", "side"], chunks).running(
        before={"total": Running("sum", F.col("n"), inclusive=True)}
    )

    def own(column: str) -> Column:
        return F.max(F.when(F.col("side") == 1, F.col(column)))

    paired = ordered.df.groupBy("case_id", F.col("of_us").alias("ts_us")).agg(
        (own("total") - F.max(F.when(F.col("side") == 0, F.col("total")))).alias("in_window"),
        own("n").alias("n"),
        own("chunk").alias("chunk"),
    )
    # Same chunks, now of instants only: order and cuts are unchanged. Several chunks mean
    # several passes for the carried values.
    counted = durable(paired, "counts")
    return Ordered(counted, ("case_id",), ("ts_us",))


def burst_instants(
    events: DataFrame, window_us: int, threshold: int, chunks: int | None = None
) -> DataFrame:
    """Instants that belong to a burst, with ``flood_us``, the start of that burst.

    An instant is in a burst when a *hot* instant (``threshold`` frames in its trailing window)
    follows within the window. A burst ends at a frame outside any burst or at a longer pause.
    """
    instants = frames(events).groupBy("case_id", "ts_us").agg(F.count(F.lit(1)).alias("n"))
    ts, hot = F.col("ts_us"), F.col("in_window") >= threshold
    marked = (
        trailing_counts(instants, window_us, chunks)
        .running(after={"next_hot_us": Running("min", F.when(hot, ts), inclusive=True)})
        .with_columns({"in_burst": F.coalesce(F.col("next_hot_us") - ts <= window_us, F.lit(False))})
        # The last instant before this one and whether it was in a burst, as one growing number.
        .running(before={"prev": Running("max", ts * 2 + F.col("in_burst").cast("int"))})
    )
    prev_us, prev_in = F.shiftright("prev", 1), F.col("prev") % 2 == 1
    continues = F.coalesce(prev_in & (ts - prev_us <= window_us), F.lit(False))
    return (
        marked.with_columns({"opens_us": F.when(F.col("in_burst") & ~continues, ts)})
        .running(before={"flood_us": Running("max", F.col("opens_us"), inclusive=True)})
        .df.filter("in_burst")
        .select("case_id", "ts_us", "n", "in_window", "flood_us")
    )


def flood_frames(
    events: DataFrame, window_us: int, threshold: int, chunks: int | None = None
) -> DataFrame:
    """Every frame of a flood, with the flood's start.

    A burst holds the whole trailing window of a hot instant, so it has ``threshold`` frames.
    """
    bursts = burst_instants(events, window_us, threshold, chunks)
    return frames(events).join(
        bursts.select("case_id", "ts_us", "flood_us", "in_window"), ["case_id", "ts_us"]
    )


def floods(flood_rows: DataFrame, window_us: int) -> DataFrame:
    """AGG04 / TK05: one row per flood. Ties for the top source go to the lower address."""
    per_source = flood_rows.groupBy("case_id", "flood_us", "src_mac").agg(
        F.max("ts_us").alias("end_us"),
        F.count(F.lit(1)).alias("n"),
        F.max("in_window").alias("peak"),
        F.count_if(F.col("dst_mac") == BROADCAST).alias("broadcast"),
    )
    ranked = F.struct((-F.col("n")).alias("rank"), "src_mac")
    return (
        per_source.groupBy("case_id", F.col("flood_us").alias("start_us"))
        .agg(
            F.max("end_us").alias("end_us"),
            F.sum("n").alias("n_frames"),
            (F.max("peak") * float(MICROS) / window_us).alias("peak_rate_per_s"),
            F.min(F.when(F.col("src_mac").isNotNull(), ranked)).alias("top"),
            F.sum("broadcast").alias("broadcast_frames"),
        )
        .withColumn("duration_s", (F.col("end_us") - F.col("start_us")) / MICROS)
        .select(
            "case_id", "start_us", "end_us", "duration_s", "n_frames", "peak_rate_per_s",
            F.col("top.src_mac").alias("top_source"), "broadcast_frames",
        )
    )


def flood_tallies(flood_rows: DataFrame) -> DataFrame:
    """AGG03 per flood, long form: how many frames per source, target and reason."""
    return _tallies(flood_rows, ["case_id", "flood_us"])


def frame_tallies(events: DataFrame) -> DataFrame:
    """AGG03 over the whole capture, long form."""
    return _tallies(frames(events), ["case_id"])


def _tallies(rows: DataFrame, keys: list[str]) -> DataFrame:
    values = F.array(
        F.struct(F.lit("source").alias("what"), F.col("src_mac").alias("value")),
        F.struct(F.lit("target").alias("what"), F.col("dst_mac").alias("value")),
        F.struct(F.lit("reason").alias("what"), F.col("reason_code").cast("string").alias("value")),
    )
    return (
        rows.select(*keys, F.explode(values).alias("v"))
        .filter(F.col("v.value").isNotNull())
        .groupBy(*keys, "v.what", "v.value")
        .agg(F.count(F.lit(1)).alias("n_frames"))
    )


def frame_totals(events: DataFrame) -> DataFrame:
    """AGG03 / AGG12: totals per case and the share carrying a tool's default reason codes."""
    signature = F.col("reason_code").isin(*SIGNATURE_REASONS)
    return (
        frames(events)
        .groupBy("case_id")
        .agg(
            F.count(F.lit(1)).alias("total_frames"),
            F.count_if(F.col("dst_mac") == BROADCAST).alias("broadcast_frames"),
            F.count_if(signature).alias("signature_frames"),
            F.array_sort(F.collect_set(F.when(signature, F.col("reason_code")))).alias(
                "signature_codes"
            ),
        )
        .withColumn("signature_share", F.col("signature_frames") / F.col("total_frames"))
    )
