"""The window statistics: AGG05-AGG08, ST01 and JN03 for every width at once.

All of them follow from one ordered pass over anchors and incidents that gives each row its
neighbours of both streams. Nothing is sorted again per width: coverage, bin occupancy and
coincidence are sums over rows of simple functions of (row, neighbours, width).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coincide.operators.ordered import Ordered, Running, arrange
from coincide.params import MICROS
from coincide.schema import CAMERA, DISRUPTION, in_period


def instants(rows: DataFrame, time: str = "ts_us") -> DataFrame:
    """Distinct instants of a stream with the number of rows at each."""
    return rows.groupBy("case_id", F.col(time).alias("ts_us")).agg(F.count(F.lit(1)).alias("n"))


def both_streams(anchors: DataFrame, incidents: DataFrame) -> DataFrame:
    """Instants of both streams: ``side`` 0 for anchors, 1 for incidents."""
    return (
        instants(anchors)
        .withColumn("side", F.lit(0))
        .unionByName(instants(incidents, "start_us").withColumn("side", F.lit(1)))
    )


def observation_period(streams: DataFrame, pad_us: int) -> DataFrame:
    """AGG05: the overlap of the two spans, padded; the union when one stream is empty.

    ``streams`` has case_id, ts_us and ``side``.
    """
    spans = streams.groupBy("case_id").agg(
        *[
            F.expr(f"{fold}(CASE WHEN side = {side} THEN ts_us END) AS {name}")
            for fold, side, name in (
                ("min", 0, "a_lo"), ("max", 0, "a_hi"), ("min", 1, "i_lo"), ("max", 1, "i_hi")
            )
        ]
    )
    periods = spans.selectExpr(
        "*",
        "a_lo IS NOT NULL AND i_lo IS NOT NULL AS two_streams",
        "if(a_lo IS NULL OR i_lo IS NULL, coalesce(a_lo, i_lo), greatest(a_lo, i_lo))"
        f" - {pad_us} AS lo_us",
        "if(a_hi IS NULL OR i_hi IS NULL, coalesce(a_hi, i_hi), least(a_hi, i_hi))"
        f" + {pad_us} AS hi_us",
    )

    def discarded(stream: str, name: str) -> str:
        outside = f"greatest(0, lo_us - {stream}_lo) + greatest(0, {stream}_hi - hi_us)"
        return f"CASE WHEN two_streams AND hi_us > lo_us THEN ({outside}) / 3.6e9D END AS {name}"

    return periods.selectExpr(
        "case_id",
        "lo_us",
        "hi_us",
        "two_streams AND hi_us <= lo_us AS disjoint",
        discarded("a", "discarded_anchor_h"),
        discarded("i", "discarded_incident_h"),
    )


def _with_neighbours(ordered: Ordered) -> Ordered:
    anchor = F.expr("CASE WHEN side = 0 THEN ts_us END")
    incident = F.expr("CASE WHEN side = 1 THEN ts_us END")
    return ordered.running(
        before={"prev_a": Running("max", anchor), "prev_i": Running("max", incident)},
        after={"next_a": Running("min", anchor), "next_i": Running("min", incident)},
    ).settled()


def neighbours(streams: DataFrame, chunks: int | None = None) -> Ordered:
    """Instants of both streams, each with the anchors and incidents around it.

    Anchors come first at equal times, so the incident after an anchor may be simultaneous, and
    so may the anchor before an incident.
    """
    return _with_neighbours(arrange(streams, ["case_id"], ["ts_us", "side"], chunks))


def event_neighbours(events: DataFrame, gap_us: int, chunks: int | None = None) -> Ordered:
    """The same from events directly: incidents are found in the order that neighbours need.

    An incident starts at a disruption instant more than ``gap_us`` after the one before.
    """
    rows = (
        events.filter(F.col("category").isin(CAMERA, DISRUPTION))
        .groupBy("case_id", "ts_us", F.expr("if(category = 'camera', 0, 1) AS side"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    disruption = F.expr("CASE WHEN side = 1 THEN ts_us END")
    starts = F.expr(f"side = 0 OR prev_d IS NULL OR ts_us - prev_d > {gap_us}")
    streams = (
        arrange(rows, ["case_id"], ["ts_us", "side"], chunks)
        .running(before={"prev_d": Running("max", disruption)})
        .filter(starts)
    )
    counted = streams.df.withColumn("n", F.expr("if(side = 1, 1L, n)")).drop("prev_d")
    return _with_neighbours(streams.with_df(counted))


def within(around: Ordered, periods: DataFrame) -> Ordered:
    """FL05: the rows inside each case's period, which is added as ``lo_us`` and ``hi_us``.

    The period is one stretch of time, so a neighbour outside it has nothing inside behind it
    and the order need not be computed again.
    """
    lo, hi = F.col("lo_us"), F.col("hi_us")
    bounds = periods.select("case_id", "lo_us", "hi_us")
    inside = around.df.join(bounds, "case_id").filter(in_period(F.col("ts_us"), lo, hi))
    clipped = {c: F.when(F.col(c) >= lo, F.col(c)) for c in ("prev_a", "prev_i")} | {
        c: F.when(F.col(c) <= hi, F.col(c)) for c in ("next_a", "next_i")
    }
    return around.with_df(inside.withColumns(clipped))


def distance_us(before: str, after: str) -> Column:
    """Distance from the row to the nearer of two neighbours; NULL without any."""
    return F.least(F.col("ts_us") - F.col(before), F.col(after) - F.col("ts_us"))


def width_counts(around: Ordered, widths_us: list[int]) -> DataFrame:
    """Raw counts per case and width: hits, coverage, exposure and the 2x2 bin table.

    What [t-w, t+w] adds to the union of the intervals before it depends only on the row before,
    and a bin is newly occupied when the row before lies in another bin.
    """
    per_width = around.df.withColumn("window_us", each_width(widths_us)).withColumn(
        "n_bins", F.expr(N_BINS.format(span="(hi_us - lo_us)"))
    )

    def bin_of(t: str) -> str:
        return f"""CASE WHEN {t} IS NOT NULL
            THEN least(({t} - lo_us) div (2 * window_us), n_bins - 1) END AS bin_{t}"""

    def added(prev: str) -> str:
        return f"""greatest(0L, least(ts_us + window_us, hi_us)
            - greatest(ts_us - window_us, lo_us, {prev} + window_us)) AS added_{prev}"""

    def near(prev: str, after: str) -> str:
        nearest = f"least(ts_us - {prev}, {after} - ts_us)"
        return f"coalesce({nearest} <= window_us, false) AS near_{prev}"

    rows = per_width.selectExpr(
        "case_id", "window_us", "side", "n", "n_bins", "hi_us - lo_us AS span_us",
        near("prev_i", "next_i"), near("prev_a", "next_a"), added("prev_i"), added("prev_a"),
        *[bin_of(t) for t in ("ts_us", "prev_a", "prev_i", "next_i")],
    )

    def total(condition: str, value: str) -> Column:
        return F.expr(f"sum(CASE WHEN {condition} THEN {value} ELSE 0L END)")

    new_a = "side = 0 AND (bin_prev_a IS NULL OR bin_prev_a <> bin_ts_us)"
    new_i = "side = 1 AND (bin_prev_i IS NULL OR bin_prev_i <> bin_ts_us)"
    shared = "(coalesce(bin_prev_i = bin_ts_us, false) OR coalesce(bin_next_i = bin_ts_us, false))"
    return (
        rows.groupBy("case_id", "window_us")
        .agg(
            F.first("span_us").alias("span_us"),
            F.first("n_bins").alias("n_bins"),
            total("side = 0", "n").alias("n_anchors"),
            total("side = 1", "n").alias("n_incidents"),
            total("side = 0 AND near_prev_i", "n").alias("n_coincident"),
            total("side = 1 AND near_prev_a", "n").alias("incidents_inside"),
            total("side = 1", "added_prev_i").alias("covered_us"),
            total("side = 0", "added_prev_a").alias("exposed_us"),
            total(new_a, "1L").alias("anchor_bins"),
            total(new_i, "1L").alias("incident_bins"),
            total(f"{new_a} AND {shared}", "1L").alias("cell_a"),
        )
        .selectExpr(
            "*",
            "anchor_bins - cell_a AS cell_b",
            "incident_bins - cell_a AS cell_c",
            "greatest(n_bins - anchor_bins - incident_bins + cell_a, 0L) AS cell_d",
        )
        .drop("anchor_bins", "incident_bins")
    )


# Number of bins of two windows that cover a span; at least one.
N_BINS = "greatest(({span} + 2 * window_us - 1) div (2 * window_us), 1L)"


def each_width(widths_us: list[int]) -> Column:
    """One row per width."""
    return F.explode(F.lit(widths_us).cast("array<bigint>"))


def rates(counts: DataFrame) -> DataFrame:
    """ST01 / AGG08 / ST06: rates, baseline, lift and the exposure rate ratio.

    Undefined ratios are NULL. An infinite lift is the double infinity.
    """
    m, hits = F.col("n_anchors"), F.col("n_coincident")
    span = F.greatest(F.col("span_us"), F.lit(1))
    inside = F.col("incidents_inside")
    outside = F.col("n_incidents") - inside
    exposed = F.col("exposed_us") / (60.0 * MICROS)
    unexposed = F.greatest(F.col("span_us") - F.col("exposed_us"), F.lit(0)) / (60.0 * MICROS)

    def per_minute(count: Column, minutes: Column) -> Column:
        return F.when(minutes > 0, count / minutes).otherwise(F.lit(0.0))

    out = counts.withColumns(
        {
            "incidents_outside": outside,
            "coincidence_rate": F.coalesce(F.try_divide(hits, m), F.lit(0.0)),
            "baseline_rate": F.least(F.col("covered_us") / span, F.lit(1.0)),
            "exposed_minutes": exposed,
            "unexposed_minutes": unexposed,
            "rate_in_per_min": per_minute(inside, exposed),
            "rate_out_per_min": per_minute(outside, unexposed),
        }
    )
    rate_in, rate_out = F.col("rate_in_per_min"), F.col("rate_out_per_min")
    nothing = (inside == 0) & (outside == 0)
    corrected = ~nothing & (rate_out == 0)
    half_in = per_minute(inside + 0.5, exposed)
    half_out = per_minute(outside + 0.5, unexposed)
    p0 = F.col("baseline_rate")
    return out.withColumns(
        {
            "expected_by_chance": m * p0,
            "lift": F.when(p0 > 0, F.try_divide(F.col("coincidence_rate"), p0))
            .when(F.col("coincidence_rate") > 0, F.lit(float("inf")))
            .otherwise(F.lit(0.0)),
            "rate_ratio": F.when(nothing, F.lit(None))
            .when(corrected, F.try_divide(half_in, half_out))
            .otherwise(F.try_divide(rate_in, rate_out)),
            "rate_ratio_corrected": corrected,
        }
    )
