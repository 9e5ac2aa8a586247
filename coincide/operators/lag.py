"""ST10 / ST11 / JN07: would the two streams line up at another clock offset?

An anchor is hit at every integer lag that moves it into a disruption interval. Intervals and
anchors meet in slots of the largest lag; merged intervals are at least two windows long, so one
anchor meets a bounded number of them however dense the data is. Each meeting adds +1 and -1 at
the ends of its range of lags, and a running sum over the lags gives the hits.

Lags worth testing are those that some anchor and incident differ by. They are found without
pairs: a stream is reduced to the first and last instant of every quarter second, a slot's instants
to one row per stream, and what two such rows differ by to a bitmap of lags; the bitmaps of a case
are combined by OR, on the map side first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coincide.functions.let import floor_div
from coincide.operators.association import distance_us
from coincide.operators.ordered import Ordered
from coincide.operators.shift import disruption_intervals
from coincide.params import MAX_LAG_S, MICROS

MAX_LAG_US = MAX_LAG_S * MICROS


def _slot(t: Column) -> Column:
    return floor_div(t, MAX_LAG_US)


def _reach(anchors: DataFrame) -> DataFrame:
    """Anchors once per slot within the largest lag."""
    ts = F.col("ts_us")
    return anchors.select("case_id", "ts_us", "n").withColumn(
        "slot", F.explode(F.sequence(_slot(ts - MAX_LAG_US), _slot(ts + MAX_LAG_US)))
    )


def lag_hits(around: Ordered, window_us: int) -> DataFrame:
    """Anchors hit at each whole-second lag, as steps: (case, lag_s, hits from this lag on)."""
    pieces = (
        disruption_intervals(around, [window_us])
        .withColumn("slot", F.explode(F.sequence(_slot(F.col("from_us")), _slot(F.col("to_us")))))
        .select(
            "case_id",
            "slot",
            F.greatest("from_us", F.col("slot") * MAX_LAG_US).alias("from_us"),
            F.least("to_us", (F.col("slot") + 1) * MAX_LAG_US - 1).alias("to_us"),
        )
    )
    met = _reach(around.df.filter("side = 0")).join(pieces, ["case_id", "slot"])
    first = F.greatest(
        -floor_div(F.col("ts_us") - F.col("from_us"), MICROS), F.lit(-MAX_LAG_S)
    )
    last = F.least(
        floor_div(F.col("to_us") - F.col("ts_us"), MICROS), F.lit(MAX_LAG_S)
    )
    steps = (
        met.select("case_id", "n", first.alias("first"), last.alias("last"))
        .filter("first <= last")
        .select(
            "case_id",
            F.explode(
                F.array(
                    F.struct(F.col("first").alias("lag_s"), F.col("n").alias("step")),
                    F.struct((F.col("last") + 1).alias("lag_s"), (-F.col("n")).alias("step")),
                )
            ).alias("s"),
        )
        .groupBy("case_id", "s.lag_s")
        .agg(F.sum("s.step").alias("step"))
    )
    # At most 2 * MAX_LAG_S + 2 rows per case.
    lags = Window.partitionBy("case_id").orderBy("lag_s")
    return steps.select(
        "case_id",
        "lag_s",
        F.sum("step").over(lags).alias("hits"),
        (F.coalesce(F.lead("lag_s").over(lags), F.lit(MAX_LAG_S + 2)) - 1).alias("until_s"),
    )


def _instants(stream: DataFrame) -> DataFrame:
    """First and last instant of every quarter second of a case, with their slot.

    They give all lags of the stream. Differences of two quarter seconds span less than half a
    second, so they round to at most two neighbouring numbers, those of the outermost ones; and if
    an outermost one lies beyond the largest lag, all others round to the largest lag.
    """
    ends = stream.groupBy("case_id", floor_div(F.col("ts_us"), MICROS // 4).alias("quarter")).agg(
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us")
    )
    instants = F.array_distinct(F.array("first_us", "last_us"))
    return ends.select("case_id", F.explode(instants).alias("ts_us")).withColumn("slot", _slot(F.col("ts_us")))


@F.pandas_udf(T.BinaryType())
def _lags_between(anchors: pd.Series, incidents: pd.Series) -> pd.Series:
    """Bit ``MAX_LAG_S + lag`` for every whole-second difference (half to even) within the largest lag."""

    def lags(a: np.ndarray, i: np.ndarray) -> bytes:
        few, many, sign = (a, np.sort(i), 1) if len(a) < len(i) else (i, np.sort(a), -1)
        seen = np.zeros(2 * MAX_LAG_S + 1, bool)
        for t in few:
            near = many[np.searchsorted(many, t - MAX_LAG_US) : np.searchsorted(many, t + MAX_LAG_US, "right")]
            seen[np.rint(sign * (near - t) / MICROS).astype(np.int64) + MAX_LAG_S] = True
            if seen.all():
                break
        return np.packbits(seen, bitorder="little").tobytes()

    return pd.Series([lags(a, i) for a, i in zip(anchors, incidents)])


@F.pandas_udf(T.ArrayType(T.LongType()))
def _lags_in(bits: pd.Series) -> pd.Series:
    def lags(one: bytes) -> np.ndarray:
        seen = np.unpackbits(np.frombuffer(one, np.uint8), bitorder="little")
        return np.flatnonzero(seen) - MAX_LAG_S

    return bits.map(lags)


def candidate_lags(around: Ordered) -> DataFrame:
    """Distinct whole-second differences within the largest lag (half to even).

    A slot has at most eight instants a second in each stream, so its rows are of bounded size
    however many anchors fall into it, and anchors meet incidents in one row per slot.
    """
    slot = F.col("slot")
    anchors = (
        _instants(around.df.filter("side = 0"))
        .groupBy("case_id", "slot")
        .agg(F.collect_list("ts_us").alias("anchors"))
    )
    incidents = (
        _instants(around.df.filter("side = 1"))
        .withColumn("slot", F.explode(F.sequence(slot - 1, slot + 1)))
        .groupBy("case_id", "slot")
        .agg(F.collect_list("ts_us").alias("incidents"))
    )
    met = anchors.join(incidents, ["case_id", "slot"])
    return (
        met.select("case_id", _lags_between("anchors", "incidents").alias("bits"))
        .groupBy("case_id")
        .agg(F.bitmap_or_agg("bits").alias("bits"))
        .withColumn("bits", F.substring("bits", 1, MAX_LAG_S // 4 + 1))
        .select("case_id", F.explode(_lags_in("bits")).alias("lag_s"))
    )


def lag_scan(around: Ordered, window_us: int) -> DataFrame:
    """Best lag per case: most hits, strictly more than at lag 0, the lowest lag among equals.

    ``around`` holds the unrestricted streams: the period itself comes from the clocks in doubt.
    """
    near = F.coalesce(distance_us("prev_i", "next_i") <= window_us, F.lit(False))
    totals = around.df.groupBy("case_id").agg(
        F.sum(F.when(F.col("side") == 0, F.col("n")).otherwise(0)).alias("n_anchors"),
        F.count_if(F.col("side") == 1).alias("n_incidents"),
        F.sum(F.when((F.col("side") == 0) & near, F.col("n")).otherwise(0)).alias("hits_at_zero"),
    )
    steps = lag_hits(around, window_us)
    hits = candidate_lags(around).join(
        steps.select(
            "case_id", "hits", F.explode(F.sequence("lag_s", "until_s")).alias("lag_s")
        ),
        ["case_id", "lag_s"],
    )
    best = hits.groupBy("case_id").agg(
        F.max(F.struct("hits", (-F.col("lag_s")).alias("earlier"))).alias("best")
    )
    enough = (F.col("n_anchors") >= 3) & (F.col("n_incidents") > 0)
    at_zero = F.when(enough, F.col("hits_at_zero")).otherwise(F.lit(0))
    better = enough & F.coalesce(F.col("best.hits") > at_zero, F.lit(False))
    return (
        totals.join(best, "case_id", "left")
        .select(
            "case_id",
            "n_anchors",
            F.when(better, -F.col("best.earlier")).otherwise(F.lit(0)).alias("best_lag_s"),
            F.when(better, F.col("best.hits")).otherwise(at_zero).alias("best_hits"),
            at_zero.alias("hits_at_zero"),
            F.lit(MAX_LAG_S).alias("searched_s"),
        )
        .withColumn("suspicious", suspicious())
        .withColumn("explanation", F.when(F.col("suspicious"), explanation()))
    )


def suspicious() -> Column:
    """ST11: a shifted alignment beats the recorded one by enough to matter."""
    hits, zero = F.col("best_hits"), F.col("hits_at_zero")
    return (
        (F.col("n_anchors") >= 3)
        & (F.abs("best_lag_s") >= 1)
        & (hits >= zero + 3)
        & (hits >= 0.6 * F.col("n_anchors"))
        & (hits >= 2 * F.greatest(zero, F.lit(1)))
    )


def explanation() -> Column:
    """ST11: what the lag most likely means."""
    lag, size = F.col("best_lag_s"), F.abs("best_lag_s")
    cause = (
        F.when(
            F.abs(size - 3600) < 90,
            "Almost exactly one hour: most likely a timezone or daylight-saving mismatch.",
        )
        .when(
            F.abs(size - 1800) < 60,
            "Almost exactly thirty minutes: most likely a half-hour timezone offset on one source.",
        )
        .when(
            (size % 3600 < 120) | (3600 - size % 3600 < 120),
            "Close to a whole number of hours: most likely a timezone mismatch.",
        )
        .otherwise("One of the clocks is probably wrong by about this much.")
    )
    return F.concat(
        F.lit("The streams line up if anchor times are taken as "),
        size.cast("string"),
        F.when(lag > 0, " s later than recorded (").otherwise(" s earlier than recorded ("),
        F.col("best_hits").cast("string"),
        F.lit(" of "),
        F.col("n_anchors").cast("string"),
        F.lit(" would coincide, against "),
        F.col("hits_at_zero").cast("string"),
        F.lit(" as recorded). "),
        cause,
    )
