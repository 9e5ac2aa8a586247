"""The whole analysis as one set of named tables, for one case or many."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coincide.functions.probability import (
    binomial_p,
    chi_square,
    chi_square_p,
    fisher_p,
    odds_ratio,
)
from coincide.operators import floods as fl
from coincide.operators.association import (
    N_BINS,
    each_width,
    event_neighbours,
    observation_period,
    rates,
    width_counts,
    within,
)
from coincide.operators.dedupe import merge_passes
from coincide.operators.drops import with_client_drops
from coincide.operators.incidents import incidents
from coincide.operators.lag import lag_scan
from coincide.operators.nearest import match_table
from coincide.operators.ordered import Ordered
from coincide.operators.shift import shift_test
from coincide.operators.verdict import combine_tests, decide
from coincide.params import AnalysisParams, micros
from coincide.session import durable


@dataclass(frozen=True)
class Analysis:
    events: DataFrame
    incidents: DataFrame
    periods: DataFrame
    stats: DataFrame
    sensitivity: DataFrame
    lag: DataFrame
    matches: DataFrame
    floods: DataFrame
    flood_tallies: DataFrame
    frame_totals: DataFrame
    merged_passes: DataFrame
    params: AnalysisParams


def window_stats(
    around: Ordered,
    periods: DataFrame,
    widths_us: list[int],
    trials: int,
    params: AnalysisParams,
) -> DataFrame:
    """ST01-ST07 for every case and width; cases without rows in their period get zeros.

    ``around`` is unrestricted; the period is applied here.
    """
    inside = within(around, periods)
    counts = width_counts(inside, widths_us)
    every = periods.select(
        "case_id",
        (F.col("hi_us") - F.col("lo_us")).alias("period_us"),
        each_width(widths_us).alias("window_us"),
    )
    bins = F.expr(N_BINS.format(span="period_us"))
    filled = (
        every.join(counts, ["case_id", "window_us"], "left")
        .withColumns(
            {
                "span_us": F.coalesce("span_us", F.greatest("period_us", F.lit(0))),
                "n_bins": F.coalesce("n_bins", bins),
                "cell_d": F.coalesce("cell_d", bins),
            }
        )
        .drop("period_us")
        .fillna(0)
    )
    cells = [F.col(f"cell_{x}") for x in "abcd"]
    shifted = shift_test(filled, inside, widths_us, trials, params.seed, params.offsets)
    tested = (
        rates(shifted)
        .withColumn("binom_p", binomial_p(F.col("n_coincident"), F.col("n_anchors"), F.col("baseline_rate")))
        .withColumn("fisher_p", fisher_p(*cells))
        .withColumn("fisher_odds_ratio", odds_ratio(*cells))
        .withColumn("chi2", chi_square(*cells))
        .withColumn("chi2_p", chi_square_p(F.col("chi2")))
    )
    return combine_tests(tested.withColumn("perm_trials", F.lit(trials)), params.alpha)


def prepare(
    events: DataFrame, params: AnalysisParams, chunks: int | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events with derived drops and merged anchors, the incidents among them, and how many were merged."""
    derived = with_client_drops(
        events, micros(params.reassoc_window_s), micros(params.reconnect_window_s), chunks
    )
    left, away = merge_passes(derived, micros(params.camera_dedupe_s), chunks)
    merged = durable(left, "events")
    found = durable(incidents(merged, micros(params.incident_gap_s), chunks), "incidents")
    return merged, found, away


def run_analysis(
    events: DataFrame, params: AnalysisParams, chunks: int | None = None
) -> Analysis:
    """Everything the analysis reports, as DataFrames keyed by ``case_id``."""
    problems = params.validate()
    if problems:
        raise ValueError("; ".join(problems))
    merged, found, away = prepare(events, params, chunks)
    around = event_neighbours(merged, micros(params.incident_gap_s), chunks)
    periods = durable(observation_period(around.df, params.window_us), "periods")

    stats = window_stats(around, periods, [params.window_us], params.trials, params)
    widths = params.widths_us() if params.sensitivity else []
    sensitivity = (
        window_stats(around, periods, widths, params.trials, params).filter(
            "n_anchors > 0 AND n_incidents > 0"
        )
        if widths
        else stats.limit(0)
    )
    flood_us = micros(params.flood_window_s)
    flood_rows = durable(
        fl.flood_frames(merged, flood_us, params.flood_threshold, chunks), "flood-frames"
    )
    return Analysis(
        events=merged,
        incidents=found,
        periods=periods,
        stats=decide(stats, params.alpha),
        sensitivity=sensitivity,
        lag=lag_scan(around, params.window_us),
        matches=match_table(merged, found, periods, params.window_us, params.timezone, chunks),
        floods=fl.floods(flood_rows, flood_us),
        flood_tallies=fl.flood_tallies(flood_rows),
        frame_totals=fl.frame_totals(merged),
        merged_passes=away,
        params=params,
    )
