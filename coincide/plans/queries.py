"""One query per operator over the driver's tables, keyed by operator id and short name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coincide.functions import probability as pr
from coincide.operators import association as asc
from coincide.operators import dedupe as dd
from coincide.operators import floods as fl
from coincide.operators import nearest as nr
from coincide.operators import shift as sh
from coincide.operators import verdict as vd
from coincide.operators.drops import client_drops
from coincide.operators.incidents import incidents
from coincide.operators.lag import lag_scan
from coincide.params import AnalysisParams, micros
from coincide.plans import analysis, report
from coincide.plans.eventmap import canonical, read_events
from coincide.schema import anchors, disruptions, frames
from coincide.session import durable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters of the registered queries; the oracle uses the same.
PARAMS = AnalysisParams(timezone="UTC", offsets="grid")
WIDTHS = PARAMS.widths_us()
PAIR = ("purchase", "error")
PASSES, FRAMES = ("purchase",), ("error",)
LEASES = ("signup", "click", "view")
GAP = micros(10)
WIDE_GAP = micros(600)
SIX_HOURS = micros(6 * 3600)
FLOOD_WINDOW, FLOOD_K = micros(1800), 5
PASS_WINDOW = micros(600)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def events(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return canonical(read_events(spark, sf_dir), **options)


def big(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("bigint")


def r9(column: str | Column, digits: int = 9) -> Column:
    return F.round(column, digits)


def joined(column: str) -> Column:
    return F.array_join(column, ",")


class Study:
    """Neighbours and periods of one set of events, shared by the statistics."""

    def __init__(self, spark: SparkSession, sf_dir: str, cases: int = 1) -> None:
        self.events = events(spark, sf_dir, cases=cases, types=PAIR)
        self.around = asc.event_neighbours(self.events, GAP)
        self.periods = asc.observation_period(self.around.df, PARAMS.window_us)
        self.inside = asc.within(self.around, self.periods)

    def counts(self, widths: list[int] = WIDTHS) -> DataFrame:
        return asc.width_counts(self.inside, widths)


@query
def dv02_incidents(spark, sf_dir):
    found = incidents(
        events(spark, sf_dir, view_resets=True, types=("error", "view")), WIDE_GAP
    )
    return found.select(
        "case_id", "start_us", "end_us", "n_events",
        *[joined(c).alias(c) for c in ("kinds", "src_macs", "client_macs", "sources")],
        F.array_join(F.col("reason_codes").cast("array<string>"), ",").alias("reason_codes"),
        "has_deauth",
    )


@query
def agg02_kinds(spark, sf_dir):
    return events(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query
def agg05_period(spark, sf_dir):
    period = Study(spark, sf_dir, 8).periods
    return period.select(
        "case_id", "lo_us", "hi_us", "disjoint",
        r9("discarded_anchor_h", 6).alias("discarded_anchor_h"),
        r9("discarded_incident_h", 6).alias("discarded_incident_h"),
    )


@query
def agg06_coverage(spark, sf_dir):
    return Study(spark, sf_dir).counts().select(
        "case_id", "window_us", "span_us", "covered_us", "exposed_us"
    )


@query
def agg07_bins2x2(spark, sf_dir):
    return Study(spark, sf_dir, 8).counts().select(
        "case_id", "window_us", "n_bins", "cell_a", "cell_b", "cell_c", "cell_d"
    )


@query
def agg08_rates(spark, sf_dir):
    return asc.rates(Study(spark, sf_dir).counts()).select(
        "case_id", "window_us", "incidents_inside", "incidents_outside",
        r9("rate_in_per_min").alias("rate_in"), r9("rate_out_per_min").alias("rate_out"),
        r9("rate_ratio").alias("rate_ratio"), "rate_ratio_corrected",
    )


@query
def st01_baseline(spark, sf_dir):
    return asc.rates(Study(spark, sf_dir, 8).counts([PARAMS.window_us])).select(
        "case_id", "n_anchors", "n_coincident", r9("coincidence_rate").alias("rate"),
        r9("baseline_rate").alias("baseline"), r9("expected_by_chance", 6).alias("expected"),
        r9("lift", 6).alias("lift"),
    )


def _log10(p: Column) -> Column:
    return F.round(F.log10(p), 5)


@query
def st02_binomial(spark, sf_dir):
    counts = asc.rates(Study(spark, sf_dir, 8).counts())
    p = pr.binomial_p(F.col("n_coincident"), F.col("n_anchors"), F.col("baseline_rate"))
    return counts.select("case_id", "window_us", _log10(p).alias("log10_p"))


@query
def st04_fisher(spark, sf_dir):
    counts = Study(spark, sf_dir, 8).counts()
    cells = [F.col(f"cell_{x}") for x in "abcd"]
    return counts.select(
        "case_id", "window_us", _log10(pr.fisher_p(*cells)).alias("log10_p"),
        r9(pr.odds_ratio(*cells), 6).alias("odds_ratio"),
    )


@query
def st05_chi2(spark, sf_dir):
    cells = [F.col(f"cell_{x}") for x in "abcd"]
    return Study(spark, sf_dir, 8).counts().select(
        "case_id", "window_us", r9(pr.chi_square(*cells), 6).alias("chi2")
    )


@query
def st05_chi2_p(spark, sf_dir):
    cells = [F.col(f"cell_{x}") for x in "abcd"]
    chi2 = pr.chi_square(*cells)
    return Study(spark, sf_dir, 8).counts().select(
        "case_id", "window_us", _log10(pr.chi_square_p(chi2)).alias("log10_p")
    )


@query
def st03_shift_grid(spark, sf_dir):
    study = Study(spark, sf_dir)
    counts = sh.shift_counts(study.inside, [PARAMS.window_us], PARAMS.trials, PARAMS.seed, "grid")
    return counts.select("case_id", "window_us", "trial", big("hits").alias("hits"))


@query
def st03_shift_test(spark, sf_dir):
    """The p-value with 10 000 pseudo-random offsets, as an analysis reports it."""
    study = Study(spark, sf_dir)
    observed = study.counts([PARAMS.window_us])
    return sh.shift_test(observed, study.inside, [PARAMS.window_us], 10_000, PARAMS.seed, "numpy").select(
        "case_id", "window_us", "perm_p", "perm_mean"
    )


def _stats(spark, sf_dir, cases: int, widths: list[int]) -> DataFrame:
    study = Study(spark, sf_dir, cases)
    return analysis.window_stats(study.around, study.periods, widths, PARAMS.trials, PARAMS)


@query
def st07_combined(spark, sf_dir):
    return _stats(spark, sf_dir, 8, [PARAMS.window_us]).select(
        "case_id", _log10(F.col("best_p")).alias("log10_best"),
        _log10(F.col("worst_p")).alias("log10_worst"), "weakest_test", "straddles",
    )


@query
def st08_verdict(spark, sf_dir):
    decided = vd.decide(_stats(spark, sf_dir, 8, [PARAMS.window_us]), PARAMS.alpha)
    return decided.select(
        "case_id", "label", "headline", F.size("reasons").cast("bigint").alias("n_reasons"),
        F.array_join("reasons", "; ").alias("reasons"),
    )


@query
def st09_sensitivity(spark, sf_dir):
    return _stats(spark, sf_dir, 1, WIDTHS).select(
        "case_id", "window_us", "n_coincident", "n_anchors", r9("baseline_rate").alias("baseline"),
        r9("rate_ratio", 6).alias("rate_ratio"), _log10(F.col("binom_p")).alias("log10_binom"),
        _log10(F.col("perm_p")).alias("log10_perm"), _log10(F.col("fisher_p")).alias("log10_fisher"),
        _log10(F.col("worst_p")).alias("log10_worst"),
    )


@query
def st10_lag_scan(spark, sf_dir):
    scan = lag_scan(Study(spark, sf_dir, 8).around, PARAMS.window_us)
    return scan.select(
        "case_id", big("n_anchors").alias("n_anchors"), big("best_lag_s").alias("best_lag_s"),
        big("best_hits").alias("best_hits"), big("hits_at_zero").alias("hits_at_zero"), "suspicious",
        "explanation",
    )


@query
def st12_calibration(spark, sf_dir):
    """Every user is a case; cases are grouped into scenarios by user id modulo four."""
    ev = events(spark, sf_dir, cases=None, types=PAIR)
    around = asc.event_neighbours(ev, GAP)
    periods = asc.observation_period(around.df, PARAMS.window_us)
    stats = analysis.window_stats(around, periods, [PARAMS.window_us], PARAMS.trials, PARAMS)
    scenario = (F.substring("case_id", 5, 12).cast("bigint") % 4).alias("scenario")
    study = vd.calibration(stats.select("*", scenario), "scenario", PARAMS.alpha)
    return study.select(
        "scenario", "cases", "flagged_worst", "flagged_best", r9("ci_low").alias("ci_low"),
        r9("ci_high").alias("ci_high"), "exceeds_alpha",
    )


@query
def agg13_wilson(spark, sf_dir):
    ev = read_events(spark, sf_dir)
    shares = ev.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("k")
    )
    low, high = pr.wilson(F.col("k"), F.col("n"))
    return shares.select("user_id", "k", "n", r9(low).alias("ci_low"), r9(high).alias("ci_high"))


@query
def jn01_nearest_incident(spark, sf_dir):
    ev = events(spark, sf_dir, cases=8, types=PAIR)
    others = incidents(ev, GAP).select("case_id", F.col("start_us").alias("ts_us"))
    return nr.nearest(anchors(ev).select("case_id", "seq", "ts_us"), others).select(
        "case_id", "seq", "nearest_us", "delta_us"
    )


@query
def jn02_band_count(spark, sf_dir):
    ev = events(spark, sf_dir, types=PAIR)
    return nr.band_count(
        anchors(ev).select("case_id", "seq", "ts_us"), disruptions(ev), WIDE_GAP
    ).select("case_id", "seq", big("events_in_window").alias("events_in_window"))


@query
def jn03_coincidence(spark, sf_dir):
    ev = events(spark, sf_dir, types=PAIR)
    return nr.coincident(
        anchors(ev).select("case_id", "seq", "ts_us"), frames(ev), PARAMS.window_us
    ).select("case_id", "seq", "delta_us")


@query
def jn05_point_in_interval(spark, sf_dir):
    """Incidents inside the union of anchor windows, per width."""
    return Study(spark, sf_dir, 8).counts().select("case_id", "window_us", "incidents_inside")


def _matches(spark, sf_dir, window_us: int = WIDE_GAP) -> DataFrame:
    ev = events(spark, sf_dir, view_resets=True, types=(*PAIR, "view"))
    found = durable(incidents(ev, GAP), "incidents")
    streams = asc.both_streams(anchors(ev), found.select("case_id", "start_us"))
    periods = durable(asc.observation_period(streams, window_us), "periods")
    return nr.match_table(ev, found, periods, window_us)


@query
def jn10_match_table(spark, sf_dir):
    return _matches(spark, sf_dir).select(
        "seq", "event_us", "plate", "coincidence", "nearest_kind", r9("delta_s", 3).alias("delta_s"),
        "attacker_mac", big("reason_code").alias("reason_code"), "client_mac",
        r9("deauth_delta_s", 3).alias("deauth_delta_s"), r9("drop_delta_s", 3).alias("drop_delta_s"),
        big("events_in_window").alias("events_in_window"), "in_analysis_period", "camera_source",
    )


@query
def agg09_delta_summary(spark, sf_dir):
    coincident = _matches(spark, sf_dir).filter("coincidence")
    return coincident.agg(
        F.count(F.lit(1)).alias("n"),
        r9(F.percentile("delta_s", 0.5), 4).alias("median_s"),
        F.min("delta_s").alias("min_s"),
        F.max("delta_s").alias("max_s"),
    )


@query
def agg09_delta_by_case(spark, sf_dir):
    """The report's table of distances, per case."""
    return report.delta_summary(_matches(spark, sf_dir)).select(
        "case_id", "n", r9("median_s", 4).alias("median_s"), "min_s", "max_s"
    )


@query
def agg02_kind_table(spark, sf_dir):
    """The report's table of kinds, per case."""
    return report.kind_counts(events(spark, sf_dir, cases=8))


@query
def dv01_client_drops(spark, sf_dir):
    found = client_drops(
        events(spark, sf_dir, view_resets=True, types=LEASES), SIX_HOURS, SIX_HOURS // 6
    )
    return found.select("ts_us", "client_mac", "kind", "category", "subtype", "source_kind")


def _flood_frames(spark, sf_dir) -> DataFrame:
    return fl.flood_frames(events(spark, sf_dir, types=FRAMES), FLOOD_WINDOW, FLOOD_K)


@query
def dv03_floods(spark, sf_dir):
    return fl.floods(_flood_frames(spark, sf_dir), FLOOD_WINDOW).select(
        "case_id", "start_us", "end_us", r9("duration_s", 6).alias("duration_s"), "n_frames",
        r9("peak_rate_per_s", 9).alias("peak_rate_per_s"), "top_source", "broadcast_frames",
    )


@query
def agg03_flood_tallies(spark, sf_dir):
    return fl.flood_tallies(_flood_frames(spark, sf_dir))


@query
def agg03_frame_tallies(spark, sf_dir):
    return fl.frame_tallies(events(spark, sf_dir, types=FRAMES))


@query
def agg12_signature_share(spark, sf_dir):
    return fl.frame_totals(events(spark, sf_dir, cases=8, types=FRAMES)).select(
        "case_id", "total_frames", "broadcast_frames", "signature_frames",
        F.array_join(F.col("signature_codes").cast("array<string>"), ",").alias("signature_codes"),
        r9("signature_share").alias("signature_share"),
    )


@query
def dd01_dedupe(spark, sf_dir):
    kept = dd.dedupe_anchors(events(spark, sf_dir, types=PASSES), PASS_WINDOW)
    return anchors(kept).select("case_id", "seq", "ts_us", "source_file", "plate")


@query
def dd01_summary(spark, sf_dir):
    """The note that tells how many anchor rows were merged away."""
    rows = anchors(events(spark, sf_dir, types=PASSES))
    return dd.dedupe_summary(dd.merged_sets(rows, PASS_WINDOW))


@query
def dd02_debounce(spark, sf_dir):
    rows = anchors(events(spark, sf_dir, types=PASSES)).select("case_id", "source_file", "seq", "ts_us")
    return dd.debounce(rows, ["case_id", "source_file"], WIDE_GAP)
