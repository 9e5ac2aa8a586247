"""SNK04 / SNK05: the numbers of a report, as tables and as one JSON document per case."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coincide.functions.display import fixed, humanize_delta, lift_text, number_text, p_text
from coincide.functions.reasons import reason_text
from coincide.params import AnalysisParams
from coincide.plans.analysis import Analysis
from coincide.plans.sinks import iso

# Lengths of report tables.
TOP_SOURCES, TOP_FLOODS = 25, 40
#: Files and warnings that a document lists of each case; it counts the others.
LISTED = 1000
NUMBERS = (
    "window_us", "n_anchors", "n_incidents", "n_coincident", "coincidence_rate", "baseline_rate",
    "expected_by_chance", "lift", "binom_p", "perm_p", "perm_mean", "perm_trials", "fisher_p",
    "fisher_odds_ratio", "chi2", "chi2_p", "cell_a", "cell_b", "cell_c", "cell_d",
    "incidents_inside", "incidents_outside", "exposed_minutes", "unexposed_minutes",
    "rate_in_per_min", "rate_out_per_min", "rate_ratio", "rate_ratio_corrected", "best_p", "worst_p",
)


def kind_counts(events: DataFrame) -> DataFrame:
    """AGG02 / TK03: events per kind, most frequent first."""
    counts = events.groupBy("case_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy("case_id", F.desc("n"), "kind")


def delta_summary(matches: DataFrame) -> DataFrame:
    """AGG09: median, lowest and highest distance of coincident anchors."""
    summary = (
        matches.filter("coincidence")
        .groupBy("case_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.percentile("delta_s", 0.5).alias("median_s"),
            F.min("delta_s").alias("min_s"),
            F.max("delta_s").alias("max_s"),
        )
    )

    def words(column: str) -> Column:
        return humanize_delta(F.round(F.col(column) * 1e6).cast("bigint"))

    return summary.withColumns(
        {f"{c}_text": words(f"{c}_s") for c in ("median", "min", "max")}
    )


def statistics_table(stats: DataFrame) -> DataFrame:
    """Section 3 and 4 rows, with numbers as text."""
    return stats.select(
        "case_id",
        "window_us",
        F.concat("n_coincident", F.lit("/"), "n_anchors").alias("coincidences"),
        F.concat(fixed(F.col("baseline_rate") * 100, 1), F.lit("%")).alias("baseline"),
        lift_text(F.col("lift")).alias("lift"),
        number_text(F.col("rate_ratio")).alias("rate_ratio"),
        p_text(F.col("binom_p")).alias("binomial_p"),
        p_text(F.col("perm_p")).alias("permutation_p"),
        p_text(F.col("fisher_p")).alias("fisher_p"),
        number_text(F.col("fisher_odds_ratio")).alias("odds_ratio"),
        p_text(F.col("chi2_p")).alias("chi_square_p"),
        p_text(F.col("worst_p")).alias("weakest_p"),
    )


def _first_per_case(rows: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The first rows of each case; Spark limits every task's rows before the shuffle."""
    place = F.row_number().over(Window.partitionBy("case_id").orderBy(*order))
    return rows.withColumn("place", place).filter(F.col("place") <= limit).drop("place")


def top_sources(tallies: DataFrame, limit: int = TOP_SOURCES) -> DataFrame:
    """TK02: each case's sources with the most frames."""
    sources = tallies.filter("what = 'source'").select(
        "case_id", F.col("value").alias("src_mac"), "n_frames"
    )
    return _first_per_case(sources, limit, F.desc("n_frames"), F.asc("src_mac"))


def reason_table(tallies: DataFrame) -> DataFrame:
    """TK03: reason codes by frames."""
    code = F.col("value").cast("int")
    return (
        tallies.filter("what = 'reason'")
        .select("case_id", code.alias("reason_code"), reason_text(code).alias("meaning"), "n_frames")
        .orderBy(F.desc("n_frames"), "reason_code", "case_id")
    )


def first_floods(floods: DataFrame, limit: int = TOP_FLOODS) -> DataFrame:
    """TK04: each case's first floods, with how many are left out of the table."""
    omitted = floods.groupBy("case_id").agg(
        F.greatest(F.count(F.lit(1)) - limit, F.lit(0)).alias("omitted")
    )
    return _first_per_case(floods, limit, F.asc("start_us")).join(omitted, "case_id")


def _finite(columns: tuple[str, ...], schema: dict[str, str]) -> Column:
    """A struct of numbers in which infinite and undefined ones are NULL, and listed by name."""
    doubles = [c for c in columns if schema[c] == "double"]

    def infinite(c: str) -> Column:
        return F.abs(F.col(c)) == float("inf")

    values = [
        F.when(~F.coalesce(infinite(c), F.lit(False)), F.col(c)).alias(c) if c in doubles else F.col(c)
        for c in columns
    ]
    state = F.map_filter(
        F.create_map(
            *[
                part
                for c in doubles
                for part in (
                    F.lit(c),
                    F.when(F.col(c).isNull(), "undefined").when(infinite(c), "infinite"),
                )
            ]
        ),
        lambda _, v: v.isNotNull(),
    )
    return F.struct(*values, state.alias("_non_finite_fields"))


def input_records(files: DataFrame, sums: DataFrame, case_id: Column | None = None) -> DataFrame:
    """SNK07: what was read: every file with role, format, accepted rows, size and checksum.

    ``files`` are those of ``read_inputs``, ``sums`` those of ``file_checksums``. A file that has gone
    since it was read keeps its row, without size and checksum.
    """
    return files.select("path", "role", "parser", "rows").join(
        sums.select("path", "length", "sha256"), "path", "left"
    ).select((F.lit("case0") if case_id is None else case_id).alias("case_id"), "path", "role", "parser", "rows", "length", "sha256")


def input_warnings(quality: DataFrame, case_id: Column | None = None) -> DataFrame:
    """Rows left out, doubtful formats and assumptions of ``read_inputs``, as warnings of a case."""
    return quality.select((F.lit("case0") if case_id is None else case_id).alias("case_id"), "source_file", "reason", "n")


def _listed(rows: DataFrame, limit: int, *order: str) -> DataFrame:
    """The first rows of each case as one array, and how many there are in all.

    Only the first ``limit`` rows of a case are gathered; tasks drop the others before the shuffle.
    """
    first = _first_per_case(rows, limit, *[F.asc_nulls_first(c) for c in order])
    others = [c for c in rows.columns if c != "case_id" and c not in order]
    lists = first.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(*order, *others))).alias("listed"))
    return rows.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).join(lists, "case_id")


def manifest(
    analysis: Analysis,
    inputs: DataFrame | None = None,
    outputs: DataFrame | None = None,
    warnings: DataFrame | None = None,
) -> DataFrame:
    """SNK04: one JSON document per case.

    ``inputs`` and ``outputs`` have a ``case_id``, a ``path`` and any further columns (see
    :func:`input_records`), ``warnings`` those of :func:`input_warnings`. Tables that grow with the
    evidence (events, matches, all floods) are written beside it; the document carries their totals and
    lists the first ``TOP_FLOODS`` floods and the first ``LISTED`` files and warnings, with how many there
    are. What was merged away, what the period left out, and floods follow from the analysis itself.
    """
    params: AnalysisParams = analysis.params
    kinds = dict(analysis.stats.dtypes)
    stats = analysis.stats.select(
        "case_id",
        F.struct("label", "headline", "reasons").alias("verdict"),
        _finite(NUMBERS, kinds).alias("statistics"),
    )
    sweep = analysis.sensitivity.select(
        "case_id", _finite(NUMBERS, dict(analysis.sensitivity.dtypes)).alias("s")
    )
    # One entry per width, at most six.
    sweep = sweep.groupBy("case_id").agg(
        F.array_sort(
            F.collect_list("s"), lambda x, y: F.signum(x["window_us"] - y["window_us"]).cast("int")
        ).alias("sensitivity")
    )
    lag = analysis.lag.select(
        "case_id",
        F.struct("best_lag_s", "best_hits", "hits_at_zero", "searched_s", "suspicious").alias(
            "clock_offset_scan"
        ),
    )
    floods = analysis.floods.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_floods"))
    frames = analysis.frame_totals.join(floods, "case_id", "left").select(
        "case_id",
        F.struct(
            "total_frames", "broadcast_frames", "signature_frames",
            F.coalesce("n_floods", F.lit(0)).alias("n_floods"),
        ).alias("floods"),
    )
    period = analysis.periods.select(
        "case_id",
        F.struct(
            iso(F.col("lo_us"), "UTC").alias("start_utc"),
            iso(F.col("hi_us"), "UTC").alias("end_utc"),
            (F.greatest(F.col("hi_us") - F.col("lo_us"), F.lit(0)) / 3.6e9).alias("hours"),
            period_notes().alias("notes"),
        ).alias("analysis_period"),
    )
    away = analysis.merged_passes.select("case_id", F.struct("removed", "merged_sets").alias("merged_passes"))
    detail = first_floods(analysis.floods).select(
        "case_id", iso(F.col("start_us"), "UTC").alias("start_utc"), iso(F.col("end_us"), "UTC").alias("end_utc"),
        "duration_s", "n_frames", "peak_rate_per_s", "top_source", "broadcast_frames",
    )
    detail = detail.groupBy("case_id").agg(
        F.array_sort(F.collect_list(F.struct(*[c for c in detail.columns if c != "case_id"]))).alias("first_floods")
    )
    whole = stats
    for part in (period, sweep, lag, frames, away, detail):
        whole = whole.join(part, "case_id", "left")
    given = {"inputs": (inputs, ["path"]), "outputs": (outputs, ["path"]), "warnings": (warnings, ["source_file", "reason"])}
    for name, (rows, order) in given.items():
        if rows is not None:
            whole = whole.join(
                _listed(rows, LISTED, *order).select(
                    "case_id", F.struct("n", "listed").alias(name)
                ), "case_id", "left",
            )
    given = [name for name, (rows, _) in given.items() if rows is not None]
    document = F.struct(
        "verdict", "statistics", "sensitivity", "clock_offset_scan", "floods", "first_floods", "analysis_period",
        "merged_passes", *given,
        F.struct(*[F.lit(v).alias(k) for k, v in asdict(params).items()]).alias("configuration"),
    )
    return whole.select("case_id", F.to_json(document).alias("manifest"))


def period_notes() -> Column:
    """AGG05: what the choice of period left out."""
    quarter = 0.25

    def note(column: str, what: str) -> Column:
        return F.when(
            F.col(column) > quarter,
            F.concat(fixed(F.col(column), 1), F.lit(f" h of {what} lie outside the period")),
        )

    return F.array_compact(
        F.array(
            F.when(F.col("disjoint"), "the two streams do not overlap in time"),
            note("discarded_anchor_h", "anchor events"),
            note("discarded_incident_h", "disruptions"),
        )
    )
