"""ST07 / ST08 / ST12: combine the tests into a three-way verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coincide.functions.display import fixed, general
from coincide.functions.probability import wilson
from coincide.params import MIN_COINCIDENCES, MIN_RATE_RATIO

FOUND = "CORRELATION FOUND"
NOT_FOUND = "CORRELATION NOT ESTABLISHED"
INSUFFICIENT = "INSUFFICIENT DATA"

_TESTS = (
    ("binom_p", "the binomial test"),
    ("perm_p", "the permutation test"),
    ("fisher_p", "Fisher's exact test"),
)


def combine_tests(stats: DataFrame, alpha: float) -> DataFrame:
    """ST07: best, worst and weakest of the defined p-values, and whether they disagree."""
    values = [F.col(name) for name, _ in _TESTS]
    worst = F.greatest(*values)
    weakest = F.lit("no test")
    for name, label in reversed(_TESTS):
        weakest = F.when(F.col(name) == worst, label).otherwise(weakest)

    def some(test) -> Column:
        found = F.lit(False)
        for value in values:
            found = found | F.coalesce(test(value), F.lit(False))
        return found

    return stats.withColumns(
        {
            "best_p": F.coalesce(F.least(*values), F.lit(1.0)),
            "worst_p": F.coalesce(worst, F.lit(1.0)),
            "weakest_test": weakest,
            "straddles": some(lambda p: p < alpha) & some(lambda p: p >= alpha),
        }
    )


def decide(stats: DataFrame, alpha: float) -> DataFrame:
    """ST08: label, headline and reasons per row of combined statistics.

    A finding needs enough coincidences, the *least* favourable test below ``alpha`` and a rate
    ratio of at least two; an undefined ratio does not qualify.
    """
    hits, m = F.col("n_coincident"), F.col("n_anchors")
    few = m < MIN_COINCIDENCES
    nothing = F.col("n_incidents") == 0
    enough = hits >= MIN_COINCIDENCES
    clear = F.col("worst_p") < alpha
    ratio = F.coalesce(F.col("rate_ratio") >= MIN_RATE_RATIO, F.lit(False))
    found = enough & clear & ratio
    label = (
        F.when(few | nothing, INSUFFICIENT).when(found, FOUND).otherwise(NOT_FOUND)
    )

    def said(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    level = f"{alpha:g}"
    width = general(F.col("window_us") / 1e6)
    worst3 = general(F.col("worst_p"), 3)
    ratio_text = fixed(F.col("rate_ratio"), 2)
    expected = fixed(F.col("expected_by_chance"), 1)
    against = F.array_compact(
        F.array(
            F.when(
                ~enough,
                said("only ", hits, " of ", m, " anchors coincided; ", str(MIN_COINCIDENCES), " needed"),
            ),
            F.when(
                ~clear,
                said(
                    F.col("weakest_test"), " gave p = ", general(F.col("worst_p"), 4),
                    ", which does not clear ", level,
                ),
            ),
            F.when(~ratio & F.col("rate_ratio").isNull(), F.lit("no rate ratio could be computed")),
            F.when(
                ~ratio & F.col("rate_ratio").isNotNull(),
                said("rate ratio only ", ratio_text, "x; ", f"{MIN_RATE_RATIO:g}x needed"),
            ),
            F.when(
                F.col("straddles"),
                said(
                    "the tests disagree: p ranges from ", general(F.col("best_p"), 3), " to ",
                    worst3, " across ", level,
                ),
            ),
        )
    )
    for_it = F.array(
        said(hits, " coincidences"),
        said("every test below ", level, " (weakest p = ", worst3, ")"),
        said("rate ratio ", ratio_text, "x"),
    )
    headline = (
        F.when(few, said("Only ", m, " anchor event(s) in the period; ", str(MIN_COINCIDENCES), " needed."))
        .when(nothing, "No disruptions in the evidence.")
        .when(
            found,
            said(
                hits, " of ", m, " anchors coincided with a disruption within +/-", width, " s; ",
                expected, " expected by chance (every test p <= ", worst3, ").",
            ),
        )
        .otherwise(
            said(
                hits, " of ", m, " anchors coincided with a disruption within +/-", width,
                " s, not distinguishable from chance (", expected, " expected).",
            )
        )
    )
    reasons = (
        F.when(few, F.array(F.lit("too few anchor events")))
        .when(nothing, F.array(F.lit("no disruption events")))
        .when(found, for_it)
        .otherwise(against)
    )
    return stats.withColumns({"label": label, "headline": headline, "reasons": reasons})


def calibration(decided: DataFrame, scenario: str, alpha: float) -> DataFrame:
    """ST12 / AGG13: share of cases flagged per scenario under two rules, with Wilson bounds.

    ``worst``: every test must clear ``alpha``. ``best``: one is enough, the rule not used.
    """
    gate = (F.col("n_coincident") >= MIN_COINCIDENCES) & F.coalesce(
        F.col("rate_ratio") >= MIN_RATE_RATIO, F.lit(False)
    )
    shares = decided.groupBy(scenario).agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(gate & (F.col("worst_p") < alpha)).alias("flagged_worst"),
        F.count_if(gate & (F.col("best_p") < alpha)).alias("flagged_best"),
    )
    low, high = wilson(F.col("flagged_worst"), F.col("cases"))
    return shares.withColumns(
        {
            "rate_worst": F.col("flagged_worst") / F.col("cases"),
            "rate_best": F.col("flagged_best") / F.col("cases"),
            "ci_low": low,
            "ci_high": high,
        }
    ).withColumn("exceeds_alpha", F.col("ci_low") > alpha)
