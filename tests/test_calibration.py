"""The calibration study in one plan: many simulated cases per scenario."""

import numpy as np

from coincide.operators import association as asc
from coincide.operators.verdict import calibration
from coincide.params import AnalysisParams
from coincide.plans.analysis import window_stats
from coincide.schema import conform
from pyspark.sql import functions as F

PERIOD_S = 6 * 3600


def simulate(rng, cases):
    """Scenario name, case, second and kind of every simulated event."""
    rows = []

    def add(scenario, case, times, kind):
        rows.extend((scenario, f"{scenario}-{case}", int(t * 1e6), kind) for t in times)

    for case in range(cases):
        passes = rng.uniform(0, PERIOD_S, 8)
        add("independent", case, passes, "camera")
        add("independent", case, rng.uniform(0, PERIOD_S, 75), "deauth")
        passes = rng.uniform(0, PERIOD_S, 8)
        add("clustered", case, np.concatenate([p + rng.uniform(0, 3, 5) for p in passes]), "camera")
        add("clustered", case, rng.uniform(0, PERIOD_S, 75), "deauth")
        passes = rng.uniform(0, PERIOD_S, 12)
        add("every pass", case, passes, "camera")
        add("every pass", case, passes + rng.uniform(2, 8, 12), "deauth")
        add("every pass", case, rng.uniform(0, PERIOD_S, 20), "deauth")
    return rows


def test_false_positives_and_power(spark):
    rows = simulate(np.random.default_rng(20260803), 100)
    raw = spark.createDataFrame(rows, "scenario string, case_id string, ts_us bigint, kind string")
    events = conform(
        raw.withColumn("seq", F.monotonically_increasing_id()).withColumn(
            "category", F.expr("if(kind = 'camera', 'camera', 'disruption')")
        )
    )
    params = AnalysisParams(timezone="UTC", trials=600)
    around = asc.event_neighbours(events, 10_000_000, 4)
    periods = asc.observation_period(around.df, params.window_us)
    stats = window_stats(around, periods, [params.window_us], params.trials, params)
    scenario = F.substring_index("case_id", "-", 1).alias("scenario")
    found = {
        r.scenario: r
        for r in calibration(stats.select("*", scenario), "scenario", params.alpha).collect()
    }
    assert {r.cases for r in found.values()} == {100}
    assert not found["independent"].exceeds_alpha and not found["clustered"].exceeds_alpha
    assert found["every pass"].rate_worst >= 0.95
    assert all(r.flagged_best >= r.flagged_worst for r in found.values())
