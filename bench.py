"""Time the headline queries and print one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "dv02_incidents", "jn01_nearest_incident", "jn02_band_count", "jn10_match_table",
    "dv01_client_drops", "dv03_floods", "dd01_dedupe", "agg07_bins2x2", "st03_shift_grid",
    "st03_shift_test", "st08_verdict", "st09_sensitivity", "st10_lag_scan", "st12_calibration",
    "src01_syslog", "src11_frames",
)


def shift_times(spark, sf_dir: str) -> dict[str, float]:
    """The permutation test at several numbers of trials."""
    from coincide.operators.shift import shift_counts
    from coincide.plans.queries import PARAMS, Study

    out = {}
    for trials in (200, 2_000, 10_000):
        start = time.perf_counter()
        counts = shift_counts(Study(spark, sf_dir).inside, [PARAMS.window_us], trials, PARAMS.seed, "grid")
        counts.write.format("noop").mode("overwrite").save()
        out[f"st03_{trials}_trials"] = round(time.perf_counter() - start, 3)
    return out


def cases(spark, sf_dir: str) -> int:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().count()


def main() -> None:
    from pyspark.sql import SparkSession

    import coincide.plans.text_queries  # noqa: F401  (registers its queries)
    from coincide.plans.queries import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or [q for q in HEADLINE if q in QUERIES]
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("coincide-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    seconds = {}
    for name in only:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    detail = {} if sys.argv[1:] else shift_times(spark, sf_dir) | {
        "st12_cases_per_sec": round(cases(spark, sf_dir) / seconds["st12_calibration"], 1)}
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "detail": detail,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
