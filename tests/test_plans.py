import json
import random

import brute
import pytest
from pyspark.sql import functions as F

from coincide.functions import probability as pr
from coincide.operators.verdict import combine_tests, decide
from coincide.params import AnalysisParams
from coincide.plans import report, sinks
from coincide.plans.analysis import run_analysis

S = 1_000_000


def planted(seed=1, n=12):
    """Anchors with a disruption a few seconds later, and some background."""
    rng = random.Random(seed)
    rows = []
    for t in sorted(rng.uniform(120, 14_280) for _ in range(n)):
        rows.append(dict(ts_us=int(t) * S, kind="camera", category="camera", source_file="a", plate="P"))
        for i in range(8):
            rows.append(
                dict(
                    ts_us=int((t + rng.uniform(2, 4) + i * 0.09) * S), kind="deauth", category="disruption",
                    src_mac="de:ad:be:ef:00:01", dst_mac="ff:ff:ff:ff:ff:ff", reason_code=7,
                )
            )
    for _ in range(4):
        t = rng.uniform(0, 14_400)
        rows.append(dict(ts_us=int(t * S), kind="link_reset", category="disruption", client_mac="x"))
    return rows


@pytest.mark.parametrize("chunks", [None, 5])
def test_planted_relation_is_found(spark, chunks):
    params = AnalysisParams(timezone="America/New_York", trials=1000)
    a = run_analysis(brute.frame(spark, planted()), params, chunks)
    row = a.stats.first()
    assert row.label == "CORRELATION FOUND" and row.n_coincident == row.n_anchors == 12
    assert row.perm_p < 0.01 and row.binom_p < 1e-8 and len(row.reasons) == 3
    assert a.sensitivity.count() == 5
    assert a.floods.count() == 12
    assert a.matches.filter("coincidence").count() == 12
    document = json.loads(report.manifest(a).first().manifest)
    assert document["verdict"]["label"] == "CORRELATION FOUND"
    assert document["floods"] == {
        "total_frames": 96, "broadcast_frames": 96, "signature_frames": 96, "n_floods": 12
    }
    assert [s["window_us"] for s in document["sensitivity"]] == sorted(params.widths_us())
    for s in [document["statistics"], *document["sensitivity"]]:
        for name, why in s["_non_finite_fields"].items():
            assert name not in s and why in ("infinite", "undefined")
    table = sinks.correlation_table(a.matches, params.timezone)
    first = table.orderBy("camera_event_utc").first()
    assert first.coincidence == "YES" and first.camera_event_local.endswith("-05:00")
    assert report.statistics_table(a.stats).first().coincidences == "12/12"
    assert report.delta_summary(a.matches).first().min_text.endswith("after")


def test_unrelated_streams_are_not_found(spark):
    rng = random.Random(3)
    rows = [dict(ts_us=rng.randrange(14_400) * S, kind="camera", category="camera") for _ in range(11)]
    rows += [dict(ts_us=rng.randrange(14_400) * S, kind="deauth", category="disruption") for _ in range(16)]
    a = run_analysis(brute.frame(spark, rows), AnalysisParams(timezone="UTC", trials=500))
    assert a.stats.first().label == "CORRELATION NOT ESTABLISHED"


@pytest.mark.parametrize(
    "cams,dis", [([5], []), ([], [5]), ([5], [5]), (range(10), [t + 30 * 86_400 for t in range(0, 300, 30)])]
)
def test_degenerate_inputs(spark, cams, dis):
    rows = [dict(ts_us=t * 100 * S, kind="camera", category="camera") for t in cams]
    rows += [dict(ts_us=t * 100 * S, kind="deauth", category="disruption") for t in dis]
    a = run_analysis(brute.frame(spark, rows), AnalysisParams(timezone="UTC", trials=100))
    row = a.stats.first()
    assert row.label == "INSUFFICIENT DATA"
    assert a.periods.first().disjoint == (len(cams) > 1)
    assert a.lag.first().best_lag_s == 0
    a.matches.collect()


def test_straddling_tests_block_a_finding(spark):
    stats = spark.createDataFrame(
        [(14, 40, 20, 0.00832, 0.111, 0.265, 3.0, 30_000_000, 6.0)],
        "n_coincident int, n_anchors int, n_incidents int, binom_p double, perm_p double, fisher_p double, "
        "rate_ratio double, window_us bigint, expected_by_chance double",
    )
    row = decide(combine_tests(stats, 0.01), 0.01).first()
    assert row.label == "CORRELATION NOT ESTABLISHED" and row.straddles
    assert row.weakest_test == "Fisher's exact test"
    assert any("0.265" in r for r in row.reasons) and any("disagree" in r for r in row.reasons)


def exact_binomial(k, n, p):
    from fractions import Fraction
    from math import comb

    q = Fraction(p)
    return float(sum(comb(n, x) * q**x * (1 - q) ** (n - x) for x in range(k, n + 1)))


def exact_fisher(a, b, c, d):
    from fractions import Fraction
    from math import comb

    row, rest, col = a + b, c + d, a + c
    return float(
        sum(
            Fraction(comb(row, x) * comb(rest, col - x), comb(row + rest, col))
            for x in range(a, min(row, col) + 1) if 0 <= col - x <= rest
        )
    )


def test_tails_against_exact_sums():
    rng = random.Random(1)
    for k, n, p in [(0, 5, 0.1), (5, 5, 0.01), (12, 12, 0.065), (3, 40, 0.5), (39, 40, 0.5), (1, 1, 0.3), (40, 300, 0.1)]:
        assert pr.binomial_tail(k, n, p) == pytest.approx(exact_binomial(k, n, p), rel=1e-9)
    assert pr.binomial_tail(5, 5, 0.0) > 0 and pr.binomial_tail(0, 0, 0.5) is None
    assert pr.binomial_tail(900, 1000, 1e-6) > 0
    for _ in range(60):
        a, b, c, d = (rng.randrange(0, 30) for _ in range(4))
        want = exact_fisher(a, b, c, d) if min(a + b, c + d, a + c, b + d) else 1.0
        assert pr.fisher_tail(a, b, c, d) == pytest.approx(want, rel=1e-9), (a, b, c, d)
    assert pr.fisher_tail(5000, 10, 10, 100_000) > 0
    assert pr.fisher_tail(0, 2000, 2000, 100_000) == 1.0
    assert pr.binomial_tail(500_000, 10**9, 0.0005) == pytest.approx(0.5, abs=0.01)


def test_params():
    p = AnalysisParams(window_s=45)
    assert p.widths_us() == [int(w * S) for w in (10, 15, 30, 45, 60, 120)]
    assert AnalysisParams.from_json(p.to_json()) == p and p.validate() == []
    assert len(AnalysisParams(window_s=0, alpha=2, trials=5, flood_threshold=1).validate()) == 4


def test_checksums(spark, tmp_path):
    import hashlib

    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        for name, content in (("x", b"1"), ("y", b"22" if folder == "a" else b"23")):
            (tmp_path / folder / name).write_bytes(content)
    (tmp_path / "a" / "only").write_bytes(b"z")

    def sums(folder):
        df = sinks.file_checksums(spark, [str(tmp_path / folder)])
        return df.withColumn("name", F.element_at(F.split("path", "/"), -1))

    assert {r.name: r.sha256 for r in sums("a").collect()}["y"] == hashlib.sha256(b"22").hexdigest()
    status = {r.name: r.status for r in sinks.verify_checksums(sums("a"), sums("b")).collect()}
    assert status == {"x": "verified", "y": "mismatch", "only": "missing"}
    listing = sinks.listing_checksum(sums("a").withColumn("dir", F.lit("a")), "dir", "name", "length").first()
    assert listing.sha256 == hashlib.sha256(b"only\t1\nx\t1\ny\t2").hexdigest()


def test_timeline(spark, tmp_path):
    inc = spark.createDataFrame([("c", 0), ("c", 299 * S), ("c", 900 * S)], "case_id string, start_us bigint")
    got = [(r.bucket_us // S, r.n) for r in sinks.timeline_buckets(inc).orderBy("bucket_us").collect()]
    assert got == [(0, 2), (300, 0), (600, 0), (900, 1)]
    ev = brute.frame(spark, planted())
    points = sinks.timeline_points(ev, 10).groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in points} == {"camera": 10, "deauth": 10, "link_reset": 4}
    sinks.write_events(ev.withColumn("ts_utc", F.timestamp_micros("ts_us")), str(tmp_path / "ev"))
    assert spark.read.parquet(str(tmp_path / "ev")).count() == ev.count()
    sinks.write_table(ev.groupBy("kind").agg(F.collect_set("src_mac").alias("macs")), str(tmp_path / "t"))
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).count() == 3


def test_manifest_lists_inputs_warnings_and_merged_passes(spark, monkeypatch):
    monkeypatch.setattr(report, "LISTED", 2)
    rows = planted(n=4)
    rows += [dict(r, source_file="b", plate=None, ts_us=r["ts_us"] + S // 2) for r in rows if r["category"] == "camera"]
    a = run_analysis(brute.frame(spark, rows), AnalysisParams(timezone="UTC", trials=100, sensitivity=False))
    files = spark.createDataFrame([(f"f{i}", "camera-events", "camera_csv", i) for i in (2, 0, 1)], "path string, role string, parser string, rows long")
    sums = spark.createDataFrame([("f0", 5, "x"), ("f1", 6, "y")], "path string, length long, sha256 string")
    quality = spark.createDataFrame([("f0", "no time", 3)], "source_file string, reason string, n long")
    inputs = report.input_records(files, sums, F.lit("c"))
    assert {r.path: r.sha256 for r in inputs.collect()} == {"f0": "x", "f1": "y", "f2": None}  # f2 has gone since
    document = json.loads(report.manifest(a, inputs, inputs.limit(0), report.input_warnings(quality, F.lit("c"))).first().manifest)
    assert document["merged_passes"] == {"removed": 4, "merged_sets": 4}
    assert document["inputs"]["n"] == 3 and [f["path"] for f in document["inputs"]["listed"]] == ["f0", "f1"]
    assert document["inputs"]["listed"][1] == {
        "path": "f1", "role": "camera-events", "parser": "camera_csv", "rows": 1, "length": 6, "sha256": "y"}
    assert document["warnings"] == {"n": 1, "listed": [{"source_file": "f0", "reason": "no time", "n": 3}]}
    assert "outputs" not in document  # none for this case
    assert [f["n_frames"] for f in document["first_floods"]] == [8] * 4
    assert document["first_floods"][0]["top_source"] == "de:ad:be:ef:00:01"
    bare = json.loads(report.manifest(a).first().manifest)
    assert not {"inputs", "outputs", "warnings"} & set(bare) and bare["merged_passes"] == document["merged_passes"]


def test_nothing_is_merged_without_a_window(spark):
    a = run_analysis(brute.frame(spark, planted(n=3)), AnalysisParams(timezone="UTC", trials=100, camera_dedupe_s=0.0, sensitivity=False))
    assert [tuple(r) for r in a.merged_passes.collect()] == [("c", 0, 0)]
