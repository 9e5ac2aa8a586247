import random
import time
import tracemalloc
from types import SimpleNamespace

import brute
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from coincide.operators import association as asc
from coincide.operators import floods as fl
from coincide.operators.dedupe import debounce, dedupe_anchors, dedupe_summary, merged_sets
from coincide.operators.drops import client_drops
from coincide.operators.incidents import incidents
from coincide.operators.lag import candidate_lags, lag_scan
from coincide.operators.nearest import band_count, coincident, match_table, nearest
from coincide.operators import shift
from coincide.operators.ordered import Ordered
from coincide.operators.shift import shift_counts, shift_offsets, shift_test
from coincide.schema import anchors, disruptions

CHUNKS = [None, 7]
S = 1_000_000


def scattered(spark, seed, n_cases=4, top=4000, scale=S // 2):
    """Cases of very different size, one holding most rows, with many equal times."""
    rng = random.Random(seed)
    rows = []
    for case, n in zip("wxyz"[:n_cases], (160, 12, 3, 1)):
        for t in brute.random_times(rng, n, top):
            rows.append(dict(case_id=case, ts_us=t * scale, kind="camera", category="camera"))
        for t in brute.random_times(rng, n, top):
            rows.append(
                dict(
                    case_id=case, ts_us=t * scale, kind="deauth", category="disruption",
                    src_mac=f"m{rng.randrange(3)}", reason_code=rng.randrange(4),
                )
            )
    rows += [dict(case_id="only_anchor", ts_us=5, kind="camera", category="camera")]
    rows += [dict(case_id="only_incident", ts_us=5, kind="deauth", category="disruption")]
    return rows


def by_case(rows, category):
    out = {}
    for r in rows:
        if r["category"] == category:
            out.setdefault(r["case_id"], []).append(r["ts_us"])
    return out


@pytest.mark.parametrize("chunks", CHUNKS)
def test_nearest_and_band_count(spark, chunks):
    rows = scattered(spark, 1)
    ev = brute.frame(spark, rows)
    dis = by_case(rows, "disruption")
    w = 20 * S
    got = {
        (r.case_id, r.seq): r
        for r in nearest(anchors(ev), disruptions(ev), chunks).collect()
    }
    counted = {
        (r.case_id, r.seq): r.events_in_window
        for r in band_count(anchors(ev), disruptions(ev), w, chunks).collect()
    }
    semi = {(r.case_id, r.seq) for r in coincident(anchors(ev), disruptions(ev), w, chunks).collect()}
    for i, r in enumerate(rows):
        if r["category"] != "camera":
            continue
        others = dis.get(r["case_id"], [])
        key = (r["case_id"], i)
        assert got[key].nearest_us == brute.nearest(r["ts_us"], others)
        assert counted[key] == sum(abs(t - r["ts_us"]) <= w for t in others)
        assert (key in semi) == any(abs(t - r["ts_us"]) <= w for t in others)


@pytest.mark.parametrize("chunks", CHUNKS)
def test_incidents(spark, chunks):
    rows = scattered(spark, 2)
    got = incidents(brute.frame(spark, rows), 10 * S, chunks).collect()
    for case, times in by_case(rows, "disruption").items():
        mine = sorted((r for r in got if r.case_id == case), key=lambda r: r.start_us)
        starts = brute.incident_starts(times, 10 * S)
        assert [r.start_us for r in mine] == starts
        assert sum(r.n_events for r in mine) == len(times)
        for r in mine:
            members = [
                x for x in rows
                if x["case_id"] == case and x["category"] == "disruption"
                and r.start_us <= x["ts_us"] <= r.end_us
            ]
            assert r.n_events == len(members)
            assert r.src_macs == sorted({m["src_mac"] for m in members if "src_mac" in m})


def prepared(spark, rows, chunks, pad):
    ev = brute.frame(spark, rows)
    inc = incidents(ev, 10 * S, chunks)
    streams = asc.both_streams(anchors(ev), inc)
    periods = asc.observation_period(streams, pad)
    return ev, inc, streams, periods, asc.neighbours(streams, chunks)


@pytest.mark.parametrize("chunks", CHUNKS)
def test_width_counts_and_shift(spark, chunks):
    rows, w = scattered(spark, 3), 30 * S
    _, _, _, periods, around = prepared(spark, rows, chunks, w)
    widths = [10 * S, w]
    inside = asc.within(around, periods)
    period = {r.case_id: r for r in periods.collect()}
    got = {(r.case_id, r.window_us): r for r in asc.width_counts(inside, widths).collect()}
    array = shift_counts(inside, widths, 40, 5, "numpy")
    slots = shift_counts(inside, widths, 40, 5, "numpy", slice_intervals=3)
    shifted = {(r.case_id, r.window_us, r.trial): r.hits for r in array.collect()}
    assert shifted == {(r.case_id, r.window_us, r.trial): r.hits for r in slots.collect()}
    cams, dis = by_case(rows, "camera"), by_case(rows, "disruption")
    for case, p in period.items():
        a = [t for t in cams.get(case, []) if p.lo_us <= t <= p.hi_us]
        i = [
            t for t in brute.incident_starts(dis.get(case, []), 10 * S) if p.lo_us <= t <= p.hi_us
        ]
        if not a and not i:
            continue
        for width in widths:
            r = got[(case, width)]
            assert (r.n_anchors, r.n_incidents) == (len(a), len(i))
            assert r.n_coincident == brute.hits(a, i, width)
            assert r.incidents_inside == brute.hits(i, a, width)
            assert r.covered_us == brute.union(i, width, p.lo_us, p.hi_us)[0]
            assert r.exposed_us == brute.union(a, width, p.lo_us, p.hi_us)[0]
            ab, n = brute.bins(a, p.lo_us, p.hi_us, width)
            ib, _ = brute.bins(i, p.lo_us, p.hi_us, width)
            assert (r.cell_a, r.cell_b, r.cell_c) == (len(ab & ib), len(ab - ib), len(ib - ab))
            assert r.cell_d == max(n - len(ab | ib), 0)
            if not a or not i:
                continue
            span = p.hi_us - p.lo_us
            low = max(4 * width, span // 50)
            low = low if span > 4 * low else 0
            for trial, s in enumerate(shift_offsets(5, "numpy", 40, low, span)):
                moved = [(t - p.lo_us + int(s)) % span + p.lo_us for t in a]
                assert shifted[(case, width, trial)] == brute.hits(moved, i, width)


def piece(base, starts, ends, span, trials, n=1, **more):
    """A row of the shift test's work: one block of anchors in one slice, all trials."""
    values = dict(
        case_id="c", window_us=10 * S, lo_us=0, hi_us=span, low_us=span // 50, first_trial=0, share=trials, slice=0, length=span,
        ts=np.asarray(base), n=np.broadcast_to(n, len(base)), starts=np.asarray(starts), ends=np.asarray(ends), n_coincident=1,
    )
    return SimpleNamespace(**values | more)


@pytest.mark.parametrize("n_anchors, n_intervals, heavy", [(40, 300, True), (300, 300, False), (300, 300, True), (3000, 2, False), (2000, 40, True)])
def test_shift_hits_of_blocks(monkeypatch, n_anchors, n_intervals, heavy):
    """Few edges, a table or all trials at once: the same hits, in one slice and in several."""
    rng, span, trials = np.random.default_rng(7), 100_000, 60
    base = np.unique(rng.integers(0, span + 1, n_anchors))
    n = rng.integers(1, 4, len(base)) if heavy else np.ones(len(base), int)
    edges = np.unique(rng.integers(0, span, 2 * n_intervals))
    starts, ends = edges[: len(edges) // 2 * 2 : 2], edges[1::2] - 1
    inside = np.zeros(3 * span, bool)
    for a, b in zip(starts, ends):
        inside[a : b + 1] = True
    for mode in ("grid", "numpy"):
        offsets = shift_offsets(5, mode, trials, span // 50, span)
        moved = base[None, :] + offsets.astype(int)[:, None]
        want = (inside[np.where(moved >= span, moved - span, moved)] @ n).tolist()
        for few in (0, 1 << 10, 1 << 20):
            for length in (span, span // 3):
                monkeypatch.setattr(shift, "FEW_ANCHORS", few)
                got = np.zeros(trials, int)
                for k in range(-(-span // length)):
                    near = (starts // length <= k) & (ends // length >= k)
                    if near.any():
                        got += shift._hits(piece(base, starts[near], ends[near], span, trials, n, slice=k, length=length), 5, mode, trials)
                assert got.tolist() == want


def test_shift_time_of_many_anchors():
    """Anchors are not looked up one by one where few intervals lie among them (a minute before)."""
    span, trials = 10**9, 10_000
    base = np.arange(0, span, 5_000)
    began = time.process_time()
    hits = shift._hits(piece(base, [0], [span // 2 - 1], span, trials), 5, "grid", trials)
    assert time.process_time() - began < 15
    assert set(hits.tolist()) == {len(base) // 2}


def test_shift_memory_of_many_cases():
    """The trials of one case are held at a time, not those of a whole batch (2,000 x 80 KB before)."""
    rows = [vars(piece([5, 9, 400], [0, 300], [50, 310], 1000, 10_000, case_id=f"c{k}")) for k in range(2000)]
    tracemalloc.start()
    told = shift._told(pd.DataFrame(rows), 5, "grid", 10_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(told) == 2000 and told["total"].nunique() == 1
    assert peak < 40_000_000


@pytest.mark.parametrize("block, share, slices", [(1 << 13, 1 << 23, 1 << 20), (1 << 13, 64, 3), (4, 1 << 23, 1 << 20), (3, 1, 2)])
def test_shift_test(spark, monkeypatch, block, share, slices):
    """The same numbers from cases in one piece and in many, and from one share of the trials and from many."""
    monkeypatch.setattr(shift, "BLOCK_ANCHORS", block)
    monkeypatch.setattr(shift, "SHARE_SIZE", share)
    widths, trials = [10 * S, 30 * S], 50
    _, _, _, periods, around = prepared(spark, scattered(spark, 3), 3, 30 * S)
    inside = asc.within(around, periods)
    observed = asc.width_counts(inside, widths)
    hits = {}
    for r in shift_counts(inside, widths, trials, 5).collect():
        hits.setdefault((r.case_id, r.window_us), []).append(r.hits)
    assert all(len(h) == trials for h in hits.values()) and hits
    got = shift_test(observed, inside, widths, trials, 5, slice_intervals=slices).collect()
    assert len(got) == observed.count()
    for r in got:
        if r.n_anchors and r.n_incidents:
            h = hits[r.case_id, r.window_us]
            assert r.perm_p == (sum(x >= r.n_coincident for x in h) + 1) / (trials + 1)
            assert r.perm_mean == sum(h) / trials
        else:
            assert r.perm_p is None and r.perm_mean is None


@pytest.mark.parametrize("chunks", CHUNKS)
def test_neighbours_from_events(spark, chunks):
    rows = scattered(spark, 7)
    ev, _, _, _, around = prepared(spark, rows, chunks, 30 * S)
    columns = ["case_id", "ts_us", "side", "n", "prev_a", "prev_i", "next_a", "next_i"]
    one = asc.event_neighbours(ev, 10 * S, chunks).df.select(columns)
    two = around.df.select(columns)
    assert one.count() == two.count() and one.exceptAll(two).isEmpty()


@pytest.mark.parametrize("chunks", CHUNKS)
def test_lag_scan(spark, chunks):
    rows, w = scattered(spark, 4, top=30_000), 30 * S
    got = {r.case_id: r for r in lag_scan(prepared(spark, rows, chunks, w)[4], w).collect()}
    cams, dis = by_case(rows, "camera"), by_case(rows, "disruption")
    for case in cams:
        a, i = cams[case], brute.incident_starts(dis.get(case, []), 10 * S)
        best = (0, 0, 0)
        if len(a) >= 3 and i:
            zero = brute.hits(a, i, w)
            best = (0, zero, zero)
            lags = sorted({round((t - x) / S) for t in i for x in a if abs(t - x) <= 7200 * S})
            for lag in lags:
                h = brute.hits([x + lag * S for x in a], i, w)
                if h > best[1]:
                    best = (lag, h, zero)
        r = got[case]
        assert (r.best_lag_s, r.best_hits, r.hits_at_zero) == best


def whole_seconds(anchors, incidents):
    """Differences within the largest lag, half to even, from all pairs."""
    return sorted({round((i - a) / S) for a in anchors for i in incidents if abs(i - a) <= 7200 * S})


@pytest.mark.parametrize("seed", range(4))
def test_candidate_lags(spark, seed):
    """Fractions at and around halves and the largest lag, negative times, busy seconds."""
    rng = random.Random(seed)
    fractions = [0, 1, 249_999, 250_000, 499_999, 500_000, 500_001, 750_000, 999_999]
    cases = {}
    for case in ("a", "b", "c"):
        seconds = [rng.choice([-9000, -7200, -1, 0, 1, 7199, 7200, 14_400, rng.randrange(-9000, 9000)]) for _ in range(12)]
        cases[case] = [{t * S + f for t in rng.sample(seconds, 6) for f in rng.sample(fractions, 4)} for _ in range(2)]
    cases["busy"] = [set(range(0, 2 * S, 997)), {7200 * S + 250_500, -7200 * S + 250_500}]
    cases["no incidents"] = [{1, 2}, set()]
    rows = [(case, t, side) for case, sides in cases.items() for side, times in enumerate(sides) for t in times]
    df = spark.createDataFrame(rows, "case_id string, ts_us bigint, side int").repartition(5)
    got = {}
    for r in candidate_lags(Ordered(df, ("case_id",), ("ts_us", "side"))).collect():
        got.setdefault(r.case_id, []).append(r.lag_s)
    assert {case: sorted(lags) for case, lags in got.items()} == {
        case: lags for case, sides in cases.items() if (lags := whole_seconds(*sides))}


@pytest.mark.parametrize("late", [3600, 0])
def test_lag_scan_flags_an_hour(spark, late):
    rng = random.Random(9)
    base = sorted(rng.sample(range(0, 40_000), 16))
    rows = [dict(ts_us=t * S, kind="deauth", category="disruption") for t in base]
    rows += [dict(ts_us=(t + late + 3) * S, kind="camera", category="camera") for t in base[:10]]
    r = lag_scan(prepared(spark, rows, None, 30 * S)[4], 30 * S).first()
    assert r.suspicious == (late == 3600)
    if late:
        assert abs(abs(r.best_lag_s) - 3600) < 60 and "one hour" in r.explanation


@pytest.mark.parametrize("chunks", CHUNKS)
def test_client_drops_random(spark, chunks):
    rng = random.Random(5)
    ops = ["DISCOVER", "DISCOVER", "REQUEST", "ACK", "OFFER", "INFORM", "RESET"]
    rows, plain = [], {}
    for mac, n in (("a", 300), ("b", 20), ("c", 5), ("noack", 40)):
        for t in brute.random_times(rng, n, n * 20):
            op = rng.choice([o for o in ops if mac != "noack" or o != "ACK"])
            plain.setdefault(mac, []).append((t * S, op, len(rows)))
            kind = "link_reset" if op == "RESET" else "assoc"
            rows.append(
                dict(
                    ts_us=t * S, kind=kind, subtype=None if op == "RESET" else op, client_mac=mac,
                    category="disruption" if op == "RESET" else "context",
                )
            )
    got = client_drops(brute.frame(spark, rows), 120 * S, 30 * S, chunks)
    found = sorted((r.client_mac, r.ts_us) for r in got.collect())
    want = sorted(
        (mac, t)
        for mac, seen in plain.items()
        for t in brute.drops([(t, op) for t, op, _ in sorted(seen, key=lambda x: (x[0], x[2]))], 120 * S, 30 * S)
    )
    assert found == want


SCENARIOS = [
    ([("ACK", -500)] + [("DISCOVER", t) for t in (0, 4, 12, 28, 60)], 0),
    ([x for t in (0, 90, 180, 270) for x in (("REQUEST", t), ("ACK", t + 1))], 0),
    ([("ACK", -500)] + [("INFORM", t) for t in (0, 30, 60)], 0),
    ([("DISCOVER", t) for t in (0, 4, 12, 28)], 0),
    ([("ACK", 0), ("RESET", 10), ("DISCOVER", 30), ("ACK", 32)], 0),
    ([("ACK", 0), ("DISCOVER", 20), ("ACK", 22)], 1),
]


@pytest.mark.parametrize("log,expected", SCENARIOS)
def test_client_drops_scenarios(spark, log, expected):
    rows = [
        dict(
            ts_us=(1000 + t) * S, client_mac="3c:22:fb:00:00:01",
            kind="link_reset" if op == "RESET" else "assoc",
            subtype=None if op == "RESET" else op,
        )
        for op, t in log
    ]
    assert client_drops(brute.frame(spark, rows), 120 * S, 120 * S).count() == expected


@pytest.mark.parametrize("chunks", CHUNKS)
@pytest.mark.parametrize("top", [300, 1500])
def test_floods(spark, chunks, top):
    rng = random.Random(top)
    rows = []
    for case, n in (("p", 200), ("q", 15)):
        for t in brute.random_times(rng, n, top):
            rows.append(
                dict(case_id=case, ts_us=t * S, kind="deauth", src_mac=f"m{t % 3}", reason_code=t % 9)
            )
    flood_rows = fl.flood_frames(brute.frame(spark, rows), 10 * S, 5, chunks)
    got = fl.floods(flood_rows, 10 * S).collect()
    for case in "pq":
        want = brute.floods([r["ts_us"] for r in rows if r["case_id"] == case], 10 * S, 5)
        mine = sorted(
            (r.start_us, r.end_us, r.n_frames, round(r.peak_rate_per_s * 10))
            for r in got if r.case_id == case
        )
        assert mine == want


@pytest.mark.parametrize("chunks", CHUNKS)
@pytest.mark.parametrize("top", [60, 600])
def test_merged_sets(spark, chunks, top):
    rng = random.Random(top)
    rows = []
    for case, n in (("p", 150), ("q", 10)):
        for t in brute.random_times(rng, n, top * 10):
            rows.append(
                dict(
                    case_id=case, ts_us=t * S // 10, kind="camera", category="camera",
                    source_file=f"s{rng.randrange(3)}", plate=rng.choice([None, "P"]),
                )
            )
    ev = brute.frame(spark, rows)
    sets = merged_sets(ev, 2 * S, chunks=chunks)
    got = {(r.case_id, r.seq): r.set_seq for r in sets.collect()}
    want = {}
    for case in "pq":
        mine = [(r["ts_us"], i, r["source_file"]) for i, r in enumerate(rows) if r["case_id"] == case]
        want |= {(case, s): o for s, o in brute.merged_sets(sorted(mine), 2 * S).items()}
    assert got == want
    kept = dedupe_anchors(ev, 2 * S, chunks).count()
    assert kept == len(set(want.items())) - sum(k[1] != v for k, v in want.items())
    removed = dedupe_summary(sets).agg(F.sum("removed")).first()[0]
    assert removed == len(rows) - kept


DEDUPE = [
    ([("A", 0, "ABC123"), ("A", 1, "XYZ789"), ("B", 0, None)], 2),
    ([("A", t, None) for t in (0, 1.9, 3.8, 5.7)], 4),
    ([("A", 0, "P"), ("B", 0.4, None)], 1),
]


@pytest.mark.parametrize("rows,expected", DEDUPE)
def test_dedupe_scenarios(spark, rows, expected):
    ev = brute.frame(
        spark,
        [
            dict(ts_us=int(t * S), kind="camera", category="camera", source_file=s, plate=p)
            for s, t, p in rows
        ],
    )
    kept = dedupe_anchors(ev, 2 * S).collect()
    assert len(kept) == expected
    assert {r.plate for r in kept if r.plate} == {p for _, _, p in rows if p}


@pytest.mark.parametrize("chunks", CHUNKS)
def test_debounce(spark, chunks):
    rng = random.Random(8)
    data = []
    for cam, n in (("p", 200), ("q", 9)):
        data += [(cam, t * S, i) for i, t in enumerate(brute.random_times(rng, n, n * 3))]
    df = spark.createDataFrame(data, "camera string, ts_us bigint, seq bigint")
    got = debounce(df, ["camera"], 5 * S, chunks).collect()
    for cam in "pq":
        times = [t for c, t, _ in data if c == cam]
        assert sorted(r.ts_us for r in got if r.camera == cam) == brute.debounced(times, 5 * S)


def test_lists_of_incidents_are_joined_last(spark):
    """Each anchor gets the lists of its incident; no join or exchange comes after that."""
    ev, inc, _, periods, _ = prepared(spark, scattered(spark, 6), None, 20 * S)
    node = match_table(ev, inc, periods, 20 * S)._jdf.queryExecution().optimizedPlan()
    while node.nodeName() == "Project":
        node = node.children().apply(0)
    assert node.nodeName() == "Join" and "client_macs" in node.output().mkString(",")
    assert "client_macs" not in node.children().apply(0).output().mkString(",")


@pytest.mark.parametrize("chunks", CHUNKS)
def test_match_table(spark, chunks):
    rows = scattered(spark, 6)
    rng = random.Random(6)
    rows += [
        dict(case_id="w", ts_us=rng.randrange(2000) * S, kind="link_reset", category="disruption")
        for _ in range(20)
    ]
    w = 20 * S
    ev, inc, _, periods, _ = prepared(spark, rows, chunks, w)
    got = {(r.case_id, r.seq): r for r in match_table(ev, inc, periods, w, chunks=chunks).collect()}
    assert len(got) == sum(r["category"] == "camera" for r in rows)

    def times(case, kinds):
        return [r["ts_us"] for r in rows if r["case_id"] == case and r["kind"] in kinds]

    for i, r in enumerate(rows):
        if r["category"] != "camera":
            continue
        m, case, t = got[(r["case_id"], i)], r["case_id"], r["ts_us"]
        all_dis = times(case, ("deauth", "link_reset"))
        near_inc = brute.nearest(t, brute.incident_starts(all_dis, 10 * S))
        near_frame = brute.nearest(t, times(case, ("deauth",)))
        near_drop = brute.nearest(t, times(case, ("link_reset",)))
        assert m.events_in_window == sum(abs(x - t) <= w for x in all_dis)
        assert m.coincidence == (near_inc is not None and abs(near_inc - t) <= w)
        for got_s, near in (
            (m.delta_s, near_inc), (m.deauth_delta_s, near_frame), (m.drop_delta_s, near_drop)
        ):
            assert got_s == (None if near is None else round((near - t) / S, 3))
        if near_frame is not None and abs(near_frame - t) <= w:
            first = next(x for x in rows if x["case_id"] == case and x["kind"] == "deauth" and x["ts_us"] == near_frame)
            assert (m.attacker_mac, m.reason_code) == (first.get("src_mac"), first.get("reason_code"))


def test_debounce_takes_as_many_jobs_for_many_chunks_as_for_few(spark):
    """A steady stream without any quiet stretch, cut into 2 and into 12 chunks."""
    rows = spark.range(600).selectExpr("'k' AS key", f"id * {S} AS ts_us", "id AS seq")
    jobs, context = [], spark.sparkContext
    for chunks in (2, 12):
        context.setJobGroup(f"debounce-{chunks}", "")
        kept = sorted(r.seq for r in debounce(rows, ["key"], 7 * S, chunks).collect())
        assert kept == list(range(0, 600, 7))
        jobs.append(len(context.statusTracker().getJobIdsForGroup(f"debounce-{chunks}")))
    context.setJobGroup("tests", "")
    assert jobs[0] == jobs[1]


def test_open_sets_against_a_scan():
    """The pointers of the sources find the sets that a scan of all open sets finds, also after a handover."""
    import random

    from coincide.operators.dedupe import _OpenSets

    draw = random.Random(6)
    window, opened, plain = 30, _OpenSets(30), []
    ts = 0
    for seq in range(3000):
        ts += draw.choice([0, 1, 1, 2, 40 if draw.random() < 0.02 else 3])
        source = draw.choice("aaabcd")
        plain = [s for s in plain if ts - s[0] <= window]
        home = next((s for s in plain if source not in s[2]), None)
        if home is None:
            home = (ts, seq, set())
            plain.append(home)
        home[2].add(source)
        if draw.random() < 0.05:
            handed = opened.left()
            opened = _OpenSets(window)
            opened.restore("c", [(s[1], s[2]) for s in handed], [s[3] for s in handed])
        opened.enter("c", ts)
        assert opened.place(ts, seq, source) == home[:2]


def test_open_sets_of_one_source_in_linear_time():
    import time

    from coincide.operators.dedupe import _OpenSets

    def seconds(n):
        opened, start = _OpenSets(10 * n), time.perf_counter()
        for i in range(n):
            opened.enter("c", i)
            assert opened.place(i, i, "one") == (i, i)
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(200_000) < 5
