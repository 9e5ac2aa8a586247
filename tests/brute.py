"""Slow, plain restatements of the operators' rules, for small inputs only."""

import random

from coincide.schema import EVENT_SCHEMA, conform


def frame(spark, rows):
    """Canonical events from dicts; seq is the list position unless given."""
    names = [f.name for f in EVENT_SCHEMA]
    full = [
        tuple({"case_id": "c", "seq": i, **r}.get(n) for n in names) for i, r in enumerate(rows)
    ]
    return conform(spark.createDataFrame(full, EVENT_SCHEMA))


def random_times(rng: random.Random, n: int, top: int, ties: bool = True) -> list[int]:
    times = [rng.randrange(top) for _ in range(n)]
    if ties and n > 4:
        times[: n // 4] = rng.choices(times, k=n // 4)
    return sorted(times)


def nearest(anchor: int, others: list[int]):
    return min(others, key=lambda t: (abs(t - anchor), t), default=None)


def incident_starts(times: list[int], gap: int) -> list[int]:
    times = sorted(times)
    return [t for i, t in enumerate(times) if i == 0 or t - times[i - 1] > gap]


def union(times, w, lo, hi):
    """Covered microseconds and merged intervals."""
    merged = []
    for t in sorted(times):
        a, b = max(t - w, lo), min(t + w, hi)
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    return sum(b - a for a, b in merged), merged


def hits(anchors, incidents, w):
    return sum(any(abs(a - i) <= w for i in incidents) for a in anchors)


def bins(times, lo, hi, w):
    n = max(-(-(hi - lo) // (2 * w)), 1)
    return {min((t - lo) // (2 * w), n - 1) for t in times}, n


def drops(rows, reassoc, reconnect):
    """rows: (ts, op or 'RESET') in order -> drop times."""
    ops = {op for _, op in rows}
    confirm = {"ACK"} if "ACK" in ops else {"ACK", "REQUEST"}
    out = []
    for i, (ts, op) in enumerate(rows):
        if op != "DISCOVER":
            continue
        past = [(j, t, o) for j, (t, o) in enumerate(rows[:i])]
        confirms = [(j, t) for j, t, o in past if o in confirm]
        if not confirms:
            continue
        since, confirmed = confirms[-1]
        if any(o == "DISCOVER" for j, _, o in past if j > since):
            continue
        if ts - confirmed > reassoc:
            continue
        if any(o == "RESET" and 0 <= ts - t <= reconnect for t, o in rows):
            continue
        out.append(ts)
    return out


def floods(times, window, k):
    """(start, end, n, peak count) of floods over frame times with repeats."""
    times = sorted(times)
    count = {t: sum(t - window <= u <= t for u in times) for t in set(times)}
    burst = [any(t <= h <= t + window and count[h] >= k for h in count) for t in times]
    runs = []
    for i, t in enumerate(times):
        if not burst[i]:
            continue
        if i and burst[i - 1] and t - times[i - 1] <= window:
            runs[-1].append(t)
        else:
            runs.append([t])
    return [(r[0], r[-1], len(r), max(count[t] for t in r)) for r in runs if len(r) >= k]


def merged_sets(rows, window):
    """rows: (ts, seq, source) in order -> {seq: seq of its set's first row}."""
    owner = {}
    for i, (ts, seq, source) in enumerate(rows):
        if seq in owner:
            continue
        owner[seq], seen = seq, {source}
        for ts2, seq2, source2 in rows[i + 1 :]:
            if ts2 - ts <= window and seq2 not in owner and source2 not in seen:
                owner[seq2] = seq
                seen.add(source2)
    return owner


def debounced(times, gap):
    kept = []
    for t in times:
        if not kept or t - kept[-1] >= gap:
            kept.append(t)
    return kept
