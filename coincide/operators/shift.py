"""ST03: circular-shift permutation test.

Each trial slides all anchors of a case around its period and recounts hits on a fixed set of
disjoint disruption intervals. Merged intervals are at least two windows long, so a stretch of time
has a bounded number of them, however many disruptions it has: the period is cut into slices that
hold ``SLICE_INTERVALS`` at most (one slice up to about 240 days at the least width), and each block
of anchors counts its hits in each slice, all trials at once or, where there is much to count, for a
share of them. A trial moves a block into few slices, and only those look at it. There it counts by the
smaller side: the anchors between two edges of intervals, or each anchor by a table of the time that
tells most of them without a search.

The test needs two numbers of a case: how many trials reach the observed hits, and the mean. A case with one
block and one slice gives them where its hits are counted, so nothing as long as the trials leaves the task.
Only the trials of a case in several pieces are added up by trial first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coincide.functions.let import floor_div
from coincide.operators.association import each_width
from coincide.operators.ordered import CHUNK, Ordered, Running
from coincide.session import durable

# Limits: anchors per block, anchors (or edges, if fewer) times trials per row of work, intervals per slice of
# the period. A block meets every slice, so the larger both are, the less is shuffled.
BLOCK_ANCHORS, SHARE_SIZE = 1 << 17, 1 << 27
SLICE_INTERVALS = 1 << 20
# Blocks up to this size are counted for many trials at once; cells of the table for an edge, and in all.
FEW_ANCHORS = 1 << 10
CELLS_PER_EDGE, MOST_CELLS = 32, 1 << 25
# Cases and widths whose trials a task adds up before it hands them on.
HELD_CASES = 64


def lowest_shift(span: Column, w: Column) -> Column:
    """Shifts below four windows or 2 % of the span are left out, if the span allows it."""
    wanted = F.greatest(4 * w, F.call_function("div", span, F.lit(50)))
    return F.when(span > 4 * wanted, wanted).otherwise(F.lit(0))


def shift_offsets(seed: int, mode: str, trials: int, low: int, span: int) -> np.ndarray:
    width = span - 2 * low
    if mode == "grid":
        exact = np.int64 if width < (1 << 62) // (2 * trials + 1) else object
        return low + (2 * np.arange(trials, dtype=exact) + 1) * width // (2 * trials)
    return np.rint(low + width * np.random.default_rng(seed).random(trials))


def disruption_intervals(around: Ordered, widths_us: list[int]) -> DataFrame:
    """AGG06 islands: disjoint [start, end] around incidents, per width, not clipped."""
    ts, w = F.col("ts_us"), F.col("window_us")
    opens = F.col("prev_i").isNull() | (ts - F.col("prev_i") > 2 * w)
    closes = F.col("next_i").isNull() | (F.col("next_i") - ts > 2 * w)
    per_width = around.df.filter("side = 1").withColumn("window_us", each_width(widths_us))
    marked = (
        Ordered(per_width, (*around.keys, "window_us"), around.order)
        .with_columns({"opens_us": F.when(opens, ts)})
        .running(before={"first_us": Running("max", F.col("opens_us"), inclusive=True)})
    )
    period = [c for c in ("lo_us", "hi_us") if c in marked.df.columns]
    return marked.df.filter(closes).select(
        "case_id", "window_us", *period, (F.col("first_us") - w).alias("from_us"), (ts + w).alias("to_us")
    )


def _slices(around: Ordered, widths_us: list[int], slice_intervals: int) -> DataFrame:
    """One pair of arrays of disjoint intervals per case, width and slice, each of a bounded length."""
    span, w = F.col("hi_us") - F.col("lo_us"), F.col("window_us")
    length = F.greatest(F.lit(1), F.least(span, 2 * w * slice_intervals))
    low = F.greatest(F.col("from_us") - F.col("lo_us"), F.lit(0))
    high = F.least(F.col("to_us") - F.col("lo_us"), F.greatest(span - 1, F.lit(0)))
    return (
        disruption_intervals(around, widths_us)
        .withColumns({"length": length, "low": low, "high": high})
        .filter("low <= high")
        .withColumn("slice", F.explode(F.sequence(floor_div(F.col("low"), F.col("length")), floor_div(F.col("high"), F.col("length")))))
        .groupBy("case_id", "window_us", "length", "slice")
        .agg(F.array_sort(F.collect_list("low")).alias("starts"), F.array_sort(F.collect_list("high")).alias("ends"))
    )


def _blocks(around: Ordered) -> DataFrame:
    """The anchors of each case in blocks."""
    anchors = around.filter(F.col("side") == 0)
    number = F.row_number().over(anchors.window()) - 1
    return (
        anchors.with_columns({"block": F.call_function("div", number, F.lit(BLOCK_ANCHORS))})
        .df.groupBy("case_id", CHUNK, "block")
        .agg(
            F.first("lo_us").alias("lo_us"),
            F.first("hi_us").alias("hi_us"),
            F.array_sort(F.collect_list(F.struct("ts_us", "n"))).alias("anchors"),
        )
    )


def _work(pieces: DataFrame, trials: int) -> DataFrame:
    """Pieces (a block of anchors in a slice) with the trials to count, dealt over all tasks."""
    in_slice = F.col("length") / F.greatest(F.col("hi_us") - F.col("lo_us"), F.col("length"))
    cost = F.greatest(F.lit(1), (in_slice * F.least(F.size("anchors"), 4 * F.size("starts"))).cast("bigint"))
    share = F.greatest(F.lit(1), F.least(F.lit(trials), F.call_function("div", F.lit(SHARE_SIZE).cast("bigint"), cost)))
    return (
        pieces.withColumn("share", share.cast("int"))
        .withColumn("first_trial", F.explode(F.expr(f"sequence(0, {trials - 1}, share)")))
        .withColumn("low_us", lowest_shift(F.col("hi_us") - F.col("lo_us"), F.col("window_us")))
        .withColumns({"ts": F.col("anchors.ts_us"), "n": F.col("anchors.n")})
        .drop("anchors")
        .repartition("case_id", "window_us", "slice", CHUNK, "block", "first_trial")
    )


def _by_trial(pieces: DataFrame, trials: int, seed: int, mode: str) -> DataFrame:
    """Hits per case, width and trial, added up over a case's pieces."""

    def rows(held: dict) -> Iterator[pd.DataFrame]:
        for (case, width), hits in held.items():
            yield pd.DataFrame({"case_id": case, "window_us": width, "trial": np.arange(trials), "hits": hits})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for row in batch.itertuples(index=False):
                key = (row.case_id, row.window_us)
                if key not in held and len(held) == HELD_CASES:
                    yield from rows(held)
                    held = {}
                hits = _hits(row, seed, mode, trials)
                whole = held.setdefault(key, np.zeros(trials, dtype=np.int64))
                whole[row.first_trial : row.first_trial + len(hits)] += hits
        yield from rows(held)

    return (
        _work(pieces, trials)
        .mapInPandas(count, "case_id string, window_us bigint, trial bigint, hits bigint")
        .groupBy("case_id", "window_us", "trial")
        .agg(F.sum("hits").alias("hits"))
    )


def shift_counts(
    around: Ordered,
    widths_us: list[int],
    trials: int,
    seed: int,
    mode: str = "numpy",
    slice_intervals: int = SLICE_INTERVALS,
) -> DataFrame:
    """Hits per case, width and trial. ``around`` is restricted to the period (lo_us, hi_us)."""
    pieces = _blocks(around).join(_slices(around, widths_us, slice_intervals), "case_id")
    return _by_trial(pieces, trials, seed, mode)


def shift_test(
    observed: DataFrame,
    around: Ordered,
    widths_us: list[int],
    trials: int,
    seed: int,
    mode: str = "numpy",
    slice_intervals: int = SLICE_INTERVALS,
) -> DataFrame:
    """``observed`` (case, width, counts) with the add-one empirical p and the mean hits of the trials; NULL where
    either stream is empty."""
    blocks = durable(_blocks(around), "blocks")
    slices = durable(_slices(around, widths_us, slice_intervals), "slices")
    of_case = blocks.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_blocks"))
    of_width = slices.groupBy("case_id", "window_us").agg(F.count(F.lit(1)).alias("n_slices"))
    goal = of_width.join(of_case, "case_id").join(observed.select("case_id", "window_us", "n_coincident"), ["case_id", "window_us"])
    goal = goal.withColumn("whole", F.expr("n_blocks = 1 AND n_slices = 1")).drop("n_blocks", "n_slices")
    pieces = blocks.join(slices.join(goal, ["case_id", "window_us"]), "case_id")

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _told(batch, seed, mode, trials)

    told = _work(pieces.filter("whole"), trials).mapInPandas(tell, "case_id string, window_us bigint, reached bigint, total bigint")
    apart = _by_trial(pieces.filter("NOT whole").drop("n_coincident", "whole"), trials, seed, mode)
    apart = apart.join(goal, ["case_id", "window_us"]).selectExpr(
        "case_id", "window_us", "CAST(hits >= n_coincident AS BIGINT) AS reached", "hits AS total"
    )
    both = told.unionByName(apart).groupBy("case_id", "window_us").agg(
        F.sum("reached").alias("reached"), F.sum("total").alias("total")
    )
    tested = (F.col("n_anchors") > 0) & (F.col("n_incidents") > 0)
    # Without any interval in the period, no trial hits: all reach an observation of none.
    reached = F.coalesce("reached", F.when(F.col("n_coincident") <= 0, F.lit(trials)).otherwise(0))
    return (
        observed.join(both, ["case_id", "window_us"], "left")
        .withColumns(
            {
                "perm_p": F.when(tested, (reached + 1) / F.lit(trials + 1.0)),
                "perm_mean": F.when(tested, F.coalesce("total", F.lit(0)) / F.lit(float(trials))),
            }
        )
        .drop("reached", "total")
    )


def _told(batch: pd.DataFrame, seed: int, mode: str, trials: int) -> pd.DataFrame:
    """How many trials reach a row's observed hits, and their sum; only one row's trials are held at a time."""
    reached, total = [], []
    for row in batch.itertuples(index=False):
        hits = _hits(row, seed, mode, trials)
        reached.append(int((hits >= row.n_coincident).sum()))
        total.append(int(hits.sum()))
    return batch[["case_id", "window_us"]].assign(reached=reached, total=total)


def _hits(row, seed: int, mode: str, trials: int) -> np.ndarray:
    """Hits of one block of anchors in one slice, for a share of the trials."""
    span = row.hi_us - row.lo_us
    offsets = shift_offsets(seed, mode, trials, row.low_us, span).astype(np.int64)
    offsets = offsets[row.first_trial : row.first_trial + row.share]
    base = np.asarray(row.ts, dtype=np.int64) - row.lo_us
    weight = np.asarray(row.n, dtype=np.int64)
    begin, end = row.slice * row.length, (row.slice + 1) * row.length
    # A point lies in an interval when an odd number of edges is at or before it.
    starts, ends = np.asarray(row.starts), np.asarray(row.ends)
    edges = np.column_stack([np.maximum(starts, begin), np.minimum(ends, end - 1) + 1]).ravel()
    hits = np.zeros(len(offsets), dtype=np.int64)
    if end < span or len(base) > FEW_ANCHORS:
        return _block_hits(base, weight, edges, offsets, span)
    step = max(1, 1_000_000 // max(len(base), 1))
    for at in range(0, len(offsets), step):
        moved = base[None, :] + offsets[at : at + step, None]
        moved = np.where(moved >= span, moved - span, moved) if span > 0 else moved
        inside = np.searchsorted(edges, moved, side="right") & 1
        hits[at : at + step] = np.where(moved >= begin, inside, 0) @ weight
    return hits


def _block_hits(base: np.ndarray, weight: np.ndarray, edges: np.ndarray, offsets: np.ndarray, span: int) -> np.ndarray:
    """Hits of a block, trial by trial, each before and after its turn around the period.

    Nothing before the first edge or from the last one on is inside.
    """
    hits = np.zeros(len(offsets), dtype=np.int64)
    single, upto, table = bool((weight == 1).all()), np.concatenate(([0], np.cumsum(weight))), None
    first = int(edges[0])
    for turn in (0, span) if span > 0 else (0,):
        moves = offsets - turn
        low, high = np.searchsorted(base, first - moves), np.searchsorted(base, edges[-1] - moves)
        there = np.flatnonzero(low < high)
        before = np.searchsorted(edges, base[low[there]] + moves[there], side="right")
        after = np.searchsorted(edges, base[high[there] - 1] + moves[there], side="right")
        for i, e, f in zip(there.tolist(), before.tolist(), after.tolist()):
            a, b, move = int(low[i]), int(high[i]), int(moves[i])
            if 2 * (f - e) < b - a:  # few edges: the anchors between them
                cuts = np.searchsorted(base[a:b], edges[e:f] - move) + a
                between = np.diff(upto[np.concatenate(([a], cuts, [b]))])
                hits[i] += int(between[1 - (e & 1) :: 2].sum())
                continue
            if table is None:
                table, bits = _table(edges)
            moved = base[a:b] + (move - first)
            told = table[moved >> bits]
            unsure = np.flatnonzero(told == 2)
            told[unsure] = np.searchsorted(edges, moved[unsure] + first, side="right") & 1
            hits[i] += np.count_nonzero(told) if single else int(weight[a:b] @ told)
    return hits


def _table(edges: np.ndarray) -> tuple[np.ndarray, int]:
    """Cells of 2**bits microseconds from the first edge on: outside (0), inside (1), or with an edge in it (2)."""
    cells = min(CELLS_PER_EDGE * len(edges), MOST_CELLS)
    bits = int((edges[-1] - edges[0]) // cells).bit_length()
    at, n = np.unique((edges - edges[0]) >> bits, return_counts=True)
    table = np.zeros(int(at[-1]) + 2, dtype=np.int8)
    table[at + 1] = n & 1
    np.bitwise_xor.accumulate(table, out=table)
    table[at] = 2
    return table, bits
