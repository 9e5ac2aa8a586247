"""DD01 / JN06 / FN24 / DD02: one row per pass."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coincide.functions.display import text
from coincide.operators.ordered import CHUNK, Running, arrange
from coincide.operators.relay import relay
from coincide.schema import CAMERA
from coincide.session import durable


def detail_score() -> Column:
    """FN24: how many identifying fields a row carries."""
    return sum(
        (text(F.col(c)).isNotNull().cast("int") for c in ("plate", "make", "model", "notes")),
        F.lit(0),
    )


class _OpenSets:
    """Sets of one case that may still take members, oldest first.

    A row joins the oldest open set without its source, and opens one only when all have it. So all sets before
    some place have a source and all from there on lack it: one number per source tells where it goes next.
    """

    def __init__(self, window_us: int) -> None:
        self.window_us = window_us
        self.case: str | None = None
        self.clear()

    def clear(self) -> None:
        self.anchors: list[tuple[int, int]] = []  # (time, seq) of each set; those before ``live`` are closed
        self.live = 0
        self.next: dict[str, int] = {}  # per source, the first set that lacks it

    def restore(self, case: str, anchors: list[tuple[int, int]], last_of: list[list[str]]) -> None:
        self.case, self.anchors = case, anchors
        self.next = {source: i + 1 for i, sources in enumerate(last_of) for source in sources}

    def left(self) -> list[tuple]:
        """Open sets as (case, time, seq, the sources that no younger set has)."""
        last_of: dict[int, list[str]] = {}
        for source, i in self.next.items():
            last_of.setdefault(i - 1, []).append(source)
        open_sets = enumerate(self.anchors[self.live :], self.live)
        return [(self.case, ts, seq, sorted(last_of.get(i, []))) for i, (ts, seq) in open_sets]

    def enter(self, case: str, ts: int) -> None:
        if case != self.case:
            self.case = case
            self.clear()
        while self.live < len(self.anchors) and ts - self.anchors[self.live][0] > self.window_us:
            self.live += 1

    def place(self, ts: int, seq: int, source: str) -> tuple[int, int]:
        """Anchor of the set the row joins: the oldest open one without its source, or its own."""
        at = max(self.next.get(source, 0), self.live)
        if at == len(self.anchors):
            self.anchors.append((ts, seq))
        self.next[source] = at + 1
        return self.anchors[at]


def merged_sets(
    anchor_rows: DataFrame, window_us: int, source: str = "source_file", chunks: int | None = None
) -> DataFrame:
    """The set each anchor row belongs to, as (case, ts, seq, set_us, set_seq).

    The first row not yet in a set opens one. It takes later rows up to ``window_us`` after
    itself, at most one per source and none of its own; a row joins the oldest set it can.
    """
    rows = anchor_rows.select(
        "case_id", "ts_us", "seq", F.coalesce(F.col(source), F.lit("")).alias("source")
    )
    ts = F.col("ts_us")
    placed = arrange(rows, ["case_id"], ["ts_us", "seq"], chunks).running(
        before={"prev_us": Running("max", ts)}, after={"next_us": Running("min", ts)}
    )
    near = (ts - F.col("prev_us") <= window_us) | (F.col("next_us") - ts <= window_us)
    marked = placed.with_columns({"near": F.coalesce(near, F.lit(False))}).settled()
    # A row without a neighbour within the window is a set of its own.
    alone = marked.df.filter("NOT near").select(
        "case_id", "ts_us", "seq", ts.alias("set_us"), F.col("seq").alias("set_seq")
    )

    def fold(part: pd.DataFrame, state: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        opened = _OpenSets(window_us)
        state = state.sort_values(["anchor_us", "anchor_seq"])
        if len(state):
            anchors = list(zip(state["anchor_us"].tolist(), state["anchor_seq"].tolist()))
            opened.restore(state["anchor_case"].iloc[0], anchors, state["sources"].tolist())
        placed = []
        for r in part.itertuples(index=False):
            opened.enter(r.case_id, r.ts_us)
            placed.append(opened.place(r.ts_us, r.seq, r.source))
        out = part[["case_id", "ts_us", "seq"]].assign(
            set_us=[p[0] for p in placed], set_seq=[p[1] for p in placed]
        )
        left = pd.DataFrame(opened.left(), columns=["anchor_case", "anchor_us", "anchor_seq", "sources"])
        return out, left

    contested = marked.filter(F.col("near"))
    sets = relay(
        contested.with_df(contested.df.drop("near", "prev_us", "next_us")),
        fold,
        "case_id string, ts_us bigint, seq bigint, set_us bigint, set_seq bigint",
        "anchor_case string, anchor_us bigint, anchor_seq bigint, sources array<string>",
    )
    return alone.unionByName(sets)


def dedupe_anchors(
    events: DataFrame, window_us: int, chunks: int | None = None, source: str = "source_file"
) -> DataFrame:
    """DD01: keep the most detailed row of every set (the earliest on ties), drop the others."""
    return merge_passes(events, window_us, chunks, source)[0]


def merge_passes(
    events: DataFrame, window_us: int, chunks: int | None = None, source: str = "source_file"
) -> tuple[DataFrame, DataFrame]:
    """DD01 with its note: the events left, and :func:`dedupe_summary` of what was merged away."""
    anchor = F.coalesce(F.col("category") == CAMERA, F.lit(False))
    rows = events.filter(anchor)
    if window_us <= 0:
        alone = rows.select("case_id", F.col("ts_us").alias("set_us"), F.col("seq").alias("set_seq"))
        return events, dedupe_summary(alone.distinct())
    sets = merged_sets(rows, window_us, source, chunks)
    scored = rows.select("case_id", "ts_us", "seq", detail_score().alias("score")).join(
        sets, ["case_id", "ts_us", "seq"]
    )
    kept = (
        scored.groupBy("case_id", "set_us", "set_seq")
        .agg(F.min(F.struct((-F.col("score")).alias("rank"), "ts_us", "seq")).alias("best"))
        .select("case_id", "best.ts_us", "best.seq")
    )
    left = events.filter(~anchor).unionByName(
        rows.join(kept, ["case_id", "ts_us", "seq"], "left_semi")
    )
    return left, dedupe_summary(sets)


def dedupe_summary(sets: DataFrame) -> DataFrame:
    """How many rows were merged away, in how many sets."""
    return (
        sets.groupBy("case_id", "set_us", "set_seq")
        .agg((F.count(F.lit(1)) - 1).alias("extra"))
        .groupBy("case_id")
        .agg(
            F.sum("extra").alias("removed"), F.count_if(F.col("extra") > 0).alias("merged_sets")
        )
    )


def debounce(
    rows: DataFrame, keys: list[str], min_gap_us: int, chunks: int | None = None
) -> DataFrame:
    """DD02: drop a row less than ``min_gap_us`` after the last kept row of its key.

    A row without a neighbour within the gap is kept as it is. For the others, the kept row after a
    row is the first one a gap later, so a chunk maps the time from which it may keep to the time
    from which the next chunk may. Only a chunk that lies within one key passes such a map on, with a
    step for each row of its first gap; the maps of a key are applied one after another, and then all
    chunks pick their rows at once. Three passes, however many chunks there are.
    """
    if min_gap_us <= 0:
        return rows
    key = F.to_json(F.struct(*keys))
    ts = F.col("ts_us")
    placed = arrange(rows.select(key.alias("key"), "ts_us", "seq"), ["key"], ["ts_us", "seq"], chunks).running(
        before={"prev_us": Running("max", ts)}, after={"next_us": Running("min", ts)}
    )
    near = F.coalesce((ts - F.col("prev_us") < min_gap_us) | (F.col("next_us") - ts < min_gap_us), F.lit(False))
    marked = durable(placed.df.select(CHUNK, "key", "ts_us", "seq", near.alias("near")), "debounce")
    contested = marked.filter("near").drop("near")
    stream = contested.repartition(CHUNK).sortWithinPartitions(CHUNK, "key", "ts_us", "seq")

    def segments(parts):
        """(chunk, key, rows) of each key in each chunk, from rows in order."""
        held = None
        for part in parts:
            held = part if held is None else pd.concat([held, part], ignore_index=True)
            mark = held[CHUNK].astype(str) + "|" + held["key"]
            last = mark != mark.iloc[-1] if len(held) else mark
            for (chunk, name), some in held[last].groupby([CHUNK, "key"], sort=False):
                yield chunk, name, some
            held = held[~last] if len(held) else None
        if held is not None and len(held):
            yield held[CHUNK].iloc[0], held["key"].iloc[0], held

    def maps(parts):
        found = []
        for chunk, name, some in segments(parts):
            t = some["ts_us"].to_numpy()
            after = _after(t, min_gap_us)
            end = np.where(after < len(t), after, np.arange(len(t)))
            while not np.array_equal(end, end[end]):
                end = end[end]
            steps = np.flatnonzero((t <= t[0] + min_gap_us) & np.append(True, t[1:] != t[:-1]))
            found.append(
                pd.DataFrame({CHUNK: chunk, "key": name, "upto_us": t[steps], "out_us": t[end[steps]] + min_gap_us})
            )
        if found:
            yield pd.concat(found)

    def entries(steps: pd.DataFrame) -> pd.DataFrame:
        """When each chunk of a key may keep its first row."""
        out, due = [], None
        for chunk, some in steps.sort_values([CHUNK, "upto_us"]).groupby(CHUNK, sort=True):
            out.append((chunk, steps["key"].iloc[0], due))
            at = 0 if due is None else int(np.searchsorted(some["upto_us"].to_numpy(), due))
            due = int(some["out_us"].iloc[at]) if at < len(some) else due
        return pd.DataFrame(out, columns=[CHUNK, "key", "due_us"]).astype({"due_us": "Int64"})

    # Keys inside one chunk need no map; the others have a few rows per chunk.
    summary = stream.mapInPandas(maps, f"{CHUNK} int, key string, upto_us bigint, out_us bigint")
    entered = durable(
        summary.groupBy("key").applyInPandas(entries, f"{CHUNK} int, key string, due_us bigint").filter("due_us IS NOT NULL"),
        "entries",
    )

    def pick(parts):
        for _, _, some in segments(parts):
            t, due = some["ts_us"].to_numpy(), some["due_us"].iloc[0]
            mark = np.zeros(len(t) + 1, bool)
            mark[0 if pd.isna(due) else np.searchsorted(t, due)] = True
            jump = np.append(_after(t, min_gap_us), len(t))
            for _ in range(int(len(t)).bit_length()):
                mark[jump[mark]] = True
                jump = jump[jump]
            yield some.loc[mark[:-1], ["key", "ts_us", "seq"]]

    due = contested.join(entered, [CHUNK, "key"], "left")
    picked = due.repartition(CHUNK).sortWithinPartitions(CHUNK, "key", "ts_us", "seq")
    kept = marked.filter("NOT near").select("key", "ts_us", "seq").unionByName(
        picked.mapInPandas(pick, "key string, ts_us bigint, seq bigint")
    )
    return (
        rows.withColumn("key", key).join(kept, ["key", "ts_us", "seq"], "left_semi").drop("key")
    )


def _after(t: np.ndarray, gap_us: int) -> np.ndarray:
    """Place of the first time at least a gap after each time (the length if there is none)."""
    return np.searchsorted(t, t + gap_us)
