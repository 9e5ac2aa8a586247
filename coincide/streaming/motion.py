"""STR01-STR03: motion notifications as a stream of anchor events."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Topics that mean motion, and spellings of an active state.
MOTION_TOPICS = (
    "RuleEngine/CellMotionDetector/Motion",
    "VideoSource/MotionAlarm",
    "RuleEngine/MotionRegionDetector/Motion",
    "VideoAnalytics/MotionDetection",
    "RuleEngine/TamperDetector/Tamper",
    "RuleEngine/LineDetector/Crossed",
    "RuleEngine/FieldDetector/ObjectsInside",
)
ACTIVE = ("true", "1", "active")

OUTPUT = "camera string, ts_us bigint, seq bigint, notes string"


def short_topic(topic: Column) -> Column:
    """A topic without its namespace prefixes."""
    return F.trim(F.regexp_replace(topic, r"\b\w+:", ""))


def is_motion(topic: Column) -> Column:
    return short_topic(topic).rlike("|".join(MOTION_TOPICS))


def motion_events(notifications: DataFrame) -> DataFrame:
    """STR01: active motion notifications of (camera, ts_us, seq, topic, state, source) rows.

    A notification without a state is active.
    """
    state = F.lower(F.trim(F.coalesce("state", F.lit("true"))))
    source = F.when(
        F.coalesce("source", F.lit("")) != "", F.concat(F.lit(" (source "), "source", F.lit(")"))
    ).otherwise("")
    return notifications.filter(is_motion(F.col("topic")) & state.isin(*ACTIVE)).select(
        "camera",
        "ts_us",
        "seq",
        F.concat(F.lit("ONVIF motion event: "), short_topic(F.col("topic")), source).alias("notes"),
    )


def debounce_stream(events: DataFrame, min_gap_us: int) -> DataFrame:
    """STR02: per camera, drop an event less than ``min_gap_us`` after the last kept one.

    An event older than the last kept one is kept, since it cannot be an echo of it. The state is
    one number per camera. Events are taken as they arrive, those of one trigger in order of time
    (a camera's events of a trigger are held together for that); ``debounce_ordered`` puts all of
    them in order.
    """

    def keep(
        key: tuple, parts: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        # Arrow batches may cut a camera's events anywhere, so they are put in order together.
        part = pd.concat(parts, ignore_index=True).sort_values(["ts_us", "seq"], kind="stable")
        kept = []
        for ts in part["ts_us"].tolist():
            fresh = last is None or not 0 <= ts - last < min_gap_us
            if fresh:
                last = ts
            kept.append(fresh)
        if last is not None:
            state.update((last,))
        yield part.loc[kept, ["camera", "ts_us", "seq", "notes"]]

    return events.groupBy("camera").applyInPandasWithState(
        keep, OUTPUT, "last_us bigint", "append", GroupStateTimeout.NoTimeout
    )


class OrderedDebounce(StatefulProcessor):
    """Holds a camera's events until the watermark has passed their slot, then takes them in order of time.

    Waiting events are a list of what each trigger brought; one timer, for the first slot that is not over,
    takes all that has become due. So a camera costs a few calls to its state per trigger, however many slots
    its events lie in. What waits for a camera is held at once when its timer goes off.
    """

    COLUMNS = ["ts_us", "seq", "notes"]

    def __init__(self, min_gap_us: int, slot_us: int) -> None:
        self.min_gap_us, self.slot_us = min_gap_us, slot_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last_us bigint")
        self.waiting = handle.getListState("waiting", "ts_us array<bigint>, seq array<bigint>, notes array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        over = self._over(timerValues)
        fresh = [part.loc[part["ts_us"] // self.slot_us >= over, self.COLUMNS] for part in rows]
        fresh = pd.concat(fresh, ignore_index=True)
        if len(fresh):
            self.waiting.appendValue(self._held(fresh))
            self._wake(fresh)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [pd.DataFrame(dict(zip(self.COLUMNS, some))) for some in self.waiting.get()] if self.waiting.exists() else []
        if not held:
            return
        rows = pd.concat(held, ignore_index=True)
        due = rows["ts_us"] // self.slot_us < self._over(timerValues)
        if not due.any():
            return
        if due.all():
            self.waiting.clear()
        else:
            self.waiting.put([self._held(rows[~due])])
            self._wake(rows[~due])
        part = rows[due].sort_values(["ts_us", "seq"], kind="stable")
        last = self.last.get()[0] if self.last.exists() else None
        kept = []
        for ts in part["ts_us"].tolist():
            fresh = last is None or not 0 <= ts - last < self.min_gap_us
            last = ts if fresh else last
            kept.append(fresh)
        self.last.update((last,))
        yield part.loc[kept].assign(camera=key[0])[["camera", *self.COLUMNS]]

    def _held(self, rows: pd.DataFrame) -> tuple:
        return tuple(rows[c].tolist() for c in self.COLUMNS)

    def _over(self, timerValues) -> int:
        """Slots before it are over."""
        return max(timerValues.getCurrentWatermarkInMs(), 0) * 1000 // self.slot_us

    def _wake(self, rows: pd.DataFrame) -> None:
        """A timer, in milliseconds, for when the first slot of the rows is over."""
        self.handle.registerTimer((int(rows["ts_us"].min()) // self.slot_us + 1) * self.slot_us // 1000)

    def close(self) -> None:
        pass


def debounce_ordered(events: DataFrame, min_gap_us: int, delay_us: int, slot_us: int = 60_000_000) -> DataFrame:
    """STR02 in order of time, whatever the order of arrival: the same rows as one sorted pass.

    Events wait in slots of ``slot_us`` (whole milliseconds) until the watermark, the latest event time less
    ``delay_us``, has passed the slot; event-time timers then take those that are due in order. The state is one
    number and the waiting events of a camera. Events in a slot that an earlier trigger's watermark has passed are late
    and left out; times before 1970 are late in any stream with a watermark. Run it under ``rocksdb_state``.
    """
    if slot_us % 1000:
        raise ValueError("slots are whole milliseconds")
    timed = events.withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", f"{delay_us} microseconds")
    return timed.groupBy("camera").transformWithStateInPandas(
        OrderedDebounce(min_gap_us, slot_us), OUTPUT, "append", "EventTime"
    )


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries that start inside keep their state in RocksDB, which operators with timers need; the session's own
    setting holds again afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def write_events(
    events: DataFrame, path: str, checkpoint: str, fmt: str = "csv", **trigger
) -> StreamingQuery:
    """STR03: append events to files; the checkpoint makes every event land exactly once."""
    return (
        events.writeStream.format(fmt)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .option("header", True)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
