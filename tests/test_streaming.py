import random

import pandas as pd
import pytest
from coincide.operators.dedupe import debounce
from coincide.operators.floods import flood_frames, floods
from coincide.operators.incidents import incidents
from coincide.schema import categorize, conform
from coincide.session import shared_dir
from coincide.streaming.incidents import MERGE_EARLY, flood_alerts, incident_stream, sessions_merged_early
from coincide.streaming.motion import OUTPUT, OrderedDebounce, debounce_ordered, debounce_stream, is_motion, motion_events, rocksdb_state, write_events
from pyspark.sql import functions as F

SCHEMA = "camera string, ts_us bigint, seq bigint, topic string, state string, source string"
TOPIC = "tns1:RuleEngine/CellMotionDetector/Motion"
S = 1_000_000


def test_topics(spark):
    topics = [
        (TOPIC, True), ("tns1:VideoSource/MotionAlarm", True), ("tns1:Device/Trigger/DigitalInput", False),
        ("tns1:RuleEngine/tnsx:FieldDetector/ObjectsInside", True),
    ]
    df = spark.createDataFrame(topics, "topic string, want boolean")
    assert df.filter(is_motion(F.col("topic")) != F.col("want")).count() == 0


def test_motion_stream(spark, tmp_path):
    batches = [
        [("front", 0, 0, "true"), ("front", 2, 1, "true"), ("front", 5, 2, "true"), ("back", 1, 3, None)],
        [("front", 9, 4, "1"), ("front", 20, 5, "false"), ("front", 10, 6, "true"), ("back", 5, 7, "active"), ("back", 6, 8, "true")],
        [("front", 3, 9, "true"), ("front", 4, 10, "true")],  # late: the first is kept
    ]
    source = tmp_path / "in"
    for i, batch in enumerate(batches):
        rows = [(c, t * S, s, TOPIC, state, "cam") for c, t, s, state in batch]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(f"{source}/{i}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{source}/*")
    kept = debounce_stream(motion_events(stream), 5 * S)
    out = str(tmp_path / "out")
    write_events(kept, out, str(tmp_path / "checkpoint"), "parquet").awaitTermination(120)
    got = sorted((r.camera, r.ts_us // S) for r in spark.read.parquet(out).collect())
    assert got == [("back", 1), ("back", 6), ("front", 0), ("front", 3), ("front", 5), ("front", 10)]
    assert shared_dir(spark)


COLUMNS = "case_id string, ts_us bigint, seq bigint, kind string, src_mac string"


def events(spark, rows):
    """Canonical events from (case, seconds, kind, source)."""
    some = [(c, round(t * S), i, k, m) for i, (c, t, k, m) in enumerate(rows)]
    df = spark.createDataFrame(some, COLUMNS)
    return conform(df.withColumn("category", categorize(F.col("kind"))))


def streamed(spark, folder, batches, live):
    """What ``live`` appends when the batches come in one after another, and the progress reports."""
    for i, batch in enumerate(batches):
        batch.coalesce(1).write.json(f"{folder}/in/{i}")
    stream = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).json(f"{folder}/in/*")
    made = live(stream)
    query = write_events(made, f"{folder}/out", f"{folder}/checkpoint", "parquet")
    query.awaitTermination(200)
    return spark.read.schema(made.schema).parquet(f"{folder}/out"), query.recentProgress


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_incident_stream(spark, tmp_path):
    gap = 60
    first = [("a", 0, "deauth", "x"), ("a", 60, "link_reset", "y"), ("a", 120.000001, "disassoc", "x"), ("b", 5, "deauth", "z"), ("b", 5, "deauth", "z")]
    second = [("a", 170, "deauth", "y"), ("b", 400, "alert", None), ("a", 500, "camera", None), ("b", 90, "deauth", "w")]
    late = [("a", 20, "deauth", "late"), ("a", 1000, "deauth", "x")]  # the watermark of the batches before is 390 s
    last = [("b", 3000, "deauth", "q"), ("b", 3060, "deauth", "q")]
    batches = [events(spark, b) for b in (first, second, late, last)]
    found, progress = streamed(spark, tmp_path, batches, lambda e: incident_stream(e, gap * S, 10 * S))
    on_time = events(spark, first + second + late[1:] + last[:1])  # the last incident is still open
    columns = ["case_id", "start_us", "end_us", "n_events", "kinds", "src_macs", "has_deauth"]
    want = [r for r in rows_of(incidents(on_time, gap * S), *columns) if r[1] < 3000 * S]
    assert rows_of(found, *columns) == want and len(want) == 6
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 1
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in progress) == 1


def test_incident_stream_merged_early(spark, tmp_path, capsys):
    """A long incident and a late row: the same rows, and sessions are merged before they are shuffled too."""
    rows = [[("a", t, "deauth", "xyz"[t % 3]) for t in range(2000)] + [("b", 5, "alert", None)], [("a", 9000, "deauth", "x"), ("a", 100, "deauth", "late")],
            [("a", 9500, "deauth", "x"), ("a", 2100, "deauth", "late"), ("a", 9030, "deauth", "y")], [("b", 20000, "deauth", "q")]]
    batches = [events(spark, b) for b in rows]
    plain, _ = streamed(spark, tmp_path / "plain", batches, lambda e: incident_stream(e, 60 * S, 10 * S))
    before = spark.conf.get(MERGE_EARLY)
    with sessions_merged_early(spark):
        early, _ = streamed(spark, tmp_path / "early", batches, lambda e: incident_stream(e, 60 * S, 10 * S))
        stream = spark.readStream.schema(batches[0].schema).json(f"{tmp_path}/early/in/*")
        query = write_events(incident_stream(stream, 60 * S, 10 * S), f"{tmp_path}/again", f"{tmp_path}/checkpoint", "parquet")
        query.awaitTermination(200)
    assert spark.conf.get(MERGE_EARLY) == before
    assert rows_of(early, *early.columns) == rows_of(plain, *plain.columns) and early.count() >= 4
    capsys.readouterr()
    query.explain()
    plan = capsys.readouterr().out
    assert "MergingSessions" in plan[plan.index("Exchange"):]


def test_flood_alerts(spark, tmp_path):
    draw = random.Random(4)
    rows = sorted((draw.choice("ab"), round(draw.choice([500, 2000, 5000]) + draw.random() * 400, 3), "deauth", "x") for _ in range(150))
    rows = sorted(rows, key=lambda r: r[1]) + [("a", 90_000, "deauth", "end")]
    batches = [events(spark, rows[i : i + 40]) for i in range(0, len(rows), 40)]
    window, slide, k = 60, 7, 9
    found, progress = streamed(spark, tmp_path, batches, lambda e: flood_alerts(e, window * S, k, slide * S, 30 * S))
    count = {}
    for case, t, _, _ in rows[:-1]:
        at = round(t * S)
        for start in range((at - (window + slide) * S) // (slide * S) + 1, at // (slide * S) + 1):
            count[case, start * slide * S] = count.get((case, start * slide * S), 0) + 1
    want = sorted((c, s, s + (window + slide) * S, n) for (c, s), n in count.items() if n >= k)
    assert rows_of(found, "case_id", "start_us", "end_us", "n_frames") == sorted(want, key=repr) and want
    # Every flood has an alert within it.
    every = events(spark, rows)
    for r in floods(flood_frames(every, window * S, k), window * S).collect():
        assert any(c == r.case_id and s <= r.end_us and e > r.start_us for c, s, e, _ in want)
    # Only the windows of the last frame are still held.
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == -(-(window + slide) // slide)


def test_one_trigger_is_debounced_in_order_of_time(spark, tmp_path):
    """Rows that come in any order and in many Arrow batches give the rows of one sorted pass."""
    draw = random.Random(3)
    rows = [(draw.choice(["front", "back"]), draw.randrange(3000 * S), i, f"n{i}") for i in range(600)]
    given = spark.createDataFrame(rows, "camera string, ts_us bigint, seq bigint, notes string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found, _ = streamed(spark, tmp_path, [given], lambda e: debounce_stream(e, 9 * S))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert rows_of(found, "camera", "ts_us", "seq", "notes") == rows_of(debounce(given, ["camera"], 9 * S), "camera", "ts_us", "seq", "notes")


class Calls:
    """A state handle that counts what is asked of it."""

    def __init__(self):
        self.n, self.held = 0, []

    def __getattr__(self, name):
        def called(*args):
            self.n += 1
            self.held += list(args) if name == "appendValue" else []
            return self if name.startswith("get") else None

        return called

    def getCurrentWatermarkInMs(self):
        return 0


def test_waiting_costs_a_few_calls_however_many_slots():
    calls = Calls()
    held = OrderedDebounce(9 * S, 50 * S)
    held.init(calls)
    before = calls.n
    part = pd.DataFrame({"ts_us": [i * 50 * S for i in range(400)], "seq": range(400), "notes": "n"})
    assert list(held.handleInputRows(("front",), iter([part]), calls)) == []
    assert calls.n - before <= 4


@pytest.mark.parametrize("arrow_rows", [7, 10_000])
def test_ordered_debounce(spark, tmp_path, arrow_rows):
    """Any order of arrival within the delay gives the rows of one sorted pass."""
    draw = random.Random(9)
    rows = [(draw.choice(["front", "back", None]), draw.randrange(4000 * S), i, f"n{i}") for i in range(900)]
    rows += [("front", rows[3][1], 900 + i, "tie") for i in range(5)]
    arrival = sorted(rows, key=lambda r: r[1] + draw.randrange(200 * S)) + [("end", 9000 * S, 1000, "end")]
    schema = "camera string, ts_us bigint, seq bigint, notes string"
    batches = [spark.createDataFrame(arrival[i : i + 200], schema) for i in range(0, len(arrival), 200)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", arrow_rows)
    try:
        with rocksdb_state(spark):
            found, progress = streamed(spark, tmp_path, batches, lambda e: debounce_ordered(e, 9 * S, 250 * S, 50 * S))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = debounce(spark.createDataFrame(rows, schema), ["camera"], 9 * S)
    assert rows_of(found, "camera", "ts_us", "seq", "notes") == rows_of(want, "camera", "ts_us", "seq", "notes")
    assert len(progress) > 4 and found.schema.simpleString() == spark.createDataFrame([], OUTPUT).schema.simpleString()


def test_late_motion_is_left_out(spark, tmp_path):
    schema = "camera string, ts_us bigint, seq bigint, notes string"
    batches = [spark.createDataFrame([("c", t * S, i, "") for i, t in b], schema) for b in ([(0, 10), (1, 500)], [(2, 30), (3, 480)], [(4, 2000)])]
    with rocksdb_state(spark):
        found, _ = streamed(spark, tmp_path, batches, lambda e: debounce_ordered(e, 5 * S, 100 * S, 10 * S))
    assert rows_of(found, "seq") == [(0,), (1,), (3,)]


def test_slots_are_whole_milliseconds(spark):
    with pytest.raises(ValueError):
        debounce_ordered(spark.createDataFrame([], OUTPUT), S, S, 1500)
