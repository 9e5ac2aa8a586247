"""Cells against the csv module, captures against what was written, and zero-byte files."""

import csv
import io
import random

import fixtures as fx
import pytest

from coincide.params import AnalysisParams
from coincide.sources import airodump, clips, delimited
from coincide.sources.lines import numbered_lines
from coincide.sources.records import packets_of

P = AnalysisParams(timezone="UTC", log_year=2024)


@pytest.mark.parametrize("chunks", [None, 5])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cells_are_those_of_the_csv_module(spark, tmp_path, chunks, seed):
    rng = random.Random(seed)
    pieces = ['"', '""', ",", "\n", "a", "b c", "", '5" x', "é"]
    text = "".join(rng.choice(pieces) for _ in range(260)) + "z"
    if seed == 3:
        rows = [[rng.choice(["", "x", 'q"q', "two\nlines", "c,d"]) for _ in range(rng.randrange(1, 6))] for _ in range(60)]
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows(rows)
        text = out.getvalue()
    (tmp_path / "t.csv").write_text("﻿" + text, encoding="utf-8", newline="")
    got = [r.fields for r in delimited.read_records(spark, [str(tmp_path / "t.csv")], chunks=chunks).orderBy("row_no").collect()]
    want = list(csv.reader(io.StringIO(text, newline="")))
    assert got == want


def test_blank_cells_stay_in_place(spark, tmp_path):
    wide = ",".join(f"x{i}" for i in range(300))
    (tmp_path / "p.csv").write_text(f"{wide},timestamp,plate,make,model,notes\n{',' * 300}2024-01-01 00:00:00,,Ford,,hello\n")
    row = delimited.read_camera(spark, [str(tmp_path / "p.csv")], P).first()
    assert (row.plate, row.make, row.model, row.notes) == (None, "Ford", None, "hello")
    lines = "BSSID, a, b, c, d, e, f\nStation MAC, x\naa:bb:cc:00:00:02, 2024-01-01 00:00:00, 2024-01-01 00:00:01, -40, , aa:bb:cc:00:00:01,\n"
    (tmp_path / "s.csv").write_text(lines)
    row = airodump.station_rows(numbered_lines(spark, [str(tmp_path / "s.csv")]), P).first()
    assert (row.bssid, row.signal) == ("aa:bb:cc:00:00:01", -40)


def test_empty_files_are_listed(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "20240101_000000.mp4").touch()
    (tmp_path / "a" / "20240101_000001.mp4").write_bytes(b"x")
    rows = clips.read_clips(spark, [str(tmp_path)], P).filter("reject IS NULL").collect()
    assert sorted(r.raw for r in rows) == ["20240101_000000.mp4", "20240101_000001.mp4"]


@pytest.mark.parametrize("write", [lambda p: fx.pcap(p), lambda p: fx.pcap(p, order=">", nanos=True), fx.pcapng])
def test_packets_around_damage(write):
    rng = random.Random(4)
    packets = [(1_700_000_000_000_000 + i * 1000, rng.randbytes(rng.randrange(1, 200))) for i in range(300)]
    whole = write(packets)
    assert [(p.ts_us, p.data) for p in packets_of(io.BytesIO(whole))] == packets
    middle = len(whole) // 2
    found = list(packets_of(io.BytesIO(whole[:middle] + b"\xff" * 300 + whole[middle + 300 :])))
    real = [(p.ts_us, p.data) for p in found if p.warning is None]
    assert len(set(real) & set(packets)) >= 290 and [p.warning for p in found if p.warning]
    for size in (0, 3, 10, 30, 500):
        assert all(p.warning or (p.ts_us, p.data) in packets for p in packets_of(io.BytesIO(whole[:size])))


@pytest.mark.parametrize("size", ["16", "90", "1m"])
@pytest.mark.parametrize("chunks", [None, 3])
def test_records_of_files_cut_anywhere(spark, tmp_path, size, chunks):
    """Several files in splits of a few bytes, quoted line breaks over many of them, and an open quote at the end."""
    rng = random.Random(12)
    texts = []
    for k in range(4):
        rows = [[rng.choice(["", "x", 'q"q', "two\nlines", "\n\n\n", "c,d", "long " * 9 + "\n"]) for _ in range(rng.randrange(1, 5))] for _ in range(25)]
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows(rows)
        texts.append(out.getvalue() + ['"never closed\nx,y', "", "plain"][k % 3])
        (tmp_path / f"{k}.csv").write_text(texts[-1], newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = delimited.read_records(spark, [str(tmp_path)], chunks=chunks).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    for k, text in enumerate(texts):
        mine = sorted((r.row_no, r.fields) for r in rows if r.path.endswith(f"/{k}.csv"))
        want = list(csv.reader(io.StringIO(text, newline="")))
        assert mine == list(enumerate(want, 1))


def test_text_is_never_shuffled(spark, tmp_path):
    """No exchange but broadcasts of splits, for delimited files, station tables and logs."""
    (tmp_path / "t.csv").write_text('timestamp,notes\n2024-01-01 00:00:00,"a, b"\n' * 50)
    frames = [
        delimited.read_records(spark, [str(tmp_path)]),
        numbered_lines(spark, [str(tmp_path)]),
    ]
    for df in frames:
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" in plan and not {"Exchange hash", "Exchange range", "Exchange Single"} & {
            line.strip(" :+-*()0123456789")[:13] for line in plan.splitlines()}
        assert plan.count("Exchange") == plan.count("BroadcastExchange")


def test_stations_of_files_cut_anywhere(spark, tmp_path):
    head = "BSSID, a, b, c, d, e, f\nStation MAC, x\n"
    body = "".join(f"aa:bb:cc:00:{i // 100:02d}:{i % 100:02d}, 2024-01-01 00:00:00, 2024-01-01 00:00:01, -40, 3, aa:bb:cc:00:00:01,\n" for i in range(120))
    other = "AA:BB, 1\n\n" + "BSSID, a\n" + body.splitlines()[0] + "\n" + head + body.splitlines()[1] + "\n"
    (tmp_path / "a.csv").write_text(head + body)
    (tmp_path / "b.csv").write_text(other)
    columns = ["source_file", "ordinal", "ts_us", "client_mac", "bssid", "notes"]
    want = sorted(airodump.station_rows(numbered_lines(spark, [str(tmp_path)]), P).select(columns).collect())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = sorted(airodump.read_stations(spark, [str(tmp_path)], P).select(columns).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 121 and got == want
