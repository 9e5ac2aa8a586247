import fixtures as fx
import pytest
from pyspark.sql import functions as F

from coincide.params import AnalysisParams
from coincide.schema import EVENT_SCHEMA
from coincide.session import spread
from coincide.sources import airodump, api_json, capture, clips, delimited, ingest, kismet, registry, syslog

P = AnalysisParams(log_year=2026)


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    return fx.write_all(tmp_path_factory.mktemp("inputs"))


def rows(df):
    return sorted((r.asDict() for r in df.filter("reject IS NULL").collect()), key=lambda r: (r["ts_us"], r["ordinal"]))


def rejects(df):
    return sorted(r.reject for r in df.filter("reject IS NOT NULL").collect())


def ops(found):
    return [(r["kind"], r["subtype"], r["client_mac"]) for r in found]


def test_dnsmasq(spark, files):
    df = syslog.read_syslog(spark, [str(files["logs/dnsmasq.log"])], P)
    got = rows(df)
    assert [r["subtype"] for r in got] == ["ACK", "DISCOVER", "OFFER", "REQUEST", "ACK"]
    assert {r["kind"] for r in got} == {"assoc"} and {r["category"] for r in got} == {"context"}
    assert got[1]["ts_us"] == fx.us(60) and got[1]["utc_offset"] == "-04:00"
    assert got[1]["notes"] == "DHCPDISCOVER 192.168.1.50" and got[1]["source_ref"] == "line 2"
    assert rejects(df) == ["no recognizable syslog timestamp"]


def test_isc_hostapd_kea(spark, files):
    got = rows(syslog.read_syslog(spark, [str(files["logs/isc-dhcpd.log"])], P))
    assert ops(got) == [("assoc", "DISCOVER", fx.CLIENT), ("assoc", "ACK", fx.CLIENT)]
    assert [r["ts_us"] for r in got] == [fx.us(5), fx.us(6)]
    got = rows(syslog.read_syslog(spark, [str(files["logs/hostapd.log"])], P))
    assert [r["kind"] for r in got] == ["link_reset", "assoc", "link_reset"]
    assert got[0]["notes"] == "hostapd: disassociated" and got[0]["category"] == "disruption"
    assert got[2]["reason_code"] == 3 and got[2]["notes"] == "hostapd: hostapd station disconnect"
    got = rows(syslog.read_syslog(spark, [str(files["logs/kea-dhcp4.log"])], P))
    assert ops(got) == [
        ("assoc", "ACK", fx.CLIENT), ("assoc", "RENEW", fx.CLIENT),
        ("assoc", "DISCOVER", fx.CLIENT), ("context", "RELEASE", fx.CLIENT),
    ]
    assert got[0]["ts_us"] == fx.us(12) + 250_000


def test_year_of_the_file(spark, tmp_path):
    import os

    path = tmp_path / "old.log"
    path.write_text(f"Dec 31 23:00:00 fw dhcpd: DHCPACK on 10.0.0.1 to {fx.CLIENT} via igb1\n")
    os.utime(path, (1767358800, 1767358800))  # 2 January 2026
    got = rows(syslog.read_syslog(spark, [str(path)], AnalysisParams()))
    assert got[0]["ts_local"].year == 2025


def test_saved_api_rows_match_the_log(spark, files):
    path = [str(files["logs/fetched.json"])]
    df = api_json.read_api(spark, path, P)
    got = rows(df)
    assert ops(got) == [
        ("assoc", "ACK", fx.CLIENT), ("assoc", "DISCOVER", fx.CLIENT), ("link_reset", None, fx.CLIENT)
    ]
    assert [r["ts_us"] for r in got] == [fx.us(0), fx.us(60), fx.us(70)]
    assert got[1]["source_ref"] == "dhcp row 2" and got[1]["raw"].startswith("dnsmasq-dhcp: DHCPDISCOVER")
    assert rejects(df) == ["no readable timestamp"]
    warned = api_json.envelope_warnings(api_json.read_envelopes(spark, path)).collect()
    assert sorted(r.reason for r in warned) == ["incomplete fetch", "unverified connection"]


def test_frame_table(spark, files):
    df = delimited.read_frames(spark, [str(files["captures/nzyme-deauth.csv"])], P)
    got = rows(df)
    assert [(r["kind"], r["reason_code"], r["client_mac"]) for r in got] == [
        ("deauth", 7, None), ("disassoc", 8, fx.CLIENT)
    ]
    assert got[0]["notes"].startswith("broadcast") and got[1]["notes"] == "home"
    assert got[0]["signal"] == -45 and got[0]["channel"] == 6 and got[0]["source_ref"] == "row 2"
    assert rejects(df) == ["unreadable timestamp"]


def test_frame_table_override(spark, tmp_path):
    path = tmp_path / "odd.csv"
    path.write_text(f"moment,type,who\n{fx.at(1).isoformat()},deauth,{fx.ATTACKER}\n")
    df = delimited.read_frames(spark, [str(path)], P, {"timestamp": "moment", "src_mac": "who"})
    assert [r["src_mac"] for r in rows(df)] == [fx.ATTACKER]


def test_camera_tables(spark, files):
    df = delimited.read_camera(
        spark, [str(files["camera/camera_events.csv"]), str(files["camera/bare.tsv"])],
        AnalysisParams(log_year=2026, camera_clock_offset_s=-2),
    )
    got = rows(df)
    assert [r["ts_us"] for r in got] == [fx.us(s - 2) for s in (100, 200, 300, 310)]
    assert [r["plate"] for r in got] == ["ABC123", None, "XYZ", "XYZ2"]
    assert got[0]["notes"] == "blue, dented" and got[2]["model"] == "Golf"
    assert rejects(df) == ["unreadable timestamp"]


def test_clips(spark, files):
    folder = str(files["camera/bare.tsv"].parent.parent / "clips")
    df = clips.read_clips(spark, [folder], P)
    got = rows(df)
    assert [r["ts_us"] for r in got] == [fx.us(i) for i in range(6)]
    counts = {r.pattern: r.n for r in clips.pattern_counts(df).collect()}
    assert counts == {"Tapo / Reolink / Blue Iris": 2, "Dahua / Amcrest": 2, "UniFi Protect": 1, "ISO 8601": 1}
    by_mtime = clips.read_clips(spark, [folder], AnalysisParams(clip_time_from="mtime"))
    assert {r["pattern"] for r in rows(by_mtime)} == {"mtime"}


def test_captures(spark, files):
    got = rows(capture.read_captures(spark, [str(files["captures/capture-01.cap"])], P))
    assert [r["kind"] for r in got] == ["deauth"] * 6 + ["disassoc", "deauth"]
    assert got[0]["ts_us"] == fx.us(400) and got[1]["ts_us"] == fx.us(400) + 90_000
    assert (got[0]["signal"], got[0]["channel"], got[0]["reason_code"]) == (-42, 6, 7)
    assert got[0]["src_mac"] == fx.ATTACKER and got[0]["dst_mac"] == fx.ALL and got[0]["client_mac"] is None
    assert got[0]["source_ref"] == "packet 2"
    got = rows(capture.read_captures(spark, [str(files["captures/big-endian.pcap"])], P))
    assert (got[0]["ts_us"], got[0]["reason_code"], got[0]["client_mac"]) == (fx.us(410), 1, fx.CLIENT)
    df = capture.read_captures(spark, [str(files["captures/cut.pcap"])], P)
    assert rows(df)[0]["reason_code"] is None and len(rejects(df)) == 1
    got = rows(capture.read_captures(spark, [str(files["captures/capture.pcapng"])], P))
    assert len(got) == 6 and {r["signal"] for r in got} == {-55}
    df = capture.read_captures(spark, [str(files["captures/wired.pcap"])], P)
    assert rejects(df) == ["no 802.11 link type"]


def test_kismet(spark, files):
    got = rows(kismet.read_kismet(spark, [str(files["captures/kismet.kismet"])], P))
    assert [r["kind"] for r in got] == ["deauth", "deauth", "alert", "alert"]
    assert [r["signal"] for r in got[:2]] == [-60, -42]
    assert got[0]["ts_us"] == fx.us(430) + 5
    assert got[2]["src_mac"] == fx.ATTACKER and got[2]["notes"].endswith(" - flood!")
    assert got[3]["src_mac"] == fx.AP


@pytest.mark.parametrize("chunks", [None, 3])
def test_airodump(spark, files, chunks):
    from coincide.sources.lines import numbered_lines

    lines = numbered_lines(spark, [str(files["captures/airodump-01.csv"])])
    got = rows(airodump.station_rows(lines, P, chunks))
    assert [r["ts_us"] for r in got] == [fx.us(440), fx.us(441)]
    assert got[0]["notes"] == "airodump last seen; 12 frames; BSSID home"
    assert got[1]["bssid"] is None and got[1]["notes"] == "airodump last seen; 3 frames"
    assert got[0]["signal"] == -50


def test_detect(spark, files):
    folder = str(files["camera/bare.tsv"].parent.parent)
    found = registry.detect(registry.catalog(spark, [folder])).collect()
    got = {r.path.rsplit("/", 1)[-1]: r.parser for r in found}
    assert got["dnsmasq.log"] == got["hostapd.log"] == got["isc-dhcpd.log"] == got["kea-dhcp4.log"] == "opnsense"
    assert got["fetched.json"] == "opnsense_api"
    assert got["camera_events.csv"] == "camera_csv"
    assert got["capture-01.cap"] == got["capture.pcapng"] == got["big-endian.pcap"] == "pcap80211"
    assert got["kismet.kismet"] == "kismet" and got["airodump-01.csv"] == "airodump_csv"
    assert got["nzyme-deauth.csv"] == "nzyme_csv"
    assert sum(p == "camera_clips" for p in got.values()) == 6


def test_read_inputs(spark, files):
    root = files["camera/bare.tsv"].parent.parent
    got = ingest.read_inputs(
        spark,
        {
            "opnsense-log": [str(root / "logs")],
            "wifi-capture": [str(root / "captures")],
            "camera-events": [str(root / "camera/camera_events.csv"), str(root / "clips")],
        },
        P,
    )
    assert got.events.columns == [f.name for f in EVENT_SCHEMA]
    kinds = {r.kind: r["count"] for r in got.events.groupBy("kind").count().collect()}
    assert kinds["camera"] == 8 and kinds["alert"] == 2 and kinds["link_reset"] == 3
    assert got.events.select("case_id", "seq").distinct().count() == got.events.count()
    by_file = {r.path.rsplit("/", 1)[-1]: r.rows for r in got.files.collect()}
    assert by_file["capture.pcapng"] == 6 and by_file["dnsmasq.log"] == 5
    reasons = {r.reason for r in got.quality.collect()}
    assert {"unreadable timestamp", "no readable timestamp", "no 802.11 link type"} <= reasons
    assert {"clip times from ISO 8601", "year 2026 assumed where the log has none"} <= reasons


def test_window_extract(spark):
    def at(*hours):
        return spark.createDataFrame([(h * 3_600_000_000,) for h in hours], "ts_us bigint")

    since, until = ingest.anchor_window(at(18, 19))
    assert (since, until) == (16 * 3_600_000_000, 21 * 3_600_000_000)
    logs = spark.createDataFrame([(since - 1,), (since,), (until,), (until + 1,), (None,)], "ts_us bigint")
    assert ingest.extract_window(logs, since, until).count() == 3
    with pytest.raises(ValueError):
        ingest.anchor_window(at())
    with pytest.raises(ValueError):
        ingest.anchor_window(at(0, 90 * 24), max_days=31)


def test_dst_report(spark):
    readings = spark.sql(
        "SELECT unix_micros(CAST(t AS TIMESTAMP)) AS wall_us FROM VALUES "
        "('2026-11-01 01:30:00'), ('2026-11-01 01:45:00'), ('2026-03-08 02:30:00'), ('2026-07-01 12:00:00') v(t)"
    )
    counts, examples = ingest.dst_report(readings, "America/New_York")
    assert {r.edge: r.n for r in counts.collect()} == {"ambiguous": 2, "nonexistent": 1}
    assert examples.count() == 3
    sydney = spark.sql("SELECT unix_micros(TIMESTAMP'2026-10-04 02:30:00') AS wall_us")
    assert ingest.dst_report(sydney, "Australia/Sydney")[0].first().edge == "nonexistent"
    lord_howe = spark.sql("SELECT unix_micros(TIMESTAMP'2026-04-05 01:45:00') AS wall_us")
    assert ingest.dst_report(lord_howe, "Australia/Lord_Howe")[0].first().edge == "ambiguous"


def test_registered_format(spark, tmp_path):
    path = tmp_path / "beeps.txt"
    path.write_text("BEEP 1000000\nBEEP 2000000\n")

    def read(session, paths, params):
        rows = session.read.text(paths).select(
            F.split("value", " ")[1].cast("bigint").alias("ts_us"), F.lit("camera").alias("kind"),
            F.lit("camera").alias("category"), F.col("_metadata.file_path").alias("source_file"),
            F.monotonically_increasing_id().alias("ordinal"), F.lit(None).cast("string").alias("reject"),
        )
        return rows

    beeps = registry.Format(
        "beeps", registry.ANCHORS, "test format",
        lambda: F.when(F.col("head").cast("string").startswith("BEEP"), 1.0).otherwise(0.0), read,
    )
    registry.register(beeps)
    try:
        got = ingest.read_inputs(spark, {registry.ANCHORS: [str(path)]}, P)
        assert sorted(r.ts_us for r in got.events.collect()) == [1_000_000, 2_000_000]
    finally:
        del registry.FORMATS["beeps"]
    with pytest.raises(ValueError):
        registry.detect(registry.catalog(spark, [str(path)]), forced="nothing")


def test_costly_columns_are_not_copied_into_filters(spark):
    """Positions of columns and blank cells are found after the events are dealt to tasks, once."""
    made = spark.range(30).repartition(3).selectExpr(
        "'f' AS path", "id + 1 AS row_no", "0 AS mtime_us",
        "if(id = 0, array('time', 'subtype'), array(concat('2024-01-01 00:00:', id + 10), 'deauth')) AS fields")
    rows = delimited.frame_rows(made, AnalysisParams(timezone="UTC"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not [line for line in plan if "+- Filter" in line and ("array_position" in line or "concat" in line)]
    assert rows.filter("kind = 'deauth'").count() == 29


def test_spread_deals_by_rows(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    given = spark.read.parquet(str(tmp_path / "t"))
    sizes = [len(part) for part in spread(given, 50).rdd.glom().collect()]
    assert len(sizes) == 20 and max(sizes) <= 60
    assert spread(given).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
