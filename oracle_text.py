"""SQL for the queries over functions, sources, sinks and streams."""

from __future__ import annotations

from coincide.functions.reasons import REASON_CODES
from coincide.functions.times import CLIP_NAMES
from coincide.plans.queries import WIDE_GAP, WIDTHS
from coincide.sources.kismet import ALERTS
from coincide.streaming.motion import MOTION_TOPICS
from oracle import _FLOOD, _FLOODS, _MATCH, CASE8, MAC, ORACLE, W, ev, inc, stats

SP = f"""
sp AS (SELECT event_id, user_id, event_type, ts, value, epoch_us(ts) AS us,
         CAST(json_extract(props, '$.k') AS INTEGER) AS k,
         {MAC} AS mac
       FROM events)"""


def pick(on: str, *choices: str) -> str:
    n = len(choices)
    return "CASE " + " ".join(f"WHEN {on} % {n} = {i} THEN {c}" for i, c in enumerate(choices)) + " END"


def sec(expr: str = "us") -> str:
    return f"({expr} // 1000000 * 1000000)"


REASON = "CASE {0} " + " ".join(
    f"WHEN {code} THEN '{text}'" for code, text in REASON_CODES.items()
) + " ELSE 'Reserved/unknown reason code ' || {0} END"

ORACLE["fn01_norm_mac"] = f"""
WITH {SP}, t AS (SELECT event_id, {pick('k', 'mac', 'mac', 'mac', 'mac', 'NULL', 'NULL', "'ff:ff:ff:ff:ff:ff'", "'01:00:5e:00:00:fb'")} AS mac FROM sp)
SELECT event_id, mac, coalesce(mac LIKE 'ff:%' OR mac LIKE '01:%', false) AS is_group,
  coalesce(mac = 'ff:ff:ff:ff:ff:ff', false) AS is_broadcast,
  CASE WHEN mac LIKE '3c:%' THEN mac END AS client FROM t"""

ORACLE["fn02_mac_in_text"] = f"WITH {SP} SELECT event_id, mac FROM sp"

ORACLE["fn05_reason_text"] = f"""
WITH {SP} SELECT event_id, {REASON.format('k')} AS reason, k IN (1, 7) AS signature FROM sp"""

ORACLE["fn07_parse_iso"] = f"""
WITH {SP} SELECT event_id, us - {pick('user_id', '0', '-14400000000', '19800000000')} AS ts_us,
  {pick('user_id', "'+00:00'", "'-04:00'", "'+05:30'")} AS utc_offset FROM sp"""

# Day first: read as month first where that is a date.
_SWAPPED = f"""CASE WHEN day(ts) > 12 THEN {sec()} ELSE
  epoch_us(make_timestamp(year(ts), day(ts), month(ts), hour(ts), minute(ts), floor(second(ts))::DOUBLE)) END"""
ORACLE["fn10_parse_any"] = f"""
WITH {SP} SELECT event_id, {pick('k', sec(), sec(), sec(), '(us // 1000 * 1000)', sec(), sec(), sec(), 'NULL', sec(), _SWAPPED)} AS ts_us FROM sp"""

_YEAR = """
yr AS (SELECT event_id, 1704067200000000 + event_id * 37 % 8784 * 3600000000 + us % 3600000000 AS wall FROM sp),
tz AS (SELECT event_id, wall, epoch_us(timezone('America/New_York', make_timestamp(wall))) AS late,
         epoch_us(timezone('America/New_York', make_timestamp(wall - 3600000000))) + 3600000000 AS early FROM yr),
lo AS (SELECT *, least(late, early) AS ts_us FROM tz),
bk AS (SELECT *, epoch_us(timezone('America/New_York', make_timestamp(ts_us)::TIMESTAMPTZ)) AS local_us FROM lo)"""

ORACLE["fn11_localize"] = f"WITH {SP}, {_YEAR} SELECT event_id, ts_us, local_us FROM bk"

_EDGE = "CASE WHEN local_us <> wall THEN 'nonexistent' WHEN late <> ts_us THEN 'ambiguous' END"

ORACLE["fn12_dst_edge"] = f"WITH {SP}, {_YEAR} SELECT event_id, {_EDGE} AS edge FROM bk"

ORACLE["tk08_dst_examples"] = f"""
WITH {SP}, {_YEAR}, e AS (SELECT wall, {_EDGE} AS edge FROM bk), f AS (SELECT * FROM e WHERE edge IS NOT NULL),
x AS (SELECT DISTINCT wall, edge FROM f ORDER BY wall LIMIT 5), c AS (SELECT edge, count(*) AS n FROM f GROUP BY edge)
SELECT wall AS wall_us, edge, n FROM x LEFT JOIN c USING (edge)"""

_LABEL = {name.split()[0]: f"'{name}'" for name, _ in CLIP_NAMES}

ORACLE["fn14_clip_time"] = f"""
WITH {SP} SELECT event_id, CASE WHEN k % 7 < 6 THEN {sec()} END AS ts_us,
  {pick('k', _LABEL['Tapo'], _LABEL['Dahua'], _LABEL['Dahua'], _LABEL['UniFi'], _LABEL['ISO'], "'unix epoch'", 'NULL')} AS pattern FROM sp"""

ORACLE["fn18_humanize"] = f"""
WITH {SP}, s AS (SELECT event_id, k, us % 10000000000 AS z FROM sp),
d AS (SELECT event_id, {pick('k', '0', 'z % 1000000', '-(z % 90000000)', 'z % 5400000000', '-z', 'z', 'NULL')} AS d FROM s),
m AS (SELECT event_id, d, abs(d) AS a FROM d),
t AS (SELECT event_id, d, CASE
  WHEN a < 1000000 THEN ((a + 500) // 1000) || ' ms'
  WHEN a < 90000000 THEN ((a + 50000) // 100000 // 10) || '.' || ((a + 50000) // 100000 % 10) || ' s'
  WHEN a < 5400000000 THEN ((a + 3000000) // 6000000 // 10) || '.' || ((a + 3000000) // 6000000 % 10) || ' min'
  ELSE ((a + 18000000) // 36000000 // 100) || '.' || printf('%02d', (a + 18000000) // 36000000 % 100) || ' h' END AS x FROM m)
SELECT event_id, CASE WHEN d IS NULL THEN 'n/a' WHEN d = 0 THEN 'simultaneous' WHEN d < 0 THEN x || ' before' ELSE x || ' after' END AS text FROM t"""

ORACLE["fn19_text"] = f"""
WITH {SP} SELECT event_id, CASE WHEN k % 6 = 5 THEN event_type END AS text,
  CASE WHEN k % 6 = 5 THEN event_type ELSE '-' END AS cell FROM sp"""

ORACLE["fn21_frame_fields"] = f"""
WITH {SP} SELECT event_id,
  {pick('k', "'deauth'", "'deauth'", "'disassoc'", "'disassoc'", 'NULL', "CASE WHEN user_id % 5 <> 3 THEN 'deauth' END")} AS kind,
  CASE WHEN user_id % 5 < 3 THEN k END::BIGINT AS code,
  CASE WHEN k % 3 = 0 THEN 1 + k % 15 WHEN k % 3 = 1 THEN k
       WHEN 5955 + k * 20 <= 7115 THEN k * 4 + 1 END::BIGINT AS channel FROM sp"""

ORACLE["fn27_numbers"] = f"""
WITH {SP}, p AS (SELECT event_id, k, value, value / 7e3 * CASE WHEN k % 2 = 0 THEN 1.0 ELSE 1e-6 END AS p FROM sp)
SELECT event_id, CASE WHEN p < 1e-4 THEN format('{{:.2e}}', p) ELSE format('{{:.4f}}', p) END AS p,
  format('{{:.3f}}', value / 7) AS number,
  CASE WHEN k = 3 THEN 'infinitely above' ELSE format('{{:.1f}}', value / 7) || ' times' END AS lift,
  format('{{:.3g}}', p) AS general FROM p"""

_NY = "(us + 18000000000)"
ORACLE["src01_syslog"] = f"""
WITH {SP}, e AS (SELECT *, user_id % 3 AS f, event_type IN ('signup', 'click') AS lease, event_type = 'error' AS err,
  CASE event_type WHEN 'signup' THEN 'DISCOVER' ELSE 'ACK' END AS op FROM sp WHERE k <> 99)
SELECT event_id, CASE WHEN f = 1 THEN {sec(_NY)} ELSE {_NY} // 1000 * 1000 END AS ts_us,
  CASE WHEN f = 2 THEN CASE WHEN k % 3 = 2 THEN 'context' ELSE 'assoc' END WHEN lease THEN 'assoc' ELSE 'link_reset' END AS kind,
  CASE WHEN f = 2 OR lease THEN 'context' ELSE 'disruption' END AS category,
  CASE WHEN f = 2 THEN {pick('k', "'ACK'", "'RENEW'", "'RELEASE'")} WHEN lease THEN op END AS subtype, mac AS client_mac,
  CASE WHEN f < 2 AND err THEN k END::BIGINT AS reason_code,
  CASE WHEN f = 2 THEN {pick('k', "'DHCP4_LEASE_ALLOC'", "'DHCP4_LEASE_RENEW'", "'DHCP4_RELEASE'")}
       WHEN lease AND f = 0 THEN 'DHCP' || op || ' 192.168.1.' || k WHEN lease THEN 'DHCP' || op
       WHEN err THEN 'hostapd: hostapd station disconnect' ELSE 'hostapd: disassociated' END AS notes,
  NULL::VARCHAR AS reject
FROM e WHERE f = 2 OR event_type <> 'purchase'
UNION ALL
SELECT event_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'no recognizable syslog timestamp' FROM sp WHERE k = 99"""

ORACLE["src15_quality"] = f"""
WITH {SP} SELECT 'fw.log' AS source_file, 'no recognizable syslog timestamp' AS reason, count(*) AS n FROM sp WHERE k = 99
UNION ALL SELECT 'fw.log', 'format matched only weakly', 1"""

ORACLE["src05_api_rows"] = f"""
WITH {SP}, e AS (SELECT *, event_type IN ('signup', 'click') AS lease,
  CASE event_type WHEN 'signup' THEN 'DISCOVER' ELSE 'REQUEST' END AS op FROM sp)
SELECT event_id, {sec()} AS ts_us, CASE WHEN lease THEN 'assoc' ELSE 'link_reset' END AS kind,
  CASE WHEN lease THEN op END AS subtype, mac AS client_mac,
  CASE WHEN lease THEN 'dnsmasq-dhcp: DHCP' || op || '(igb1) ' || mac
       ELSE 'hostapd: STA ' || mac || ' IEEE 802.11: disassociated' END AS raw, 'dhcp row 1' AS source_ref FROM e"""

ORACLE["src06_frame_table"] = f"""
WITH {SP} SELECT event_id, us // 1000 * 1000 AS ts_us, CASE WHEN k % 3 = 0 THEN 'deauth' ELSE 'disassoc' END AS kind, mac AS src_mac,
  CASE WHEN k % 3 = 0 THEN 'ff:ff:ff:ff:ff:ff' ELSE mac END AS dst_mac, CASE WHEN k % 3 <> 0 THEN mac END AS client_mac,
  k::BIGINT AS reason_code, (-k)::BIGINT AS signal,
  CASE WHEN k % 3 = 0 THEN 'broadcast deauth - disconnects every client on the BSS' ELSE 'home' END AS notes,
  'row ' || (event_id + 2) AS source_ref FROM sp WHERE k % 3 < 2"""

ORACLE["src08_pass_log"] = f"""
WITH {SP} SELECT event_id, CASE WHEN k <> 42 THEN {sec()} + 18001500000 END AS ts_us,
  CASE WHEN k <> 42 THEN 'P' || user_id END AS plate, CASE WHEN k <> 42 THEN 'Ford' END AS make, NULL::VARCHAR AS model,
  CASE WHEN k <> 42 THEN event_type || CASE WHEN k % 2 = 0 THEN ' [clip: c' || k || ']' ELSE '' END END AS notes,
  CASE WHEN k <> 42 THEN 'row ' || (event_id + 2) END AS source_ref,
  CASE WHEN k = 42 THEN 'unreadable timestamp' END AS reject FROM sp"""

ORACLE["src07_stations"] = f"""
WITH {SP} SELECT event_id, {sec()} AS ts_us, mac AS client_mac, CASE WHEN k % 2 = 0 THEN 'aa:bb:cc:00:00:01' END AS bssid,
  (-k)::BIGINT AS signal, 'airodump last seen; ' || k || ' frames' || CASE WHEN k % 2 = 0 THEN '; BSSID home' ELSE '' END AS notes FROM sp"""

_CLIP_PATTERN = pick("k", _LABEL["Tapo"], _LABEL["ISO"], "'mtime'")
ORACLE["src09_clips"] = f"""
WITH {SP}, c AS (SELECT *, {_CLIP_PATTERN} AS pattern, {pick('k', "strftime(ts, '%Y%m%d_%H%M%S')", "strftime(ts, '%Y-%m-%dT%H-%M-%S')", "'clip'")} ||
    {pick('user_id', "'.mp4'", "'.JPG'", "'.txt'")} AS name FROM sp WHERE user_id % 3 < 2)
SELECT event_id, CASE WHEN k % 3 = 2 THEN us ELSE {sec()} END AS ts_us,
  'clip ' || name || '; time from ' || CASE WHEN k % 3 = 2
    THEN 'file modification time (NOT the recorded time - the filename carried no timestamp)'
    ELSE 'filename pattern: ' || pattern END AS notes, pattern FROM c"""

ORACLE["agg11_clip_patterns"] = f"WITH {SP} SELECT {_CLIP_PATTERN} AS pattern, count(*) AS n FROM sp GROUP BY 1"

ORACLE["src11_frames"] = f"""
WITH {SP} SELECT event_id, us AS ts_us, CASE user_id % 3 WHEN 0 THEN 'deauth' ELSE 'disassoc' END AS kind,
  'de:ad:be:ef:00:01' AS src_mac, CASE WHEN k % 3 = 0 THEN 'ff:ff:ff:ff:ff:ff' ELSE mac END AS dst_mac,
  'aa:bb:cc:00:00:01' AS bssid, CASE WHEN k % 3 <> 0 THEN mac END AS client_mac,
  CASE WHEN k % 5 <> 0 THEN k END::BIGINT AS reason_code, (-k - 1)::BIGINT AS signal, 6::BIGINT AS channel,
  'packet ' || event_id AS source_ref FROM sp WHERE user_id % 3 < 2"""

ORACLE["src12_alerts"] = f"""
WITH {SP} SELECT event_id, us AS ts_us, 'alert' AS kind, 'disruption' AS category,
  CASE WHEN user_id % 2 = 0 THEN mac ELSE 'aa:bb:cc:00:00:01' END AS src_mac, 'aa:bb:cc:00:00:01' AS bssid,
  CASE k % 3 WHEN 0 THEN 'DEAUTHFLOOD: {ALERTS["DEAUTHFLOOD"]}' ELSE 'BCASTDISCON: {ALERTS["BCASTDISCON"]}' END
    || CASE WHEN k % 2 = 0 THEN ' - seen ' || k ELSE '' END AS notes FROM sp WHERE k % 3 < 2"""

ORACLE["src13_detect"] = f"""
WITH {SP}, e AS (SELECT *, event_type IN ('signup', 'click') AS lease FROM sp),
s AS (SELECT event_id, k, CASE WHEN k = 99 THEN NULL WHEN user_id % 3 = 2 THEN 0.9 WHEN NOT lease THEN 0.8
        WHEN user_id % 3 = 1 THEN 0.85 ELSE 0.9 END AS log FROM e)
SELECT event_id, {pick('k', "CASE WHEN log IS NOT NULL THEN 'opnsense' END", "'camera_csv'", "'nzyme_csv'", "'airodump_csv'", "'opnsense_api'", 'NULL')} AS parser,
  {pick('k', 'coalesce(log, 0.0)', '0.95', '0.8', '0.9', '0.98', '0.0')}::DOUBLE AS score FROM s"""

ORACLE["src16_extract"] = f"""
WITH {ev()}, w AS (SELECT min(ts_us) - 7200000000 AS a, max(ts_us) + 7200000000 AS b FROM ev WHERE category = 'camera')
SELECT seq, ts_us, kind FROM ev, w WHERE category <> 'camera' AND ts_us BETWEEN a AND b"""


def iso(us: str, zone_hours: int) -> str:
    """Winter readings only: the events lie in January."""
    sign = "-" if zone_hours < 0 else "+"
    return (
        f"strftime(make_timestamp({us} + {zone_hours * 3600000000}), '%Y-%m-%dT%H:%M:%S.%g') "
        f"|| '{sign}{abs(zone_hours):02d}:00'"
    )


ORACLE["snk01_correlation"] = f"""{_MATCH}
SELECT {iso('mt.event_us', -5)} AS camera_event_local, {iso('mt.event_us', 0)} AS camera_event_utc, mt.plate,
  CASE WHEN mt.coincidence THEN 'YES' ELSE 'no' END AS coincidence, mt.delta_s AS delta_seconds,
  mt.nearest_kind AS nearest_disruption_type, {iso('ni.t', -5)} AS nearest_disruption_local,
  mt.attacker_mac AS deauth_source_mac, mt.reason_code,
  CASE WHEN mt.reason_code IS NOT NULL THEN {REASON.format('mt.reason_code')} END AS reason_meaning,
  mt.client_mac AS affected_client_mac,
  CASE WHEN mt.in_analysis_period THEN 'yes' ELSE 'NO - outside overlapping period' END AS within_analysis_period,
  mt.camera_source AS camera_source_file FROM mt JOIN ni USING (seq)"""

ORACLE["snk06_bands"] = f"""{_MATCH}
SELECT 'case0' AS case_id, seq, event_us - {WIDE_GAP} AS from_us, event_us + {WIDE_GAP} AS to_us, coincidence FROM mt"""


def p_text(p: str) -> str:
    return f"CASE WHEN {p} IS NULL THEN 'n/a' WHEN {p} < 1e-4 THEN format('{{:.2e}}', {p}) ELSE format('{{:.4f}}', {p}) END"


def num(v: str) -> str:
    return f"CASE WHEN {v} IS NULL THEN 'n/a' WHEN isinf({v}) THEN 'infinite (no counter-examples)' ELSE format('{{:.3f}}', {v}) END"


ORACLE["snk05_statistics"] = f"""{stats(CASE8, WIDTHS)}
SELECT case_id, w AS window_us, hit || '/' || m AS coincidences, format('{{:.1f}}', p0 * 100) || '%' AS baseline,
  CASE WHEN isinf(lift) THEN 'infinitely above' ELSE format('{{:.1f}}', lift) || ' times' END AS lift,
  {num('ratio')} AS rate_ratio, {p_text('binom_p')} AS binomial_p, {p_text('fisher_p')} AS fisher_p,
  {num('fisher.odds')} AS odds_ratio, {p_text('worst_p')} AS weakest_p
FROM tst JOIN (SELECT case_id, w, odds FROM fisher) fisher USING (case_id, w)"""

ORACLE["st08_verdict"] = f"""{stats(CASE8, [W])},
v AS (SELECT *, m < 3 OR ni = 0 AS no_data, hit >= 3 AND worst_p < 0.01 AND coalesce(ratio >= 2, false) AS found,
  CASE worst_p WHEN binom_p THEN 'the binomial test' WHEN perm_p THEN 'the permutation test' WHEN fisher_p THEN 'Fisher''s exact test' ELSE 'no test' END AS weakest,
  coalesce(binom_p < 0.01 OR perm_p < 0.01 OR fisher_p < 0.01, false) AND coalesce(binom_p >= 0.01 OR perm_p >= 0.01 OR fisher_p >= 0.01, false) AS mixed FROM tst),
r AS (SELECT *, CASE WHEN m < 3 THEN ['too few anchor events'] WHEN ni = 0 THEN ['no disruption events']
  WHEN found THEN [hit || ' coincidences', 'every test below 0.01 (weakest p = ' || format('{{:.3g}}', worst_p) || ')', 'rate ratio ' || format('{{:.2f}}', ratio) || 'x']
  ELSE list_filter([
    CASE WHEN hit < 3 THEN 'only ' || hit || ' of ' || m || ' anchors coincided; 3 needed' END,
    CASE WHEN worst_p >= 0.01 THEN weakest || ' gave p = ' || format('{{:.4g}}', worst_p) || ', which does not clear 0.01' END,
    CASE WHEN ratio IS NULL THEN 'no rate ratio could be computed' WHEN ratio < 2 THEN 'rate ratio only ' || format('{{:.2f}}', ratio) || 'x; 2x needed' END,
    CASE WHEN mixed THEN 'the tests disagree: p ranges from ' || format('{{:.3g}}', best_p) || ' to ' || format('{{:.3g}}', worst_p) || ' across 0.01' END
  ], lambda x: x IS NOT NULL) END AS reasons FROM v)
SELECT case_id, CASE WHEN no_data THEN 'INSUFFICIENT DATA' WHEN found THEN 'CORRELATION FOUND' ELSE 'CORRELATION NOT ESTABLISHED' END AS label,
  CASE WHEN m < 3 THEN 'Only ' || m || ' anchor event(s) in the period; 3 needed.' WHEN ni = 0 THEN 'No disruptions in the evidence.'
    WHEN found THEN hit || ' of ' || m || ' anchors coincided with a disruption within +/-30 s; ' || format('{{:.1f}}', expected) || ' expected by chance (every test p <= ' || format('{{:.3g}}', worst_p) || ').'
    ELSE hit || ' of ' || m || ' anchors coincided with a disruption within +/-30 s, not distinguishable from chance (' || format('{{:.1f}}', expected) || ' expected).' END AS headline,
  len(reasons)::BIGINT AS n_reasons, array_to_string(reasons, '; ') AS reasons FROM r"""

ORACLE["snk06_timeline"] = f"""
WITH {ev()}, {inc()}, c AS (SELECT case_id, start_us // 300000000 AS b, count(*) AS n FROM inc GROUP BY 1, 2),
a AS (SELECT case_id, unnest(range(min(b), max(b) + 1)) AS b FROM c GROUP BY case_id)
SELECT case_id, b * 300000000 AS bucket_us, coalesce(n, 0) AS n FROM a LEFT JOIN c USING (case_id, b)"""

_FILES = f"""{SP}, f AS (SELECT user_id AS folder, event_id::VARCHAR AS name, k AS size, k,
  sha256(event_id || '|' || mac || '|' || event_type) AS sha FROM sp)"""

ORACLE["snk07_listing_checksum"] = f"""
WITH {_FILES} SELECT folder, count(*) AS n_files, sha256(string_agg(name || chr(9) || size, chr(10) ORDER BY name || chr(9) || size)) AS sha256
FROM f GROUP BY folder"""

ORACLE["snk08_verify"] = f"""
WITH {_FILES} SELECT name, CASE k % 10 WHEN 0 THEN 'mismatch' WHEN 1 THEN 'missing' ELSE 'verified' END AS status FROM f"""

_FRAMES = f"WITH {ev()}, f AS (SELECT * FROM ev WHERE kind IN ('deauth', 'disassoc'))"
ORACLE["tk02_top_sources"] = f"""{_FRAMES}
SELECT case_id, src_mac, count(*) AS n_frames FROM f GROUP BY 1, 2 ORDER BY n_frames DESC, src_mac LIMIT 10"""

ORACLE["tk03_reasons"] = f"""{_FRAMES}
SELECT case_id, reason_code::BIGINT AS reason_code, {REASON.format('reason_code')} AS meaning, count(*) AS n_frames FROM f GROUP BY 1, 2, 3"""

ORACLE["tk04_first_floods"] = f"""{_FLOOD}, g2 AS (SELECT flood_us, count(*) AS n FROM ff GROUP BY flood_us)
SELECT 'case0' AS case_id, flood_us AS start_us, n AS n_frames,
  (SELECT greatest(count(*) - 40, 0) FROM g2)::BIGINT AS omitted FROM g2 ORDER BY flood_us LIMIT 40"""

_TOPIC = pick("k", *[f"'{t}'" for t in MOTION_TOPICS], "NULL")
_MOTION = f"""{SP}, mo AS (SELECT user_id::VARCHAR AS camera, us AS ts_us, event_id AS seq,
  'ONVIF motion event: ' || {_TOPIC} || ' (source cam)' AS notes FROM sp WHERE k % 8 <> 7 AND event_id % 4 <> 3)"""
ORACLE["str01_motion_filter"] = f"WITH {_MOTION} SELECT * FROM mo"
ORACLE["str02_debounce"] = f"""
WITH RECURSIVE {_MOTION},
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY camera ORDER BY ts_us, seq) AS rn FROM mo),
f AS (SELECT rn, camera, ts_us, seq, ts_us AS kept, true AS keep FROM r WHERE rn = 1
  UNION ALL
  SELECT r.rn, r.camera, r.ts_us, r.seq, CASE WHEN r.ts_us - f.kept >= 21600000000 THEN r.ts_us ELSE f.kept END,
    r.ts_us - f.kept >= 21600000000 FROM f JOIN r ON r.camera = f.camera AND r.rn = f.rn + 1)
SELECT camera, ts_us, seq FROM f WHERE keep"""


_FILE = "event_id // 20000 AS f, row_number() OVER (PARTITION BY event_id // 20000 ORDER BY event_id)"

ORACLE["src06_frame_files"] = f"""
WITH {SP}, r AS (SELECT *, {_FILE} + 2 AS row_no,
  CASE WHEN k % 7 = 0 THEN NULL WHEN k % 3 = 0 THEN 'ff:ff:ff:ff:ff:ff' ELSE mac END AS dst FROM sp)
SELECT f, row_no, us // 1000 * 1000 AS ts_us, CASE WHEN k % 3 = 0 THEN 'deauth' ELSE 'disassoc' END AS kind,
  CASE WHEN k % 5 <> 0 THEN mac END AS src_mac, dst AS dst_mac, CASE WHEN k % 2 = 0 THEN mac END AS bssid,
  CASE WHEN dst LIKE '3c:%' THEN dst END AS client_mac, CASE WHEN k % 4 <> 1 THEN k END::BIGINT AS reason_code,
  (-k)::BIGINT AS signal, NULL::BIGINT AS channel,
  CASE WHEN dst LIKE 'ff:%' THEN 'broadcast deauth - disconnects every client on the BSS'
       WHEN k % 6 = 0 THEN 'ho"me, x' || chr(10) || 'y' ELSE 'home' END AS notes FROM r WHERE k % 3 < 2"""

ORACLE["src08_pass_files"] = f"""
WITH {SP}, r AS (SELECT *, {_FILE} + 2 AS row_no FROM sp)
SELECT f, row_no, CASE WHEN k <> 42 THEN {sec()} END AS ts_us, CASE WHEN k <> 42 AND k % 3 <> 0 THEN 'P' || user_id END AS plate,
  CASE WHEN k <> 42 AND k % 4 <> 0 THEN 'Ford' END AS make, CASE WHEN k <> 42 THEN 'T' END AS model,
  CASE WHEN k <> 42 THEN CASE WHEN k % 5 = 0 THEN 'a, "b"' || chr(10) ELSE '' END || event_type ||
    CASE WHEN k % 2 = 0 THEN ' [clip: c' || k || ']' ELSE '' END END AS notes,
  CASE WHEN k = 42 THEN 'unreadable timestamp' END AS reject FROM r"""

ORACLE["src07_station_files"] = f"""
WITH {SP}, r AS (SELECT *, {_FILE} + 4 AS row_no FROM sp)
SELECT f, row_no, {sec()} AS ts_us, mac AS client_mac, CASE WHEN k % 2 = 0 THEN 'aa:bb:cc:00:00:01' END AS bssid,
  CASE WHEN k % 7 <> 0 THEN -k END::BIGINT AS signal, 'airodump last seen; ' || CASE WHEN k % 3 = 1 THEN 0 ELSE k END || ' frames' ||
  CASE WHEN k % 2 = 0 THEN '; BSSID home' ELSE '' END AS notes FROM r"""

ORACLE["src01_log_files"] = f"""
WITH e AS ({ORACLE["src01_syslog"].replace("WITH sp", "WITH sp", 1)}), r AS (SELECT event_id AS id, {_FILE} + 1 AS row_no FROM events)
SELECT f, row_no, kind, category, subtype, client_mac, notes FROM e JOIN r ON r.id = e.event_id WHERE reject IS NULL"""

ORACLE["snk02_events"] = f"""
WITH {ev(CASE8)} SELECT case_id, seq, ts_us, kind, category, client_mac, strftime(make_timestamp(ts_us), '%Y-%m-%d') AS day FROM ev"""

ORACLE["snk03_incidents"] = f"""
WITH {ev()}, {inc(WIDE_GAP)} SELECT case_id, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS n_events,
  string_agg(DISTINCT kind, ', ' ORDER BY kind) AS kinds FROM num GROUP BY case_id, isl"""

ORACLE["snk06_points"] = f"""
WITH {ev()}, r AS (SELECT case_id, kind, seq, ts_us, row_number() OVER (PARTITION BY case_id, kind ORDER BY md5(case_id || '|' || seq), seq) AS place
  FROM ev WHERE kind IN ('camera', 'deauth', 'disassoc', 'client_drop', 'link_reset', 'alert'))
SELECT case_id, kind, seq, ts_us FROM r WHERE place <= 500"""

ORACLE["src10_packets"] = f"""
WITH {SP}, r AS (SELECT *, event_id // 1500 AS f, row_number() OVER (PARTITION BY event_id // 1500 ORDER BY event_id) AS packet_no FROM sp),
c AS (SELECT f, count(*) AS n FROM r GROUP BY f)
SELECT f, packet_no, us AS ts_us, CASE user_id % 3 WHEN 0 THEN 'deauth' ELSE 'disassoc' END AS kind, 'de:ad:be:ef:00:01' AS src_mac,
  CASE WHEN k % 3 = 0 THEN 'ff:ff:ff:ff:ff:ff' ELSE mac END AS dst_mac, CASE WHEN k % 5 <> 0 THEN k END::BIGINT AS reason_code,
  (-k - 1)::BIGINT AS signal, NULL::VARCHAR AS reject FROM r WHERE user_id % 3 < 2
UNION ALL SELECT f, n, NULL, NULL, NULL, NULL, NULL, NULL, '400 bytes could not be read as packets' FROM c WHERE f % 4 > 1"""

ORACLE["fn13_year"] = f"""
WITH {SP}, r AS (SELECT event_id, ts, us + (k - 20) * 86400000000 AS ref FROM sp),
w AS (SELECT event_id, ref, make_timestamp(year(make_timestamp(ref)), month(ts), day(ts), hour(ts), minute(ts), floor(second(ts))::DOUBLE) AS wall FROM r)
SELECT event_id, epoch_us(CASE WHEN epoch_us(wall) > ref + 86400000000 THEN wall - INTERVAL 1 YEAR ELSE wall END) AS ts_us FROM w"""

ORACLE["snk04_fields"] = f"""{stats("'case0'", [W])},
{_FLOODS},
fd AS (SELECT flood_us, count(*) AS n FROM ff GROUP BY flood_us),
fs AS (SELECT flood_us, src_mac, row_number() OVER (PARTITION BY flood_us ORDER BY count(*) DESC, src_mac) AS rk FROM ff GROUP BY flood_us, src_mac),
fo AS (SELECT *, row_number() OVER (ORDER BY flood_us) AS place FROM fd JOIN fs USING (flood_us) WHERE rk = 1),
pl AS (SELECT source_file AS s, count(*) AS n, count(*) FILTER (plate IS NULL) AS bare FROM cam GROUP BY 1)
SELECT case_id, CASE WHEN m < 3 OR ni = 0 THEN 'INSUFFICIENT DATA' WHEN hit >= 3 AND worst_p < 0.01 AND coalesce(ratio >= 2, false)
    THEN 'CORRELATION FOUND' ELSE 'CORRELATION NOT ESTABLISHED' END AS label,
  m AS n_anchors, ni AS n_incidents, hit AS n_coincident, round(log10(binom_p), 5) AS log10_binom,
  '{",".join(map(str, WIDTHS))}' AS widths,
  (SELECT count(*) FROM ev WHERE kind IN ('deauth', 'disassoc')) AS total_frames,
  (SELECT count(*) FROM ev WHERE kind IN ('deauth', 'disassoc') AND dst_mac = 'ff:ff:ff:ff:ff:ff') AS broadcast_frames,
  (SELECT count(*) FROM ev WHERE kind IN ('deauth', 'disassoc') AND reason_code IN (1, 7)) AS signature_frames,
  (SELECT count(*) FROM fd) AS n_floods,
  coalesce((SELECT string_agg(n || ':' || src_mac, ',' ORDER BY flood_us) FROM fo WHERE place <= 40), '') AS first_floods,
  round(span / 3.6e9, 6) AS hours, 0::BIGINT AS removed,
  (SELECT count(*) FROM pl) AS n,
  (SELECT string_agg(s || ':' || n || ':' || sha256(s || ':' || n), ',' ORDER BY s) FROM pl) AS inputs,
  'incidents:' || (SELECT count(*) FROM inc) AS outputs,
  (SELECT string_agg(s || ':no plate:' || bare, ',' ORDER BY s) FROM pl WHERE bare > 0) AS warnings,
  1800.0::DOUBLE AS flood_window_s
FROM tst"""
