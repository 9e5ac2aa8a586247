"""The registered queries again, as SQL for DuckDB."""

from __future__ import annotations

from coincide.plans.queries import (
    FLOOD_K,
    FLOOD_WINDOW,
    GAP,
    PARAMS,
    PASS_WINDOW,
    SIX_HOURS,
    WIDE_GAP,
    WIDTHS,
)

W = PARAMS.window_us
ORACLE: dict[str, str] = {}


_HEX = "printf('%010x', user_id)"
MAC = "'3c' || " + " || ".join(f"':' || substr({_HEX}, {i}, 2)" for i in range(1, 11, 2))


def ev(case: str = "'case0'", view: str = "context") -> str:
    return f"""
ev AS (
  SELECT {case} AS case_id, event_id AS seq, epoch_us(ts) AS ts_us, user_id, event_type,
    k, CASE event_type WHEN 'purchase' THEN 'camera'
         WHEN 'error' THEN CASE WHEN k % 2 = 0 THEN 'deauth' ELSE 'disassoc' END
         WHEN 'view' THEN '{view}' ELSE 'assoc' END AS kind,
    CASE WHEN event_type = 'purchase' THEN 'camera'
         WHEN event_type = 'error' OR (event_type = 'view' AND '{view}' = 'link_reset')
         THEN 'disruption' ELSE 'context' END AS category,
    CASE event_type WHEN 'signup' THEN 'DISCOVER' WHEN 'click' THEN 'ACK' END AS subtype,
    CASE WHEN event_type = 'error'
         THEN 'aa:bb:cc:00:00:' || printf('%02x', user_id % 16) END AS src_mac,
    CASE WHEN event_type = 'error' THEN
      CASE WHEN k % 3 = 0 THEN 'ff:ff:ff:ff:ff:ff' ELSE mac END END AS dst_mac,
    CASE WHEN event_type = 'error' AND k % 3 = 0 THEN NULL ELSE mac END AS client_mac,
    CASE WHEN event_type = 'error' THEN k % 10 END AS reason_code,
    CASE WHEN event_type = 'purchase' THEN 'src' || (k % 3) END AS source_file,
    CASE WHEN event_type = 'purchase' AND k % 2 = 0 THEN 'P' || user_id END AS plate,
    'events' AS source_kind
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
          {MAC} AS mac
        FROM events))"""


CASE8 = "'case' || (user_id % 8)"
CASE_EACH = "'case' || user_id"


def inc(gap: int = GAP) -> str:
    return f"""
dis AS (SELECT *, lag(ts_us) OVER (PARTITION BY case_id ORDER BY ts_us, seq) AS p
        FROM ev WHERE category = 'disruption'),
num AS (SELECT *, sum(CASE WHEN p IS NULL OR ts_us - p > {gap} THEN 1 ELSE 0 END)
          OVER (PARTITION BY case_id ORDER BY ts_us, seq) AS isl FROM dis),
inc AS (SELECT case_id, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS n_events
        FROM num GROUP BY case_id, isl),
cam AS (SELECT * FROM ev WHERE category = 'camera')"""


PERIOD = f"""
sp AS (SELECT case_id, min(ts_us) FILTER (s = 0) AS a_lo, max(ts_us) FILTER (s = 0) AS a_hi,
         min(ts_us) FILTER (s = 1) AS i_lo, max(ts_us) FILTER (s = 1) AS i_hi
       FROM (SELECT case_id, ts_us, 0 AS s FROM cam UNION ALL
             SELECT case_id, start_us, 1 FROM inc) GROUP BY case_id),
per AS (SELECT *, a_lo IS NOT NULL AND i_lo IS NOT NULL AS two,
          CASE WHEN a_lo IS NOT NULL AND i_lo IS NOT NULL THEN greatest(a_lo, i_lo)
               ELSE coalesce(a_lo, i_lo) END - {W} AS lo,
          CASE WHEN a_lo IS NOT NULL AND i_lo IS NOT NULL THEN least(a_hi, i_hi)
               ELSE coalesce(a_hi, i_hi) END + {W} AS hi FROM sp),
pa AS (SELECT case_id, ts_us AS t, lo, hi FROM cam JOIN per USING (case_id)
       WHERE ts_us BETWEEN lo AND hi),
pi AS (SELECT case_id, start_us AS t, lo, hi FROM inc JOIN per USING (case_id)
       WHERE start_us BETWEEN lo AND hi)"""


def widths(ws: list[int]) -> str:
    return "wd AS (SELECT unnest([" + ", ".join(map(str, ws)) + "])::BIGINT AS w)"


def islands(src: str, out: str) -> str:
    """Merged intervals of +/- w around the points of ``src``, clipped to the period."""
    return f"""
{out}0 AS (SELECT case_id, w, t, lo, hi, lag(t) OVER (PARTITION BY case_id, w ORDER BY t) AS p
          FROM {src} CROSS JOIN wd),
{out}1 AS (SELECT *, sum(CASE WHEN p IS NULL OR t - p > 2 * w THEN 1 ELSE 0 END)
            OVER (PARTITION BY case_id, w ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM {out}0),
{out} AS (SELECT case_id, w, greatest(min(t) - w, min(lo)) AS f, least(max(t) + w, min(hi)) AS u
          FROM {out}1 GROUP BY case_id, w, g)"""


def hits(a: str, b: str, out: str) -> str:
    """Points of ``a`` with a point of ``b`` within w, by two as-of joins."""
    return f"""
{out}n AS (SELECT a.case_id, a.t, l.t AS bt, r.t AS nx
   FROM {a} a ASOF LEFT JOIN {b} l ON a.case_id = l.case_id AND a.t >= l.t
   ASOF LEFT JOIN {b} r ON a.case_id = r.case_id AND a.t <= r.t),
{out} AS (SELECT case_id, w, count(*) AS n,
    count(*) FILTER (least(coalesce(t - bt, 9e17), coalesce(nx - t, 9e17)) <= w) AS h
   FROM {out}n CROSS JOIN wd GROUP BY case_id, w)"""


def counts(ws: list[int]) -> str:
    return f"""
{widths(ws)},
{islands('pi', 'ui')}, {islands('pa', 'ua')},
{hits('pa', 'pi', 'ha')}, {hits('pi', 'pa', 'hi')},
cov AS (SELECT case_id, w, sum(u - f) AS len FROM ui GROUP BY case_id, w),
exo AS (SELECT case_id, w, sum(u - f) AS len FROM ua GROUP BY case_id, w),
nb AS (SELECT case_id, w, hi - lo AS span,
         greatest(CAST(ceil((hi - lo) / (2.0 * w)) AS BIGINT), 1) AS n_bins FROM per CROSS JOIN wd),
ab AS (SELECT DISTINCT case_id, w, least((t - lo) // (2 * w), n_bins - 1) AS b
       FROM pa JOIN nb USING (case_id)),
ib AS (SELECT DISTINCT case_id, w, least((t - lo) // (2 * w), n_bins - 1) AS b
       FROM pi JOIN nb USING (case_id)),
bins AS (SELECT case_id, w, count(*) FILTER (x AND y) AS a, count(*) FILTER (x AND NOT y) AS b,
           count(*) FILTER (y AND NOT x) AS c
         FROM (SELECT case_id, w, b, bool_or(s = 0) AS x, bool_or(s = 1) AS y
               FROM (SELECT *, 0 AS s FROM ab UNION ALL SELECT *, 1 FROM ib)
               GROUP BY case_id, w, b) GROUP BY case_id, w),
cnt AS (
  SELECT nb.case_id, nb.w, span, n_bins, coalesce(ha.n, 0) AS m, coalesce(hi.n, 0) AS ni,
    coalesce(ha.h, 0) AS hit, coalesce(hi.h, 0) AS inside,
    CAST(coalesce(cov.len, 0) AS BIGINT) AS covered, CAST(coalesce(exo.len, 0) AS BIGINT) AS exposed,
    a, b, c, greatest(n_bins - a - b - c, 0) AS d
  FROM nb JOIN bins USING (case_id, w) LEFT JOIN ha USING (case_id, w)
  LEFT JOIN hi USING (case_id, w) LEFT JOIN cov USING (case_id, w)
  LEFT JOIN exo USING (case_id, w)),
rate AS (
  SELECT *, ni - inside AS outside, CASE WHEN m > 0 THEN hit / m ELSE 0.0 END AS rate,
    least(covered / span, 1.0) AS p0, exposed / 60e6 AS ex, (span - exposed) / 60e6 AS un
  FROM cnt),
rr AS (
  SELECT *, CASE WHEN ex > 0 THEN inside / ex ELSE 0.0 END AS rin,
    CASE WHEN un > 0 THEN outside / un ELSE 0.0 END AS rout FROM rate),
st AS (
  SELECT *, m * p0 AS expected, CASE WHEN p0 > 0 THEN rate / p0 WHEN rate > 0 THEN 'inf'::DOUBLE ELSE 0.0 END AS lift,
    NOT (inside = 0 AND outside = 0) AND rout = 0 AS corrected,
    CASE WHEN inside = 0 AND outside = 0 THEN NULL
      WHEN rout = 0 THEN CASE WHEN un > 0 THEN (CASE WHEN ex > 0 THEN (inside + 0.5) / ex ELSE 0.0 END)
                                / ((outside + 0.5) / un) END
      ELSE rin / rout END AS ratio FROM rr)"""


LF = """
lf AS (SELECT i AS n, lgamma(i + 1.0) AS v FROM range(0, 2000001) t(i))"""

# Tails are summed by enumeration; only the log factorials come from lgamma.
BINOM = """
bt AS (SELECT case_id, w, x, lgamma(m + 1.0) - lgamma(x + 1.0) - lgamma(m - x + 1.0)
         + x * ln(p0) + (m - x) * ln(1 - p0) AS l
       FROM (SELECT case_id, w, m, p0, unnest(range(hit, m + 1)) AS x FROM st
             WHERE hit > 0 AND p0 > 0 AND p0 < 1)),
binom AS (
  SELECT st.case_id, st.w, CASE WHEN m = 0 THEN NULL WHEN hit = 0 OR p0 >= 1 THEN 1.0
      WHEN p0 <= 0 THEN 5e-324 ELSE least(s.p, 1.0) END AS binom_p
  FROM st LEFT JOIN (SELECT case_id, w, sum(exp(l)) AS p FROM bt GROUP BY case_id, w) s
    USING (case_id, w))"""

FISHER = """
ft AS (SELECT case_id, w, lgamma(a + b + 1.0) - lgamma(x + 1.0) - lgamma(a + b - x + 1.0)
         + lgamma(c + d + 1.0) - lgamma(a + c - x + 1.0) - lgamma(c + d - a - c + x + 1.0)
         - lgamma(n + 1.0) + lgamma(a + c + 1.0) + lgamma(n - a - c + 1.0) AS l
       FROM (SELECT *, a + b + c + d AS n, unnest(range(a, least(a + b, a + c) + 1)) AS x FROM st)
       WHERE a + c - x <= c + d),
fisher AS (
  SELECT st.case_id, st.w,
    CASE WHEN least(a + b, c + d, a + c, b + d) = 0 THEN 1.0 ELSE least(s.p, 1.0) END AS fisher_p,
    CASE WHEN least(a + b, c + d, a + c, b + d) = 0 THEN NULL
      WHEN b * c > 0 THEN (a * d) / (b * c) WHEN a * d > 0 THEN 'inf'::DOUBLE END AS odds
  FROM st LEFT JOIN (SELECT case_id, w, sum(exp(l)) AS p FROM ft GROUP BY case_id, w) s
    USING (case_id, w))"""


def shift(trials: int) -> str:
    return f"""
low AS (SELECT case_id, w, lo, hi - lo AS span, CASE WHEN hi - lo > 4 * greatest(4 * w, (hi - lo) // 50)
          THEN greatest(4 * w, (hi - lo) // 50) ELSE 0 END AS low FROM per CROSS JOIN wd),
tr AS (SELECT *, low + CAST((2 * i + 1)::HUGEINT * (span - 2 * low) // {2 * trials} AS BIGINT) AS off
       FROM low CROSS JOIN range(0, {trials}) x(i)),
mv AS (SELECT case_id, w, i, pa.lo + (t - pa.lo + off) % span AS x FROM pa JOIN tr USING (case_id)
       WHERE span > 0),
sc AS (SELECT mv.case_id, mv.w, i, count(*) FILTER (x <= u) AS hits
       FROM mv ASOF LEFT JOIN ui ON mv.case_id = ui.case_id AND mv.w = ui.w AND mv.x >= ui.f
       GROUP BY mv.case_id, mv.w, i),
perm AS (SELECT st.case_id, st.w, CASE WHEN m > 0 AND ni > 0
           THEN (count(*) FILTER (hits >= hit) + 1) / ({trials} + 1.0) END AS perm_p
         FROM st JOIN sc USING (case_id, w) GROUP BY st.case_id, st.w, m, ni)"""


def stats(case: str, ws: list[int], trials: int = PARAMS.trials) -> str:
    return (
        f"WITH {ev(case)}, {inc()}, {PERIOD}, {counts(ws)}, {BINOM}, {FISHER}, {shift(trials)},"
        """
tst AS (SELECT st.*, binom_p, fisher_p, perm_p,
    coalesce(least(binom_p, perm_p, fisher_p), 1.0) AS best_p,
    coalesce(greatest(binom_p, perm_p, fisher_p), 1.0) AS worst_p
  FROM st JOIN binom USING (case_id, w) JOIN fisher USING (case_id, w)
  LEFT JOIN perm USING (case_id, w))"""
    )


ORACLE["dv02_incidents"] = f"""
WITH {ev(view='link_reset')}, {inc(WIDE_GAP)}
SELECT case_id, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS n_events,
  string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds,
  coalesce(string_agg(DISTINCT src_mac, ',' ORDER BY src_mac), '') AS src_macs,
  coalesce(string_agg(DISTINCT client_mac, ',' ORDER BY client_mac), '') AS client_macs,
  string_agg(DISTINCT source_kind, ',' ORDER BY source_kind) AS sources,
  coalesce(array_to_string(list_sort(list(DISTINCT reason_code) FILTER (reason_code IS NOT NULL)), ','), '') AS reason_codes,
  bool_or(kind IN ('deauth', 'disassoc')) AS has_deauth
FROM num GROUP BY case_id, isl"""

ORACLE["agg02_kinds"] = f"WITH {ev()} SELECT kind, count(*) AS n FROM ev GROUP BY kind"

ORACLE["agg05_period"] = f"""
WITH {ev(CASE8)}, {inc()}, {PERIOD}
SELECT case_id, lo AS lo_us, hi AS hi_us, two AND hi <= lo AS disjoint,
  CASE WHEN two AND hi > lo THEN round((greatest(0, lo - a_lo) + greatest(0, a_hi - hi)) / 3.6e9, 6) END AS discarded_anchor_h,
  CASE WHEN two AND hi > lo THEN round((greatest(0, lo - i_lo) + greatest(0, i_hi - hi)) / 3.6e9, 6) END AS discarded_incident_h
FROM per"""

_ONE = f"WITH {ev()}, {inc()}, {PERIOD}, {counts(WIDTHS)}"
_EIGHT = f"WITH {ev(CASE8)}, {inc()}, {PERIOD}, {counts(WIDTHS)}"

ORACLE["agg06_coverage"] = f"""{_ONE}
SELECT case_id, w AS window_us, span AS span_us, covered AS covered_us, exposed AS exposed_us FROM st"""

ORACLE["agg07_bins2x2"] = f"""{_EIGHT}
SELECT case_id, w AS window_us, n_bins, a AS cell_a, b AS cell_b, c AS cell_c, d AS cell_d FROM st"""

ORACLE["agg08_rates"] = f"""{_ONE}
SELECT case_id, w AS window_us, inside AS incidents_inside, outside AS incidents_outside,
  round(rin, 9) AS rate_in, round(rout, 9) AS rate_out, round(ratio, 9) AS rate_ratio,
  corrected AS rate_ratio_corrected FROM st"""

ORACLE["st01_baseline"] = f"""
WITH {ev(CASE8)}, {inc()}, {PERIOD}, {counts([W])}
SELECT case_id, m AS n_anchors, hit AS n_coincident, round(rate, 9) AS rate, round(p0, 9) AS baseline,
  round(expected, 6) AS expected, round(lift, 6) AS lift FROM st"""

ORACLE["st02_binomial"] = f"""{_EIGHT}, {BINOM}
SELECT case_id, w AS window_us, round(log10(binom_p), 5) AS log10_p FROM binom"""

ORACLE["st04_fisher"] = f"""{_EIGHT}, {FISHER}
SELECT case_id, w AS window_us, round(log10(fisher_p), 5) AS log10_p, round(odds, 6) AS odds_ratio FROM fisher"""

ORACLE["st05_chi2"] = f"""{_EIGHT}
SELECT case_id, w AS window_us, CASE WHEN (a + b) * (c + d) * (a + c) * (b + d) > 0 THEN
  round(greatest(abs(a * d - b * c) - (a + b + c + d) / 2.0, 0) ** 2 * (a + b + c + d)
    / ((a + b)::DOUBLE * (c + d) * (a + c) * (b + d)), 6) END AS chi2 FROM st"""

# The tail of chi-square with one degree of freedom is erfc(z), z = sqrt(chi2 / 2): a power series
# for small z, a continued fraction (from its far end) for the others.
ORACLE["st05_chi2_p"] = f"""{ORACLE["st05_chi2"].replace("SELECT case_id, w AS window_us, CASE WHEN (a + b)", ", x AS (SELECT case_id, w AS window_us, CASE WHEN (a + b)").replace("round(greatest(", "(greatest(").replace("(b + d)), 6) END", "(b + d))) END")}),
z AS (SELECT case_id, window_us, sqrt(chi2 / 2) AS z FROM x),
t AS (SELECT *, list_sum(list_transform(range(0, 70), lambda n: CASE n % 2 WHEN 0 THEN 1 ELSE -1 END * z ** (2 * n + 1) / (gamma(n + 1.0) * (2 * n + 1)))) AS s,
  list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(0, 80), lambda n: (80 - n)::DOUBLE)), lambda acc, k: 1 + k / (2 * z * z) / acc) AS f FROM z)
SELECT case_id, window_us, round(log10(CASE WHEN z < 2 THEN 1 - 2 / sqrt(pi()) * s ELSE exp(-z * z) / (z * sqrt(pi()) * f) END), 5) AS log10_p FROM t"""

ORACLE["st03_shift_grid"] = f"""
WITH {ev()}, {inc()}, {PERIOD}, {counts([W])}, {shift(PARAMS.trials)}
SELECT case_id, w AS window_us, i AS trial, hits FROM sc"""

ORACLE["st07_combined"] = f"""{stats(CASE8, [W])}
SELECT case_id, round(log10(best_p), 5) AS log10_best, round(log10(worst_p), 5) AS log10_worst,
  CASE worst_p WHEN binom_p THEN 'the binomial test' WHEN perm_p THEN 'the permutation test'
    WHEN fisher_p THEN 'Fisher''s exact test' ELSE 'no test' END AS weakest_test,
  coalesce(binom_p < 0.01 OR perm_p < 0.01 OR fisher_p < 0.01, false)
    AND coalesce(binom_p >= 0.01 OR perm_p >= 0.01 OR fisher_p >= 0.01, false) AS straddles
FROM tst"""

ORACLE["st09_sensitivity"] = f"""{stats("'case0'", WIDTHS)}
SELECT case_id, w AS window_us, hit AS n_coincident, m AS n_anchors, round(p0, 9) AS baseline,
  round(ratio, 6) AS rate_ratio, round(log10(binom_p), 5) AS log10_binom,
  round(log10(perm_p), 5) AS log10_perm, round(log10(fisher_p), 5) AS log10_fisher,
  round(log10(worst_p), 5) AS log10_worst FROM tst"""

ORACLE["st12_calibration"] = f"""{stats(CASE_EACH, [W])},
f AS (SELECT CAST(substr(case_id, 5) AS BIGINT) % 4 AS scenario,
        hit >= 3 AND coalesce(ratio >= 2, false) AS gate, worst_p, best_p FROM
        (SELECT per.case_id, coalesce(hit, 0) AS hit, ratio, coalesce(worst_p, 1.0) AS worst_p,
           coalesce(best_p, 1.0) AS best_p FROM per LEFT JOIN tst USING (case_id))),
g AS (SELECT scenario, count(*) AS n, count(*) FILTER (gate AND worst_p < 0.01) AS k,
        count(*) FILTER (gate AND best_p < 0.01) AS k2 FROM f GROUP BY scenario),
h AS (SELECT *, k / n AS p, 1 + 1.96 * 1.96 / n AS s FROM g),
e AS (SELECT *, (p + 1.96 * 1.96 / (2 * n)) / s AS mid,
        (1.96 / s) * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n)) AS half FROM h)
SELECT scenario, n AS cases, k AS flagged_worst, k2 AS flagged_best,
  round(greatest(mid - half, 0), 9) AS ci_low, round(least(mid + half, 1), 9) AS ci_high,
  greatest(mid - half, 0) > 0.01 AS exceeds_alpha FROM e"""

ORACLE["agg13_wilson"] = """
WITH g AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS k
           FROM events GROUP BY user_id),
h AS (SELECT *, k / n AS p, 1 + 1.96 * 1.96 / n AS s FROM g),
e AS (SELECT *, (p + 1.96 * 1.96 / (2 * n)) / s AS mid,
        (1.96 / s) * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n)) AS half FROM h)
SELECT user_id, k, n, round(greatest(mid - half, 0), 9) AS ci_low, round(least(mid + half, 1), 9) AS ci_high
FROM e"""

ORACLE["st10_lag_scan"] = f"""
WITH {ev(CASE8)}, {inc()},
pr AS (SELECT cam.case_id, cam.seq, start_us - cam.ts_us AS d FROM cam JOIN inc
       ON cam.case_id = inc.case_id AND start_us BETWEEN cam.ts_us - {7200000000 + W} AND cam.ts_us + {7200000000 + W}),
cand AS (SELECT DISTINCT case_id, CAST(round_even(d / 1e6, 0) AS BIGINT) AS lag_s FROM pr WHERE abs(d) <= 7200000000),
lg AS (SELECT case_id, seq, unnest(range(CAST(ceil((d - {W}) / 1e6) AS BIGINT),
         CAST(floor((d + {W}) / 1e6) AS BIGINT) + 1)) AS lag_s FROM pr),
h AS (SELECT case_id, lag_s, count(DISTINCT seq) AS hits FROM lg GROUP BY case_id, lag_s),
z AS (SELECT c.case_id, count(*) AS m,
        count(*) FILTER (EXISTS (SELECT 1 FROM inc i WHERE i.case_id = c.case_id
          AND i.start_us BETWEEN c.ts_us - {W} AND c.ts_us + {W})) AS h0
      FROM cam c GROUP BY c.case_id),
b AS (SELECT z.case_id, m, h0, h.lag_s, h.hits, row_number() OVER (PARTITION BY z.case_id ORDER BY h.hits DESC, h.lag_s) AS rk
      FROM z JOIN cand USING (case_id) JOIN h ON h.case_id = z.case_id AND h.lag_s = cand.lag_s),
o AS (SELECT case_id, m AS n_anchors, CASE WHEN hits > h0 THEN lag_s ELSE 0 END AS best_lag_s,
        CASE WHEN hits > h0 THEN hits ELSE h0 END AS best_hits, h0 AS hits_at_zero FROM b WHERE rk = 1),
f AS (SELECT *, n_anchors >= 3 AND abs(best_lag_s) >= 1 AND best_hits >= hits_at_zero + 3
  AND best_hits >= 0.6 * n_anchors AND best_hits >= 2 * greatest(hits_at_zero, 1) AS suspicious, abs(best_lag_s) AS d FROM o)
SELECT * EXCLUDE (d), CASE WHEN suspicious THEN
  'The streams line up if anchor times are taken as ' || d || ' s ' || CASE WHEN best_lag_s > 0 THEN 'later' ELSE 'earlier' END
  || ' than recorded (' || best_hits || ' of ' || n_anchors || ' would coincide, against ' || hits_at_zero || ' as recorded). '
  || CASE WHEN abs(d - 3600) < 90 THEN 'Almost exactly one hour: most likely a timezone or daylight-saving mismatch.'
     WHEN abs(d - 1800) < 60 THEN 'Almost exactly thirty minutes: most likely a half-hour timezone offset on one source.'
     WHEN d % 3600 < 120 OR 3600 - d % 3600 < 120 THEN 'Close to a whole number of hours: most likely a timezone mismatch.'
     ELSE 'One of the clocks is probably wrong by about this much.' END END AS explanation FROM f"""

_NEAR = """
near AS (SELECT c.*, l.t AS bt, r.t AS nx,
    CASE WHEN r.t IS NULL OR c.ts_us - l.t <= r.t - c.ts_us THEN l.t ELSE r.t END AS nearest_us
  FROM cam c ASOF LEFT JOIN o l ON c.case_id = l.case_id AND c.ts_us >= l.t
  ASOF LEFT JOIN o r ON c.case_id = r.case_id AND c.ts_us <= r.t)"""

ORACLE["jn01_nearest_incident"] = f"""
WITH {ev(CASE8)}, {inc()}, o AS (SELECT case_id, start_us AS t FROM inc), {_NEAR}
SELECT case_id, seq, nearest_us, nearest_us - ts_us AS delta_us FROM near"""

ORACLE["jn02_band_count"] = f"""
WITH {ev()}
SELECT c.case_id, c.seq, count(d.seq) AS events_in_window
FROM ev c LEFT JOIN (SELECT * FROM ev WHERE category = 'disruption') d
  ON d.case_id = c.case_id AND d.ts_us BETWEEN c.ts_us - {WIDE_GAP} AND c.ts_us + {WIDE_GAP}
WHERE c.category = 'camera' GROUP BY c.case_id, c.seq"""

ORACLE["jn03_coincidence"] = f"""
WITH {ev()}, {inc()}, o AS (SELECT case_id, ts_us AS t FROM ev WHERE kind IN ('deauth', 'disassoc')), {_NEAR}
SELECT case_id, seq, nearest_us - ts_us AS delta_us FROM near WHERE abs(nearest_us - ts_us) <= {W}"""

ORACLE["jn05_point_in_interval"] = f"""{_EIGHT}
SELECT case_id, w AS window_us, inside AS incidents_inside FROM st"""


def nearest_to(name: str, others: str) -> str:
    return f"""
{name} AS (SELECT c.seq, CASE WHEN r.t IS NULL OR c.ts_us - l.t <= r.t - c.ts_us THEN l.t ELSE r.t END AS t
  FROM cam c ASOF LEFT JOIN {others} l ON c.ts_us >= l.t ASOF LEFT JOIN {others} r ON c.ts_us <= r.t)"""


_MATCH = f"""
WITH {ev(view='link_reset')}, {inc()}, {PERIOD},
ia AS (SELECT case_id, min(ts_us) AS t, string_agg(DISTINCT kind, ', ' ORDER BY kind) AS kinds,
    coalesce(string_agg(DISTINCT src_mac, ', ' ORDER BY src_mac), '') AS src_macs,
    coalesce(string_agg(DISTINCT client_mac, ', ' ORDER BY client_mac), '') AS client_macs
  FROM num GROUP BY case_id, isl),
fr AS (SELECT ts_us AS t, min_by(src_mac, seq) AS src_mac, min_by(reason_code, seq) AS reason_code
       FROM ev WHERE kind IN ('deauth', 'disassoc') GROUP BY ts_us),
dr AS (SELECT DISTINCT ts_us AS t FROM ev WHERE kind = 'link_reset'),
{nearest_to('ni', 'ia')}, {nearest_to('nf', 'fr')}, {nearest_to('nd', 'dr')},
bc AS (SELECT c.seq, count(d.seq) AS n FROM cam c LEFT JOIN dis d
       ON d.ts_us BETWEEN c.ts_us - {WIDE_GAP} AND c.ts_us + {WIDE_GAP} GROUP BY c.seq),
mt AS (
SELECT c.seq, c.ts_us AS event_us, c.plate, coalesce(abs(ni.t - c.ts_us) <= {WIDE_GAP}, false) AS coincidence,
  ia.kinds AS nearest_kind, round((ni.t - c.ts_us) / 1e6, 3) AS delta_s,
  CASE WHEN abs(nf.t - c.ts_us) <= {WIDE_GAP} THEN fr.src_mac
       WHEN abs(ni.t - c.ts_us) <= {WIDE_GAP} THEN ia.src_macs END AS attacker_mac,
  CASE WHEN abs(nf.t - c.ts_us) <= {WIDE_GAP} THEN fr.reason_code END::BIGINT AS reason_code,
  ia.client_macs AS client_mac, round((nf.t - c.ts_us) / 1e6, 3) AS deauth_delta_s,
  round((nd.t - c.ts_us) / 1e6, 3) AS drop_delta_s, bc.n AS events_in_window,
  c.ts_us BETWEEN lo - {WIDE_GAP - W} AND hi + {WIDE_GAP - W} AS in_analysis_period, c.source_file AS camera_source
FROM cam c JOIN ni USING (seq) JOIN nf USING (seq) JOIN nd USING (seq) JOIN bc USING (seq)
  JOIN per ON per.case_id = c.case_id LEFT JOIN ia ON ia.t = ni.t LEFT JOIN fr ON fr.t = nf.t)"""

ORACLE["jn10_match_table"] = f"{_MATCH} SELECT * FROM mt"

ORACLE["agg09_delta_summary"] = f"""{_MATCH}
SELECT count(*) AS n, round(quantile_cont(delta_s, 0.5), 4) AS median_s, min(delta_s) AS min_s,
  max(delta_s) AS max_s FROM mt WHERE coincidence"""

ORACLE["agg09_delta_by_case"] = f"""{_MATCH}
SELECT 'case0' AS case_id, count(*) AS n, round(quantile_cont(delta_s, 0.5), 4) AS median_s, min(delta_s) AS min_s,
  max(delta_s) AS max_s FROM mt WHERE coincidence HAVING count(*) > 0"""

ORACLE["agg02_kind_table"] = f"WITH {ev(CASE8)} SELECT case_id, kind, count(*) AS n FROM ev GROUP BY 1, 2"

ORACLE["dv01_client_drops"] = f"""
WITH {ev(view='link_reset')},
l AS (SELECT *, max(subtype = 'ACK') OVER (PARTITION BY client_mac) AS has_ack FROM ev WHERE kind = 'assoc'),
c AS (SELECT *, CASE WHEN subtype = 'ACK' THEN 1 ELSE 0 END AS conf FROM l),
e AS (SELECT *, sum(conf) OVER w AS epoch, max(CASE WHEN conf = 1 THEN ts_us END) OVER w AS conf_us
      FROM c WINDOW w AS (PARTITION BY client_mac ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, row_number() OVER (PARTITION BY client_mac, epoch ORDER BY ts_us, seq) AS rn
      FROM e WHERE subtype = 'DISCOVER')
SELECT ts_us, client_mac, 'client_drop' AS kind, 'disruption' AS category, 'DISCOVER' AS subtype,
  'events+derived' AS source_kind
FROM d WHERE rn = 1 AND epoch > 0 AND ts_us - conf_us <= {SIX_HOURS}
  AND NOT EXISTS (SELECT 1 FROM ev r WHERE r.kind = 'link_reset' AND r.client_mac = d.client_mac
    AND d.ts_us - r.ts_us BETWEEN 0 AND {SIX_HOURS // 6})"""

_FLOODS = f"""
f AS (SELECT *, count(*) OVER (ORDER BY ts_us RANGE BETWEEN {FLOOD_WINDOW} PRECEDING AND CURRENT ROW) AS cnt
      FROM ev WHERE kind IN ('deauth', 'disassoc')),
g AS (SELECT *, max(CASE WHEN cnt >= {FLOOD_K} THEN 1 ELSE 0 END)
        OVER (ORDER BY ts_us RANGE BETWEEN CURRENT ROW AND {FLOOD_WINDOW} FOLLOWING) AS b FROM f),
h AS (SELECT *, lag(b) OVER (ORDER BY ts_us, seq) AS pb, lag(ts_us) OVER (ORDER BY ts_us, seq) AS pt FROM g),
i AS (SELECT *, sum(CASE WHEN b = 1 AND (pb IS NULL OR pb = 0 OR ts_us - pt > {FLOOD_WINDOW}) THEN 1 ELSE 0 END)
        OVER (ORDER BY ts_us, seq) AS s FROM h),
fl AS (SELECT *, min(ts_us) OVER (PARTITION BY s) AS flood_us, count(*) OVER (PARTITION BY s) AS n
       FROM i WHERE b = 1),
ff AS (SELECT * FROM fl WHERE n >= {FLOOD_K})"""
_FLOOD = f"""
WITH {ev()}, {_FLOODS}"""

ORACLE["dv03_floods"] = f"""{_FLOOD},
tp AS (SELECT flood_us, src_mac, row_number() OVER (PARTITION BY flood_us ORDER BY count(*) DESC, src_mac) AS rk
       FROM ff GROUP BY flood_us, src_mac)
SELECT 'case0' AS case_id, ff.flood_us AS start_us, max(ts_us) AS end_us,
  round((max(ts_us) - ff.flood_us) / 1e6, 6) AS duration_s, count(*) AS n_frames,
  round(max(cnt) * 1e6 / {FLOOD_WINDOW}, 9) AS peak_rate_per_s, min(tp.src_mac) AS top_source,
  count(*) FILTER (dst_mac = 'ff:ff:ff:ff:ff:ff') AS broadcast_frames
FROM ff JOIN tp ON tp.flood_us = ff.flood_us AND rk = 1 GROUP BY ff.flood_us"""


def tallies(src: str, keys: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {keys}, '{what}' AS what, CAST({col} AS VARCHAR) AS value, count(*) AS n_frames "
        f"FROM {src} WHERE {col} IS NOT NULL GROUP BY {keys}, {col}"
        for what, col in (("source", "src_mac"), ("target", "dst_mac"), ("reason", "reason_code"))
    )


ORACLE["agg03_flood_tallies"] = f"{_FLOOD} {tallies('ff', 'case_id, flood_us')}"
ORACLE["agg03_frame_tallies"] = (
    f"WITH {ev()}, f AS (SELECT * FROM ev WHERE kind IN ('deauth', 'disassoc')) {tallies('f', 'case_id')}"
)

ORACLE["agg12_signature_share"] = f"""
WITH {ev(CASE8)}
SELECT case_id, count(*) AS total_frames, count(*) FILTER (dst_mac = 'ff:ff:ff:ff:ff:ff') AS broadcast_frames,
  count(*) FILTER (reason_code IN (1, 7)) AS signature_frames,
  coalesce(array_to_string(list_sort(list(DISTINCT reason_code) FILTER (reason_code IN (1, 7))), ','), '') AS signature_codes,
  round(count(*) FILTER (reason_code IN (1, 7)) / count(*), 9) AS signature_share
FROM ev WHERE kind IN ('deauth', 'disassoc') GROUP BY case_id"""

ORACLE["dd01_dedupe"] = f"""
WITH RECURSIVE {ev()},
r AS MATERIALIZED (SELECT row_number() OVER (ORDER BY ts_us, seq) AS rn, ts_us, seq, source_file AS s,
       CASE WHEN plate IS NULL THEN 0 ELSE 1 END AS score, plate FROM ev WHERE category = 'camera'),
f AS (
  SELECT 0::BIGINT AS rn, []::STRUCT(t BIGINT, q BIGINT, src VARCHAR[])[] AS sets, 0::BIGINT AS set_seq
  UNION ALL
  SELECT rn, CASE WHEN pos > 0 THEN list_transform(live, lambda x, i: CASE WHEN i = pos
                    THEN struct_pack(t := x.t, q := x.q, src := list_append(x.src, s)) ELSE x END)
                  ELSE list_append(live, struct_pack(t := ts_us, q := seq, src := [s])) END,
    CASE WHEN pos > 0 THEN live[pos].q ELSE seq END
  FROM (SELECT *, coalesce(list_position(list_transform(live, lambda x: NOT list_contains(x.src, s)), true), 0) AS pos
        FROM (SELECT r.*, list_filter(f.sets, lambda x: r.ts_us - x.t <= {PASS_WINDOW}) AS live
              FROM f JOIN r ON r.rn = f.rn + 1))),
k AS (SELECT r.*, row_number() OVER (PARTITION BY set_seq ORDER BY score DESC, ts_us, seq) AS best
      FROM r JOIN f USING (rn))
SELECT 'case0' AS case_id, seq, ts_us, s AS source_file, plate FROM k WHERE best = 1"""

ORACLE["dd01_summary"] = ORACLE["dd01_dedupe"][: ORACLE["dd01_dedupe"].index("k AS (SELECT")] + """
e AS (SELECT set_seq, count(*) - 1 AS extra FROM f WHERE rn > 0 GROUP BY set_seq)
SELECT 'case0' AS case_id, sum(extra)::BIGINT AS removed, count(*) FILTER (extra > 0) AS merged_sets FROM e"""

ORACLE["dd02_debounce"] = f"""
WITH RECURSIVE {ev()},
r AS MATERIALIZED (SELECT row_number() OVER (PARTITION BY source_file ORDER BY ts_us, seq) AS rn, case_id,
       source_file, ts_us, seq FROM ev WHERE category = 'camera'),
f AS (
  SELECT rn, case_id, source_file, ts_us, seq, ts_us AS kept, true AS keep FROM r WHERE rn = 1
  UNION ALL
  SELECT r.rn, r.case_id, r.source_file, r.ts_us, r.seq,
    CASE WHEN r.ts_us - f.kept >= {WIDE_GAP} THEN r.ts_us ELSE f.kept END, r.ts_us - f.kept >= {WIDE_GAP}
  FROM f JOIN r ON r.source_file = f.source_file AND r.rn = f.rn + 1)
SELECT case_id, source_file, seq, ts_us FROM f WHERE keep"""
