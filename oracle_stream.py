"""SQL of the streaming queries: the batch rules, as far as the last watermark reaches."""

from __future__ import annotations

from coincide.plans.queries import FLOOD_K, FLOOD_WINDOW, WIDE_GAP
from coincide.plans.stream_queries import DELAY, SLIDE, SLOT
from oracle import ORACLE


def mark(source: str) -> str:
    """The last watermark over the rows of a table: whole milliseconds."""
    return f"(SELECT (max(ts_us) // 1000 - {DELAY // 1000}) * 1000 FROM {source})"


_INCIDENTS = ORACLE["dv02_incidents"]
ORACLE["stx1_incidents"] = f"""
SELECT * FROM ({_INCIDENTS}) WHERE end_us + {WIDE_GAP} <= (SELECT (max(end_us) // 1000 - {DELAY // 1000}) * 1000 FROM ({_INCIDENTS}))"""

_LENGTH = FLOOD_WINDOW + SLIDE
ORACLE["stx2_alerts"] = f"""
{ORACLE['agg03_frame_tallies'].split(', f AS')[0]},
f AS (SELECT * FROM ev WHERE kind IN ('deauth', 'disassoc')),
w AS (SELECT case_id, unnest(range((ts_us - {_LENGTH}) // {SLIDE} + 1, ts_us // {SLIDE} + 1)) * {SLIDE} AS start_us FROM f)
SELECT case_id, start_us, start_us + {_LENGTH} AS end_us, count(*) AS n_frames FROM w GROUP BY case_id, start_us
HAVING count(*) >= {FLOOD_K} AND start_us + {_LENGTH} <= {mark('f')}"""

ORACLE["str02_ordered"] = ORACLE["str02_debounce"].replace(
    "WHERE keep", f"WHERE keep AND (ts_us // {SLOT} + 1) * {SLOT} <= {mark('mo')}")
