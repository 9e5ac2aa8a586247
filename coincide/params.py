"""EX03: analysis parameters, their checks and their JSON form."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

MICROS = 1_000_000

# Widths of the sensitivity sweep and limits of the verdict.
SENSITIVITY_WINDOWS_S = (10.0, 15.0, 30.0, 60.0, 120.0)
MIN_COINCIDENCES = 3
MIN_RATE_RATIO = 2.0
MAX_LAG_S = 7200


def micros(seconds: float) -> int:
    return round(seconds * MICROS)


@dataclass(frozen=True)
class AnalysisParams:
    timezone: str = "America/New_York"
    log_year: int | None = None
    assume_offset: str = ""
    camera_clock_offset_s: float = 0.0
    clip_time_from: str = "auto"
    window_s: float = 30.0
    alpha: float = 0.01
    trials: int = 10_000
    sensitivity: bool = True
    reassoc_window_s: float = 120.0
    reconnect_window_s: float = 120.0
    incident_gap_s: float = 10.0
    camera_dedupe_s: float = 2.0
    flood_window_s: float = 10.0
    flood_threshold: int = 5
    seed: int = 20260803
    offsets: str = "numpy"

    @property
    def window_us(self) -> int:
        return micros(self.window_s)

    def widths_us(self) -> list[int]:
        """SE03: the sweep widths and the primary width, once each, ascending."""
        return sorted({micros(w) for w in (*SENSITIVITY_WINDOWS_S, self.window_s)})

    def validate(self) -> list[str]:
        checks = [
            (self.window_s > 0, "The coincidence window must be greater than zero."),
            (0 < self.alpha < 1, "The significance threshold must be between 0 and 1."),
            (self.trials >= 100, "At least 100 permutation trials are needed."),
            (self.flood_threshold >= 2, "The flood threshold must be at least 2 frames."),
            (self.incident_gap_s > 0, "The incident gap must be greater than zero."),
            (self.reassoc_window_s > 0, "The re-association window must be greater than zero."),
            (
                self.clip_time_from in ("auto", "filename", "mtime"),
                "Clip times come from auto, filename or mtime.",
            ),
            (self.offsets in ("numpy", "grid"), "Shift offsets are numpy or grid."),
        ]
        return [message for ok, message in checks if not ok]

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)

    @classmethod
    def from_json(cls, text: str) -> AnalysisParams:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in json.loads(text).items() if k in known})
