"""Analysis parameters and their defaults."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class ChangePointSettings:
    min_photons: int = 20
    edge_offset: int = 7
    segment: int = 1000
    overlap: int = 200
    min_trace: int = 200
    confidence: int = 99


@dataclass(frozen=True)
class BurstSettings:
    min_dwell_s: float = 0.001
    use_sigma: bool = True
    sigma: float = 3.0
    absolute_int: float = 5000.0


@dataclass(frozen=True)
class FitSettings:
    use_moving_avg: bool = True
    moving_avg_window: int = 10
    start_percent: float = 80.0
    end_multiple: float = 20.0
    end_percent: float = 1.0
    minimum_decay_window_ns: float = 0.5
    bg_percent: float = 5.0


@dataclass(frozen=True)
class Bound:
    minimum: float | None = None
    maximum: float | None = None


@dataclass(frozen=True)
class LevelFilter:
    photons: Bound = field(default_factory=Bound)
    intensity: Bound = field(default_factory=Bound)
    lifetime: Bound = field(default_factory=Bound)
    chi_squared: Bound = field(default_factory=Bound)
    irf_shift: Bound = field(default_factory=Bound)
    dw_test: str | None = None  # one of "5%", "1%", "0.3%", "0.1%"


@dataclass(frozen=True)
class Settings:
    change_points: ChangePointSettings = field(default_factory=ChangePointSettings)
    bursts: BurstSettings = field(default_factory=BurstSettings)
    fit: FitSettings = field(default_factory=FitSettings)
    open_bin_ms: float = 100.0
    histogram_tmax_ns: float = 25.0
    channel_width_ns: float = 0.01220703125
    g2_window_ns: float = 500.0
    g2_bin_ns: float = 0.5
    quick_roi_min_time_s: float = 5.0
    quick_roi_min_int: float = 400.0

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)

    @staticmethod
    def from_json(text: str) -> "Settings":
        raw = json.loads(text)
        nested = {"change_points": ChangePointSettings, "bursts": BurstSettings, "fit": FitSettings}
        return Settings(**{k: nested[k](**v) if k in nested else v for k, v in raw.items()})
