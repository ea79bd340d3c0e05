"""Policies and limits with their defaults (all distances in metres, times in seconds)."""

from __future__ import annotations

from dataclasses import dataclass


def _require(ok: bool, field: str, message: str) -> None:
    if not ok:
        raise InvalidField(field, message)


class InvalidField(ValueError):
    """An input that breaks a rule: ``field`` and ``message``."""

    def __init__(self, field: str, message: str):
        super().__init__(f"{field}: {message}")
        self.field, self.message = field, message


@dataclass(frozen=True)
class DemandPolicy:
    access_m: float = 800.0
    quadratic: bool = False


@dataclass(frozen=True)
class RevenuePolicy:
    capture: float = 1.0
    registered_share: float = 1.0

    def __post_init__(self):
        _require(0 <= self.registered_share <= 1, "registered_share", "must be between 0 and 1")
        _require(self.capture >= 0, "capture", "must not be negative")


@dataclass(frozen=True)
class TravelTimePolicy:
    radii_m: tuple[float, ...] = (100.0, 300.0, 800.0)
    min_routes: int = 3
    max_angle: float = 60.0
    min_kmh: float = 2.0
    max_kmh: float = 80.0

    def __post_init__(self):
        _require(list(self.radii_m) == sorted(self.radii_m) and bool(self.radii_m), "radii_m", "must ascend")


@dataclass(frozen=True)
class DetourPolicy:
    corridor_m: float = 5.0
    forced_m: float = 20.0
    optional_m: float = 500.0
    search_m: float = 1000.0
    retry_margin_m: float = 250.0
    match_m: float = 15.0
    match_angle: float = 45.0
    estimate_m: float = 300.0
    min_samples: int = 3
    max_samples: int = 5
    default_kmh: float = 20.0
    snap_m: float = 50.0
    max_waypoints: int = 25
    reversal_angle: float = 150.0
    crossing_m: float = 30.0
    max_cut_positions: int = 10_000
    max_cut_m: float = 20_000.0

    def __post_init__(self):
        _require(self.forced_m <= self.optional_m, "forced_m", "must not exceed optional_m")


@dataclass(frozen=True)
class GpsPolicy:
    max_age_s: int = 300
    max_skew_s: int = 60
    retention_days: int = 7
    coverage_ratio: float = 0.7


@dataclass(frozen=True)
class BunchingPolicy:
    radius_m: float = 100.0
    max_age_s: float = 300.0
    max_skew_s: float = 60.0
    missing_tolerance: int = 1
    min_observations: int = 2
    min_duration_s: float = 900.0
    min_speed_mps: float = 1.0
    recurrence_days: int = 7
    recurrent_dates: int = 2


@dataclass(frozen=True)
class BottleneckPolicy:
    sector_m: float = 500.0
    max_gap_s: float = 180.0
    max_distance_m: float = 100.0
    max_kmh: float = 100.0
    slow_kmh: float = 6.0
    min_slow: int = 2
    missing_captures: int = 4


@dataclass(frozen=True)
class SimilarityPolicy:
    radius_m: float = 200.0
    min_overlap: float = 0.20
    default_limit: int = 10
    max_limit: int = 50


@dataclass(frozen=True)
class TransferPolicy:
    walk_m: float = 300.0
    access_m: float = 400.0
    max_alternatives: int = 10
    weak_above: float = 5.0
    default_limit: int = 10
    max_limit: int = 50


@dataclass(frozen=True)
class ShapePolicy:
    """Plausibility of the path between two stops."""

    max_edge_m: float = 8000.0
    loop_m: float = 4500.0
    loop_factor: float = 5.0
    adjacent_edge_m: float = 3000.0
    alignment_m: float = 250.0


def clamp_page(limit: int | None, offset: int | None, default: int = 50, most: int = 200) -> tuple[int, int]:
    """A page's limit and offset: default when absent, at most ``most``."""
    _require(limit is None or limit >= 0, "limit", "must not be negative")
    _require(offset is None or offset >= 0, "offset", "must not be negative")
    return min(default if not limit else limit, most), offset or 0
