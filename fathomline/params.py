"""Thresholds of the operators; a revised design is another instance."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class TextParams:
    sequence_weight: float = 0.65
    jaccard_weight: float = 0.35
    high: tuple[float, float] = (0.90, 0.85)
    medium: tuple[tuple[float, float], ...] = ((0.90, 0.60), (0.70, 0.75), (0.50, 0.90))
    reversed_at: float = 0.85
    reversed_margin: float = 0.10


@dataclass(frozen=True)
class LinkParams:
    radius_m: float = 200.0
    top: int = 8
    distance_scale_m: float = 60.0
    distance_weight: float = 0.55
    name_weight: float = 0.45
    ambiguous_gap: float = 0.05


@dataclass(frozen=True)
class GateParams:
    skill_percent: float = 5.0
    increment_percent: float = 2.0
    bias_percent: float = 10.0
    subgroup_bias_percent: float = 15.0
    min_fold_wins: int = 3
    min_transitions: int = 2


@dataclass(frozen=True)
class DetectorParams:
    expected_snapshots: int = 60
    year_share: float = 0.90
    detector_share: float = 0.80
    min_months: int = 8
    strata: int = 6
    offset_minutes: int = 15


@dataclass(frozen=True)
class GeoParams:
    """Local plane: metres per degree and reference point."""

    metres_per_lon: float = 111_320.0
    metres_per_lat: float = 110_540.0
    lat0: float = 22.35
    lon0: float = 114.15
    earth_km: float = 6371.0


PREDICTION_FLOOR = 1.0
SEED = 42
