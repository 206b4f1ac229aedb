"""Thresholds and tables of the address and route rules."""

from __future__ import annotations

from dataclasses import dataclass

# They must be as they are for results to be right.
EARTH_KM = 6371.0
EARTH_M = 6_371_000.0
DUPLICATE_KM = 0.15
OUTLIER_HOUSES = 4
OUTLIER_KM = 0.25
OUTLIER_FACTOR = 5.0
NEIGHBOUR_KM = 15.0
NEIGHBOUR_RATIO = 0.6
NEIGHBOURS = 3
SWEEPS = 5
PRIORITY_TOLERANCE = 0.15
GROUP_FACTOR = 1.12
GROUP_METERS = 2000.0
MAX_JOBS = 48
MAX_OWN_STOPS = 100
MAX_GROUP_CHARS = 96
AREA_RADIUS_KM = 40.0


@dataclass(frozen=True)
class Area:
    """A search area; none of it applies when the radius is not positive."""

    lat: float
    lng: float
    radius_km: float = AREA_RADIUS_KM
