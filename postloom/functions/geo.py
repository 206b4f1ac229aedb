"""Distances and areas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import EARTH_KM, EARTH_M, Area


def _haversine(lat_a: Column, lng_a: Column, lat_b: Column, lng_b: Column, radius: float) -> Column:
    h = F.pow(F.sin((F.radians(lat_b) - F.radians(lat_a)) / 2), 2) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(F.sin((F.radians(lng_b) - F.radians(lng_a)) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(h))


def haversine_km(lat_a: Column, lng_a: Column, lat_b: Column, lng_b: Column) -> Column:
    return _haversine(lat_a, lng_a, lat_b, lng_b, EARTH_KM)


def haversine_m(lat_a: Column, lng_a: Column, lat_b: Column, lng_b: Column) -> Column:
    return _haversine(lat_a, lng_a, lat_b, lng_b, EARTH_M)


def has_coords(lat: Column, lng: Column) -> Column:
    return lat.isNotNull() & lng.isNotNull() & ~F.isnan(lat) & ~F.isnan(lng)


def within_area(lat: Column, lng: Column, area: Area | None) -> Column:
    """Inside the box around the area's centre; always, without an area or without coordinates."""
    if area is None or area.radius_km <= 0:
        return F.lit(True)
    d_lat = area.radius_km / 111
    d_lng = F.lit(area.radius_km) / (F.lit(111.0) * F.greatest(F.lit(0.2).cast("double"), F.cos(F.radians(F.lit(area.lat)))))
    inside = (F.abs(lat - F.lit(area.lat)) <= F.lit(d_lat)) & (F.abs(lng - F.lit(area.lng)) <= d_lng)
    return ~has_coords(lat, lng) | inside
