"""Neighbours on the sphere: cells in bands of latitude, or of space for the nearest, exact to the poles and across the antimeridian."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.operators.blocks import Axes, best_of, first_of_copies, halvings, met
from fathomline.operators.spatial import _finite, _grown, haversine_km
from fathomline.params import GeoParams


def _bands(height: float) -> int:
    return max(1, math.ceil(180 / height))


def _band(lat: Column, height: float) -> Column:
    """Number of the band of latitude from the south pole."""
    return F.least(F.greatest(F.floor((lat + 90) / height), F.lit(0)), F.lit(_bands(height) - 1)).cast("int")


def _cells(band: Column, height: float) -> Column:
    """Cells of a band: as many as fit its widest circle with about the height as width."""
    low, high = band * height - 90, (band + 1) * height - 90
    widest = F.when((low <= 0) & (high >= 0), F.lit(0.0)).otherwise(F.least(F.abs(low), F.abs(high)))
    return F.greatest(F.floor(F.cos(F.radians(widest)) * 360 / height), F.lit(1)).cast("int")


def _wrapped(lon: Column) -> Column:
    """Longitude in [0, 360)."""
    return F.pmod(lon, F.lit(360.0))


def sphere_radius_join(left: DataFrame, right: DataFrame, radius_km: float, lon: str = "lon", lat: str = "lat", rlon: str = "rlon", rlat: str = "rlat", geo: GeoParams = GeoParams()) -> DataFrame:
    """All pairs within a great-circle distance, with it as ``distance`` in km.

    Bands are as high as the radius. The right side keeps its cell; the left one opens, in its own and the two bands beside,
    the cells that the circle around it can reach: half its width in longitude is asin(sin r / cos lat), and the whole band
    where the circle holds a pole. Longitudes may have any turn; latitudes lie in [-90, 90].
    """
    r = math.degrees(min(radius_km / geo.earth_km, math.pi)) * (1 + 1e-9) + 1e-9
    height, top = min(r, 180.0), _bands(min(r, 180.0)) - 1
    reach = F.when(F.abs(F.col(lat)) + r >= 90, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(math.radians(min(r, 90.0)))) / F.cos(F.radians(F.col(lat)))))) + 1e-9)
    own = _band(F.col(lat), height)
    a = left.withColumn("_band", F.explode(F.sequence(F.greatest(own - 1, F.lit(0)), F.least(own + 1, F.lit(top)))))
    n = _cells(F.col("_band"), height)
    first, last = (F.floor((_wrapped(F.col(lon)) + side * reach) * n / 360).cast("int") for side in (-1, 1))
    a = a.withColumn("_cell", F.explode(F.transform(F.sequence(first, F.least(last, first + n - 1)), lambda c: F.pmod(c, n))))
    b = right.withColumn("_band", _band(F.col(rlat), height))
    b = b.withColumn("_cell", F.pmod(F.floor(_wrapped(F.col(rlon)) * _cells(F.col("_band"), height) / 360).cast("int"), _cells(F.col("_band"), height)))
    met = a.join(b, ["_band", "_cell"]).withColumn("distance", haversine_km(F.col(lon), F.col(lat), F.col(rlon), F.col(rlat), geo))
    return met.where(F.col("distance") <= radius_km).drop("_band", "_cell")


def _space(lon: str, lat: str) -> list[Column]:
    """A place on the unit sphere."""
    around = F.cos(F.radians(lat))
    return [around * F.cos(F.radians(lon)), around * F.sin(F.radians(lon)), F.sin(F.radians(lat))]


def _side(radius_km: float, geo: GeoParams) -> float:
    """Side of cells in space that a great circle of this length does not leave by more than one."""
    return 2 * math.sin(min(radius_km / geo.earth_km, math.pi) / 2) * (1 + 1e-9) + 1e-9


def _on_shell(side: float) -> Column:
    """Cells that the sphere meets."""
    low = [F.greatest(F.col(c) * side, -(F.col(c) + 1) * side, F.lit(0.0)) for c in ("_cx", "_cy", "_cz")]
    high = [F.greatest(F.abs(F.col(c) * side), F.abs((F.col(c) + 1) * side)) for c in ("_cx", "_cy", "_cz")]
    return (sum(c * c for c in low) <= 1 + 1e-9) & (sum(c * c for c in high) >= 1 - 1e-9)


def _one_pole(lon: str, lat: str) -> Column:
    """The longitude, 0 at a pole."""
    return F.when(F.abs(F.col(lat)) == 90, F.lit(0.0)).otherwise(F.col(lon))


def sphere_nearest_join(
    left: DataFrame, right: DataFrame, key: str, right_key: str, k: int, start_km: float, lon: str = "lon", lat: str = "lat", rlon: str = "rlon", rlat: str = "rlat", geo: GeoParams = GeoParams()
) -> DataFrame:
    """k nearest right rows of each left row by great-circle distance (km), with place; ties by right key.

    The radius doubles for rows that still lack k, up to half the circumference, where every point is met. Rows without
    finite coordinates have no neighbours and are none. Blocks of cells in space meet and keep the k nearest, so no row is
    written for each pair; the first radius is halved where rows are dense, and of right rows that agree in all but their
    key (at a pole with any longitude) only the first k are met.
    """
    from fathomline.session import discard, materialize

    left, right = left.where(_finite(lon) & _finite(lat)), right.where(_finite(rlon) & _finite(rlat))
    # At a pole places of all longitudes are one: their distance is 0, not what rounding makes of it.
    left, right = left.withColumn("_lon", _one_pole(lon, lat)), right.withColumn("_rlon", _one_pole(rlon, rlat))
    few = materialize(first_of_copies(right, right_key, k, [F.col(c) for c in right.columns if c not in (right_key, rlon)]), "right")
    axes: Axes = list(zip(_space("_lon", lat), _space("_rlon", rlat)))
    first = lambda todo: start_km / 2 ** halvings(todo, few, _side(start_km, geo), axes)

    def distance(own: dict, its: dict) -> np.ndarray:
        a, b, c, d = np.radians(own["_lon"]), np.radians(own[lat]), np.radians(its["_rlon"]), np.radians(its[rlat])
        h = np.sin((d - b) / 2) ** 2 + np.cos(b) * np.cos(d) * np.sin((c - a) / 2) ** 2
        return 2 * geo.earth_km * np.arcsin(np.sqrt(np.minimum(h, 1.0)))

    def within(todo: DataFrame, radius: float) -> DataFrame:
        side = _side(radius, geo)
        return best_of(met(todo, few, side, axes, _on_shell(side)), todo, few, key, right_key, radius, k, distance)

    done = _grown(left, few, [key], right_key, k, first, within)
    discard(few)
    return done.drop("_lon", "_rlon")
