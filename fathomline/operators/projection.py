"""Geographic coordinates (EPSG:4326) to the national grid of Hong Kong (EPSG:2326) and back, in closed form.

A seven-parameter shift between the ellipsoids' Cartesian coordinates, and a transverse Mercator series that is exact
to well under a millimetre in the territory. Steps are expressions in plain SQL, each on columns made before it, so
that Catalyst evaluates them inside one stage and any SQL engine can check them.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Both ellipsoids (half axis, flattening), the shift from the grid's datum (m, arc seconds, ppm) and the grid.
WGS84 = (6378137.0, 1 / 298.257223563)
INTERNATIONAL_1924 = (6378388.0, 1 / 297.0)
SHIFT = (-162.619, -276.959, -161.764, 0.067753, -2.24365, -1.15883, -1.09425)
LATITUDE_0, LONGITUDE_0, EASTING_0, NORTHING_0 = 22 + 18 / 60 + 43.68 / 3600, 114 + 10 / 60 + 42.80 / 3600, 836694.05, 819069.80

Steps = list[tuple[str, str]]


def _square(ellipsoid: tuple[float, float]) -> float:
    """First eccentricity squared."""
    return ellipsoid[1] * (2 - ellipsoid[1])


def _cartesian(ellipsoid: tuple[float, float], phi: str, lam: str, out: str) -> Steps:
    a, e2 = ellipsoid[0], _square(ellipsoid)
    nu = f"({a!r} / sqrt(1 - {e2!r} * sin({phi}) * sin({phi})))"
    return [(f"{out}_x", f"{nu} * cos({phi}) * cos({lam})"), (f"{out}_y", f"{nu} * cos({phi}) * sin({lam})"), (f"{out}_z", f"{nu} * {1 - e2!r} * sin({phi})")]


def _geographic(ellipsoid: tuple[float, float], c: str, phi: str, lam: str) -> Steps:
    """Latitude by one step from the parametric latitude, exact to 1e-11 radians on the ground."""
    a, e2 = ellipsoid[0], _square(ellipsoid)
    b = a * (1 - ellipsoid[1])
    second = e2 / (1 - e2)
    return [
        (f"{c}_p", f"sqrt({c}_x * {c}_x + {c}_y * {c}_y)"),
        (f"{c}_t", f"atan2({c}_z * {a!r}, {c}_p * {b!r})"),
        (phi, f"atan2({c}_z + {second * b!r} * pow(sin({c}_t), 3), {c}_p - {e2 * a!r} * pow(cos({c}_t), 3))"),
        (lam, f"atan2({c}_y, {c}_x)"),
    ]


def _shifted(source: str, out: str, forward: bool) -> Steps:
    """The grid's datum to WGS84, or back by the transposed rotation."""
    tx, ty, tz = SHIFT[:3]
    rx, ry, rz = (math.radians(v / 3600) for v in SHIFT[3:6])
    scale = 1 + SHIFT[6] * 1e-6
    if forward:
        x, y, z = (f"{source}_{c}" for c in "xyz")
        return [(f"{out}_x", f"{tx!r} + {scale!r} * ({x} - {rz!r} * {y} + {ry!r} * {z})"), (f"{out}_y", f"{ty!r} + {scale!r} * ({rz!r} * {x} + {y} - {rx!r} * {z})"), (f"{out}_z", f"{tz!r} + {scale!r} * ({z} - {ry!r} * {x} + {rx!r} * {y})")]
    x, y, z = (f"(({source}_{c} - {t!r}) / {scale!r})" for c, t in zip("xyz", (tx, ty, tz)))
    return [(f"{out}_x", f"{x} + {rz!r} * {y} - {ry!r} * {z}"), (f"{out}_y", f"{y} - {rz!r} * {x} + {rx!r} * {z}"), (f"{out}_z", f"{z} + {ry!r} * {x} - {rx!r} * {y}")]


def _arc(phi: str) -> str:
    """Length of the meridian from the equator."""
    a, e2 = INTERNATIONAL_1924[0], _square(INTERNATIONAL_1924)
    c0, c2, c4, c6 = 1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256, 3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024, 15 * e2**2 / 256 + 45 * e2**3 / 1024, 35 * e2**3 / 3072
    return f"({a!r} * ({c0!r} * {phi} - {c2!r} * sin(2 * {phi}) + {c4!r} * sin(4 * {phi}) - {c6!r} * sin(6 * {phi})))"


def grid_steps(lon: str, lat: str) -> Steps:
    """Columns up to easting and northing, from degrees."""
    a, e2 = INTERNATIONAL_1924[0], _square(INTERNATIONAL_1924)
    second, phi0, lam0 = e2 / (1 - e2), math.radians(LATITUDE_0), math.radians(LONGITUDE_0)
    return [
        ("g_phi", f"radians({lat})"), ("g_lam", f"radians({lon})"), *_cartesian(WGS84, "g_phi", "g_lam", "g_w"), *_shifted("g_w", "g_h", False), *_geographic(INTERNATIONAL_1924, "g_h", "g_f", "g_l"),
        ("g_n", f"{a!r} / sqrt(1 - {e2!r} * sin(g_f) * sin(g_f))"), ("g_tt", "tan(g_f) * tan(g_f)"), ("g_c", f"{second!r} * cos(g_f) * cos(g_f)"), ("g_a", f"(g_l - {lam0!r}) * cos(g_f)"),
        ("easting", f"{EASTING_0!r} + g_n * (g_a + (1 - g_tt + g_c) * pow(g_a, 3) / 6 + (5 - 18 * g_tt + g_tt * g_tt + 72 * g_c - {58 * second!r}) * pow(g_a, 5) / 120)"),
        ("northing", f"{NORTHING_0!r} + {_arc('g_f')} - {_arc(repr(phi0))} + g_n * tan(g_f) * (g_a * g_a / 2 + (5 - g_tt + 9 * g_c + 4 * g_c * g_c) * pow(g_a, 4) / 24 + (61 - 58 * g_tt + g_tt * g_tt + 600 * g_c - {330 * second!r}) * pow(g_a, 6) / 720)"),
    ]


def geographic_steps(easting: str, northing: str) -> Steps:
    """Columns up to longitude and latitude in degrees, from the grid."""
    a, e2 = INTERNATIONAL_1924[0], _square(INTERNATIONAL_1924)
    second, phi0, lam0 = e2 / (1 - e2), math.radians(LATITUDE_0), math.radians(LONGITUDE_0)
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    whole = a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256)
    return [
        ("b_mu", f"({northing} - {NORTHING_0!r} + {_arc(repr(phi0))}) / {whole!r}"),
        ("b_f", f"b_mu + {3 * e1 / 2 - 27 * e1**3 / 32!r} * sin(2 * b_mu) + {21 * e1**2 / 16 - 55 * e1**4 / 32!r} * sin(4 * b_mu) + {151 * e1**3 / 96!r} * sin(6 * b_mu) + {1097 * e1**4 / 512!r} * sin(8 * b_mu)"),
        ("b_n", f"{a!r} / sqrt(1 - {e2!r} * sin(b_f) * sin(b_f))"), ("b_r", f"{a * (1 - e2)!r} / pow(1 - {e2!r} * sin(b_f) * sin(b_f), 1.5)"), ("b_tt", "tan(b_f) * tan(b_f)"), ("b_c", f"{second!r} * cos(b_f) * cos(b_f)"),
        ("b_d", f"({easting} - {EASTING_0!r}) / b_n"),
        ("b_phi", f"b_f - b_n * tan(b_f) / b_r * (b_d * b_d / 2 - (5 + 3 * b_tt + 10 * b_c - 4 * b_c * b_c - {9 * second!r}) * pow(b_d, 4) / 24 + (61 + 90 * b_tt + 298 * b_c + 45 * b_tt * b_tt - {252 * second!r} - 3 * b_c * b_c) * pow(b_d, 6) / 720)"),
        ("b_lam", f"{lam0!r} + (b_d - (1 + 2 * b_tt + b_c) * pow(b_d, 3) / 6 + (5 - 2 * b_c + 28 * b_tt - 3 * b_c * b_c + {8 * second!r} + 24 * b_tt * b_tt) * pow(b_d, 5) / 120) / cos(b_f)"),
        *_cartesian(INTERNATIONAL_1924, "b_phi", "b_lam", "b_h"), *_shifted("b_h", "b_w", True), *_geographic(WGS84, "b_w", "b_p", "b_l"), ("longitude", "degrees(b_l)"), ("latitude", "degrees(b_p)"),
    ]


def _with(df: DataFrame, steps: Steps, keep: tuple[str, str]) -> DataFrame:
    columns = df.columns
    for name, expression in steps:
        df = df.withColumn(name, F.expr(expression))
    return df.select(*columns, *keep)


def to_grid(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """df with easting and northing."""
    return _with(df, grid_steps(lon, lat), ("easting", "northing"))


def from_grid(df: DataFrame, easting: str, northing: str) -> DataFrame:
    """df with longitude and latitude."""
    return _with(df, geographic_steps(easting, northing), ("longitude", "latitude"))


def steps_sql(source: str, steps: Steps) -> str:
    """The steps as nested selects over a table expression."""
    for name, expression in steps:
        source = f"(SELECT *, {expression} AS {name} FROM {source})"
    return source
