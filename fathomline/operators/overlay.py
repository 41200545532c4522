"""Overlay of polygons with holes and concave rings: areas of intersection, shares, IoU and validity, by built-in functions, and by Arrow batches for small rings in one row.

A polygon is an array of rings, the outer one first, its holes behind; rows of one unit are its parts. Each edge that is
not vertical stands for the trapezoid between it and a base line. With a sign from its direction and its ring's role, the
trapezoids of a unit add up to 1 inside it and 0 outside, so the area that two units share is the sum over pairs of their
edges of sign x sign x area shared by two trapezoids, which is exact: the lower of two straight lines over a range of x.
Units of one row, few edges and about the size of a cell meet in blocks of cells, where a pair's edges are summed at once,
so that no row is written for a pair of edges. For the rest edges are dealt to vertical strips, and a pair of edges is met
in the strip where its common range begins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.operators.blocks import met, number, pairs_of

#: Shares from which a unit is the same as before, and from which nearly (fixed values).
STABLE, NEAR_STABLE, LEAST_SHARE = 0.95, 0.90, 0.001


def signed_area(points: Column) -> Column:
    """Shoelace area of a ring, positive where it runs counter-clockwise."""
    n = F.size(points)
    # Relative to the first point, so that large coordinates cost no digits.
    ox, oy = F.get(points, 0)["x"], F.get(points, 0)["y"]
    at = lambda i: (F.get(points, i)["x"] - ox, F.get(points, i)["y"] - oy)

    def cross(i: Column) -> Column:
        (ax, ay), (bx, by) = at(i), at((i + 1) % n)
        return ax * by - bx * ay

    return F.when(n >= 3, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda acc, i: acc + cross(i)) / 2).otherwise(0.0)


def edges(polygons: DataFrame, unit: str, rings: str) -> DataFrame:
    """(unit, ring, no, ax, ay, bx, by, sign): all edges of all rings with three points or more and an area."""
    each = polygons.select(F.col(unit).alias("unit"), F.xxhash64(rings).alias("part"), F.posexplode(rings).alias("ring", "points"))
    each = each.withColumn("area", signed_area(F.col("points"))).where("area <> 0")
    # Counter-clockwise outer rings have their inside below edges that run left.
    role = F.when(F.col("ring") == 0, F.signum("area")).otherwise(-F.signum("area"))
    n = F.size("points")
    following = F.concat(F.slice("points", F.lit(2), n - 1), F.slice("points", 1, 1))
    opened = each.select("unit", "part", "ring", "area", role.alias("role"), F.posexplode(F.arrays_zip(F.col("points").alias("a"), following.alias("b"))).alias("no", "e"))
    ax, ay, bx, by = (F.col(f"e.{p}.{c}").cast("double") for p in ("a", "b") for c in ("x", "y"))
    return opened.select("unit", "part", "ring", "no", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"), (F.col("role") * F.signum(ax - bx)).alias("sign"))


def areas(found: DataFrame) -> DataFrame:
    """(unit, area and box) of each unit from its edges."""
    return found.groupBy("unit").agg(
        F.sum(F.col("sign") * F.abs(F.col("bx") - F.col("ax")) * (F.col("ay") + F.col("by")) / 2).alias("area"),
        F.min("ax").alias("x0"), F.min("ay").alias("y0"), F.max("ax").alias("x1"), F.max("ay").alias("y1"),
    )


def _strips(found: DataFrame, width: float) -> DataFrame:
    """Edges that are not vertical, left to right (xl, yl, xr, yr), once for each strip that they meet."""
    swap = F.col("ax") > F.col("bx")
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    flat = found.where("ax <> bx").select("unit", "ring", "no", "sign", pick("ax", "bx").alias("xl"), pick("ay", "by").alias("yl"), pick("bx", "ax").alias("xr"), pick("by", "ay").alias("yr"))
    return flat.withColumn("strip", F.explode(F.sequence(F.floor(F.col("xl") / width), F.floor(F.col("xr") / width))))


def _dealt(boxes: DataFrame, size: float, prefix: str) -> DataFrame:
    cell = lambda c: F.floor(F.col(c) / size)
    first = boxes.withColumn(f"{prefix}x", cell("x0")).withColumn(f"{prefix}y", cell("y0"))
    return first.withColumn("cx", F.explode(F.sequence(F.col(f"{prefix}x"), cell("x1")))).withColumn("cy", F.explode(F.sequence(F.col(f"{prefix}y"), cell("y1"))))


def touching(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """(a, b, area_a, area_b, base) of units whose boxes meet; a pair is met in one cell only."""
    as_ = lambda df, who: df.select(F.col("unit").alias(who), F.col("area").alias(f"area_{who}"), "x0", "y0", "x1", "y1")
    left = _dealt(as_(a, "a"), size, "l")
    right = _dealt(as_(b, "b"), size, "r").withColumnsRenamed({c: f"r{c}" for c in ("x0", "y0", "x1", "y1")})
    met = left.join(right, ["cx", "cy"]).where("cx = greatest(lx, rx) AND cy = greatest(ly, ry) AND x0 < rx1 AND rx0 < x1 AND y0 < ry1 AND ry0 < y1")
    return met.select("a", "b", "area_a", "area_b", F.least("y0", "ry0").alias("base"))


def _lower_area(low: Column, high: Column, pl: Column, pr: Column, ql: Column, qr: Column) -> Column:
    """Area under the lower of two straight lines from low to high, given their heights at both ends."""
    dl, dr = pl - ql, pr - qr
    left, right = F.least(pl, ql), F.least(pr, qr)
    t = F.try_divide(dl, dl - dr)
    middle = pl + t * (pr - pl)
    return (high - low) / 2 * F.when(dl * dr < 0, t * (left + middle) + (1 - t) * (middle + right)).otherwise(left + right)


def _shared(base: Column) -> Column:
    """Area between the base and the lower of two edges (prefixes p, q) over their common range."""
    low, high = F.greatest("pxl", "qxl"), F.least("pxr", "qxr")
    at = lambda e, x: F.col(f"{e}yl") + (F.col(f"{e}yr") - F.col(f"{e}yl")) * ((x - F.col(f"{e}xl")) / (F.col(f"{e}xr") - F.col(f"{e}xl"))) - base
    return _lower_area(low, high, at("p", low), at("p", high), at("q", low), at("q", high))


def overlay(a: DataFrame, b: DataFrame, unit_a: str, unit_b: str, rings_a: str, rings_b: str, cell: float, strip: float | None = None, ordered: bool = False) -> DataFrame:
    """(unit_a, unit_b, area_a, area_b, intersection, share_of_source, share_of_target, iou) of units that share an area.

    ``cell`` is about the size of a unit, ``strip`` (an eighth of it by default) about the length of an edge. Rings with
    fewer than three points or no area, and null polygons, count for nothing. Shared areas below a 10 ** 12th of the
    smaller unit are rounding and left out. ``ordered``: only pairs whose first unit is the smaller one.
    """
    small_a, rest_a = _by_size(a, unit_a, rings_a, 2 * cell)
    small_b, rest_b = _by_size(b, unit_b, rings_b, 2 * cell)
    both = _in_blocks(small_a, small_b, 2 * cell, ordered)
    if not (rest_a.isEmpty() and rest_b.isEmpty()):
        both = both.unionByName(_in_strips(a, b, unit_a, unit_b, rings_a, rings_b, rest_a, rest_b, cell, strip or cell / 8, ordered))
    both = both.where(F.col("intersection") > 1e-12 * F.least("area_a", "area_b"))
    return both.select(
        F.col("a").alias(unit_a), F.col("b").alias(unit_b), "area_a", "area_b", "intersection", F.try_divide("intersection", "area_a").alias("share_of_source"),
        F.try_divide("intersection", "area_b").alias("share_of_target"), F.try_divide("intersection", F.col("area_a") + F.col("area_b") - F.col("intersection")).alias("iou"),
    )


def _in_strips(a: DataFrame, b: DataFrame, unit_a: str, unit_b: str, rings_a: str, rings_b: str, rest_a: DataFrame, rest_b: DataFrame, cell: float, width: float, ordered: bool) -> DataFrame:
    """(a, b, area_a, area_b, intersection) of pairs of which one unit at least is in ``rest_a`` or ``rest_b``."""
    from fathomline.session import materialize

    ea, eb = (materialize(edges(df, u, r), "edges") for df, u, r in ((a, unit_a, rings_a), (b, unit_b, rings_b)))
    of_a, of_b = areas(ea), areas(eb)
    large_b = of_b.join(rest_b, "unit", "left_semi")
    pairs = touching(of_a.join(rest_a, "unit", "left_semi"), of_b, cell).unionByName(touching(of_a.join(rest_a, "unit", "left_anti"), large_b, cell))
    pairs = materialize(pairs.where("a < b") if ordered else pairs, "pairs")
    as_ = lambda e, who, p: _strips(e, width).select(F.col("unit").alias(who), "strip", *[F.col(c).alias(f"{p}{c}") for c in ("xl", "yl", "xr", "yr", "sign")])
    edge_pairs = pairs.select("a", "b", "base").join(as_(ea, "a", "p"), "a").join(as_(eb, "b", "q"), ["b", "strip"])
    edge_pairs = edge_pairs.where((F.greatest("pxl", "qxl") < F.least("pxr", "qxr")) & (F.floor(F.greatest("pxl", "qxl") / width) == F.col("strip")))
    sums = edge_pairs.groupBy("a", "b").agg(F.sum(F.col("psign") * F.col("qsign") * _shared(F.col("base"))).alias("intersection"))
    return pairs.join(sums, ["a", "b"]).select("a", "b", "area_a", "area_b", "intersection")


#: Edges of a unit that is met in blocks, and pairs of edges that are looked at at once.
FEW_EDGES, EDGE_PAIRS = 64, 1 << 18


class Polygons:
    """Edges of polygons with holes as arrays (edge, polygon), as in ``Rings``, with areas and boxes."""

    def __init__(self, polygons: pa.ListArray):
        rings = polygons.flatten()
        points = rings.flatten()
        counts, n = (c.value_lengths().fill_null(0).to_numpy() for c in (polygons, rings))
        of = np.repeat(np.arange(len(polygons)), counts)
        place = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        ring = np.repeat(np.arange(len(n)), n)
        xy = [points.field(points.type.get_field_index(c)) for c in ("x", "y")]
        bare = np.asarray(points.is_null()) | np.asarray(xy[0].is_null()) | np.asarray(xy[1].is_null())
        x, y = (c.fill_null(0.0).to_numpy() for c in xy)
        begin = (np.cumsum(n) - n)[ring]
        following = np.where(np.arange(len(ring)) + 1 < begin + n[ring], np.arange(len(ring)) + 1, begin)
        nx, ny, fx, fy = x[following], y[following], x[begin], y[begin]
        twice = np.bincount(ring, (x - fx) * (ny - fy) - (y - fy) * (nx - fx), minlength=len(n)).astype(float)
        twice[(n < 3) | (np.bincount(ring, bare, minlength=len(n)) > 0)] = 0.0
        role = np.where(place == 0, np.sign(twice), -np.sign(twice))
        held = twice[ring] != 0
        unit, sign = of[ring], role[ring] * np.sign(x - nx)
        self.area = np.bincount(unit[held], (sign * np.abs(nx - x) * (y + ny) / 2)[held], minlength=len(polygons)).astype(float)
        self.x0, self.y0 = np.full(len(polygons), np.inf), np.full(len(polygons), np.inf)
        self.x1, self.y1 = -self.x0, -self.y0
        for side, values, f in ((self.x0, x, np.minimum), (self.y0, y, np.minimum), (self.x1, x, np.maximum), (self.y1, y, np.maximum)):
            f.at(side, unit[held], values[held])
        self.floor = self.y0
        # Rows of the arrays: an edge's number in its polygon.
        on = held & (x != nx)
        unit, swap = unit[on], (x > nx)[on]
        self.edges = np.bincount(unit, minlength=len(polygons))
        no = np.arange(len(unit)) - np.repeat(np.cumsum(self.edges) - self.edges, self.edges)
        shape = (int(self.edges.max(initial=0)), len(polygons))
        for name, values in (("xl", np.where(swap, nx[on], x[on])), ("yl", np.where(swap, ny[on], y[on])), ("xr", np.where(swap, x[on], nx[on])), ("yr", np.where(swap, y[on], ny[on])), ("sign", sign[on])):
            rows = np.zeros(shape)
            rows[no, unit] = values
            setattr(self, name, rows)


def polygon_areas(a: Polygons, b: Polygons, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Areas that the pairs a[at], b[to] share."""
    out = np.zeros(len(at))
    step = max(1, EDGE_PAIRS // max(1, len(a.sign) * len(b.sign)))
    for begin in range(0, len(at), step):
        mine, its = at[begin : begin + step], to[begin : begin + step]
        low, high = np.maximum(a.xl[:, None, mine], b.xl[None, :, its]), np.minimum(a.xr[:, None, mine], b.xr[None, :, its])
        sign = a.sign[:, None, mine] * b.sign[None, :, its]
        i, j, n = np.nonzero((low < high) & (sign != 0))
        low, high, sign, p, q = low[i, j, n], high[i, j, n], sign[i, j, n], mine[n], its[n]
        under = np.minimum(a.floor[p], b.floor[q])

        def heights(e: Polygons, edge: np.ndarray, row: np.ndarray, low=low, high=high, under=under) -> tuple[np.ndarray, np.ndarray]:
            xl, yl = e.xl[edge, row], e.yl[edge, row]
            rise = (e.yr[edge, row] - yl) / (e.xr[edge, row] - xl)
            return yl + rise * (low - xl) - under, yl + rise * (high - xl) - under

        (pl, pr), (ql, qr) = heights(a, i, p), heights(b, j, q)
        dl, dr = pl - ql, pr - qr
        left, right = np.minimum(pl, ql), np.minimum(pr, qr)
        crossed = dl * dr < 0
        t = np.divide(dl, dl - dr, out=np.zeros(len(n)), where=crossed)
        middle = pl + t * (pr - pl)
        out[begin : begin + step] = np.bincount(n, sign * (high - low) / 2 * np.where(crossed, t * (left + middle) + (1 - t) * (middle + right), left + right), minlength=len(mine))
    return np.maximum(out, 0.0)


BOX = ("area", "x0", "y0", "x1", "y1")


def _by_size(polygons: DataFrame, unit: str, rings: str, side: float) -> tuple[DataFrame, DataFrame]:
    """(unit, rings, area, x0, y0, x1, y1) of units of one row, few edges and a box of this side at most, and (unit) of the others (holes alone as well)."""
    from fathomline.session import materialize

    numbers = F.transform(F.col(rings), lambda r: F.transform(r, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))))
    known = polygons.select(F.col(unit).alias("unit"), numbers.alias("rings")).where("unit IS NOT NULL")
    schema = T.StructType([*known.schema.fields, T.StructField("edges", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in BOX)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = Polygons(batch.column(1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.edges), *(pa.array(getattr(found, c)) for c in BOX)], schema.names)

    measured = known.mapInArrow(run, schema).where("edges > 0")
    fits = (F.col("edges") <= FEW_EDGES) & (F.col("x1") - F.col("x0") <= side) & (F.col("y1") - F.col("y0") <= side) & (F.col("area") > 0) & (F.col("area") < F.lit(float("inf")))
    parts = known.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("unit")
    rest = materialize(measured.where(~fits).select("unit").union(parts).distinct(), "rest")
    small = measured.where(fits).drop("edges")
    return (small if rest.isEmpty() else small.join(rest, "unit", "left_anti")), rest


def _in_blocks(a: DataFrame, b: DataFrame, side: float, ordered: bool) -> DataFrame:
    """(a, b, area_a, area_b, intersection) of small units whose boxes meet."""
    left = a.withColumnsRenamed({"unit": "a", "rings": "rings_a"} | {c: f"{c}_a" for c in BOX})
    right = b.withColumnsRenamed({"unit": "b", "rings": "rings_b"} | {c: f"{c}_b" for c in BOX})
    schema = T.StructType([left.schema["a"], right.schema["b"], *(T.StructField(c, T.DoubleType()) for c in ("area_a", "area_b", "intersection"))])

    def pairs(mine: pa.RecordBatch) -> Callable:
        ours = Polygons(mine.column(mine.schema.get_field_index("rings_a")))

        def of(other: pa.RecordBatch) -> list[pa.Array]:
            box = lambda batch, who: [number(batch, f"{c}_{who}") for c in ("x0", "y0", "x1", "y1")]
            (x0, y0, x1, y1), (rx0, ry0, rx1, ry1) = box(mine, "a"), box(other, "b")
            ok = (x0[:, None] < rx1) & (rx0 < x1[:, None]) & (y0[:, None] < ry1) & (ry0 < y1[:, None])
            if ordered:
                ok &= number(mine, "a")[:, None] < number(other, "b")
            at, to = np.nonzero(ok)
            shared = polygon_areas(ours, Polygons(other.column(other.schema.get_field_index("rings_b"))), at, to) if len(at) else np.zeros(0)
            some = shared > 0
            at, to, shared = at[some], to[some], shared[some]
            take = lambda batch, c, rows: batch.column(batch.schema.get_field_index(c)).take(pa.array(rows))
            return [take(mine, "a", at), take(other, "b", to), take(mine, "area_a", at), take(other, "area_b", to), pa.array(shared)]

        return of

    return pairs_of(met(left, right, side, [(F.col("x0_a"), F.col("x0_b")), (F.col("y0_a"), F.col("y0_b"))]), left, right, schema, pairs)


def _parts_of(points: Column) -> Column:
    """A ring's edges that are not vertical as array<struct(xl, yl, xr, yr, s)>."""
    n = F.size(points)
    following = F.concat(F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(points, 1, 1))
    way = F.signum(signed_area(points))

    def part(a: Column, b: Column) -> Column:
        swap = a["x"] > b["x"]
        pick = lambda p, q, c: F.when(swap, q[c]).otherwise(p[c]).cast("double")
        return F.struct(pick(a, b, "x").alias("xl"), pick(a, b, "y").alias("yl"), pick(b, a, "x").alias("xr"), pick(b, a, "y").alias("yr"), (way * F.signum(a["x"] - b["x"])).alias("s"))

    return F.filter(F.zip_with(points, following, part), lambda e: e["xl"] < e["xr"])


def ring_overlap(a: Column, b: Column) -> Column:
    """Area shared by two rings, both arrays of struct(x, y), concave or not; null for a null side, 0 where one has no area.

    For small rings that stand in one row; ``overlay`` joins many edges, and ``with_ring_overlap`` is faster for many rows.
    """
    base = F.least(F.array_min(F.transform(a, lambda p: p["y"])), F.array_min(F.transform(b, lambda p: p["y"])))

    def shared(p: Column, q: Column) -> Column:
        low, high = F.greatest(p["xl"], q["xl"]), F.least(p["xr"], q["xr"])
        at = lambda e, x: e["yl"] + (e["yr"] - e["yl"]) * ((x - e["xl"]) / (e["xr"] - e["xl"])) - base
        return F.when(low < high, p["s"] * q["s"] * _lower_area(low, high, at(p, low), at(p, high), at(q, low), at(q, high))).otherwise(0.0)

    sums = F.aggregate(_parts_of(a), F.lit(0.0), lambda acc, p: acc + F.aggregate(_parts_of(b), F.lit(0.0), lambda inner, q: inner + shared(p, q)))
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(F.coalesce(sums, F.lit(0.0)), F.lit(0.0)))


#: Pairs of rings whose areas are computed at once.
RING_PAIRS = 1 << 15


class Rings:
    """Edges of rings as arrays (edge, ring) of xl, yl, xr, yr and sign; missing and vertical edges have sign 0."""

    def __init__(self, rings: pa.ListArray):
        points = rings.flatten()
        n = rings.value_lengths().fill_null(0).to_numpy()
        xy = [points.field(points.type.get_field_index(c)).cast(pa.float64()) for c in ("x", "y")]
        bare = np.asarray(points.is_null()) | np.asarray(xy[0].is_null()) | np.asarray(xy[1].is_null())
        # Rings are filled up with their first points, which adds edges without a length.
        at = np.arange(max(1, int(n.max(initial=0))))[:, None]
        at = np.minimum(np.cumsum(n) - n + np.where(at < n, at, 0), max(len(points) - 1, 0))
        x, y = (np.append(c.fill_null(0.0).to_numpy(), [0.0] * (not len(points)))[at] for c in xy)
        #: Rings of three points or more, with all their coordinates; others share nothing.
        whole = (n >= 3) & ~np.append(bare, [True] * (not len(points)))[at].any(axis=0)
        nx, ny = (np.roll(v, -1, axis=0) for v in (x, y))
        ox, oy, px, py = x - x[0], y - y[0], nx - x[0], ny - y[0]
        swap = x > nx
        self.sign = np.where((x != nx) & whole, np.sign((ox * py - oy * px).sum(axis=0)) * np.sign(x - nx), 0.0)
        self.xl, self.yl, self.xr, self.yr = np.where(swap, nx, x), np.where(swap, ny, y), np.where(swap, x, nx), np.where(swap, y, ny)
        self.floor = y.min(axis=0)


def shared_areas(a: Rings, b: Rings, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """ring_overlap of the pairs a[at], b[to]."""
    out = np.zeros(len(at))
    for begin in range(0, len(at), RING_PAIRS):
        mine, its = at[begin : begin + RING_PAIRS], to[begin : begin + RING_PAIRS]
        base = np.minimum(a.floor[mine], b.floor[its])
        total = out[begin : begin + RING_PAIRS]
        others = [(b.xl[j][its], b.xr[j][its], b.sign[j][its]) for j in range(len(b.sign))]
        for i in range(len(a.sign)):
            pxl, pxr, psign = a.xl[i][mine], a.xr[i][mine], a.sign[i][mine]
            for j, (qxl, qxr, qsign) in enumerate(others):
                low, high, sign = np.maximum(pxl, qxl), np.minimum(pxr, qxr), psign * qsign
                on = np.flatnonzero((low < high) & (sign != 0))
                low, high, p, q, under = low[on], high[on], mine[on], its[on], base[on]

                def heights(e: Rings, edge: int, row: np.ndarray, low=low, high=high, under=under) -> tuple[np.ndarray, np.ndarray]:
                    xl, yl = e.xl[edge][row], e.yl[edge][row]
                    rise = (e.yr[edge][row] - yl) / (e.xr[edge][row] - xl)
                    return yl + rise * (low - xl) - under, yl + rise * (high - xl) - under

                (pl, pr), (ql, qr) = heights(a, i, p), heights(b, j, q)
                dl, dr = pl - ql, pr - qr
                left, right = np.minimum(pl, ql), np.minimum(pr, qr)
                crossed = dl * dr < 0
                t = np.divide(dl, dl - dr, out=np.zeros(len(on)), where=crossed)
                middle = pl + t * (pr - pl)
                total[on] += sign[on] * (high - low) / 2 * np.where(crossed, t * (left + middle) + (1 - t) * (middle + right), left + right)
    return np.maximum(out, 0.0)


def shared_area(a: str, b: str) -> Callable:
    """For blocks.pairs_within: ring_overlap of column a of a left and column b of a right block."""
    of = lambda batch, c: Rings(batch.column(batch.schema.get_field_index(c)))
    return lambda left: (lambda rings: lambda right, at, to: shared_areas(rings, of(right, b), at, to))(of(left, a))


def with_ring_overlap(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """df with ring_overlap of two of its columns, computed a batch of rows at once."""
    if out in df.columns:
        raise ValueError(f"column {out} would be overwritten")
    kept = df.columns
    ring = lambda c: F.transform(c, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    ready = df.select("*", ring(F.col(a)).alias("_a"), ring(F.col(b)).alias("_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (batch.column(batch.schema.get_field_index(c)) for c in ("_a", "_b"))
            blank = np.asarray(left.is_null()) | np.asarray(right.is_null())
            rows = np.arange(batch.num_rows)
            found = pa.array(shared_areas(Rings(left), Rings(right), rows, rows), pa.float64(), mask=blank)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), found], [*kept, out])

    return ready.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))


def crosswalk(shared: DataFrame, source: str, target: str, least: float = LEAST_SHARE) -> DataFrame:
    """Overlaps of two editions, ranked by area for each source unit, with the best one's status."""
    kept = shared.where(F.greatest("share_of_source", "share_of_target") >= least)
    rank = F.row_number().over(Window.partitionBy(source).orderBy(F.desc("intersection"), target))
    reach = lambda share: (F.col(source) == F.col(target)) & (F.col("share_of_source") >= share) & (F.col("share_of_target") >= share)
    status = F.when(reach(STABLE), "stable_same_code").when(reach(NEAR_STABLE), "near_stable_same_code").otherwise("changed_split_or_reassigned")
    return kept.withColumn("overlap_rank", rank).withColumn("match_status", F.when(F.col("overlap_rank") == 1, status))


def faults(polygons: DataFrame, unit: str, rings: str, strip: float) -> DataFrame:
    """(unit, rings_without_area, crossings, valid) of every unit: edges of a unit that cross each other inside both, or lie on one another.

    Edges are met in strips; vertical ones stand in the strip of their x.
    """
    from fathomline.session import materialize

    none = F.filter(rings, lambda r: F.coalesce(signed_area(r) == 0, F.lit(True)))
    bare = polygons.groupBy(F.col(unit).alias("unit")).agg(F.sum(F.coalesce(F.size(none), F.lit(0))).alias("rings_without_area"), F.max((F.coalesce(F.size(rings), F.lit(0)) > 0).cast("int")).alias("some"))
    found = materialize(edges(polygons, unit, rings).withColumn("id", F.struct("part", "ring", "no")), "edges")
    dealt = found.withColumn("strip", F.explode(F.sequence(F.floor(F.least("ax", "bx") / strip), F.floor(F.greatest("ax", "bx") / strip))))
    as_ = lambda p: dealt.select("unit", "strip", *[F.col(c).alias(f"{p}{c}") for c in ("id", "ax", "ay", "bx", "by")])
    met = as_("p").join(as_("q"), ["unit", "strip"]).where("pid < qid AND least(pax, pbx) <= greatest(qax, qbx) AND least(qax, qbx) <= greatest(pax, pbx) AND least(pay, pby) <= greatest(qay, qby) AND least(qay, qby) <= greatest(pay, pby)")
    side = lambda e, x, y: (F.col(f"{e}bx") - F.col(f"{e}ax")) * (F.col(y) - F.col(f"{e}ay")) - (F.col(f"{e}by") - F.col(f"{e}ay")) * (F.col(x) - F.col(f"{e}ax"))
    across = (side("p", "qax", "qay") * side("p", "qbx", "qby") < 0) & (side("q", "pax", "pay") * side("q", "pbx", "pby") < 0)
    along = (side("p", "qax", "qay") == 0) & (side("p", "qbx", "qby") == 0)
    longer = lambda c: F.least(F.greatest(f"pa{c}", f"pb{c}"), F.greatest(f"qa{c}", f"qb{c}")) > F.greatest(F.least(f"pa{c}", f"pb{c}"), F.least(f"qa{c}", f"qb{c}"))
    bad = met.where(across | (along & (longer("x") | longer("y")))).select("unit", "pid", "qid").distinct().groupBy("unit").agg(F.count(F.lit(1)).alias("crossings"))
    out = bare.join(bad, "unit", "left").na.fill(0, ["crossings"])
    return out.select(F.col("unit").alias(unit), "rings_without_area", "crossings", ((F.col("rings_without_area") == 0) & (F.col("crossings") == 0) & (F.col("some") == 1)).alias("valid"))
