"""Plane geometry and neighbour joins on a grid: no cross join, exact filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.operators.blocks import best_within, first_of_copies, halvings
from fathomline.params import GeoParams, LinkParams


def to_xy(lon: Column, lat: Column, geo: GeoParams = GeoParams()) -> tuple[Column, Column]:
    """Local equirectangular metres."""
    import math

    return (lon - geo.lon0) * (geo.metres_per_lon * math.cos(math.radians(geo.lat0))), (lat - geo.lat0) * geo.metres_per_lat


def to_lon_lat(x: Column, y: Column, geo: GeoParams = GeoParams()) -> tuple[Column, Column]:
    import math

    return x / (geo.metres_per_lon * math.cos(math.radians(geo.lat0))) + geo.lon0, y / geo.metres_per_lat + geo.lat0


def projected_at_median(df: DataFrame, lon: str, lat: str, geo: GeoParams = GeoParams()) -> DataFrame:
    """x, y with the reference latitude at the data's median (one row, met by a cross join)."""
    ref = df.agg(F.median(lat).alias("_lat0"))
    return df.crossJoin(F.broadcast(ref)).withColumn("x", F.col(lon) * geo.metres_per_lon * F.cos(F.radians("_lat0"))).withColumn("y", F.col(lat) * geo.metres_per_lat).drop("_lat0")


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column, geo: GeoParams = GeoParams()) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    # Not the least of both, which for a null coordinate would be 1 and half the way around.
    return 2 * geo.earth_km * F.asin(F.when(a > 1, F.lit(1.0)).otherwise(F.sqrt(a)))


def plane_distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def point_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """struct(distance, x, y): foot point with its parameter clamped to [0, 1]; a zero-length segment is its point."""
    dx, dy = bx - ax, by - ay
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy))), F.lit(0.0))
    x, y = ax + t * dx, ay + t * dy
    return F.struct(plane_distance(px, py, x, y).alias("distance"), x.alias("x"), y.alias("y"))


def point_polyline(px: Column, py: Column, points: Column) -> Column:
    """Nearest foot point on a polyline given as array<struct<x,y>>."""
    ends = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.array_min(F.transform(ends, lambda s: point_segment(px, py, s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])))


def polyline_length(points: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(points) - 1, F.lit(1))), F.lit(0.0), lambda acc, i: acc + F.coalesce(plane_distance(F.get(points, i - 1)["x"], F.get(points, i - 1)["y"], F.get(points, i)["x"], F.get(points, i)["y"]), F.lit(0.0)))


def polyline_summary(points: Column) -> Column:
    """struct(length, centroid_x, centroid_y, min_x, max_x, min_y, max_y, start, end, vertices); the centroid is weighted by length."""
    first = F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0)))
    parts = F.zip_with(first, F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda a, b: F.struct(plane_distance(a["x"], a["y"], b["x"], b["y"]).alias("l"), ((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y")))
    total = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + p["l"])
    centre = lambda axis: F.coalesce(F.try_divide(F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + p["l"] * p[axis]), total), F.get(points, 0)[axis])
    at = lambda axis: F.transform(points, lambda p: p[axis])
    return F.struct(
        total.alias("length"), centre("x").alias("centroid_x"), centre("y").alias("centroid_y"), F.array_min(at("x")).alias("min_x"), F.array_max(at("x")).alias("max_x"),
        F.array_min(at("y")).alias("min_y"), F.array_max(at("y")).alias("max_y"), F.get(points, 0).alias("start"), F.element_at(points, -1).alias("end"), F.size(points).alias("vertices"),
    )


def endpoint_key(x: Column, y: Column, digits: int = 6) -> Column:
    return F.format_string(f"%.{digits}f,%.{digits}f", F.round(x, digits), F.round(y, digits))


def node_degrees(segments: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """min, max and mean degree of a segment's two end nodes."""
    ends = segments.select(key, F.explode(F.array(start, end)).alias("node"))
    degree = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return ends.join(degree, "node").groupBy(key).agg(F.min("degree").alias("degree_min"), F.max("degree").alias("degree_max"), F.avg("degree").alias("degree_mean"))


def wkt_line(points: Column) -> Column:
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(points, lambda p: F.format_string("%.12f %.12f", p["x"], p["y"])), ", "), F.lit(")"))


def parse_wkt(text: Column) -> Column:
    """Points of a WKT text as array<struct<x,y>>."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(-?\d+(?:\.\d+)?\s+-?\d+(?:\.\d+)?)"), F.lit(1)), lambda p: F.struct(F.get(F.split(p, r"\s+"), 0).cast("double").alias("x"), F.get(F.split(p, r"\s+"), 1).cast("double").alias("y")))


def parse_coordinates(text: Column) -> Column:
    """'lon,lat[,z] lon,lat' as array<struct<x,y>>; malformed pairs are left out."""
    pairs = F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda s: s != ""), lambda s: F.split(s, ","))
    typed = F.transform(pairs, lambda p: F.struct(F.get(p, 0).try_cast("double").alias("x"), F.get(p, 1).try_cast("double").alias("y")))
    return F.filter(typed, lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def ring_area(points: Column) -> Column:
    """Shoelace area of a closed or open ring."""
    n = F.size(points)
    twice = F.aggregate(
        F.sequence(F.lit(0), n - 1), F.lit(0.0),
        lambda acc, i: acc + F.get(points, i)["x"] * F.get(points, (i + 1) % n)["y"] - F.get(points, (i + 1) % n)["x"] * F.get(points, i)["y"],
    )
    return F.when(n >= 3, F.abs(twice) / 2).otherwise(0.0)


def in_ring(px: Column, py: Column, points: Column) -> Column:
    """Ray casting; null points are in no ring."""
    n = F.size(points)
    crosses = F.aggregate(
        F.sequence(F.lit(0), n - 1), F.lit(0),
        lambda acc, i: acc + F.coalesce(
            ((F.get(points, i)["y"] > py) != (F.get(points, (i + 1) % n)["y"] > py))
            & (px < F.try_divide((F.get(points, (i + 1) % n)["x"] - F.get(points, i)["x"]) * (py - F.get(points, i)["y"]), F.get(points, (i + 1) % n)["y"] - F.get(points, i)["y"]) + F.get(points, i)["x"]),
            F.lit(False),
        ).cast("int"),
    )
    return crosses % 2 == 1


def box_overlap(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> dict[str, Column]:
    """Intersection area, shares and IoU of axis-parallel boxes (min_x, min_y, max_x, max_y)."""
    wide = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    high = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    both, of_a, of_b = wide * high, (a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1])
    return {"intersection": both, "share_of_source": F.try_divide(both, of_a), "share_of_target": F.try_divide(both, of_b), "iou": F.try_divide(both, of_a + of_b - both)}


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


def _around(v: Column, size: float) -> Column:
    return F.explode(F.sequence(_cell(v, size) - 1, _cell(v, size) + 1))


def polygon_join(points: DataFrame, polygons: DataFrame, key: str, unit: str, ring: str, fallback: float, cell: float, x: str = "x", y: str = "y") -> DataFrame:
    """(key, unit, distance, method): the first polygon by unit that holds a point, else the nearest one within fallback.

    Edges belong to a polygon. ``method`` is within, nearest or outside; points beyond the fallback, or without
    coordinates, have no unit. Polygons are dealt to every cell that their widened boxes meet, so choose cells of about
    a polygon's size; keys are unique.
    """
    edge = lambda axis, f, by: F.floor((f(F.transform(F.col(ring), lambda p: p[axis])) + by) / cell).cast("long")
    dealt = polygons.where(F.size(ring) >= 3).select(unit, ring, F.explode(F.sequence(edge("x", F.array_min, -fallback), edge("x", F.array_max, fallback))).alias("_cx"))
    dealt = dealt.withColumn("_cy", F.explode(F.sequence(edge("y", F.array_min, -fallback), edge("y", F.array_max, fallback))))
    at = points.select(key, F.col(x).alias("_x"), F.col(y).alias("_y"), _cell(F.col(x), cell).alias("_cx"), _cell(F.col(y), cell).alias("_cy"))
    border = point_polyline(F.col("_x"), F.col("_y"), F.concat(F.col(ring), F.slice(ring, 1, 1)))["distance"]
    met = at.join(dealt, ["_cx", "_cy"]).withColumn("distance", F.when(in_ring(F.col("_x"), F.col("_y"), F.col(ring)), 0.0).otherwise(border)).where(F.col("distance") <= fallback)
    best = met.groupBy(key).agg(F.min(F.struct("distance", unit)).alias("_best"))
    method = F.when(F.col("_best").isNull(), "outside").when(F.col("_best.distance") == 0, "within").otherwise("nearest")
    return points.select(key).join(best, key, "left").select(key, F.col(f"_best.{unit}").alias(unit), F.col("_best.distance").alias("distance"), method.alias("method"))


def radius_join(left: DataFrame, right: DataFrame, radius: float, lx: str = "x", ly: str = "y", rx: str = "rx", ry: str = "ry", by: tuple[str, ...] = ()) -> DataFrame:
    """All pairs within the radius: the right side keeps its cell (of side radius), the left opens the nine around it.

    Pairs agree in the columns ``by``, which both sides have.
    """
    a = left.withColumn("_cx", _around(F.col(lx), radius)).withColumn("_cy", _around(F.col(ly), radius))
    b = right.withColumn("_cx", _cell(F.col(rx), radius)).withColumn("_cy", _cell(F.col(ry), radius))
    met = a.join(b, [*by, "_cx", "_cy"]).withColumn("distance", plane_distance(F.col(lx), F.col(ly), F.col(rx), F.col(ry)))
    return met.where(F.col("distance") <= radius).drop("_cx", "_cy")


def _finite(c: str) -> Column:
    return F.coalesce(F.abs(F.col(c)) < F.lit(float("inf")), F.lit(False))


def _grown(left: DataFrame, right: DataFrame, key: list[str], right_key: str, k: int, start: float | Callable[[DataFrame], float], within: Callable[[DataFrame, float], DataFrame], by: tuple[str, ...] = ()) -> DataFrame:
    """k nearest of each left row: rows that have k (or all there are in their group of ``by``) within a radius are done, the rest try twice the radius.

    The first radius may follow from the left rows.
    """
    from fathomline.session import discard, materialize

    w = Window.partitionBy(*key).orderBy("distance", right_key)
    if by:
        # A row without any candidate in its group is done at once.
        counts = right.groupBy(*by).agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("_need"))
        todo = materialize(left.join(counts, list(by)), "todo")
    else:
        todo = materialize(left.withColumn("_need", F.lit(min(k, right.count())).cast("long")), "todo")
    radius, done, rows = start(todo) if callable(start) else start, None, todo.count()
    while True:
        found = materialize(within(todo, radius).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k), "nearest")
        full = found.where(F.col("place") == F.col("_need")).select(*key)
        part = found.join(full, key, "left_semi").drop("_need")
        done = part if done is None else done.unionByName(part)
        before, todo = todo, materialize(todo.where("_need > 0").join(full, key, "left_anti"), "todo")
        discard(before)
        if not (lack := todo.count()):
            discard(todo)
            return done
        # A few rows far from all others may meet 16 times as many at once; each round costs a pass over the right side.
        radius *= 4 if lack * 64 <= rows else 2


def nearest_join(
    left: DataFrame, right: DataFrame, key: str, right_key: str, k: int, start: float, lx: str = "x", ly: str = "y", rx: str = "rx", ry: str = "ry", by: tuple[str, ...] = ()
) -> DataFrame:
    """k nearest right rows of each left row, with distance and place (ties by right key).

    With ``by``, a left row (one for each key and by) looks among right rows that agree in these columns only.

    Grid rings grow: rows with k neighbours within the radius are done, the rest try twice
    the radius, until all are done. Exact, because k neighbours within r beat everything
    outside r. Without ``by`` the first radius is halved where rows are dense, and of right
    rows that agree in all but their key only the first k are met, so work does not grow as the
    square of either. Rows whose coordinates are null or no finite numbers have no neighbours and
    are none; with fewer than k right rows all of them are returned.
    """
    left, right = left.where(_finite(lx) & _finite(ly)), right.where(_finite(rx) & _finite(ry))
    if by:
        return _grown(left, right, [key, *by], right_key, k, start, lambda todo, radius: radius_join(todo, right, radius, lx, ly, rx, ry, by), by)
    from fathomline.session import discard, materialize

    few = materialize(first_of_copies(right, right_key, k), "right")
    first = lambda todo: start / 2 ** halvings(todo, few, start, [(F.col(lx), F.col(rx)), (F.col(ly), F.col(ry))])
    done = _grown(left, few, [key], right_key, k, first, lambda todo, radius: best_within(todo, few, key, right_key, radius, k, lx=lx, ly=ly, rx=rx, ry=ry))
    discard(few)
    return done


def masked(candidates: DataFrame, targets: DataFrame, right_key: str, fold: str, folds: list[int], buffer: float, x: str = "x", y: str = "y", rx: str = "rx", ry: str = "ry") -> DataFrame:
    """Candidates once for each held-out fold (``held``) in which they may be used.

    Banned are a fold's own candidates and those within the buffer of any target of the fold (both have the column fold).
    """
    opened = candidates.withColumn("held", F.explode(F.array(*[F.lit(f) for f in folds]))).where(~F.col(fold).eqNullSafe(F.col("held")))
    places = targets.select(F.col(fold).alias("held"), F.col(x).alias("_tx"), F.col(y).alias("_ty")).where(_finite("_tx") & _finite("_ty"))
    near = radius_join(candidates.select(right_key, rx, ry).where(_finite(rx) & _finite(ry)), places, buffer, rx, ry, "_tx", "_ty").select(right_key, "held").distinct()
    return opened.join(near, [right_key, "held"], "left_anti")


def nearest_masked(
    targets: DataFrame, candidates: DataFrame, key: str, right_key: str, fold: str, folds: list[int], buffer: float, start: float, x: str = "x", y: str = "y", rx: str = "rx", ry: str = "ry"
) -> DataFrame:
    """For each target and held-out fold, its nearest candidate that the fold does not ban, with distance; none where all are banned.

    Rings go on growing past banned candidates, as these are no rows of the fold at all.
    """
    allowed = masked(candidates, targets, right_key, fold, folds, buffer, x, y, rx, ry).drop(fold)
    opened = targets.withColumn("held", F.explode(F.array(*[F.lit(f) for f in folds])))
    return nearest_join(opened, allowed, key, right_key, 1, start, x, y, rx, ry, ("held",)).drop("place")


def mask_summary(candidates: DataFrame, targets: DataFrame, right_key: str, fold: str, folds: list[int], buffer: float, **names: str) -> DataFrame:
    """(held, source_count, retained_count, masked_count, retained_share) of each held-out fold."""
    kept = masked(candidates, targets, right_key, fold, folds, buffer, **names).groupBy("held").agg(F.count(F.lit(1)).alias("retained_count"))
    total = candidates.agg(F.count(F.lit(1)).alias("source_count"), F.array(*[F.lit(f) for f in folds]).alias("_f")).withColumn("held", F.explode("_f")).drop("_f")
    out = total.join(kept, "held", "left").na.fill(0, ["retained_count"])
    return out.select("held", "source_count", "retained_count", (F.col("source_count") - F.col("retained_count")).alias("masked_count"), F.try_divide("retained_count", "source_count").alias("retained_share"))


def nearest_others(left: DataFrame, right: DataFrame, key: str, right_key: str, k: int, start: float, **names: str) -> DataFrame:
    """As nearest_join where both sides are one table: a row whose keys are equal is no neighbour of itself."""
    near = nearest_join(left, right, key, right_key, k + 1, start, **names).where(~F.col(key).eqNullSafe(F.col(right_key)))
    w = Window.partitionBy(key).orderBy("distance", right_key)
    return near.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def inverse_distance(neighbours: DataFrame, key: str, value: str, k: int = 10) -> DataFrame:
    """Mean weighted by 1 / distance; where some distance is 0, the mean of those neighbours alone."""
    near = neighbours.where(F.col("place") <= k)
    zero = F.col("distance") == 0
    w = F.when(~zero, 1 / F.when(~zero, F.col("distance")))
    return near.groupBy(key).agg(F.when(F.max(zero.cast("int")) == 1, F.avg(F.when(zero, F.col(value)))).otherwise(F.sum(w * F.col(value)) / F.sum(w)).alias("predicted"))


def nearest_centre(points: DataFrame, centres: DataFrame, label: str = "label", most: int = 10_000) -> DataFrame:
    """Label of the nearest of a few centres (cx, cy, label), which are broadcast; more than ``most`` are an error, and nearest_join is for them."""
    if (n := centres.count()) > most:
        raise ValueError(f"{n} centres, {most} at most: use nearest_join")
    met = points.crossJoin(F.broadcast(centres.groupBy().agg(F.collect_list(F.struct("cx", "cy", label)).alias("_centres"))))
    nearest = F.array_min(F.transform("_centres", lambda c: F.struct(plane_distance(F.col("x"), F.col("y"), c["cx"], c["cy"]).alias("d"), c[label].alias("label"))))
    return met.withColumn(label, nearest["label"]).drop("_centres")


def candidate_score(distance: Column, similarity: Column, params: LinkParams = LinkParams()) -> Column:
    return params.distance_weight * F.greatest(F.lit(0.0), 1 - distance / params.distance_scale_m) + params.name_weight * similarity


def best_candidates(left: DataFrame, right: DataFrame, key: str, radius: float, similarity: str, others: bool = False, params: LinkParams = LinkParams(), **names: str) -> DataFrame:
    """Pairs of key and candidate within the radius with their score, for ranked_candidates, which needs no others than these."""

    def order(own: dict, its: dict, distance):
        near = 1 - distance / params.distance_scale_m
        return [-(params.distance_weight * near.clip(min=0.0) + params.name_weight * its[similarity]), distance]

    few = first_of_copies(right, "candidate", params.top + others)
    pairs = best_within(left, few, key, "candidate", radius, params.top, order, others, **names)
    return pairs.withColumn("score", candidate_score(F.col("distance"), F.col(similarity), params))


def ranked_candidates(pairs: DataFrame, key: str, params: LinkParams = LinkParams()) -> DataFrame:
    """Top candidates by score, then distance, with candidate_rank and selected."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "distance", "candidate")
    return pairs.withColumn("candidate_rank", F.row_number().over(w)).where(F.col("candidate_rank") <= params.top).withColumn("selected", F.col("candidate_rank") == 1)


def rival_gap(ranked: DataFrame, key: str, identity: str) -> DataFrame:
    """Selected score minus the best score of another identity; null without a rival."""
    best = ranked.where("selected").select(key, F.col(identity).alias("_identity"), F.col("score").alias("_score"))
    return ranked.join(best, key).groupBy(key).agg(F.first("_score").alias("score"), (F.first("_score") - F.max(F.when(F.col(identity) != F.col("_identity"), F.col("score")))).alias("rival_gap"))


def radius_or_nearest(left: DataFrame, right: DataFrame, key: str, right_key: str, radius: float, others: bool = False, **names: str) -> DataFrame:
    """Pairs within the radius, and for the rest their nearest row; ``others``: rows with equal keys are no pair."""
    near = radius_join(left, right, radius, **names).withColumn("fallback", F.lit(False))
    near = near.where(~F.col(key).eqNullSafe(F.col(right_key))) if others else near
    rest = left.join(near.select(key).distinct(), key, "left_anti")
    far = (nearest_others if others else nearest_join)(rest, right, key, right_key, 1, radius * 2, **names).drop("place").withColumn("fallback", F.lit(True))
    return near.unionByName(far)
