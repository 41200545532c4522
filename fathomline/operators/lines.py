"""Line and ring operators beyond single distances: points along a line, overlap shares, clipping, matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.operators.spatial import plane_distance, point_segment


def lengths_upto(points: Column) -> Column:
    """Length of a polyline up to each of its points, starting with 0."""
    steps = F.transform(points, lambda p, i: F.coalesce(plane_distance(p["x"], p["y"], F.get(points, i - 1)["x"], F.get(points, i - 1)["y"]), F.lit(0.0)))
    return F.transform(steps, lambda s, i: F.aggregate(F.slice(steps, 1, i + 1), F.lit(0.0), lambda acc, x: acc + x))


def with_point_along(df: DataFrame, points: str, fraction: float, out: str = "along") -> DataFrame:
    """struct(x, y) at a fraction of the length (0.5: the midpoint); a line without length gives its first point."""
    step = df.withColumn("_upto", lengths_upto(F.col(points)))
    step = step.withColumn("_want", F.element_at("_upto", -1) * fraction).withColumn("_i", F.greatest(F.size(F.filter("_upto", lambda u: u <= F.col("_want"))), F.lit(1)))
    step = step.withColumn("_a", F.get(points, F.col("_i") - 1)).withColumn("_b", F.coalesce(F.get(points, F.col("_i")), F.get(points, F.col("_i") - 1)))
    part = F.coalesce(F.try_divide(F.col("_want") - F.get("_upto", F.col("_i") - 1), F.get("_upto", F.col("_i")) - F.get("_upto", F.col("_i") - 1)), F.lit(0.0))
    at = lambda axis: F.col("_a")[axis] + part * (F.col("_b")[axis] - F.col("_a")[axis])
    return step.withColumn(out, F.struct(at("x").alias("x"), at("y").alias("y"))).drop("_upto", "_want", "_i", "_a", "_b")


def segments(points: Column) -> Column:
    """The segments of a polyline as array<struct<a, b>>; fewer than two points have none."""
    n = F.greatest(F.size(points) - 1, F.lit(0))
    return F.zip_with(F.slice(points, 1, n), F.slice(points, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _between(at: Column, step: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """The t with low <= at + t * step <= high; an empty range is (1, 0)."""
    one, two = F.try_divide(low - at, step), F.try_divide(high - at, step)
    inside = (at >= low) & (at <= high)
    return (
        F.when(step != 0, F.least(one, two)).when(inside, 0.0).otherwise(1.0),
        F.when(step != 0, F.greatest(one, two)).when(inside, 1.0).otherwise(0.0),
    )


def _near_parts(s: Column, o: Column, reach: float) -> Column:
    """Ranges of a segment, as struct(lo, hi) in [0, 1], within reach of another one: near its ends and along it."""
    ux, uy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]

    def disc(end: str) -> Column:
        wx, wy = s["a"]["x"] - o[end]["x"], s["a"]["y"] - o[end]["y"]
        uu, uw = ux * ux + uy * uy, ux * wx + uy * wy
        left = uw * uw - uu * (wx * wx + wy * wy - reach * reach)
        root = F.sqrt(F.when(left >= 0, left))
        return F.struct(F.greatest(F.lit(0.0), F.try_divide(-uw - root, uu)).alias("lo"), F.least(F.lit(1.0), F.try_divide(-uw + root, uu)).alias("hi"), left.alias("left"))

    vx, vy = o["b"]["x"] - o["a"]["x"], o["b"]["y"] - o["a"]["y"]
    wx, wy = s["a"]["x"] - o["a"]["x"], s["a"]["y"] - o["a"]["y"]
    vv = vx * vx + vy * vy
    along = _between(wx * vx + wy * vy, ux * vx + uy * vy, F.lit(0.0), vv)
    aside = _between(vx * wy - vy * wx, vx * uy - vy * ux, -reach * F.sqrt(vv), reach * F.sqrt(vv))
    strip = F.struct(F.greatest(F.lit(0.0), along[0], aside[0]).alias("lo"), F.least(F.lit(1.0), along[1], aside[1]).alias("hi"), vv.alias("left"))
    return F.filter(F.array(disc("a"), disc("b"), strip), lambda r: (r["left"] >= 0) & (r["hi"] > r["lo"]))


def overlap_share(points: Column, other: Column, buffer: float, least_length: float = 1.0) -> Column:
    """Share of a line's length within buffer of another line, exact (round ends); lengths under least_length count as it.

    Null lines and lines without a segment share nothing.
    """

    def covered(s: Column) -> Column:
        ranges = F.array_sort(F.flatten(F.transform(segments(other), lambda o: _near_parts(s, o, buffer))))
        merged = F.aggregate(
            ranges, F.struct(F.lit(0.0).alias("upto"), F.lit(0.0).alias("total")),
            lambda acc, r: F.struct(F.greatest(acc["upto"], r["hi"]).alias("upto"), (acc["total"] + F.greatest(F.lit(0.0), r["hi"] - F.greatest(r["lo"], acc["upto"]))).alias("total")),
        )
        length = plane_distance(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])
        return F.struct(length.alias("length"), (length * merged["total"]).alias("near"))

    parts = F.transform(segments(points), covered)
    summed = lambda name: F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + p[name])
    return F.least(F.lit(1.0), F.coalesce(summed("near"), F.lit(0.0)) / F.greatest(summed("length"), F.lit(least_length)))


def overlap_share_near(points: Column, other: Column, distance: Column, buffer: float, least_length: float = 1.0) -> Column:
    """overlap_share of lines whose distance is known: nothing is computed where it exceeds the buffer (but for rounding)."""
    share = overlap_share(points, other, buffer, least_length)
    return F.when(distance > buffer * (1 + 1e-6) + 1e-6, F.lit(0.0)).otherwise(share)


def _side(a: Column, b: Column, p: Column) -> Column:
    return (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])


def segment_distance(s: Column, o: Column) -> Column:
    """Distance of two segments struct(a, b): 0 where they cross, else the least of their ends' distances."""
    cross = (_side(s["a"], s["b"], o["a"]) * _side(s["a"], s["b"], o["b"]) < 0) & (_side(o["a"], o["b"], s["a"]) * _side(o["a"], o["b"], s["b"]) < 0)
    end = lambda p, q: point_segment(p["x"], p["y"], q["a"]["x"], q["a"]["y"], q["b"]["x"], q["b"]["y"])["distance"]
    return F.when(cross, 0.0).otherwise(F.least(end(s["a"], o), end(s["b"], o), end(o["a"], s), end(o["b"], s)))


def line_distance(points: Column, other: Column) -> Column:
    """Least distance of two polylines; null where one has no segment."""
    # Lines of one segment need no lambda, which Spark does not compile.
    only = lambda p: {"a": F.get(p, 0), "b": F.get(p, 1)}
    single = (F.size(points) == 2) & (F.size(other) == 2)
    return F.when(single, segment_distance(only(points), only(other))).otherwise(_least_distance(points, other))


def _least_distance(points: Column, other: Column) -> Column:
    return F.array_min(F.flatten(F.transform(segments(points), lambda s: F.transform(segments(other), lambda o: segment_distance(s, o)))))


def _cells(df: DataFrame, points: str, size: float, margin: float, prefix: str) -> DataFrame:
    """One row per grid cell that a line's box, widened by margin, meets; the box's first cell is kept beside it."""
    end = lambda axis, f: f(F.transform(F.col(points), lambda p: p[axis]))
    first = df.where(F.size(points) >= 2).withColumns({f"{prefix}{name}{axis}": end(axis, f) for axis in "xy" for name, f in (("low", F.array_min), ("high", F.array_max))})
    edge = lambda axis, f, by: F.floor((F.col(f"{prefix}{'low' if f is F.array_min else 'high'}{axis}") + by) / size).cast("long")
    first = first.withColumn(f"{prefix}x", edge("x", F.array_min, -margin)).withColumn(f"{prefix}y", edge("y", F.array_min, -margin))
    wide = first.withColumn("_cx", F.explode(F.sequence(F.col(f"{prefix}x"), edge("x", F.array_max, margin))))
    return wide.withColumn("_cy", F.explode(F.sequence(F.col(f"{prefix}y"), edge("y", F.array_max, margin))))


def line_join(left: DataFrame, right: DataFrame, points: str, other: str, reach: float, cell: float | None = None) -> DataFrame:
    """All pairs of lines within reach, with their distance; each pair is met in one cell only, so nothing is deduplicated.

    Cells are four times the reach wide by default; long lines call for larger ones. Lines without a segment meet none.
    """
    size = cell or 4 * reach
    # Pairs are many more than lines: a small table of one partition would leave all of them to one task.
    left = left.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(points))
    met = _cells(left, points, size, reach, "_l").join(_cells(right, other, size, 0.0, "_r"), ["_cx", "_cy"])
    met = met.where((F.col("_cx") == F.greatest("_lx", "_rx")) & (F.col("_cy") == F.greatest("_ly", "_ry")))
    # Boxes farther apart than the reach, a hair more for rounding, need no distance.
    far = reach * (1 + 1e-9)
    met = met.where(" AND ".join(f"_{p}low{c} - _{q}high{c} <= {far!r}" for c in "xy" for p, q in ("lr", "rl")))
    met = met.drop("_cx", "_cy", *[f"_{p}{n}{c}" for p in "lr" for n in ("", "low", "high") for c in "xy"])
    return met.withColumn("distance", line_distance(F.col(points), F.col(other))).where(F.col("distance") <= reach)


def match_score(overlap: Column, name: Column, distance: Column, reach: float = 60.0) -> Column:
    return 2.5 * overlap + 0.75 * name - 0.30 * distance / reach


def best_match(pairs: DataFrame, key: str, candidate: str) -> DataFrame:
    """The candidate with the largest (score, overlap, name similarity, -distance); ties by candidate."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), F.desc("overlap"), F.desc("name_similarity"), "distance", candidate)
    return pairs.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def order_of_matches(own: dict, its: dict, distance, reach: float = 60.0) -> list:
    """The order of best_match for ``blocks.best_within``: overlap stands with the candidate, name_similarity with the row."""
    return [-(2.5 * its["overlap"] + 0.75 * own["name_similarity"] - 0.30 * distance / reach), -its["overlap"], -own["name_similarity"], distance]


def match_status(distance: Column, overlap: Column, name: Column) -> Column:
    high = (distance <= 15) & ((overlap >= 0.5) | (name >= 0.5))
    moderate = ((distance <= 30) & ((overlap >= 0.2) | (name >= 0.25))) | (distance <= 8)
    return F.when(distance.isNull(), "unmatched").when(high, "high").when(moderate, "moderate").otherwise("low")
