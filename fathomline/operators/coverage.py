"""How much of a network lies near detectors: unions of covered ranges on each line, summed by road domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.operators.lines import segments
from fathomline.operators.spatial import _finite, plane_distance

#: Number of salts among which the ranges of a segment are merged first.
SALTS = 64


def segment_rows(lines: DataFrame, key: str, points: str) -> DataFrame:
    """(key, no, ax, ay, bx, by, length) of every segment of every line."""
    opened = lines.select(key, F.posexplode(segments(F.col(points))).alias("no", "s"))
    flat = opened.select(key, "no", *[F.col(f"s.{p}.{c}").cast("double").alias(f"{p}{c}") for p in ("a", "b") for c in ("x", "y")])
    return flat.withColumn("length", plane_distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))


def segment_cells(rows: DataFrame, size: float, margin: float) -> DataFrame:
    """Segments once for each grid cell (cx, cy) that they cross or come within margin of.

    Cells are named column by column from the part of the segment that stands in the column, so a long slanting segment
    meets cells in proportion to its length, not to its box.
    """
    cell = lambda v: F.floor(v / size)
    low, high = F.least("ax", "bx"), F.greatest("ax", "bx")
    wide = rows.withColumn("cx", F.explode(F.sequence(cell(low - margin), cell(high + margin))))
    inside = lambda x: F.least(F.greatest(x, low), high)
    y_at = lambda x: F.col("ay") + (F.col("by") - F.col("ay")) * F.try_divide(inside(x) - F.col("ax"), F.col("bx") - F.col("ax"))
    one, two = y_at(F.col("cx") * size - margin), y_at((F.col("cx") + 1) * size + margin)
    bottom, top = F.coalesce(F.least(one, two), F.least("ay", "by")), F.coalesce(F.greatest(one, two), F.greatest("ay", "by"))
    # Vertical segments have no y at an x: both quotients are null, and the whole segment counts.
    upright = F.col("ax") == F.col("bx")
    bottom, top = F.when(upright, F.least("ay", "by")).otherwise(bottom), F.when(upright, F.greatest("ay", "by")).otherwise(top)
    return wide.withColumn("cy", F.explode(F.sequence(cell(bottom - margin), cell(top + margin))))


def disc_range(x: Column, y: Column, reach: float) -> Column:
    """struct(lo, hi): the part of a segment (ax, ay, bx, by) within reach of a point, as fractions of it; null where none is."""
    ux, uy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    wx, wy = F.col("ax") - x, F.col("ay") - y
    uu, uw = ux * ux + uy * uy, ux * wx + uy * wy
    left = uw * uw - uu * (wx * wx + wy * wy - reach * reach)
    root = F.sqrt(F.when(left >= 0, left))
    lo, hi = F.greatest(F.lit(0.0), F.try_divide(-uw - root, uu)), F.least(F.lit(1.0), F.try_divide(-uw + root, uu))
    return F.when((left >= 0) & (hi > lo), F.struct(lo.alias("lo"), hi.alias("hi")))


def merged_ranges(rows: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Disjoint ranges that cover what the ranges of a key cover; ranges that touch become one."""
    ahead = Window.partitionBy(*keys).orderBy(lo, hi)
    before = ahead.rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce(F.col(lo) > F.max(hi).over(before), F.lit(True)).cast("int")
    numbered = rows.select(*keys, lo, hi).withColumn("_new", fresh).withColumn("_island", F.sum("_new").over(ahead.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("_island")


def line_coverage(lines: DataFrame, key: str, points: str, centres: DataFrame, reach: float, x: str = "x", y: str = "y", cell: float | None = None) -> DataFrame:
    """(key, length, covered, share) of every line with a segment: its length within reach of any centre, counted once.

    Centres meet segments by grid cell. The ranges of one segment are merged among salts first and then all together, so
    that many centres beside one segment are no single group before they are few ranges. Rows without finite coordinates
    are no centres; equal keys are one line.
    """
    size = cell or 2 * reach
    parts = segment_rows(lines, key, points)
    at = centres.where(_finite(x) & _finite(y)).select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).distinct()
    at = at.withColumn("cx", F.floor(F.col("_x") / size)).withColumn("cy", F.floor(F.col("_y") / size))
    met = segment_cells(parts.where("length > 0"), size, reach).join(at, ["cx", "cy"]).withColumn("r", disc_range(F.col("_x"), F.col("_y"), reach)).where("r IS NOT NULL")
    ranges = met.select(key, "no", "length", "r.lo", "r.hi", F.pmod(F.xxhash64("_x", "_y"), F.lit(SALTS)).alias("_salt"))
    few = merged_ranges(ranges, [key, "no", "length", "_salt"]).drop("_salt")
    covered = merged_ranges(few, [key, "no", "length"]).groupBy(key).agg(F.sum(F.col("length") * (F.col("hi") - F.col("lo"))).alias("covered"))
    whole = parts.groupBy(key).agg(F.sum("length").alias("length"))
    return whole.join(covered, key, "left").na.fill(0.0, ["covered"]).withColumn("share", F.when(F.col("length") > 0, F.least(F.lit(1.0), F.col("covered") / F.col("length"))))


def domain_support(network: DataFrame, domains: dict[str, Column], length: str = "length", covered: str = "covered") -> DataFrame:
    """(road_domain, network_count, supported_count, count_share, network_length, supported_length, length_share), a row per domain.

    A domain is a condition on network rows, so they may overlap; all are summed in one pass.
    """
    rows = []
    for name, inside in domains.items():
        of = lambda v, inside=inside: F.coalesce(F.sum(F.when(inside, v)), F.lit(0.0))
        rows.append((name, F.count_if(inside), F.count_if(inside & (F.col(covered) > 0)), of(F.col(length)), of(F.col(covered))))
    sums = network.agg(F.array(*[F.struct(F.lit(n).alias("road_domain"), a.alias("network_count"), b.alias("supported_count"), c.alias("network_length"), d.alias("supported_length")) for n, a, b, c, d in rows]).alias("x"))
    flat = sums.select(F.explode("x").alias("x")).select("x.*")
    return flat.withColumn("count_share", F.try_divide("supported_count", "network_count")).withColumn("length_share", F.try_divide("supported_length", "network_length"))


def overlap_table(nearest: DataFrame, domains: dict[str, Column], reach: float, distance: str = "distance") -> DataFrame:
    """(domain, stations, with_detector, share, median_distance): stations whose nearest detector is within reach; null distances are none."""
    near = F.coalesce(F.col(distance) <= reach, F.lit(False))
    one = lambda n, c: F.struct(F.lit(n).alias("domain"), F.count_if(c).alias("stations"), F.count_if(c & near).alias("with_detector"), F.median(F.when(c, F.col(distance))).alias("median_distance"))
    flat = nearest.agg(F.array(*[one(n, c) for n, c in domains.items()]).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    return flat.withColumn("share", F.try_divide("with_detector", "stations"))


def match_table(nearest: DataFrame, group: str, device: str, fold: str, reach: float, distance: str = "distance") -> DataFrame:
    """Per road group of the nearest line: records, accepted ones (within reach), their devices, folds and median distance."""
    ok = F.coalesce(F.col(distance) <= reach, F.lit(False))
    kept = lambda c: F.when(ok, F.col(c))
    return nearest.groupBy(F.coalesce(F.col(group).cast("string"), F.lit("unmatched")).alias("road_group")).agg(
        F.count(F.lit(1)).alias("records"), F.count_if(ok).alias("accepted"), F.count_distinct(kept(device)).alias("accepted_devices"),
        F.count_distinct(kept(fold)).alias("folds"), F.median(kept(distance)).alias("median_distance"),
    )
