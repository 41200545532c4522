"""Queries of spatial support: masked and great-circle neighbours, coverage of a network, overlay of polygons."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.operators import coverage, overlay, spatial, sphere
from fathomline.plans.frames import POINTS, points
from fathomline.plans.q_stats import rounded
from fathomline.plans.registry import query
from fathomline.session import table

FOLDS = [1, 2, 3, 4, 5]
#: Stations and sensors in one plane: coordinates 1 and 2, and coordinates 3 and 4, of every vector; folds by longitude bands of the label.
SITES = f"{POINTS}, sites AS (SELECT vec_id, x, y, (label % 5 + 1)::INTEGER AS fold FROM points), sensors AS (SELECT vec_id AS sensor_id, embedding[3]::DOUBLE * 1000 AS rx, embedding[4]::DOUBLE * 1000 AS ry, (label % 5 + 1)::INTEGER AS fold FROM embeddings)"
GAP = "sqrt((s.x - d.rx) * (s.x - d.rx) + (s.y - d.ry) * (s.y - d.ry))"
BANNED = f"{SITES}, banned AS (SELECT DISTINCT d.sensor_id, s.fold AS held FROM sensors d JOIN sites s ON {GAP} <= 2)"


def sites(spark, sf):
    return points(spark, sf).select("vec_id", "x", "y", (F.col("label") % 5 + 1).cast("int").alias("fold"))


def sensors(spark, sf):
    v = table(spark, sf, "embeddings")
    at = lambda i: F.get("embedding", i).cast("double") * 1000
    return v.select(F.col("vec_id").alias("sensor_id"), at(2).alias("rx"), at(3).alias("ry"), (F.col("label") % 5 + 1).cast("int").alias("fold"))


@query("l11_nearest_masked", f"""WITH {BANNED}, p AS (SELECT s.vec_id, h.held, d.sensor_id, {GAP} AS g FROM sites s CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS held) h JOIN sensors d ON d.fold <> h.held WHERE NOT EXISTS (SELECT 1 FROM banned b WHERE b.sensor_id = d.sensor_id AND b.held = h.held))
SELECT vec_id, held, arg_min(sensor_id, struct_pack(g := g, i := sensor_id)) AS sensor_id, round(min(g), 6) AS distance FROM p GROUP BY 1, 2""")
def _(spark, sf):
    near = spatial.nearest_masked(sites(spark, sf), sensors(spark, sf), "vec_id", "sensor_id", "fold", FOLDS, 2.0, 4.0)
    return near.select("vec_id", "held", "sensor_id", F.round("distance", 6).alias("distance"))


@query("l11_mask_summary", f"""WITH {BANNED}, k AS (SELECT h.held, count(*) FILTER (WHERE d.fold <> h.held AND NOT EXISTS (SELECT 1 FROM banned b WHERE b.sensor_id = d.sensor_id AND b.held = h.held)) AS n, count(*) AS s FROM sensors d CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS held) h GROUP BY h.held)
SELECT held, s AS source_count, n AS retained_count, s - n AS masked_count, round(n / s, 6) AS retained_share FROM k""")
def _(spark, sf):
    return rounded(spatial.mask_summary(sensors(spark, sf), sites(spark, sf), "sensor_id", "fold", FOLDS, 2.0), 6)


#: Places all over the globe, some beside the poles and the antimeridian: coordinates as angles.
GLOBE = """globe AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 179.9 + embedding[1]::DOUBLE / 2 ELSE embedding[1]::DOUBLE * 900 END AS lon,
  greatest(-90, least(90, CASE WHEN vec_id % 11 = 0 THEN 89.5 + embedding[2]::DOUBLE ELSE embedding[2]::DOUBLE * 400 END)) AS lat FROM embeddings)"""
KM = "2 * 6371 * asin(least(1, sqrt(power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2))))"


def globe(spark, sf):
    first, second = (F.get("embedding", i).cast("double") for i in (0, 1))
    lon = F.when(F.col("vec_id") % 7 == 0, 179.9 + first / 2).otherwise(first * 900)
    lat = F.when(F.col("vec_id") % 11 == 0, 89.5 + second).otherwise(second * 400)
    return table(spark, sf, "embeddings").select("vec_id", lon.alias("lon"), F.greatest(F.lit(-90.0), F.least(F.lit(90.0), lat)).alias("lat"))


@query("j13_great_circle_nearest", f"""WITH {GLOBE}, p AS (SELECT a.vec_id, b.vec_id AS other_id, {KM} AS km FROM globe a JOIN globe b ON a.vec_id <> b.vec_id)
SELECT vec_id, place::INTEGER AS place, round(km, 5) AS km FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY km, other_id) AS place FROM p) WHERE place <= 3""")
def _(spark, sf):
    g = globe(spark, sf)
    others = g.select(F.col("vec_id").alias("other_id"), F.col("lon").alias("rlon"), F.col("lat").alias("rlat"))
    # The nearest of all is the point itself.
    near = sphere.sphere_nearest_join(g, others, "vec_id", "other_id", 4, 300.0).where("vec_id <> other_id")
    w = F.row_number().over(spatial.Window.partitionBy("vec_id").orderBy("distance", "other_id"))
    return near.withColumn("place", w).where("place <= 3").select("vec_id", "place", F.round("distance", 5).alias("km"))


@query("j17_great_circle_radius", f"WITH {GLOBE} SELECT a.vec_id, count(*) AS n, round(max({KM}), 5) AS farthest FROM globe a JOIN globe b ON {KM} <= 150 GROUP BY a.vec_id")
def _(spark, sf):
    g = globe(spark, sf)
    others = g.select(F.col("lon").alias("rlon"), F.col("lat").alias("rlat"))
    near = sphere.sphere_radius_join(g, others, 150.0)
    return near.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("distance"), 5).alias("farthest"))


#: Lines of two segments that begin at coordinates 1 and 2 of a vector, by steps of a tenth of coordinates 3 to 6; detectors at coordinates 7 and 8.
LINES = """roads AS (SELECT vec_id, label, embedding[1]::DOUBLE * 1000 AS x1, embedding[2]::DOUBLE * 1000 AS y1, embedding[1]::DOUBLE * 1000 + embedding[3]::DOUBLE * 100 AS x2, embedding[2]::DOUBLE * 1000 + embedding[4]::DOUBLE * 100 AS y2,
  embedding[1]::DOUBLE * 1000 + embedding[3]::DOUBLE * 100 + embedding[5]::DOUBLE * 100 AS x3, embedding[2]::DOUBLE * 1000 + embedding[4]::DOUBLE * 100 + embedding[6]::DOUBLE * 100 AS y3 FROM embeddings),
segs AS (SELECT vec_id, label, 0 AS no, x1 AS ax, y1 AS ay, x2 AS bx, y2 AS by_ FROM roads UNION ALL SELECT vec_id, label, 1, x2, y2, x3, y3 FROM roads),
detectors AS (SELECT embedding[7]::DOUBLE * 1000 AS x, embedding[8]::DOUBLE * 1000 AS y FROM embeddings),
ranges AS (SELECT s.*, sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) AS l, ((bx - ax) * (ax - d.x) + (by_ - ay) * (ay - d.y)) AS uw, ((bx - ax) ** 2 + (by_ - ay) ** 2) AS uu, ((ax - d.x) ** 2 + (ay - d.y) ** 2 - 9) AS ww FROM segs s, detectors d),
cut AS (SELECT *, greatest(0, (-uw - sqrt(uw * uw - uu * ww)) / uu) AS lo, least(1, (-uw + sqrt(uw * uw - uu * ww)) / uu) AS hi FROM ranges WHERE uw * uw - uu * ww >= 0),
run AS (SELECT *, max(hi) OVER (PARTITION BY vec_id, no ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM cut WHERE hi > lo),
near AS (SELECT vec_id, sum(l * greatest(0, hi - greatest(lo, coalesce(upto, 0)))) AS covered FROM run GROUP BY vec_id),
cover AS (SELECT r.vec_id, r.label, r.l AS length, coalesce(near.covered, 0) AS covered FROM (SELECT vec_id, label, sum(sqrt((bx - ax) ** 2 + (by_ - ay) ** 2)) AS l FROM segs GROUP BY 1, 2) r LEFT JOIN near USING (vec_id))"""


def roads(spark, sf):
    at = lambda i: F.get("embedding", i).cast("double") * 1000
    v = table(spark, sf, "embeddings")
    step = lambda i: F.get("embedding", i).cast("double") * 100
    corners = [(at(0), at(1)), (at(0) + step(2), at(1) + step(3)), (at(0) + step(2) + step(4), at(1) + step(3) + step(5))]
    lines = v.select("vec_id", "label", F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners]).alias("points"))
    return lines, v.select(F.col("vec_id").alias("detector_id"), at(6).alias("x"), at(7).alias("y"), "label")


def covered(spark, sf):
    lines, detectors = roads(spark, sf)
    return coverage.line_coverage(lines, "vec_id", "points", detectors, 3.0, cell=8.0).join(lines.select("vec_id", "label"), "vec_id")


@query("e16_line_coverage", f"WITH {LINES} SELECT vec_id, round(length, 6) AS length, round(covered, 6) AS covered, round(least(1, covered / length), 6) AS share FROM cover")
def _(spark, sf):
    return rounded(covered(spark, sf).select("vec_id", "length", "covered", "share"), 6)


@query("e16_domain_support", f"""WITH {LINES}, d AS (SELECT unnest(['all', 'local', 'service', 'minor_proxy']) AS road_domain, * FROM cover),
g AS (SELECT * FROM d WHERE road_domain = 'all' OR (road_domain = 'local' AND label IN (1, 2, 3)) OR (road_domain = 'service' AND label = 4) OR (road_domain = 'minor_proxy' AND label IN (1, 2, 3, 4)))
SELECT road_domain, count(*) AS network_count, count(*) FILTER (WHERE covered > 0) AS supported_count, round(sum(length), 4) AS network_length, round(sum(covered), 4) AS supported_length,
  round(count(*) FILTER (WHERE covered > 0) / count(*), 4) AS count_share, round(sum(covered) / sum(length), 4) AS length_share FROM g GROUP BY 1""")
def _(spark, sf):
    label = F.col("label")
    domains = {"all": F.lit(True), "local": label.isin(1, 2, 3), "service": label == 4, "minor_proxy": label.isin(1, 2, 3, 4)}
    return rounded(coverage.domain_support(covered(spark, sf), domains))


@query("e16_detector_matches", f"""WITH {LINES.split('segs AS')[0]} d AS (SELECT vec_id AS detector_id, label, embedding[7]::DOUBLE * 1000 AS x, embedding[8]::DOUBLE * 1000 AS y FROM embeddings),
c AS (SELECT vec_id, label, (x1 + x2 + x3) / 3 AS cx, (y1 + y2 + y3) / 3 AS cy FROM roads),
p AS (SELECT d.detector_id, d.label % 5 AS fold, c.label AS road, c.vec_id, sqrt((d.x - c.cx) * (d.x - c.cx) + (d.y - c.cy) * (d.y - c.cy)) AS g FROM d, c),
n AS (SELECT detector_id, any_value(fold) AS fold, arg_min(road, struct_pack(g := g, i := vec_id)) AS road, min(g) AS g FROM p GROUP BY 1)
SELECT road::VARCHAR AS road_group, count(*) AS records, count(*) FILTER (WHERE g <= 12) AS accepted, count(DISTINCT detector_id) FILTER (WHERE g <= 12) AS accepted_devices, count(DISTINCT fold) FILTER (WHERE g <= 12) AS folds, round(median(g) FILTER (WHERE g <= 12), 6) AS median_distance FROM n GROUP BY 1""")
def _(spark, sf):
    lines, detectors = roads(spark, sf)
    centre = lambda c: (F.get("points", 0)[c] + F.get("points", 1)[c] + F.get("points", 2)[c]) / 3
    centres = lines.select(F.col("vec_id").alias("road_id"), F.col("label").alias("road"), centre("x").alias("rx"), centre("y").alias("ry"))
    near = spatial.nearest_join(detectors, centres, "detector_id", "road_id", 1, 5.0).withColumn("fold", F.col("label") % 5)
    return rounded(coverage.match_table(near, "road", "detector_id", "fold", 12.0), 6)


#: Five-pointed stars around each vector's point, larger where coordinate 3 is; every other one has a square hole.
STARS = """base AS (SELECT vec_id, embedding[1]::DOUBLE * 1000 AS x, embedding[2]::DOUBLE * 1000 AS y, 3 + 8 * abs(embedding[3]::DOUBLE) AS r FROM embeddings),
corner AS (SELECT vec_id, i, x + (CASE WHEN i % 2 = 0 THEN r ELSE r * 0.45 END) * cos(i * pi() / 5 + 0.1) AS ax, y + (CASE WHEN i % 2 = 0 THEN r ELSE r * 0.45 END) * sin(i * pi() / 5 + 0.1) AS ay, 1 AS role FROM base, range(10) AS t(i)
  UNION ALL SELECT vec_id, 10 + i, x + r * 0.2 * cos(i * pi() / 2 + 0.3), y + r * 0.2 * sin(i * pi() / 2 + 0.3), -1 FROM base, range(4) AS t(i) WHERE vec_id % 2 = 0),
edge AS (SELECT vec_id, role, ax, ay, lead(ax, 1, fx) OVER w AS bx, lead(ay, 1, fy) OVER w AS by_ FROM (SELECT *, first_value(ax) OVER w AS fx, first_value(ay) OVER w AS fy FROM corner WINDOW w AS (PARTITION BY vec_id, role ORDER BY i)) WINDOW w AS (PARTITION BY vec_id, role ORDER BY i)),
flat AS (SELECT vec_id, role * sign(ax - bx) AS s, least(ax, bx) AS xl, greatest(ax, bx) AS xr, CASE WHEN ax < bx THEN ay ELSE by_ END AS yl, CASE WHEN ax < bx THEN by_ ELSE ay END AS yr FROM edge WHERE ax <> bx),
whole AS (SELECT vec_id, sum(s * (xr - xl) * (yl + yr) / 2) AS area, min(least(yl, yr)) AS y0 FROM flat GROUP BY 1),
pq AS (SELECT p.vec_id, q.vec_id AS other_id, p.s * q.s AS s, least(wp.y0, wq.y0) AS y0, greatest(p.xl, q.xl) AS l, least(p.xr, q.xr) AS h, p.xl AS pxl, p.xr AS pxr, p.yl AS pyl, p.yr AS pyr, q.xl AS qxl, q.xr AS qxr, q.yl AS qyl, q.yr AS qyr
  FROM base a JOIN base b ON a.vec_id < b.vec_id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 < (a.r + b.r) ** 2 JOIN flat p ON p.vec_id = a.vec_id JOIN flat q ON q.vec_id = b.vec_id AND greatest(p.xl, q.xl) < least(p.xr, q.xr) JOIN whole wp ON wp.vec_id = a.vec_id JOIN whole wq ON wq.vec_id = b.vec_id),
h AS (SELECT *, pyl + (pyr - pyl) * (l - pxl) / (pxr - pxl) - y0 AS pl, pyl + (pyr - pyl) * (h - pxl) / (pxr - pxl) - y0 AS pr, qyl + (qyr - qyl) * (l - qxl) / (qxr - qxl) - y0 AS ql, qyl + (qyr - qyl) * (h - qxl) / (qxr - qxl) - y0 AS qr FROM pq),
shared AS (SELECT vec_id, other_id, sum(s * (h - l) / 2 * CASE WHEN (pl - ql) * (pr - qr) < 0 THEN (pl - ql) / ((pl - ql) - (pr - qr)) * (least(pl, ql) + pl + (pl - ql) / ((pl - ql) - (pr - qr)) * (pr - pl)) + (1 - (pl - ql) / ((pl - ql) - (pr - qr))) * (pl + (pl - ql) / ((pl - ql) - (pr - qr)) * (pr - pl) + least(pr, qr)) ELSE least(pl, ql) + least(pr, qr) END) AS i FROM h GROUP BY 1, 2)"""


def stars(spark, sf):
    import math

    first, second, third = (F.get("embedding", i).cast("double") for i in (0, 1, 2))
    base = table(spark, sf, "embeddings").select("vec_id", (first * 1000).alias("x"), (second * 1000).alias("y"), (3 + 8 * F.abs(third)).alias("r"))
    at = lambda share, angle: F.struct((F.col("x") + F.col("r") * share * math.cos(angle)).alias("x"), (F.col("y") + F.col("r") * share * math.sin(angle)).alias("y"))
    star = F.array(*[at(0.45 if i % 2 else 1.0, i * math.pi / 5 + 0.1) for i in range(10)])
    # The hole runs clockwise; roles come from the place of a ring, not from its direction.
    hole = F.array(*[at(0.2, -i * math.pi / 2 + 0.3) for i in range(4)])
    return base.select("vec_id", F.when(F.col("vec_id") % 2 == 0, F.array(star, hole)).otherwise(F.array(star)).alias("rings"))


@query("j21_n09_polygon_overlay", f"""WITH {STARS} SELECT s.vec_id, s.other_id, round(i, 4) AS intersection, round(i / a.area, 5) AS share_of_source, round(i / b.area, 5) AS share_of_target, round(i / (a.area + b.area - i), 5) AS iou
FROM shared s JOIN whole a ON a.vec_id = s.vec_id JOIN whole b ON b.vec_id = s.other_id WHERE i > 0.001""")
def _(spark, sf):
    s = stars(spark, sf)
    o = overlay.overlay(s, s.withColumnRenamed("vec_id", "other_id"), "vec_id", "other_id", "rings", "rings", 10.0, ordered=True).where("vec_id < other_id AND intersection > 0.001")
    return o.select("vec_id", "other_id", F.round("intersection", 4).alias("intersection"), *[F.round(c, 5).alias(c) for c in ("share_of_source", "share_of_target", "iou")])


@query("n09_polygon_areas", f"WITH {STARS} SELECT vec_id, round(area, 4) AS area, true AS valid, 0 AS crossings FROM whole")
def _(spark, sf):
    s = stars(spark, sf)
    found = overlay.areas(overlay.edges(s, "vec_id", "rings")).select(F.col("unit").alias("vec_id"), F.round("area", 4).alias("area"))
    return found.join(overlay.faults(s, "vec_id", "rings", 4.0), "vec_id").select("vec_id", "area", "valid", F.col("crossings").cast("int").alias("crossings"))
