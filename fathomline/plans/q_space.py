"""Queries of geometry, neighbour joins, components, folds and detector summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fathomline.functions import dates
from fathomline.operators import detectors, models, spatial
from fathomline.operators.graph import components
from fathomline.params import DetectorParams
from fathomline.plans.frames import POINTS, SNAPSHOTS, points, snapshots
from fathomline.plans.registry import query
from fathomline.session import table

PAIR = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"


def two_sides(spark, sf):
    """All points on both sides: a point's neighbours are all others."""
    p = points(spark, sf)
    return p.select("vec_id", "x", "y"), p.select(F.col("vec_id").alias("other_id"), F.col("x").alias("rx"), F.col("y").alias("ry"), "label")


@query("j17_radius_join", f"WITH {POINTS} SELECT a.vec_id, b.vec_id AS other_id, round({PAIR}, 6) AS distance FROM points a JOIN points b ON a.vec_id <> b.vec_id WHERE {PAIR} <= 40")
def _(spark, sf):
    from fathomline.operators.blocks import neighbours_within

    return neighbours_within(*two_sides(spark, sf), "vec_id", "other_id", 40.0, digits=6)


@query("j13_j14_nearest_join", f"WITH {POINTS} SELECT a.vec_id, arg_min(b.vec_id, struct_pack(d := {PAIR}, i := b.vec_id)) AS other_id, round(min({PAIR}), 6) AS distance FROM points a JOIN points b ON a.vec_id <> b.vec_id GROUP BY a.vec_id")
def _(spark, sf):
    left, right = two_sides(spark, sf)
    return spatial.nearest_others(left, right, "vec_id", "other_id", 1, 20.0).select("vec_id", "other_id", F.round("distance", 6).alias("distance"))


@query("j15_inverse_distance_knn", f"WITH {POINTS}, n AS (SELECT a.vec_id, b.label, {PAIR} AS d FROM points a JOIN points b ON a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {PAIR}, b.vec_id) <= 10) SELECT vec_id, round(CASE WHEN min(d) = 0 THEN avg(label) FILTER (WHERE d = 0) ELSE sum(label / d) / sum(1 / d) END, 6) AS predicted FROM n GROUP BY vec_id")
def _(spark, sf):
    left, right = two_sides(spark, sf)
    near = spatial.nearest_others(left, right, "vec_id", "other_id", 10, 40.0)
    return spatial.inverse_distance(near, "vec_id", "label").select("vec_id", F.round("predicted", 6).alias("predicted"))


@query("j16_nearest_centre", f"WITH {POINTS}, c(label, cx, cy) AS (VALUES (1, -150.0, 0.0), (2, 0.0, 100.0), (3, 0.0, -100.0), (4, 150.0, 0.0)) SELECT vec_id, arg_min(c.label, struct_pack(d := sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)), l := c.label)) AS fold FROM points, c GROUP BY vec_id")
def _(spark, sf):
    centres = spark.createDataFrame([(1, -150.0, 0.0), (2, 0.0, 100.0), (3, 0.0, -100.0), (4, 150.0, 0.0)], "fold int, cx double, cy double")
    return spatial.nearest_centre(points(spark, sf), centres, "fold").select("vec_id", "fold")


@query("j18_w06_ranked_candidates", f"WITH {POINTS}, s AS (SELECT a.vec_id, b.vec_id AS candidate, b.label, {PAIR} AS distance, 0.55 * greatest(0, 1 - {PAIR} / 60) + 0.45 * (b.label / 10.0) AS score FROM points a JOIN points b ON a.vec_id <> b.vec_id WHERE {PAIR} <= 60), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, distance, candidate) AS k FROM s), t AS (SELECT * FROM r WHERE k <= 8), b AS (SELECT vec_id, label, score FROM t WHERE k = 1) SELECT t.vec_id, round(any_value(b.score), 6) AS score, round(any_value(b.score) - max(t.score) FILTER (WHERE t.label <> b.label), 6) AS rival_gap FROM t JOIN b USING (vec_id) GROUP BY t.vec_id")
def _(spark, sf):
    left, right = two_sides(spark, sf)
    right = right.withColumnRenamed("other_id", "candidate").withColumn("similarity", F.col("label") / 10.0)
    pairs = spatial.best_candidates(left, right, "vec_id", 60.0, "similarity", others=True)
    gap = spatial.rival_gap(spatial.ranked_candidates(pairs, "vec_id"), "vec_id", "label")
    return gap.select("vec_id", F.round("score", 6).alias("score"), F.round("rival_gap", 6).alias("rival_gap"))


@query("j19_radius_or_nearest", f"WITH {POINTS}, d AS (SELECT a.vec_id, b.vec_id AS other_id, {PAIR} AS distance FROM points a JOIN points b ON a.vec_id <> b.vec_id), m AS (SELECT vec_id, min(distance) AS best, arg_min(other_id, struct_pack(d := distance, i := other_id)) AS first FROM d GROUP BY vec_id) SELECT d.vec_id, d.other_id, round(d.distance, 6) AS distance, best > 15 AS fallback FROM d JOIN m USING (vec_id) WHERE d.distance <= 15 OR (best > 15 AND d.other_id = first)")
def _(spark, sf):
    left, right = two_sides(spark, sf)
    return spatial.radius_or_nearest(left, right, "vec_id", "other_id", 15.0, others=True).select("vec_id", "other_id", F.round("distance", 6).alias("distance"), "fallback")


@query("j20_n05_point_to_line", f"WITH {POINTS}, s AS (SELECT a.vec_id, a.x AS px, a.y AS py, b.x AS ax, b.y AS ay, c.x AS bx, c.y AS by_, ((a.x - b.x) * (c.x - b.x) + (a.y - b.y) * (c.y - b.y)) / ((c.x - b.x) * (c.x - b.x) + (c.y - b.y) * (c.y - b.y)) AS t FROM points a JOIN points b ON b.vec_id = a.vec_id + 1 JOIN points c ON c.vec_id = a.vec_id + 2), f AS (SELECT *, greatest(0, least(1, t)) AS u FROM s) SELECT vec_id, round(sqrt((px - (ax + u * (bx - ax))) ** 2 + (py - (ay + u * (by_ - ay))) ** 2), 6) AS distance FROM f")
def _(spark, sf):
    p = points(spark, sf)
    at = lambda k, n: p.select((F.col("vec_id") - k).alias("vec_id"), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))
    j = at(0, 0).join(at(1, 1), "vec_id").join(at(2, 2), "vec_id")
    line = F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))
    return j.select("vec_id", F.round(spatial.point_polyline(F.col("x0"), F.col("y0"), line)["distance"], 6).alias("distance"))


@query("j21_box_overlap", f"""WITH {POINTS}, b AS (SELECT vec_id, x AS x0, y AS y0, x + 20 AS x1, y + 10 AS y1 FROM points), p AS (SELECT a.vec_id, b.vec_id AS other_id, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS i FROM b a JOIN b ON a.vec_id < b.vec_id)
SELECT vec_id, other_id, round(i, 6) AS intersection, round(i / 200, 6) AS share_of_source, round(i / (400 - i), 6) AS iou FROM p WHERE i > 0""")
def _(spark, sf):
    # Boxes meet only if their corners are within a cell of the larger side.
    p = points(spark, sf).select("vec_id", "x", "y")
    q = p.select(F.col("vec_id").alias("other_id"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    near = spatial.radius_join(p, q, 23.0).where("vec_id < other_id")
    box = lambda x, y: (F.col(x), F.col(y), F.col(x) + 20, F.col(y) + 10)
    o = spatial.box_overlap(box("x", "y"), box("rx", "ry"))
    both = near.withColumn("intersection", o["intersection"]).where("intersection > 0")
    return both.select("vec_id", "other_id", F.round("intersection", 6).alias("intersection"), F.round(o["share_of_source"], 6).alias("share_of_source"), F.round(o["iou"], 6).alias("iou"))


@query("j22_point_in_polygon", f"WITH {POINTS} SELECT vec_id, (y > -100 AND y < 100 AND x > -100 + (y + 100) / 4 AND x < 100 - (y + 100) / 4) AS inside FROM points")
def _(spark, sf):
    corner = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    ring = F.array(corner(-100.0, -100.0), corner(100.0, -100.0), corner(50.0, 100.0), corner(-50.0, 100.0))
    return points(spark, sf).select("vec_id", spatial.in_ring(F.col("x"), F.col("y"), ring).alias("inside"))


@query("n01_n04_projection_and_haversine", f"""WITH {POINTS}, g AS (SELECT vec_id, 114.15 + x / 1000 AS lon, 22.35 + y / 1000 AS lat FROM points)
SELECT vec_id, round((lon - 114.15) * 111320 * cos(radians(22.35)), 4) AS x, round((lat - 22.35) * 110540, 4) AS y, round(2 * 6371 * asin(least(1, sqrt(sin(radians(22.35 - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(22.35)) * sin(radians(114.15 - lon) / 2) ** 2))), 6) AS km FROM g""")
def _(spark, sf):
    g = points(spark, sf).select("vec_id", (114.15 + F.col("x") / 1000).alias("lon"), (22.35 + F.col("y") / 1000).alias("lat"))
    x, y = spatial.to_xy(F.col("lon"), F.col("lat"))
    return g.select("vec_id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"), F.round(spatial.haversine_km(F.col("lon"), F.col("lat"), F.lit(114.15), F.lit(22.35)), 6).alias("km"))


@query("n02_projection_at_median", "WITH g AS (SELECT vec_id, embedding[1]::DOUBLE AS lon, 22 + embedding[2]::DOUBLE AS lat FROM embeddings), m AS (SELECT median(lat) AS m FROM g) SELECT vec_id, round(lon * 111320 * cos(radians(m)), 4) AS x, round(lat * 110540, 4) AS y FROM g, m")
def _(spark, sf):
    g = table(spark, sf, "embeddings").select("vec_id", F.get("embedding", 0).cast("double").alias("lon"), (22 + F.get("embedding", 1).cast("double")).alias("lat"))
    p = spatial.projected_at_median(g, "lon", "lat")
    return p.select("vec_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("n06_polyline_summary", f"WITH {POINTS}, s AS (SELECT label, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM points WINDOW w AS (PARTITION BY label ORDER BY vec_id)), l AS (SELECT *, sqrt((x2 - x) ** 2 + (y2 - y) ** 2) AS d FROM s) SELECT label, round(sum(d), 4) AS length, round(sum(d * (x + x2) / 2) / sum(d), 4) AS centroid_x, round(min(x), 4) AS min_x, count(*)::INTEGER AS vertices FROM l GROUP BY label")
def _(spark, sf):
    lines = points(spark, sf).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("vec_id", "x", "y"))).alias("p"))
    s = lines.withColumn("s", spatial.polyline_summary(F.transform("p", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))))
    return s.select("label", F.round("s.length", 4).alias("length"), F.round("s.centroid_x", 4).alias("centroid_x"), F.round("s.min_x", 4).alias("min_x"), F.col("s.vertices").alias("vertices"))


@query("n09_ring_area", f"WITH {POINTS}, a AS (SELECT vec_id // 4 AS g, list(x ORDER BY vec_id) AS xs, list(y ORDER BY vec_id) AS ys FROM points GROUP BY 1 HAVING count(*) = 4) SELECT g, round(abs(xs[1] * ys[2] - xs[2] * ys[1] + xs[2] * ys[3] - xs[3] * ys[2] + xs[3] * ys[4] - xs[4] * ys[3] + xs[4] * ys[1] - xs[1] * ys[4]) / 2, 4) AS area FROM a")
def _(spark, sf):
    rings = points(spark, sf).groupBy(F.floor(F.col("vec_id") / 4).alias("g")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "x", "y"))).alias("p")).where("size(p) = 4")
    return rings.select("g", F.round(spatial.ring_area(F.transform("p", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))), 4).alias("area"))


@query("n11_n12_wkt_round_trip", f"WITH {POINTS} SELECT vec_id, printf('LINESTRING (%.12f %.12f, %.12f %.12f)', round(x, 3), round(y, 3), round(y, 3), round(x, 3)) AS wkt, 2 AS n_points FROM points")
def _(spark, sf):
    p = points(spark, sf).select("vec_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))
    line = F.array(F.struct(F.col("x").alias("x"), F.col("y").alias("y")), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))
    return p.select("vec_id", spatial.wkt_line(line).alias("wkt")).withColumn("n_points", F.size(spatial.parse_wkt(F.col("wkt"))))


@query("n13_components", "SELECT c_custkey AS node, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS component FROM customer")
def _(spark, sf):
    # Customers linked by a shared nation and segment, in a chain from each to the next: long paths, known components.
    following = F.lead("c_custkey").over(Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("src"), F.coalesce(following, "c_custkey").alias("dst"))
    return components(c)


@query("n13_components_whole")
def _(spark, sf):
    # Orders and parts of every line; part nodes are below zero, order nodes above.
    e = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("long").alias("src"), (-1 - F.col("l_partkey").cast("long")).alias("dst"))
    return components(e)


@query("n14_spatial_folds")
def _(spark, sf):
    g = points(spark, sf).groupBy("label").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).cast("double").alias("weight"))
    return models.spatial_folds(g, 5).select("label", "spatial_fold")


@query("l11_masked_sensors", f"WITH {POINTS}, held AS (SELECT x, y FROM points WHERE label = 3), s AS (SELECT b.vec_id FROM points b WHERE b.label <> 3 AND NOT EXISTS (SELECT 1 FROM held a WHERE {PAIR} <= 10)) SELECT count(*) AS kept FROM s")
def _(spark, sf):
    p = points(spark, sf)
    held = p.where("label = 3").select(F.col("x").alias("rx"), F.col("y").alias("ry"))
    rest = p.where("label <> 3").select("vec_id", "x", "y")
    near = spatial.radius_join(rest, held, 10.0).select("vec_id").distinct()
    return rest.join(near, "vec_id", "left_anti").agg(F.count(F.lit(1)).alias("kept"))


@query("a21_s17_annualise", f"""WITH {SNAPSHOTS}, s AS (SELECT detector_id, year, day_type, time_block, avg(volume) AS m FROM snapshots GROUP BY 1, 2, 3, 4), b AS (SELECT detector_id, year, avg(m) AS balanced_proxy, count(*) AS stratum_count FROM s GROUP BY 1, 2),
c AS (SELECT detector_id, year, lanes, count(*) AS n FROM snapshots GROUP BY 1, 2, 3), md AS (SELECT detector_id, year, min(lanes) AS modal_lanes FROM (SELECT *, max(n) OVER (PARTITION BY detector_id, year) AS best FROM c) WHERE n = best GROUP BY 1, 2),
w AS (SELECT detector_id, year, count(*) AS snapshot_count, count(DISTINCT month) AS distinct_months FROM snapshots GROUP BY 1, 2)
SELECT detector_id, year, snapshot_count, distinct_months, round(balanced_proxy, 6) AS balanced_proxy, stratum_count, modal_lanes, round(snapshot_count / 10.0, 6) AS sample_share, snapshot_count / 10.0 >= 0.8 AND distinct_months >= 5 AND stratum_count = 6 AS qualified FROM w JOIN b USING (detector_id, year) JOIN md USING (detector_id, year)""")
def _(spark, sf):
    out = detectors.annualise(snapshots(spark, sf), DetectorParams(expected_snapshots=10, min_months=5))
    lowest = snapshots(spark, sf).groupBy("detector_id", "year").agg(F.mode("lanes", True).alias("modal_lanes"))
    out = out.drop("modal_lanes").join(lowest, ["detector_id", "year"])
    return out.withColumn("balanced_proxy", F.round("balanced_proxy", 6)).withColumn("sample_share", F.round("sample_share", 6))


@query("a22_day_time_breakdown", f"WITH {SNAPSHOTS} SELECT detector_id, round(avg(volume) FILTER (WHERE day_type = 'weekday'), 6) AS mean_weekday, round(avg(volume) FILTER (WHERE day_type = 'weekend'), 6) AS mean_weekend, round(avg(volume) FILTER (WHERE time_block = 'am'), 6) AS mean_am, round(avg(volume) FILTER (WHERE time_block = 'midday'), 6) AS mean_midday, round(avg(volume) FILTER (WHERE time_block = 'pm'), 6) AS mean_pm FROM snapshots GROUP BY detector_id")
def _(spark, sf):
    d = detectors.day_time_breakdown(snapshots(spark, sf), ["detector_id"])
    return d.select("detector_id", *[F.round(c, 6).alias(c) for c in d.columns[1:]])


@query("v12_archive_gate", f"WITH {SNAPSHOTS} SELECT year, count(*) AS n_found, count(DISTINCT month) AS months, count(DISTINCT day_type || time_block) AS strata, count(*) >= 54 AND count(DISTINCT day_type || time_block) = 6 AS pass FROM snapshots GROUP BY year")
def _(spark, sf):
    return detectors.archive_gate(snapshots(spark, sf).withColumn("status", F.lit("ok")))


@query("e17_pairwise_panel", f"""WITH {SNAPSHOTS}, a AS (SELECT detector_id, year, avg(volume) AS v, count(*) AS n FROM snapshots GROUP BY 1, 2) SELECT c.year, count(*) AS n_pairs, count(*) FILTER (WHERE c.n >= 8 AND p.n >= 8) AS n_supported, round(avg(ln(c.v / p.v)) FILTER (WHERE c.v > 0 AND p.v > 0), 6) AS mean_log_ratio FROM a c JOIN a p ON c.detector_id = p.detector_id AND c.year = p.year + 1 GROUP BY c.year""")
def _(spark, sf):
    from fathomline.operators.panel import consecutive

    a = snapshots(spark, sf).groupBy("detector_id", "year").agg(F.avg("volume").alias("v"), F.count(F.lit(1)).alias("n"))
    c = consecutive(a, ["detector_id"], "year", ["v", "n"])
    good = (F.col("v_current") > 0) & (F.col("v_previous") > 0)
    return c.groupBy("year").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if((F.col("n_current") >= 8) & (F.col("n_previous") >= 8)).alias("n_supported"), F.round(F.avg(F.when(good, F.log(F.col("v_current") / F.col("v_previous")))), 6).alias("mean_log_ratio"))


@query("e18_stable_panel", f"WITH {SNAPSHOTS} SELECT detector_id, count(DISTINCT year) AS years FROM snapshots GROUP BY detector_id HAVING count(DISTINCT year) = 5")
def _(spark, sf):
    return snapshots(spark, sf).groupBy("detector_id").agg(F.count_distinct("year").alias("years")).where("years = 5")


@query("d01_d04_sampling_design", """WITH d AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS s FROM orders),
t AS (SELECT s, (s + ((9 - isodow(s)) % 7)::INTEGER + 7)::DATE AS tue, (s + ((13 - isodow(s)) % 7)::INTEGER + 7)::DATE AS sat FROM d),
u AS (SELECT s, tue AS day, 'weekday' AS day_type FROM t UNION ALL SELECT s, sat, 'weekend' FROM t),
n AS (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1)
SELECT year(s)::INTEGER AS year, month(s)::INTEGER AS month, strftime(u.day, '%Y-%m-%d') AS sample_date, day_type, h::INTEGER AS requested_hour, CASE WHEN h < 10 THEN 'am' WHEN h < 16 THEN 'midday' ELSE 'pm' END AS time_block, coalesce(n.n, 0) AS n_orders
FROM u LEFT JOIN n ON n.day = u.day, (VALUES (8), (13), (18)) v(h)""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    months = o.select(F.year("day").alias("year"), F.month("day").alias("month")).distinct()
    on_day = o.groupBy(F.col("day").alias("sample_date")).agg(F.count(F.lit(1)).alias("n_orders"))
    d = dates.sampling_days(months, (8, 13, 18)).join(on_day, "sample_date", "left").na.fill(0, ["n_orders"])
    return d.withColumn("sample_date", F.date_format("sample_date", "yyyy-MM-dd")).select("year", "month", "sample_date", "day_type", "requested_hour", "time_block", "n_orders")


@query("stream_hourly_batch", "SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, user_id AS detector_id, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2")
def _(spark, sf):
    from fathomline.streaming.detectors import hourly

    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("detector_id"), F.col("value").alias("volume"))
    return hourly(e, streaming=False).withColumn("mean_value", F.round("mean_value", 6)).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


def _pairs_of_points(spark, sf):
    p = points(spark, sf)
    nxt = p.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    line = F.array(F.struct(F.col("x").alias("x"), F.col("y").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))
    return p.join(nxt, "vec_id").select("vec_id", line.alias("line"))


@query("n07_points_along_lines", f"WITH {POINTS} SELECT a.vec_id, round((a.x + b.x) / 2, 6) AS x, round((a.y + b.y) / 2, 6) AS y FROM points a JOIN points b ON b.vec_id = a.vec_id + 1")
def _(spark, sf):
    from fathomline.operators.lines import with_point_along

    m = with_point_along(_pairs_of_points(spark, sf), "line", 0.5)
    return m.select("vec_id", F.round("along.x", 6).alias("x"), F.round("along.y", 6).alias("y"))


def _near_sql(line: str) -> str:
    """Rows (keys, ux, uy, share) of segments a-b with those within 12 of c-d; ``line`` gives the keys, ax to dy."""
    return f"""v AS (SELECT *, bx - ax AS ux, by_ - ay AS uy, ax - cx AS wx, ay - cy AS wy, ax - dx AS zx, ay - dy AS zy, dx - cx AS vx, dy - cy AS vy FROM ({line})),
q AS (SELECT *, ux * ux + uy * uy AS uu, vx * vx + vy * vy AS vv, (ux * wx + uy * wy) ** 2 - (ux * ux + uy * uy) * (wx * wx + wy * wy - 144) AS lw, (ux * zx + uy * zy) ** 2 - (ux * ux + uy * uy) * (zx * zx + zy * zy - 144) AS lz FROM v),
k AS (SELECT *, (0 - (wx * vx + wy * vy)) / (ux * vx + uy * vy) AS s1, (vv - (wx * vx + wy * vy)) / (ux * vx + uy * vy) AS s2, (-12 * sqrt(vv) - (vx * wy - vy * wx)) / (vx * uy - vy * ux) AS n1, (12 * sqrt(vv) - (vx * wy - vy * wx)) / (vx * uy - vy * ux) AS n2 FROM q),
e AS (SELECT *, unnest([CASE WHEN lw >= 0 THEN greatest(0, (-(ux * wx + uy * wy) - sqrt(greatest(lw, 0))) / uu) ELSE 2 END, CASE WHEN lz >= 0 THEN greatest(0, (-(ux * zx + uy * zy) - sqrt(greatest(lz, 0))) / uu) ELSE 2 END, greatest(0, least(s1, s2), least(n1, n2))]) AS lo,
  unnest([CASE WHEN lw >= 0 THEN least(1, (-(ux * wx + uy * wy) + sqrt(greatest(lw, 0))) / uu) ELSE -1 END, CASE WHEN lz >= 0 THEN least(1, (-(ux * zx + uy * zy) + sqrt(greatest(lz, 0))) / uu) ELSE -1 END, least(1, greatest(s1, s2), greatest(n1, n2))]) AS hi FROM k)"""


@query("n10_overlap_share", f"""WITH {POINTS}, {_near_sql("SELECT a.vec_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, b.x AS cx, b.y AS cy, c.x AS dx, c.y AS dy FROM points a JOIN points b ON b.vec_id = a.vec_id + 1 JOIN points c ON c.vec_id = a.vec_id + 2")}
SELECT vec_id, round(coalesce(max(hi) FILTER (WHERE hi > lo) - min(lo) FILTER (WHERE hi > lo), 0) * sqrt(any_value(uu)) / greatest(sqrt(any_value(uu)), 1), 6) AS overlap_share FROM e GROUP BY vec_id""")
def _(spark, sf):
    from fathomline.operators.lines import overlap_share

    lines = _pairs_of_points(spark, sf)
    other = lines.select((F.col("vec_id") - 1).alias("vec_id"), F.col("line").alias("other"))
    return lines.join(other, "vec_id").select("vec_id", F.round(overlap_share(F.col("line"), F.col("other"), 12.0), 6).alias("overlap_share"))


def _end_sql(p: str, a: str, b: str) -> str:
    """Distance of a point to a segment; each of the three is the letter of its columns."""
    (px, py), (ax, ay), (bx, by) = ([f"{c}x", "by_" if c == "b" else f"{c}y"] for c in (p, a, b))
    t = f"greatest(0, least(1, (({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / (({bx} - {ax}) ** 2 + ({by} - {ay}) ** 2)))"
    return f"sqrt(({px} - ({ax} + {t} * ({bx} - {ax}))) ** 2 + ({py} - ({ay} + {t} * ({by} - {ay}))) ** 2)"


def _turn_sql(a: str, b: str, p: str) -> str:
    (px, py), (ax, ay), (bx, by) = ([f"{c}x", "by_" if c == "b" else f"{c}y"] for c in (p, a, b))
    return f"(({bx} - {ax}) * ({py} - {ay}) - ({by} - {ay}) * ({px} - {ax}))"


@query("j20_line_match", f"""WITH {POINTS}, p AS (SELECT a.vec_id, b.vec_id AS candidate, (a.label = b.label)::DOUBLE AS name, a.x AS ax, a.y AS ay, a.x + 20 AS bx, a.y + a.label AS by_, b.x AS cx, b.y AS cy, b.x + 20 AS dx, b.y + b.label AS dy FROM points a JOIN points b ON a.vec_id <> b.vec_id),
near AS (SELECT *, CASE WHEN {_turn_sql("a", "b", "c")} * {_turn_sql("a", "b", "d")} < 0 AND {_turn_sql("c", "d", "a")} * {_turn_sql("c", "d", "b")} < 0 THEN 0 ELSE least({_end_sql("a", "c", "d")}, {_end_sql("b", "c", "d")}, {_end_sql("c", "a", "b")}, {_end_sql("d", "a", "b")}) END AS distance FROM p),
{_near_sql("SELECT * FROM near WHERE distance <= 60")},
g AS (SELECT vec_id, candidate, any_value(name) AS name, round(any_value(distance), 9) AS distance, round(coalesce(max(hi) FILTER (WHERE hi > lo) - min(lo) FILTER (WHERE hi > lo), 0), 9) AS overlap FROM e GROUP BY 1, 2),
s AS (SELECT *, round(2.5 * overlap + 0.75 * name - 0.30 * distance / 60, 9) AS score FROM g)
SELECT vec_id, candidate, round(distance, 6) AS distance, round(overlap, 6) AS overlap, round(score, 6) AS score, CASE WHEN distance <= 15 AND (overlap >= 0.5 OR name >= 0.5) THEN 'high' WHEN (distance <= 30 AND (overlap >= 0.2 OR name >= 0.25)) OR distance <= 8 THEN 'moderate' ELSE 'low' END AS status FROM s
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, overlap DESC, name DESC, distance, candidate) = 1""")
def _(spark, sf):
    from fathomline.operators import lines
    from fathomline.operators.matching import OURS, THEIRS, best_segment_matches

    p = points(spark, sf)
    ends = (F.col("x"), F.col("y"), F.col("x") + 20, F.col("y") + F.col("label"))
    left = p.select("vec_id", F.col("label").alias("name"), *[e.alias(c) for e, c in zip(ends, OURS)])
    right = p.select(F.col("vec_id").alias("candidate"), F.col("label").alias("other_name"), *[e.alias(c) for e, c in zip(ends, THEIRS)])
    best = best_segment_matches(left, right, "vec_id", "candidate", 60.0, 12.0)
    if not p.where("label IS NULL").isEmpty():
        best = lines.best_match(best.unionByName(_matches_without_label(p)), "vec_id", "candidate")
    # Of nine digits one number in a thousand is a half of the sixth: the product is rounded, as SQL does.
    return best.select("vec_id", "candidate", *[(F.round(F.col(c) * 1e6) / 1e6).alias(c) for c in ("distance", "overlap", "score")], lines.match_status(F.col("distance"), F.col("overlap"), F.col("name_similarity")).alias("status"))


def _matches_without_label(p):
    """Best matches of the pairs in which a label, and so the height of a line's end, is null: their scores are null and come last."""
    from fathomline.operators import lines

    line = F.array(F.struct("x", "y"), F.struct((F.col("x") + 20).alias("x"), (F.col("y") + F.col("label")).alias("y")))
    left = p.select("vec_id", "label", line.alias("line"))
    right = p.select(F.col("vec_id").alias("candidate"), F.col("label").alias("other_label"), line.alias("other"))
    some = lines.line_join(left.where("label IS NULL"), right, "line", "other", 60.0).unionByName(lines.line_join(left.where("label IS NOT NULL"), right.where("other_label IS NULL"), "line", "other", 60.0))
    pairs = some.where("vec_id <> candidate")
    same = pairs.withColumn("overlap", F.round(lines.overlap_share_near(F.col("line"), F.col("other"), F.col("distance"), 12.0), 9)).withColumn("distance", F.round("distance", 9)).withColumn("name_similarity", (F.col("label") == F.col("other_label")).cast("double"))
    scored = same.withColumn("score", F.round(lines.match_score(F.col("overlap"), F.col("name_similarity"), F.col("distance")), 9))
    return lines.best_match(scored, "vec_id", "candidate").select("vec_id", "candidate", "distance", "overlap", "name_similarity", "score")


@query("j22_polygon_join", f"""WITH {POINTS}, c AS (SELECT label AS unit, round(avg(x), 3) AS cx, round(avg(y), 3) AS cy FROM points GROUP BY label),
m AS (SELECT vec_id, unit, sqrt(greatest(abs(x - cx) - 40, 0) ** 2 + greatest(abs(y - cy) - 40, 0) ** 2) AS distance FROM points, c),
b AS (SELECT * FROM m WHERE distance <= 30 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, unit) = 1)
SELECT p.vec_id, b.unit, round(b.distance, 6) AS distance, CASE WHEN b.unit IS NULL THEN 'outside' WHEN b.distance = 0 THEN 'within' ELSE 'nearest' END AS method FROM points p LEFT JOIN b USING (vec_id)""")
def _(spark, sf):
    # A square of side 80 around each label's mean point; squares overlap, the first one by label counts.
    p = points(spark, sf)
    c = p.groupBy(F.col("label").alias("unit")).agg(F.round(F.avg("x"), 3).alias("cx"), F.round(F.avg("y"), 3).alias("cy"))
    ring = F.array(*[F.struct((F.col("cx") + dx).alias("x"), (F.col("cy") + dy).alias("y")) for dx, dy in ((-40, -40), (40, -40), (40, 40), (-40, 40))])
    found = spatial.polygon_join(p, c.select("unit", ring.alias("ring")), "vec_id", "unit", "ring", 30.0, 80.0)
    return found.withColumn("distance", F.round("distance", 6))


@query("j20_best_line_match", f"WITH {POINTS}, c AS (SELECT a.vec_id, b.vec_id AS candidate, {PAIR} AS distance, b.label / 10.0 AS overlap, a.label / 10.0 AS name FROM points a JOIN points b ON a.vec_id <> b.vec_id WHERE {PAIR} <= 60), s AS (SELECT *, 2.5 * overlap + 0.75 * name - 0.30 * distance / 60 AS score FROM c) SELECT vec_id, candidate, round(score, 6) AS score, CASE WHEN distance <= 15 AND (overlap >= 0.5 OR name >= 0.5) THEN 'high' WHEN (distance <= 30 AND (overlap >= 0.2 OR name >= 0.25)) OR distance <= 8 THEN 'moderate' ELSE 'low' END AS status FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, overlap DESC, name DESC, distance, candidate) = 1")
def _(spark, sf):
    from fathomline.operators import lines
    from fathomline.operators.blocks import best_within, first_of_copies

    p = points(spark, sf)
    other = p.select(F.col("vec_id").alias("candidate"), F.col("x").alias("rx"), F.col("y").alias("ry"), (F.col("label") / 10.0).alias("overlap"))
    own = p.select("vec_id", "x", "y", (F.col("label") / 10.0).alias("name_similarity"))
    pairs = best_within(own, first_of_copies(other, "candidate", 2), "vec_id", "candidate", 60.0, 1, lines.order_of_matches, others=True)
    scored = pairs.withColumn("score", lines.match_score(F.col("overlap"), F.col("name_similarity"), F.col("distance")))
    best = lines.best_match(scored, "vec_id", "candidate")
    return best.select("vec_id", "candidate", F.round("score", 6).alias("score"), lines.match_status(F.col("distance"), F.col("overlap"), F.col("name_similarity")).alias("status"))


@query("j21_convex_overlap", f"""WITH {POINTS}, p AS (SELECT a.vec_id, b.vec_id AS other_id, abs((a.x - b.x) + (a.y - b.y)) AS u, abs((a.x - b.x) - (a.y - b.y)) AS v FROM points a JOIN points b ON a.vec_id < b.vec_id AND {PAIR} <= 20)
SELECT vec_id, other_id, round(greatest(0, 20 - u) * greatest(0, 20 - v) / 2, 6) AS area FROM p""")
def _(spark, sf):
    from fathomline.operators.blocks import pairs_within
    from fathomline.operators.overlay import shared_area

    diamond = lambda x, y: F.array(*[F.struct((F.col(x) + dx).alias("x"), (F.col(y) + dy).alias("y")) for dx, dy in ((-10.0, 0.0), (0.0, -10.0), (10.0, 0.0), (0.0, 10.0))])
    p = points(spark, sf).select("vec_id", "x", "y").withColumn("a", diamond("x", "y"))
    q = p.select(F.col("vec_id").alias("other_id"), F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("a").alias("b"))
    return pairs_within(p, q, "vec_id", "other_id", 20.0, "area", shared_area("a", "b")).withColumn("area", F.round("area", 6))


@query("j23_greedy_assignment")
def _(spark, sf):
    from fathomline.operators.assignment import assign_among

    return assign_among(points(spark, sf), "vec_id", "other_id", 25.0)
