"""Queries of evaluation beyond one split, support tiers, audits, the national grid and small predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.operators import evaluation, projection, spatial
from fathomline.plans.frames import OOF, PANEL, POINTS, SNAPSHOTS, STATIONS, out_of_fold, panel, points, snapshots, stations
from fathomline.plans.q_stats import rounded
from fathomline.plans.registry import query
from fathomline.session import materialize, table

FOLDS, TARGETS = [1, 2, 3, 4, 5], [1997, 1998]

FUTURE = f"""{PANEL}, {STATIONS},
b AS (SELECT p.station_id, p.year, p.aadt, s.fold, s.segment, s.bal FROM panel p JOIN stations s USING (station_id)),
tr AS (SELECT h.held, t.target, b.* FROM b, (SELECT unnest([1, 2, 3, 4, 5]) AS held) h, (SELECT unnest([1997, 1998]) AS target) t WHERE b.fold <> h.held AND b.year < t.target),
cell AS (SELECT held, target, segment, median(aadt) AS v FROM tr GROUP BY 1, 2, 3), whole AS (SELECT held, target, median(aadt) AS v FROM tr GROUP BY 1, 2),
fut AS (SELECT b.station_id, b.year, b.fold, b.segment, b.bal, b.aadt AS observed, coalesce(cell.v, whole.v) AS predicted FROM b JOIN whole ON whole.held = b.fold AND whole.target = b.year
  LEFT JOIN cell ON cell.held = b.fold AND cell.target = b.year AND cell.segment = b.segment)"""


def future(spark, sf):
    b = panel(spark, sf).select("station_id", "year", F.col("aadt").alias("observed")).join(stations(spark, sf), "station_id")
    return evaluation.future_fold_predictions(materialize(b, "panel"), "fold", FOLDS, "year", TARGETS, "segment", "observed")


@query("e02_future_year_folds", f"WITH {FUTURE} SELECT station_id, year, fold, observed, round(predicted, 4) AS predicted FROM fut")
def _(spark, sf):
    return rounded(future(spark, sf).select("station_id", "year", "fold", "observed", "predicted"))


@query("e07_change_pairs", f"""WITH {FUTURE}, c AS (SELECT a.station_id, a.year, a.observed - b.observed AS o, a.predicted - b.predicted AS p FROM fut a JOIN fut b ON a.station_id = b.station_id AND a.year = b.year + 1)
SELECT station_id, year, round(o, 4) AS observed_change, round(p, 4) AS predicted_change, round(abs(p - o), 4) AS absolute_error, round(abs(o), 4) AS no_change_error, round(abs(p - o) - abs(o), 4) + 0.0 AS difference_to_no_change FROM c""")
def _(spark, sf):
    return rounded(evaluation.change_pairs(future(spark, sf), ["station_id"], "year"))


@query("e09_rescore", f"""WITH {OOF}, q AS (SELECT model, quantile_cont(predicted, 0.75) AS q FROM oof GROUP BY model),
s AS (SELECT model, avg(abs(predicted - observed)) AS mae, sqrt(avg((predicted - observed) ** 2)) AS rmse, 1 - sum((predicted - observed) ** 2) / (var_pop(observed) * count(*)) AS r2, 100.0 * sum(predicted - observed) / sum(observed) AS bias,
  100.0 * sum(predicted - observed) FILTER (WHERE predicted > q) / sum(observed) FILTER (WHERE predicted > q) AS top FROM oof JOIN q USING (model) GROUP BY model)
SELECT s.model, round(s.mae, 4) AS mae, round(s.rmse, 4) AS rmse, round(s.r2, 6) AS r2, round(s.bias, 4) AS bias_percent, round(s.top, 4) AS top_quarter_bias_percent, round(100.0 * (s.mae - b.mae) / b.mae, 4) + 0.0 AS mae_change_percent,
  100.0 * (s.mae - b.mae) / b.mae <= 2 AS mae_not_degraded, s.rmse < b.rmse AS rmse_improved, s.r2 > b.r2 AS r2_improved, abs(s.bias) < abs(b.bias) AS bias_improved FROM s, s b WHERE b.model = 'median'""")
def _(spark, sf):
    return rounded(evaluation.rescore(out_of_fold(spark, sf), "model", "median"), r2=6)


UNITS = f"{FUTURE}, u AS (SELECT year, fold, segment, count(*) AS members, avg(observed) AS observed, avg(predicted) AS predicted, avg(bal) AS income FROM fut GROUP BY 1, 2, 3)"


@query("e10_unit_validation", f"""WITH {UNITS}, r AS (SELECT *, rank() OVER (PARTITION BY year ORDER BY observed) + (count(*) OVER (PARTITION BY year, observed) - 1) / 2.0 AS ro, rank() OVER (PARTITION BY year ORDER BY predicted) + (count(*) OVER (PARTITION BY year, predicted) - 1) / 2.0 AS rp FROM u)
SELECT year, count(*) AS units, sum(members)::BIGINT AS members, count(*) FILTER (WHERE members = 1) AS single_units, max(members) AS largest_unit, round(avg(abs(predicted - observed)), 4) AS mae, round(100 * avg(abs(predicted - observed)) / avg(observed), 4) AS mae_percent,
  round(100 * (avg(predicted) - avg(observed)) / avg(observed), 4) AS bias_percent, round(100 * (sum(predicted * members) / sum(members) - sum(observed * members) / sum(members)) / (sum(observed * members) / sum(members)), 4) AS weighted_bias_percent,
  round(corr(observed, predicted), 6) AS pearson, count(*) FILTER (WHERE abs(predicted - observed) / observed <= 0.2) AS within_20_percent, count(*) FILTER (WHERE abs(predicted - observed) / observed > 0.5) AS over_50_percent, round(corr(ro, rp), 6) AS spearman FROM r GROUP BY year""")
def _(spark, sf):
    units = materialize(evaluation.unit_means(future(spark, sf), ["year"], ["fold", "segment"]), "units")
    return rounded(evaluation.unit_validation(units, ["year"]), pearson=6, spearman=6)


@query("e11_income_contrast", f"""WITH {UNITS}, e AS (SELECT year, list_sort(list_distinct([quantile_cont(income, 0.0), quantile_cont(income, 0.2), quantile_cont(income, 0.4), quantile_cont(income, 0.6), quantile_cont(income, 0.8), quantile_cont(income, 1.0)])) AS e FROM u GROUP BY year),
m AS (SELECT year, len(list_filter(list_slice(e, 2, len(e) - 1), lambda x: income > x)) + 1 AS bin, count(*) AS units, avg(observed) AS mean FROM u JOIN e USING (year) GROUP BY 1, 2),
d AS (SELECT year, count(*) FILTER (WHERE up) AS ups, count(*) FILTER (WHERE down) AS downs, count(*) AS steps FROM (SELECT year, mean > lag(mean) OVER w AS up, mean < lag(mean) OVER w AS down FROM m WINDOW w AS (PARTITION BY year ORDER BY bin)) WHERE up IS NOT NULL GROUP BY year)
SELECT year, bin, units, round(mean, 4) AS mean, round(first_value(mean) OVER w - last_value(mean) OVER w, 4) AS lowest_minus_highest, CASE WHEN ups = steps THEN 'increasing' WHEN downs = steps THEN 'decreasing' ELSE 'not_monotonic' END AS shape
FROM m JOIN d USING (year) WINDOW w AS (PARTITION BY year ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def _(spark, sf):
    f = future(spark, sf)
    units = f.groupBy("year", "fold", "segment").agg(F.avg("observed").alias("observed"), F.avg("bal").alias("income"))
    c = evaluation.bin_contrast(materialize(units, "units"), ["year"], "observed", "income")
    return rounded(c.withColumn("bin", F.col("bin").cast("long")))


@query("m19_unit_bootstrap", f"""WITH {STATIONS}, a AS (SELECT segment AS g, avg(bal) AS v FROM stations WHERE segment IN ('BUILDING', 'MACHINERY') GROUP BY fold, segment),
u AS (SELECT g, v, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (PARTITION BY g ORDER BY v) - 1 AS i FROM a),
p AS (SELECT d, g, (('0x' || substr(md5('42:' || d || ':' || g || ':' || i), 1, 8))::BIGINT * n) >> 32 AS i FROM u, range(1, 2001) AS t(d)),
m AS (SELECT d, avg(v) FILTER (WHERE g = 'BUILDING') AS lowest, avg(v) FILTER (WHERE g = 'MACHINERY') AS highest FROM p JOIN u USING (g, i) GROUP BY d),
w AS (SELECT avg(v) FILTER (WHERE g = 'BUILDING') AS lowest, avg(v) FILTER (WHERE g = 'MACHINERY') AS highest FROM a),
l AS (SELECT unnest(['lowest', 'highest', 'difference']) AS what, unnest([lowest, highest, lowest - highest]) AS v FROM m), e AS (SELECT unnest(['lowest', 'highest', 'difference']) AS what, unnest([lowest, highest, lowest - highest]) AS estimate FROM w)
SELECT what, round(any_value(estimate), 4) AS estimate, round(quantile_cont(v, 0.025), 4) AS low, round(quantile_cont(v, 0.975), 4) AS high FROM l JOIN e USING (what) GROUP BY what""")
def _(spark, sf):
    units = stations(spark, sf).groupBy("fold", "segment").agg(F.avg("bal").alias("income"))
    return rounded(evaluation.unit_bootstrap(units, "income", "segment", "BUILDING", "MACHINERY"))


NEAR = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"


@query("e19_l15_support_audit", f"""WITH {POINTS}, anchors AS (SELECT * FROM points WHERE label = 0), bound AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM anchors),
n AS (SELECT a.vec_id, a.x, a.y, a.label, min({NEAR}) / 30 AS km FROM points a, anchors b GROUP BY ALL), s AS (SELECT vec_id, label = 0 AS direct, km, (x < x0 OR x > x1)::INTEGER + (y < y0 OR y > y1)::INTEGER AS ex FROM n, bound),
t AS (SELECT *, CASE WHEN direct THEN 'observed_anchor_route' WHEN km <= 1 AND ex = 0 THEN 'within_1km_in_range' WHEN km <= 3 AND ex <= 1 THEN 'within_3km_limited_exceedance' ELSE 'sparse_or_extrapolative_support' END AS tier, CASE WHEN km <= 1 THEN 'within_1km' WHEN km <= 3 THEN '1_to_3km' WHEN km <= 5 THEN '3_to_5km' ELSE 'over_5km' END AS band FROM s),
l AS (SELECT unnest(['tier', 'distance', 'exceedances']) AS dimension, unnest([tier, band, ex::VARCHAR]) AS category FROM t)
SELECT dimension, category, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM t), 6) AS percent FROM l GROUP BY 1, 2""")
def _(spark, sf):
    p = points(spark, sf)
    anchors = p.where("label = 0")
    right = anchors.select(F.col("vec_id").alias("other_id"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    near = spatial.nearest_join(p.select("vec_id", "x", "y", "label"), right, "vec_id", "other_id", 1, 20.0).withColumn("km", F.col("distance") / 30)
    rows = evaluation.range_exceedances(near, anchors, ["x", "y"])
    tier = evaluation.support_tier((F.col("label") == 0).cast("int"), F.col("km"), F.col("exceedances"))
    return rounded(evaluation.support_audit(rows.withColumn("tier", tier), "tier", "km", "exceedances"), 6)


@query("l15_full_fit", f"WITH {PANEL}, {STATIONS}, m AS (SELECT segment, avg(aadt) - 180000 AS v FROM panel JOIN stations USING (station_id) WHERE year = 1998 GROUP BY segment) SELECT station_id, round(greatest(v, 1.0), 4) AS prediction, round(v, 4) + 0.0 AS raw_prediction FROM stations JOIN m USING (segment)")
def _(spark, sf):
    s = stations(spark, sf)
    fit = panel(spark, sf).where("year = 1998").join(s, "station_id").groupBy("segment").agg((F.avg("aadt") - 180000).alias("v"))
    return rounded(s.join(fit, "segment").select("station_id", *evaluation.floored(F.col("v"))))


@query("e20_feature_coverage", """SELECT feature, count(*) FILTER (WHERE set) AS n, round(100.0 * avg(set::INTEGER), 6) AS percent FROM (SELECT unnest(['l_discount', 'l_tax', 'l_quantity']) AS feature, unnest([l_discount <> 0, l_tax <> 0.05, l_quantity <> 50]) AS set FROM lineitem) GROUP BY feature""")
def _(spark, sf):
    return rounded(evaluation.feature_coverage(table(spark, sf, "lineitem"), {"l_discount": 0.0, "l_tax": 0.05, "l_quantity": 50.0}), 6)


@query("e22_direction_audit", """WITH p AS (SELECT l_returnflag, least(l_partkey::VARCHAR, l_suppkey::VARCHAR) AS lo, greatest(l_partkey::VARCHAR, l_suppkey::VARCHAR) AS hi, count(*) AS n, (max(l_quantity) - min(l_quantity)) / avg(l_quantity) AS s FROM lineitem GROUP BY 1, 2, 3),
m AS (SELECT sum(n)::DOUBLE AS a, count(*)::DOUBLE AS b, count(*) FILTER (WHERE n >= 2)::DOUBLE AS c, coalesce(sum(n) FILTER (WHERE n >= 2), 0)::DOUBLE AS d, count(*) FILTER (WHERE n >= 2 AND s > 0)::DOUBLE AS e, max(s) FILTER (WHERE n >= 2) AS f FROM p)
SELECT unnest(['rows', 'pairs', 'repeated_pairs', 'rows_in_repeated_pairs', 'pairs_that_differ', 'largest_spread']) AS metric, round(unnest([a, b, c, d, e, f]), 6) AS value FROM m""")
def _(spark, sf):
    return rounded(evaluation.direction_audit(table(spark, sf, "lineitem"), "l_returnflag", "l_partkey", "l_suppkey", "l_quantity"), 6)


@query("m02_change_check", f"""WITH {PANEL}, c AS (SELECT a.station_id, a.year, b.aadt AS p, a.aadt AS c, CASE WHEN a.n_obs > 1 THEN round(100 * (a.aadt - b.aadt) / b.aadt, 1) + (a.n_obs % 3) * 0.5 END AS r FROM panel a JOIN panel b ON a.station_id = b.station_id AND a.year = b.year + 1)
SELECT station_id, year, CASE WHEN r IS NULL THEN 'not_checkable' WHEN r BETWEEN (greatest(c - 5, 0) - (p + 5)) / (p + 5) * 100 - 0.15 AND (c + 5 - greatest(p - 5, 1)) / greatest(p - 5, 1) * 100 + 0.15 THEN 'consistent_with_rounded_values' ELSE 'outside_rounded_range' END AS change_check FROM c""")
def _(spark, sf):
    from fathomline.operators.panel import consecutive

    c = consecutive(panel(spark, sf), ["station_id"], "year", ["aadt", "n_obs"])
    reported = F.when(F.col("n_obs_current") > 1, F.round(100 * (F.col("aadt_current") - F.col("aadt_previous")) / F.col("aadt_previous"), 1) + (F.col("n_obs_current") % 3) * 0.5)
    return c.select("station_id", "year", evaluation.change_check(F.col("aadt_previous"), F.col("aadt_current"), reported).alias("change_check"))


@query("m10_block_ratio", f"WITH {SNAPSHOTS}, w AS (SELECT detector_id, coalesce(sum(volume) FILTER (WHERE time_block = 'am'), 0) AS a, coalesce(sum(volume) FILTER (WHERE time_block = 'pm'), 0) AS p, sum(volume) AS v FROM snapshots GROUP BY detector_id) SELECT detector_id, round((a + p) / nullif(v, 0), 6) AS ratio FROM w")
def _(spark, sf):
    of = lambda block: F.sum(F.when(F.col("time_block") == block, F.col("volume")))
    w = snapshots(spark, sf).groupBy("detector_id").agg(of("am").alias("am"), of("pm").alias("pm"), F.sum("volume").alias("v"))
    return rounded(w.select("detector_id", evaluation.sum_ratio([F.col("am"), F.col("pm")], F.col("v")).alias("ratio")), 6)


@query("p11_p14_p18_predicates", """SELECT l_orderkey, l_linenumber, (l_returnflag, l_linestatus) IN (('A', 'F'), ('N', 'O')) AS listed, (l_quantity <= 25 AND l_discount >= 0.15) OR l_quantity <= 5 AS small, l_tax > 0.02 AS e0, l_tax > 0.02 AND l_discount > 0.03 AS e1, l_tax > 0.02 AND l_discount > 0.03 AND l_quantity > 10 AS e2,
  (l_extendedprice / 400 <= 100 AND l_discount >= 0.15) OR l_extendedprice / 400 <= 25 AS credible FROM lineitem""")
def _(spark, sf):
    e0 = F.col("l_tax") > 0.02
    e1 = e0 & (F.col("l_discount") > 0.03)
    small = ((F.col("l_quantity") <= 25) & (F.col("l_discount") >= 0.15)) | (F.col("l_quantity") <= 5)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", evaluation.is_one_of(["l_returnflag", "l_linestatus"], [("A", "F"), ("N", "O")]).alias("listed"), small.alias("small"),
        e0.alias("e0"), e1.alias("e1"), (e1 & (F.col("l_quantity") > 10)).alias("e2"), evaluation.credible_sensor(F.col("l_extendedprice") / 400, F.col("l_discount")).alias("credible"),
    )


@query("v14_not_estimable", """WITH x AS (SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'cluster_interval_includes_zero|change_correlation_not_positive' WHEN c_acctbal > 0 THEN 'change_correlation_not_positive|too_small|too_small' ELSE '' END AS f, c_nationkey AS k, CASE WHEN c_acctbal > 2000 THEN c_acctbal END AS r FROM customer)
SELECT c_custkey, CASE WHEN f = '' THEN '' WHEN f LIKE 'cluster%' THEN (CASE WHEN k < 2 THEN 'insufficient_clusters_for_interval' ELSE 'cluster_interval_includes_zero' END) || '|' || (CASE WHEN r IS NULL THEN 'change_correlation_not_estimable' ELSE 'change_correlation_not_positive' END)
  ELSE (CASE WHEN r IS NULL THEN 'change_correlation_not_estimable' ELSE 'change_correlation_not_positive' END) || '|too_small' END AS failed FROM x""")
def _(spark, sf):
    b = F.col("c_acctbal")
    failed = F.when(b > 5000, "cluster_interval_includes_zero|change_correlation_not_positive").when(b > 0, "change_correlation_not_positive|too_small|too_small").otherwise("")
    return table(spark, sf, "customer").select("c_custkey", evaluation.not_estimable(failed, F.col("c_nationkey"), F.when(b > 2000, b)).alias("failed"))


@query("n15_nested_points", """WITH x AS (SELECT vec_id, round(embedding[1]::DOUBLE, 3) AS a, round(embedding[2]::DOUBLE, 3) AS b FROM embeddings) SELECT vec_id, 3 AS n, a + 1 + 2 AS sum_x, b + 2 + 7 AS sum_y FROM x""")
def _(spark, sf):
    a, b = (F.round(F.get("embedding", i).cast("double"), 3) for i in (0, 1))
    v = table(spark, sf, "embeddings").select("vec_id", a.alias("a"), b.alias("b"))
    written = F.concat(F.lit("[[["), F.col("a").cast("string"), F.lit(", "), F.col("b").cast("string"), F.lit(",9.5],[1,2]],[[2e0 , 7.0]]]"))
    p = v.select("vec_id", evaluation.nested_points(written).alias("p"))
    add = lambda c: F.aggregate("p", F.lit(0.0), lambda acc, x: acc + x[c])
    return p.select("vec_id", F.size("p").alias("n"), F.round(add("x"), 3).alias("sum_x"), F.round(add("y"), 3).alias("sum_y"))


@query("j24_by_place", """WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS r FROM customer), b AS (SELECT c_name, row_number() OVER (ORDER BY c_name DESC) AS r FROM customer) SELECT c_custkey, c_name FROM a JOIN b USING (r)""")
def _(spark, sf):
    c = table(spark, sf, "customer")
    return evaluation.by_place(c.select("c_custkey", "c_acctbal"), c.select("c_name"), [F.col("c_acctbal"), F.col("c_custkey")], [F.desc("c_name")]).select("c_custkey", "c_name")


GEOGRAPHIC = "(SELECT vec_id, 114.1 + embedding[1]::DOUBLE / 10 AS lon, 22.3 + embedding[2]::DOUBLE / 10 AS lat FROM embeddings)"


@query("n03_national_grid", f"SELECT vec_id, round(easting, 3) AS easting, round(northing, 3) AS northing FROM {projection.steps_sql(GEOGRAPHIC, projection.grid_steps('lon', 'lat'))}")
def _(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", (114.1 + F.get("embedding", 0).cast("double") / 10).alias("lon"), (22.3 + F.get("embedding", 1).cast("double") / 10).alias("lat"))
    return rounded(projection.to_grid(v, "lon", "lat").select("vec_id", "easting", "northing"), 3)
