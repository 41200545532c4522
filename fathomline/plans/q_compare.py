"""Queries that compare models, studies and changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.operators import comparison
from fathomline.operators.panel import changed_any, consecutive
from fathomline.plans.frames import OOF, PANEL, STATIONS, out_of_fold, panel, stations
from fathomline.plans.q_stats import rounded
from fathomline.plans.registry import query
from fathomline.session import table


@query("e06_paired_intervals", f"""WITH {OOF}, d AS (SELECT a.station_id, a.fold, a.segment, abs(a.predicted - a.observed) AS c, abs(b.predicted - b.observed) AS r FROM oof a JOIN oof b ON a.station_id = b.station_id AND a.model = 'hierarchy' AND b.model = 'median'),
s AS (SELECT 'all' AS subset, * FROM d UNION ALL SELECT 'building', * FROM d WHERE segment = 'BUILDING' UNION ALL SELECT 'not_building', * FROM d WHERE segment <> 'BUILDING'),
f AS (SELECT subset, fold, avg(c) AS c, avg(r) AS r, sum(c - r) AS s, count(*) AS n FROM s GROUP BY 1, 2),
x AS (SELECT a.subset, (a.s + b.s + e.s + g.s + h.s) / (a.n + b.n + e.n + g.n + h.n) AS x FROM f a JOIN f b USING (subset) JOIN f e USING (subset) JOIN f g USING (subset) JOIN f h USING (subset)),
i AS (SELECT subset, quantile_cont(x, 0.025) AS low, quantile_cont(x, 0.975) AS high FROM x GROUP BY 1), w AS (SELECT subset, count(*) FILTER (WHERE c < r) AS improved_folds, count(*) AS folds FROM f GROUP BY 1),
m AS (SELECT subset, count(*) AS n, avg(c) AS cm, avg(r) AS rm, avg(c - r) AS difference FROM s GROUP BY 1)
SELECT 'hierarchy' AS candidate, 'median' AS reference, subset, n, round(cm, 4) AS candidate_mae, round(rm, 4) AS reference_mae, improved_folds, folds, round(low, 4) AS low, round(high, 4) AS high, round(difference, 4) AS difference, round(100.0 * (rm - cm) / rm, 4) AS improvement_percent
FROM m JOIN i USING (subset) JOIN w USING (subset)""")
def _(spark, sf):
    building = F.col("segment") == "BUILDING"
    return rounded(comparison.paired_comparisons(out_of_fold(spark, sf), "station_id", [("hierarchy", "median")], {"all": F.lit(True), "building": building, "not_building": ~building}, 5))


@query("e24_deployability", f"""WITH {OOF}, m AS (SELECT model, avg(abs(predicted - observed)) AS mae, avg(abs(predicted - observed)) FILTER (WHERE segment = 'BUILDING') AS b, avg(abs(predicted - observed)) FILTER (WHERE segment <> 'BUILDING') AS o,
  100 * sum(predicted - observed) FILTER (WHERE segment = 'BUILDING') / sum(observed) FILTER (WHERE segment = 'BUILDING') AS bb, 100 * sum(predicted - observed) FILTER (WHERE segment <> 'BUILDING') / sum(observed) FILTER (WHERE segment <> 'BUILDING') AS ob FROM oof GROUP BY model),
k(model, deployable, feature_count, interpretation) AS (VALUES ('median', true, 0, 'eligible_for_deployment_gate'), ('hierarchy', true, 2, 'eligible_for_deployment_gate'), ('oracle', false, 5, 'oracle_diagnostic_not_deployment_evidence'))
SELECT k.*, round(mae, 4) AS pooled_mae, round(b, 4) AS building_mae, round(o, 4) AS other_mae, round(bb, 4) AS building_bias_percent, round(ob, 4) AS other_bias_percent, round(100.0 * ((SELECT mae FROM m WHERE model = 'median') - mae) / (SELECT mae FROM m WHERE model = 'median'), 4) AS improvement_percent FROM k LEFT JOIN m USING (model)""")
def _(spark, sf):
    building = F.col("segment") == "BUILDING"
    models = {"median": (True, 0), "hierarchy": (True, 2), "oracle": (False, 5)}
    return rounded(comparison.deployability(out_of_fold(spark, sf), models, "median", {"building": building, "other": ~building}))


@query("e25_comparability", f"""WITH {PANEL}, {STATIONS}, a AS (SELECT DISTINCT station_id, segment, fold FROM panel JOIN stations USING (station_id) WHERE year = 1996), b AS (SELECT DISTINCT station_id, segment, fold FROM panel JOIN stations USING (station_id) WHERE year = 1998),
o AS (SELECT station_id FROM a INTERSECT SELECT station_id FROM b), ax AS (SELECT a.*, station_id IN (SELECT station_id FROM o) AS shared FROM a), bx AS (SELECT b.*, station_id IN (SELECT station_id FROM o) AS shared FROM b)
SELECT 'unique_units' AS dimension, (SELECT count(*) FROM ax) AS first_value, (SELECT count(*) FROM bx) AS second_value UNION ALL SELECT 'units_in_both', (SELECT count(*) FROM ax WHERE shared), (SELECT count(*) FROM bx WHERE shared)
UNION ALL SELECT 'building_count', (SELECT count(*) FROM ax WHERE segment = 'BUILDING'), (SELECT count(*) FROM bx WHERE segment = 'BUILDING') UNION ALL SELECT 'building_in_overlap', (SELECT count(*) FROM ax WHERE shared AND segment = 'BUILDING'), (SELECT count(*) FROM bx WHERE shared AND segment = 'BUILDING')
UNION ALL SELECT 'first_fold_count', NULL, (SELECT count(*) FROM bx WHERE fold = 1) UNION ALL SELECT 'first_fold_in_overlap', NULL, (SELECT count(*) FROM bx WHERE shared AND fold = 1)""")
def _(spark, sf):
    p = panel(spark, sf).join(stations(spark, sf), "station_id")
    building = F.col("segment") == "BUILDING"
    return comparison.comparability(p.where("year = 1996"), p.where("year = 1998"), "station_id", {"building": (building, building), "first_fold": (None, F.col("fold") == 1)})


@query("e14_change_alignment", f"""WITH {PANEL}, {STATIONS}, t AS (SELECT o_custkey AS station_id, year(o_orderdate)::INTEGER AS year, arg_min(o_orderpriority, o_orderkey) AS tag FROM orders GROUP BY 1, 2), p AS (SELECT panel.*, tag FROM panel JOIN t USING (station_id, year)),
c AS (SELECT a.station_id, a.year, abs(a.aadt - b.aadt) AS d, a.tag <> b.tag AS changed FROM p a JOIN p b ON a.station_id = b.station_id AND a.year = b.year + 1),
g AS (SELECT 'all' AS "group", * FROM c UNION ALL SELECT 'since_1996', * FROM c WHERE year >= 1996 UNION ALL SELECT 'none', * FROM c WHERE year < 0)
SELECT x."group", count(g.station_id) AS pairs, count(*) FILTER (WHERE changed) AS changed, round(avg(d) FILTER (WHERE changed), 4) AS mean_abs_change_with, round(avg(d) FILTER (WHERE NOT changed), 4) AS mean_abs_change_without, round(sum(d) FILTER (WHERE NOT changed) / sum(d), 6) AS share_without_change
FROM (SELECT unnest(['all', 'since_1996', 'none']) AS "group") x LEFT JOIN g ON g."group" = x."group" GROUP BY 1""")
def _(spark, sf):
    tags = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("station_id"), F.year("o_orderdate").alias("year")).agg(F.min_by("o_orderpriority", "o_orderkey").alias("tag"))
    pairs = consecutive(panel(spark, sf).join(tags, ["station_id", "year"]), ["station_id"], "year", ["aadt", "tag"])
    groups = {"all": F.lit(True), "since_1996": F.col("year") >= 1996, "none": F.col("year") < 0}
    found = comparison.change_alignment(pairs, "aadt_previous", "aadt_current", changed_any([("tag_previous", "tag_current")]), groups)
    return rounded(found, share_without_change=6)
