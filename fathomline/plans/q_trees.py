"""Queries of boosted trees: out-of-fold predictions, refits without a feature, bootstrap refits."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.operators import boosting
from fathomline.plans.frames import PANEL, panel, stations, training
from fathomline.plans.q_stats import rounded
from fathomline.plans.registry import query
from fathomline.session import materialize, table

FEATURES = ["extent", "route", "balance", "segment_no"]
FOLDS = [1, 2, 3, 4, 5]


def featured(spark, sf, rows):
    """Features of stations: the balance is missing where it is below zero, the segment is numbered by its first letter."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("station_id"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"), F.ascii("c_mktsegment").cast("double").alias("segment_no"))
    return rows.join(c, "station_id")


def labelled(spark, sf):
    # Written once: bins, fits and predictions read one row per station, not the orders again.
    rows = training(spark, sf).select("station_id", "fold", "segment", "extent", F.col("route").cast("double").alias("route"), "aadt")
    return materialize(featured(spark, sf, rows), "trees")


def predicted(spark, sf, loss):
    t = labelled(spark, sf)
    return boosting.out_of_fold(t, "fold", FOLDS, "aadt", FEATURES, boosting.BoostParams(loss=loss)).select("station_id", "fold", "prediction")


@query("l04_l06_boosted_trees")
def _(spark, sf):
    return predicted(spark, sf, "absolute")


@query("l05_poisson_model")
def _(spark, sf):
    return predicted(spark, sf, "poisson")


@query("l05_squared_trees")
def _(spark, sf):
    return predicted(spark, sf, "squared")


@query("l12_drop_one")
def _(spark, sf):
    return rounded(boosting.drop_one(labelled(spark, sf), "fold", FOLDS, "aadt", FEATURES))


@query("l14_without_feature")
def _(spark, sf):
    t = labelled(spark, sf)
    return rounded(boosting.without_feature(t, t, "aadt", FEATURES, "segment_no", "segment"))


def yearly(spark, sf):
    """Stations with a value in 1996, 1997 and 1998; extent counts orders before 1996."""
    p = panel(spark, sf).where("year BETWEEN 1992 AND 1998")
    of = lambda y: F.max(F.when(F.col("year") == y, F.col("aadt"))).alias(f"aadt_{y}")
    wide = p.groupBy("station_id").agg(*[of(y) for y in (1996, 1997, 1998)], F.sum(F.when(F.col("year") < 1996, F.col("n_obs"))).cast("double").alias("extent"))
    routes = stations(spark, sf).select("station_id", "segment", (F.col("bal") > 5000).cast("double").alias("route"))
    return materialize(featured(spark, sf, wide.join(routes, "station_id")), "yearly")


@query("m20_refit_noise")
def _(spark, sf):
    network = yearly(spark, sf)
    t = network.where("aadt_1996 IS NOT NULL AND aadt_1997 IS NOT NULL AND aadt_1998 IS NOT NULL")
    targets = {y: f"aadt_{y}" for y in (1996, 1997, 1998)}
    return rounded(boosting.refit_noise(t, network, "station_id", FEATURES, targets, [(1996, 1997), (1997, 1998)], 1997))


@query("m20_resample_counts", f"""WITH {PANEL}, s AS (SELECT station_id FROM panel WHERE year IN (1996, 1997, 1998) GROUP BY 1 HAVING count(*) = 3),
u AS (SELECT d AS draw, ('0x' || substr(md5('42|' || d || '|' || station_id), 1, 10))::BIGINT / 1099511627776.0 AS u FROM s, range(60) AS t(d)),
c(k, p) AS (SELECT i, sum(exp(-1) / [1, 1, 2, 6, 24, 120, 720, 5040][i + 1]) OVER (ORDER BY i) FROM range(8) AS t(i)),
w AS (SELECT draw, (SELECT count(*) FROM c WHERE u.u >= c.p) AS w FROM u)
SELECT draw::INTEGER AS draw, count(*) AS n, sum(w)::BIGINT AS drawn, count(*) FILTER (WHERE w = 0) AS left_out, max(w)::INTEGER AS most FROM w GROUP BY draw""")
def _(spark, sf):
    t = panel(spark, sf).where("year IN (1996, 1997, 1998)").groupBy("station_id").count().where("count = 3")
    each = t.select("station_id", F.explode(F.sequence(F.lit(0), F.lit(59))).alias("draw")).withColumn("w", boosting.drawn(F.col("station_id"), F.col("draw")))
    return each.groupBy("draw").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("drawn"), F.count_if(F.col("w") == 0).alias("left_out"), F.max("w").alias("most"))
