"""Bindings of the operators' roles to the provided tables, with the same frames as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.session import materialize, table


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """station_id, year, aadt (rounded sums of order prices), n_obs."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    return o.groupBy(F.col("o_custkey").alias("station_id"), F.year("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("aadt"), F.count(F.lit(1)).alias("n_obs"))


PANEL = "panel AS (SELECT o_custkey AS station_id, year(o_orderdate)::INTEGER AS year, round(sum(o_totalprice), 2) AS aadt, count(*) AS n_obs FROM orders GROUP BY 1, 2)"


def stations(spark: SparkSession, sf: str) -> DataFrame:
    """station_id, fold (region + 1), segment, bal, route (many orders or not is left to the queries)."""
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    n = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").alias("station_id"), (F.col("n_regionkey") + 1).cast("int").alias("fold"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("bal")
    )


STATIONS = "stations AS (SELECT c_custkey AS station_id, (n_regionkey + 1)::INTEGER AS fold, c_mktsegment AS segment, c_acctbal AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def training(spark: SparkSession, sf: str) -> DataFrame:
    """One row per station of 1998: fold, route flag, extent (orders before 1998), aadt."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("station_id"), F.year("o_orderdate").alias("year"), "o_totalprice")
    # One pass over the orders: this year's value and the earlier rows beside each other.
    now = F.when(F.col("year") == 1998, F.col("o_totalprice"))
    per = o.groupBy("station_id").agg(F.round(F.sum(now), 2).alias("aadt"), F.count_if(F.col("year") < 1998).cast("double").alias("extent")).where("aadt IS NOT NULL AND extent > 0")
    return per.join(stations(spark, sf), "station_id").select("station_id", "fold", (F.col("bal") > 5000).alias("route"), "extent", "aadt", "segment")


TRAINING = f"""{PANEL}, {STATIONS},
training AS (
  SELECT p.station_id, s.fold, s.bal > 5000 AS route, e.extent, p.aadt, s.segment
  FROM (SELECT station_id, aadt FROM panel WHERE year = 1998) p JOIN stations s USING (station_id)
  JOIN (SELECT station_id, sum(n_obs)::DOUBLE AS extent FROM panel WHERE year < 1998 GROUP BY 1) e USING (station_id))"""

#: Out-of-fold predictions of the fold median and of the hierarchy lookup, in SQL.
OOF = f"""{TRAINING},
folds AS (SELECT unnest([1, 2, 3, 4, 5]) AS held),
opened AS (SELECT t.*, f.held, t.fold = f.held AS is_test FROM training t, folds f),
med AS (SELECT held, median(aadt) AS m FROM opened WHERE NOT is_test GROUP BY held),
edges AS (SELECT held, list_sort(list_distinct([quantile_cont(extent, 0.0), quantile_cont(extent, 0.2), quantile_cont(extent, 0.4), quantile_cont(extent, 0.6), quantile_cont(extent, 0.8), quantile_cont(extent, 1.0)])) AS e FROM opened WHERE NOT is_test GROUP BY held),
binned AS (SELECT o.*, len(list_filter(list_slice(e, 2, len(e) - 1), lambda x: o.extent > x)) + 1 AS b FROM opened o JOIN edges USING (held)),
l0 AS (SELECT held, route, b, median(aadt) AS v FROM binned WHERE NOT is_test GROUP BY 1, 2, 3),
l1 AS (SELECT held, route, median(aadt) AS v FROM binned WHERE NOT is_test GROUP BY 1, 2),
oof AS (
  SELECT station_id, fold, segment, 'median' AS model, aadt AS observed, m AS predicted FROM training JOIN med ON held = fold
  UNION ALL
  SELECT x.station_id, x.fold, x.segment, 'hierarchy', x.aadt, coalesce(l0.v, l1.v, med.m)
  FROM binned x LEFT JOIN l0 ON l0.held = x.held AND l0.route = x.route AND l0.b = x.b
  LEFT JOIN l1 ON l1.held = x.held AND l1.route = x.route JOIN med ON med.held = x.held WHERE x.is_test)"""


def out_of_fold(spark: SparkSession, sf: str) -> DataFrame:
    from fathomline.operators.models import out_of_fold_hierarchy, out_of_fold_median

    # Written once: medians, edges and cells of all folds read one row per station, not the orders again.
    t, folds = materialize(training(spark, sf), "training"), [1, 2, 3, 4, 5]
    keep = ["station_id", "fold", "segment"]
    a = out_of_fold_median(t, "fold", folds, "aadt").select(*keep, F.lit("median").alias("model"), F.col("aadt").alias("observed"), F.col("prediction").alias("predicted"))
    b = out_of_fold_hierarchy(t, "fold", folds, "aadt", "route", "extent").select(*keep, F.lit("hierarchy").alias("model"), F.col("aadt").alias("observed"), F.col("prediction").alias("predicted"))
    return materialize(a.unionByName(b), "oof")


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """events as detector snapshots: week of month stands for the year, day of month for the month."""
    e = table(spark, sf, "events").select("user_id", "ts", "value", "event_type")
    hhmm = F.hour("ts") * 100 + F.minute("ts")
    return e.select(
        F.col("user_id").alias("detector_id"), (F.floor((F.dayofmonth("ts") - 1) / 7) + 1).cast("int").alias("year"), F.dayofmonth("ts").alias("month"),
        F.when(F.weekday("ts") < 5, "weekday").otherwise("weekend").alias("day_type"), F.when(hhmm < 1000, "am").when(hhmm < 1600, "midday").otherwise("pm").alias("time_block"),
        F.col("value").alias("volume"), F.length("event_type").alias("lanes"), "ts",
    )


SNAPSHOTS = """snapshots AS (
  SELECT user_id AS detector_id, ((day(ts) - 1) // 7 + 1)::INTEGER AS year, day(ts)::INTEGER AS month,
    CASE WHEN isodow(ts) < 6 THEN 'weekday' ELSE 'weekend' END AS day_type,
    CASE WHEN hour(ts) * 100 + minute(ts) < 1000 THEN 'am' WHEN hour(ts) * 100 + minute(ts) < 1600 THEN 'midday' ELSE 'pm' END AS time_block,
    value AS volume, length(event_type)::INTEGER AS lanes, ts FROM events)"""


def points(spark: SparkSession, sf: str) -> DataFrame:
    """Two coordinates of each embedding, in units of a thousandth."""
    v = table(spark, sf, "embeddings")
    return v.select("vec_id", (F.get("embedding", 0).cast("double") * 1000).alias("x"), (F.get("embedding", 1).cast("double") * 1000).alias("y"), "label")


POINTS = "points AS (SELECT vec_id, embedding[1]::DOUBLE * 1000 AS x, embedding[2]::DOUBLE * 1000 AS y, label FROM embeddings)"
