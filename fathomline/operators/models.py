"""Folds, out-of-fold frames and predictors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.operators.graph import components
from fathomline.operators.panel import fallback_lookup
from fathomline.operators.stats import bin_of, quantile_edges


def support_groups(memberships: DataFrame, member: str, shared: str) -> DataFrame:
    """Members joined by shared supports, transitively: (member, group, n_members).

    Edges run from each support to its smallest member, so a hub adds one edge per member.
    """
    low = memberships.groupBy(shared).agg(F.min(member).alias("_low"))
    edges = memberships.join(low, shared).select(F.col(member).alias("src"), F.col("_low").alias("dst")).distinct()
    found = components(edges).withColumnRenamed("node", member).withColumnRenamed("component", "group")
    return found.withColumn("n_members", F.count(F.lit(1)).over(Window.partitionBy("group")))


def spatial_folds(groups: DataFrame, folds: int = 5, seed: int = 42) -> DataFrame:
    """Weighted k-means on group centroids (x, y, weight); folds numbered 1.. from west to east."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    ready = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(groups)
    model = KMeans(k=folds, seed=seed, weightCol="weight", maxIter=50).fit(ready)
    centres = sorted(range(folds), key=lambda i: (model.clusterCenters()[i][0], i)) if len(model.clusterCenters()) == folds else list(range(len(model.clusterCenters())))
    number = F.lit(None).cast("int")
    for place, label in enumerate(centres, 1):
        number = F.when(F.col("prediction") == label, F.lit(place)).otherwise(number)
    return model.transform(ready).withColumn("spatial_fold", number).drop("features", "prediction")


def held_out_frames(df: DataFrame, fold: str, folds: list[int]) -> DataFrame:
    """Each row once per held-out fold, with is_test; rows grow by the number of folds, a constant."""
    return df.withColumn("held", F.explode(F.array(*[F.lit(f) for f in folds]))).withColumn("is_test", F.col(fold) == F.col("held"))


def fold_medians(df: DataFrame, fold: str, folds: list[int], value: str) -> DataFrame:
    """Training median per held-out fold: (held, prediction)."""
    return held_out_frames(df, fold, folds).where("NOT is_test").groupBy("held").agg(F.median(value).alias("prediction"))


def out_of_fold_median(df: DataFrame, fold: str, folds: list[int], value: str) -> DataFrame:
    return df.join(fold_medians(df, fold, folds, value).withColumnRenamed("held", fold), fold)


def out_of_fold_hierarchy(df: DataFrame, fold: str, folds: list[int], value: str, route: str, extent: str, bins: int = 5) -> DataFrame:
    """Route flag x extent bin medians with training-only edges; coarser cells, then the global median, where one is missing."""
    opened = held_out_frames(df, fold, folds)
    edges = quantile_edges(opened.where("NOT is_test"), extent, bins, ["held"])
    binned = opened.join(edges, "held").withColumn("extent_bin", bin_of(F.col(extent), F.col("edges"))).drop("edges")
    train, test = binned.where("NOT is_test"), binned.where("is_test")
    levels = [["held", route, "extent_bin"], ["held", route], ["held"]]
    return fallback_lookup(test, train, levels, value, "prediction").drop("held", "is_test")


def fold_wins(errors: DataFrame, fold: str, model: str, metric: str, candidate: str, reference: str) -> DataFrame:
    """Folds in which the candidate's metric is below the reference's."""
    wide = errors.groupBy(fold).agg(F.max(F.when(F.col(model) == candidate, F.col(metric))).alias("c"), F.max(F.when(F.col(model) == reference, F.col(metric))).alias("r"))
    return wide.agg(F.count_if(F.col("c") < F.col("r")).alias("fold_wins"), F.count(F.lit(1)).alias("n_folds"))


def persistence(df: DataFrame, key: str, period: str, value: str) -> DataFrame:
    """Value of the previous period, exactly one step before."""
    before = df.select(key, (F.col(period) + 1).alias(period), F.col(value).alias("persistence"))
    return df.join(before, [key, period])


def expanding_mean(df: DataFrame, key: str, period: str, value: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(period).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("expanding_mean", F.avg(value).over(w))


def scaled_by_factor(base: Column, factor: Column, residual: Column | None = None, clip: tuple[Column, Column] | None = None, floor: float = 1.0) -> Column:
    """base x factor, times exp of a clipped residual, at least the floor."""
    out = base * factor
    if residual is not None:
        r = F.least(F.greatest(residual, clip[0]), clip[1]) if clip else residual
        out = out * F.exp(r)
    return F.greatest(out, F.lit(floor))


def leave_fold_out_factor(ratios: DataFrame, fold: str, folds: list[int], ratio: str) -> DataFrame:
    """Median ratio from all other folds, per held-out fold."""
    return held_out_frames(ratios, fold, folds).where("NOT is_test").groupBy("held").agg(F.median(ratio).alias("factor"))


def transfer_matrix(predictions: DataFrame, observed: DataFrame, key: str, trained: str, period: str) -> DataFrame:
    """Mean absolute error of each training year's predictions against every year's values."""
    return predictions.join(observed, key).groupBy(trained, period).agg(F.avg(F.abs(F.col("prediction") - F.col("observed"))).alias("mae"), F.count(F.lit(1)).alias("n"))
