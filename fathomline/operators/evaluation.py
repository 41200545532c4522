"""Evaluation beyond one split: future years, change pairs, areas, contrasts, support tiers, coverage, audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.operators import stats
from fathomline.operators.panel import consecutive


def future_fold_predictions(df: DataFrame, fold: str, folds: list[int], period: str, targets: list[int], level: str, value: str) -> DataFrame:
    """Rows of the target periods with a prediction from earlier periods of other folds only: the median of the row's
    level, or of all where the level was never seen. Rows grow by folds x targets, a constant."""
    opened = df.withColumn("_held", F.explode(F.array(*map(F.lit, folds)))).withColumn("_target", F.explode(F.array(*map(F.lit, targets))))
    train = opened.where((F.col(fold) != F.col("_held")) & (F.col(period) < F.col("_target")))
    cells = train.groupBy("_held", "_target", level).agg(F.median(value).alias("_cell"))
    whole = train.groupBy("_held", "_target").agg(F.median(value).alias("_whole"))
    test = df.where(F.col(period).isin(targets)).withColumn("_held", F.col(fold)).withColumn("_target", F.col(period))
    met = test.join(whole, ["_held", "_target"]).join(cells, ["_held", "_target", level], "left")
    return met.withColumn("predicted", F.coalesce("_cell", "_whole")).drop("_held", "_target", "_cell", "_whole")


def change_pairs(oof: DataFrame, key: list[str], period: str) -> DataFrame:
    """Observed and predicted changes between consecutive periods of out-of-fold rows, and errors against no change."""
    pairs = consecutive(oof, key, period, ["observed", "predicted"])
    pairs = pairs.withColumn("observed_change", F.col("observed_current") - F.col("observed_previous")).withColumn("predicted_change", F.col("predicted_current") - F.col("predicted_previous"))
    error, still = F.abs(F.col("predicted_change") - F.col("observed_change")), F.abs("observed_change")
    return pairs.select(*key, period, "observed_change", "predicted_change", error.alias("absolute_error"), still.alias("no_change_error"), (error - still).alias("difference_to_no_change"))


def rescore(oof: DataFrame, model: str, base: str, tolerance_percent: float = 2.0) -> DataFrame:
    """Models on errors that a lucky loss cannot hide, the bias of the highest predicted quarter among them, and
    whether each beats the base model."""
    edges = oof.groupBy(model).agg(F.percentile("predicted", F.lit(0.75)).alias("_q"))
    top = F.col("predicted") > F.col("_q")
    share = lambda rows: F.try_divide(100.0 * F.sum(F.when(rows, F.col("predicted") - F.col("observed"))), F.sum(F.when(rows, F.col("observed"))))
    error = F.col("predicted") - F.col("observed")
    scores = oof.join(edges, model).groupBy(model).agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (1 - F.sum(error * error) / (F.var_pop("observed") * F.count(F.lit(1)))).alias("r2"),
        share(F.lit(True)).alias("bias_percent"),
        share(top).alias("top_quarter_bias_percent"),
    )
    reference = scores.where(F.col(model) == base).select(*[F.col(c).alias(f"base_{c}") for c in ("mae", "rmse", "r2", "bias_percent")])
    met = scores.crossJoin(F.broadcast(reference))  # one row
    change = 100.0 * (F.col("mae") - F.col("base_mae")) / F.col("base_mae")
    return met.withColumns({
        "mae_change_percent": change, "mae_not_degraded": change <= tolerance_percent, "rmse_improved": F.col("rmse") < F.col("base_rmse"),
        "r2_improved": F.col("r2") > F.col("base_r2"), "bias_improved": F.abs("bias_percent") < F.abs("base_bias_percent"),
    }).drop("base_mae", "base_rmse", "base_r2", "base_bias_percent")


def unit_means(df: DataFrame, by: list[str], unit: list[str], least: int = 1) -> DataFrame:
    """Mean observed and predicted value of each unit with enough rows."""
    means = df.groupBy(*by, *unit).agg(F.count(F.lit(1)).alias("members"), F.avg("observed").alias("observed"), F.avg("predicted").alias("predicted"))
    return means.where(F.col("members") >= least)


def unit_validation(units: DataFrame, by: list[str]) -> DataFrame:
    """How well units are predicted: errors, biases by unit and by member, correlations, shares near and far off."""
    off = F.abs(F.col("predicted") - F.col("observed"))
    weighed = lambda c: F.sum(F.col(c) * F.col("members")) / F.sum("members")
    summary = units.groupBy(*by).agg(
        F.count(F.lit(1)).alias("units"), F.sum("members").alias("members"), F.count_if(F.col("members") == 1).alias("single_units"), F.max("members").alias("largest_unit"), F.avg(off).alias("mae"),
        (100 * F.avg(off) / F.avg("observed")).alias("mae_percent"), (100 * (F.avg("predicted") - F.avg("observed")) / F.avg("observed")).alias("bias_percent"),
        (100 * (weighed("predicted") - weighed("observed")) / weighed("observed")).alias("weighted_bias_percent"), stats.pearson("observed", "predicted").alias("pearson"),
        F.count_if(off / F.col("observed") <= 0.2).alias("within_20_percent"), F.count_if(off / F.col("observed") > 0.5).alias("over_50_percent"),
    )
    return summary.join(stats.spearman(units, "observed", "predicted", by).select(*by, "spearman"), by)


def bin_contrast(units: DataFrame, by: list[str], value: str, of: str, bins: int = 5) -> DataFrame:
    """Means of a value over quantile bins of another, lowest minus highest bin, and the shape of the gradient."""
    binned = units.join(stats.quantile_edges(units, of, bins, by), by).withColumn("bin", stats.bin_of(F.col(of), F.col("edges")))
    means = binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("units"), F.avg(value).alias("mean"))
    listed = means.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "mean"))), lambda x: x["mean"]).alias("_means"))  # one entry a bin
    step = lambda up: F.forall(F.sequence(F.lit(1), F.size("_means") - 1), lambda i: (F.get("_means", i) > F.get("_means", i - 1)) if up else (F.get("_means", i) < F.get("_means", i - 1)))
    shape = F.when(F.size("_means") < 2, "one_bin").when(step(True), "increasing").when(step(False), "decreasing").otherwise("not_monotonic")
    lowest = listed.select(*by, (F.get("_means", 0) - F.get("_means", F.size("_means") - 1)).alias("lowest_minus_highest"), shape.alias("shape"))
    return means.join(lowest, by)


def unit_bootstrap(df: DataFrame, value: str, group: str, low: str, high: str, draws: int = 2000, seed: int = 42) -> DataFrame:
    """(what, estimate, low, high): intervals of both groups' means and of their difference; units of each group are
    drawn with replacement.

    Draw d takes n slots in a group; a slot's unit comes from md5 of (seed, d, group, slot). Units are numbered per group and
    joined to slots by number, so no draw is gathered; a group of units is a table of areas, not of rows of data.
    """
    from pyspark.sql import Window

    units = df.where(F.col(group).isin(low, high) & F.col(value).isNotNull()).select(F.col(group).cast("string").alias("_g"), F.col(value).alias("_v"))
    units = units.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("_g"))).withColumn("_i", F.row_number().over(Window.partitionBy("_g").orderBy("_v")) - 1)
    slots = units.select("_g", "_n", F.col("_i").alias("_slot")).withColumn("_draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "_draw", "_g", "_slot")), 1, 8), 16, 10).cast("long")
    slots = slots.withColumn("_i", F.shiftright(digest * F.col("_n"), 32).cast("int"))
    means = slots.join(units.select("_g", "_i", "_v"), ["_g", "_i"]).groupBy("_draw").agg(*[F.avg(F.when(F.col("_g") == str(g), F.col("_v"))).alias(n) for g, n in ((low, "lowest"), (high, "highest"))])
    means = means.withColumn("difference", F.col("lowest") - F.col("highest")).unpivot(["_draw"], ["lowest", "highest", "difference"], "what", "v")
    whole = units.agg(*[F.avg(F.when(F.col("_g") == str(g), F.col("_v"))).alias(n) for g, n in ((low, "lowest"), (high, "highest"))])
    whole = whole.withColumn("difference", F.col("lowest") - F.col("highest")).unpivot([], ["lowest", "highest", "difference"], "what", "estimate")
    return means.groupBy("what").agg(F.percentile("v", F.lit(0.025)).alias("low"), F.percentile("v", F.lit(0.975)).alias("high")).join(whole, "what").select("what", "estimate", "low", "high")


def range_exceedances(rows: DataFrame, train: DataFrame, features: list[str], out: str = "exceedances") -> DataFrame:
    """How many features lie outside the training range."""
    bounds = train.agg(*[f(c).alias(f"_{n}_{c}") for c in features for n, f in (("lo", F.min), ("hi", F.max))])
    counted = reduce(lambda a, b: a + b, [((F.col(c) < F.col(f"_lo_{c}")) | (F.col(c) > F.col(f"_hi_{c}"))).cast("int") for c in features])
    return rows.crossJoin(F.broadcast(bounds)).withColumn(out, counted).select(*rows.columns, out)  # one row of bounds


def support_tier(direct: Column, distance_km: Column, exceedances: Column) -> Column:
    return (
        F.when(direct > 0, "observed_anchor_route").when((distance_km <= 1.0) & (exceedances == 0), "within_1km_in_range")
        .when((distance_km <= 3.0) & (exceedances <= 1), "within_3km_limited_exceedance").otherwise("sparse_or_extrapolative_support")
    )


def support_audit(df: DataFrame, tier: str, distance_km: str, exceedances: str) -> DataFrame:
    """(dimension, category, n, percent) over tiers, distance bands and exceedance counts."""
    d = F.col(distance_km)
    band = F.when(d <= 1, "within_1km").when(d <= 3, "1_to_3km").when(d <= 5, "3_to_5km").otherwise("over_5km")
    long = df.select(F.col(tier).alias("tier"), band.alias("distance"), F.col(exceedances).cast("string").alias("exceedances")).unpivot([], ["tier", "distance", "exceedances"], "dimension", "category")
    counted = long.groupBy("dimension", "category").agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return counted.crossJoin(F.broadcast(total)).select("dimension", "category", "n", (100.0 * F.col("n") / F.col("_total")).alias("percent"))


def floored(prediction: Column, floor: float = 1.0) -> tuple[Column, Column]:
    """A full-fit prediction as (reported with the floor, raw)."""
    return F.greatest(prediction, F.lit(floor)).alias("prediction"), prediction.alias("raw_prediction")


def feature_coverage(df: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """(feature, n, percent) of values other than the feature's default; missing ones count as 0."""
    cells = [F.struct(F.lit(f).alias("feature"), (F.coalesce(F.col(f).try_cast("double"), F.lit(0.0)) != d).alias("set")) for f, d in defaults.items()]
    opened = df.select(F.inline(F.array(*cells)))
    return opened.groupBy("feature").agg(F.count_if("set").alias("n"), (100.0 * F.avg(F.col("set").cast("double"))).alias("percent"))


def direction_audit(links: DataFrame, route: str, start: str, end: str, value: str) -> DataFrame:
    """(metric, value): rows, undirected pairs with two records or more, and the spread of values inside them."""
    u, v = F.col(start).cast("string"), F.col(end).cast("string")
    pairs = links.groupBy(F.col(route).alias("r"), F.least(u, v).alias("lo"), F.greatest(u, v).alias("hi")).agg(
        F.count(F.lit(1)).alias("n"), F.try_divide(F.max(value) - F.min(value), F.when(F.avg(value) > 0, F.avg(value))).alias("spread")
    )
    many = F.col("n") >= 2
    out = pairs.agg(
        F.sum("n").cast("double").alias("rows"), F.count(F.lit(1)).cast("double").alias("pairs"), F.count_if(many).cast("double").alias("repeated_pairs"), F.sum(F.when(many, F.col("n")).otherwise(0)).cast("double").alias("rows_in_repeated_pairs"),
        F.count_if(many & (F.col("spread") > 0)).cast("double").alias("pairs_that_differ"), F.max(F.when(many, F.col("spread"))).alias("largest_spread"),
    )
    return out.unpivot([], out.columns, "metric", "value")


def change_check(previous: Column, current: Column, reported: Column, rounding: float = 5.0, slack: float = 0.15) -> Column:
    """Whether a reported percent change could come from two rounded values."""
    low = (F.greatest(current - rounding, F.lit(0.0)) - (previous + rounding)) / (previous + rounding) * 100
    base = F.greatest(previous - rounding, F.lit(1.0))
    high = (current + rounding - base) / base * 100
    fits = (reported >= low - slack) & (reported <= high + slack)
    return F.when(previous.isNull() | current.isNull() | (previous <= 0) | reported.isNull(), "not_checkable").when(fits, "consistent_with_rounded_values").otherwise("outside_rounded_range")


def sum_ratio(parts: list[Column], whole: Column) -> Column:
    """Sum of parts over a whole; null where that is 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in parts]) / F.when(whole != 0, whole)


def credible_sensor(distance_m: Column, similarity: Column) -> Column:
    return ((distance_m <= 100) & (similarity >= 0.15)) | (distance_m <= 25)


def not_estimable(failed: Column, clusters: Column, correlation: Column, sign: str = "|") -> Column:
    """Failure reasons where an interval or a correlation could not be had at all; order kept, no repeats."""
    few, none = F.coalesce(clusters < 2, F.lit(True)), correlation.isNull() | F.isnan(correlation)
    items = F.filter(F.split(F.coalesce(failed, F.lit("")), "[" + sign + "]"), lambda x: x != "")
    fixed = F.transform(items, lambda x: F.when(few & (x == "cluster_interval_includes_zero"), "insufficient_clusters_for_interval").when(none & (x == "change_correlation_not_positive"), "change_correlation_not_estimable").otherwise(x))
    return F.array_join(F.array_distinct(fixed), sign)


def is_one_of(columns: list[str], keys: list[tuple]) -> Column:
    """Whether a tuple of columns is in a constant set."""
    return reduce(lambda a, b: a | b, [reduce(lambda x, y: x & y, [F.col(c) == F.lit(v) for c, v in zip(columns, key)]) for key in keys])


def nested_points(coordinates: Column) -> Column:
    """(x, y) of all positions in a coordinate text nested to any depth; further ordinates of a position are dropped."""
    number = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
    position = F.regexp_extract_all(coordinates, F.lit(rf"\[\s*({number}\s*,\s*{number})[^\[\]]*\]"), F.lit(1))
    return F.transform(position, lambda p: F.struct(F.trim(F.get(F.split(p, ","), 0)).cast("double").alias("x"), F.trim(F.get(F.split(p, ","), 1)).cast("double").alias("y")))


def by_place(left: DataFrame, right: DataFrame, left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """Rows of two tables beside each other by their place in a stated order; tables of unlike length raise ValueError."""
    from fathomline.operators.panel import numbered

    a, b = numbered(left, left_order, "_place"), numbered(right, right_order, "_place")
    if (m := a.count()) != (n := b.count()):
        raise ValueError(f"{m} rows beside {n}")
    return a.join(b, "_place").drop("_place")


def tiles(west: float, south: float, east: float, north: float, side: int = 4, margin: float = 0.03) -> list[tuple[float, float, float, float]]:
    """A box with a margin cut into side x side tiles, row by row from the south-west."""
    west, south, east, north = west - margin, south - margin, east + margin, north + margin
    xs, ys = ([lo + (hi - lo) * i / side for i in range(side + 1)] for lo, hi in ((west, east), (south, north)))
    return [(xs[i], ys[j], xs[i + 1], ys[j + 1]) for j in range(side) for i in range(side)]


def split_tile(tile: tuple[float, float, float, float]) -> list[tuple[float, float, float, float]]:
    """The four quarters of a tile."""
    return tiles(*tile, side=2, margin=0.0)
