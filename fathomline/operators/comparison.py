"""Comparisons of models and of studies: paired losses with intervals and subsets, ablation of deployable models, change alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.operators.stats import fold_bootstrap_exact, improvement
from fathomline.session import materialize


def paired_losses(predictions: DataFrame, key: str, candidate: str, reference: str, model: str = "model", fold: str = "fold", observed: str = "observed", predicted: str = "predicted") -> DataFrame:
    """One row per key that both models predicted, with both absolute errors and all other columns of the candidate's row."""
    of = lambda name: predictions.where(F.col(model) == name).withColumn("_e", F.abs(F.col(predicted) - F.col(observed)))
    left = of(candidate).withColumnRenamed("_e", "candidate_error").drop(model)
    return left.join(of(reference).select(key, F.col("_e").alias("reference_error")), key)


def paired_comparisons(predictions: DataFrame, key: str, pairs: list[tuple[str, str]], subsets: dict[str, Column], folds: int, fold: str = "fold", **names: str) -> DataFrame:
    """Per (candidate, reference, subset): rows, both errors, improvement %, improved folds, and the difference with the exact
    interval of all draws of folds (null where a fold has no row of the subset)."""
    out = None
    for candidate, reference in pairs:
        # Written once: every subset reads it.
        both = materialize(paired_losses(predictions, key, candidate, reference, fold=fold, **names), "paired")
        for name, inside in subsets.items():
            part = both.where(inside)
            per_fold = part.groupBy(fold).agg(F.avg("candidate_error").alias("c"), F.avg("reference_error").alias("r"))
            won = per_fold.agg(F.count_if(F.col("c") < F.col("r")).alias("improved_folds"), F.count(F.lit(1)).alias("folds"))
            mean = part.agg(F.count(F.lit(1)).alias("n"), F.avg("candidate_error").alias("candidate_mae"), F.avg("reference_error").alias("reference_mae"))
            interval = fold_bootstrap_exact(part, fold, F.col("candidate_error") - F.col("reference_error"), folds).withColumnRenamed("estimate", "difference").drop("draws")
            row = mean.crossJoin(won).crossJoin(interval)  # one row each
            row = row.select(F.lit(candidate).alias("candidate"), F.lit(reference).alias("reference"), F.lit(name).alias("subset"), "*", improvement(F.col("reference_mae"), F.col("candidate_mae")).alias("improvement_percent"))
            out = row if out is None else out.unionByName(row)
    return out


def deployability(predictions: DataFrame, models: dict[str, tuple[bool, int]], baseline: str, strata: dict[str, Column], model: str = "model", observed: str = "observed", predicted: str = "predicted") -> DataFrame:
    """Per model, whether it can be deployed and on how many features, its pooled error and improvement over the baseline, and per
    stratum its error and aggregate bias %: models maps a name to (deployable, features). One pass over the predictions."""
    error, miss = F.abs(F.col(predicted) - F.col(observed)), F.col(predicted) - F.col(observed)
    inside = lambda c, v: F.when(c, v)
    per = predictions.groupBy(F.col(model).alias("model")).agg(
        F.avg(error).alias("pooled_mae"),
        *[F.avg(inside(c, error)).alias(f"{name}_mae") for name, c in strata.items()],
        *[(100 * F.try_divide(F.sum(inside(c, miss)), F.sum(inside(c, F.col(observed))))).alias(f"{name}_bias_percent") for name, c in strata.items()],
    )
    base = per.where(F.col("model") == baseline).select(F.col("pooled_mae").alias("_base"))
    listed = F.array(*[F.struct(F.lit(n).alias("model"), F.lit(d).alias("deployable"), F.lit(k).alias("feature_count")) for n, (d, k) in models.items()])
    known = predictions.sparkSession.range(1).select(F.explode(listed).alias("x")).select("x.*")
    rows = known.join(per, "model", "left").crossJoin(base)  # one row
    use = F.when(F.col("deployable"), "eligible_for_deployment_gate").otherwise("oracle_diagnostic_not_deployment_evidence")
    return rows.withColumn("improvement_percent", improvement(F.col("_base"), F.col("pooled_mae"))).drop("_base").withColumn("interpretation", use)


def comparability(first: DataFrame, second: DataFrame, key: str, categories: dict[str, tuple[Column | None, Column | None]]) -> DataFrame:
    """(dimension, first_value, second_value) of two studies: units, units in both, and units of each category (null where a study has none).

    A category's second count inside the overlap is given too, as ``<name>_in_overlap``. Units are distinct keys.
    """
    a, b = (df.dropDuplicates([key]) for df in (first, second))
    both = a.select(key).join(b.select(key), key, "left_semi").withColumn("_both", F.lit(True))
    a, b = (df.join(both, key, "left") for df in (a, b))
    count = lambda c: F.count_if(c) if c is not None else F.lit(None).cast("long")
    seen = F.coalesce(F.col("_both"), F.lit(False))

    def side(df: DataFrame, place: int) -> DataFrame:
        values = [("unique_units", F.count(F.lit(1))), ("units_in_both", F.count_if(seen))]
        for name, conditions in categories.items():
            c = conditions[place]
            values += [(f"{name}_count", count(c)), (f"{name}_in_overlap", count(None if c is None else c & seen))]
        row = df.agg(*[v.alias(n) for n, v in values])
        return row.unpivot([], [n for n, _ in values], "dimension", "value")

    return side(a, 0).withColumnRenamed("value", "first_value").join(side(b, 1).withColumnRenamed("value", "second_value"), "dimension")


def change_alignment(pairs: DataFrame, before: str, after: str, changed: Column, groups: dict[str, Column]) -> DataFrame:
    """Per group of pairs of a unit's consecutive values: pairs, changed ones, mean absolute change with and without a tag change,
    and the share of absolute change that stands in pairs without one. Groups may overlap; all are summed in one pass.

    A tag change that is null is none; pairs without both values are left out.
    """
    step = pairs.withColumn("_abs", F.abs(F.col(after) - F.col(before))).where("_abs IS NOT NULL").withColumn("_tag", F.coalesce(changed, F.lit(False)))
    tag, size = F.col("_tag"), F.col("_abs")

    def one(name: str, inside: Column) -> Column:
        total = lambda c: F.sum(F.when(inside & c, size))
        return F.struct(
            F.lit(name).alias("group"), F.count_if(inside).alias("pairs"), F.count_if(inside & tag).alias("changed"), F.avg(F.when(inside & tag, size)).alias("mean_abs_change_with"),
            F.avg(F.when(inside & ~tag, size)).alias("mean_abs_change_without"), F.try_divide(F.coalesce(total(~tag), F.lit(0.0)), total(F.lit(True))).alias("share_without_change"),
        )

    return step.agg(F.array(*[one(n, c) for n, c in groups.items()]).alias("x")).select(F.explode("x").alias("x")).select("x.*")
