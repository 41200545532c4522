"""Comparison tables on small frames."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.operators import comparison


def test_paired_comparison_by_hand(spark):
    rows = [(i, i % 3 + 1, m, 10.0 + i, 10.0 + i + e) for i in range(30) for m, e in (("new", (i % 4) * 1.0), ("old", 2.0 + (i % 2)))] + [(99, 1, "new", 1.0, 5.0)]
    df = spark.createDataFrame(rows, "k int, fold int, model string, observed double, predicted double")
    got = {r.subset: r for r in comparison.paired_comparisons(df, "k", [("new", "old")], {"all": F.lit(True), "few": F.col("fold") == 1, "none": F.lit(False)}, 3).collect()}
    d = {f: [(i % 4) - 2 - (i % 2) for i in range(30) if i % 3 + 1 == f] for f in (1, 2, 3)}
    means = [np.mean(sum((d[f] for f in draw), [])) for draw in itertools.product(d, repeat=3)]
    a = got["all"]
    assert a.n == 30 and a.candidate_mae == 1.4333333333333333 and a.reference_mae == 2.5 and (a.improved_folds, a.folds) == (3, 3)
    assert a.difference == pytest.approx(np.mean(sum(d.values(), []))) and a.low == pytest.approx(np.quantile(means, 0.025)) and a.high == pytest.approx(np.quantile(means, 0.975))
    assert got["few"].low is None and got["few"].n == 10 and got["none"].n == 0 and got["none"].candidate_mae is None


def test_deployability_and_comparability(spark):
    df = spark.createDataFrame([("a", "x", 10.0, 12.0), ("a", "y", 20.0, 20.0), ("b", "x", 10.0, 10.0), ("b", "y", 20.0, 24.0)], "model string, g string, observed double, predicted double")
    got = {r.model: r for r in comparison.deployability(df, {"a": (True, 3), "b": (False, 9), "c": (True, 1)}, "b", {"x": F.col("g") == "x", "z": F.lit(False)}).collect()}
    assert (got["a"].pooled_mae, got["a"].improvement_percent, got["a"].x_mae, got["a"].x_bias_percent, got["a"].z_mae) == (1.0, 50.0, 2.0, 20.0, None)
    assert got["b"].interpretation == "oracle_diagnostic_not_deployment_evidence" and got["c"].pooled_mae is None
    one, two = (spark.createDataFrame(rows, "k int, c string") for rows in ([(1, "m"), (1, "m"), (2, "m"), (3, "n")], [(2, "m"), (3, "m"), (4, "m")]))
    rows = {r.dimension: (r.first_value, r.second_value) for r in comparison.comparability(one, two, "k", {"m": (F.col("c") == "m", F.col("c") == "m"), "new": (None, F.col("k") > 2)}).collect()}
    assert rows == {"unique_units": (3, 3), "units_in_both": (2, 2), "m_count": (2, 3), "m_in_overlap": (1, 2), "new_count": (None, 2), "new_in_overlap": (None, 1)}


def test_change_alignment(spark):
    df = spark.createDataFrame([(1.0, 3.0, True), (5.0, 4.0, False), (5.0, 9.0, None), (None, 9.0, True)], "a double, b double, t boolean")
    r = {x.group: x for x in comparison.change_alignment(df, "a", "b", F.col("t"), {"all": F.lit(True), "none": F.lit(False)}).collect()}
    assert (r["all"].pairs, r["all"].changed, r["all"].mean_abs_change_with, r["all"].mean_abs_change_without) == (3, 1, 2.0, 2.5) and r["all"].share_without_change == pytest.approx(5 / 7)
    assert r["none"].pairs == 0 and r["none"].share_without_change is None
