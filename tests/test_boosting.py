"""Boosted trees: splits and leaf values against brute force, both ways of fitting against each other, refits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.operators import boosting
from fathomline.operators.boosting import BoostParams, Model


def brute_split(x, g, h, params, missing):
    """Best (gain, bin, missing_left) by trying every border and side."""
    def score(rows):
        return g[rows].sum() ** 2 / (h[rows].sum() + params.penalty)

    best = None
    gap = x == missing
    for low in (False, True) if gap.any() else (False,):
        for at in range(missing):
            left = (x <= at) & ~gap | (gap & low)
            if min(left.sum(), (~left).sum()) < params.least_rows:
                continue
            gain = score(left) + score(~left) - score(np.ones(len(x), bool))
            if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                best = gain, at, low
    return best


@pytest.mark.parametrize("loss", ["absolute", "squared", "poisson"])
@pytest.mark.parametrize("seed", range(4))
def test_split_with_missing_values(loss, seed):
    rng = np.random.default_rng(seed)
    params = BoostParams(loss=loss, bins=12, least_rows=5)
    n = 120
    x = rng.integers(0, 12, n)
    x[rng.random(n) < (0.3 if seed else 0.0)] = 12
    y = np.where(x == 12, 9.0, x * 1.0) + rng.random(n)
    g, h = boosting.gradients(loss, y, np.full(n, 1.5))
    hist = boosting.histograms(x[:, None], np.zeros(n, dtype=np.int64), 1, g, h, np.ones(n), 13)
    found, want = boosting.best_splits(hist[0], params)[0], brute_split(x, g, h, params, 12)
    assert found[0] == pytest.approx(want[0]) and found[1] == want[1] and (not (x == 12).any() or found[2] == want[2])


def test_leaf_values_of_each_loss():
    """One split: a leaf is -G / (H + penalty), or the median residual, times the rate."""
    x = np.repeat([0, 1], 30)[:, None]
    y = np.concatenate([np.arange(30.0), 100 + np.arange(30.0) ** 2])
    w = np.tile([1.0, 2.0, 0.0], 20)
    for loss in ("absolute", "squared", "poisson"):
        params = BoostParams(loss=loss, rounds=1, bins=2, rate=0.5, least_rows=3)
        start, (tree,) = boosting.fit_resident(x, y, w, np.array([True]), params)
        repeated = np.repeat(y, w.astype(int))
        assert start == pytest.approx({"absolute": np.median(repeated), "squared": repeated.mean(), "poisson": np.log(repeated.mean())}[loss])
        leaf = tree.nodes_of(x, 2)
        assert len(set(leaf.tolist())) == 2
        for one in set(leaf.tolist()):
            rows = np.repeat(np.flatnonzero(leaf == one), w[leaf == one].astype(int))
            if loss == "absolute":
                want = np.median(y[rows] - start)
            else:
                mean = start if loss == "squared" else np.exp(start)
                want = -(mean - y[rows]).sum() / ((len(rows) if loss == "squared" else len(rows) * mean) + 1)
            assert tree.value[one] == pytest.approx(0.5 * want)


def test_best_first_keeps_the_best_leaves():
    """Against a plain grower that splits one leaf at a time."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 20, (400, 3))
    y = np.sin(x[:, 0]) * 10 + x[:, 1] * (x[:, 2] > 7)
    params = BoostParams(loss="squared", rounds=1, bins=20, leaves=7, least_rows=10, rate=1.0)
    _, (tree,) = boosting.fit_resident(x, y, np.ones(400), np.ones(3, bool), params)
    g = y.mean() - y
    leaves = [np.ones(400, bool)]
    while len(leaves) < 7:
        best = max(((s[0], i, f, s[1]) for i, rows in enumerate(leaves) for f in range(3) if (s := brute_split(x[rows, f], g[rows], np.ones(rows.sum()), params, 20))), key=lambda b: b[0])
        rows = leaves.pop(best[1])
        leaves += [rows & (x[:, best[2]] <= best[3]), rows & (x[:, best[2]] > best[3])]
    leaf = tree.nodes_of(x, 20)
    assert {frozenset(np.flatnonzero(rows)) for rows in leaves} == {frozenset(np.flatnonzero(leaf == one)) for one in set(leaf.tolist())}


def test_ordered_bits():
    values = np.array([-np.inf, -3.5, -1e-300, -0.0, 0.0, 1e-300, 2.0, 1e300])
    bits = boosting.ordered_bits(values)
    assert (np.diff(bits.astype(object)) >= 0).all() and [boosting.from_ordered_bits(int(b)) for b in bits] == values.tolist()


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(600):
        a, b = float(rng.integers(0, 40)), float(rng.integers(0, 3))
        y = 50 + a * 3 + (b == 2) * 40 + float(rng.normal()) * 5
        rows.append((i, i % 5 + 1, None if i % 11 == 0 else a, float("nan") if i % 13 == 0 else b, None if i == 7 else y))
    return spark.createDataFrame(rows, "id long, fold int, a double, b double, y double").repartition(3).cache()


@pytest.mark.parametrize("loss", ["absolute", "squared", "poisson"])
def test_both_ways_give_the_same_trees(frame, loss):
    models = boosting.fold_models([1, 2], "fold", "y") + [Model("boot", F.col("y"), boosting.drawn(F.col("id"), 1), ("a",))]
    params = BoostParams(loss=loss, rounds=3, leaves=5, refresh=2)
    one = boosting.fit(frame, ["a", "b"], models, params)
    two = boosting.fit(frame, ["a", "b"], models, BoostParams(loss=loss, rounds=3, leaves=5, refresh=2, resident_rows=0))
    assert one.starts == pytest.approx(two.starts)
    for p, q in zip(one.trees, two.trees):
        assert len(p) == len(q) == 3
        for s, t in zip(p, q):
            assert (s.feature, s.bin, s.left) == (t.feature, t.bin, t.left) and s.value == pytest.approx(t.value)
    assert all(f in (-1, 0) for t in one.trees[2] for f in t.feature)


def test_out_of_fold_predicts_and_keeps_rows(frame):
    out = boosting.out_of_fold(frame, "fold", [1, 2, 3, 4, 5], "y", ["a", "b"], BoostParams(rounds=60))
    assert out.columns == [*frame.columns, "prediction"] and out.count() == 600
    mae = out.where("y IS NOT NULL AND a IS NOT NULL AND NOT isnan(b)").agg(F.avg(F.abs(F.col("y") - F.col("prediction")))).first()[0]
    spread = frame.where("y IS NOT NULL").agg(F.avg(F.abs(F.col("y") - 125))).first()[0]
    assert mae < 0.35 * spread


def test_training_rows_of_the_own_fold_do_not_matter(spark, frame):
    params = BoostParams(rounds=5)
    a = {r.id: r.prediction for r in boosting.out_of_fold(frame, "fold", [1, 2, 3, 4, 5], "y", ["a", "b"], params).where("fold = 2").collect()}
    changed = frame.withColumn("y", F.when(F.col("fold") == 2, F.lit(1e6)).otherwise(F.col("y")))
    b = {r.id: r.prediction for r in boosting.out_of_fold(changed, "fold", [1, 2, 3, 4, 5], "y", ["a", "b"], params).where("fold = 2").collect()}
    assert a == b


def test_drop_one_finds_the_feature_that_counts(frame):
    got = {r.dropped_feature: r for r in boosting.drop_one(frame, "fold", [1, 2, 3], "y", ["a", "b"], BoostParams(rounds=30)).collect()}
    assert got["a"].mae_without_feature > 1.5 * got["a"].full_model_mae and got["a"].full_model_mae == got["b"].full_model_mae
    assert got["a"].mae_increase_pct == pytest.approx(100 * (got["a"].mae_without_feature / got["a"].full_model_mae - 1))


def test_resamples_are_poisson_counts(spark):
    n = spark.range(40000).select(boosting.drawn(F.col("id"), 3).alias("n")).agg(F.avg("n"), F.var_samp("n")).first()
    assert abs(n[0] - 1) < 0.03 and abs(n[1] - 1) < 0.05


def test_refit_noise_tells_change_from_noise(spark, frame):
    """Two years that differ by a constant of 60, and a third equal to the second."""
    years = frame.where("y IS NOT NULL").withColumn("y1", F.col("y")).withColumn("y2", F.col("y") + 60).withColumn("y3", F.col("y2"))
    got = {r.period: r for r in boosting.refit_noise(years, frame.limit(200), "id", ["a", "b"], {1: "y1", 2: "y2", 3: "y3"}, [(1, 2), (2, 3)], 2, draws=4, params=BoostParams(rounds=20)).collect()}
    assert got["1-2"].mean_change == pytest.approx(60, abs=1e-6) and got["1-2"].distinguishable_pct == 100 and got["1-2"].network_rows == 200
    assert got["2-3"].mean_change == 0 and got["2-3"].mean_refit_sd == 0 and got["1-2"].mean_placebo_sd > 0


def test_without_feature(spark, frame):
    got = {r.fold: r for r in boosting.without_feature(frame, frame, "y", ["a", "b"], "b", "fold", BoostParams(rounds=30)).collect()}
    assert len(got) == 5 and all(r.network_rows == 120 and r.mean_abs_change > 1 and r.max_abs_change >= r.mean_abs_change and r.prediction_q10 <= r.prediction_median <= r.prediction_q90 for r in got.values())
    assert got[3].training_rows == 119  # row 7 has no value


def test_many_values_take_quantiles(spark):
    df = spark.range(5000).select((F.col("id") * 1.0).alias("v"), F.lit(None).cast("double").alias("none"))
    edges = boosting.bin_edges(df, ["v", "none"], 100)
    assert len(edges[0]) == 99 and abs(edges[0][49] - 2500) < 60 and len(edges[1]) == 0
    empty = boosting.fit(df.where("v < 0"), ["v"], [Model("m", F.col("v"), F.lit(1))], BoostParams(rounds=2))
    assert boosting.predict(df.where("v < 3"), empty).count() == 3


@pytest.mark.parametrize("loss", ["absolute", "squared", "poisson"])
def test_rows_that_no_model_tells_apart_are_merged(spark, monkeypatch, loss):
    """A frame above the bound whose rows repeat is fitted by a task for each model, with the trees of all its rows; before, by levels."""
    rng = np.random.default_rng(8)
    base = [(int(a), int(b), int(rng.integers(1, 9))) for a in range(12) for b in range(5)]
    rows = [(i, float(a), None if b == 4 else float(b), float(a + b * b + (v if loss == "absolute" else 8 * rng.random()))) for i, (a, b, v) in enumerate(base * 12)]
    df = spark.createDataFrame(rows, "k long, a double, b double, y double")
    models = [Model("all", F.col("y"), F.lit(1)), Model("some", F.col("y"), (F.col("k") % 3).cast("int"))]
    params = BoostParams(loss=loss, rounds=6, leaves=5, least_rows=8, rate=0.3)
    want = boosting.fit(df, ["a", "b"], models, params)
    monkeypatch.setattr(boosting, "_ByLevels", None)
    got = boosting.fit(df, ["a", "b"], models, BoostParams(loss=loss, rounds=6, leaves=5, least_rows=8, rate=0.3, resident_rows=100))
    for m in range(2):
        assert got.starts[m] == pytest.approx(want.starts[m])
        # A split and its mirror image (missing rows on the other side) have equal gains, so predictions are compared.
        codes = want.codes([np.array([r[c] if r[c] is not None else np.nan for r in rows]) for c in (1, 2)])
        assert len(got.trees[m]) == 6 and got.raw(m, codes) == pytest.approx(want.raw(m, codes))


@pytest.mark.parametrize("most", [1, 3, 40])
def test_cells_give_the_trees_of_their_rows(most):
    """Rows of one cell are fitted together; weights that draw rows up to 40 times are kept as weights."""
    rng = np.random.default_rng(most)
    codes = rng.integers(0, 13, (3000, 3)).astype(np.uint8)
    codes[:, 2] = np.where(codes[:, 0] > 6, 12, codes[:, 2] % 2)
    y = np.round(codes[:, 0] * 3 + (codes[:, 1] == 12) * 9 + rng.normal(size=3000) * 4, 1)
    w, allowed = rng.integers(1, most + 1, 3000).astype(float), np.array([True, True, most != 3])
    params = BoostParams(rounds=8, bins=12, leaves=9, least_rows=15, rate=0.3)
    want = boosting.fit_resident(codes.astype(np.int64), y, w, allowed, params)
    got = boosting.fit_cells(*boosting._by_cell(np.where(allowed, codes, 0).astype(np.uint8), y, w), allowed, params)
    assert got == want


@pytest.mark.parametrize("cells, heavy", [(13, 1), (200, 1), (200, 1 << 16)])
def test_few_and_many_rows_of_a_cell_give_the_same_trees(cells, heavy):
    """Few rows are looked at one by one, many are searched; sums of large weights are not packed (l04_l06, l14, m20)."""
    rng = np.random.default_rng(cells)
    codes = rng.integers(0, cells, (3000, 2)).astype(np.uint8)
    codes[:, 1] = np.where(codes[:, 1] > 9, 0, codes[:, 1] % 2 * 9)
    if cells == 200:
        codes[:, 1] = rng.integers(0, 10, 3000)
    y, w = np.round(codes[:, 0] / 9 + rng.normal(size=3000), 2), (heavy * rng.integers(1, 3, 3000)).astype(float)
    allowed, params = np.array([True, True]), BoostParams(rounds=6, bins=255, leaves=7, least_rows=15 * heavy, rate=0.3)
    packed = boosting._by_cell(codes, y, w)
    assert (len(y) > 16 * len(packed[0])) == (cells == 13) and (w.sum() >= 1 << 25) == (heavy > 1)
    assert boosting.fit_cells(*packed, allowed, params) == boosting.fit_resident(codes.astype(np.int64), y, w, allowed, params)


def test_frames_of_different_targets_need_no_pass_per_level(frame, monkeypatch):
    """Before, a frame above resident_rows whose targets differ took some ten jobs for each round (l04_l06, l12, l14, m20)."""
    models = boosting.fold_models([1, 2], "fold", "y") + [Model("boot", F.col("y"), boosting.drawn(F.col("id"), 1), ("a",))]
    want = boosting.fit(frame, ["a", "b"], models, BoostParams(rounds=5, leaves=5))
    monkeypatch.setattr(boosting, "_ByLevels", None)
    got = boosting.fit(frame, ["a", "b"], models, BoostParams(rounds=5, leaves=5, resident_rows=100))
    assert got.starts == want.starts and got.trees == want.trees
    of_rows = lambda e: boosting.predict(frame, e).orderBy("id").select("id", "predictions").collect()
    assert of_rows(got) == of_rows(want)
