"""Queries of estimators, bins, strata, bootstraps and out-of-fold evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fathomline.operators import models, stats
from fathomline.params import GateParams
from fathomline.plans.frames import OOF, PANEL, STATIONS, TRAINING, out_of_fold, panel, stations, training
from fathomline.plans.registry import query
from fathomline.session import table

METRICS = """count(*) AS n, round(avg(abs(predicted - observed)), 4) AS mae, round(sqrt(avg((predicted - observed) ** 2)), 4) AS rmse,
  round(median(abs(predicted - observed)), 4) AS median_ae, round(1 - sum((predicted - observed) ** 2) / (var_pop(observed) * count(*)), 6) AS r2,
  round(avg(predicted - observed), 4) AS mean_error, round(100.0 * sum(predicted - observed) / sum(observed), 4) AS bias_percent"""


def rounded(df, digits: int = 4, **other: int):
    kinds = dict(df.dtypes)
    return df.select(*[(F.round(c, other.get(c, digits)) + 0.0).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


@query("flagship_lookup_gate", f"""WITH {OOF},
m AS (SELECT model, {METRICS.replace('round(avg(abs(predicted - observed)), 4) AS mae', 'avg(abs(predicted - observed)) AS mae')} FROM oof GROUP BY model),
f AS (SELECT fold, model, avg(abs(predicted - observed)) AS mae FROM oof GROUP BY 1, 2),
w AS (SELECT count(*) FILTER (WHERE h.mae < b.mae) AS fold_wins FROM f h JOIN f b ON h.fold = b.fold AND h.model = 'hierarchy' AND b.model = 'median'),
e AS (SELECT 100.0 * (b.mae - h.mae) / b.mae AS improvement FROM m h, m b WHERE h.model = 'hierarchy' AND b.model = 'median')
SELECT m.model, m.n, round(m.mae, 4) AS mae, m.rmse, m.median_ae, m.r2, m.mean_error, m.bias_percent, CASE WHEN m.model = 'hierarchy' THEN round(improvement, 4) ELSE 0.0 END AS improvement_vs_median, fold_wins,
  CASE WHEN m.model = 'hierarchy' THEN improvement >= 5 AND fold_wins >= 3 END AS pass FROM m, w, e""")
def _(spark, sf):
    oof = out_of_fold(spark, sf)
    summary = stats.with_improvement(oof.groupBy("model").agg(*stats.error_metrics()), [], "model", "mae", "median")
    folds = oof.groupBy("fold", "model").agg(F.avg(F.abs(F.col("predicted") - F.col("observed"))).alias("mae"))
    wins = models.fold_wins(folds, "fold", "model", "mae", "hierarchy", "median").select("fold_wins")
    g = GateParams()
    passed = F.when(F.col("model") == "hierarchy", (F.col("improvement_vs_median") >= g.skill_percent) & (F.col("fold_wins") >= g.min_fold_wins))
    return rounded(summary.crossJoin(F.broadcast(wins)).withColumn("pass", passed), r2=6)


@query("m03_m04_correlations", f"""WITH {PANEL}, {STATIONS}, b AS (SELECT fold, year, n_obs::DOUBLE AS x, aadt AS y FROM panel JOIN stations USING (station_id)),
r AS (SELECT *, rank() OVER (PARTITION BY fold, year ORDER BY x) + (count(*) OVER (PARTITION BY fold, year, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY fold, year ORDER BY y) + (count(*) OVER (PARTITION BY fold, year, y) - 1) / 2.0 AS ry FROM b)
SELECT fold, year, count(*) AS n, round(CASE WHEN count(*) >= 3 AND min(x) < max(x) AND min(y) < max(y) THEN corr(x, y) END, 6) AS pearson, round(CASE WHEN count(*) >= 3 AND min(x) < max(x) AND min(y) < max(y) THEN corr(rx, ry) END, 6) AS spearman FROM r GROUP BY 1, 2""")
def _(spark, sf):
    b = panel(spark, sf).join(stations(spark, sf), "station_id").select("fold", "year", F.col("n_obs").cast("double").alias("x"), F.col("aadt").alias("y"))
    rho = stats.spearman(b, "x", "y", ["fold", "year"])
    r = b.groupBy("fold", "year").agg(stats.pearson("x", "y").alias("pearson"))
    return rounded(rho.join(r, ["fold", "year"]).select("fold", "year", "n", "pearson", "spearman"), 6)


@query("m05_slopes", f"WITH {PANEL} SELECT station_id, CASE WHEN count(*) >= 2 THEN round(greatest(regr_intercept(aadt, year - 2002), 0), 4) ELSE arg_max(aadt, year) END AS trend, count(*) AS n_periods FROM panel GROUP BY station_id")
def _(spark, sf):
    t = stats.slope_or_last(panel(spark, sf), ["station_id"], "year", "aadt", 2002)
    return t.withColumn("trend", F.round("trend", 4))


@query("m06_m15_change_metrics", f"""WITH {PANEL}, c AS (SELECT a.year, a.aadt - b.aadt AS o, 0.5 * (b.n_obs - a.n_obs) * 1000 AS p FROM panel a JOIN panel b ON a.station_id = b.station_id AND a.year = b.year + 1)
SELECT year, count(*) AS n, round(avg(abs(p - o)), 4) AS change_mae, round(avg(abs(o)), 4) AS no_change_mae, round(100.0 * (avg(abs(o)) - avg(abs(p - o))) / avg(abs(o)), 4) AS improvement_percent, round(avg(CASE WHEN o <> 0 THEN (sign(o) = sign(p))::INTEGER END), 6) AS direction_nonzero, round(avg((sign(o) = sign(p))::INTEGER), 6) AS direction_all, round(corr(o, p), 6) AS correlation FROM c GROUP BY year""")
def _(spark, sf):
    from fathomline.operators.panel import consecutive

    c = consecutive(panel(spark, sf), ["station_id"], "year", ["aadt", "n_obs"])
    c = c.select("year", (F.col("aadt_current") - F.col("aadt_previous")).alias("o"), (0.5 * (F.col("n_obs_previous") - F.col("n_obs_current")) * 1000).alias("p"))
    return rounded(c.groupBy("year").agg(*stats.change_metrics("o", "p")), direction_nonzero=6, direction_all=6, correlation=6)


@query("m07_standardised_difference", "WITH d AS (SELECT c_mktsegment = 'BUILDING' AS g, ln(1 + greatest(c_acctbal, 0)) AS x FROM customer) SELECT round((avg(x) FILTER (WHERE g) - avg(x) FILTER (WHERE NOT g)) / sqrt((var_samp(x) FILTER (WHERE g) + var_samp(x) FILTER (WHERE NOT g)) / 2), 8) AS standardised_difference FROM d")
def _(spark, sf):
    d = table(spark, sf, "customer").select((F.col("c_mktsegment") == "BUILDING").alias("g"), F.greatest("c_acctbal", F.lit(0.0)).alias("x"))
    return rounded(stats.standardised_difference(d, "g", "x"), 8)


@query("m08_e28_wilson", """WITH d AS (SELECT l.toxic, d.source, l.quality FROM labels l JOIN documents d USING (doc_id)), s AS (SELECT stratum, count(*) AS n, sum(toxic)::BIGINT AS k FROM (SELECT unnest(['all', 'source:' || source]) AS stratum, toxic FROM d) GROUP BY 1)
SELECT stratum, n, k, round((k / n + 3.841458820694124 / (2 * n)) / (1 + 3.841458820694124 / n) - 1.959963984540054 * sqrt((k / n) * (1 - k / n) / n + 3.841458820694124 / (4 * n * n)) / (1 + 3.841458820694124 / n), 8) + 0.0 AS low,
  round((k / n + 3.841458820694124 / (2 * n)) / (1 + 3.841458820694124 / n) + 1.959963984540054 * sqrt((k / n) * (1 - k / n) / n + 3.841458820694124 / (4 * n * n)) / (1 + 3.841458820694124 / n), 8) AS high FROM s""")
def _(spark, sf):
    d = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    s = stats.by_strata(d, [], {"all": None, "source": F.col("source")}, [F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("k")])
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return rounded(s.withColumn("low", low).withColumn("high", high), 8)


@query("m09_e22_relative_range", "WITH e AS (SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, l_quantity AS q FROM lineitem) SELECT a, b, count(*) AS n, round((max(q) - min(q)) / avg(q), 6) AS relative_range FROM e GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, sf):
    e = table(spark, sf, "lineitem").select(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b"), F.col("l_quantity").alias("q"))
    return rounded(e.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.max("q") - F.min("q"), F.avg("q")).alias("relative_range")).where("n > 1"), 6)


@query("m11_a24_error_metrics_by_scope", f"WITH {OOF} SELECT model, coalesce(fold::VARCHAR, 'pooled') AS scope, {METRICS} FROM oof GROUP BY GROUPING SETS ((model), (model, fold))")
def _(spark, sf):
    oof = out_of_fold(spark, sf)
    per = stats.by_strata(oof, ["model"], {"pooled": None, "fold": F.col("fold")}, stats.error_metrics())
    return rounded(per.withColumn("scope", F.regexp_replace("stratum", "^fold:", "")).drop("stratum"), r2=6)


@query("m12_poisson_deviance", f"WITH {OOF} SELECT model, round(2 * avg(CASE WHEN observed = 0 THEN greatest(predicted, 1e-6) ELSE observed * ln(observed / greatest(predicted, 1e-6)) - observed + greatest(predicted, 1e-6) END), 4) AS deviance FROM oof GROUP BY model")
def _(spark, sf):
    return rounded(out_of_fold(spark, sf).groupBy("model").agg(stats.poisson_deviance(F.col("observed"), F.col("predicted")).alias("deviance")))


@query("m17_fold_bootstrap_exact", f"""WITH {OOF}, d AS (SELECT a.fold, abs(a.predicted - a.observed) - abs(b.predicted - b.observed) AS v FROM oof a JOIN oof b ON a.station_id = b.station_id AND a.model = 'hierarchy' AND b.model = 'median'),
c AS (SELECT fold, sum(v) AS s, count(*) AS n FROM d GROUP BY fold),
x AS (SELECT (a.s + b.s + e.s + f.s + g.s) / (a.n + b.n + e.n + f.n + g.n) AS x FROM c a, c b, c e, c f, c g)
SELECT round(quantile_cont(x, 0.025), 4) AS low, round(quantile_cont(x, 0.975), 4) AS high, count(*) AS draws, round((SELECT sum(s) / sum(n) FROM c), 4) AS estimate FROM x""")
def _(spark, sf):
    oof = out_of_fold(spark, sf)
    side = lambda m, name: oof.where(F.col("model") == m).select("station_id", "fold", F.abs(F.col("predicted") - F.col("observed")).alias(name))
    d = side("hierarchy", "a").join(side("median", "b").drop("fold"), "station_id")
    return rounded(stats.fold_bootstrap_exact(d, "fold", F.col("a") - F.col("b"), 5))


def _bootstrap_sql(kind: str, draws: int) -> str:
    return f"""SELECT '{kind}' AS kind, round((SELECT sum(s) / sum(n) FROM {kind}), 4) AS estimate, round(quantile_cont(x, 0.025), 4) AS low, round(quantile_cont(x, 0.975), 4) AS high
FROM (SELECT draw, sum(s) / sum(n) AS x FROM (SELECT draw, ((('0x' || substr(md5('42:' || draw || ':' || place), 1, 8))::BIGINT * (SELECT count(*) FROM {kind})) >> 32) + 1 AS place FROM {kind}, range(1, {draws + 1}) d(draw)) JOIN {kind} USING (place) GROUP BY draw)"""


@query("m16_m18_cluster_bootstrap", f"""WITH {TRAINING}, pooled AS (SELECT row_number() OVER (ORDER BY station_id) AS place, sum(aadt) AS s, count(aadt) AS n FROM training GROUP BY station_id),
means AS (SELECT row_number() OVER (ORDER BY segment) AS place, avg(aadt) AS s, 1 AS n FROM training GROUP BY segment)
{_bootstrap_sql("pooled", 1000)} UNION ALL {_bootstrap_sql("means", 5000)}""")
def _(spark, sf):
    t = training(spark, sf)
    pooled = stats.cluster_bootstrap(t, "station_id", F.col("aadt")).withColumn("kind", F.lit("pooled"))
    both = pooled.unionByName(stats.cluster_bootstrap(t, "segment", F.col("aadt"), statistic="means").withColumn("kind", F.lit("means")))
    return rounded(both.select("kind", "estimate", "low", "high"))


@query("m22_m25_benchmark_factors", f"""WITH {PANEL}, {STATIONS}, b AS (SELECT year, fold AS region, segment AS network, sum(aadt) AS vkt, sum(n_obs) AS len FROM panel JOIN stations USING (station_id) WHERE year IN (1996, 1998, 2000) GROUP BY 1, 2, 3),
t AS (SELECT year, sum(vkt) AS vkt, sum(len) AS len FROM b GROUP BY year), p(a, z) AS (VALUES (1996, 1998), (1998, 2000))
SELECT p.a AS year_from, p.z AS year_to, x.region, x.network, round(tz.vkt / ta.vkt, 8) AS territory_vkt_factor, round((tz.vkt / tz.len) / (ta.vkt / ta.len), 8) AS territory_intensity_factor, round(y.vkt / x.vkt, 8) AS vkt_factor, round((y.vkt / y.len) / (x.vkt / x.len), 8) AS intensity_factor
FROM p JOIN b x ON x.year = p.a JOIN b y ON y.year = p.z AND y.region = x.region AND y.network = x.network JOIN t ta ON ta.year = p.a JOIN t tz ON tz.year = p.z""")
def _(spark, sf):
    b = panel(spark, sf).join(stations(spark, sf), "station_id").where(F.col("year").isin(1996, 1998, 2000))
    cells = b.groupBy("year", F.col("fold").alias("region"), F.col("segment").alias("network")).agg(F.sum("aadt").alias("vkt"), F.sum("n_obs").alias("len"))
    whole = cells.groupBy("year").agg(F.sum("vkt").alias("t_vkt"), F.sum("len").alias("t_len"))
    rows = cells.join(whole, "year")
    values = ["vkt", "len", "t_vkt", "t_len"]
    from fathomline.operators.panel import period_pairs

    p = period_pairs(rows, ["region", "network"], "year", values, [(1996, 1998), (1998, 2000)])
    ratio = lambda v: F.col(f"{v}_to") / F.col(f"{v}_from")
    return rounded(p.select("year_from", "year_to", "region", "network", ratio("t_vkt").alias("territory_vkt_factor"), (ratio("t_vkt") / ratio("t_len")).alias("territory_intensity_factor"), ratio("vkt").alias("vkt_factor"), (ratio("vkt") / ratio("len")).alias("intensity_factor")), 8)


@query("w04_w05_quantile_bins", f"WITH {TRAINING}, e AS (SELECT fold, list_sort(list_distinct([quantile_cont(extent, 0.0), quantile_cont(extent, 0.25), quantile_cont(extent, 0.5), quantile_cont(extent, 0.75), quantile_cont(extent, 1.0)])) AS e FROM training GROUP BY fold) SELECT fold, len(list_filter(list_slice(e, 2, len(e) - 1), lambda x: extent > x)) + 1 AS bin, count(*) AS n FROM training JOIN e USING (fold) GROUP BY 1, 2")
def _(spark, sf):
    t = training(spark, sf)
    binned = t.join(stats.quantile_edges(t, "extent", 4, ["fold"]), "fold").withColumn("bin", stats.bin_of(F.col("extent"), F.col("edges")).cast("long"))
    return binned.groupBy("fold", "bin").agg(F.count(F.lit(1)).alias("n"))


@query("w03_equal_count_bins", f"WITH {TRAINING}, r AS (SELECT fold, row_number() OVER (PARTITION BY fold ORDER BY aadt, station_id) AS r, count(*) OVER (PARTITION BY fold) AS n FROM training) SELECT fold, greatest(ceil((r - 1) * 5 / (n - 1)), 1)::INTEGER AS bin, count(*) AS n FROM r GROUP BY 1, 2")
def _(spark, sf):
    return stats.equal_count_bin(training(spark, sf), "aadt", 5, ["fold"], "station_id").groupBy("fold", "bin").agg(F.count(F.lit(1)).alias("n"))


@query("a23_e12_strata", f"WITH {OOF} SELECT model, stratum, {METRICS} FROM (SELECT *, unnest(['all', 'fold:' || fold, 'segment:' || segment]) AS stratum FROM oof) GROUP BY 1, 2")
def _(spark, sf):
    return rounded(stats.by_strata(out_of_fold(spark, sf), ["model"], {"all": None, "fold": F.col("fold"), "segment": F.col("segment")}, stats.error_metrics()), r2=6)


def _calibration_sql(by: str) -> str:
    return f"""WITH {OOF}, e AS (SELECT model, list_sort(list_distinct([quantile_cont({by}, 0.0), quantile_cont({by}, 0.2), quantile_cont({by}, 0.4), quantile_cont({by}, 0.6), quantile_cont({by}, 0.8), quantile_cont({by}, 1.0)])) AS e FROM oof GROUP BY model)
SELECT model, len(list_filter(list_slice(e, 2, len(e) - 1), lambda x: {by} > x)) + 1 AS bin, count(*) AS n, round(avg(observed), 4) AS mean_observed, round(avg(predicted), 4) AS mean_predicted, round(100.0 * (sum(predicted) - sum(observed)) / sum(observed), 4) AS bias_percent FROM oof JOIN e USING (model) GROUP BY 1, 2"""


@query("e04_calibration_by_observed", _calibration_sql("observed"))
def _(spark, sf):
    c = stats.calibration(out_of_fold(spark, sf), ["model"], "observed", 5)
    return rounded(c.withColumn("bin", F.col("bin").cast("long")))


@query("e05_calibration_by_predicted", _calibration_sql("predicted"))
def _(spark, sf):
    c = stats.calibration(out_of_fold(spark, sf), ["model"], "predicted", 5)
    return rounded(c.withColumn("bin", F.col("bin").cast("long")))


@query("e03_e06_paired_comparison", f"""WITH {OOF}, f AS (SELECT fold, model, avg(abs(predicted - observed)) AS mae FROM oof GROUP BY 1, 2)
SELECT h.fold, round(h.mae, 4) AS candidate_mae, round(b.mae, 4) AS reference_mae, round(100.0 * (b.mae - h.mae) / b.mae, 4) AS improvement_percent, h.mae < b.mae AS win FROM f h JOIN f b ON h.fold = b.fold AND h.model = 'hierarchy' AND b.model = 'median'""")
def _(spark, sf):
    f = out_of_fold(spark, sf).groupBy("fold", "model").agg(F.avg(F.abs(F.col("predicted") - F.col("observed"))).alias("mae"))
    h, b = (f.where(F.col("model") == m).select("fold", F.col("mae").alias(n)) for m, n in (("hierarchy", "candidate_mae"), ("median", "reference_mae")))
    j = h.join(b, "fold")
    return rounded(j.withColumn("improvement_percent", stats.improvement(F.col("reference_mae"), F.col("candidate_mae"))).withColumn("win", F.col("candidate_mae") < F.col("reference_mae")))


@query("e08_reproduction_check", f"WITH {OOF}, m AS (SELECT model, avg(abs(predicted - observed)) AS mae FROM oof GROUP BY model), s AS (SELECT model, round(mae, 6) AS saved FROM m) SELECT model, abs(mae - saved) < 1e-4 AS reproduced FROM m JOIN s USING (model)")
def _(spark, sf):
    from fathomline.operators.checks import within

    m = out_of_fold(spark, sf).groupBy("model").agg(F.avg(F.abs(F.col("predicted") - F.col("observed"))).alias("mae"))
    saved = m.select("model", F.round("mae", 6).alias("saved"))
    return m.join(saved, "model").select("model", within(F.col("mae"), F.col("saved"), 1e-4).alias("reproduced"))


@query("e13_representativeness", f"WITH {PANEL}, {STATIONS}, b AS (SELECT s.*, s.station_id IN (SELECT station_id FROM panel WHERE year = 1998) AS cohort FROM stations s) SELECT cohort, dimension, level, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY cohort, dimension), 6) AS share FROM (SELECT cohort, unnest(['fold', 'segment']) AS dimension, unnest([fold::VARCHAR, segment]) AS level FROM b) GROUP BY 1, 2, 3")
def _(spark, sf):
    seen = panel(spark, sf).where("year = 1998").select("station_id").withColumn("cohort", F.lit(True))
    b = stations(spark, sf).join(seen, "station_id", "left").na.fill(False, ["cohort"])
    long = b.select("cohort", F.col("fold").cast("string").alias("fold"), "segment").unpivot(["cohort"], ["fold", "segment"], "dimension", "level")
    n = long.groupBy("cohort", "dimension", "level").agg(F.count(F.lit(1)).alias("n"))
    return rounded(n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("cohort", "dimension"))), 6)


@query("e15_coverage", f"WITH {PANEL}, {STATIONS} SELECT s.fold, count(DISTINCT s.station_id) AS stations, count(DISTINCT p.station_id) AS covered, round(count(DISTINCT p.station_id) / count(DISTINCT s.station_id), 6) AS coverage FROM stations s LEFT JOIN panel p ON p.station_id = s.station_id AND p.year = 1998 GROUP BY s.fold")
def _(spark, sf):
    p = panel(spark, sf).where("year = 1998").select("station_id", F.lit(1).alias("seen"))
    j = stations(spark, sf).join(p, "station_id", "left")
    return rounded(j.groupBy("fold").agg(F.count(F.lit(1)).alias("stations"), F.count("seen").alias("covered"), (F.count("seen") / F.count(F.lit(1))).alias("coverage")), 6)


@query("e23_extraction_audit", f"WITH {PANEL}, c AS (SELECT year, count(*) AS found FROM panel GROUP BY year), x(year, expected) AS (VALUES (1995, 1000), (1996, 1100), (2005, 10)) SELECT x.year, coalesce(found, 0) AS found, expected, coalesce(found, 0) = expected AS equal FROM x LEFT JOIN c USING (year)")
def _(spark, sf):
    expected = spark.createDataFrame([(1995, 1000), (1996, 1100), (2005, 10)], "year int, expected int")
    c = panel(spark, sf).groupBy("year").agg(F.count(F.lit(1)).alias("found"))
    found = F.coalesce("found", F.lit(0).cast("long"))
    return expected.join(c, "year", "left").select("year", found.alias("found"), "expected", (found == F.col("expected")).alias("equal"))


@query("v08_v13_decision_table", f"""WITH {OOF}, m AS (SELECT model, avg(abs(predicted - observed)) AS mae, 100.0 * sum(predicted - observed) / sum(observed) AS bias FROM oof GROUP BY model),
f AS (SELECT fold, model, avg(abs(predicted - observed)) AS mae FROM oof GROUP BY 1, 2), w AS (SELECT count(*) FILTER (WHERE h.mae < b.mae) AS wins FROM f h JOIN f b ON h.fold = b.fold AND h.model = 'hierarchy' AND b.model = 'median'),
s AS (SELECT 100.0 * (b.mae - h.mae) / b.mae AS effect, h.bias, wins FROM m h, m b, w WHERE h.model = 'hierarchy' AND b.model = 'median')
SELECT 'skill' AS decision, effect >= 5 AND wins >= 3 AS pass, printf('improvement %.2f%%, %d fold wins', effect, wins) AS evidence, array_to_string(list_filter([CASE WHEN effect < 5 THEN 'effect_below_threshold' END, CASE WHEN wins < 3 THEN 'too_few_fold_wins' END], lambda x: x IS NOT NULL), ';') AS failed_criterion, NULL::VARCHAR AS action FROM s
UNION ALL SELECT 'bias', abs(bias) <= 10, printf('bias %.2f%%', bias), CASE WHEN abs(bias) <= 10 THEN '' ELSE 'bias_above_limit' END, NULL FROM s
UNION ALL SELECT 'change_claim', false, 'fixed by design', 'claim_boundary', 'report levels only' FROM s""")
def _(spark, sf):
    oof = out_of_fold(spark, sf)
    m = oof.groupBy("model").agg(F.avg(F.abs(F.col("predicted") - F.col("observed"))).alias("mae"), F.try_divide(100.0 * F.sum(F.col("predicted") - F.col("observed")), F.sum("observed")).alias("bias"))
    f = oof.groupBy("fold", "model").agg(F.avg(F.abs(F.col("predicted") - F.col("observed"))).alias("mae"))
    of = lambda c, name: F.max(F.when(F.col("model") == name, F.col(c)))
    one = m.agg(stats.improvement(of("mae", "median"), of("mae", "hierarchy")).alias("effect"), of("bias", "hierarchy").alias("bias")).crossJoin(models.fold_wins(f, "fold", "model", "mae", "hierarchy", "median"))
    g = GateParams()
    failed = stats.gate(F.col("effect"), g.skill_percent, F.lit(-1.0), F.col("fold_wins"), g.min_fold_wins)
    small = F.abs("bias") <= g.bias_percent
    return stats.decision_table(one, [
        stats.decision("skill", failed == "", F.format_string("improvement %.2f%%, %d fold wins", "effect", "fold_wins"), failed),
        stats.decision("bias", small, F.format_string("bias %.2f%%", "bias"), F.when(small, "").otherwise("bias_above_limit")),
        stats.decision("change_claim", F.lit(False), F.lit("fixed by design"), F.lit("claim_boundary"), F.lit("report levels only")),
    ])


@query("v11_transition_gate", f"""WITH {PANEL}, c AS (SELECT a.year, a.aadt - b.aadt AS o, 0.1 * b.aadt AS p FROM panel a JOIN panel b ON a.station_id = b.station_id AND a.year = b.year + 1 WHERE a.year IN (1997, 1998)), g AS (SELECT year, 100.0 * (avg(abs(o)) - avg(abs(p - o))) / avg(abs(o)) AS i, corr(o, p) AS r FROM c GROUP BY year)
SELECT bool_and(i > 0 AND r > 0) AS pass, arg_max(year, i) AS best_year, count(*) AS transitions FROM g""")
def _(spark, sf):
    from fathomline.operators.panel import consecutive

    c = consecutive(panel(spark, sf), ["station_id"], "year", ["aadt"]).where(F.col("year").isin(1997, 1998))
    c = c.select("year", (F.col("aadt_current") - F.col("aadt_previous")).alias("o"), (0.1 * F.col("aadt_previous")).alias("p"))
    g = c.groupBy("year").agg(*stats.change_metrics("o", "p"))
    return g.agg(F.every((F.col("improvement_percent") > 0) & (F.col("correlation") > 0)).alias("pass"), F.max_by("year", "improvement_percent").alias("best_year"), F.count(F.lit(1)).alias("transitions"))


@query("l01_training_median", f"WITH {OOF} SELECT station_id, fold, predicted FROM oof WHERE model = 'median'")
def _(spark, sf):
    return out_of_fold(spark, sf).where("model = 'median'").select("station_id", "fold", "predicted")


@query("l03_e01_hierarchy_lookup", f"WITH {OOF} SELECT station_id, fold, predicted FROM oof WHERE model = 'hierarchy'")
def _(spark, sf):
    return out_of_fold(spark, sf).where("model = 'hierarchy'").select("station_id", "fold", "predicted")


@query("l07_persistence_expanding", f"WITH {PANEL} SELECT a.station_id, a.year, b.aadt AS persistence, round((SELECT avg(c.aadt) FROM panel c WHERE c.station_id = a.station_id AND c.year < a.year), 4) AS expanding_mean FROM panel a JOIN panel b ON a.station_id = b.station_id AND a.year = b.year + 1")
def _(spark, sf):
    p = models.expanding_mean(panel(spark, sf), "station_id", "year", "aadt")
    q = models.persistence(p, "station_id", "year", "aadt")
    return q.select("station_id", "year", "persistence", F.round("expanding_mean", 4).alias("expanding_mean"))


@query("l08_hierarchy_trend", f"WITH {PANEL}, {STATIONS}, m AS (SELECT segment, year, median(aadt) AS v FROM panel JOIN stations USING (station_id) WHERE year < 2001 GROUP BY 1, 2) SELECT segment, round(greatest(regr_intercept(v, year - 2001), 0), 4) AS trend, count(*) AS n_periods FROM m GROUP BY segment")
def _(spark, sf):
    m = panel(spark, sf).join(stations(spark, sf), "station_id").where("year < 2001").groupBy("segment", "year").agg(F.median("aadt").alias("v"))
    return rounded(stats.slope_or_last(m, ["segment"], "year", "v", 2001))


@query("l09_l10_factor_scaling", f"""WITH {PANEL}, {STATIONS}, r AS (SELECT a.station_id, s.fold, b.aadt AS base, a.aadt / b.aadt AS ratio FROM panel a JOIN panel b ON a.station_id = b.station_id AND a.year = 1998 AND b.year = 1997 JOIN stations s ON s.station_id = a.station_id),
f AS (SELECT h.held, median(ratio) AS factor FROM r, (SELECT unnest([1, 2, 3, 4, 5]) AS held) h WHERE r.fold <> h.held GROUP BY h.held) SELECT station_id, fold, round(greatest(base * factor, 1.0), 4) AS predicted FROM r JOIN f ON f.held = r.fold""")
def _(spark, sf):
    from fathomline.operators.panel import period_pairs

    r = period_pairs(panel(spark, sf), ["station_id"], "year", ["aadt"], [(1997, 1998)]).join(stations(spark, sf), "station_id")
    r = r.select("station_id", "fold", F.col("aadt_from").alias("base"), (F.col("aadt_to") / F.col("aadt_from")).alias("ratio"))
    f = models.leave_fold_out_factor(r, "fold", [1, 2, 3, 4, 5], "ratio").withColumnRenamed("held", "fold")
    return r.join(f, "fold").select("station_id", "fold", F.round(models.scaled_by_factor(F.col("base"), F.col("factor")), 4).alias("predicted"))


@query("l13_transfer_matrix", f"WITH {PANEL}, {STATIONS}, t AS (SELECT segment, year AS trained, median(aadt) AS prediction FROM panel JOIN stations USING (station_id) WHERE year IN (1996, 1998) GROUP BY 1, 2) SELECT t.trained, p.year, round(avg(abs(t.prediction - p.aadt)), 4) AS mae, count(*) AS n FROM t JOIN stations s USING (segment) JOIN panel p ON p.station_id = s.station_id WHERE p.year IN (1996, 1998) GROUP BY 1, 2")
def _(spark, sf):
    b = panel(spark, sf).where(F.col("year").isin(1996, 1998)).join(stations(spark, sf).select("station_id", "segment"), "station_id")
    t = b.groupBy("segment", F.col("year").alias("trained")).agg(F.median("aadt").alias("prediction"))
    return rounded(models.transfer_matrix(t, b.withColumnRenamed("aadt", "observed"), "segment", "trained", "year"))
