"""Queries of scans, predicates, joins, aggregations, windows and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fathomline.operators import panel as op
from fathomline.operators.checks import duplicate_keys, join_checked, key_difference, null_counts, split_groups
from fathomline.operators.stats import annualised_change, percent_change
from fathomline.plans.frames import PANEL, SNAPSHOTS, STATIONS, panel, snapshots, stations
from fathomline.plans.registry import query
from fathomline.session import table


@query("p01_p03_filter_project", "SELECT o_orderkey, o_custkey, round(o_totalprice * 0.001, 6) AS price_k FROM orders WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 1000 AND 200000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def _(spark, sf):
    o = table(spark, sf, "orders")
    return o.where("o_orderstatus = 'F' AND o_totalprice BETWEEN 1000 AND 200000").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_custkey", F.round(F.col("o_totalprice") * 0.001, 6).alias("price_k"))


@query("p04_p06_ladders_and_reasons", """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'negative' WHEN c_acctbal < 3000 THEN 'low' WHEN c_acctbal < 7000 THEN 'medium' ELSE 'high' END AS tier,
  array_to_string(list_filter([CASE WHEN c_acctbal < 0 THEN 'negative_balance' END, CASE WHEN c_nationkey < 5 THEN 'low_nation' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'building' END], lambda x: x IS NOT NULL), ';') AS reasons,
  greatest(1.0, least(c_acctbal, 5000.0)) AS clipped, sign(c_acctbal)::INTEGER AS direction FROM customer""")
def _(spark, sf):
    from fathomline.functions.text import reasons

    c, b = table(spark, sf, "customer"), F.col("c_acctbal")
    return c.select(
        "c_custkey", F.when(b < 0, "negative").when(b < 3000, "low").when(b < 7000, "medium").otherwise("high").alias("tier"),
        reasons((b < 0, "negative_balance"), (F.col("c_nationkey") < 5, "low_nation"), (F.col("c_mktsegment") == "BUILDING", "building")).alias("reasons"),
        F.greatest(F.lit(1.0), F.least(b, F.lit(5000.0))).alias("clipped"), F.signum(b).cast("int").alias("direction"),
    )


@query("p08_p10_coalesce_and_casts", """SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k, coalesce(try_cast(json_extract_string(props, '$.missing') AS DOUBLE), value, 0.0) AS first_known,
  lower(trim(event_type)) = 'click' AS is_click FROM events""")
def _(spark, sf):
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").try_cast("double")
    return e.select("event_id", k.alias("k"), F.coalesce(F.get_json_object("props", "$.missing").try_cast("double"), "value", F.lit(0.0)).alias("first_known"), (F.lower(F.trim("event_type")) == "click").alias("is_click"))


@query("p13_p17_region_and_keywords", "SELECT p_partkey, CASE WHEN p_partkey < 300 THEN 'island' WHEN p_partkey < 700 THEN 'middle' ELSE 'outer' END AS region, p_size BETWEEN 1 AND 10 AS small, contains(lower(p_type), 'steel') AS steel, substr(p_brand, 1, 1) AS initial FROM part")
def _(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    return p.select("p_partkey", F.when(k < 300, "island").when(k < 700, "middle").otherwise("outer").alias("region"), F.col("p_size").between(1, 10).alias("small"), F.lower("p_type").contains("steel").alias("steel"), F.substring("p_brand", 1, 1).alias("initial"))


@query("p16_e14_change_flags", f"""WITH s AS (SELECT o_custkey AS station_id, year(o_orderdate)::INTEGER AS year, arg_min(o_orderstatus, o_orderkey) AS status, arg_min(o_orderpriority, o_orderkey) AS priority FROM orders GROUP BY 1, 2)
SELECT a.year, count(*) AS n_pairs, count(*) FILTER (WHERE coalesce(a.status, '') <> coalesce(b.status, '') OR coalesce(a.priority, '') <> coalesce(b.priority, '')) AS n_changed FROM s a JOIN s b ON a.station_id = b.station_id AND a.year = b.year + 1 GROUP BY a.year""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    s = o.groupBy(F.col("o_custkey").alias("station_id"), F.year("o_orderdate").alias("year")).agg(F.min_by("o_orderstatus", "o_orderkey").alias("status"), F.min_by("o_orderpriority", "o_orderkey").alias("priority"))
    pairs = op.consecutive(s, ["station_id"], "year", ["status", "priority"])
    changed = op.changed_any([("status_previous", "status_current"), ("priority_previous", "priority_current")])
    return pairs.groupBy("year").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(changed).alias("n_changed"))


@query("j01_j02_checked_joins", f"WITH {PANEL}, {STATIONS} SELECT fold, count(*) AS n, round(sum(aadt), 2) AS total FROM panel LEFT JOIN stations USING (station_id) GROUP BY fold")
def _(spark, sf):
    joined = join_checked(panel(spark, sf), stations(spark, sf), ["station_id"])
    return joined.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("aadt"), 2).alias("total"))


@query("j03_composite_join", f"WITH {PANEL}, {STATIONS}, f AS (SELECT year, fold, round(avg(aadt), 4) AS cell_mean FROM panel JOIN stations USING (station_id) GROUP BY 1, 2) SELECT station_id, year, fold, aadt, cell_mean FROM panel JOIN stations USING (station_id) LEFT JOIN f USING (year, fold)")
def _(spark, sf):
    base = panel(spark, sf).join(stations(spark, sf).select("station_id", "fold"), "station_id")
    cells = base.groupBy("year", "fold").agg(F.round(F.avg("aadt"), 4).alias("cell_mean"))
    return base.join(cells, ["year", "fold"], "left").select("station_id", "year", "fold", "aadt", "cell_mean")


@query("j04_m01_consecutive_changes", f"WITH {PANEL} SELECT a.station_id, a.year, a.aadt AS aadt_current, b.aadt AS aadt_previous, round(100.0 * (a.aadt - b.aadt) / b.aadt, 4) AS change_pct FROM panel a JOIN panel b ON a.station_id = b.station_id AND a.year = b.year + 1")
def _(spark, sf):
    pairs = op.consecutive(panel(spark, sf), ["station_id"], "year", ["aadt"])
    return pairs.withColumn("change_pct", F.round(percent_change(F.col("aadt_previous"), F.col("aadt_current")), 4))


@query("j05_period_pairs", f"WITH {PANEL}, pairs(year_from, year_to) AS (VALUES (1995, 1998), (1998, 2000), (1995, 2000)) SELECT a.station_id, year_from, year_to, a.aadt AS aadt_from, b.aadt AS aadt_to, round(100.0 * (pow(b.aadt / a.aadt, 1.0 / (year_to - year_from)) - 1), 4) AS annualised FROM pairs JOIN panel a ON a.year = year_from JOIN panel b ON b.year = year_to AND a.station_id = b.station_id")
def _(spark, sf):
    pairs = op.period_pairs(panel(spark, sf), ["station_id"], "year", ["aadt"], [(1995, 1998), (1998, 2000), (1995, 2000)])
    return pairs.withColumn("annualised", F.round(annualised_change(F.col("aadt_from"), F.col("aadt_to"), F.col("year_to") - F.col("year_from")), 4))


@query("j06_symmetric_difference", f"WITH {PANEL}, a AS (SELECT DISTINCT station_id FROM panel WHERE year = 1996), b AS (SELECT DISTINCT station_id FROM panel WHERE year = 1999) SELECT coalesce(a.station_id, b.station_id) AS station_id, a.station_id IS NOT NULL AS in_left, b.station_id IS NOT NULL AS in_right FROM a FULL JOIN b ON a.station_id = b.station_id WHERE a.station_id IS NULL OR b.station_id IS NULL")
def _(spark, sf):
    p = panel(spark, sf)
    return op.one_side_only(p.where("year = 1996"), p.where("year = 1999"), "station_id")


@query("j07_presence_pivot", f"WITH {PANEL} SELECT station_id, max(aadt) FILTER (WHERE year = 1995) AS aadt_1995, max(aadt) FILTER (WHERE year = 1998) AS aadt_1998, max(aadt) FILTER (WHERE year = 2000) AS aadt_2000, count(*) FILTER (WHERE year = 1995) > 0 AS present_1995, count(*) FILTER (WHERE year = 1998) > 0 AS present_1998, count(*) FILTER (WHERE year = 2000) > 0 AS present_2000 FROM panel WHERE year IN (1995, 1998, 2000) GROUP BY station_id")
def _(spark, sf):
    return op.presence(panel(spark, sf), "station_id", "year", [1995, 1998, 2000], "aadt")


@query("j08_j09_semi_anti", "SELECT 'with_orders' AS part, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'without_orders', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(spark, sf):
    c, o = table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    count = lambda how, name: c.join(o, "k", how).agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"))
    return count("left_semi", "with_orders").unionByName(count("left_anti", "without_orders"))


@query("j10_indicator", f"WITH {PANEL} SELECT a.station_id, b.station_id IS NOT NULL AS matched FROM (SELECT DISTINCT station_id FROM panel WHERE year = 1997) a LEFT JOIN (SELECT DISTINCT station_id FROM panel WHERE year = 1998) b ON a.station_id = b.station_id")
def _(spark, sf):
    p = panel(spark, sf)
    return op.with_indicator(p.where("year = 1997").select("station_id"), p.where("year = 1998").select("station_id"), ["station_id"])


@query("j11_lookup_with_default", "SELECT c_custkey, coalesce(n_name, 'unknown') AS nation FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey")
def _(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation").where("n_nationkey < 20")
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").select("c_custkey", F.coalesce("n_name", F.lit("unknown")).alias("nation"))


@query("j12_fallback_lookup", f"""WITH {PANEL}, {STATIONS}, b AS (SELECT * FROM panel JOIN stations USING (station_id)), t AS (SELECT * FROM b WHERE year < 1999 AND bal > 8000),
a0 AS (SELECT fold, segment, median(aadt) AS v FROM t WHERE fold IS NOT NULL AND segment IS NOT NULL GROUP BY 1, 2), a1 AS (SELECT segment, median(aadt) AS v FROM t WHERE segment IS NOT NULL GROUP BY 1), g AS (SELECT median(aadt) AS v FROM t)
SELECT station_id, b.year, coalesce(a0.v, a1.v, g.v) AS expected, CASE WHEN a0.v IS NOT NULL THEN 0 WHEN a1.v IS NOT NULL THEN 1 ELSE 2 END AS expected_level FROM b LEFT JOIN a0 ON a0.fold = b.fold AND a0.segment = b.segment LEFT JOIN a1 ON a1.segment = b.segment, g WHERE b.year = 2000""")
def _(spark, sf):
    b = panel(spark, sf).join(stations(spark, sf), "station_id")
    return op.fallback_lookup(b.where("year = 2000"), b.where("year < 1999 AND bal > 8000"), [["fold", "segment"], ["segment"]], "aadt", "expected").select("station_id", "year", "expected", "expected_level")


@query("j25_small_dimensions", "SELECT y.year, r_name AS region, m.model FROM (VALUES (1995), (1998)) y(year), region, (VALUES ('a'), ('b')) m(model)")
def _(spark, sf):
    years, models = spark.createDataFrame([(1995,), (1998,)], "year int"), spark.createDataFrame([("a",), ("b",)], "model string")
    return years.crossJoin(table(spark, sf, "region").select(F.col("r_name").alias("region"))).crossJoin(models)


@query("j26_t03_v03_key_sets", f"WITH {PANEL}, a AS (SELECT DISTINCT station_id FROM panel WHERE year = 1996), b AS (SELECT DISTINCT station_id FROM panel WHERE year = 1997) SELECT station_id, 'left' AS side FROM a WHERE station_id NOT IN (SELECT station_id FROM b) UNION ALL SELECT station_id, 'right' FROM b WHERE station_id NOT IN (SELECT station_id FROM a)")
def _(spark, sf):
    p = panel(spark, sf)
    return key_difference(p.where("year = 1996"), p.where("year = 1997"), ["station_id"])


@query("a01_a02_group_aggregates", f"WITH {PANEL}, {STATIONS} SELECT segment, count(*) AS n, round(avg(aadt), 4) AS mean, median(aadt) AS median, min(aadt) AS low, max(aadt) AS high, round(stddev_samp(aadt), 4) AS sd, round(var_samp(bal), 2) AS var_bal, round(stddev_pop(aadt), 4) AS sd0 FROM panel JOIN stations USING (station_id) GROUP BY segment")
def _(spark, sf):
    b = panel(spark, sf).join(stations(spark, sf), "station_id")
    return b.groupBy("segment").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("aadt"), 4).alias("mean"), F.median("aadt").alias("median"), F.min("aadt").alias("low"), F.max("aadt").alias("high"),
        F.round(F.stddev_samp("aadt"), 4).alias("sd"), F.round(F.var_samp("bal"), 2).alias("var_bal"), F.round(F.stddev_pop("aadt"), 4).alias("sd0"),
    )


@query("a03_null_keys_dropped", "WITH d AS (SELECT CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS segment FROM customer) SELECT 'kept' AS rule, segment, count(*) AS n FROM d GROUP BY segment UNION ALL SELECT 'dropped', segment, count(*) FROM d WHERE segment IS NOT NULL GROUP BY segment")
def _(spark, sf):
    d = table(spark, sf, "customer").select(F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("segment"))
    count = lambda df, name: df.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("rule"), "segment", "n")
    return count(d, "kept").unionByName(count(d.where("segment IS NOT NULL"), "dropped"))


@query("a05_quantiles", f"WITH {PANEL} SELECT year, round(quantile_cont(aadt, 0.1), 4) AS p10, round(quantile_cont(aadt, 0.25), 4) AS p25, round(quantile_cont(aadt, 0.9), 4) AS p90, round(quantile_cont(aadt, 0.99), 4) AS p99 FROM panel GROUP BY year")
def _(spark, sf):
    return panel(spark, sf).groupBy("year").agg(*[F.round(F.percentile("aadt", q), 4).alias(n) for n, q in (("p10", 0.1), ("p25", 0.25), ("p90", 0.9), ("p99", 0.99))])


@query("a08_a10_weighted", "SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS weighted_mean, round(sum(CASE WHEN l_discount > 0.05 THEN l_quantity ELSE 0 END) / sum(l_quantity), 6) AS weighted_share, round(avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END), 6) AS row_share, round(sum(l_extendedprice * l_quantity / 1000), 2) AS vkt FROM lineitem GROUP BY l_returnflag")
def _(spark, sf):
    from fathomline.operators.stats import weighted_mean

    q, high = F.col("l_quantity"), F.col("l_discount") > 0.05
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.round(weighted_mean("l_extendedprice", "l_quantity"), 4).alias("weighted_mean"), F.round(F.sum(F.when(high, q).otherwise(0)) / F.sum(q), 6).alias("weighted_share"),
        F.round(F.avg(high.cast("double")), 6).alias("row_share"), F.round(F.sum(F.col("l_extendedprice") * q / 1000), 2).alias("vkt"),
    )


@query("a11_a20_distinct_and_counts", "SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, count(DISTINCT l_partkey) AS parts, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")).agg(F.count_distinct("l_partkey").alias("parts"), F.count(F.lit(1)).alias("n"))


@query("a12_first_non_null", "WITH d AS (SELECT o_custkey AS station_id, o_orderkey AS k, CASE WHEN o_totalprice > 150000 THEN o_orderpriority END AS priority, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END AS status FROM orders) SELECT station_id, arg_min(priority, k) FILTER (WHERE priority IS NOT NULL) AS priority, arg_min(status, k) FILTER (WHERE status IS NOT NULL) AS status FROM d GROUP BY station_id")
def _(spark, sf):
    d = table(spark, sf, "orders").select(F.col("o_custkey").alias("station_id"), F.col("o_orderkey").alias("k"), F.when(F.col("o_totalprice") > 150000, F.col("o_orderpriority")).alias("priority"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("status"))
    return op.first_non_null(d, ["station_id"], "k", ["priority", "status"])


@query("a13_a14_w10_latest_rows", "SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def _(spark, sf):
    o = table(spark, sf, "orders")
    return op.latest(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")


@query("a15_a16_mode_and_lists", "WITH c AS (SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2), m AS (SELECT l_suppkey, min(l_linenumber) AS mode FROM (SELECT *, max(n) OVER (PARTITION BY l_suppkey) AS best FROM c) WHERE n = best GROUP BY 1) SELECT l_suppkey, any_value(m.mode) AS mode, array_to_string(list_sort(list(DISTINCT l_returnflag)), ';') AS flags FROM lineitem JOIN m USING (l_suppkey) GROUP BY l_suppkey")
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.mode("l_linenumber", True).alias("mode"), F.array_join(F.sort_array(F.collect_set("l_returnflag")), ";").alias("flags"))


@query("a18_node_degrees", "WITH e AS (SELECT l_orderkey, l_linenumber, unnest([l_partkey, l_suppkey + 1000000]) AS node FROM lineitem), g AS (SELECT node, count(*) AS degree FROM e GROUP BY node) SELECT l_orderkey, l_linenumber, min(degree) AS degree_min, max(degree) AS degree_max, avg(degree) AS degree_mean FROM e JOIN g USING (node) GROUP BY 1, 2")
def _(spark, sf):
    from fathomline.operators.spatial import node_degrees

    line = table(spark, sf, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("key"), F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1000000).alias("b"))
    return node_degrees(line, "key", "a", "b").select("key.l_orderkey", "key.l_linenumber", "degree_min", "degree_max", "degree_mean")


@query("a19_layer_enrichment", "SELECT l_partkey, count(*) AS n, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS returned, max(l_quantity) AS most, coalesce(min(CASE WHEN l_discount > 0.09 THEN l_quantity END), 50.0) AS speed_min FROM lineitem GROUP BY l_partkey")
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("returned"), F.max("l_quantity").alias("most"), F.coalesce(F.min(F.when(F.col("l_discount") > 0.09, F.col("l_quantity"))), F.lit(50.0)).alias("speed_min"))


@query("a25_pivot", f"WITH {PANEL}, {STATIONS} SELECT fold, round(coalesce(avg(aadt) FILTER (WHERE year = 1996), 0), 4) AS y1996, round(coalesce(avg(aadt) FILTER (WHERE year = 1997), 0), 4) AS y1997 FROM panel JOIN stations USING (station_id) GROUP BY fold")
def _(spark, sf):
    b = panel(spark, sf).join(stations(spark, sf), "station_id")
    wide = b.groupBy("fold").pivot("year", [1996, 1997]).agg(F.avg("aadt")).na.fill(0)
    return wide.select("fold", F.round("`1996`", 4).alias("y1996"), F.round("`1997`", 4).alias("y1997"))


@query("a26_unpivot", "SELECT p_partkey, 'size' AS measure, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part")
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return p.unpivot(["p_partkey"], ["size", "price"], "measure", "value")


@query("a27_distribution_rows", f"WITH {PANEL} SELECT year, unnest(['mean', 'median', 'p90']) AS metric, unnest([round(avg(aadt), 4), median(aadt), round(quantile_cont(aadt, 0.9), 4)]) AS value FROM panel GROUP BY year")
def _(spark, sf):
    wide = panel(spark, sf).groupBy("year").agg(F.round(F.avg("aadt"), 4).alias("mean"), F.median("aadt").alias("median"), F.round(F.percentile("aadt", 0.9), 4).alias("p90"))
    return wide.unpivot(["year"], ["mean", "median", "p90"], "metric", "value")


@query("a28_attrition_funnel", "WITH s AS (SELECT count(*) AS a, count(*) FILTER (WHERE o_orderstatus = 'F') AS b, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice > 100000) AS c FROM orders) SELECT 0 AS stage_order, 'all' AS stage, a AS n, NULL::DOUBLE AS from_previous, 1.0::DOUBLE AS from_start FROM s UNION ALL SELECT 1, 'finished', b, b / a, b / a FROM s UNION ALL SELECT 2, 'large', c, c / b, c / a FROM s")
def _(spark, sf):
    return op.funnel(table(spark, sf, "orders"), [("all", F.lit(True)), ("finished", F.col("o_orderstatus") == "F"), ("large", F.col("o_totalprice") > 100000)])


@query("a29_longest_run", f"WITH {PANEL}, r AS (SELECT station_id, year, year - row_number() OVER (PARTITION BY station_id ORDER BY year) AS island FROM panel), g AS (SELECT station_id, count(*) AS n, min(year) AS first FROM r GROUP BY station_id, island) SELECT station_id, max(n) AS longest_run, min(first) FILTER (WHERE n = best) AS run_start FROM (SELECT *, max(n) OVER (PARTITION BY station_id) AS best FROM g) GROUP BY station_id")
def _(spark, sf):
    return op.longest_run(panel(spark, sf), ["station_id"], "year")


@query("a30_pooled_parts", f"WITH {PANEL}, {STATIONS}, g AS (SELECT fold, avg(aadt) AS m, count(*) AS w FROM panel JOIN stations USING (station_id) GROUP BY fold) SELECT round(sum(m * w) / sum(w), 4) AS pooled FROM g")
def _(spark, sf):
    g = panel(spark, sf).join(stations(spark, sf), "station_id").groupBy("fold").agg(F.avg("aadt").alias("m"), F.count(F.lit(1)).alias("w"))
    return g.agg(F.round(F.sum(F.col("m") * F.col("w")) / F.sum("w"), 4).alias("pooled"))


@query("w01_w02_ranks", f"WITH {PANEL} SELECT station_id, year, row_number() OVER (PARTITION BY year ORDER BY aadt DESC, station_id) AS place FROM panel QUALIFY place <= 8")
def _(spark, sf):
    w = Window.partitionBy("year").orderBy(F.desc("aadt"), "station_id")
    return panel(spark, sf).withColumn("place", F.row_number().over(w).cast("long")).where("place <= 8").select("station_id", "year", "place")


@query("w07_o03_first_arg_min", f"WITH {PANEL} SELECT year, arg_min(station_id, struct_pack(a := aadt, s := station_id)) AS station_id FROM panel GROUP BY year")
def _(spark, sf):
    return panel(spark, sf).groupBy("year").agg(F.min_by("station_id", F.struct("aadt", "station_id")).alias("station_id"))


@query("w08_monotonic", f"WITH {PANEL}, {STATIONS}, m AS (SELECT fold, year, median(aadt) AS v FROM panel JOIN stations USING (station_id) WHERE year < 2001 GROUP BY 1, 2), d AS (SELECT fold, v - lag(v) OVER (PARTITION BY fold ORDER BY year) AS d FROM m) SELECT fold, bool_and(d >= 0) AS rising, bool_and(d <= 0) AS falling FROM d WHERE d IS NOT NULL GROUP BY fold")
def _(spark, sf):
    m = panel(spark, sf).join(stations(spark, sf), "station_id").where("year < 2001").groupBy("fold", "year").agg(F.median("aadt").alias("v"))
    d = m.withColumn("d", F.col("v") - F.lag("v").over(Window.partitionBy("fold").orderBy("year"))).where("d IS NOT NULL")
    return d.groupBy("fold").agg(F.every(F.col("d") >= 0).alias("rising"), F.every(F.col("d") <= 0).alias("falling"))


@query("w09_change_vs_previous", f"WITH {PANEL}, t AS (SELECT year, round(sum(aadt), 2) AS total FROM panel GROUP BY year) SELECT year, total, round(100.0 * (total - lag(total) OVER (ORDER BY year)) / lag(total) OVER (ORDER BY year), 4) AS change_pct FROM t")
def _(spark, sf):
    t = panel(spark, sf).groupBy("year").agg(F.round(F.sum("aadt"), 2).alias("total"))
    before = F.lag("total").over(Window.orderBy("year"))  # one row per year
    return t.withColumn("change_pct", F.round(percent_change(before, F.col("total")), 4))


@query("w11_closest_timestamp", f"WITH {SNAPSHOTS} SELECT detector_id, month, ts, abs(hour(ts) * 60 + minute(ts) - 780)::INTEGER AS offset_minutes FROM snapshots WHERE abs(hour(ts) * 60 + minute(ts) - 780) <= 15 QUALIFY row_number() OVER (PARTITION BY detector_id, month ORDER BY abs(hour(ts) * 60 + minute(ts) - 780), hour(ts) * 60 + minute(ts), ts) = 1")
def _(spark, sf):
    s = snapshots(spark, sf).withColumn("at", F.hour("ts") * 60 + F.minute("ts"))
    ordered = s.groupBy("detector_id", "month", "at").agg(F.min("ts").alias("ts"))
    return op.closest(ordered, ["detector_id", "month"], F.col("at"), F.lit(780), 15).select("detector_id", "month", "ts", F.col("offset").cast("int").alias("offset_minutes"))


@query("w12_carry_forward", "WITH d AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN length(text)::INTEGER END AS label FROM conversations) SELECT conv_id, turn, last_value(label IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS label FROM d")
def _(spark, sf):
    d = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.length("text")).alias("label"))
    return op.carry_forward(d, ["conv_id"], ["turn"], "label")


@query("o02_numeric_text_order_whole", "SELECT p_name, row_number() OVER (ORDER BY coalesce(try_cast(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT), 1000000000000), p_brand, p_partkey) AS place, p_partkey FROM part")
def _(spark, sf):
    number = F.coalesce(F.regexp_extract("p_brand", r"(\d+)", 1).try_cast("bigint"), F.lit(10**12))
    return op.numbered(table(spark, sf, "part"), [number, F.col("p_brand"), F.col("p_partkey")]).select("p_name", "place", "p_partkey")


@query("o05_stratified_sample", "SELECT c_custkey, c_mktsegment FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('42|' || c_custkey), c_custkey) <= 25")
def _(spark, sf):
    return op.stratified_sample(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"], "c_custkey", 25)


@query("t01_t02_unions_and_common_keys", f"WITH {PANEL} SELECT station_id FROM panel WHERE year IN (1996, 1997, 1998) GROUP BY station_id HAVING count(DISTINCT year) = 3")
def _(spark, sf):
    p = panel(spark, sf)
    years = [p.where(f"year = {y}").select("station_id", "year") for y in (1996, 1997, 1998)]
    return years[0].unionByName(years[1]).unionByName(years[2]).groupBy("station_id").agg(F.count_distinct("year").alias("n")).where("n = 3").select("station_id")


@query("t04_k04_upsert", "WITH old AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 2 = 0), new AS (SELECT c_custkey AS k, c_acctbal + 1 AS v FROM customer WHERE c_custkey % 3 = 0) SELECT * FROM old WHERE k NOT IN (SELECT k FROM new) UNION ALL SELECT * FROM new")
def _(spark, sf):
    c = table(spark, sf, "customer")
    old = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    new = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") + 1).alias("v"))
    return op.upsert(old, new, ["k"])


@query("t05_snapshot_difference", "WITH s AS (SELECT o_custkey AS k, year(o_orderdate) AS y, arg_min(o_orderstatus, o_orderkey) AS status, arg_min(o_orderpriority, o_orderkey) AS priority FROM orders GROUP BY 1, 2), a AS (SELECT * FROM s WHERE y = 1996), b AS (SELECT * FROM s WHERE y = 1997), j AS (SELECT a.k AS ak, b.k AS bk, a.status AS s1, b.status AS s2, a.priority AS p1, b.priority AS p2 FROM a FULL JOIN b ON a.k = b.k) SELECT unnest(['status', 'priority', 'only_left', 'only_right']) AS field, unnest([count(*) FILTER (WHERE ak IS NOT NULL AND bk IS NOT NULL AND s1 IS DISTINCT FROM s2), count(*) FILTER (WHERE ak IS NOT NULL AND bk IS NOT NULL AND p1 IS DISTINCT FROM p2), count(*) FILTER (WHERE bk IS NULL), count(*) FILTER (WHERE ak IS NULL)]) AS n_changed FROM j")
def _(spark, sf):
    s = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y")).agg(F.min_by("o_orderstatus", "o_orderkey").alias("status"), F.min_by("o_orderpriority", "o_orderkey").alias("priority"))
    return op.snapshot_difference(s.where("y = 1996"), s.where("y = 1997"), "k", ["status", "priority"])


@query("v02_v05_contract_rows", "WITH d AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1), f AS (SELECT l_partkey, count(DISTINCT l_suppkey % 5) AS n FROM lineitem GROUP BY 1 HAVING n > 1) SELECT 'duplicate_keys' AS contract, count(*) AS n FROM d UNION ALL SELECT 'split_groups', count(*) FROM f UNION ALL SELECT 'null_text', count(*) FROM documents WHERE text IS NULL")
def _(spark, sf):
    line = table(spark, sf, "lineitem").select("l_partkey", (F.col("l_suppkey") % 5).alias("fold"))
    count = lambda df, name: df.agg(F.lit(name).alias("contract"), F.count(F.lit(1)).alias("n"))
    nulls = null_counts(table(spark, sf, "documents"), ["text"]).select(F.lit("null_text").alias("contract"), F.col("n_null").alias("n"))
    return count(duplicate_keys(table(spark, sf, "orders"), ["o_custkey"]), "duplicate_keys").unionByName(count(split_groups(line, "l_partkey", "fold"), "split_groups")).unionByName(nulls)
