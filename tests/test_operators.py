import difflib

import pytest
from pyspark.sql import functions as F

from fathomline.functions import dates, text
from fathomline.operators import boosting, checks, detectors, models, overlay, panel, spatial, stats
from fathomline.operators.graph import components
from fathomline.sources import readers, sinks


def test_contracts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "k int, v string")
    assert checks.required_columns(df, ["k", "z"]) == ["z"]
    with pytest.raises(checks.ContractError):
        checks.require(df, keys=["k"])
    with pytest.raises(checks.ContractError):
        checks.join_checked(df, df, ["k"])
    assert checks.same_rows(df, df.orderBy(F.desc("k"))) and not checks.same_rows(df, df.limit(1))


def test_first_non_null_takes_columns_from_different_rows(spark):
    df = spark.createDataFrame([(1, 2001, None, "x"), (1, 2002, "a", None), (2, 2001, None, None)], "k int, y int, p string, q string")
    got = {r.k: (r.p, r.q) for r in panel.first_non_null(df, ["k"], "y", ["p", "q"]).collect()}
    assert got == {1: ("a", "x"), 2: (None, None)}


def test_consecutive_needs_the_very_next_period(spark):
    df = spark.createDataFrame([(1, 1, 10.0), (1, 3, 30.0), (1, 4, 40.0)], "k int, y int, v double")
    assert [(r.y, r.v_previous, r.v_current) for r in panel.consecutive(df, ["k"], "y", ["v"]).collect()] == [(4, 30.0, 40.0)]


def test_mutual_best_equals_greedy(spark):
    import random

    random.seed(3)
    pairs = [(a, b, random.random()) for a in range(12) for b in range(12) if random.random() < 0.5]
    used_a, used_b, want = set(), set(), set()
    for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in used_a and b not in used_b:
            used_a.add(a), used_b.add(b), want.add((a, b))
    df = spark.createDataFrame(pairs, "a int, b int, s double")
    assert {(r.a, r.b) for r in panel.mutual_best(df, "a", "b", [(-F.col("s")).alias("o")]).collect()} == want


def test_numbered_gives_every_row_its_place(spark):
    # More than one partition, ties, and ids without digits last.
    df = spark.range(3000).select("id", F.when(F.col("id") % 7 == 0, "none").otherwise(F.concat(F.lit("Brand#"), (F.col("id") * 37 % 211).cast("string"))).alias("brand")).repartition(5, F.rand(4))
    number = F.coalesce(F.regexp_extract("brand", r"(\d+)", 1).try_cast("bigint"), F.lit(10**12))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = panel.numbered(df, [number, F.col("brand"), F.col("id")])
        assert [r.id for r in got.orderBy("place").collect()] == sorted(range(3000), key=lambda i: (10**12, i) if i % 7 == 0 else (i * 37 % 211, i))
        assert sorted(r.place for r in got.collect()) == list(range(1, 3001))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert panel.numbered(df.where("id < 0"), [F.col("id")]).count() == 0


def greedy(pairs):
    """Pairs one by one from the smallest (distance, left, right)."""
    used_a, used_b, want = set(), set(), set()
    for a, b, s in sorted(pairs, key=lambda p: (p[2], p[0], p[1])):
        if a not in used_a and b not in used_b:
            used_a.add(a), used_b.add(b), want.add((a, b))
    return want


@pytest.mark.parametrize("tail", [0, 20_000])
def test_mutual_best_settles_every_pair_of_a_hot_cell(spark, tail):
    import random

    # 70 x 60 points at one place, apart from them a square that is not complete, and random ties.
    hot = [(a, b, 0.0) for a in range(70) for b in range(60)]
    random.seed(9)
    ties = [(100 + a, 100 + b, float(random.randrange(3))) for a in range(15) for b in range(15) if random.random() < 0.6]
    square = [(200, 201, 1.0), (200, 202, 1.0), (201, 201, 1.0)]
    pairs = hot + ties + square
    got = panel.mutual_best(spark.createDataFrame(pairs, "a int, b int, s double"), "a", "b", [F.col("s")], tail).collect()
    assert len(got) == len({(r.a, r.b) for r in got}) and {(r.a, r.b) for r in got} == greedy(pairs)
    assert sum(r.a < 70 for r in got) == 60


def test_mutual_best_settles_a_long_chain(spark):
    # Distances fall along the chain: a round settles one pair.
    pairs = [(i // 2 + i % 2, i // 2, 1000.0 - i) for i in range(240)]
    got = panel.mutual_best(spark.createDataFrame(pairs, "a int, b int, s double"), "a", "b", [F.col("s")]).collect()
    assert {(r.a, r.b) for r in got} == greedy(pairs) and len(got) == 120
    assert panel.mutual_best(spark.createDataFrame([], "a int, b int, s double"), "a", "b", [F.col("s")]).count() == 0


def test_components_any_order(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (5, 5)]
    for seed in (1, 2):
        df = spark.createDataFrame(edges, "src int, dst int").orderBy(F.rand(seed))
        got = {r.node: r.component for r in components(df).collect()}
        assert all(got[i] == 0 for i in range(31)) and got[101] == 100
    assert components(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_components_of_the_whole_line_table(spark, tmp_path):
    from fathomline.plans import registry

    # Few orders are divisible by 20, and keys that are equal modulo 1500 are different parts.
    lines = [(o, p) for o in range(1, 60) for p in (o // 4 * 1500 + 1, 50_000 + o // 8)] + [(900, 7), (901, 1507), (40, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r.node: r.component for r in registry.queries()["n13_components_whole"](spark, str(tmp_path)).collect()}
    groups: list[set] = []
    for o, p in lines:
        if p is not None:
            met = [g for g in groups if o in g or -1 - p in g]
            groups = [g for g in groups if g not in met] + [set().union({o, -1 - p}, *met)]
    assert got == {n: min(g) for g in groups for n in g}
    assert len(groups) == 10 and got[900] != got[901]


def test_pearson_guards(spark):
    df = spark.createDataFrame([("c", 1.0, 1.0), ("c", 1.0, 2.0), ("c", 1.0, 3.0), ("n", 1.0, 2.0), ("ok", 1.0, 2.0), ("ok", 2.0, 4.0), ("ok", 3.0, 6.0), ("ok", None, 9.0)], "g string, x double, y double")
    got = {r.g: r.r for r in df.groupBy("g").agg(stats.pearson("x", "y").alias("r")).collect()}
    assert got["c"] is None and got["n"] is None and got["ok"] == pytest.approx(1.0)


def test_bins_match_a_pandas_oracle(spark):
    import pandas as pd

    values = [1.0, 1.0, 1.0, 2.0, 3.0, 5.0, 8.0, 13.0, 21.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    edges = stats.quantile_edges(df, "v", 4)
    got = {r.i: r.b for r in df.crossJoin(edges).select("i", stats.bin_of(F.col("v"), F.col("edges")).alias("b")).collect()}
    want = pd.qcut(pd.Series(values), 4, labels=False, duplicates="drop") + 1
    assert [got[i] for i in range(len(values))] == want.tolist()
    first = {r.i: r.bin for r in stats.equal_count_bin(df.withColumn("g", F.lit(1)), "v", 4, ["g"], "i").collect()}
    ranked = pd.qcut(pd.Series(values).rank(method="first"), 4, labels=False) + 1
    assert [first[i] for i in range(len(values))] == ranked.tolist()


def test_wilson_and_improvement_replay_published_arithmetic(spark):
    one = spark.range(1)
    low, high = stats.wilson(F.lit(6.0), F.lit(99.0))
    r = one.select((100 * low).alias("l"), (100 * high).alias("h"), stats.improvement(F.lit(11041.64), F.lit(10290.98)).alias("i"), stats.improvement(F.lit(3.0), F.lit(3.0)).alias("z")).first()
    assert (round(r.l, 2), round(r.h, 2)) == (2.81, 12.60) and round(r.i, 2) == 6.80 and r.z == 0


def test_fold_bootstrap_is_the_full_enumeration(spark):
    import itertools

    import numpy as np

    data = [(f, v) for f in range(1, 4) for v in (f * 1.0, f * f * 1.0)]
    got = stats.fold_bootstrap_exact(spark.createDataFrame(data, "f int, v double"), "f", F.col("v"), 3).first()
    sums = {f: (f + f * f, 2) for f in range(1, 4)}
    xs = [sum(sums[f][0] for f in d) / sum(sums[f][1] for f in d) for d in itertools.product(sums, repeat=3)]
    assert got.draws == 27 and got.low == pytest.approx(np.quantile(xs, 0.025)) and got.high == pytest.approx(np.quantile(xs, 0.975))


def test_registered_models_have_the_settings_of_the_reference(spark, monkeypatch):
    import inspect

    from fathomline.plans import registry

    seen = []

    def recorded(f):
        def run(*args, **kwargs):
            bound = inspect.signature(f).bind(*args, **kwargs)
            bound.apply_defaults()
            seen.append(bound.arguments)
            return args[0].withColumn("prediction", F.lit(1.0))

        return run

    monkeypatch.setattr(boosting, "out_of_fold", recorded(boosting.out_of_fold))
    for name in ("l04_l06_boosted_trees", "l05_poisson_model", "l05_squared_trees"):
        registry.queries()[name](spark, "/root/testdata/sf0.001")
    settings = [(p.rounds, p.rate, p.leaves, p.least_rows, p.penalty, p.loss) for p in (s["params"] for s in seen)]
    assert settings == [(250, 0.05, 15, 20, 1.0, loss) for loss in ("absolute", "poisson", "squared")]


def test_cluster_bootstrap_makes_all_draws(spark):
    from fathomline.plans import registry

    df = spark.createDataFrame([(i, float(i * i % 17)) for i in range(40)], "c int, v double")
    for statistic, n in (("pooled", 1000), ("means", 5000)):
        own, fixed = (stats.cluster_bootstrap(df, "c", F.col("v"), *a, statistic=statistic).first() for a in ((), (n, 42)))
        assert tuple(own) == tuple(fixed) != tuple(stats.cluster_bootstrap(df, "c", F.col("v"), 500, 42, statistic).first())
    plan = registry.queries()["m16_m18_cluster_bootstrap"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert "sequence(1, 1000" in plan and "sequence(1, 5000" in plan and "sequence(1, 500," not in plan


def test_sequence_ratio_is_difflib(spark):
    pairs = [("nathan road", "nathan rd"), ("abcd", "bcde"), ("", "x"), (None, "x")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", text.sequence_ratio("a", "b").alias("r")).collect()
    assert all(r.r == difflib.SequenceMatcher(None, r.a or "", r.b or "").ratio() for r in got)


def test_marks_fold_and_html(spark):
    row = spark.createDataFrame([("Ｃafé STRASSE ß", "<tr><td>A</td><td>1 &amp; <b>2</b></td></tr><tr><td>A</td><td>3</td></tr>")], "t string, h string")
    r = row.select(text.fold_marks("t").alias("t"), text.html_fields(F.col("h")).alias("m")).first()
    assert r.t == "cafe strasse ss" and r.m == {"A": "3"}


def test_grid_join_equals_brute_force_and_has_no_cross_join(spark):
    import random

    random.seed(5)
    a = [(i, random.uniform(-50, 50), random.uniform(-50, 50)) for i in range(60)]
    b = [(i, random.uniform(-50, 50), random.uniform(-50, 50)) for i in range(80)] + [(90, a[0][1], a[0][2])]
    left, right = spark.createDataFrame(a, "k int, x double, y double"), spark.createDataFrame(b, "o int, rx double, ry double")
    d = lambda p, q: ((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2) ** 0.5
    joined = spatial.radius_join(left, right, 9.0)
    assert {(r.k, r.o) for r in joined.collect()} == {(p[0], q[0]) for p in a for q in b if d(p, q) <= 9.0}
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    near = spatial.nearest_join(left, right, "k", "o", 3, 2.0).collect()
    for p in a:
        want = [q[0] for q in sorted(b, key=lambda q: (d(p, q), q[0]))[:3]]
        assert [r.o for r in sorted((r for r in near if r.k == p[0]), key=lambda r: r.place)] == want
    mean = {r.k: r.predicted for r in spatial.inverse_distance(spatial.nearest_join(left, right.withColumn("v", F.col("o") * 1.0), "k", "o", 3, 2.0), "k", "v").collect()}
    assert mean[0] == 90.0  # the zero-distance neighbour alone


def test_segment_distance_and_polygon(spark):
    r = spark.range(1).select(spatial.point_segment(F.lit(0.0), F.lit(1.0), F.lit(2.0), F.lit(0.0), F.lit(2.0), F.lit(0.0)).alias("s"), spatial.ring_area(spatial.parse_coordinates(F.lit("0,0,1 4,0 4,3 bad 0,3"))).alias("a")).first()
    assert r.s.distance == pytest.approx(5**0.5) and r.a == 12.0


def test_service_calendar(spark):
    cal = spark.createDataFrame([("a", "2023-01-01", "2023-12-31", 1, 1, 1, 1, 1, 0, 0), ("b", "2023-01-01", "2023-12-31", 0, 0, 0, 0, 0, 1, 0)], "service_id string, start_date string, end_date string, monday int, tuesday int, wednesday int, thursday int, friday int, saturday int, sunday int")
    exc = spark.createDataFrame([("a", "2023-06-20", 2), ("b", "2023-06-19", 1), ("b", "2023-06-24", 2)], "service_id string, date string, exception_type int")
    of = lambda day: sorted(r.service_id for r in dates.active_services(cal.withColumn("start_date", F.to_date("start_date")).withColumn("end_date", F.to_date("end_date")), exc.withColumn("date", F.to_date("date")), day).collect())
    assert of("2023-06-19") == ["a", "b"] and of("2023-06-20") == [] and of("2023-06-24") == []


def test_lane_snapshot(spark):
    ddl = "sample string, period array<struct<period_from:string,detectors:array<struct<detector_id:string,lanes:array<struct<valid:string,volume:double,speed:double,occupancy:double>>>>>>"
    data = [("s", [("p1", [("d", [("Y", 2.0, 50.0, 1.0), ("Y", 0.0, 80.0, 3.0), ("N", 9.0, 1.0, 1.0)])]), ("p2", [("d", [("Y", 4.0, 60.0, 5.0)])])])]
    r = detectors.lane_snapshot(spark.createDataFrame(data, ddl)).first()
    assert (r.sampled_minute_volume, r.sampled_speed, r.sampled_occupancy) == (3.0, 60.0, 3.5)


def test_support_groups_join_transitively(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b"), (9, "z")], "station int, route string")
    assert {r.station: (r.group, r.n_members) for r in models.support_groups(df, "station", "route").collect()} == {1: (1, 3), 2: (1, 3), 3: (1, 3), 9: (9, 1)}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿k,v\n1,\n2,x\n", encoding="utf-8")
    assert [tuple(r) for r in readers.csv(spark, str(tmp_path / "a.csv"), "k int, v string").collect()] == [(1, None), (2, "x")]
    (tmp_path / "b.csv").write_bytes("k,v\n1,香港\n".encode("big5"))
    assert readers.csv_flexible(spark, str(tmp_path / "b.csv"), "k int, v string").first().v == "香港"
    with pytest.raises(sinks.EmptyResultError):
        sinks.save(spark.createDataFrame([], "k int"), str(tmp_path / "out"))
    (tmp_path / "x.xml").write_text("<L><S><id>1</id><v>2.5</v></S><S><id>2</id></S></L>")
    assert {(r.id, r.v) for r in readers.xml(spark, str(tmp_path / "x.xml"), "S", "id string, v double").collect()} == {("1", 2.5), ("2", None)}
    (tmp_path / "o.json").write_text('{"elements":[{"type":"way","id":1,"tags":{"name":"a"},"geometry":[{"lat":1,"lon":2},{"lat":1,"lon":3}]},{"type":"way","id":2,"tags":{},"geometry":[{"lat":1,"lon":2}]}]}')
    assert [r.osm_id for r in readers.osm_ways(spark, str(tmp_path / "o.json")).collect()] == [1]
    words = spark.createDataFrame([(1, 10.0, 5.0, "7001"), (1, 60.0, 5.0, "Nathan"), (1, 80.0, 5.0, "Road"), (1, 10.0, 9.0, "7002"), (1, 60.0, 9.5, "Main")], "page int, x0 double, top double, text string")
    assert [(r.id, r.name) for r in readers.word_bands(words, {"id": (0, 50), "name": (50, 200)}, "id").orderBy("record_top").collect()] == [("7001", "Nathan Road"), ("7002", "Main")]
    lines = spark.createDataFrame([(0, "x"), (1, "Table 5 VKT"), (2, "Kowloon 1 234 5"), (3, "  7 890 12"), (4, "Total")], "line_no int, text string")
    assert [(r.label, r.first_value, r.second_value) for r in readers.layout_table(lines, "Table 5", ["Kowloon"]).orderBy("line_no").collect()][1] == ("Kowloon", 7890, 12)


def test_csv_flexible_decodes_each_file_as_a_whole(spark, tmp_path):
    # The first sign of another encoding stands after 64 KB, and each file has its own; [1] in a name is no pattern.
    plain = "".join(f"{i},plain\n" for i in range(9000))
    texts = {"a.csv": ("utf-8", "香港"), "b[1].csv": ("big5", "九龍"), "c.csv": ("latin-1", "Café ÿ"), "d e.csv": ("utf-8", "x")}
    for k, (name, (encoding, last)) in enumerate(texts.items()):
        (tmp_path / name).write_bytes(("k,v\n" + plain + f"{100_000 + k},{last}\n").encode(encoding))
    got = readers.csv_flexible(spark, str(tmp_path), "k int, v string")
    assert got.count() == 4 * 9001 and got.where("v = 'plain'").count() == 4 * 9000
    assert {r.k: r.v for r in got.where("k >= 100000").collect()} == {100_000 + k: last for k, (_, last) in enumerate(texts.values())}
    alone = readers.csv_flexible(spark, str(tmp_path / "c.csv"), "k int, v string").where("k >= 100000").collect()
    assert [r.v for r in alone] == ["Café ÿ"]


def test_stream_equals_batch(spark, tmp_path):
    from fathomline.streaming.detectors import hourly, start

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("detector_id"), F.col("value").alias("volume"))
    e.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "e"))
    q = start(spark.readStream.schema(e.schema).parquet(str(tmp_path / "e")), "hourly_out")
    q.awaitTermination()
    closed = spark.table("hourly_out")
    last = closed.agg(F.max("hour")).first()[0]
    batch = hourly(e, streaming=False).where(F.col("hour") <= F.lit(last))
    key = lambda df: sorted((r.hour, r.detector_id, r.n, round(r.mean_value, 6)) for r in df.collect())
    assert key(closed) == key(batch)


def test_lines(spark):
    from fathomline.operators import lines

    point = lambda x, y: {"x": float(x), "y": float(y)}
    ring = "array<struct<x:double,y:double>>"
    df = spark.createDataFrame(
        [(1, [point(0, 0), point(4, 0), point(4, 2)], [point(0, 1), point(2, 1)], [point(0, 0), point(2, 0), point(2, 2), point(0, 2)], [point(1, 1), point(1, 3), point(3, 3), point(3, 1)])],
        f"k int, p {ring}, q {ring}, a {ring}, b {ring}",
    )
    r = lines.with_point_along(df, "p", 0.5).select("along", lines.overlap_share(F.col("p"), F.col("q"), 1.0).alias("share"), overlay.ring_overlap(F.col("a"), F.col("b")).alias("area")).first()
    assert (r.along.x, r.along.y) == (3.0, 0.0) and r.share == pytest.approx(2 / 6, abs=0.05) and r.area == pytest.approx(1.0)
    pairs = spark.createDataFrame([(1, 10, 5.0, 0.6, 0.1), (1, 11, 5.0, 0.6, 0.1), (1, 12, 50.0, 0.1, 0.0)], "k int, c int, distance double, overlap double, name_similarity double")
    scored = pairs.withColumn("score", lines.match_score(F.col("overlap"), F.col("name_similarity"), F.col("distance")))
    best = lines.best_match(scored, "k", "c").withColumn("status", lines.match_status(F.col("distance"), F.col("overlap"), F.col("name_similarity"))).first()
    assert (best.c, best.status) == (10, "high")


def test_a_giant_component_and_a_hub(spark):
    """Nearly all rows carry one label and nearly all edges one node; labels of large components are sent, not gathered."""
    from fathomline.operators.graph import components

    hub = [(0, i) for i in range(1, 1500)]
    chain = [(2000 + i, 2001 + i) for i in range(40)] + [(2020, 700)]
    small = [(5000 + 3 * i, 5001 + 3 * i) for i in range(200)]
    got = {r.node: r.component for r in components(spark.createDataFrame([*hub, *chain, *small, (9, 9), (None, 4)], "src long, dst long")).collect()}
    assert {n for n, c in got.items() if c == 0} == {*range(1500), *range(2000, 2041)}
    assert all(got[a] == got[b] == a for a, b in small) and len(got) == 1500 + 41 + 400


def test_components_of_large_graphs_are_not_broadcast(spark, monkeypatch):
    """Tables of nodes compress well below Spark's limit for a broadcast, which is built on the driver (n13_components_whole)."""
    from fathomline.operators import graph

    hints = []
    hint = type(spark.range(1)).hint
    monkeypatch.setattr(type(spark.range(1)), "hint", lambda self, name, *args: hints.append(name) or hint(self, name, *args))
    monkeypatch.setattr(graph, "BROADCAST_NODES", 10)
    # A chain, a star whose label is carried by most nodes, and a pair.
    ends = [(i, i + 1) for i in range(100, 110)] + [(1, i) for i in range(200, 400)] + [(7, 8)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(ends, "src long, dst long")).collect()}
    assert got == {**{i: 100 for i in range(100, 111)}, **{i: 1 for i in (1, *range(200, 400))}, 7: 7, 8: 7}
    assert hints.count("merge") >= 4
