"""Line and polygon joins against sampling and plain loops, and their edge cases."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from fathomline.operators import lines, spatial, stats
from fathomline.operators.digests import slot_digests

LINE = "array<struct<x:double,y:double>>"


def point_to(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def walk(line, n):
    for a, b in zip(line, line[1:]):
        for i in range(n):
            t = (i + 0.5) / n
            yield math.dist(a, b) / n, (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))


def near(p, line):
    return min(point_to(p, a, b) for a, b in zip(line, line[1:]))


def test_overlap_and_distance_against_sampling(spark):
    rng = random.Random(3)
    draw = lambda: [(rng.uniform(0, 40), rng.uniform(0, 40)) for _ in range(rng.randint(2, 5))]
    pairs = [(i, draw(), draw()) for i in range(40)]
    # A point twice, a line on itself, parallels at the very reach, a crossing.
    pairs += [(90, [(0, 0), (0, 0), (9, 0)], [(0, 1), (9, 1)]), (91, [(0, 0), (9, 9)], [(0, 0), (9, 9)]), (92, [(0, 0), (9, 0)], [(0, 5), (9, 5)]), (93, [(0, 0), (9, 9)], [(0, 9), (9, 0)])]
    pairs = [(k, [tuple(map(float, v)) for v in p], [tuple(map(float, v)) for v in q]) for k, p, q in pairs]
    df = spark.createDataFrame(pairs, f"k int, p {LINE}, q {LINE}")
    got = {r.k: r for r in df.select("k", lines.overlap_share(F.col("p"), F.col("q"), 5.0).alias("share"), lines.line_distance(F.col("p"), F.col("q")).alias("distance")).collect()}
    for k, p, q in pairs:
        steps = list(walk(p, 4000))
        share = sum(w for w, v in steps if near(v, q) <= 5.0) / max(1.0, sum(w for w, _ in steps))
        assert got[k].share == pytest.approx(share, abs=2e-3), k
        assert got[k].distance == pytest.approx(min(near(v, q) for _, v in steps), abs=0.05), k
    assert got[92].share == 1.0 and got[93].distance == 0.0


def test_lines_without_segments(spark):
    df = spark.createDataFrame([(1, None, [(0.0, 0.0), (1.0, 0.0)]), (2, [], [(0.0, 0.0), (1.0, 0.0)]), (3, [(0.0, 0.0)], [(0.0, 0.0), (1.0, 0.0)]), (4, [(0.0, 0.0), (1.0, 0.0)], None)], f"k int, p {LINE}, q {LINE}")
    assert [r[0] for r in df.select(lines.overlap_share(F.col("p"), F.col("q"), 1.0)).collect()] == [0.0] * 4
    left, right = df.select("k", "p"), df.select(F.col("k").alias("j"), "q")
    assert {(r.k, r.j) for r in lines.line_join(left, right, "p", "q", 1.0).collect()} == {(4, 1), (4, 2), (4, 3)}
    assert lines.line_join(left.limit(0), right, "p", "q", 1.0).count() == 0


def test_line_join_is_all_pairs_once(spark):
    rng = random.Random(5)
    rows = [(i, [(x := rng.uniform(-200, 200), y := rng.uniform(-200, 200)), (x + rng.uniform(-90, 90), y + rng.uniform(-90, 90))]) for i in range(60)]
    df = spark.createDataFrame(rows, f"k int, p {LINE}")
    every = df.crossJoin(df.select(F.col("k").alias("j"), F.col("p").alias("q"))).where(lines.line_distance(F.col("p"), F.col("q")) <= 12.0)
    want = sorted((r.k, r.j) for r in every.collect())
    for cell in (None, 7.0, 1000.0):
        met = lines.line_join(df, df.select(F.col("k").alias("j"), F.col("p").alias("q")), "p", "q", 12.0, cell)
        assert sorted((r.k, r.j) for r in met.collect()) == want and len(want) > 60


def test_polygon_join(spark):
    box = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    # b overlaps a; c is an arrow that is not convex; d has no area.
    units = [("b", box(5.0, 5.0, 10.0)), ("a", box(0.0, 0.0, 10.0)), ("c", [(100.0, 0.0), (120.0, 0.0), (110.0, 5.0), (110.0, 30.0)]), ("d", [(500.0, 500.0), (501.0, 500.0)]), ("e", None)]
    ask = {1: (7.0, 7.0), 2: (12.0, 12.0), 3: (-3.0, 4.0), 4: (50.0, 50.0), 5: (115.0, 6.0), 6: (10.0, 0.0), 7: (None, 1.0), 8: (500.5, 500.0), 9: (-3.0, -4.0)}
    points = spark.createDataFrame([(k, *v) for k, v in ask.items()], "k int, x double, y double")
    polygons = spark.createDataFrame(units, f"unit string, ring {LINE}")
    for cell in (3.0, 40.0):
        got = {r.k: (r.unit, r.method, r.distance) for r in spatial.polygon_join(points, polygons, "k", "unit", "ring", 5.0, cell).collect()}
        assert got[1] == ("a", "within", 0.0) and got[2] == ("b", "within", 0.0) and got[3] == ("a", "nearest", 3.0) and got[6] == ("a", "within", 0.0)
        assert got[9] == ("a", "nearest", 5.0) and got[5] == ("c", "nearest", pytest.approx(35 / math.sqrt(125)))
        assert got[4] == got[7] == got[8] == (None, "outside", None) and len(got) == len(ask)
    assert {r.method for r in spatial.polygon_join(points, polygons.limit(0), "k", "unit", "ring", 5.0, 9.0).collect()} == {"outside"}


def test_cluster_bootstrap_draws_as_many_clusters(spark):
    # A constant value gives a constant statistic only if every draw's weights are consistent; one cluster is drawn always.
    same = spark.createDataFrame([(i % 7, 3.0) for i in range(30)] + [(None, 3.0), (8, None)], "c int, v double")
    assert tuple(stats.cluster_bootstrap(same, "c", F.col("v"), 50).first()) == (3.0, 3.0, 3.0)
    one = spark.createDataFrame([(1, 2.0), (1, 4.0)], "c int, v double")
    assert tuple(stats.cluster_bootstrap(one, "c", F.col("v"), 20, statistic="means").first()) == (3.0, 3.0, 3.0)
    assert tuple(stats.cluster_bootstrap(one.limit(0), "c", F.col("v"), 20).first()) == (None, None, None)


def test_slots_are_named_by_digests_and_stay_in_their_task(spark):
    """Digests against hashlib at every change of length, sums against a plain loop, in one block of clusters and in several."""
    for prefix, low, high in (("42:1:", 0, 120), ("42:1000:", 9990, 10011), ("x:", 2**32 - 3, 2**32 + 3)):
        assert slot_digests(prefix, low, high).tolist() == [int(hashlib.md5(f"{prefix}{i}".encode()).hexdigest()[:8], 16) for i in range(low, high + 1)]
    sums = spark.createDataFrame([(i, float(i * i), float(i % 3)) for i in range(1, 24)], "_place long, s double, n double")
    named = [[(int(hashlib.md5(f"7:{d}:{p}".encode()).hexdigest()[:8], 16) * 23 >> 32) + 1 for p in range(1, 24)] for d in range(1, 6)]
    want = {d: (sum(float(i * i) for i in at), sum(float(i % 3) for i in at)) for d, at in enumerate(named, 1)}
    for block in (100, 10):
        got = stats._drawn_sums(sums, 23, 5, 7, block).groupBy("draw").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        assert {r.draw: (r.s, r.n) for r in got.collect()} == want
    # Before, every slot of every draw was shuffled to its cluster: no join is left below the aggregation by draws.
    assert "Join" not in stats._drawn_sums(sums, 23, 5, 7)._jdf.queryExecution().optimizedPlan().toString()


def test_lines_of_one_segment_and_far_lines(spark):
    """One segment by plain columns equals the general way; where lines are apart, their overlap is 0 without being computed."""
    random.seed(9)
    line = lambda: [(random.uniform(0, 40), random.uniform(0, 40)) for _ in range(2)]
    df = spark.createDataFrame([(i, line(), line()) for i in range(300)] + [(300, [(0.0, 0.0), (12.0, 0.0)], [(0.0, 12.0), (12.0, 12.0)]), (301, [(1.0, 1.0)] * 2, [(1.0, 1.0), (4.0, 5.0)])], f"i int, a {LINE}, b {LINE}")
    a, b = F.col("a"), F.col("b")
    got = df.select(lines.line_distance(a, b).alias("d"), lines._least_distance(a, b).alias("e"), lines.overlap_share(a, b, 12.0).alias("s"))
    near = df.withColumn("d", lines.line_distance(a, b)).select(lines.overlap_share_near(a, b, F.col("d"), 12.0).alias("t")).collect()
    for r, n in zip(got.collect(), near):
        assert r.d == r.e and n.t == pytest.approx(r.s, abs=1e-9)
    # Before, every pair of a cell four times the reach wide got its distance.
    joined = lines.line_join(df.select("i", "a"), df.select(F.col("i").alias("j"), "b"), "a", "b", 3.0)
    want = df.select("i", "a").crossJoin(df.select(F.col("i").alias("j"), "b")).withColumn("d", lines._least_distance(a, b)).where("d <= 3")
    assert {(r.i, r.j) for r in joined.collect()} == {(r.i, r.j) for r in want.collect()}
    assert "_llowx" in joined._jdf.queryExecution().analyzed().toString() and joined.columns == ["i", "a", "j", "b", "distance"]


def test_ring_overlaps_of_batches(spark):
    """The same areas as by built-in functions, which took a fold over all pairs of edges for each row (j21_convex_overlap)."""
    from fathomline.operators import overlay

    random.seed(6)
    ring = lambda n: [(random.randrange(9) + random.choice([0.0, 0.25]), float(random.randrange(9))) for _ in range(n)]
    star = lambda n, x, y: [(x + (3 + 5 * (i % 2)) * math.cos(6.28 * i / n), y + (3 + 5 * (i % 2)) * math.sin(6.28 * i / n)) for i in range(n)][:: random.choice([1, -1])]
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    rows = [(star(random.choice([6, 10]), random.random() * 9, 0.0), star(8, 0.0, 1e6 * (i == 3) + random.random())) for i in range(40)] + [(ring(3), ring(3)) for _ in range(30)]
    rows += [(None, square), (square, []), (square, square[:2]), (square, square), (square, [(1.0, None), *square]), (square, [(2.0, 1.0), (9.0, 1.0), (9.0, 2.0)])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "id long, a array<struct<x double, y double>>, b array<struct<x double, y double>>").repartition(2)
    got = overlay.with_ring_overlap(df, "a", "b", "area").withColumn("want", overlay.ring_overlap(F.col("a"), F.col("b"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.area is r.want is None if r.want is None else r.area == pytest.approx(r.want, abs=1e-9), r.id
    assert sum(bool(r.area) for r in got) > 40
