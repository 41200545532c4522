"""Overlay, great-circle neighbours, masked neighbours and coverage against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.operators import coverage, overlay, spatial, sphere

POLYGON = "unit long, rings array<array<struct<x:double,y:double>>>"


def inside(px, py, rings):
    """Even-odd over all rings, for arrays of points."""
    odd = np.zeros(px.shape, dtype=bool)
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            cross = (ay > py) != (by > py)
            with np.errstate(divide="ignore", invalid="ignore"):
                odd ^= cross & (px < (bx - ax) * (py - ay) / (by - ay) + ax)
    return odd


def star(cx, cy, r, n, turn=0.0, hole=False, backwards=False):
    ring = [(cx + r * (1 if i % 2 else 0.4) * math.cos(turn + i * math.pi / n), cy + r * (1 if i % 2 else 0.4) * math.sin(turn + i * math.pi / n)) for i in range(2 * n)]
    rings = [ring[::-1] if backwards else ring]
    if hole:
        rings.append([(cx + dx * r * 0.2, cy + dy * r * 0.2) for dx, dy in ((-1, -1), (1, -1), (1, 1), (-1, 1))])
    return rings


@pytest.fixture(scope="module")
def shapes():
    rng = random.Random(2)
    out = {i: star(rng.uniform(0, 60), rng.uniform(1e3, 1e3 + 60), rng.uniform(8, 20), rng.choice([3, 4, 5]), rng.random(), rng.random() < 0.5, rng.random() < 0.5) for i in range(24)}
    out[50] = [[(0.0, 1000.0), (40.0, 1000.0), (40.0, 1040.0), (20.0, 1010.0), (0.0, 1040.0)]]  # concave with vertical sides
    out[51] = [[(0.0, 1000.0), (0.0, 1040.0), (40.0, 1040.0), (40.0, 1000.0)], [(10.0, 1010.0), (30.0, 1010.0), (30.0, 1030.0), (10.0, 1030.0)]]
    out[52] = [[(12.0, 1012.0), (28.0, 1012.0), (28.0, 1028.0), (12.0, 1028.0)]]  # in the hole of 51
    return out


def test_overlay_against_a_fine_grid(spark, shapes):
    df = spark.createDataFrame(list(shapes.items()), POLYGON).repartition(3)
    got = {(r.unit, r.other): r for r in overlay.overlay(df, df.withColumnRenamed("unit", "other"), "unit", "other", "rings", "rings", 30.0).collect()}
    step = 0.1
    gx, gy = np.meshgrid(np.arange(-25, 85, step) + step / 2, np.arange(975, 1085, step) + step / 2)
    masks = {k: inside(gx, gy, rings) for k, rings in shapes.items()}
    for a in shapes:
        assert got[a, a].iou == pytest.approx(1) and got[a, a].area_a == pytest.approx(masks[a].sum() * step**2, rel=0.02)
        for b in shapes:
            want = (masks[a] & masks[b]).sum() * step**2
            found = got.get((a, b))
            assert (found.intersection if found else 0.0) == pytest.approx(want, abs=max(1.5, 0.03 * want)), (a, b)
            if found:
                assert found.intersection == pytest.approx(got[b, a].intersection) and found.share_of_target == pytest.approx(found.intersection / found.area_b)
                assert found.iou == pytest.approx(found.intersection / (found.area_a + found.area_b - found.intersection))
    assert (51, 52) not in got and got[50, 51].intersection == pytest.approx(40 * 40 - 600 - (masks[50] & ~masks[51]).sum() * step**2, abs=2)


def test_overlay_is_exact_and_adds_parts(spark):
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    a = [(1, [square(0.0, 0.0, 4.0)]), (1, [square(10.0, 0.0, 4.0)]), (2, None), (3, [[(0.0, 0.0), (1.0, 1.0)]]), (4, [])]
    b = [(7, [square(2.0, 2.0, 10.0), square(3.0, 3.0, 0.5)[::-1]]), (8, [square(4.0, 0.0, 6.0)])]
    left, right = spark.createDataFrame(a, POLYGON), spark.createDataFrame(b, POLYGON.replace("unit", "other"))
    rows = overlay.overlay(left, right, "unit", "other", "rings", "rings", 5.0).collect()
    # Two corners of 2 x 2 less the hole; unit 8 shares only borders.
    assert [(r.unit, r.other, round(r.intersection, 9), r.area_a, r.area_b) for r in rows] == [(1, 7, 2 * 2 + 2 * 2 - 0.25, 32.0, 99.75)]
    assert overlay.overlay(left.limit(0), right, "unit", "other", "rings", "rings", 5.0).count() == 0


def test_crosswalk_ranks_and_labels(spark):
    rows = [(1, 1, 96.0, 0.96, 0.97), (1, 2, 4.0, 0.04, 0.9), (2, 2, 50.0, 0.92, 0.91), (3, 4, 9.0, 1.0, 1.0), (4, 4, 0.0001, 0.0005, 0.0004)]
    shared = spark.createDataFrame(rows, "a int, b int, intersection double, share_of_source double, share_of_target double")
    got = {(r.a, r.b): (r.overlap_rank, r.match_status) for r in overlay.crosswalk(shared, "a", "b").collect()}
    assert got == {(1, 1): (1, "stable_same_code"), (1, 2): (2, None), (2, 2): (1, "near_stable_same_code"), (3, 4): (1, "changed_split_or_reassigned")}


def test_faults(spark, shapes):
    bow = [[(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 3.0)]]
    spike = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 5.0)]]
    poked = [[(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0)], [(5.0, 5.0), (12.0, 5.0), (12.0, 6.0), (5.0, 6.0)]]
    rows = [*shapes.items(), (100, bow), (101, spike), (102, poked), (103, [[(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)]]), (104, None), (105, [])]
    got = {r.unit: r for r in overlay.faults(spark.createDataFrame(rows, POLYGON), "unit", "rings", 3.0).collect()}
    assert len(got) == len(rows) and all(got[k].valid for k in shapes)
    assert [got[k].valid for k in range(100, 106)] == [False] * 6
    assert got[100].crossings == 1 and got[101].crossings >= 1 and got[102].crossings == 2 and got[103].rings_without_area == 1


def km(a, b):
    (lon1, lat1), (lon2, lat2) = (tuple(map(math.radians, p)) for p in (a, b))
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
    return 2 * 6371 * math.asin(min(1, math.sqrt(h)))


@pytest.fixture(scope="module")
def globe(spark):
    rng = random.Random(8)
    places = [(rng.uniform(-180, 180), math.degrees(math.asin(rng.uniform(-1, 1)))) for _ in range(120)]
    places += [(rng.choice([179.9, -179.95, 180.0, -180.0, 539.9]), rng.uniform(-60, 60)) for _ in range(30)]
    places += [(rng.uniform(-180, 180), rng.choice([89.0, 89.9, 90.0, -89.5, -90.0])) for _ in range(30)]
    return places


@pytest.mark.parametrize("radius", [50.0, 900.0, 4000.0, 9900.0, 10100.0, 20100.0])
def test_radius_on_the_sphere(spark, globe, radius):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(globe)], "id long, lon double, lat double")
    right = df.select(F.col("id").alias("other"), F.col("lon").alias("rlon"), F.col("lat").alias("rlat"))
    got = [(r.id, r.other) for r in sphere.sphere_radius_join(df, right, radius).collect()]
    want = {(i, j) for i, a in enumerate(globe) for j, b in enumerate(globe) if km(a, b) <= radius}
    assert len(got) == len(set(got)) and set(got) == want


def test_nearest_on_the_sphere(spark, globe):
    left = spark.createDataFrame([(i, *p) for i, p in enumerate(globe)] + [(900, None, 1.0), (901, float("nan"), 1.0)], "id long, lon double, lat double")
    right = spark.createDataFrame([(i, *p) for i, p in enumerate(globe) if i % 3 == 0] + [(902, 1.0, None)], "other long, rlon double, rlat double")
    got = {}
    for r in sphere.sphere_nearest_join(left, right, "id", "other", 2, 100.0).collect():
        got[r.id, r.place] = (r.other, r.distance)
    assert len(got) == 2 * len(globe)
    for i, a in enumerate(globe):
        want = sorted((km(a, b), j) for j, b in enumerate(globe) if j % 3 == 0)[:2]
        for place, (distance, other) in enumerate(want, 1):
            assert got[i, place][1] == pytest.approx(distance, abs=1e-6)


def test_masked_neighbours(spark):
    rng = random.Random(4)
    targets = [(i, rng.uniform(0, 50), rng.uniform(0, 50), i % 3 + 1) for i in range(60)]
    sensors = [(i, rng.uniform(-20, 90), rng.uniform(-20, 90), rng.choice([1, 2, 3, None])) for i in range(90)]
    t = spark.createDataFrame(targets + [(99, None, 1.0, 1)], "id long, x double, y double, fold int")
    s = spark.createDataFrame(sensors, "sensor long, rx double, ry double, fold int")
    got = {(r.id, r.held): (r.sensor, r.distance) for r in spatial.nearest_masked(t, s, "id", "sensor", "fold", [1, 2, 3, 4], 6.0, 1.0).collect()}
    away = lambda a, b: math.dist(a[1:3], b[1:3])
    kept = {f: [d for d in sensors if d[3] != f and all(away(d, p) > 6 for p in targets if p[3] == f)] for f in (1, 2, 3, 4)}
    assert len(got) == 60 * 4
    for p in targets:
        for f in kept:
            want = min(kept[f], key=lambda d: (away(p, d), d[0]))
            assert got[p[0], f][0] == want[0] and got[p[0], f][1] == pytest.approx(away(p, want))
    summary = {r.held: (r.source_count, r.retained_count, r.masked_count) for r in spatial.mask_summary(s, t, "sensor", "fold", [1, 2, 3, 4], 6.0).collect()}
    assert summary == {f: (90, len(kept[f]), 90 - len(kept[f])) for f in kept}
    none = spatial.nearest_masked(t, s.where("fold = 1"), "id", "sensor", "fold", [1], 6.0, 1.0)
    assert none.count() == 0


def test_coverage_against_samples(spark):
    rng = random.Random(6)
    lines = [(i, [(rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(rng.choice([2, 3, 5]))]) for i in range(25)]
    lines += [(50, [(10.0, 0.0), (10.0, 90.0)]), (51, [(0.0, 5.0), (200.0, 5.0)]), (52, [(3.0, 3.0)]), (53, None), (54, [(3.0, 3.0), (3.0, 3.0)])]
    centres = [(rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(60)] + [(50 + i / 50, 5.0) for i in range(200)] + [(None, 3.0), (float("inf"), 1.0)]
    df = spark.createDataFrame(lines, "id long, points array<struct<x:double,y:double>>")
    at = spark.createDataFrame(centres, "x double, y double")
    got = {r.id: r for r in coverage.line_coverage(df, "id", "points", at, 4.0).collect()}
    assert set(got) == {i for i, p in lines if p and len(p) > 1} and got[54].share is None and got[54].length == 0
    real = np.array([c for c in centres if c[0] is not None and math.isfinite(c[0])])
    for i, points in lines:
        if i in got and got[i].length:
            near = total = 0.0
            for (ax, ay), (bx, by) in zip(points, points[1:]):
                t = (np.arange(4000) + 0.5) / 4000
                xs, ys, l = ax + t * (bx - ax), ay + t * (by - ay), math.dist((ax, ay), (bx, by))
                near += l * ((np.hypot(xs[:, None] - real[:, 0], ys[:, None] - real[:, 1]) <= 4).any(axis=1)).mean()
                total += l
            assert got[i].length == pytest.approx(total) and got[i].covered == pytest.approx(near, abs=0.2)


def test_a_long_line_meets_cells_in_proportion_to_its_length(spark):
    df = spark.createDataFrame([(1, [(0.0, 0.0), (1000.0, 1000.0)])], "id long, points array<struct<x:double,y:double>>")
    assert coverage.segment_cells(coverage.segment_rows(df, "id", "points"), 10.0, 1.0).count() < 500


def test_merged_ranges(spark):
    rng = random.Random(1)
    rows = [(k, lo, lo + rng.uniform(0, 5)) for k in range(5) for lo in (rng.uniform(0, 60) for _ in range(30))]
    got = coverage.merged_ranges(spark.createDataFrame(rows, "k int, lo double, hi double"), ["k"]).collect()
    for k in range(5):
        want = []
        for _, lo, hi in sorted(r for r in rows if r[0] == k):
            if want and lo <= want[-1][1]:
                want[-1][1] = max(want[-1][1], hi)
            else:
                want.append([lo, hi])
        assert sorted([r.lo, r.hi] for r in got if r.k == k) == want


def test_support_tables(spark):
    net = spark.createDataFrame([("a", 10.0, 5.0), ("b", 20.0, 0.0), ("a", 0.0, 0.0)], "g string, length double, covered double")
    got = {r.road_domain: r for r in coverage.domain_support(net, {"all": F.lit(True), "a": F.col("g") == "a", "none": F.lit(False)}).collect()}
    assert (got["all"].network_count, got["all"].supported_count, got["all"].length_share) == (3, 1, pytest.approx(5 / 30))
    assert got["a"].count_share == 0.5 and got["none"].length_share is None and got["none"].network_length == 0
    near = spark.createDataFrame([("x", "r1", 1, 3.0), ("x", "r1", 2, 30.0), ("y", None, 1, None), ("y", "r1", 2, 1.0)], "device string, road string, fold int, distance double")
    rows = {r.road_group: r for r in coverage.match_table(near, "road", "device", "fold", 10.0).collect()}
    assert (rows["r1"].records, rows["r1"].accepted, rows["r1"].accepted_devices, rows["r1"].folds, rows["r1"].median_distance) == (3, 2, 2, 2, 2.0) and rows["unmatched"].accepted == 0
    table = {r.domain: r for r in coverage.overlap_table(near, {"all": F.lit(True), "first": F.col("fold") == 1}, 10.0).collect()}
    assert (table["all"].stations, table["all"].with_detector, table["all"].share, table["all"].median_distance) == (4, 2, 0.5, 3.0) and table["first"].with_detector == 1
