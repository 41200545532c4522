"""Neighbours where places are crowded: same results as plain loops, and no row for each pair."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fathomline.operators import blocks, spatial, sphere


def test_first_radius_follows_density(spark, monkeypatch):
    """One hot cell of the start radius; before, each row met all rows of it."""
    monkeypatch.setattr(blocks, "MEET", 64)
    random.seed(6)
    rows = [(i, random.uniform(0, 30), random.uniform(0, 30), i % 3) for i in range(600)] + [(600 + i, 3.0, 4.0, 1) for i in range(300)] + [(900, 500.0, 0.0, 2)]
    df = spark.createDataFrame(rows, "id long, x double, y double, s int")
    left, right = df.select("id", "x", "y"), df.select(F.col("id").alias("other"), F.col("x").alias("rx"), F.col("y").alias("ry"), "s")
    radii = []
    keep = spatial.best_within
    monkeypatch.setattr(spatial, "best_within", lambda a, b, *rest, **names: radii.append((rest[2], b.count())) or keep(a, b, *rest, **names))
    got = {(r.id, r.place): (r.other, r.distance) for r in spatial.nearest_others(left, right, "id", "other", 2, 40.0).collect()}
    assert radii[0][0] < 40.0 and radii[0][1] == 604
    for a in rows:
        want = sorted((math.sqrt((a[1] - b[1]) * (a[1] - b[1]) + (a[2] - b[2]) * (a[2] - b[2])), b[0]) for b in rows if a[0] != b[0])[:2]
        assert [got[a[0], place] for place in (1, 2)] == [(other, distance) for distance, other in want]


def test_nearest_beside_a_crowded_pole(spark, monkeypatch):
    """Places of a pole are one whatever their longitude; before, all pairs of them were ranked."""
    monkeypatch.setattr(blocks, "MEET", 64)
    random.seed(7)
    places = [(random.uniform(-900, 900), random.choice([90.0, -90.0, random.gauss(89.7, 0.1), random.uniform(-90, 90)])) for _ in range(500)] + [(179.95 + random.uniform(-0.1, 0.1), random.uniform(-80, 80)) for _ in range(80)]
    places = [(lon, max(-90.0, min(90.0, lat))) for lon, lat in places]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "id long, lon double, lat double")
    right = df.select(F.col("id").alias("other"), F.col("lon").alias("rlon"), F.col("lat").alias("rlat"))
    seen = []
    keep = sphere.best_of
    monkeypatch.setattr(sphere, "best_of", lambda *given: seen.append(given[2].count()) or keep(*given))
    rows = sphere.sphere_nearest_join(df, right, "id", "other", 3, 3000.0).collect()
    got = {(r.id, r.place): (r.other, r.distance) for r in rows}
    assert len(rows) == len(got) == 3 * len(places) and set(rows[0].asDict()) == {"id", "lon", "lat", "other", "rlon", "rlat", "distance", "place"}

    def km(a, b):
        (lon1, lat1), (lon2, lat2) = (tuple(map(math.radians, p)) for p in (a, b))
        return 2 * 6371 * math.asin(min(1, math.sqrt(math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2)))

    for i, a in enumerate(places):
        assert [got[i, place][1] for place in (1, 2, 3)] == pytest.approx(sorted(km(a, b) for b in places)[:3], abs=1e-6)
    assert seen[0] < len(places) - 100
