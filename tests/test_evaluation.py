"""Golden rows and properties of the evaluation operators, name similarities and the national grid."""

import difflib

import pytest
from pyspark.sql import functions as F

from fathomline.functions import text
from fathomline.operators import evaluation, projection, spatial
from fathomline.plans import frames

SF = "/root/testdata/sf0.001"


def test_names_by_hand(spark):
    rows = [("Café  Road & Junction", "CAFE RD and jct"), ("Nathan Road", "Nathan Rd"), ("Tai Po Road near Sha Tin", "TAI PO ROAD"), ("", "x"), ("Road", "Street"), ("King's Road", "KINGS ROAD"), (None, "a")]
    df = spark.createDataFrame(rows, "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = df.select(text.normalize(a).alias("n"), text.text_similarity(a, b).alias("t"), text.name_similarity(a, b).alias("m"), text.core_name_similarity(a, b, {"RD": "ROAD"}).alias("c"), text.substring_or_ratio(a, b).alias("s")).collect()
    assert [r.n for r in got] == ["cafe rd and jct", "nathan rd", "tai po rd near sha tin", "", "rd", "king s rd", ""]
    assert got[0].t == got[1].t == 1.0
    ratio = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()
    assert got[2].t == pytest.approx(0.65 * ratio("tai po rd near sha tin", "tai po rd") + 0.35 * 3 / 6) and got[2].m == 1.0
    # "RD" is no generic word for the plain form, but is after replacement; NATHAN stands inside NATHAN RD.
    assert got[1].m == 1.0 and got[1].c == 1.0 and got[1].s == 1.0
    assert [got[3].t, got[3].m, got[3].s, got[4].m, got[6].m, got[6].s] == [0.0] * 6
    assert got[5].m == pytest.approx(max(0.0, 0.5 * ratio("KING S", "KINGS"))) and got[4].s == pytest.approx(ratio("ROAD", "STREET"))


def test_grid_origin_and_round_trip(spark):
    # The datum shift moves the origin of the grid by about +8.8 and -5.5 arc seconds.
    df = spark.createDataFrame([(projection.LONGITUDE_0 + 8.8 / 3600, projection.LATITUDE_0 - 5.5 / 3600), (113.85, 22.15), (114.4, 22.55)], "lon double, lat double")
    there = projection.to_grid(df, "lon", "lat").cache()
    r = there.first()
    assert abs(r.easting - projection.EASTING_0) < 10 and abs(r.northing - projection.NORTHING_0) < 10
    back = projection.from_grid(there, "easting", "northing").collect()
    assert all(abs(r.lon - r.longitude) < 1e-8 and abs(r.lat - r.latitude) < 1e-8 for r in back)


def test_out_of_fold_reads_the_orders_once(spark):
    plan = frames.training(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("orders.parquet") == 1
    assert "orders.parquet" not in frames.out_of_fold(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_nearest_join_at_the_edges(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (3, float("nan"), 0.0), (4, 5e6, 0.0)], "a int, x double, y double")
    right = spark.createDataFrame([(7, 1.0, 0.0), (8, 0.0, 2.0), (9, None, None)], "b int, rx double, ry double")
    got = sorted((r.a, r.b, r.place) for r in spatial.nearest_join(left, right, "a", "b", 2, 0.5).collect())
    assert got == [(1, 7, 1), (1, 8, 2), (4, 7, 1), (4, 8, 2)]
    assert spark.range(1).select(spatial.endpoint_key(F.lit(1234567.5), F.lit(2.0))).first()[0] == "1234567.500000,2.000000"


def test_unit_bootstrap_and_tiles(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(40)] + [("b", 100.0 + i) for i in range(60)], "g string, v double")
    got = {r.what: r for r in evaluation.unit_bootstrap(df, "v", "g", "a", "b", draws=400).collect()}
    assert got["lowest"].estimate == 19.5 and got["difference"].estimate == 19.5 - 129.5
    assert got["lowest"].low < 19.5 < got["lowest"].high and 5 < got["lowest"].high - got["lowest"].low < 9 and got["difference"].low < -110 < got["difference"].high
    boxes = evaluation.tiles(0, 0, 4, 4, 4, 0)
    assert len(boxes) == 16 and boxes[5] == (1, 1, 2, 2) and evaluation.split_tile((0, 0, 2, 2))[3] == (1, 1, 2, 2)
    with pytest.raises(ValueError):
        evaluation.by_place(df, df.limit(3), [F.col("v")], [F.col("v")])
