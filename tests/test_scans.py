"""Scans of KMZ archives, id columns and vehicle-class samples."""

import zipfile

import pytest
from pyspark.sql import functions as F

from fathomline.operators import detectors
from fathomline.sources import readers

KML = """<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><Folder>
<Placemark><description><![CDATA[<table><tr><td>STATION</td><td>1001</td></tr></table>]]></description><Point><coordinates>114.1,22.3,0</coordinates></Point></Placemark>
<Placemark><MultiGeometry><LineString><coordinates>1,2 3,4 5,6</coordinates></LineString><LineString><coordinates>7,8</coordinates></LineString></MultiGeometry></Placemark>
<Placemark/></Folder></Document></kml>"""


def archive(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, content in members.items():
            z.writestr(name, content)


def test_placemarks(spark, tmp_path):
    archive(tmp_path / "a.kmz", {"notes.txt": "x", "doc.KML": KML, "other.kml": "<kml/>"})
    archive(tmp_path / "b.kmz", {"doc.kml": "<kml/>"})
    archive(tmp_path / "c.kmz", {"doc.kml": "<kml>" + "<Placemark><Point><coordinates>1,2</coordinates></Point></Placemark>" * 2500 + "</kml>"})
    found = readers.placemarks(spark, str(tmp_path / "*.kmz")).cache()
    rows = {r.place: r for r in found.where("file LIKE '%a.kmz'").collect()}
    assert len(rows) == 3 and rows[0].fields == {"STATION": "1001"} and [tuple(p) for p in rows[0].points] == [(114.1, 22.3)] and rows[0].lines == []
    assert [[tuple(p) for p in line] for line in rows[1].lines] == [[(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)]] and rows[1].fields == {}
    assert (rows[2].points, rows[2].lines) == ([], []) and found.where("file LIKE '%b.kmz'").count() == 0
    assert found.where("file LIKE '%c.kmz' AND points[0].x = 1").agg(F.count_distinct("place")).first()[0] == 2500
    archive(tmp_path / "d.zip", {"x.txt": "y"})
    with pytest.raises(Exception, match="no KML member"):
        readers.placemarks(spark, str(tmp_path / "d.zip")).collect()


def test_column_ids(spark):
    words = [(290.0, 100.0, 800.0, "1001"), (311.9, 120.0, 800.0, "20025"), (312.0, 100.0, 800.0, "3003"), (290.0, 745.0, 800.0, "4004"), (290.0, 10.0, 800.0, "123"), (290.0, 10.0, 800.0, "12a4"), (290.0, 10.0, 800.0, None)]
    df = spark.createDataFrame(words, "x0 double, top double, page_height double, text string")
    assert sorted(r[0] for r in readers.column_ids(df, 285.0, 312.0).collect()) == [1001, 20025]
    assert readers.column_ids(df.limit(0), 285.0, 312.0).count() == 0
    with pytest.raises(Exception, match="stands twice: 1001"):
        readers.column_ids(df.unionByName(df), 285.0, 312.0).collect()


def test_vehicle_classes(spark):
    kind = "s string, period array<struct<period_from:string,period_to:string,detectors:array<struct<detector_id:string,valid:string,vehicle_class:array<struct<class_name:string,proportion:string>>>>>>"
    whole = lambda *d: ("00:00:00", "24:00:00", list(d))
    rows = [
        ("one", [("00:00:00", "01:00:00", [("A", "Y", [("Private Car", "99")])]), whole((" A ", "Y", [("Private Car", "40"), ("D.D. Bus", "10")]), ("B", "N", [("Private Car", "1")]))]),
        ("two", [whole(("A", "Y", [("private car", "60"), ("D.D. Bus", "-")]), ("C", "Y", None)), whole(("A", "Y", [("Private Car", "0")]))]),
        ("three", [("00:00:00", "24:00:00", None)]),
    ]
    df = spark.createDataFrame(rows, kind)
    got = {r.sensor_id: tuple(r)[1:] for r in detectors.vehicle_classes(df, "s", ["private_car", "dd_bus"]).collect()}
    assert got == {"A": (50.0, 10.0, 2, pytest.approx(2 / 3)), "C": (None, None, 1, pytest.approx(1 / 3))}
    with pytest.raises(Exception, match="no full-day period: four"):
        detectors.vehicle_classes(df.unionByName(spark.createDataFrame([("four", [])], kind)), "s", ["dd_bus"]).collect()


def test_layout_table_by_document(spark):
    lines = [("a", 1, "Table 2"), ("a", 2, "Urban 1 200 30"), ("a", 3, "7 8"), ("b", 1, "Urban 5 6"), ("b", 2, "x"), ("b", 5, "Table 2"), ("b", 6, "9 10"), ("b", 7, "Rural 11 12"), ("c", 1, "Urban 1 2")]
    df = spark.createDataFrame(lines, "d string, line_no int, text string")
    got = [tuple(r) for r in readers.layout_table(df, "^Table 2", ["Urban", "Rural"], document="d").orderBy("d", "line_no").collect()]
    assert got == [("a", 2, "Urban", 1200, 30), ("a", 3, "Urban", 7, 8), ("b", 6, None, 9, 10), ("b", 7, "Rural", 11, 12)]
    alone = readers.layout_table(df.where("d = 'a'").drop("d"), "^Table 2", ["Urban", "Rural"]).collect()
    assert [tuple(r) for r in alone] == [(2, "Urban", 1200, 30), (3, "Urban", 7, 8)]


def test_nearest_centre_is_bounded(spark):
    from fathomline.operators import spatial

    points = spark.createDataFrame([(1, 0.0, 0.0)], "k int, x double, y double")
    centres = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0)], "label int, cx double, cy double")
    assert spatial.nearest_centre(points, centres).first()["label"] == 1
    with pytest.raises(ValueError, match="nearest_join"):
        spatial.nearest_centre(points, centres, most=1)
