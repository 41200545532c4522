"""Feeds, schemas, sections, schedules and lineage on small fixtures."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fathomline.operators import lineage, transit
from fathomline.sources import feeds, readers

XML = """<?xml version="1.0" encoding="UTF-8"?><t:feed xmlns:t="urn:x"><date>2023-06-19</date><detectors>
<detector><detector_id>A1</detector_id><lanes><lane><Volume>12</Volume><valid>Y</valid></lane></lanes><t:time>2023-06-19T08:00:00Z</t:time></detector>
<detector><detector_id>A2</detector_id><lanes><lane><Volume></Volume><valid>N</valid></lane></lanes><t:time>bad</t:time></detector>
<detector><detector_id>A1</detector_id><lanes><lane><Volume>12</Volume><valid>Y</valid></lane></lanes><t:time>2023-06-19T08:00:00Z</t:time></detector>
</detectors></t:feed>"""
JSON = '{"data": [{"id": 7, "deep": {"er": {"flow": 3.5, "isValid": true}}, "dateTime": "2023-01-02T00:00:00Z"}, {"name": "no id"}, {"id": "8"}], "n": null}'


def test_feed_profile_of_nested_xml_and_json(spark):
    rows = [("x", XML), ("x", XML), ("j", JSON), ("bad", "<a><b></a>"), ("bad", None), ("none", ""), ("bytes", None)]
    docs = spark.createDataFrame(rows, "source string, content string")
    got = {r.source: r for r in feeds.feed_profile(docs, "source", "content").collect()}
    # Two detectors, and the root, which has a date beside the last detector's leaves; the node between them equals that detector.
    x = got["x"]
    assert (x.parsed, x.records, x.devices, x.with_volume, x.with_validity, x.valid) == (True, 3, 2, 2, 3, 2)
    assert x.first_time == datetime(2023, 6, 19) and x.last_time == datetime(2023, 6, 19, 8)
    j = got["j"]
    assert (j.parsed, j.records, j.devices, j.with_volume, j.with_validity, j.valid) == (True, 3, 2, 2, 2, 2) and j.first_time == datetime(2023, 1, 2)
    assert all(not got[s].parsed and got[s].records == 0 and got[s].first_time is None for s in ("bad", "none", "bytes"))
    raw = spark.createDataFrame([("x", bytearray(XML.encode()))], "source string, content binary")
    assert feeds.feed_profile(raw, "source", "content").first().records == 3
    assert feeds.feed_profile(docs.limit(0), "source", "content").count() == 0


def test_schema_fingerprints_and_drift(spark):
    base = "<r><d><id>1</id><v>2</v></d><d><id>x</id><v></v></d></r>"
    rows = [("a", base), ("b", base), ("c", base.replace("<id>1</id>", "<id>1</id><new>n</new>")), ("d", "<r><d><id>1</id></d></r>"), ("e", base.replace("<v>2</v>", "<v>two</v>")), ("f", "not a document")]
    paths = feeds.schema_paths(spark.createDataFrame(rows, "file string, content string"), "file", "content")
    one = {(r.path, r.kind): r.n for r in paths.where("file = 'a'").collect()}
    assert one == {("/r", "node"): 1, ("/r/d", "node"): 2, ("/r/d/id", "number"): 1, ("/r/d/id", "text"): 1, ("/r/d/v", "number"): 1, ("/r/d/v", "empty"): 1}
    print_ = {r.path: (r.kinds, r.files, r.n) for r in feeds.schema_fingerprint(paths).collect()}
    assert print_["/r/d/v"] == (["empty", "number", "text"], 4, 8) and print_["/r/d/new"] == (["text"], 1, 1)
    # Reduced per part and then together, the fingerprint is the same.
    halves = feeds.schema_fingerprint(paths, F.when(F.col("file") < "c", "one").otherwise("two")).groupBy("path").agg(F.sum("n").alias("n"), F.sum("files").alias("files")).collect()
    assert {r.path: (r.files, r.n) for r in halves} == {p: v[1:] for p, v in print_.items()}
    got = {(r.file, r.path, r.drift) for r in feeds.schema_drift(paths).collect()}
    assert got == {("c", "/r/d/new", "extra"), ("d", "/r/d/v", "missing"), ("d", "/r/d/id", "kind"), ("e", "/r/d/v", "kind")}
    assert feeds.schema_drift(paths.where("file = 'a'")).count() == 0


def test_snapshot_audit(spark):
    rows = [("f", 1, "a", "Y", 2.0, 50.0), ("f", 1, "a", "N", 9.0, 1.0), ("f", 2, "b", "Y", 4.0, None), ("f", 2, "b", None, 1.0, 1.0), ("g", 1, None, "N", 1.0, 1.0)]
    got = {r.file: r for r in feeds.snapshot_audit(spark.createDataFrame(rows, "file string, period int, detector_id string, valid string, volume double, speed double"), "file").collect()}
    f = got["f"]
    assert (f.periods, f.detectors, f.detector_periods, f.lanes, f.valid_share, f.volume, f.median_speed) == (2, 2, 2, 4, 0.5, 6.0, 50.0) and got["g"].volume is None


def section(*lines):
    return list(lines)


def test_sections_with_broken_and_repeated_headers(spark):
    good = section(
        "Hong Kong Island : before the section", "Sub-total 999", "APPENDIX H", "Road Network", "Hong Kong Island :", "Major roads", "  a 10.0", "  Sub-total   120.5", "Minor roads", "  Sub-total 1.0", "Total Covered by Census 300.25",
        "Page 2", "Hong Kong Island : (continued)", "Kowloon and New Kowloon :", "Major", "Sub-total", "", "  80", "Sub-total 81", "Minor", "Total Covered by Census", "100.5 x", "New Territories:", "Minor", "Sub-total 5", "Major", "Total Covered by Census 7",
        "APPENDIX I", "New Territories:", "Major", "Sub-total 3",
    )
    rows = [("good", i, t) for i, t in enumerate(good)] + [("none", 0, "Kowloon:"), ("none", 1, None), ("open", 0, "appendix h"), ("open", 1, "Kowloon:"), ("open", 2, "Major Sub-total 2"), ("open", 3, "Total Covered by Census 5")]
    regions = {"island": r"Hong Kong Island\s*:", "kowloon": r"Kowloon(?: and New Kowloon)?\s*:", "nt": r"New Territories\s*:"}
    lines = spark.createDataFrame(rows, "document string, line_no int, text string").repartition(3)
    got = {(r.document, r.region, r.road_network): (r.length, r.derivation) for r in feeds.section_lengths(lines, r"^APPENDIX H", r"^APPENDIX I", regions).collect()}
    assert got == {
        ("good", "island", "major"): (120.5, "published_subtotal"), ("good", "island", "minor"): (179.75, "total_minus_major"), ("good", "island", "subtotal"): (300.25, "published_total"),
        ("good", "kowloon", "major"): (80.0, "published_subtotal"), ("good", "kowloon", "minor"): (20.5, "total_minus_major"), ("good", "kowloon", "subtotal"): (100.5, "published_total"),
        ("open", "kowloon", "major"): (2.0, "published_subtotal"), ("open", "kowloon", "minor"): (3.0, "total_minus_major"), ("open", "kowloon", "subtotal"): (5.0, "published_total"),
    }


def test_service_context_of_a_small_bundle(spark):
    days = {"weekday": "2023-06-20", "saturday": "2023-06-17"}
    week = ", ".join(f"{d} int" for d in transit.WEEK)
    calendar = spark.createDataFrame([("W", "2023-01-01", "2023-12-31", 1, 1, 1, 1, 1, 0, 0), ("S", "2023-01-01", "2023-12-31", 0, 0, 0, 0, 0, 1, 0), ("OLD", "2022-01-01", "2022-12-31", 1, 1, 1, 1, 1, 1, 1)], f"service_id string, start_date string, end_date string, {week}")
    calendar = calendar.withColumns({c: F.col(c).cast("date") for c in ("start_date", "end_date")})
    exceptions = spark.createDataFrame([("X", "2023-06-20", 1), ("W", "2023-06-17", 1), ("W", "2023-06-17", 2), ("S", "2023-06-20", 1)], "service_id string, date string, exception_type int").withColumn("date", F.col("date").cast("date"))
    services = transit.service_days(calendar, exceptions, days)
    assert {r.service_id: r.days for r in services.collect()} == {"W": 1, "S": 3, "OLD": 0, "X": 1}
    trips = spark.createDataFrame([("t1", "r1", "W"), ("t2", "r1", "S"), ("t3", "r2", "X"), ("t4", "r9", "OLD")], "trip_id string, route_id string, service_id string")
    stop_times = spark.createDataFrame([("t1", "a"), ("t1", "b"), ("t2", "a"), ("t3", "b"), ("t4", "a"), ("t9", "a")], "trip_id string, stop_id string")
    frequencies = spark.createDataFrame([("t1", "06:00:00", "07:00:00", 700), ("t1", "25:00:00", "25:01:00", 600), ("t2", "bad", "07:00:00", 60), ("t3", "06:00:00", "07:00:00", 0)], "trip_id string, start_time string, end_time string, headway_secs int")
    served = transit.stop_service(trips, stop_times, frequencies, services, days)
    stops = spark.createDataFrame([("a", 0.0, 100.0), ("b", 0.0, 400.0), ("c", 0.0, 450.0)], "stop_id string, sx double, sy double")
    targets = spark.createDataFrame([(1, 0.0, 0.0), (2, 9e5, 0.0)], "id int, x double, y double")
    context = transit.service_context(targets, stops, served, "id", days)
    got = {r.id: r for r in context.collect()}
    t1, r = 3600 / 700 + 1, got[1]
    assert (r.weekday_stop_count_250m, r.weekday_route_count_250m, r.saturday_stop_count_250m, r.saturday_route_count_250m) == (1, 1, 1, 1)
    assert r.weekday_weighted_service_250m == pytest.approx(t1 + 1) and r.saturday_weighted_service_250m == 1
    assert (r.weekday_stop_count_500m, r.weekday_route_count_500m) == (3, 2) and r.weekday_weighted_service_500m == pytest.approx(2 * t1 + 2) and r.saturday_weighted_service_500m == 1
    assert all(v == 0 for c, v in got[2].asDict().items() if c != "id")
    audit = {a.day_type: a for a in transit.context_audit(context, services, trips, stop_times, days).collect()}
    assert (audit["weekday"].active_services, audit["weekday"].active_trips, audit["weekday"].active_stop_events, audit["weekday"].share_with_service) == (3, 3, 4, 0.5)
    assert (audit["saturday"].active_services, audit["saturday"].active_trips, audit["saturday"].active_stop_events) == (1, 1, 1)


def test_lineage_through_joins_unions_and_functions(spark, tmp_path):
    for name, ddl in (("left", "k long, a long, b long"), ("right", "k long, c string")):
        spark.createDataFrame([(1, 2, 3) if name == "left" else (1, "x y")], ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    left, right = (spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("left", "right"))
    met = left.join(right, "k").groupBy("k").agg((F.sum("a") + F.max("b")).alias("s"), F.first("c").alias("c")).withColumn("w", F.explode(F.split("c", " "))).withColumn("one", F.lit(1))
    both = met.select("k", "s", "w", "one").unionByName(left.select("k", F.col("b").alias("s"), F.lit("z").alias("w"), F.lit(2).alias("one")))
    got = lineage.sources(both)
    assert got == {"k": ["left.k"], "s": ["left.a", "left.b"], "w": ["right.c"], "one": []}
    mapped = left.select("a", "b").mapInArrow(lambda batches: batches, "a long, b long")
    assert lineage.sources(mapped) == {"a": ["left.a", "left.b"], "b": ["left.a", "left.b"]}
    rows = {r.feature: r for r in lineage.manifest(both, {"s": ("role", True), "gone": ("none", False)}).collect()}
    assert rows["s"].sources == "left.a, left.b" and rows["s"].available_count == 3 and rows["gone"].available_count == 0 and rows["gone"].sources == "" and rows["s"].available_share == 1.0


def test_archive_listings_of_any_shape(spark):
    one = '{"timestamps": ["20230619-0800", "202306190900", "99999999-0000"], "meta": {"Total Versions": "12", "total": -4}, "files": [{"name": "a.ZIP", "size": 2e9}, {"name": "a.ZIP", "size": "x"}, "b.zip"]}'
    rows = [("a", one), ("a", '[{"record_count": 40, "u": "http://x/20230101-0000/b.zip"}]'), ("b", '{"n": 1}'), ("c", "no listing")]
    got = {r.source: r for r in feeds.archive_listing(spark.createDataFrame(rows, "source string, content string"), "source", "content").collect()}
    a = got["a"]
    assert (a.versions, a.zips, a.total_gb, a.timestamps, a.first_timestamp, a.last_timestamp) == (40, 3, 2.0, 3, "20230101-0000", "20230619-0900")
    assert got["b"].versions is None and got["b"].timestamps == 0 and set(got) == {"a", "b"}


def test_way_features(spark):
    tags = [{"highway": "Primary_link", "name": "Weg", "name:en": "Way", "lanes": "2;3", "maxspeed": "30 mph", "oneway": "-1", "bridge": "yes", "junction": "circular", "access": "private"}, {"highway": "track"}, {}, None]
    line = [{"lon": 114.0, "lat": 22.0}, {"lon": 114.0, "lat": 22.01}]
    rows = [(i, t, line) for i, t in enumerate(tags)] + [(9, {}, [line[0], line[0]])]
    got = {r.osm_id: r for r in readers.way_features(spark.createDataFrame(rows, "osm_id long, tags map<string,string>, geometry array<struct<lat:double,lon:double>>")).collect()}
    r = got[0]
    assert (r.highway, r.highway_group, r.name, r.lanes, r.oneway, r.bridge, r.tunnel, r.roundabout, r.access_restricted, r.link, r.name_present) == ("primary_link", "primary", "Way", 2.0, 1, 1, 0, 1, 1, 1, 1)
    assert r.maxspeed_kmh == pytest.approx(48.28, abs=0.01) and r.length_m == pytest.approx(1111.9, abs=1)
    assert got[1].highway_group == "track" and got[2].highway_group == "unmatched" and got[3].name == "" and set(got) == {0, 1, 2, 3}


def test_classes_and_hours_of_wide_columns():
    names = ["CAR_Volume_07", "BUS_Volume_23", "NOX_CAR_01", "car_Volume_08", "id"]
    assert readers.classes_and_hours(names, "traffic_volume") == ({"CAR", "BUS"}, {"07", "23"}) and readers.classes_and_hours(names, "nox_emissions") == ({"CAR"}, {"01"})
