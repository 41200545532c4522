"""Queries of feeds, schedules and lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.operators import lineage, transit
from fathomline.plans.frames import POINTS, TRAINING, points, training
from fathomline.plans.q_stats import rounded
from fathomline.plans.registry import query
from fathomline.session import table
from fathomline.sources import feeds

DAYS = {"weekday": "2023-06-20", "saturday": "2023-06-17"}


def bundle(spark, sf):
    """Orders as trips, their lines as stop times, priorities as services with weekly patterns and exceptions."""
    o, digit = table(spark, sf, "orders"), F.substring("o_orderpriority", 1, 1).cast("int")
    key = F.col("o_orderkey")
    trips = o.select(key.alias("trip_id"), (F.col("o_custkey") % 40).alias("route_id"), F.col("o_orderpriority").alias("service_id"))
    stop_times = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("trip_id"), (F.col("l_partkey") % 500).alias("stop_id"))
    clock = F.concat(F.lpad((7 + key % 5).cast("string"), 2, "0"), F.lit(":30:00"))
    frequencies = o.where(key % 3 == 0).select(key.alias("trip_id"), F.lit("06:00:00").alias("start_time"), clock.alias("end_time"), (600 + key % 4 * 300).cast("int").alias("headway_secs"))
    services = o.select(F.col("o_orderpriority").alias("service_id"), digit.alias("d")).distinct()
    week = (F.col("d") <= 3).cast("int")
    calendar = services.select("service_id", F.lit("2023-01-01").cast("date").alias("start_date"), F.lit("2023-12-31").cast("date").alias("end_date"), *[week.alias(c) for c in transit.WEEK[:5]], F.col("d").isin(2, 4).cast("int").alias("saturday"), F.lit(0).alias("sunday"))
    change = lambda d, day, kind: services.where(F.col("d") == d).select("service_id", F.lit(DAYS[day]).cast("date").alias("date"), F.lit(kind).alias("exception_type"))
    exceptions = change(5, "weekday", 1).unionByName(change(2, "weekday", 2)).unionByName(change(4, "saturday", 1)).unionByName(change(4, "saturday", 2))
    return trips, stop_times, frequencies, calendar, exceptions


@query("e26_service_context", f"""WITH {POINTS}, stops AS (SELECT vec_id AS stop_id, embedding[3]::DOUBLE * 1000 AS sx, embedding[4]::DOUBLE * 1000 AS sy FROM embeddings),
n AS (SELECT a.vec_id, s.stop_id, sqrt((a.x - s.sx) * (a.x - s.sx) + (a.y - s.sy) * (a.y - s.sy)) AS g FROM points a JOIN stops s ON sqrt((a.x - s.sx) * (a.x - s.sx) + (a.y - s.sy) * (a.y - s.sy)) <= 20),
t AS (SELECT o_orderkey, o_custkey % 40 AS route, substr(o_orderpriority, 1, 1)::INTEGER AS d, CASE WHEN o_orderkey % 3 = 0 THEN greatest(1, ((7 + o_orderkey % 5) * 3600 + 1800 - 21600) / (600 + o_orderkey % 4 * 300)::DOUBLE) ELSE 1 END AS w FROM orders),
ss AS (SELECT l_partkey % 500 AS stop_id, route, sum(w) FILTER (WHERE d IN (1, 3, 5)) AS w0, sum(w) FILTER (WHERE d = 2) AS w1 FROM lineitem JOIN t ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT p.vec_id, {', '.join(f'''count(DISTINCT n.stop_id) FILTER (WHERE g <= {r}) AS {label}_stop_count_{r}m, round(coalesce(sum({w}) FILTER (WHERE g <= {r}), 0), 4) AS {label}_weighted_service_{r}m, count(DISTINCT route) FILTER (WHERE g <= {r} AND {w} IS NOT NULL) AS {label}_route_count_{r}m''' for label, w in (('weekday', 'w0'), ('saturday', 'w1')) for r in (10, 20))}
FROM points p LEFT JOIN n ON n.vec_id = p.vec_id LEFT JOIN ss ON ss.stop_id = n.stop_id GROUP BY p.vec_id""")
def _(spark, sf):
    trips, stop_times, frequencies, calendar, exceptions = bundle(spark, sf)
    at = lambda i: F.get("embedding", i).cast("double") * 1000
    stops = table(spark, sf, "embeddings").select(F.col("vec_id").alias("stop_id"), at(2).alias("sx"), at(3).alias("sy"))
    served = transit.stop_service(trips, stop_times, frequencies, transit.service_days(calendar, exceptions, DAYS), DAYS)
    return rounded(transit.service_context(points(spark, sf), stops, served, "vec_id", DAYS, (10.0, 20.0)))


@query("s20_feed_profile", """WITH e AS (SELECT event_type AS source, user_id, value, ts, event_id FROM events),
leaf AS (SELECT DISTINCT source, user_id, value, event_id % 3 = 0 AS yes, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS t FROM e),
dev AS (SELECT DISTINCT source, user_id, value, yes FROM leaf)
SELECT l.source, true AS parsed, l.n + d.n AS records, l.devices, l.n + d.n AS with_volume, l.n + d.n AS with_validity, l.valid + d.valid AS valid, l.first_time, l.last_time
FROM (SELECT source, count(*) AS n, count(DISTINCT user_id) AS devices, count(*) FILTER (WHERE yes) AS valid, min(t) AS first_time, max(t) AS last_time FROM leaf GROUP BY 1) l
JOIN (SELECT source, count(*) AS n, count(*) FILTER (WHERE yes) AS valid FROM dev GROUP BY 1) d USING (source)""")
def _(spark, sf):
    e = table(spark, sf, "events")
    # A nested document for every event; every other one is written as XML.
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    valid = F.when(F.col("event_id") % 3 == 0, "Y").otherwise("N")
    text = F.col("value").cast("string")
    written = F.to_json(F.struct(F.struct(F.array(F.struct(F.col("user_id").cast("string").alias("id"), F.struct(text.alias("Volume"), valid.alias("valid")).alias("lane"))).alias("devices"), time.alias("time")).alias("feed")))
    xml = F.concat(F.lit('<a:root xmlns:a="urn:a"><feed><a:device><id>'), F.col("user_id").cast("string"), F.lit("</id><lane><Volume>"), text, F.lit("</Volume><valid>"), valid, F.lit("</valid></lane></a:device><time>"), time, F.lit("</time></feed></a:root>"))
    documents = e.select(F.col("event_type").alias("source"), F.when(F.col("event_id") % 2 == 0, written).otherwise(xml).alias("content"))
    found = feeds.feed_profile(documents, "source", "content")
    day = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c)
    return found.select("source", "parsed", "records", "devices", "with_volume", "with_validity", "valid", day("first_time"), day("last_time"))


@query("s19_snapshot_audit", """WITH l AS (SELECT strftime(ts, '%Y-%m-%d') AS file, hour(ts) AS period, user_id AS detector_id, event_id % 4 <> 0 AS ok, value, length(event_type) * value AS speed FROM events)
SELECT file, count(DISTINCT period) AS periods, count(DISTINCT detector_id) AS detectors, count(DISTINCT (period, detector_id)) AS detector_periods, count(*) AS lanes, round(avg(ok::INTEGER), 6) AS valid_share, round(sum(value) FILTER (WHERE ok), 4) AS volume, round(median(speed) FILTER (WHERE ok), 4) AS median_speed FROM l GROUP BY 1""")
def _(spark, sf):
    e = table(spark, sf, "events")
    lanes = e.select(
        F.date_format("ts", "yyyy-MM-dd").alias("file"), F.hour("ts").alias("period"), F.col("user_id").alias("detector_id"), F.when(F.col("event_id") % 4 != 0, "Y").otherwise("N").alias("valid"),
        F.col("value").alias("volume"), (F.length("event_type") * F.col("value")).alias("speed"),
    )
    found = feeds.snapshot_audit(lanes, "file")
    return found.withColumn("valid_share", F.round("valid_share", 6)).withColumn("volume", F.round("volume", 4)).withColumn("median_speed", F.round("median_speed", 4))


@query("e21_feature_lineage", f"""WITH {TRAINING}, n AS (SELECT count(*) AS n FROM training)
SELECT f.*, CASE WHEN sources = '' THEN 0 ELSE n END AS available_count, n AS total_count, (CASE WHEN sources = '' THEN 0 ELSE 1 END)::DOUBLE AS available_share FROM n, (VALUES
  ('extent', 'orders.o_orderdate', 'structural', true), ('route', 'customer.c_acctbal', 'structural', true), ('segment', 'customer.c_mktsegment', 'structural', true), ('fold', 'nation.n_regionkey', 'design', false),
  ('station_id', 'orders.o_custkey', 'key', false), ('aadt', 'orders.o_orderdate, orders.o_totalprice', 'target', false), ('match_distance', '', 'oracle_diagnostic_only', false)) f(feature, sources, role, allowed)""")
def _(spark, sf):
    roles = {"extent": ("structural", True), "route": ("structural", True), "segment": ("structural", True), "fold": ("design", False), "station_id": ("key", False), "aadt": ("target", False), "match_distance": ("oracle_diagnostic_only", False)}
    return lineage.manifest(training(spark, sf), roles)


@query("s26_archive_listing", """WITH d AS (SELECT event_type AS source, strftime(ts, '%Y%m%d-%H%M') AS t, event_id, user_id, value FROM events)
SELECT source, max(event_id) AS versions, count(DISTINCT user_id) AS zips, round(sum(CASE WHEN value > 0 THEN value END) / 1e9, 12) AS total_gb, count(DISTINCT t) AS timestamps, min(t) AS first_timestamp, max(t) AS last_timestamp FROM d GROUP BY 1""")
def _(spark, sf):
    e = table(spark, sf, "events")
    # A listing for every event, of one shape where its number is even and another, with the stamp inside a name, where it is odd.
    stamp = F.date_format("ts", "yyyyMMdd-HHmm")
    member = F.struct(F.concat(F.lit("m_"), F.col("user_id").cast("string"), F.lit(".ZIP")).alias("name"), F.col("value").alias("fileSize"), F.col("value").alias("size"))
    one = F.to_json(F.struct(F.array(stamp).alias("timestamps"), F.struct(F.col("event_id").alias("Total-Count"), F.array(F.struct(member["name"].alias("n"), member["size"].alias("file size"))).alias("files")).alias("archive")))
    first, second = F.struct(F.concat(F.lit("snap_"), F.regexp_replace(stamp, "-", ""), F.lit(".xml")).alias("key"), F.col("event_id").alias("version_count")), F.struct(member["name"].alias("file"), member["size"].alias("Size"))
    two = F.concat(F.lit("["), F.to_json(first), F.lit(","), F.to_json(second), F.lit("]"))
    found = feeds.archive_listing(e.select(F.col("event_type").alias("source"), F.when(F.col("event_id") % 2 == 0, one).otherwise(two).alias("content")), "source", "content")
    return found.withColumn("total_gb", F.round("total_gb", 12))
