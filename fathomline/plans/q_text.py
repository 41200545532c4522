"""Queries of string functions, parsing, sources and text linkage."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.functions import dates, text
from fathomline.plans.registry import query
from fathomline.session import table


#: A part's name as a road name with an abbreviation, an accent and an ampersand.
ROAD_NAME = "concat('Café ', p_name, CASE WHEN p_size > 25 THEN ' Road' WHEN p_size > 10 THEN ' & Highway Junction' ELSE ' Roadside' END)"


@query("f01_normalise", f"""WITH n AS (SELECT p_partkey, regexp_replace(lower(strip_accents({ROAD_NAME})), '&', ' and ', 'g') AS x FROM part)
SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '\\broad\\b', 'rd', 'g'), '\\bstreet\\b', 'st', 'g'), '\\bavenue\\b', 'ave', 'g'), '\\bhighway\\b', 'hwy', 'g'), '\\bjunction\\b', 'jct', 'g'), '[^a-z0-9]+', ' ', 'g')) AS name FROM n""")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.normalize(F.expr(ROAD_NAME)).alias("name"))


@query("f09_f17_keys_and_labels", f"""WITH p AS (SELECT p_partkey, CASE WHEN p_size > 40 THEN p_brand ELSE '' END AS code, p_name, p_type FROM part), l AS (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN 'Kowloon ' WHEN p_partkey % 3 = 1 THEN 'New  Territories ' ELSE 'Hong Kong Island ' END || CASE WHEN p_partkey % 2 = 0 THEN 'Sub-total' WHEN p_partkey % 5 = 0 THEN 'Minor roads' ELSE 'major' END AS label FROM p)
SELECT p_partkey, CASE WHEN code <> '' THEN 'street_code:' || code ELSE 'street_name:' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) END AS road_key,
  CASE WHEN label LIKE 'Hong%' THEN 'hong_kong_island' WHEN label LIKE 'Kow%' THEN 'kowloon' ELSE 'new_territories' END AS region, CASE WHEN label LIKE '%Sub-total' THEN 'subtotal' WHEN label LIKE '%major' THEN 'major' ELSE 'minor' END AS network FROM l""")
def _(spark, sf):
    k = F.col("p_partkey")
    place = F.when(k % 3 == 0, "Kowloon ").when(k % 3 == 1, "New  Territories ").otherwise("Hong Kong Island ")
    label = F.concat(place, F.when(k % 2 == 0, "Sub-total").when(k % 5 == 0, "Minor roads").otherwise("major"))
    code = F.when(F.col("p_size") > 40, F.col("p_brand")).otherwise("")
    return table(spark, sf, "part").select("p_partkey", text.road_key(code, F.lit(""), F.col("p_name")).alias("road_key"), text.region_of_label(label).alias("region"), text.network_of_label(label).alias("network"))


@query("f02_m21_jaccard_containment", """WITH n AS (SELECT DISTINCT p_name, list_distinct(string_split(lower(p_name), ' ')) AS t FROM part) SELECT a.p_name AS left_name, b.p_name AS right_name, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) AS jaccard, round(len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t)), 6) AS containment FROM n a JOIN n b ON a.p_name < b.p_name AND list_has_any(a.t, b.t)""")
def _(spark, sf):
    n = table(spark, sf, "part").select("p_name").distinct().withColumn("t", text.tokens(F.col("p_name")))
    opened = n.withColumn("w", F.explode("t"))
    a, b = (opened.select(F.col("p_name").alias(f"{s}_name"), F.col("t").alias(f"{s}_t"), "w") for s in ("left", "right"))
    pairs = a.join(b, "w").where("left_name < right_name").drop("w").distinct()
    return pairs.select("left_name", "right_name", F.round(text.jaccard(F.col("left_t"), F.col("right_t")), 6).alias("jaccard"), F.round(text.containment(F.col("left_t"), F.col("right_t")), 6).alias("containment"))


@query("f02_f05_sequence_similarity")
def _(spark, sf):
    n = table(spark, sf, "part").select("p_name", "p_type").distinct()
    a, b = F.col("p_name"), F.col("p_type")
    return n.select("p_name", "p_type", text.text_similarity(a, b).alias("text_similarity"), text.name_similarity(a, b).alias("name_similarity"), text.core_name_similarity(a, b, {"STEEL": "METAL"}, ("LARGE",)).alias("core_similarity"), text.substring_or_ratio(a, b).alias("substring_or_ratio"))


@query("f06_best_of_variants", """WITH v AS (SELECT p_partkey, [lower(p_name), lower(p_type)] AS vs, [lower(p_brand), lower(p_name), '-99'] AS ns FROM part), j AS (SELECT p_partkey, v, n FROM v, unnest(vs) AS a(v), unnest(ns) AS b(n)), t AS (SELECT p_partkey, n, list_distinct(list_filter(string_split(trim(regexp_replace(v, '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '')) AS x, list_distinct(list_filter(string_split(trim(regexp_replace(n, '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '')) AS y FROM j) SELECT p_partkey, round(max(CASE WHEN n = '-99' THEN 0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END), 6) AS similarity FROM t GROUP BY p_partkey""")
def _(spark, sf):
    p = table(spark, sf, "part")
    best = text.best_of_variants(F.array(F.lower("p_name"), F.lower("p_type")), F.array(F.lower("p_brand"), F.lower("p_name"), F.lit("-99")))
    return p.select("p_partkey", F.round(best, 6).alias("similarity"))


@query("p05_f08_confidence_orientation", """WITH s AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS a, l_tax * 12 AS b FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN a >= 0.9 AND b >= 0.85 THEN 'high' WHEN (a >= 0.9 AND b >= 0.6) OR (a >= 0.7 AND b >= 0.75) OR (a >= 0.5 AND b >= 0.9) THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN b >= 0.85 AND b > a + 0.1 THEN 'reversed' WHEN a >= 0.85 THEN 'direct' WHEN b > a + 0.1 THEN 'possible_reversal' ELSE 'ambiguous' END AS orientation FROM s""")
def _(spark, sf):
    a, b = F.col("l_discount") * 10, F.col("l_tax") * 12
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.confidence(a, b).alias("confidence"), text.orientation(a, b).alias("orientation"))


@query("f10_f18_extract_and_lists", """SELECT page_id, regexp_extract(url, '(\\d+)', 1) AS first_number, len(regexp_extract_all(url, '\\d+')) AS numbers, array_to_string(list_filter(string_split(regexp_replace(url, '[/:.]+', ';', 'g'), ';'), lambda x: trim(x) <> ''), '|') AS parts FROM pages""")
def _(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", F.regexp_extract(u, r"(\d+)", 1).alias("first_number"), F.size(F.regexp_extract_all(u, F.lit(r"(\d+)"), F.lit(1))).cast("long").alias("numbers"), F.array_join(text.split_list(F.regexp_replace(u, "[/:.]+", ";")), "|").alias("parts"))


@query("f11_slug", "SELECT DISTINCT p_type, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_type", text.slug(F.col("p_type")).alias("slug")).distinct()


#: Road classes and speeds as texts, spread over the parts: links, lists, units and missing ones.
ROADS = """roads AS (SELECT p_partkey, ['motorway', 'Trunk', 'primary', 'residential', 'service', 'track', 'footway', ''][(p_partkey % 8) + 1] || CASE WHEN p_size % 5 = 0 THEN '_link' ELSE '' END AS road,
  CASE p_partkey % 5 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN p_size || ' mph' WHEN 2 THEN p_size || ';60' WHEN 3 THEN 'none' END AS speed FROM part)"""


def road_texts(spark, sf):
    classes = F.array(*[F.lit(x) for x in ("motorway", "Trunk", "primary", "residential", "service", "track", "footway", "")])
    key, size = F.col("p_partkey"), F.col("p_size")
    road = F.concat(F.get(classes, (key % 8).cast("int")), F.when(size % 5 == 0, "_link").otherwise(""))
    number = size.cast("string")
    speed = F.when(key % 5 == 0, number).when(key % 5 == 1, F.concat(number, F.lit(" mph"))).when(key % 5 == 2, F.concat(number, F.lit(";60"))).when(key % 5 == 3, "none")
    return table(spark, sf, "part").select("p_partkey", road.alias("road"), speed.alias("speed"))


@query("f12_f15_road_groups_and_speed", f"""WITH {ROADS} SELECT p_partkey, road, speed,
CASE WHEN b IN ('motorway', 'trunk', 'primary', 'secondary', 'tertiary') THEN b WHEN b IN ('residential', 'unclassified', 'living_street', 'road') THEN 'local' WHEN b = 'track' THEN 'local' WHEN b = 'service' THEN 'service' WHEN b = '' THEN 'unmatched' ELSE 'other' END AS road_group,
coalesce(split_part(speed, ';', 1), '') AS first_speed, round(CASE WHEN contains(lower(speed), 'mph') THEN n * 1.609344 ELSE n END, 6) AS kmh, (lower(road) IN ('service', 'track'))::INTEGER AS flagged
FROM (SELECT *, regexp_replace(lower(trim(road)), '_link$', '') AS b, try_cast(regexp_extract(coalesce(speed, ''), '(\\d+(?:\\.\\d+)?)', 1) AS DOUBLE) AS n FROM roads)""")
def _(spark, sf):
    road, speed = F.col("road"), F.col("speed")
    first = text.first_value(F.split(speed, ";"))
    return road_texts(spark, sf).select("p_partkey", "road", "speed", text.road_group(road).alias("road_group"), first.alias("first_speed"), F.round(text.speed_kmh(speed), 6).alias("kmh"), text.flag(road, ("service", "track")).alias("flagged"))


@query("f16_p09_clean_ids_and_numbers", """WITH r AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN p_partkey || '.0' WHEN 1 THEN ' ' || p_size || ' ' WHEN 2 THEN 'nan' WHEN 3 THEN '<null>' WHEN 4 THEN '1,' || lpad(p_size::VARCHAR, 3, '0') || '*' WHEN 5 THEN p_size || '.5' END AS v FROM part)
SELECT p_partkey, v, CASE WHEN lower(trim(coalesce(v, ''))) IN ('nan', 'none', '<null>', 'null') THEN '' ELSE regexp_replace(trim(coalesce(v, '')), '^(\\d+)\\.0$', '\\1') END AS id, try_cast(regexp_replace(v, '[,* ]', '', 'g') AS DOUBLE) AS number FROM r""")
def _(spark, sf):
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    v = (
        F.when(key % 7 == 0, F.concat(key.cast("string"), F.lit(".0"))).when(key % 7 == 1, F.concat(F.lit(" "), size, F.lit(" "))).when(key % 7 == 2, "nan").when(key % 7 == 3, "<null>")
        .when(key % 7 == 4, F.concat(F.lit("1,"), F.lpad(size, 3, "0"), F.lit("*"))).when(key % 7 == 5, F.concat(size, F.lit(".5")))
    )
    r = table(spark, sf, "part").select("p_partkey", v.alias("v"))
    number = text.number(F.col("v"))
    return r.select("p_partkey", "v", text.clean_id(F.col("v")).alias("id"), F.when(~F.isnan(number), number).otherwise(F.when(F.lower(F.trim("v")) == "nan", F.lit(float("nan")))).alias("number"))


@query("f19_evidence_text", "SELECT c_mktsegment, printf('%d customers, mean %.2f', count(*), avg(c_acctbal)) AS evidence FROM customer GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.format_string("%d customers, mean %.2f", F.count(F.lit(1)), F.avg("c_acctbal")).alias("evidence"))


@query("d06_d08_times", """WITH r AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN event_type WHEN event_id % 9 = 1 THEN NULL ELSE (hour(ts) + 4) || ':' || lpad(minute(ts)::VARCHAR, 2, '0') || ':' || lpad(second(ts)::VARCHAR, 2, '0') END AS t,
  CASE event_id % 4 WHEN 0 THEN event_type || '_' || strftime(ts, '%Y%m%d') || '.zip' WHEN 1 THEN strftime(ts, '%Y-%m-%d') || '.csv' WHEN 2 THEN event_type ELSE '99999999' END AS name FROM events)
SELECT event_id, t, name, try_cast(regexp_extract(coalesce(t, ''), '^\\s*(\\d+):(\\d{1,2}):(\\d{1,2})\\s*$', 1) AS INTEGER) * 3600 + try_cast(regexp_extract(coalesce(t, ''), '^\\s*(\\d+):(\\d{1,2}):(\\d{1,2})\\s*$', 2) AS INTEGER) * 60 + try_cast(regexp_extract(coalesce(t, ''), '^\\s*(\\d+):(\\d{1,2}):(\\d{1,2})\\s*$', 3) AS INTEGER) AS seconds,
nullif(regexp_extract(name, '((?:19|20)\\d{2})[-_]?(0[1-9]|1[0-2])[-_]?([0-3]\\d)', 1) || '-' || regexp_extract(name, '((?:19|20)\\d{2})[-_]?(0[1-9]|1[0-2])[-_]?([0-3]\\d)', 2) || '-' || regexp_extract(name, '((?:19|20)\\d{2})[-_]?(0[1-9]|1[0-2])[-_]?([0-3]\\d)', 3), '--') AS day FROM r""")
def _(spark, sf):
    e, turn = table(spark, sf, "events"), F.col("event_id")
    clock = F.concat((F.hour("ts") + 4).cast("string"), F.lit(":"), F.lpad(F.minute("ts").cast("string"), 2, "0"), F.lit(":"), F.lpad(F.second("ts").cast("string"), 2, "0"))
    t = F.when(turn % 9 == 0, F.col("event_type")).when(turn % 9 == 1, F.lit(None)).otherwise(clock)
    name = F.when(turn % 4 == 0, F.concat("event_type", F.lit("_"), F.date_format("ts", "yyyyMMdd"), F.lit(".zip"))).when(turn % 4 == 1, F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit(".csv"))).when(turn % 4 == 2, F.col("event_type")).otherwise("99999999")
    r = e.select("event_id", t.alias("t"), name.alias("name"))
    return r.select("event_id", "t", "name", dates.service_seconds(F.col("t")).alias("seconds"), F.date_format(dates.date_in_name(F.col("name")), "yyyy-MM-dd").alias("day"))


@query("s11_html_fields", """WITH c AS (SELECT page_id, list_transform(regexp_extract_all(html, '<li><a href="/[^"<>]*">[^<>]*</a></li>'), lambda x: [regexp_extract(x, 'href="/([^"]*)"', 1), regexp_extract(x, '">([^<]*)</a>', 1)]) AS f, html FROM pages),
u AS (SELECT page_id, i, f[i] AS x FROM c, range(1, len(f) + 1) AS t(i)),
e AS (SELECT page_id, i, trim(x[1]) AS k, trim(x[2]) AS v FROM (SELECT page_id, i, list_transform(x, lambda s: replace(replace(replace(replace(replace(replace(s, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&')) AS x FROM u)), d AS (SELECT page_id, k, arg_max(v, i) AS v FROM e GROUP BY 1, 2)
SELECT c.page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, count(d.k)::INTEGER AS n_fields, coalesce(sum(length(d.k)), 0)::BIGINT AS key_chars, coalesce(sum(length(d.v)), 0)::BIGINT AS value_chars FROM c LEFT JOIN d USING (page_id) GROUP BY c.page_id, html""")
def _(spark, sf):
    p = table(spark, sf, "pages")
    # The navigation's links as rows of a field table: the target beside its name.
    links = F.regexp_extract_all("html", F.lit('(<li><a href="/[^"<>]*">[^<>]*</a></li>)'), F.lit(1))
    cells = F.transform(links, lambda x: F.regexp_replace(x, '<li><a href="/([^"]*)">([^<]*)</a></li>', "<tr><td class='k'><b>$1</b></td>\n<td>$2</td></tr>"))
    fields = F.array_join(cells, "")
    of = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda acc, x: acc + F.length(x))
    m = p.select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), text.html_fields(fields).alias("m"))
    return m.select("page_id", "title", F.size("m").alias("n_fields"), of(F.map_keys("m")).alias("key_chars"), of(F.map_values("m")).alias("value_chars"))


@query("s26_json_fields", "SELECT json_extract_string(props, '$.k') AS k, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1")
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return e.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("s30_static_tables", "SELECT c.road_class, c.place, count(l_orderkey) AS n, round(coalesce(sum(l_quantity), 0), 4) AS quantity FROM (VALUES ('R', 'motorway', 1), ('A', 'trunk', 2), ('N', 'primary', 3), ('Z', 'secondary', 4)) c(code, road_class, place) LEFT JOIN lineitem ON l_returnflag = c.code GROUP BY 1, 2")
def _(spark, sf):
    # A table kept in the code gives the rows of the given table their class and order; classes without rows stay.
    classes = spark.createDataFrame([("R", "motorway", 1), ("A", "trunk", 2), ("N", "primary", 3), ("Z", "secondary", 4)], "code string, road_class string, place int")
    found = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("code")).agg(F.count("l_orderkey").alias("n"), F.sum("l_quantity").alias("quantity"))
    return classes.join(found, "code", "left").na.fill(0).select("road_class", "place", "n", F.round("quantity", 4).alias("quantity"))


@query("k03_geojson_features")
def _(spark, sf):
    from fathomline.plans.frames import points
    from fathomline.sources.sinks import feature, point

    return points(spark, sf).select("vec_id", feature(point(F.col("x"), F.col("y")), ["vec_id", "label"]).alias("feature"))


@query("e27_review_priority", """WITH g AS (SELECT c_nationkey, bool_or(c_acctbal < 0) AS negative, bool_or(c_acctbal > 9000) AS rich, count(*) AS n FROM customer GROUP BY 1) SELECT c_nationkey, CASE WHEN negative AND rich THEN 'P1' WHEN negative THEN 'P2' WHEN rich THEN 'P3' ELSE 'P4' END AS priority, n FROM g""")
def _(spark, sf):
    g = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.bool_or(F.col("c_acctbal") < 0).alias("negative"), F.bool_or(F.col("c_acctbal") > 9000).alias("rich"), F.count(F.lit(1)).alias("n"))
    level = F.when(F.col("negative") & F.col("rich"), "P1").when(F.col("negative"), "P2").when(F.col("rich"), "P3").otherwise("P4")
    return g.select("c_nationkey", level.alias("priority"), "n")


@query("v09_review_contract", "SELECT count(*) AS n, count(DISTINCT doc_id) AS ids, count(*) FILTER (WHERE quality NOT IN (0, 1)) AS illegal FROM labels")
def _(spark, sf):
    return table(spark, sf, "labels").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("ids"), F.count_if(~F.col("quality").isin(0, 1)).alias("illegal"))
