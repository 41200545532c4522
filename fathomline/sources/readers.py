"""Scans with declared schemas. Blank text becomes null; nothing is inferred."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENCODINGS = ("utf-8", "big5", "cp950", "latin-1")


def csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str, columns: list[str] | None = None, encoding: str = "utf-8") -> DataFrame:
    """CSV with a header. Rows with malformed values keep nulls; a byte-order mark is dropped by the reader."""
    df = spark.read.schema(schema).csv(path, header=True, encoding=encoding, nullValue="", mode="PERMISSIVE")
    return df.select(*columns) if columns else df


def _decoded(encoding: str) -> Callable:
    @F.pandas_udf(T.StringType())
    def run(content: pd.Series) -> pd.Series:
        return content.map(lambda c: c.decode(encoding))

    return run


def csv_flexible(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV, each file in the first encoding that decodes its whole content. The driver gets one row a file.
    Encodings that Spark's reader does not know are decoded in Arrow batches, whole files at a time and one record a line."""

    @F.pandas_udf(T.StringType())
    def encoding(content: pd.Series) -> pd.Series:
        def first(raw: bytes) -> str:
            for name in ENCODINGS:
                try:
                    raw.decode(name)
                    return name
                except UnicodeDecodeError:
                    pass
            return ENCODINGS[-1]  # decodes anything

        return content.map(first)

    found = spark.read.format("binaryFile").load(path).select("path", encoding("content").alias("encoding")).collect()
    names = {r["encoding"] for r in found}
    if names <= {"utf-8"}:
        return csv(spark, path, schema)
    ddl = schema if isinstance(schema, str) else ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    parts = []
    for name in (e for e in ENCODINGS if e in names):
        # The reader takes paths as patterns.
        files = [re.sub(r"([][{}*?\\])", r"\\\1", r["path"]) for r in found if r["encoding"] == name]
        if name in ("utf-8", "latin-1"):
            parts.append(csv(spark, files, schema, encoding={"latin-1": "iso-8859-1"}.get(name, name)))
            continue
        lines = spark.read.format("binaryFile").load(files).select(F.posexplode(F.split(_decoded(name)("content"), "\r?\n")).alias("line_no", "line"))
        parts.append(lines.where("line_no > 0 AND line <> ''").select(F.from_csv("line", ddl, {"nullValue": ""}).alias("r")).select("r.*"))
    return reduce(DataFrame.unionByName, parts)


def find_column(df: DataFrame, candidates: list[str], loose: bool = True) -> str | None:
    """First candidate among the columns, without case, then without signs."""
    by_lower = {c.lower(): c for c in df.columns}
    plain = {"".join(ch for ch in c.lower() if ch.isalnum()): c for c in df.columns}
    for c in candidates:
        if c.lower() in by_lower:
            return by_lower[c.lower()]
        if loose and (p := "".join(ch for ch in c.lower() if ch.isalnum())) in plain:
            return plain[p]
    return None


def xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def geojson(spark: SparkSession, path: str, properties: T.StructType, expected: int | None = None, key: str | None = None) -> DataFrame:
    """Features of a collection as (properties..., geometry text); counts and keys checked when asked."""
    schema = T.StructType([T.StructField("features", T.ArrayType(T.StructType([T.StructField("properties", properties), T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())]))])))])
    df = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f")).select("f.properties.*", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"))
    if expected is not None and (found := df.count()) != expected:
        raise ValueError(f"{path}: {found} features, {expected} expected")
    if key is not None:
        from fathomline.operators.checks import require

        require(df, keys=[key])
    return df


def placemarks(spark: SparkSession, path: str) -> DataFrame:
    """Placemarks of KMZ archives as (file, place, fields, points, lines), in the order of each archive's first KML member.

    ``fields`` are the cells of the description, ``points`` and ``lines`` coordinates as array<struct<x, y>>, with lines
    of fewer than two vertices left out. Elements are read one at a time and dropped, so an archive costs a task its
    packed bytes; no placemark gives no row. An archive without a KML member, or with broken XML, is an error.
    """
    from fathomline.functions.text import html_fields
    from fathomline.operators.spatial import parse_coordinates

    def elements(batches):
        import io
        import zipfile
        from xml.etree import ElementTree

        bare = lambda element: element.tag.rpartition("}")[2]
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    members = [m for m in archive.namelist() if m.lower().endswith(".kml")]
                    if not members:
                        raise ValueError(f"{file}: no KML member")
                    found = []
                    with archive.open(members[0]) as member:
                        place = 0
                        for _, element in ElementTree.iterparse(member):
                            if bare(element) != "Placemark":
                                continue
                            texts = {"Point": [], "LineString": []}
                            description = next((e.text or "" for e in element if bare(e) == "description"), "")
                            for shape in element.iter():
                                if bare(shape) in texts:
                                    texts[bare(shape)] += [e.text or "" for e in shape if bare(e) == "coordinates"]
                            found.append((file, place, description, texts["Point"], texts["LineString"]))
                            element.clear()
                            place += 1
                            if len(found) == 1000:
                                yield pd.DataFrame(found, columns=names)
                                found = []
                    yield pd.DataFrame(found, columns=names)

    names = ["file", "place", "description", "point_texts", "line_texts"]
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = raw.mapInPandas(elements, "file string, place long, description string, point_texts array<string>, line_texts array<string>")
    lines = F.filter(F.transform("line_texts", parse_coordinates), lambda line: F.size(line) >= 2)
    points = F.flatten(F.transform("point_texts", parse_coordinates))
    return rows.select("file", "place", html_fields(F.col("description")).alias("fields"), points.alias("points"), lines.alias("lines"))


def column_ids(words: DataFrame, low: float, high: float, footer: float = 60.0, digits: tuple[int, int] = (4, 5)) -> DataFrame:
    """station_id of each number of allowed length in one band of words (x0, top, page_height, text), above the footer.

    A number that stands there twice is an error, raised by the rows' own evaluation.
    """
    number = F.regexp_extract("text", r"^(\d{%d,%d})$" % digits, 1)
    kept = words.where((F.col("x0") >= low) & (F.col("x0") < high) & (F.col("top") < F.col("page_height") - footer) & (number != ""))
    counted = kept.groupBy(number.cast("long").alias("station_id")).agg(F.count(F.lit(1)).alias("_n"))
    once = F.when(F.col("_n") == 1, F.col("station_id")).otherwise(F.raise_error(F.concat(F.lit("station id stands twice: "), F.col("station_id").cast("string"))).cast("long"))
    return counted.select(once.alias("station_id"))


def osm_ways(spark: SparkSession, path: str) -> DataFrame:
    """Ways of an Overpass answer: one row per id (the first tile that has it), two or more nodes, tags as a map."""
    schema = "elements array<struct<type:string,id:bigint,tags:map<string,string>,geometry:array<struct<lat:double,lon:double>>>>"
    df = spark.read.schema(schema).json(path, multiLine=True).select(F.input_file_name().alias("tile"), F.explode("elements").alias("e"))
    ways = df.where("e.type = 'way' AND size(e.geometry) >= 2").select(F.col("e.id").alias("osm_id"), "e.tags", "e.geometry", "tile")
    return ways.groupBy("osm_id").agg(F.min_by(F.struct("tags", "geometry"), "tile").alias("w")).select("osm_id", "w.tags", "w.geometry")


#: Texts of a tag that mean yes, and that restrict access (fixed values).
YES, ONE_WAY, ROUND, CLOSED = ("yes", "true", "1"), ("yes", "true", "1", "-1"), ("roundabout", "circular"), ("no", "private", "destination", "customers", "permit")


def tag(tags: Column, *names: str) -> Column:
    """The value of the first of some alternate keys that a tag map has; null where it has none."""
    return F.coalesce(*[F.try_element_at(tags, F.lit(n)) for n in names])


def way_features(ways: DataFrame, length: Column | None = None) -> DataFrame:
    """Derived columns of ways (osm_id, tags, geometry): class and group, name with alternates, lanes, speed, flags, length in metres.

    Lengths are great-circle ones unless a column is given. Ways without a length are left out.
    """
    from fathomline.functions import text
    from fathomline.operators.spatial import haversine_km

    t = F.col("tags")
    highway = F.lower(F.trim(F.coalesce(tag(t, "highway"), F.lit(""))))
    name = F.coalesce(tag(t, "name:en", "name"), F.lit(""))
    steps = F.transform("geometry", lambda p, i: F.coalesce(haversine_km(F.get("geometry", i - 1)["lon"], F.get("geometry", i - 1)["lat"], p["lon"], p["lat"]), F.lit(0.0)))
    metres = length if length is not None else 1000 * F.aggregate(steps, F.lit(0.0), lambda acc, d: acc + d)
    named = F.regexp_extract(F.coalesce(tag(t, "lanes"), F.lit("")), r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    flags = {"oneway": ("oneway", ONE_WAY), "bridge": ("bridge", YES), "tunnel": ("tunnel", YES), "roundabout": ("junction", ROUND), "access_restricted": ("access", CLOSED)}
    out = ways.select(
        "osm_id", highway.alias("highway"), text.road_group(highway, "track").alias("highway_group"), name.alias("name"), named.alias("lanes"), text.speed_kmh(tag(t, "maxspeed")).alias("maxspeed_kmh"),
        *[text.flag(tag(t, key), values).alias(out) for out, (key, values) in flags.items()], highway.endswith("_link").cast("int").alias("link"), (name != "").cast("int").alias("name_present"), metres.alias("length_m"),
    )
    return out.where("length_m > 0")


#: Patterns of column names by product, class first and hour second (fixed values).
WIDE_COLUMNS = {"traffic_volume": r"^([A-Z]+)_Volume_(\d{2})$", "nox_emissions": r"^NOX_([A-Z]+)_(\d{2})$", "pm25_emissions": r"^PM25_([A-Z]+)_(\d{2})$"}


def classes_and_hours(columns: list[str], product: str) -> tuple[set[str], set[str]]:
    """Vehicle classes and hours that the columns of a wide product have, by their names."""
    found = [m for c in columns if (m := re.match(WIDE_COLUMNS[product], c))]
    return {m.group(1) for m in found}, {m.group(2) for m in found}


#: Members of a GTFS bundle and their columns, ids as text.
GTFS = {
    "stops": "stop_id string, stop_lon double, stop_lat double",
    "trips": "trip_id string, route_id string, service_id string",
    "stop_times": "trip_id string, stop_id string",
    "frequencies": "trip_id string, start_time string, end_time string, headway_secs int",
    "calendar": "service_id string, start_date string, end_date string, monday int, tuesday int, wednesday int, thursday int, friday int, saturday int, sunday int",
    "calendar_dates": "service_id string, date string, exception_type int",
}


def gtfs(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The six members of an unpacked bundle; columns are found by name, dates parsed."""
    out = {}
    for name, ddl in GTFS.items():
        fields = T._parse_datatype_string(ddl).fields
        raw = spark.read.csv(f"{folder}/{name}.txt", header=True)
        df = raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in raw.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
        for c in ("start_date", "end_date", "date"):
            if name.startswith("calendar") and c in df.columns:
                df = df.withColumn(c, F.try_to_date(c, "yyyyMMdd"))
        out[name] = df
    return out


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, name, date_in_name, kind) without reading contents."""
    from fathomline.functions.dates import date_in_name

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    name = F.substring_index("path", "/", -1)
    kind = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return files.withColumn("name", name).withColumn("date_in_name", date_in_name(name)).withColumn("kind", F.when(kind == "", "none").otherwise(kind))


def word_bands(words: DataFrame, bands: dict[str, tuple[float, float]], id_band: str, page: str = "page") -> DataFrame:
    """Words (page, x0, top, text) to records: a band per column, a record from each word in the id band to the next one."""
    from pyspark.sql import Window

    band = F.lit(None).cast("string")
    for name, (low, high) in bands.items():
        band = F.when((F.col("x0") >= low) & (F.col("x0") < high), F.lit(name)).otherwise(band)
    banded = words.withColumn("band", band).where("band IS NOT NULL")
    starts = F.when(F.col("band") == id_band, F.col("top"))
    record = F.last(starts, ignorenulls=True).over(Window.partitionBy(page).orderBy("top", "x0"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.round("top", 1).alias("t"), "x0", "text"))), lambda w: w["text"]), " ")
    return banded.withColumn("record_top", record).where("record_top IS NOT NULL").groupBy(page, "record_top").pivot("band", list(bands)).agg(joined)


def layout_table(lines: DataFrame, header: str, labels: list[str], span: int = 60, document: str | None = None) -> DataFrame:
    """Lines (line_no, text) after the first header line: label carried forward, the two spaced numbers of each line.

    With a ``document`` column every document has its own header line and labels; those without a header give no row.
    """
    from pyspark.sql import Window

    keys = [document] if document else []
    head = lines.where(F.col("text").rlike(header)).groupBy(*keys).agg(F.min("line_no").alias("_head"))
    body = (lines.join(head, keys) if keys else lines.crossJoin(F.broadcast(head))).where(F.col("line_no").between(F.col("_head") + 1, F.col("_head") + span))
    label = F.regexp_extract("text", "(" + "|".join(labels) + ")", 1)
    numbers = F.regexp_extract_all("text", F.lit(r"(\d{1,3}(?: \d{3})+|\d+)"), F.lit(1))
    rows = body.withColumn("label", F.when(label != "", label)).withColumn("numbers", numbers)
    rows = rows.withColumn("label", F.last("label", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("line_no")))  # at most `span` lines of a document
    return rows.where(F.size("numbers") >= 2).select(*keys, "line_no", "label", F.regexp_replace(F.get("numbers", 0), " ", "").cast("long").alias("first_value"), F.regexp_replace(F.get("numbers", 1), " ", "").cast("long").alias("second_value"))


def leaf_profile(documents: DataFrame, text: str, id_names: tuple[str, ...] = ("id", "detector_id", "device_id")) -> DataFrame:
    """Counts over leaf records of JSON texts: a record is any object with an id; equal records count once."""
    leaves = documents.select(F.explode(F.regexp_extract_all(text, F.lit(r"(\{[^{}]*\})"), F.lit(1))).alias("leaf")).distinct()
    named = leaves.withColumn("id", F.coalesce(*[F.get_json_object("leaf", f"$.{n}") for n in id_names]))
    return named.where("id IS NOT NULL").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("id").alias("ids"), F.count_if(F.lower("leaf").contains("volume")).alias("with_volume"))
