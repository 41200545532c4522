"""Feeds of any shape: records and schemas of XML and JSON documents of any depth, found by Spark over many files."""

from __future__ import annotations

import json
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Leaves that name a device (fixed values), and texts that mean yes.
ID_NAMES = ("device_id", "detector_id", "station_id", "cctv_id", "id")
YES = ("y", "yes", "true", "1", "valid", "online")


def _tag(name: str) -> str:
    return name.rsplit("}", 1)[-1].strip().lower()


def _nodes(document: str | bytes | None) -> tuple | None:
    """A document as nested (name, value, children), children None for a leaf; None where it is neither XML nor JSON."""

    def of_xml(e) -> tuple:
        children = [of_xml(c) for c in e]
        return _tag(e.tag), (e.text or "").strip(), children or None

    def of_json(name: str, value) -> tuple:
        if isinstance(value, dict):
            return name, "", [of_json(_tag(k), v) for k, v in value.items()]
        if isinstance(value, list):
            return name, "", [of_json("item", v) for v in value]
        return name, "" if value is None else value if isinstance(value, str) else json.dumps(value), None

    text = document.decode("utf-8-sig", "replace") if isinstance(document, bytes) else document
    if text is None or not text.strip():
        return None
    try:
        return of_json("root", json.loads(text)) if text.lstrip()[0] in "{[" else of_xml(ElementTree.fromstring(text if isinstance(document, str) else document))
    except (ValueError, ElementTree.ParseError):
        return None


def _records(node: tuple, out: list[dict[str, str]]) -> dict[str, str]:
    """Leaves below a node by name, the last of equal names; nodes with an id among them are added to out."""
    leaves: dict[str, str] = {}
    for name, value, children in node[2] or ():
        if children is None:
            if value:
                leaves[name] = value
        else:
            leaves.update(_records((name, value, children), out))
    if any(n in leaves for n in ID_NAMES):
        out.append(leaves)
    return leaves


def feed_records(documents: DataFrame, source: str, content: str) -> DataFrame:
    """(source, parsed, leaves map<string,string>): distinct records of each source's documents, text or bytes.

    A record is any node that has an id among the leaves below it. Documents that cannot be parsed give a row without leaves.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, document in zip(batch["source"], batch["content"]):
                node = _nodes(bytes(document) if isinstance(document, bytearray | memoryview) else document)
                found: list[dict[str, str]] = []
                if node is not None:
                    _records(node, found)
                rows.append((name, node is not None, None))
                rows += [(name, True, leaves) for leaves in found]
            yield pd.DataFrame(rows, columns=["source", "parsed", "leaves"])

    kind = documents.schema[source].dataType.simpleString()
    opened = documents.select(F.col(source).alias("source"), F.col(content).alias("content")).mapInPandas(run, f"source {kind}, parsed boolean, leaves map<string,string>")
    # Maps cannot be compared, their sorted entries can.
    return opened.withColumn("_key", F.to_json(F.array_sort(F.map_entries("leaves")))).dropDuplicates(["source", "parsed", "_key"]).drop("_key")


def feed_profile(documents: DataFrame, source: str, content: str) -> DataFrame:
    """Per source: documents parsed, distinct records and devices, records with a volume, with a validity and valid, first and last time."""
    found = feed_records(documents, source, content)
    entries = F.map_entries(F.coalesce("leaves", F.create_map().cast("map<string,string>")))
    device = F.coalesce(*[F.try_element_at("leaves", F.lit(n)) for n in ID_NAMES])
    volume = F.exists(entries, lambda e: (F.contains(e["key"], F.lit("vol")) | F.contains(e["key"], F.lit("flow"))) & e["value"].rlike(r"\d"))
    validity = F.filter(entries, lambda e: F.contains(e["key"], F.lit("valid")))
    times = F.transform(F.filter(entries, lambda e: F.contains(e["key"], F.lit("time")) | F.contains(e["key"], F.lit("date"))), lambda e: F.try_to_timestamp(e["value"]))
    marked = found.select(
        "source", "parsed", F.col("leaves").isNotNull().alias("record"), device.alias("device"), volume.alias("volume"), (F.size(validity) > 0).alias("has_validity"),
        F.exists(validity, lambda e: F.lower(F.trim(e["value"])).isin(*YES)).alias("valid"), F.array_min(times).alias("first"), F.array_max(times).alias("last"),
    )
    return marked.groupBy("source").agg(
        F.max((F.col("parsed") & ~F.col("record")).cast("int")).cast("boolean").alias("parsed"), F.count_if("record").alias("records"), F.count_distinct("device").alias("devices"),
        F.count_if("volume").alias("with_volume"), F.count_if("has_validity").alias("with_validity"), F.count_if("valid").alias("valid"), F.min("first").alias("first_time"), F.max("last").alias("last_time"),
    )


#: Keys that tell how many versions an archive has, and how large a member is (fixed values).
TOTAL_KEYS = ("total", "total_count", "totalcount", "record_count", "version_count", "total_versions")
SIZE_KEYS = ("size", "file_size", "compressed_size", "filesize")


def _values(node: tuple) -> Iterator[tuple[str, str]]:
    name, value, children = node
    if children is None:
        yield name, value
    for child in children or ():
        yield from _values(child)


def document_values(documents: DataFrame, source: str, content: str) -> DataFrame:
    """(source, key, value): every leaf of XML and JSON documents of any depth, its key in lower case with single underscores."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, document in zip(batch["source"], batch["content"]):
                node = _nodes(bytes(document) if isinstance(document, bytearray | memoryview) else document)
                rows += [(name, *pair) for pair in _values(node)] if node is not None else []
            yield pd.DataFrame(rows, columns=["source", "key", "value"])

    kind = documents.schema[source].dataType.simpleString()
    found = documents.select(F.col(source).alias("source"), F.col(content).alias("content")).mapInPandas(run, f"source {kind}, key string, value string")
    return found.withColumn("key", F.btrim(F.regexp_replace(F.lower("key"), "[^a-z0-9]+", "_"), F.lit("_")))


def archive_listing(documents: DataFrame, source: str, content: str) -> DataFrame:
    """Per source, from listings of any shape: distinct timestamps (YYYYMMDD-HHMM, hyphen optional) with the first and last, the largest
    total of versions, distinct zip members, and the sum of all sizes in GB (null where none is told)."""
    stamp = F.explode_outer(F.regexp_extract_all("value", F.lit(r"((?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])[0-3][0-9]-?[0-2][0-9][0-5][0-9])(?![0-9])"), F.lit(1)))
    values = document_values(documents, source, content)
    total = F.when(F.col("key").isin(*TOTAL_KEYS), F.col("value").try_cast("bigint"))
    size = F.when(F.col("key").isin(*SIZE_KEYS), F.col("value").try_cast("double"))
    member = F.when(F.lower("value").contains(".zip"), F.col("value"))
    rows = values.select("source", F.when(total >= 0, total).alias("total"), F.when(size > 0, size).alias("size"), member.alias("member"), "value")
    sums = rows.groupBy("source").agg(F.max("total").alias("versions"), F.count_distinct("member").alias("zips"), (F.sum("size") / 1e9).alias("total_gb"))
    stamps = rows.select("source", stamp.alias("t")).withColumn("t", F.regexp_replace("t", "^([0-9]{8})-?", "$1-"))
    times = stamps.groupBy("source").agg(F.count_distinct("t").alias("timestamps"), F.min("t").alias("first_timestamp"), F.max("t").alias("last_timestamp"))
    return sums.join(times, "source")


def _paths(node: tuple, above: str, out: dict[tuple[str, str], int]) -> None:
    name, value, children = node
    path = f"{above}/{name}"
    kind = "node" if children is not None else "empty" if not value else "number" if value.replace(".", "", 1).lstrip("-").isdigit() else "text"
    out[path, kind] = out.get((path, kind), 0) + 1
    for child in children or ():
        _paths(child, path, out)


def schema_paths(documents: DataFrame, file: str, content: str) -> DataFrame:
    """(file, path, kind, n): every path of a document with the kind of its values and how often it is there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, document in zip(batch["file"], batch["content"]):
                found: dict[tuple[str, str], int] = {}
                node = _nodes(bytes(document) if isinstance(document, bytearray | memoryview) else document)
                if node is not None:
                    _paths(node, "", found)
                rows += [(name, path, kind, n) for (path, kind), n in found.items()]
            yield pd.DataFrame(rows, columns=["file", "path", "kind", "n"])

    return documents.select(F.col(file).cast("string").alias("file"), F.col(content).alias("content")).mapInPandas(run, "file string, path string, kind string, n long")


def schema_fingerprint(paths: DataFrame, group: Column | None = None) -> DataFrame:
    """(group, path, kinds, files, n): the schema of a group of files, from rows that can be reduced in any order."""
    return paths.groupBy((F.lit("all") if group is None else group).alias("group"), "path").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.count_distinct("file").alias("files"), F.sum("n").alias("n"))


def schema_drift(paths: DataFrame, group: Column | None = None) -> DataFrame:
    """(group, file, path, drift): a path that all other files of its group have and this one lacks (missing), that no other one has (extra), or
    whose kinds differ from those of most other files (kind; empty values differ from none). Groups of one file do not drift."""
    g = F.lit("all") if group is None else group
    per_file = paths.where("kind <> 'empty'").select(g.alias("group"), "file", "path", "kind").unionByName(paths.where("kind = 'empty'").select(g.alias("group"), "file", "path", F.lit(None).cast("string").alias("kind")))
    kinds = per_file.groupBy("group", "file", "path").agg(F.concat_ws("|", F.array_sort(F.collect_set("kind"))).alias("kinds"))
    files = per_file.select("group", "file").distinct()
    total = files.groupBy("group").agg(F.count(F.lit(1)).alias("n_files")).where("n_files > 1")
    known = kinds.groupBy("group", "path").agg(F.count(F.lit(1)).alias("have"), F.mode(F.when(F.col("kinds") != "", F.col("kinds"))).alias("usual")).join(total, "group")
    extra = kinds.join(known.where("have = 1"), ["group", "path"]).select("group", "file", "path", F.lit("extra").alias("drift"))
    # Lacking files of a path that all others have: at most one, so the pairs are as many as such paths.
    lacking = known.where("have = n_files - 1 AND n_files > 2 OR have = 1 AND n_files = 2").join(files, "group").join(kinds.select("group", "file", "path"), ["group", "file", "path"], "left_anti")
    missing = lacking.select("group", "file", "path", F.lit("missing").alias("drift"))
    other = kinds.join(known.where("have > 2"), ["group", "path"]).where("kinds <> '' AND kinds <> usual").select("group", "file", "path", F.lit("kind").alias("drift"))
    return extra.unionByName(missing).unionByName(other)


def snapshot_audit(lanes: DataFrame, file: str) -> DataFrame:
    """Per snapshot file of lane rows (period, detector_id, valid, volume, speed): periods, detectors, records, valid share, volume, median speed."""
    ok = F.coalesce(F.col("valid") == "Y", F.lit(False))
    return lanes.groupBy(file).agg(
        F.count_distinct("period").alias("periods"), F.count_distinct("detector_id").alias("detectors"), F.count_distinct("period", "detector_id").alias("detector_periods"),
        F.count(F.lit(1)).alias("lanes"), F.avg(ok.cast("double")).alias("valid_share"), F.sum(F.when(ok, F.col("volume"))).alias("volume"), F.median(F.when(ok, F.col("speed"))).alias("median_speed"),
    )


def section_lengths(lines: DataFrame, start: str, end: str, regions: dict[str, str], document: str = "document") -> DataFrame:
    """(document, region, road_network, length, derivation) from the lines (document, line_no, text) of one section of each document.

    The section runs from the first line that matches start to the next that matches end. A region begins at the first line
    of the section that matches its pattern (later headers of it, as on a next page, change nothing) and ends where another
    one begins. Its major length is the first ``Sub-total`` behind a line with ``Major`` and before one with ``Minor``, its
    total the first ``Total Covered by Census``; a number may stand on the next line that is not blank. The minor length is
    the difference. Regions without both numbers give no row.
    """
    w = Window.partitionBy(document).orderBy("line_no")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    text = F.coalesce("text", F.lit(""))
    some = lines.where(F.trim(text) != "").select(document, "line_no", text.alias("text"))
    opens = F.min(F.when(F.col("text").rlike(f"(?i){start}"), F.col("line_no"))).over(Window.partitionBy(document))
    inside = some.withColumn("_open", opens).where("line_no >= _open")
    closes = F.min(F.when(F.col("text").rlike(f"(?i){end}") & (F.col("line_no") > F.col("_open")), F.col("line_no"))).over(Window.partitionBy(document))
    inside = inside.withColumn("_close", closes).where("_close IS NULL OR line_no < _close")
    named = F.lit(None).cast("string")
    for name, pattern in reversed(regions.items()):
        named = F.when(F.col("text").rlike(f"(?i){pattern}"), F.lit(name)).otherwise(named)
    marked = inside.withColumn("_named", named)
    first = F.min("line_no").over(Window.partitionBy(document, "_named")) == F.col("line_no")
    marked = marked.withColumn("_begin", F.when(F.col("_named").isNotNull() & first, F.col("_named")))
    marked = marked.withColumn("region", F.last("_begin", ignorenulls=True).over(upto)).withColumn("_next", F.lead("text").over(w)).where("region IS NOT NULL")
    part = F.when(F.col("text").rlike("(?i)minor"), "minor").when(F.col("text").rlike("(?i)major"), "major")
    inner = Window.partitionBy(document, "region").orderBy("line_no")
    marked = marked.withColumn("_part", F.last(part, ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    number = r"([0-9]+(?:\.[0-9]+)?)"

    def value(label: str) -> Column:
        here = F.regexp_extract("text", rf"(?i){label}\s*{number}", 1)
        behind = F.regexp_extract("_next", rf"^\s*{number}", 1)
        found = F.when(here != "", here).when(F.col("text").rlike(rf"(?i){label}\s*$"), behind)
        return F.when(found != "", found.cast("double"))

    earliest = lambda v: F.min_by(v, F.when(v.isNotNull(), F.col("line_no")))
    of = marked.withColumn("_sub", F.when(F.col("_part") == "major", value("Sub-total"))).withColumn("_total", value("Total Covered by Census"))
    both = of.groupBy(document, "region").agg(earliest(F.col("_sub")).alias("major"), earliest(F.col("_total")).alias("total")).where("major IS NOT NULL AND total IS NOT NULL")
    row = lambda network, length, how: F.struct(F.lit(network).alias("road_network"), F.round(length, 4).alias("length"), F.lit(how).alias("derivation"))
    rows = F.array(row("major", F.col("major"), "published_subtotal"), row("minor", F.col("total") - F.col("major"), "total_minus_major"), row("subtotal", F.col("total"), "published_total"))
    return both.select(document, "region", F.explode(rows).alias("x")).select(document, "region", "x.*")
