"""URL filters by host-suffix and path-prefix expressions.

A URL is expanded into the expressions that some rule could equal: the host's last labels
joined with the path's first characters, for the (labels, characters) shapes in a table
made from the rules. Expressions meet rules in an equi-join on the first four bytes of a
SHA-256 digest; the full digest is then confirmed and the longest rule wins (equal
lengths: the longer host, then the rule's text).

Each distinct (host, path) is expanded once, so a URL that a third of all pages share
costs as much as any other, and only pairs that some rule fits go back to the pages, in a
left join that Spark turns into a broadcast where the measured result is small.

The table of shapes is bounded by the longest host and path of a rule, not by the number
of rules; more than MAX_SHAPES raise ValueError. Rules are a DataFrame (host, path,
verdict). Spark broadcasts them only while they are under
spark.sql.autoBroadcastJoinThreshold; beyond it the join shuffles and adaptive execution
splits hot digest prefixes.

Defined results: a null URL or one without ``://`` has empty host and path and takes
the default verdict; very long URLs are taken whole. Repeated pages are judged separately
and alike. Extra columns of pages are not returned, whatever their names. Empty pages or
empty rules give an empty or an all-default result. Rules with a null host or path never
match; of equal rules the one with the larger verdict counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Digest characters (hex) of the join key: four bytes.
PREFIX_HEX = 8
MAX_SHAPES = 20_000


def _host(url: Column) -> Column:
    """A-Z alone are lower-cased."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(key, host, path, rule, verdict, n_fitting), one row for each row of pages."""
    listed = rules.where("host IS NOT NULL AND path IS NOT NULL").select(
        F.concat("host", "path").alias("_rule"),
        F.col("verdict").alias("_verdict"),
        F.length("host").alias("_host_len"),
        F.size(F.split("host", r"\.")).alias("_labels"),
        F.length("path").alias("_chars"),
        _digest(F.col("host"), F.col("path")).alias("_full"),
    )
    shapes: dict[int, list[int]] = {}
    for r in listed.select("_labels", "_chars").distinct().limit(MAX_SHAPES + 1).collect():
        shapes.setdefault(r[0], []).append(r[1])
    if sum(map(len, shapes.values())) > MAX_SHAPES:
        raise ValueError(f"rules have more than {MAX_SHAPES} shapes")
    base = pages.select(F.col(key).alias("_key"), _host(F.col(url)).alias("host"), _path(F.col(url)).alias("path"))
    listed = listed.select("_rule", "_verdict", "_host_len", "_full", F.substring("_full", 1, PREFIX_HEX).alias("_short"))
    # One entry per number of labels in a rule: the lengths of paths beside it.
    by_labels = F.array(*[F.struct(F.lit(n).alias("labels"), F.array(*[F.lit(c) for c in sorted(shapes[n])]).alias("chars")) for n in sorted(shapes)])
    pairs = base.select("host", "path").distinct()
    if not shapes:
        best = pairs.where("false").select("host", "path", F.lit("").alias("_rule"), F.lit("").alias("_verdict"), F.lit(0).cast("long").alias("n_fitting"))
    else:
        fitting = F.filter(by_labels, lambda x: x["labels"] <= F.size(F.split("host", r"\.")))
        opened = pairs.select("host", "path", F.explode(fitting).alias("x")).select("host", "path", "x.labels", F.explode(F.filter("x.chars", lambda c: c <= F.length("path"))).alias("chars"))
        # substring_index takes no column for its count, so the last labels are joined again.
        labels = F.split("host", r"\.")
        tail = F.array_join(F.slice(labels, F.size(labels) - F.col("labels") + 1, F.col("labels")), ".")
        opened = opened.withColumn("_digest", _digest(tail, F.substring(F.col("path"), F.lit(1), F.col("chars")))).withColumn("_prefix", F.substring("_digest", 1, PREFIX_HEX))
        met = opened.join(listed, F.col("_prefix") == F.col("_short")).where(F.col("_digest") == F.col("_full"))
        top = F.max(F.struct(F.length("_rule").alias("n"), "_host_len", "_rule", "_verdict")).alias("_best")
        best = met.groupBy("host", "path").agg(top, F.count(F.lit(1)).alias("n_fitting")).select("host", "path", "_best._rule", "_best._verdict", "n_fitting")
    return base.join(best, ["host", "path"], "left").select(
        F.col("_key").alias(key),
        "host",
        "path",
        F.col("_rule").alias("rule"),
        F.coalesce("_verdict", F.lit(default)).alias("verdict"),
        F.coalesce("n_fitting", F.lit(0)).alias("n_fitting"),
    )
