"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: sources in code-point order (null last) have repeating weights and share all words
by them; a target stops at ``most_repeats`` times its source's words, and the excess is
shared anew among the others until none is above.

A source's documents, in the order of a keyed hash, are a stream of words that is read as
often as the target asks, the last time in part. The stream is cut every ``block_words``
words, so a source has an exact quota of blocks. Quotas are split among output shards from
the root of a binary tree: the left half of a node's shards draws as many blocks as it has
room for, how many of each source is a multivariate-hypergeometric draw, the rest goes right.
A source's blocks are permuted (a keyed affine map modulo their number) and consecutive runs
of the permuted blocks go to the shards, so runs are disjoint and shards hold exactly their
quotas. ``in_order`` shuffles blocks, and documents inside them, within a shard.

Sources are dealt to at most ``groups`` groups, whose quotas are what the driver holds; up to
that number of sources each one is a group. Beyond it, sources of a group lie side by side in
the group's blocks and keep exact quotas of their own. Blocks grow with the input so that
there are at most 2 ** 28 of them. Places in the streams come from a range sort by (source,
hash) and one sum per partition, so a hot source is spread over tasks. Targets are found by
repeated sums over the table of sources, a row each.

Defined results: a null or wordless text has size 0 and is never taken; a null source is a
source of its own, the last; rows of one id are separate documents; a very long document is
cut at block borders and at the end of the stream; sizes and results do not depend on how
files are split (rows of one id, source and size may change places); extra columns are not
returned, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import gcd

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.words import words_of
from fathomline.operators.skew import join_counted
from fathomline.session import materialize


@dataclass(frozen=True)
class MixParams:
    weights: tuple[int, ...] = (5, 2, 1)
    most_repeats: int = 3
    shards: int = 16
    block_words: int = 4096
    groups: int = 4096
    seed: int = 29


#: More blocks than this are not made: they are longer instead.
MOST_BLOCKS = 1 << 28


def running(df: DataFrame, order: list[str], amounts: dict[str, str]) -> DataFrame:
    """df with, for each (column, amount), the sum of the amount over all earlier rows in the order of the whole table.

    Rows are sorted by ranges; the driver gets one row of sums per partition.
    """
    placed = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "running")
    upto, begins = [0] * len(amounts), []
    for r in placed.groupBy("_part").agg(*[F.sum(a).alias(a) for a in amounts.values()]).orderBy("_part").collect():
        begins.append((r["_part"], *upto))
        upto = [at + (r[a] or 0) for at, a in zip(upto, amounts.values())]
    offsets = df.sparkSession.createDataFrame(begins, "_part int, " + ", ".join(f"_{c} long" for c in amounts))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    step = placed.withColumns({c: F.coalesce(F.sum(a).over(within), F.lit(0)) for c, a in amounts.items()})
    # As many rows as the range sort had partitions.
    return step.join(F.broadcast(offsets), "_part").withColumns({c: F.col(c) + F.col(f"_{c}") for c in amounts}).drop("_part", *[f"_{c}" for c in amounts])


def level(sources: DataFrame, total: int, params: MixParams) -> float:
    """The number of words per unit of weight with which all targets add up to total."""
    cap = F.col("source_size") * params.most_repeats
    at, stopped = -1.0, -1
    while True:
        above = (F.lit(at) * F.col("weight") > cap) if at >= 0 else F.lit(False)
        r = sources.agg(F.count_if(above).alias("n"), F.sum(F.when(above, cap)).alias("held"), F.sum(F.when(~above, F.col("weight"))).alias("open")).first()
        if r["n"] == stopped or not r["open"]:
            return at
        at, stopped = (total - (r["held"] or 0)) / r["open"], r["n"]


def with_targets(sources: DataFrame, total: int, params: MixParams) -> DataFrame:
    """sources (place from 0, source_size, ...) with weight, target and quota, the target in whole words."""
    weighed = sources.withColumn("weight", F.get(F.array(*[F.lit(w) for w in params.weights]), F.pmod("place", F.lit(len(params.weights))).cast("int")))
    cap = F.col("source_size") * params.most_repeats
    target = F.least(cap.cast("double"), F.lit(level(weighed, total, params)) * F.col("weight"))
    return weighed.withColumn("target", target).withColumn("quota", F.least(F.round("target").cast("long"), cap))


def split_quotas(quotas: list[int], shards: int, seed: int) -> list[list[int]]:
    """Blocks of each group in each shard (shards x groups): exact row and column sums, shards at most one block apart."""
    total = sum(quotas)
    room = [total * (k + 1) // shards - total * k // shards for k in range(shards)]
    out: list[list[int]] = [[]] * shards

    def descend(low: int, high: int, held: np.ndarray) -> None:
        if high - low == 1:
            out[low] = held.tolist()
            return
        middle = (low + high) // 2
        draw = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(held, sum(room[low:middle]), method="marginals")
        descend(low, middle, draw)
        descend(middle, high, held - draw)

    descend(0, shards, np.array(quotas, dtype=np.int64))
    return out


def _plan(groups: list[tuple[int, int]], params: MixParams) -> list[tuple[int, int, int, int, list[int]]]:
    """(group, blocks, factor, shift, first permuted block of each shard and the end) of each group."""
    split = np.array(split_quotas([q for _, q in groups], params.shards, params.seed), dtype=np.int64).reshape(params.shards, -1)
    out = []
    for i, (group, blocks) in enumerate(groups):
        rng = np.random.default_rng([params.seed, 1, group])
        factor, shift = (int(x) for x in rng.integers(1, max(blocks, 2), 2))
        while gcd(factor, blocks) > 1:
            factor += 1
        out.append((group, blocks, factor % max(blocks, 1), shift, [0, *np.cumsum(split[:, i]).tolist()]))
    return out


def _pieces(block_words: Column, params: MixParams) -> Column:
    """array<struct(shard, block, repeat, start, length)> of a document whose words begin at ``begin`` of its source's stream."""

    def of_repeat(c: Column) -> Column:
        at = c * F.col("source_size") + F.col("begin")
        end = F.least(at + F.col("size"), F.col("quota"))

        def of_block(j: Column) -> Column:
            low, high = F.greatest(at, j * block_words), F.least(end, (j + 1) * block_words)
            block = F.col("first_block") + j
            place = F.pmod(block * F.col("factor") + F.col("shift"), F.col("blocks"))
            shard = F.size(F.filter("ends", lambda e: e <= place)) - 1
            return F.struct(shard.alias("shard"), block.alias("block"), c.cast("int").alias("repeat"), (low - at).alias("start"), (high - low).alias("length"))

        whole = lambda x: F.floor(x / block_words).cast("long")
        return F.when(end > at, F.transform(F.sequence(whole(at), whole(end - 1)), of_block)).otherwise(F.array().cast("array<struct<shard:int,block:bigint,repeat:int,start:bigint,length:bigint>>"))

    return F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(params.most_repeats - 1).cast("long")), of_repeat))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", params: MixParams = MixParams()) -> DataFrame:
    """(key, source, size, source_size, target, group, pieces) of every document.

    pieces tell what the mix takes of it: array<struct(shard, block, repeat, start, length)>, in words.
    """
    # Null sorts behind all strings.
    name = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("t"))
    size = F.size(words_of(F.coalesce(F.col(text), F.lit("")))).cast("long")
    tie = F.conv(F.substring(F.md5(F.concat(F.lit(f"{params.seed}|"), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    rows = docs.select(F.col(key).alias("id"), F.col(source).alias("source"), name.alias("name"), size.alias("size"), tie.alias("tie"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "mix")
    held = rows.groupBy("name").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")).withColumn("one", F.lit(1))
    sources = materialize(running(held, ["name"], {"place": "one"}), "sources")
    sums = sources.agg(F.sum("source_size").alias("words"), F.sum("rows").alias("rows")).first()
    total, n_rows = sums["words"] or 0, sums["rows"] or 0
    block_words = max(params.block_words, -(-total // (MOST_BLOCKS - params.groups)))
    aimed = with_targets(sources, total, params).withColumn("own_blocks", F.ceil(F.col("quota") / block_words).cast("long")).withColumn("group", F.pmod("place", F.lit(params.groups)).cast("int"))
    before = Window.partitionBy("group").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    aimed = materialize(aimed.withColumn("first_block", F.coalesce(F.sum("own_blocks").over(before), F.lit(0))), "sources")
    groups = sorted((r["group"], r["n"]) for r in aimed.groupBy("group").agg(F.sum("own_blocks").alias("n")).collect())
    plan = docs.sparkSession.createDataFrame(_plan(groups, params), "group int, blocks long, factor long, shift long, ends array<long>")
    stats = aimed.join(F.broadcast(plan), "group").select("name", "source_size", "rows", "place", "target", "quota", "group", "first_block", "blocks", "factor", "shift", "ends")
    stats = materialize(stats, "sources")
    placed = running(rows, ["name", "tie", "size", "row"], {"at": "size"})
    first = materialize(running(sources.select("name", "source_size"), ["name"], {"stream": "source_size"}).select("name", "stream"), "sources")
    known = materialize(stats.join(first, "name"), "sources")
    met = join_counted(materialize(placed, "mix"), known, "name", "rows", n_rows)
    taken = met.withColumn("begin", F.col("at") - F.col("stream")).withColumn("pieces", _pieces(F.lit(block_words), params))
    return taken.select(F.col("id").alias(key), F.col("source").alias(source), "size", "source_size", "target", "group", "pieces")


def taken_words(pieces: str = "pieces") -> Column:
    return F.aggregate(F.transform(pieces, lambda p: p["length"]), F.lit(0).cast("long"), lambda acc, n: acc + n)


def in_order(mixed: DataFrame, key: str = "doc_id", params: MixParams = MixParams()) -> DataFrame:
    """One row per piece (key, group, shard, block, repeat, start, length), shards one after another, each shuffled.

    Blocks of a shard stand in the order of a keyed hash, documents of a block too, so neighbours come from all sources.
    """
    opened = mixed.select(key, "group", F.explode("pieces").alias("p")).select(key, "group", "p.*")
    hashed = opened.withColumn("_b", F.xxhash64(F.lit(params.seed), "group", "block")).withColumn("_d", F.xxhash64(F.lit(params.seed), F.col(key).cast("string"), "repeat", "block"))
    keys = ["shard", "_b", "_d", "start"]
    return hashed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_b", "_d")
