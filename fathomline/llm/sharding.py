"""Sharding by balanced label propagation.

Documents start in shards by hash. In each round every link (documents that share a
link value) counts its documents per shard; documents elsewhere wish to move to the
link's fullest shard (ties by hash); the matrix of wishes (shards x shards numbers, the only thing
the driver sees) gives quotas that keep loads near equal; a keyed hash below
quota / wishes decides who moves. Afterwards all documents are ordered by shard, with
unlinked ones on both sides of each shard's linked ones, and the order is cut into
shards of equal rows (law ``rows``: counts at most one apart), so that a cut rarely
falls inside a link.

Joins run on the link value after counts per (link, shard) were reduced in the map
tasks. Links with more than a 64th of all rows are fewer than 64 and sent to every task,
so their rows are not gathered; the final range sort splits them too (ties by a hash of
the row). A link larger than a shard is
spread over several. Rows in flight are small: no text is shuffled.

Defined results: a null link value links nothing; null and empty texts have size 1, and
empty ones are linked; very long texts are only hashed; repeated rows are separate
documents; equal wishes of a link go to the shard with the larger hash; extra columns are
not returned, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.operators.skew import join_counted
from fathomline.session import discard, materialize


@dataclass(frozen=True)
class ShardParams:
    shards: int = 16
    rounds: int = 5
    slack: float = 0.25
    seed: int = 23


def _quotas(wishes: dict[tuple[int, int], int], loads: list[int], slack: float) -> dict[tuple[int, int], int]:
    """Moves allowed from i to j: swaps first, then what room below (1 + slack) x the mean load admits."""
    n = len(loads)
    room = [max(0, int((1 + slack) * sum(loads) / n) - x) for x in loads]
    allowed: dict[tuple[int, int], int] = {}
    for (i, j), x in sorted(wishes.items()):
        allowed[i, j] = min(x, wishes.get((j, i), 0))
    for (i, j), x in sorted(wishes.items(), key=lambda w: (-w[1], w[0])):
        more = min(x - allowed[i, j], room[j])
        allowed[i, j] += more
        room[j] -= more
        room[i] += more
    return allowed


def propagate(rows: DataFrame, params: ShardParams = ShardParams()) -> DataFrame:
    """rows (link, tie, ...) with a shard after label propagation; link may be null.

    ``tie`` is any stable hash of the row.
    """
    k = params.shards
    rows = materialize(rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(params.seed), "tie"), F.lit(k)).cast("int")), "shard")
    for turn in range(params.rounds):
        counted = rows.where(F.col("link").isNotNull()).groupBy("link", "shard").agg(F.count(F.lit(1)).alias("n"))
        best = materialize(
            counted.groupBy("link")
            .agg(F.max_by("shard", F.struct("n", F.xxhash64("link", "shard"))).alias("want"), F.sum("n").alias("members"))
            .where("members > 1"),
            "best",
        )
        loads = [0] * k
        for r in rows.groupBy("shard").count().collect():
            loads[r["shard"]] = r["count"]
        met = join_counted(rows, best, "link", "members", sum(loads)).withColumn("want", F.coalesce("want", "shard"))
        wishes = {(r["shard"], r["want"]): r["count"] for r in met.where("want <> shard").groupBy("shard", "want").count().collect()}
        if not wishes:
            break
        allowed = _quotas(wishes, loads, params.slack)
        share = F.lit(0.0)
        for pair, x in wishes.items():
            share = F.when((F.col("shard") == pair[0]) & (F.col("want") == pair[1]), F.lit(allowed[pair] / x)).otherwise(share)
        # Members of a small link draw one number, so they move together; those of a large one draw their own.
        whole = F.xxhash64(F.lit(turn), "link", "shard")
        own = F.xxhash64(F.lit(turn), "link", "tie")
        drawn = F.pmod(F.when(F.col("members") * k * 4 > sum(loads), own).otherwise(whole), F.lit(1 << 30)) / F.lit(float(1 << 30))
        moved = met.withColumn("shard", F.when((F.col("want") != F.col("shard")) & (drawn < share), F.col("want")).otherwise(F.col("shard")))
        after = materialize(moved.select(*rows.columns), "shard")
        discard(rows)
        discard(best)
        rows = after
    return rows


def cut_edges(rows: DataFrame, link: str = "link", shard: str = "shard") -> DataFrame:
    """Links cut, as pairs between neighbours in a link's order of shards: shards per link minus one; and links whole."""
    spread = rows.where(F.col(link).isNotNull()).groupBy(link, shard).count().groupBy(link).agg(F.count(F.lit(1)).alias("parts"), F.sum("count").alias("members"))
    return spread.where("members > 1").agg(
        F.count(F.lit(1)).alias("links"), F.count_if(F.col("parts") > 1).alias("cut_links"), F.coalesce(F.sum(F.col("parts") - 1), F.lit(0)).alias("cuts")
    )


def balance(rows: DataFrame, params: ShardParams = ShardParams()) -> DataFrame:
    """Equal rows: order by shard, cut the order every n / shards rows, number the rows of each shard from 0."""
    k, total = params.shards, rows.count()
    sizes = materialize(rows.where(F.col("link").isNotNull()).groupBy("link").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "sizes")
    side = F.when(F.col("members") > 1, F.lit(1)).otherwise(F.when(F.pmod("tie", F.lit(2)) == 0, F.lit(0)).otherwise(F.lit(2)))
    ordered = join_counted(rows, sizes, "link", "members", total).withColumn("side", side)
    keys = ["shard", "side", "link", "tie"]
    placed = materialize(ordered.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "shard")
    at, begins = 0, []
    for r in placed.groupBy("part").count().orderBy("part").collect():
        begins.append((r["part"], at))
        at += r["count"]
    offsets = rows.sparkSession.createDataFrame(begins, "part int, begin long")
    within = F.row_number().over(Window.partitionBy("part").orderBy(*keys)) - 1
    position = placed.withColumn("within", within).join(offsets, "part").withColumn("position", F.col("begin") + F.col("within"))
    shard = F.expr(f"CAST((position * {k}) DIV {max(at, 1)} AS INT)")
    first = F.expr(f"(final * CAST({at} AS BIGINT) + {k - 1}) DIV {k}")
    return position.withColumn("final", shard).withColumn("slot", F.col("position") - first).drop("shard").withColumnRenamed("final", "shard")


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", params: ShardParams = ShardParams()) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for links between equal texts."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).cast("long").alias("text_crc32"),
        # Two 64-bit hashes with unlike seeds stand for the text.
        F.when(F.col(text).isNotNull(), F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"))).alias("link"),
    ).withColumn("tie", F.xxhash64(F.lit(11), "id", "link.a"))
    done = balance(propagate(rows, params), params)
    return done.select(
        F.col("id").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
