"""Panels: joins across periods, frozen metadata, runs, funnels, upserts, snapshot differences."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def consecutive(df: DataFrame, key: list[str], period: str, values: list[str], step: int = 1) -> DataFrame:
    """Self-join on period = previous + step; columns get _previous and _current. A gap gives no pair."""
    now = df.select(*key, period, *[F.col(v).alias(f"{v}_current") for v in values])
    before = df.select(*key, (F.col(period) + step).alias(period), *[F.col(v).alias(f"{v}_previous") for v in values])
    return now.join(before, [*key, period])


def period_pairs(df: DataFrame, key: list[str], period: str, values: list[str], pairs: list[tuple[int, int]]) -> DataFrame:
    """Rows of both periods for each chosen pair; the pair table has as many rows as pairs and is broadcast."""
    table = df.sparkSession.createDataFrame(pairs, f"{period}_from int, {period}_to int")
    a = df.select(*key, F.col(period).alias(f"{period}_from"), *[F.col(v).alias(f"{v}_from") for v in values])
    b = df.select(*key, F.col(period).alias(f"{period}_to"), *[F.col(v).alias(f"{v}_to") for v in values])
    return a.join(F.broadcast(table), f"{period}_from").join(b, [*key, f"{period}_to"])


def presence(df: DataFrame, key: str, period: str, periods: list[int], value: str) -> DataFrame:
    """One row per key: value and present flag for each period (a pivot over fixed periods)."""
    cols: list[Column] = []
    for p in periods:
        at = F.when(F.col(period) == p, F.col(value))
        cols += [F.max(at).alias(f"{value}_{p}"), (F.count_if(F.col(period) == p) > 0).alias(f"present_{p}")]
    return df.where(F.col(period).isin(periods)).groupBy(key).agg(*cols)


def one_side_only(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys in one table only, with presence flags."""
    left = a.select(key).distinct().withColumn("in_left", F.lit(True))
    right = b.select(key).distinct().withColumn("in_right", F.lit(True))
    both = left.join(right, key, "full").na.fill(False, ["in_left", "in_right"])
    return both.where("in_left <> in_right")


def with_indicator(left: DataFrame, right: DataFrame, keys: list[str], name: str = "matched") -> DataFrame:
    marked = right.withColumn(name, F.lit(True))
    return left.join(marked, keys, "left").na.fill(False, [name])


def first_non_null(df: DataFrame, key: list[str], order: str, columns: list[str]) -> DataFrame:
    """Freeze each column at its first non-null value; columns may come from different rows."""
    return df.groupBy(*key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The whole row that comes first in the given order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def longest_run(df: DataFrame, key: list[str], period: str) -> DataFrame:
    """Longest run of consecutive periods per key (gaps and islands)."""
    distinct = df.select(*key, period).distinct()
    island = F.col(period) - F.row_number().over(Window.partitionBy(*key).orderBy(period))
    runs = distinct.withColumn("_island", island).groupBy(*key, "_island").agg(F.count(F.lit(1)).alias("n"), F.min(period).alias("first"))
    return runs.groupBy(*key).agg(F.max("n").alias("longest_run"), F.max_by("first", F.struct("n", -F.col("first"))).alias("run_start"))


def funnel(df: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """Attrition: rows that pass all stages up to each one, retention from the previous stage and the start."""
    passed, sums = F.lit(True), []
    for i, (name, condition) in enumerate(stages):
        passed = passed & F.coalesce(condition, F.lit(False))
        sums.append(F.struct(F.lit(i).alias("stage_order"), F.lit(name).alias("stage"), F.count_if(passed).alias("n")))
    rows = df.agg(F.array(*sums).alias("s")).select(F.inline("s"))
    w = Window.orderBy("stage_order")  # as many rows as stages
    share = lambda base: F.try_divide(F.col("n").cast("double"), base)
    return rows.withColumn("from_previous", share(F.lag("n").over(w))).withColumn("from_start", share(F.first("n").over(w)))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of old whose key is not in new, then new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def snapshot_difference(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field, n_changed) among common keys, with counts of keys on one side."""
    left = a.select(F.col(key), *[F.col(f).alias(f"a_{f}") for f in fields], F.lit(1).alias("_a"))
    right = b.select(F.col(key), *[F.col(f).alias(f"b_{f}") for f in fields], F.lit(1).alias("_b"))
    both = left.join(right, key, "full")
    common = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    sums = [F.count_if(common & ~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}"))).alias(f) for f in fields]
    counted = both.agg(*sums, F.count_if(F.col("_b").isNull()).alias("only_left"), F.count_if(F.col("_a").isNull()).alias("only_right"))
    return counted.unpivot([], [*fields, "only_left", "only_right"], "field", "n_changed")


def changed_any(pairs: list[tuple[str, str]]) -> Column:
    """Any of the column pairs differs, null counting as ''."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return reduce(lambda x, y: x | y, [blank(a) != blank(b) for a, b in pairs])


def fallback_lookup(rows: DataFrame, train: DataFrame, levels: list[list[str]], value: str, out: str, stat=F.median) -> DataFrame:
    """Most specific cell of the training part first, then coarser ones, then the global statistic.

    One broadcastable table per level; a null statistic falls through. Null keys match no cell.
    """
    tries: list[Column] = []
    for i, level in enumerate(levels):
        name = f"_level{i}"
        cells = train.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in level])).groupBy(*level).agg(stat(value).alias(name))
        rows = rows.join(cells, level, "left")
        tries.append(F.col(name))
    whole = train.agg(stat(value).alias("_global"))
    rows = rows.crossJoin(F.broadcast(whole))  # one row
    source = F.coalesce(*[F.when(t.isNotNull(), F.lit(i)) for i, t in enumerate(tries)], F.lit(len(levels)))
    rows = rows.withColumn(out, F.coalesce(*tries, F.col("_global"))).withColumn(f"{out}_level", source)
    return rows.drop("_global", *[f"_level{i}" for i in range(len(levels))])


def closest(rows: DataFrame, key: list[str], at: Column, target: Column, tolerance: float) -> DataFrame:
    """The row nearest its target per key (ties: the earlier one); beyond the tolerance there is none."""
    offset = F.abs(at - target)
    near = rows.withColumn("_offset", offset).withColumn("_at", at).where(F.col("_offset") <= tolerance)
    w = Window.partitionBy(*key).orderBy("_offset", "_at")
    return near.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", "_at").withColumnRenamed("_offset", "offset")


def carry_forward(df: DataFrame, partition: list[str], order: list[str], column: str) -> DataFrame:
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def stratified_sample(df: DataFrame, strata: list[str], key: str, per_stratum: int, seed: int = 42) -> DataFrame:
    """A frozen sample without replacement: the rows with the smallest hash of key and seed in each stratum."""
    w = Window.partitionBy(*strata).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= per_stratum).drop("_rank")


def numbered(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Every row with its place from 1 in the order of the whole table, without a task that holds all rows.

    Rows are sorted by ranges; a row's place is its place in its partition after the rows of earlier partitions,
    of which the driver gets one number per partition.
    """
    from fathomline.session import materialize

    # The id has the partition in its upper 31 bits and counts from 0 in the lower 33.
    rows = materialize(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumn("_part", F.shiftright("_id", 33))
    at, begins = 0, []
    for r in rows.groupBy("_part").count().orderBy("_part").collect():
        begins.append((r["_part"], at - (r["_part"] << 33) + 1))
        at += r["count"]
    offsets = df.sparkSession.createDataFrame(begins, "_part long, _begin long")
    return rows.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_id") + F.col("_begin")).drop("_part", "_id", "_begin")


def mutual_best(pairs: DataFrame, left: str, right: str, order: list[Column], tail: int = 20_000) -> DataFrame:
    """Greedy one-to-one assignment: equal to taking pairs one by one from the best, ties by left, then right.

    A round takes every pair that is best for both of its sides, and whole blocks of ties: where all rows of some
    sides are equally good and each left meets each right, they are paired by rank. The best pair of all is always
    taken, so rounds go on until no pair is left; a rest of at most ``tail`` rows (a chain may need a round a pair)
    is walked in order by one task. Lineage is cut every round. Pairs without a side are ignored.
    """
    from fathomline.session import discard, materialize

    ends = F.col(left).isNotNull() & F.col(right).isNotNull()
    rest = materialize(pairs.where(ends).withColumn("_order", F.struct(*order)).withColumn("_place", F.struct("_order", F.col(left), F.col(right))), "assign")
    kept = []
    while (n := rest.count()) > tail:
        best = materialize(_best_of_both(rest, left, right), "assign")
        if best.isEmpty():
            raise RuntimeError(f"assignment cannot settle {n} pairs: their order is not comparable")
        kept.append(best)
        after = materialize(rest.join(best.select(left), left, "left_anti").join(best.select(right), right, "left_anti"), "assign")
        discard(rest)
        rest = after
    if n:
        kept.append(materialize(rest.coalesce(1).sortWithinPartitions("_place").mapInArrow(_walk(left, right), rest.schema), "assign"))
    if not kept:
        return rest.drop("_order", "_place")
    discard(rest)
    # One scan of all rounds: a chain of unions would grow with their number.
    return rest.sparkSession.read.schema(kept[0].schema).parquet(*[k.fathomline_path for k in kept]).select(pairs.columns)


def _best_of_both(rest: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs that greedy takes whatever else happens: best for both sides, or of the same rank in a block of ties."""

    def side(own: str, other: str, name: str) -> DataFrame:
        # The best order of a row, how many share it, and the first of them.
        per = rest.groupBy(own, "_order").agg(F.count(F.lit(1)).alias("n"), F.min(other).alias("first"))
        return per.groupBy(own).agg(F.min(F.struct("_order", "n", "first")).alias(name))

    tied = rest.join(side(left, right, "_a"), left).join(side(right, left, "_b"), right).where("_order = _a._order AND _order = _b._order")
    mutual = F.col(right).eqNullSafe(F.col("_a.first")) & F.col(left).eqNullSafe(F.col("_b.first"))
    # Rows of a block share the order and both firsts; it is closed and complete if every row has as many ties as the block has rows opposite.
    key = {"_o": F.col("_order"), "_l": F.col("_b.first"), "_r": F.col("_a.first")}
    tied = tied.withColumns(key | {"_mutual": mutual, "_na": F.col("_a.n"), "_nb": F.col("_b.n")}).drop("_a", "_b")
    blocks = tied.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n"), F.count_distinct(left).alias("_lefts"), F.count_distinct(right).alias("_rights"),
        F.min("_na").alias("_na0"), F.max("_na").alias("_na1"), F.min("_nb").alias("_nb0"), F.max("_nb").alias("_nb1"),
    )
    blocks = blocks.where("_n > 1 AND _n = _lefts * _rights AND _na0 = _rights AND _na1 = _rights AND _nb0 = _lefts AND _nb1 = _lefts").select(*key)
    whole = tied.join(blocks, list(key))
    rank = lambda c, out: whole.select(*key, c).distinct().withColumn(out, F.row_number().over(Window.partitionBy(*key).orderBy(c)))
    ranked = whole.join(rank(left, "_i"), [*key, left]).join(rank(right, "_j"), [*key, right]).where("_i = _j")
    alone = tied.where("_mutual").join(blocks, list(key), "left_anti")
    return ranked.select(rest.columns).unionByName(alone.select(rest.columns).dropDuplicates([left]))  # a pair given twice is taken once


def _walk(left: str, right: str) -> Callable:
    """Takes each row whose two sides are free, in the order in which rows come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used: tuple[set, set] = set(), set()
        for batch in batches:
            take = []
            for i, (a, b) in enumerate(zip(batch.column(left).to_pylist(), batch.column(right).to_pylist())):
                if a not in used[0] and b not in used[1]:
                    used[0].add(a), used[1].add(b), take.append(i)
            yield batch.take(pa.array(take, pa.int64()))

    return run
