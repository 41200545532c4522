"""Connected components by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from fathomline.operators.skew import SHARE, join_counted
from fathomline.session import discard, materialize

#: Labels of graphs with at most so many nodes are sent to every task. Larger graphs are joined by sorting: their tables
#: compress so well that Spark would take them for small ones and build them on the driver for a broadcast.
BROADCAST_NODES = 1 << 18


def components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge.

    Each round takes the smallest label among a node and its neighbours, then the
    label's own label. Labels are reduced per node in the map tasks, so a hub costs one
    row per task. Labels of small graphs are sent to every task; in others a label is looked
    up once for all nodes that carry it, and the labels of large components are sent to
    every task, so that these are not gathered in one. Rounds
    grow with the logarithm of a component's diameter. Lineage is cut by a table in the
    shared folder after every round. Edges with a null end are ignored; self-loops make
    their node known.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    both = materialize(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    total = labels.count()
    small = total <= BROADCAST_NODES
    sorted_ = F.broadcast if small else (lambda df: df.hint("merge"))
    for _ in range(max_rounds):
        near = both.join(sorted_(labels), both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(sorted_(near), labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        largest = 0 if small else labels.groupBy("label").count().agg(F.max("count")).first()[0] or 0
        carried = None
        if largest * SHARE > total:
            hooked = materialize(hooked, "hooked")
            carried = hooked.groupBy("label").agg(F.count(F.lit(1)).alias("carriers"))
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("upper"))
        if carried is None:  # all labels are sent, or none has a large share of the nodes
            met = hooked.join(sorted_(up), "label", "left")
        else:
            carried = materialize(carried.join(sorted_(up), "label"), "carried")
            met = join_counted(hooked, carried, "label", "carriers", total, sorted_)
        seen = Observation()
        moved = met.select("node", "old", F.least("label", F.coalesce("upper", "label")).alias("label"))
        after = materialize(moved.observe(seen, F.count_if(F.col("old") != F.col("label")).alias("changed")), "labels")
        changed = seen.get["changed"]  # counted by the write itself, without a job of its own
        for held in (labels, hooked, carried):
            discard(held)
        labels = after
        if not changed:
            discard(both)
            found = labels.select("node", F.col("label").alias("component"))
            found.fathomline_path = labels.fathomline_path  # for callers that discard it
            return found
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
