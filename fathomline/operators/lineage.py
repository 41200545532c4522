"""Lineage of features, read from the analysed plan of a frame, beside how much of each is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _each(scala) -> list:
    return [scala.apply(i) for i in range(scala.size())]


def _ids(expression) -> list[int]:
    refs = expression.references().toSeq()
    return [a.exprId().id() for a in _each(refs)]


def sources(df: DataFrame) -> dict[str, list[str]]:
    """For each column the table columns that its value is made of (``table.column``, sorted).

    Keys of groups, joins and conditions of filters decide which rows there are, not a value, and are not counted. Columns
    that a Python function or a generator makes come from all that goes into it.
    """
    plan = df._jdf.queryExecution().analyzed()
    made: dict[int, set[int]] = {}
    base: dict[int, str] = {}

    def walk(node) -> None:
        for child in _each(node.children()):
            walk(child)
        name = node.getClass().getSimpleName()
        if name == "LogicalRelation":
            roots = _each(node.relation().location().rootPaths())
            table = roots[0].getName().rsplit(".", 1)[0] if roots else "?"
            for a in _each(node.output()):
                base[a.exprId().id()] = f"{table}.{a.name()}"
            return
        if name == "Union":
            for i, a in enumerate(_each(node.output())):
                made.setdefault(a.exprId().id(), set()).update(c.output().apply(i).exprId().id() for c in _each(node.children()))
            return
        below = {a.exprId().id() for c in _each(node.children()) for a in _each(c.output())}
        for e in _each(node.expressions()):
            if e.getClass().getSimpleName() == "Alias":
                made.setdefault(e.exprId().id(), set()).update(_ids(e.child()))
        generator = _ids(node.generator()) if name == "Generate" else None
        for a in _each(node.output()):
            number = a.exprId().id()
            if number not in below and number not in made and number not in base and below:
                made[number] = set(generator) if generator is not None else set(below)

    walk(plan)

    def origin(number: int, seen: frozenset[int] = frozenset()) -> set[str]:
        if number in base:
            return {base[number]}
        return set().union(*(origin(n, seen | {number}) for n in made.get(number, ()) if n not in seen)) if made.get(number) else set()

    return {a.name(): sorted(origin(a.exprId().id())) for a in _each(plan.output())}


def manifest(df: DataFrame, roles: dict[str, tuple[str, bool]]) -> DataFrame:
    """(feature, sources, role, allowed, available_count, total_count, available_share) of the features in roles: feature -> (role, allowed).

    A feature that the frame does not have is listed with no sources and nothing available.
    """
    found = sources(df)
    have = [f for f in roles if f in df.columns]
    counts = [F.count(F.col(f)).alias(f"_n{i}") for i, f in enumerate(have)]
    row = df.agg(F.count(F.lit(1)).alias("_total"), *counts)
    each = []
    for f, (role, allowed) in roles.items():
        n = F.col(f"_n{have.index(f)}") if f in have else F.lit(0).cast("long")
        each.append(F.struct(F.lit(f).alias("feature"), F.lit(", ".join(found.get(f, []))).alias("sources"), F.lit(role).alias("role"), F.lit(allowed).alias("allowed"), n.alias("available_count"), F.col("_total").alias("total_count")))
    flat = row.select(F.explode(F.array(*each)).alias("x")).select("x.*")
    return flat.withColumn("available_share", F.try_divide("available_count", "total_count"))
