"""Contracts: columns, keys, cardinality, leakage. Checks return rows; ``require`` turns them into errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """An input contract does not hold."""


def required_columns(df: DataFrame, names: list[str]) -> list[str]:
    """Missing columns, on the schema alone."""
    return [n for n in names if n not in df.columns]


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def require(df: DataFrame, columns: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """df itself if it has the columns and its keys are unique."""
    if missing := required_columns(df, columns or []):
        raise ContractError(f"missing columns: {missing}")
    if keys and (found := duplicate_keys(df, keys).limit(10).collect()):
        raise ContractError(f"keys {keys} are not unique: {[tuple(r)[: len(keys)] for r in found]}")
    return df


def join_checked(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", cardinality: str = "many_to_one") -> DataFrame:
    """Equi-join after a uniqueness check of the sides that the cardinality names."""
    if cardinality not in ("one_to_one", "many_to_one", "one_to_many"):
        raise ValueError(cardinality)
    if cardinality.endswith("to_one"):
        require(right, keys=keys)
    if cardinality.startswith("one_to"):
        require(left, keys=keys)
    return left.join(right, keys, how)


def key_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, with the side."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("right")))


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Equal as multisets; row order is not compared."""
    right = right.select(*left.columns)
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_null), one scan."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counted.unpivot([], columns, "column_name", "n_null")


def split_groups(df: DataFrame, member: str, fold: str) -> DataFrame:
    """Members that occur in more than one fold (leakage)."""
    return df.groupBy(member).agg(F.count_distinct(fold).alias("n_folds")).where("n_folds > 1")


def within(a: Column, b: Column, tolerance: float) -> Column:
    """Both null, or apart by at most the tolerance."""
    return (a.isNull() & b.isNull()) | F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))
