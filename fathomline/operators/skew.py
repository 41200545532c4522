"""A join whose hot keys need no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of all rows is hot; there are fewer than SHARE of them.
SHARE = 64


def join_counted(rows: DataFrame, per_key: DataFrame, key: str, count: str, total: int, cold_hint: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """rows, left-joined with one row per key that tells how many rows the key has.

    Fewer than SHARE keys can hold more than a SHARE-th of all rows each, so those go to every task by a broadcast of
    that proven size; rows of all other keys are shuffled, and rows with a null key are not moved at all.
    per_key is read three times: write it first. ``cold_hint`` may keep Spark from a broadcast of the other keys.
    """
    hot = per_key.where(F.col(count) * SHARE > total)
    cold = per_key.where(F.col(count) * SHARE <= total)
    held = rows.join(F.broadcast(hot), key)
    rest = rows.where(F.col(key).isNotNull()).join(F.broadcast(hot.select(key)), key, "left_anti").join(cold_hint(cold), key, "left")
    alone = rows.where(F.col(key).isNull())
    return held.unionByName(rest).unionByName(alone, allowMissingColumns=True)
