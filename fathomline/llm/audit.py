"""Filter interaction audit by the multilinear extension.

Every document gets one mask of the filters that it fails. Documents are counted per part
and mask, so a part is at most 2 ** n rows whatever its size, and its removal polynomial is

    f(x) = sum over masks m of n_m * (1 - product of (1 - x_i) for i in m)

for filters that are switched on with degrees x between 0 and 1. Its integer coefficients
come from sums over supersets. Corners (every x 0 or 1) are the documents that a set of
filters removes, hence survivors and losses of any order at any step. A filter's Shapley
share is the integral of its partial derivative along the diagonal, in exact rationals;
times n! it is the number of documents that the filter removes, summed over all orders.

One pass over texts makes masks; a repeat is found by the smallest id of equal texts, which
are reduced per 128-bit hash in the map tasks and met again by (hash, id), so that neither
a large group of copies nor a hot part is gathered anywhere.

Defined results: a null text is empty (it fails A alone, and E where a smaller id has an
empty text); a null part is the empty string; a null id has no smaller id and is none, and
has no labels; several rows of one id and text are no repeats of each other; several labels
of an id count as 1 if any is 1; very long texts are read whole; extra columns are not
returned, whatever their names; an empty table gives no parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import cache
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.words import words_of
from fathomline.session import materialize

#: Letters of the filters, in the order of their bits.
FILTERS = "ABCDE"


class RemovalPolynomial:
    """f above, as integer coefficients of the products of x over the filters of each set."""

    def __init__(self, counts: dict[int, int], filters: int):
        self.filters = filters
        self.documents = sum(counts.values())
        at_least = [counts.get(m, 0) for m in range(1 << filters)]
        for i in range(filters):
            for m in range(1 << filters):
                if not m >> i & 1:
                    at_least[m] += at_least[m | 1 << i]
        self.coefficients = [0, *((at_least[s] if s.bit_count() % 2 else -at_least[s]) for s in range(1, 1 << filters))]

    def corners(self) -> list[int]:
        """f at every corner: what each set of filters removes."""
        out = list(self.coefficients)
        for i in range(self.filters):
            for s in range(1 << self.filters):
                if s >> i & 1:
                    out[s] += out[s ^ 1 << i]
        return out

    def derivative(self, i: int) -> list[int]:
        """df/dx_i on the diagonal, as coefficients of rising powers."""
        out = [0] * self.filters
        for s, c in enumerate(self.coefficients):
            if s >> i & 1:
                out[s.bit_count() - 1] += c
        return out

    def shapley(self, i: int) -> Fraction:
        """The integral of derivative(i) from 0 to 1."""
        return sum((Fraction(c, power + 1) for power, c in enumerate(self.derivative(i))), Fraction(0))


@cache
def _orders(letters: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All orders, and for each step of each the set of filters before it and its filter's place."""
    orders = list(permutations(range(len(letters))))
    filters = np.array(orders, dtype=np.int64)
    upto = np.cumsum(1 << filters, axis=1)
    return ["".join(letters[i] for i in o) for o in orders], upto - (1 << filters), filters


COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _steps(masks: list[dict], letters: str) -> dict[str, np.ndarray]:
    """COLUMNS for every step of every order of one part, from its (mask, n, good, toxic) rows."""
    n = len(letters)
    polynomial, good, toxic = (RemovalPolynomial({r["mask"]: r[c] for r in masks}, n) for c in ("n", "good", "toxic"))
    _, before, filters = _orders(letters)
    after = before | 1 << filters
    corners = [np.array(p.corners(), dtype=np.int64) for p in (polynomial, good, toxic)]
    failing = corners[0][1 << np.arange(n)]
    alone = corners[0][-1] - corners[0][(1 << n) - 1 - (1 << np.arange(n))]
    scaled = np.array([int(factorial(n) * polynomial.shapley(i)) for i in range(n)], dtype=np.int64)
    removed, good_lost, toxic_lost = (c[after] - c[before] for c in corners)
    kept = polynomial.documents - corners[0][after]
    return dict(zip(COLUMNS, (kept, removed, failing[filters] - removed, alone[filters], good_lost, toxic_lost, scaled[filters])))


def interactions(counts: DataFrame, letters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, filter, and COLUMNS) from counts (part, mask, n, good, toxic), a row per part and mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, _, filters = _orders(letters)
        n = len(letters)
        names = pa.array([o for o in orders for _ in range(n)])
        steps = pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders)))
        own = pa.array([letters[i] for i in filters.ravel()])
        for batch in batches:
            for part, masks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = _steps(masks, letters)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(names), pa.string()), names, steps, own, *(pa.array(found[c].ravel()) for c in COLUMNS)],
                    ["part", "filter_order", "step", "filter", *COLUMNS],
                )

    per_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    return per_part.mapInArrow(run, "part string, filter_order string, step int, filter string, " + ", ".join(f"{c} long" for c in COLUMNS))


def text_failures(body: Column) -> dict[str, Column]:
    """Filters on a text alone; the words must stand in a column ``_words`` beside it."""
    n, distinct = F.size("_words"), F.size(F.array_distinct("_words"))
    capitals = F.length(F.regexp_replace(body, "[^A-Z]+", ""))
    return {
        "A": n < 200,
        "B": 100 * distinct < 50 * n,
        "C": 100 * capitals > 2 * F.length(body),
        "D": body.rlike(r"[#$%&*|]"),
    }


def with_masks(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, good, toxic) of each document."""
    step = docs.select(F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    step = step.withColumn("_words", words_of(F.col("body")))
    fails = text_failures(F.col("body"))
    mask = F.lit(0)
    for bit, letter in enumerate(FILTERS):
        if letter in fails:
            mask = mask.bitwiseOR(F.when(fails[letter], F.lit(1 << bit)).otherwise(F.lit(0)))
    rows = step.select("id", "part", mask.alias("mask"), F.xxhash64("body").alias("a"), F.xxhash64(F.lit(7), "body").alias("b"))
    # Rows without an id meet no label; the salt keeps them from one task.
    salt = F.when(F.col("id").isNull(), F.col("a")).otherwise(F.lit(0))
    marked = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = materialize(rows.withColumn("salt", salt).join(marked.withColumn("salt", F.lit(0).cast("long")), ["id", "salt"], "left").drop("salt"), "audit")
    firsts = rows.where("id IS NOT NULL").groupBy("a", "b").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    repeat = F.col("id").isNotNull() & F.col("first").isNull()
    bit = F.when(repeat, F.lit(1 << FILTERS.index("E"))).otherwise(F.lit(0))
    return rows.join(firsts, ["a", "b", "id"], "left").select("part", F.col("mask").bitwiseOR(bit).alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """What each filter does at each step of each order, per part."""
    counts = with_masks(docs, labels, key, text, part).groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    return interactions(counts)
