"""Language identification by rank-order profiles (out-of-place distance).

A profile is the list of a text's most frequent n-grams (one to ``max_n`` letters of
lower-cased words, padded by a border sign), most frequent first, ties by code. A
language's profile comes from its training documents; a document gets the language
whose profile is nearest: for each of its n-grams the difference of the ranks, or
``size`` where the profile lacks it.

Fitting reads a sample of about ``fit_rows`` distinct texts of each language, chosen by a
hash of the text, so a rare language keeps all of them and copies count once; counts are reduced per
(language, n-gram) before anything reaches the driver, which receives at most ``size``
n-grams of each language. Prediction is a map over whole texts: no shuffle, no hot key.

Defined results: a null text, or one without a letter, is ``und`` with score 0, and so
is everything when no language was learned. Equal distances: the language that sorts
first. Repeated rows are predicted alike; very long texts are taken whole, a few MB or one
text at a time. An empty table gives no profiles, and predictions on one are empty. Extra
columns pass through; a column named lang_pred or score raises ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.llm.words import letter_runs
from fathomline.llm.worker import bounded_batches, slices, worker_cache


@dataclass(frozen=True)
class LangParams:
    size: int = 400
    max_n: int = 3
    fit_rows: int = 2000


def grams(text: str | None, max_n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram codes (21 bits a sign) and their counts; a single border sign is no n-gram."""
    words = letter_runs().findall((text or "").lower())
    if not words:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    signs = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    parts, code = [signs[signs != 32]], signs
    for n in range(2, max_n + 1):
        code = (code[:-1] << 21) | signs[n - 1 :]
        # Borders stand at the ends of an n-gram only.
        inner = np.ones(len(code), dtype=bool)
        for i in range(1, n - 1):
            inner &= signs[i : i + len(code)] != 32
        parts.append(code[inner])
    return np.unique(np.concatenate(parts), return_counts=True)


def top(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Codes by falling count, ties by code; codes come sorted."""
    if len(codes) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    """Ranks of all profiles over the union of their n-grams."""

    def __init__(self, ranked: dict[str, list[int]], size: int):
        self.langs, self.size = sorted(ranked), size
        self.union = np.array(sorted({g for gs in ranked.values() for g in gs}), dtype=np.int64)
        self.ranks = np.full((len(self.langs), len(self.union) + 1), -1, dtype=np.int64)
        for row, lang in enumerate(self.langs):
            self.ranks[row, np.searchsorted(self.union, np.array(ranked[lang], dtype=np.int64))] = np.arange(len(ranked[lang]))

    def predict(self, text: str | None, max_n: int) -> tuple[str, float]:
        codes, counts = grams(text, max_n)
        if not len(codes) or not self.langs:
            return "und", 0.0
        own = top(codes, counts, self.size)
        at = np.minimum(np.searchsorted(self.union, own), len(self.union) - 1)
        ranks = np.where(self.union[at] == own, self.ranks[:, at], -1)
        away = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own)))).sum(axis=1)
        best = int(np.argmin(away))
        return self.langs[best], float(1.0 - away[best] / (self.size * len(own)))


def fit(train: DataFrame, text: str = "text", lang: str = "lang", params: LangParams = LangParams()) -> dict[str, list[int]]:
    """Ranked n-gram codes of each language, from about fit_rows of its distinct texts."""
    known = train.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    mark = F.xxhash64(F.lit(3), F.col("text"))
    # Copies go in or out together, so distinct texts are counted, by hash, and a drawn text is read once.
    share = known.select("lang", mark.alias("mark")).distinct().groupBy("lang").agg((F.lit(float(params.fit_rows)) / F.count(F.lit(1))).alias("share"))
    drawn = F.pmod(mark, F.lit(1 << 20)) < F.col("share") * (1 << 20)
    sample = known.join(F.broadcast(share), "lang").where(drawn).select("lang", "text").distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Counts are added up per language before they leave the task.
        worker_cache("langid")
        for batch in slices(batches, 1):
            held: dict[str, list] = {}
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(name, []).append(grams(body, params.max_n))
            for name, parts in held.items():
                codes, inverse = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                counts = np.bincount(inverse, weights=np.concatenate([n for _, n in parts]), minlength=len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], ["lang", "gram", "n"])

    counted = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    ranked: dict[str, list[int]] = {}
    for row in counted.withColumn("place", place).where(F.col("place") <= params.size).orderBy("lang", "place").collect():
        ranked.setdefault(row["lang"], []).append(row["gram"])
    return ranked


def predict(docs: DataFrame, ranked: dict[str, list[int]], text: str = "text", params: LangParams = LangParams()) -> DataFrame:
    """docs with lang_pred and score."""
    if clash := {"lang_pred", "score"} & set(docs.columns):
        raise ValueError(f"columns would be overwritten: {sorted(clash)}")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(ranked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("langid")
        profiles = Profiles(sent.value, params.size)
        for batch in slices(batches, text):
            found = [profiles.predict(t, params.max_n) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield batch.append_column("lang_pred", pa.array([f[0] for f in found], pa.string())).append_column("score", pa.array([f[1] for f in found], pa.float64()))

    return docs.mapInArrow(run, schema)


def held_out(key: str, mod: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(mod)) == remainder
