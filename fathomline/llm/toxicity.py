"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of toxic text and one on
ordinary text. A window is a lower-cased word between spaces, repeated so that whole
bytes tell windows apart. Its two compressed lengths, with its own length, fall into a
cell; cells are calibrated on labelled texts (log ratio of toxic to ordinary windows),
and a document's score is a logistic function of how many of its windows pass
calibrated thresholds, absolutely and per hundred windows.

Most words of a toxic text are ordinary. So the toxic dictionary is trained only on
windows that begin like (3 to 8 letters) or equal words that toxic documents have far
more often than ordinary ones.

Windows of several words and a toxic dictionary of whole toxic texts were measured too;
they miss most toxic documents (figures in the README), so they are not used.

Fitting reads a bounded sample: at most about ``toxic_rows`` and ``ordinary_rows`` labelled
rows by a hash of the id, of each a stretch of ``fit_chars`` characters from a place given
by the same hash (most texts are shorter and used whole), and for the dictionaries about
every n-th run of words beyond ``ordinary_windows`` on either side. Scoring is a map over
whole texts with a broadcast model of fixed size: no shuffle and no hot key; a task holds
a few MB of text at a time, and one very long text whole.

Defined results: an empty, null or wordless text gets the score of no windows; without
toxic or ordinary labels, as on empty tables, every score is 0. Duplicate labels of an id:
toxic if any is. Repeated rows score alike; an empty table gives an empty one. Extra columns
pass through; a column named score raises ValueError.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.llm.words import letter_runs
from fathomline.llm.worker import bounded_batches, give_back, slices, worker_cache


@dataclass(frozen=True)
class ToxicParams:
    toxic_rows: int = 1500
    ordinary_rows: int = 4500
    fit_chars: int = 60_000
    repeat: int = 4
    level: int = 16
    toxic_dictionary: int = 16 << 10
    ordinary_dictionary: int = 110 << 10
    ordinary_windows: int = 200_000
    min_share: float = 0.008
    min_lift: float = 30.0
    stems: tuple[int, ...] = (3, 4, 5, 6, 7, 8)
    thresholds: tuple[float, ...] = (1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0)
    ridge: float = 0.5
    cache_words: int = 300_000
    group_words: int = 150_000


def windows(text: str | None) -> list[str]:
    return letter_runs().findall((text or "").lower())


def _marks(word: str, params: ToxicParams) -> list[str]:
    return [*(word[:k] for k in params.stems if len(word) >= k), word + "$"]


def _trained(size: int, samples: list[bytes]):
    """A trained dictionary; plain content where the samples are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-size:] or b"none", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Lengths:
    """Cell of a word: its length, the difference of its compressed lengths, and the toxic one."""

    def __init__(self, toxic: bytes, ordinary: bytes, params: ToxicParams):
        import zstandard

        self.repeat, made = params.repeat, []
        for raw in (toxic, ordinary):
            held = zstandard.ZstdCompressionDict(raw)
            held.precompute_compress(level=params.level)
            made.append(zstandard.ZstdCompressor(level=params.level, dict_data=held, write_content_size=False, write_dict_id=False).compress)
        self.toxic, self.ordinary = made

    def cell(self, word: str) -> int:
        window = f" {word} ".encode()
        many = window * self.repeat
        toxic, ordinary = len(self.toxic(many)), len(self.ordinary(many))
        return (min(len(window), 20) * 64 + max(-8, min(ordinary - toxic, 15)) + 8) * 64 + min(toxic, 63)


@dataclass(frozen=True)
class ToxicModel:
    toxic: bytes
    ordinary: bytes
    cells: dict[int, float]
    mean: tuple[float, ...]
    spread: tuple[float, ...]
    weights: tuple[float, ...]


def _features(values: np.ndarray, params: ToxicParams) -> list[float]:
    """From the weights of a document's windows."""
    n = max(len(values), 1)
    values = values[values > 1.0]  # the lowest threshold
    over = [int((values > t).sum()) for t in params.thresholds]
    top = max(float(values.max()), 0.0) if len(values) else 0.0
    strong, weak = float(values[values > 1.5].sum()), float(values[values > 1.0].sum())
    return [*np.log1p(over), np.log1p(n), *np.log1p(np.array(over) * 100 / n), top, np.log1p(strong), weak / n * 100]


def fit_texts(toxic: list[str], ordinary: list[str], params: ToxicParams = ToxicParams()) -> ToxicModel | None:
    """Both dictionaries, the cells and the logistic weights, from labelled texts."""
    if not toxic or not ordinary:
        return None
    one: dict[str, str] = {}  # each word once, however often it stands in the texts
    bags = [[[one.setdefault(w, w) for w in windows(t)] for t in texts] for texts in (toxic, ordinary)]
    seen = [Counter(m for bag in side for m in {m for w in set(bag) for m in _marks(w, params)}) for side in bags]
    least = max(4, params.min_share * len(toxic))
    marks = {m for m, c in seen[0].items() if c >= least and c / len(toxic) > params.min_lift * (seen[1][m] + 0.5) / len(ordinary)}
    if not marks:  # too few labels for the rule above: take what toxic texts alone have
        marks = {m for m, c in seen[0].items() if c >= 2 and not seen[1][m]}
    grouped = []
    for words in ([w for bag in bags[0] for w in bag if marks.intersection(_marks(w, params))], [w for bag in bags[1] for w in bag]):
        step = max(1, len(words) // params.ordinary_windows)
        words = words[::step]
        grouped.append([" ".join(["", *words[i : i + 8], ""]).encode() for i in range(0, len(words), 8)])
    raw = [_trained(size, samples or [b" "]).as_bytes() for size, samples in zip((params.toxic_dictionary, params.ordinary_dictionary), grouped)]
    lengths, known = Lengths(*raw, params), {}
    for side in bags:
        for bag in side:
            for w in bag:
                if w not in known:
                    known[w] = lengths.cell(w)
    counts = [Counter(known[w] for bag in side for w in bag) for side in bags]
    totals = [max(1, sum(c.values())) for c in counts]
    cells = {c: float(np.log((counts[0][c] + 0.3) / totals[0] / ((counts[1][c] + 1) / totals[1]))) for c in counts[0].keys() | counts[1].keys()}
    x = np.array([_features(np.array([cells[known[w]] for w in bag]), params) for side in bags for bag in side])
    y = np.array([1.0] * len(toxic) + [0.0] * len(ordinary))
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.concatenate([np.ones((len(x), 1)), (x - mean) / spread], axis=1)
    w, penalty = np.zeros(z.shape[1]), np.r_[0.0, np.full(x.shape[1], params.ridge)]
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return ToxicModel(*raw, cells, tuple(mean), tuple(spread), tuple(w))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic", params: ToxicParams = ToxicParams()) -> ToxicModel | None:
    """Fit on a bounded sample of the labelled rows; texts come to the driver sorted by id hash."""
    marked = labels.where(F.col(key).isNotNull() & F.col(toxic).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.max(F.col(toxic).cast("int")).alias("_toxic"))
    found = {r["_toxic"]: r["count"] for r in marked.groupBy("_toxic").count().collect()}
    bound = {1: params.toxic_rows, 0: params.ordinary_rows}
    draw = F.pmod(F.xxhash64(F.lit(5), F.col("_id").cast("string")), F.lit(1 << 30))
    chosen = F.lit(False)
    for label, rows in bound.items():
        chosen |= (F.col("_toxic") == label) & (draw < int(min(1.0, rows / max(1, found.get(label, 0))) * (1 << 30)))
    drawn = marked.where(chosen)
    # Bounded by the two row parameters, so a broadcast is safe.
    body = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).where("_text IS NOT NULL")
    begin = F.pmod(F.xxhash64(F.lit(6), F.col("_id").cast("string")), F.greatest(F.length("_text") - params.fit_chars, F.lit(0)) + 1) + 1
    rows = body.join(F.broadcast(drawn), "_id").withColumn("_text", F.substring("_text", begin.cast("int"), F.lit(params.fit_chars)))
    texts = sorted((r["_toxic"], r["_id"], r["_text"]) for r in rows.collect())
    model = fit_texts([t for label, _, t in texts if label == 1], [t for label, _, t in texts if label == 0], params)
    del texts
    give_back()
    return model


class Scorer:
    def __init__(self, model: ToxicModel, params: ToxicParams):
        self.model, self.params = model, params
        self.lengths, self.known = Lengths(model.toxic, model.ordinary, params), {}
        self.mean, self.spread, self.weights = map(np.array, (model.mean, model.spread, model.weights))

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Scores of texts, taken in groups: a group's own words stay in the processor's cache."""
        rows: list[list[float]] = []
        at = 0
        while at < len(texts):
            group, n = [], 0
            while at < len(texts) and n < self.params.group_words:
                group.append(windows(texts[at]))
                n += len(group[-1])
                at += 1
            local = self._weights(dict.fromkeys(chain.from_iterable(group)))
            rows += [_features(np.fromiter(map(local.__getitem__, words), dtype=np.float64, count=len(words)), self.params) for words in group]
        if not rows:
            return np.zeros(0)
        z = (np.array(rows) - self.mean) / self.spread
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + z @ self.weights[1:], -30, 30)))

    def _weights(self, words: dict) -> dict[str, float]:
        if len(self.known) + len(words) > self.params.cache_words:
            self.known.clear()
        known, cells = self.known, self.model.cells
        for w in words:
            weight = known.get(w)
            if weight is None:
                weight = known[w] = cells.get(self.lengths.cell(w), 0.0)
            words[w] = weight
        return words


def score(docs: DataFrame, model: ToxicModel | None, text: str = "text", params: ToxicParams = ToxicParams()) -> DataFrame:
    """docs with score."""
    if "score" in docs.columns:
        raise ValueError("column score would be overwritten")
    if model is None:
        return docs.withColumn("score", F.lit(0.0))
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, plain = worker_cache("toxicity"), sent.value
        name = ("toxic", hash((plain["toxic"], plain["ordinary"], plain["weights"])))
        if name not in cache:
            for old in [k for k in cache if isinstance(k, tuple) and k[0] == "toxic"]:
                del cache[old]
            cache[name] = Scorer(ToxicModel(**plain), params)
        for batch in slices(batches, text):
            found = cache[name].score(batch.column(batch.schema.get_field_index(text)).to_pylist())
            yield batch.append_column("score", pa.array(found, pa.float64()))

    return docs.mapInArrow(run, schema)
