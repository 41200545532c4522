"""Benchmark decontamination with one FM-index per training shard.

A shard is a run of whole documents (about ``shard_bytes`` of text). Its words become
symbols of the test vocabulary; every stretch of words outside that vocabulary is one
separator, since no test phrase can contain it, and so are document ends. The shard
gets a suffix order, its Burrows-Wheeler transform in a wavelet matrix with sampled
rank counts, and suffix positions sampled every ``sample`` symbols. All test phrases
are searched backwards at once; rows found are located by walking the LF mapping to a
sampled position; occurrences become word spans, merged per document.

Shards are built from whatever rows a task reads, so there is no shuffle, no hot key
and nothing gathered: beside Spark's own Arrow batch, memory is bounded by a multiple of
``shard_bytes`` (or of one longer document) and by ``block_phrases``. Phrases beyond that
bound are searched in further passes over the documents, each with a broadcast of bounded
size, and their spans are merged.

Words are maximal runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z.
Defined results: a null or wordless text has no words and no spans; items without
words match nothing; items with fewer than ``window`` words are one phrase; repeated
rows each get their result; equal items each count; items without an id are searched like
others, stand as one null in the list of items and add nothing to its text. Very long
texts are a shard of their own; an empty table gives an empty one, an empty benchmark no
spans. Extra columns pass through, and a clash with RESULT's columns raises ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.llm.worker import bounded_batches, slices, worker_cache


@dataclass(frozen=True)
class DecontaminateParams:
    window: int = 10
    shard_bytes: int = 4 << 20
    sample: int = 8
    block_phrases: int = 200_000


RESULT = (("n_words", "long"), ("spans", "array<struct<start:int,end:int>>"), ("items", "array<string>"))

#: Byte map that lower-cases A-Z, keeps word bytes and turns all others into spaces.
WORD_BYTES = bytes(c + 32 if 0x41 <= c < 0x5B else c if 0x30 <= c < 0x3A or 0x61 <= c < 0x7B or c >= 0x80 else 0x20 for c in range(256))
_IS_WORD = np.frombuffer(WORD_BYTES, dtype=np.uint8) != 0x20
#: Stands between documents; the map above leaves no such byte in a text.
_BETWEEN = b"\x01"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which words begin and end."""
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = _IS_WORD[np.frombuffer(raw, dtype=np.uint8)]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class Phrases:
    """Test phrases of a block: a sorted vocabulary of words and phrases as symbol rows padded with 0."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        words = [words_of(text) for _, text in items]
        code = {w: i + 2 for i, w in enumerate(sorted({w for ws in words for w in ws}))}  # 0 ends, 1 separates
        self.vocabulary = code
        grams: dict[tuple[int, ...], list[int]] = {}
        for item, ws in enumerate(words):
            codes = [code[w] for w in ws]
            for i in range(max(1, len(codes) - window + 1)):
                if gram := tuple(codes[i : i + window]):
                    if item not in (at := grams.setdefault(gram, [])):
                        at.append(item)
        self.ids = [item_id for item_id, _ in items]
        self.lengths = np.array([len(g) for g in grams], dtype=np.int64)
        self.symbols = np.zeros((len(grams), window), dtype=np.int64)
        for row, gram in enumerate(grams):
            self.symbols[row, : len(gram)] = gram
        self.item_counts = np.array([len(v) for v in grams.values()], dtype=np.int64)
        self.items = np.array([i for v in grams.values() for i in v], dtype=np.int64)
        self.item_starts = np.cumsum(self.item_counts) - self.item_counts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words of the texts, 1 for words outside the vocabulary; and words in each text."""
        raw = (b" " + _BETWEEN + b" ").join([(t or "").encode().translate(WORD_BYTES) for t in texts])
        words, get = raw.split(), {**self.vocabulary, _BETWEEN: 0}.get
        codes = np.fromiter((get(w, 1) for w in words), dtype=np.int64, count=len(words))
        ends = np.append(np.flatnonzero(codes == 0), len(codes))
        return codes[codes > 0], np.diff(ends, prepend=-1) - 1


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; each round sorts again only the suffixes still tied."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    rank = _dense(rank[order], order)
    step = 1
    while n:
        ranked = rank[order]
        tied = np.zeros(n, dtype=bool)
        same = ranked[1:] == ranked[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            break
        rows = order[at]
        nxt = np.where(rows + step < n, rank[np.minimum(rows + step, n - 1)] + 1, 0)
        key = ranked[at] * np.int64(n + 1) + nxt
        moved = np.argsort(key, kind="stable")
        order[at] = rows[moved]
        key = key[moved]
        # A tied group begins at its old rank; parts of it get the place where they begin.
        begins = np.ones(len(at), dtype=bool)
        begins[1:] = key[1:] != key[:-1]
        rank[order[at]] = at[np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))]
        step *= 2
    return order


def _dense(ranked: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Rank of each suffix: the first place of its group in the order."""
    begins = np.ones(len(ranked), dtype=bool)
    begins[1:] = ranked[1:] != ranked[:-1]
    out = np.empty(len(ranked), dtype=np.int64)
    out[order] = np.maximum.accumulate(np.where(begins, np.arange(len(ranked)), 0))
    return out


class WaveletMatrix:
    """Rank and access over integers below 2 ** bits; 64-bit words with counts before each."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.n, self.levels, self.zeros = bits, len(values), [], []
        for level in range(bits - 1, -1, -1):
            bit = (values >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            padded = np.zeros(-(-(self.n + 1) // 64) * 8, dtype=np.uint8)
            padded[: len(packed)] = packed
            words = padded.view(np.uint64)
            counts = np.zeros(len(words) + 1, dtype=np.int64)
            np.cumsum(np.bitwise_count(words), out=counts[1:])
            self.levels.append((words, counts))
            self.zeros.append(int(self.n - counts[-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        words, counts = self.levels[level]
        word, inside = at >> 6, (at & 63).astype(np.uint64)
        return counts[word] + np.bitwise_count(words[word] & ((np.uint64(1) << inside) - np.uint64(1)))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol occurs in the first ``at`` places."""
        lo, hi = np.zeros(len(at), dtype=np.int64), at.astype(np.int64)
        for level in range(self.bits):
            one = (symbol >> (self.bits - 1 - level)) & 1 == 1
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = np.where(one, self.zeros[level] + a, lo - a), np.where(one, self.zeros[level] + b, hi - b)
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        at, out = at.astype(np.int64), np.zeros(len(at), dtype=np.int64)
        for level in range(self.bits):
            words, _ = self.levels[level]
            one = (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            ones = self._ones(level, at)
            out = (out << 1) | one
            at = np.where(one, self.zeros[level] + ones, at - ones)
        return out


class FMIndex:
    def __init__(self, symbols: np.ndarray, n_symbols: int, sample: int):
        order = suffix_order(symbols)
        self.n = len(symbols)
        self.bwt = WaveletMatrix(symbols[order - 1], max(1, int(n_symbols - 1).bit_length()))
        self.before = np.zeros(n_symbols + 1, dtype=np.int64)
        np.cumsum(np.bincount(symbols, minlength=n_symbols), out=self.before[1:])
        kept = order % sample == 0
        self.sampled, self.positions = np.flatnonzero(kept), order[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of all phrases, by backward search over all of them at once."""
        lo, hi = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.n, dtype=np.int64)
        for back in range(phrases.shape[1]):
            live = np.flatnonzero((lengths > back) & (lo < hi))
            if not len(live):
                break
            c = phrases[live, lengths[live] - 1 - back]
            lo[live] = self.before[c] + self.bwt.rank(c, lo[live])
            hi[live] = self.before[c] + self.bwt.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back until a sampled row, counting steps."""
        out, steps, live, at = np.zeros(len(rows), dtype=np.int64), 0, np.arange(len(rows)), rows.astype(np.int64)
        while len(live):
            where = np.minimum(np.searchsorted(self.sampled, at), len(self.sampled) - 1)
            found = self.sampled[where] == at
            out[live[found]] = (self.positions[where[found]] + steps) % self.n
            live, at = live[~found], at[~found]
            if len(live):
                c = self.bwt.access(at)
                at = self.before[c] + self.bwt.rank(c, at)
                steps += 1
        return out


def search_shard(texts: pa.Array, phrases: Phrases, params: DecontaminateParams) -> tuple[np.ndarray, list, list]:
    """Words, merged word spans and item ids for each text of a shard."""
    codes, n_words = phrases.encode(texts.to_pylist())
    n_docs = len(n_words)
    doc_of = np.repeat(np.arange(n_docs), n_words)
    first_word = np.cumsum(n_words) - n_words
    spans: list[list] = [[] for _ in range(n_docs)]
    items: list[list] = [[] for _ in range(n_docs)]
    # Words outside the vocabulary and document ends collapse into single separators.
    keep = codes > 1
    at = np.flatnonzero(keep)
    if not len(at) or not len(phrases.lengths):
        return n_words, spans, items
    run = np.ones(len(at), dtype=bool)
    run[1:] = (np.diff(at) > 1) | (doc_of[at[1:]] != doc_of[at[:-1]])
    # A stretch shorter than the shortest phrase holds no occurrence and stays out of the index.
    number = np.cumsum(run) - 1
    long_enough = np.bincount(number)[number] >= phrases.lengths.min()
    at, run = at[long_enough], run[long_enough]
    if not len(at):
        return n_words, spans, items
    place = np.arange(len(at)) + np.cumsum(run) - 1
    symbols = np.ones(place[-1] + 2, dtype=np.int64)
    symbols[-1] = 0  # the one end mark, below every symbol
    symbols[place] = codes[at]
    word_at = np.zeros(len(symbols), dtype=np.int64)
    word_at[place] = at
    index = FMIndex(symbols, len(phrases.vocabulary) + 2, params.sample)
    lo, hi = index.search(phrases.symbols, phrases.lengths)
    counts = hi - lo
    found = np.flatnonzero(counts)
    if not len(found):
        return n_words, spans, items
    n = counts[found]
    which = np.repeat(found, n)
    rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[found], n)
    word = word_at[index.locate(rows)]
    length = phrases.lengths[which]
    # Spans: +1 at starts, -1 at ends; documents cannot run into each other.
    depth = np.zeros(len(codes) + 1, dtype=np.int64)
    np.add.at(depth, word, 1)
    np.add.at(depth, word + length, -1)
    hit = np.zeros(len(codes) + 2, dtype=np.int8)
    hit[1:-1] = np.cumsum(depth)[:-1] > 0
    edge = np.diff(hit)
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    for s, e in zip(a.tolist(), b.tolist()):
        # Adjacent spans of neighbouring documents are cut at the document's end.
        while s < e:
            d = int(doc_of[s])
            stop = min(e, int(first_word[d] + n_words[d]))
            spans[d].append({"start": s - int(first_word[d]), "end": stop - int(first_word[d])})
            s = stop
    pair_n = phrases.item_counts[which]
    pair_items = phrases.items[np.arange(pair_n.sum()) - np.repeat(np.cumsum(pair_n) - pair_n, pair_n) + np.repeat(phrases.item_starts[which], pair_n)]
    pairs = np.unique(np.repeat(doc_of[word], pair_n) * np.int64(len(phrases.ids)) + pair_items)
    for p in pairs.tolist():
        items[p // len(phrases.ids)].append(phrases.ids[p % len(phrases.ids)])
    return n_words, spans, items


def _merge(old: list, new: list) -> list:
    out: list = []
    for s in sorted([*old, *new], key=lambda x: x["start"]):
        if out and s["start"] <= out[-1]["end"]:
            out[-1] = {"start": out[-1]["start"], "end": max(out[-1]["end"], s["end"])}
        else:
            out.append(dict(s))
    return out


def _blocks(items: DataFrame, params: DecontaminateParams) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of at most block_phrases words; rows come to the driver one partition at a time."""
    block, words = [], 0
    for item_id, text in items.toLocalIterator(prefetchPartitions=False):
        block.append((item_id, text))
        words += len(text) // 2 + 1
        if words >= params.block_phrases:
            yield block
            block, words = [], 0
    if block:
        yield block


def find_spans(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", params: DecontaminateParams = DecontaminateParams()
) -> DataFrame:
    """docs with n_words, spans (merged, in words) and items (sorted distinct ids as strings)."""
    clash = {name for name, _ in RESULT} & set(docs.columns)
    if clash:
        raise ValueError(f"columns would be overwritten: {sorted(clash)}")
    listed = benchmark.select(F.col(item_id).cast("string"), F.col(item_text)).where(F.col(item_text).isNotNull())
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(", ".join(f"{n} {k}" for n, k in RESULT)).fields])
    spark, out = docs.sparkSession, docs
    bounded_batches(spark)
    for number, block in enumerate(_blocks(listed, params) or ()):
        out = out.mapInArrow(_searcher(spark.sparkContext.broadcast(block), text, number == 0, params), schema)
    if out is docs:
        out = docs.mapInArrow(_searcher(spark.sparkContext.broadcast([]), text, True, params), schema)
    return out


def _searcher(block, text: str, first: bool, params: DecontaminateParams):
    name = (block._jbroadcast.id(), params.window)
    types = [pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string())]

    def shard(rows: pa.Table, phrases: Phrases) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        texts = rows.column(text)
        texts = texts.chunk(0)
        n_words, spans, items = search_shard(texts, phrases, params)
        if not first:
            spans = [_merge(a or [], b) for a, b in zip(rows.column("spans").to_pylist(), spans)]
            items = [[*(a or []), *b] for a, b in zip(rows.column("items").to_pylist(), items)]
            rows = rows.drop_columns([name for name, _ in RESULT])
        items = [sorted(set(x), key=lambda i: (i is not None, i)) for x in items]
        for (name, _), values, kind in zip(RESULT, (n_words, spans, items), types):
            rows = rows.append_column(name, pa.array(values, kind))
        yield from rows.to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache("decontaminate")
        if name not in cache:  # one block at a time is kept for the tasks that follow
            for old in [k for k in cache if isinstance(k, tuple)]:
                del cache[old]
            cache[name] = Phrases(block.value, params.window)
        held, size, phrases = [], 0, cache[name]
        for batch in slices(batches, text, params.shard_bytes):
            held.append(batch)
            size += batch.column(text).nbytes
            if size >= params.shard_bytes:
                yield from shard(pa.Table.from_batches(held), phrases)
                held, size = [], 0
        if held:
            yield from shard(pa.Table.from_batches(held), phrases)

    return run


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The digest columns of ``find_spans``: hit words, item count and hash, and the verdict."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select(
        key,
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def remove_spans(found: DataFrame, text: str = "text") -> DataFrame:
    """found without contaminated words: the text from a span's first word to its last is cut out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("decontaminate")
        for batch in slices(batches, text):
            at = batch.schema.get_field_index(text)
            texts, spans = batch.column(at).to_pylist(), batch.column(batch.schema.get_field_index("spans")).to_pylist()
            cut = [_cut(t, s) if t and s else t for t, s in zip(texts, spans)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(cut, batch.schema.field(at).type))

    return found.mapInArrow(run, found.schema)


def _cut(text: str, spans: list) -> str:
    raw = text.encode()
    starts, ends = word_bounds(raw)
    out, last = [], 0
    for s in spans:
        out.append(raw[last : starts[s["start"]]])
        last = ends[s["end"] - 1]
    return b"".join([*out, raw[last:]]).decode()
