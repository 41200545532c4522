"""Packing along a space-filling curve.

Each document's tokens are counted into ``buckets`` hashed buckets; the counts are
projected to ``dims`` dimensions by a fixed random matrix, scaled to unit length, cut
to ``bits`` bits each and turned into a Hilbert key. Documents are range-sorted by that
key, the token stream along the curve is cut every ``length`` tokens, so neighbours on
the curve share sequences and only the last sequence has padding.

Texts are encoded once; token ids go to a table in the shared folder with a row number
and the key. The small columns alone are range-sorted (ties by row number, so a hot key
is split), and places in the token stream come from sums per partition, the only thing
the driver sees (one number per partition). Ids then meet their places in one shuffle
and are cut into pieces.

Tokens come from a file for the tokenizers library, whose path is a parameter; id
``end_id`` closes each document. Where white space separates tokens and letters are
lower-cased, as in the vocabulary of op7, distinct white-space chunks are encoded once per
worker (cache of bounded size). Each worker first compares that way with the library on
sample texts, and with any other kind of vocabulary it encodes every text as a whole.

Defined results: a null text is empty, and an empty text is the end id alone;
repeated rows are packed once each; a very long text is taken whole and cut into as many
pieces as it needs; extra columns are not returned, whatever their names; an empty table
gives no pieces.
"""

from __future__ import annotations

import os
import sys
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.worker import bounded_batches, slices, worker_cache
from fathomline.session import materialize


@dataclass(frozen=True)
class PackParams:
    tokenizer: str
    length: int = 4096
    end_id: int = 2
    dims: int = 3
    bits: int = 10
    buckets: int = 256
    seed: int = 17
    cache_chunks: int = 500_000
    slice_chars: int = 4_000_000


@cache
def _unsafe() -> str:
    """A sign before a comma or stop, or a letter whose lower case is not one letter in every library.

    Letters and numbers that normalization (composed form) ends with another kind of sign, such as U+0958, count as signs.
    """
    split = []
    for c in map(chr, chain(range(0xD800), range(0xE000, sys.maxunicode + 1))):
        if unicodedata.category(c)[0] in "LN" and unicodedata.category(unicodedata.normalize("NFC", c)[-1])[0] not in "LN":
            split.append(rf"\x{{{ord(c):X}}}")
    return rf"[^\s\pL\pN][.,]|[{''.join(split)}][.,]|[\x{{0130}}\x{{03A3}}]"


#: Texts on which the way by chunks must give the ids of the library: case, marks, digits, white space, joined signs.
PROBES = (
    "The QUICK brown fox, again and again.", "don't I'LL x,y 1,2.3 _. a.., b?", "Ünïcödé ÉCOLE straße Ñandú ñ", "tab\tand\nnew  lines\r\n end ", " leading", "ΑΣ. Ωμέγα Привет МИР", "日本語 テキスト 😀 e\u0301 \u00a0q", "a1b2 3rd CamelCaseWord snake_case http://x.example.com/a?b=c", "### $$$ %%% «quoted» (brackets) [x] {y}", "",
)
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Byte-level vocabularies write a byte as the sign of that number if it prints, else as 256 + its place among the others.
BYTE_SIGNS = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}


class Encoder:
    """Token ids of white-space chunks as bytes, with each chunk's projection."""

    def __init__(self, params: PackParams):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.params, self.tokenizer = params, Tokenizer.from_file(params.tokenizer)
        rng = np.random.default_rng(params.seed)
        self.matrix = rng.standard_normal((params.buckets, params.dims))
        self.kind = "<u2" if max(self.tokenizer.get_vocab_size(), params.end_id + 1) <= 1 << 16 else "<u4"
        self.by_chunk = self._chunks_suffice()
        self._clear()

    def _chunks_suffice(self) -> bool:
        """Whether chunks give the ids of whole texts for this vocabulary, tried on PROBES."""
        try:
            self.by_chunk = True
            self._clear()
            width = np.dtype(self.kind).itemsize
            return all(
                np.frombuffer(raw[:-width], dtype=self.kind).tolist() == self.tokenizer.encode(text, add_special_tokens=False).ids for text, (raw, _) in zip(PROBES, self.encode(pa.array(PROBES)))
            )
        except Exception:  # a model without merges, or without ids for some sign
            return False

    def _clear(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.raw: list[bytes] = [b""]
        self.vectors = np.zeros((1, self.params.dims), dtype=np.float32)

    def split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """White-space chunks of all texts, and how many each text has.

        Only ASCII white space splits. A text is lower-cased and its commas and stops set apart first, which
        changes no token, unless a sign stands before one of them (the two would be one token) or lower-casing
        is not one letter for one; such a text is split as it is.
        """
        if not self.by_chunk:
            return texts, np.ones(len(texts), dtype=np.int64)
        raw = pc.match_substring_regex(texts, _unsafe())
        plain = pc.replace_substring(pc.replace_substring(pc.utf8_lower(texts), ",", " ,"), ".", " .")
        lists = pc.ascii_split_whitespace(pc.if_else(raw, texts, plain))
        return pc.list_flatten(lists), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)

    def learn(self, parts: list[str]) -> None:
        """Store the ids of unknown chunks. Lower-case Latin words go straight to the merges."""
        if not self.by_chunk:
            self._store(parts, [e.ids for e in self.tokenizer.encode_batch(parts, add_special_tokens=False)])
            return
        simple, other = [], []
        for part in parts:
            latin = part.isalpha() and part.islower() and (part.isascii() or max(part) < "\u0250" and unicodedata.is_normalized("NFC", part))
            (simple if latin else other).append(part)
        merge = self.tokenizer.model.tokenize
        self._store(simple, [[t.id for t in merge(p if p.isascii() else p.encode().decode("latin-1").translate(BYTE_SIGNS))] for p in simple])
        self._store(other, [e.ids for e in self.tokenizer.encode_batch(other, add_special_tokens=False)])

    def _store(self, parts: list[str], found: list[list[int]]) -> None:
        if not parts:
            return
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        ids = np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=int(sizes.sum()))
        bucket = ((ids.astype(np.uint64) * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(self.params.buckets)).astype(np.int64)
        sums = np.concatenate([np.zeros((1, self.params.dims)), np.cumsum(self.matrix[bucket], axis=0)])
        ends = np.cumsum(sizes)
        self.vectors = np.concatenate([self.vectors, (sums[ends] - sums[ends - sizes]).astype(np.float32)])
        flat, width = ids.astype(self.kind).tobytes(), np.dtype(self.kind).itemsize
        self.known.update(zip(parts, range(len(self.raw), len(self.raw) + len(parts))))
        self.raw += [flat[a:b] for a, b in zip(((ends - sizes) * width).tolist(), (ends * width).tolist())]

    def encode(self, texts: pa.Array) -> Iterator[tuple[bytes, np.ndarray]]:
        """For each text, its ids with the end id as bytes, and the unit vector of the projected counts."""
        chunks, counts = self.split(pc.fill_null(texts, ""))
        coded = chunks.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.raw) + len(distinct) > self.params.cache_chunks or not self.by_chunk:
            self._clear()
        self.learn([p for p in distinct if p not in self.known])
        place = np.fromiter(map(self.known.__getitem__, distinct), dtype=np.int64, count=len(distinct))
        # The slice's own chunks side by side: what follows stays in the processor's cache.
        raw = list(map(self.raw.__getitem__, place.tolist()))
        flat = np.frombuffer(b"".join(raw), dtype=self.kind)
        sizes = np.fromiter(map(len, raw), dtype=np.int32, count=len(raw)) // np.dtype(self.kind).itemsize
        starts = np.cumsum(sizes, dtype=np.int32) - sizes
        vectors = self.vectors[place]
        at = coded.indices.to_numpy(zero_copy_only=False)
        end_id = np.array([self.params.end_id], dtype=self.kind).tobytes()
        ends = np.cumsum(counts)
        for begin, end in zip((ends - counts).tolist(), ends.tolist()):
            mine = at[begin:end]
            n = sizes[mine]
            upto = np.cumsum(n, dtype=np.int32)
            total = int(upto[-1]) if len(upto) else 0
            where = np.repeat(starts[mine] - upto + n, n) + np.arange(total, dtype=np.int32)
            vector = (np.ones(len(mine), dtype=np.float32) @ vectors[mine]).astype(np.float64) if len(mine) else np.zeros(self.params.dims)
            size = float(np.sqrt((vector**2).sum()))
            yield flat[where].tobytes() + end_id, vector / size if size else vector


def _encoder(params: PackParams) -> Encoder:
    cache = worker_cache("packing")
    key = ("encoder", params.tokenizer, params.end_id, params.dims, params.buckets, params.seed)
    if key not in cache:
        cache[key] = Encoder(params)
    return cache[key]


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (n x dims) on a grid of 2 ** bits a side.

    The axes are transformed to the transposed index (inverse undo of excess work from
    the top bit down, then Gray encoding), whose bits are interleaved.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    level = 1 << (bits - 1)
    q = level
    while q > 1:
        low = q - 1
        for i in range(dims):
            set_bit = (x[i] & q) != 0
            swap = np.where(set_bit, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(set_bit, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), level
    while q > 1:
        turn = np.where((x[dims - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> bit) & 1)
    return out


def _encode(params: PackParams):
    """(id, n_tokens, curve, ids) for each document; ids of two bytes where the vocabulary allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, side = _encoder(params), 1 << params.bits
        width = np.dtype(encoder.kind).itemsize
        for batch in slices(batches, 1, params.slice_chars):
            ids, vectors = zip(*encoder.encode(batch.column(1)))
            grid = np.clip(((np.array(vectors) + 1) / 2 * side).astype(np.int64), 0, side - 1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) // width for x in ids], pa.int64()),
                    pa.array(hilbert_key(grid, params.bits), pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                ["doc_id", "n_tokens", "curve", "ids"],
            )

    return run


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Local start of each row's tokens in its partition of the sorted rows."""
    at, part = 0, TaskContext.get().partitionId()
    for batch in batches:
        total = batch.column(batch.schema.get_field_index("n_tokens")).to_numpy()
        ends = at + np.cumsum(total)
        yield batch.append_column("local", pa.array(ends - total, pa.int64())).append_column("part", pa.array(np.full(len(total), part), pa.int32()))
        at = int(ends[-1]) if len(ends) else at


def _cut(params: PackParams):
    """Pieces of each document's ids from its place in the token stream."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, crcs = [], []
            for row, (raw, total, place) in enumerate(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))):
                ids = np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * total else "<u4").astype("<u4")
                start = 0
                while start < total:
                    offset = (place + start) % params.length
                    n = min(total - start, params.length - offset)
                    rows.append((row, start, n, total, (place + start) // params.length, offset))
                    crcs.append(zlib.crc32(ids[start : start + n]))
                    start += n
            if not rows:
                continue
            cols = np.array(rows, dtype=np.int64).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(cols[0])), *(pa.array(c) for c in (cols[1], cols[2], np.array(crcs, dtype=np.int64), *cols[3:]))], names
            )

    return run


def pack(docs: DataFrame, params: PackParams, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row per piece."""
    bounded_batches(docs.sparkSession)
    base = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    encoded = base.mapInArrow(_encode(params), f"doc_id {kind}, n_tokens long, curve long, ids binary")
    # The row number is written with the row, so it stays the same in every later read.
    encoded = materialize(encoded.withColumn("row", F.monotonically_increasing_id()), "pack")
    sorted_rows = encoded.select("curve", "row", "n_tokens").repartitionByRange("curve", "row").sortWithinPartitions("curve", "row")
    placed = materialize(sorted_rows.select("row", "n_tokens").mapInArrow(_running, "row long, n_tokens long, local long, part int"), "pack")
    # One row per partition: its first place in the whole stream.
    sums = placed.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    begins, at = [], 0
    for r in sums:
        begins.append((r["part"], at))
        at += r["n"]
    offsets = docs.sparkSession.createDataFrame(begins, "part int, begin long")
    places = placed.join(offsets, "part").select("row", (F.col("begin") + F.col("local")).alias("place"))
    met = encoded.join(places, "row").select("doc_id", "ids", "n_tokens", "place")
    out = met.mapInArrow(
        _cut(params), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
    return out.withColumnRenamed("doc_id", key)
