"""N-gram Jaccard join by vertical partitioning.

A document is the set of 64-bit hashes of its k-word shingles; equal sets are one node.
Shingles have a global order: by frequency class (from a count sketch whose size follows
the input's, up to 2 ** 24 counters), then by hash, so that common passages come last:

1. One pass over the texts: sizes, node keys, and the sketch.
2. Prefix filter, from a second pass: two sets can only reach the threshold if they share
   a shingle among the first n - ceil(t n) + 1 of each. A row says how much of its set
   lies at and behind the shingle; at the first shared one that bounds the overlap, and
   pairs that cannot reach the threshold are not named at all.
3. Each shingle's list, sorted by node (a hash, so that its first member is any of them,
   and the same one in all lists of a group), names candidates: all pairs of a short list,
   in a long one each member with the first. Sorted rows are streamed; no list is held.
   Lists that the sketch counts as very long are dealt into blocks by node. Of the named pairs only
   those stay whose signatures (see 5) allow the threshold, before any set is fetched.
4. Verification by fragments: the order is cut at pivots into fragments of equal weight;
   segments of both sets meet per (pair, fragment), their overlaps are counted apart and
   added up per pair. A node with many pairs is met in several buckets of its partners.
5. Links give components. Long lists that still hold several components name further
   candidates between components, a range of leaders of every block against all blocks
   of the list, with eight times the leaders in every round, until no list has an unseen
   pair between components. A set's signature (parities of its hashes, two to four bits a
   shingle) bounds the difference of two sets from below, so that of the pairs that share
   a passage only those near the threshold are named. No link is lost, and a group of
   copies does not expand into all its pairs. ``all_links=True`` keeps pairs inside
   components too and returns every link.

Texts are never shuffled and no set is stored but those of candidates. What is broadcast
is bounded: the sketch (one byte per counter, 16 MB at most) and a Bloom filter over the
texts of candidates (two bytes each, 64 MB at most), whose errors only send unneeded rows.
A task holds sets of a few MB of text at a time; one very long text is held whole.

Words are maximal runs of ``[^\\x20\\x09-\\x0D]`` after lower-casing A-Z. Defined results:
fewer than k words give one shingle of the whole sequence; null and wordless texts have
no shingles and link with nothing, not even each other; equal sets are linked; repeated
rows and null ids are kept, and a component is named by its smallest non-null id (null
if it has none). Extra columns are not returned, whatever their names. Empty tables give
empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.worker import SLICE_BYTES, bounded_batches, slices, worker_cache
from fathomline.operators.graph import components
from fathomline.session import discard, materialize


@dataclass(frozen=True)
class JoinParams:
    k: int = 5
    percent: int = 75
    #: log2 of the sketch's counters; 0 takes one counter for every 16 KB of input, 2 ** 20 to 2 ** 24 of them.
    sketch_bits: int = 0
    fragments: int = 4
    short_list: int = 8
    first_leaders: int = 4
    block_rows: int = 1 << 16
    hub_pairs: int = 512
    slice_bytes: int = SLICE_BYTES


_LOWER = bytes(c + 32 if 0x41 <= c < 0x5B else c for c in range(256))
_P = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 4096
#: Low bits of a list's key: its block, 0 for a list in one piece. The upper 52 are the shingle's; should two shingles
#: share them, their lists only name a few more candidates.
_BLOCK_BITS = 12
_MAX_BLOCKS = (1 << _BLOCK_BITS) - 1
_MAX_SIGNATURE = 1 << 16
#: At most so many pairs are sent to every task, so that neither texts nor sets are shuffled to meet them.
_SENT_PAIRS = 1 << 17
#: Nodes that a task remembers to have sent.
_SENT = 200_000


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def shingles(text: str | bytes | None, params: JoinParams) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    from xxhash import xxh3_64_intdigest

    raw = text if isinstance(text, bytes) else (text or "").encode()
    words = raw.translate(_LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    codes = np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = min(params.k, len(codes))
    with np.errstate(over="ignore"):
        rolled = np.full(len(codes) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            rolled = rolled * _P + codes[i : len(codes) - n + 1 + i]
    found = np.sort(_mix(rolled))
    keep = np.ones(len(found), dtype=bool)
    keep[1:] = found[1:] != found[:-1]
    return found[keep]


def node_key(found: np.ndarray) -> int:
    """A hash of the set as a signed 64-bit number."""
    with np.errstate(over="ignore"):
        total = _mix(found + _P).sum(dtype=np.uint64) + np.uint64(len(found)) * _P
    return int(_mix(np.array([total]))[0].astype(np.int64))


def _tags(raw: list[bytes | None]) -> np.ndarray:
    """Hashes of whole texts, which find a node's text again."""
    from xxhash import xxh3_64_intdigest

    return np.fromiter((xxh3_64_intdigest(t or b"") for t in raw), dtype=np.uint64, count=len(raw)).view(np.int64)


def _raw(batch: pa.RecordBatch, column: int) -> list[bytes | None]:
    return pc.cast(batch.column(column), pa.binary()).to_pylist()


def _slots(found: np.ndarray, bits: int) -> np.ndarray:
    return (found >> np.uint64(64 - bits)).astype(np.int64)


def signature(found: np.ndarray) -> bytes:
    """Parity of how many hashes fall on each bit; equal hashes of two sets cancel out when signatures are added."""
    size = min(_MAX_SIGNATURE, max(64, 1 << (2 * len(found) - 1).bit_length())) if len(found) else 64
    return np.packbits(np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1, bitorder="little").tobytes()


def _folded(marks: bytes, size: int) -> bytes:
    """A signature of fewer bits."""
    while len(marks) > size:
        half = len(marks) // 2
        marks = (int.from_bytes(marks[:half], "little") ^ int.from_bytes(marks[half:], "little")).to_bytes(half, "little")
    return marks


def _apart(left: list[bytes], i: np.ndarray, right: list[bytes], j: np.ndarray) -> np.ndarray:
    """For each pair of places, at least how many elements stand in one of the two sets alone."""
    size = np.minimum(np.array([len(x) for x in left])[i], np.array([len(x) for x in right])[j])
    out = np.zeros(len(i), dtype=np.int64)
    for one in np.unique(size).tolist():
        at = np.flatnonzero(size == one)
        sides = []
        for marks, place in ((left, i[at]), (right, j[at])):
            used, back = np.unique(place, return_inverse=True)
            sides.append((np.frombuffer(b"".join(_folded(marks[k], one) for k in used.tolist()), dtype=np.uint64).reshape(len(used), -1), back))
        step = max(1, (4 << 20) // one)
        for b in range(0, len(at), step):
            part = slice(b, b + step)
            out[at[part]] = np.bitwise_count(sides[0][0][sides[0][1][part]] ^ sides[1][0][sides[1][1][part]]).sum(axis=1)
    return out


def _describe(bits: int, params: JoinParams):
    """Step 1: a row per document, and at the end of a task its counters in blocks."""
    names = ["id", "n", "node", "tag", "marks", "block", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("ngram_join")
        counts, kind = np.zeros(1 << bits, dtype=np.uint32), None
        for batch in slices(batches, 1, params.slice_bytes):
            raw, kind = _raw(batch, 1), batch.column(0).type
            sizes, nodes, marks = [], [], []
            for text in raw:
                found = shingles(text, params)
                marks.append(signature(found))
                np.add.at(counts, _slots(found, bits), np.uint32(1))
                sizes.append(len(found))
                nodes.append(node_key(found))
            empty = pa.nulls(len(raw), pa.int32()), pa.nulls(len(raw), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(_tags(raw)), pa.array(marks, pa.binary()), *empty], names)
        blocks = counts.reshape(-1, _BLOCK)
        used = np.flatnonzero(blocks.any(axis=1))
        for part in np.array_split(used, -(-len(used) // 256)) if len(used) else ():
            none = [pa.nulls(len(part), t) for t in (kind, pa.int64(), pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(part, pa.int32()), pa.array([_narrow(blocks[i]) for i in part], pa.binary())], names)

    return run


def _narrow(counts: np.ndarray) -> bytes:
    """Counters as 1-, 2- or 4-byte numbers, whatever fits; the length tells which."""
    most = counts.max()
    return counts.astype("u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype={1: "u1", 2: "<u2", 4: "<u4"}[len(raw) // _BLOCK]).astype(np.float64)


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of each block; a task holds the sums of its own blocks."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sums[block] = sums.get(block, 0) + _wide(raw)
    for block, total in sums.items():
        # Eight steps to a doubling; one byte.
        level = np.minimum(np.round(8 * np.log2(np.maximum(total, 1))), 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["block", "level"])


def _bits_of(level: np.ndarray) -> int:
    return len(level).bit_length() - 1


def _keys(found: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Place in the global order: the top byte is the frequency class."""
    return level[_slots(found, _bits_of(level))].astype(np.uint64) << np.uint64(56) | found >> np.uint64(8)


def ordered(found: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Hashes in the global order."""
    return found[np.argsort(_keys(found, level), kind="stable")]


def pivots(level: np.ndarray, params: JoinParams) -> np.ndarray:
    """Borders of fragments in the (class, hash) order, of about equal weight by the sketch."""
    weight = np.bincount(level, weights=2.0 ** (level / 8.0), minlength=256)
    upto = np.concatenate([[0.0], np.cumsum(weight)])
    want = upto[-1] * np.arange(1, params.fragments) / params.fragments
    at = np.clip(np.searchsorted(upto, want, side="right") - 1, 0, 255)
    inside = np.clip((want - upto[at]) / np.maximum(weight[at], 1.0), 0, 1 - 1e-9)
    return (at.astype(np.uint64) << np.uint64(56)) | (inside * float(1 << 56)).astype(np.uint64)


def _blocks_of(found: np.ndarray, level: np.ndarray, params: JoinParams) -> np.ndarray:
    """Blocks of each shingle's list, by the sketch, which counts too many rather than too few."""
    return np.clip(np.ceil(2.0 ** (level[_slots(found, _bits_of(level))] / 8.0) / params.block_rows), 1, _MAX_BLOCKS).astype(np.int64)


def prefix_size(n, percent: int):
    return n - -(-percent * n // 100) + 1


def _prefixes(level, params: JoinParams):
    """Step 2: (key, size, node) for the prefix of every node; size has n in its upper and the rest in its lower half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("ngram_join")
        sent: set[int] = set()
        table = np.frombuffer(level.value, dtype=np.uint8)
        for batch in slices(batches, 0, params.slice_bytes):
            parts, sizes, nodes = [], [], []
            for text in _raw(batch, 0):
                found = shingles(text, params)
                node = node_key(found)
                if not len(found) or node in sent:
                    continue
                if len(sent) >= _SENT:
                    sent.clear()  # a node sent twice is dropped where its list is read
                sent.add(node)
                parts.append(ordered(found, table)[: prefix_size(len(found), params.percent)])
                sizes.append(len(found))
                nodes.append(node)
            if not parts:
                continue
            lengths = np.array([len(p) for p in parts])
            shingle, n, node = np.concatenate(parts), np.repeat(np.array(sizes, dtype=np.int64), lengths), np.repeat(np.array(nodes, dtype=np.int64), lengths)
            place = np.arange(len(shingle)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            blocks = _blocks_of(shingle, table, params)
            block = np.where(blocks > 1, (_mix(node.view(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64) + 1, 0)
            key = shingle.view(np.int64) & ~np.int64(_MAX_BLOCKS) | block
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, n << 32 | n - place, node)], ["key", "size", "node"])

    return run


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and sizes of stretches of equal keys."""
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return begins, np.diff(np.append(begins, len(key)))


def _halves(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return size >> 32, size & 0xFFFFFFFF


def _reaches(n_a, rest_a, n_b, rest_b, percent: int):
    """Whether sizes fit and, with this as the first shared shingle, the overlap could reach the threshold."""
    small, large = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    return (100 * small >= percent * large) & ((100 + percent) * np.minimum(rest_a, rest_b) >= percent * (small + large))


def _candidates(params: JoinParams):
    """Step 3 on rows sorted by (key, node): pairs (a, b), and the rows of long lists.

    A list may span batches: its last rows wait for the next batch while it is short, and of a long one only its
    leader and its last node are carried on. In a pair, a is the smaller node.
    """
    names = ["a", "b", "na", "nb", "key", "size", "node"]

    def emit(pairs: list, rows: list) -> Iterator[pa.RecordBatch]:
        if pairs:
            got = [np.concatenate(x) for x in zip(*pairs)]
            none = [pa.nulls(len(got[0]), pa.int64()) for _ in range(3)]
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in got), *none], names)
        if rows:
            got = [np.concatenate(x) for x in zip(*rows)]
            none = [pa.nulls(len(got[0]), pa.int64()) for _ in range(4)]
            yield pa.RecordBatch.from_arrays([*none, *(pa.array(x) for x in got)], names)

    def short(cols: list[np.ndarray], begins: np.ndarray, sizes: np.ndarray, pairs: list) -> None:
        """All pairs of lists of two rows or more."""
        if not len(sizes):
            return
        at = np.repeat(begins - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        which = np.repeat(np.arange(len(sizes)), sizes)
        (n, rest), node = _halves(cols[1][at]), cols[2][at]
        for gap in range(1, int(sizes.max())):
            i = np.flatnonzero(which[:-gap] == which[gap:])
            i = i[_reaches(n[i], rest[i], n[i + gap], rest[i + gap], params.percent)]
            if len(i):
                pairs.append((node[i], node[i + gap], n[i], n[i + gap]))

    def long(size, node, leader, pairs: list):
        """leader: (n, rest, node) of the list's first member, which is paired with all others that fit."""
        (n, rest), at = _halves(size), 0
        if leader is None:
            leader, at = (int(n[0]), int(rest[0]), int(node[0])), 1
        i = at + np.flatnonzero(_reaches(leader[0], leader[1], n[at:], rest[at:], params.percent))
        if len(i):
            pairs.append((np.full(len(i), leader[2]), node[i], np.full(len(i), leader[0]), n[i]))
        return leader

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("ngram_join")
        held = None  # rows of an unfinished list that is still short
        open_list = None  # (key, leader, last node) of an unfinished long list
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy() for i in range(3)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
                held = None
            key, _, node = cols
            same = np.concatenate([[False], (key[1:] == key[:-1]) & (node[1:] == node[:-1])])
            if open_list is not None:
                same[0] = (key[0], node[0]) == (open_list[0], open_list[2])
            cols = [c[~same] for c in cols]
            key, size, node = cols
            if not len(key):
                continue
            pairs, rows, start = [], [], 0
            begins, sizes = _runs(key)
            if open_list is not None:
                if key[0] == open_list[0]:
                    stop = int(sizes[0])
                    leader = long(size[:stop], node[:stop], open_list[1], pairs)
                    rows.append([c[:stop] for c in cols])
                    start = 1
                    open_list = (open_list[0], leader, node[stop - 1]) if len(sizes) == 1 else None
                else:
                    open_list = None
            begins, sizes = begins[start:], sizes[start:]
            if len(sizes):
                last = len(sizes) - 1
                # A block of a dealt list is no whole list: its rows are kept to meet the other blocks.
                kept = (sizes > params.short_list) | (key[begins] & _MAX_BLOCKS > 0)
                for i in np.flatnonzero(kept):
                    part = slice(int(begins[i]), int(begins[i] + sizes[i]))
                    leader = long(size[part], node[part], None, pairs)
                    rows.append([c[part] for c in cols])
                    if i == last:
                        open_list = (key[part.start], leader, node[part.stop - 1])
                if not kept[last]:
                    held = [c[int(begins[last]) :] for c in cols]
                    begins, sizes, kept = begins[:last], sizes[:last], kept[:last]
                few = (sizes > 1) & ~kept
                short(cols, begins[few], sizes[few], pairs)
            yield from emit(pairs, rows)
        if held is not None and len(held[0]) > 1:
            pairs = []
            short(held, np.array([0]), np.array([len(held[0])]), pairs)
            yield from emit(pairs, [])

    return run


def _further(all_links: bool, params: JoinParams):
    """Step 5 on rows (key, leads, size, node, component, marks), a list's leaders first: leaders against members."""

    def meet(leaders: list, members: list) -> Iterator[tuple]:
        """Pairs (a, b, na, nb) that sizes, places and signatures allow; both sides are [n, rest, node, component, marks]."""
        step = max(1, (1 << 18) // len(members[0]))
        for at in range(0, len(leaders[0]), step):
            ln, lr, lv, lc = (x[at : at + step, None] for x in leaders[:4])
            mn, mr, mv, mc = (x[None, :] for x in members[:4])
            good = _reaches(ln, lr, mn, mr, params.percent) & (lv != mv)
            if not all_links:
                good &= lc != mc
            i, j = np.nonzero(good)
            if not len(i):
                continue
            both = ln[i, 0] + mn[0, j]
            most = (both - _apart(leaders[4][at : at + step], i, members[4], j)) // 2
            near = (100 + params.percent) * most >= params.percent * both
            i, j = i[near], j[near]
            if len(i):
                yield lv[i, 0], mv[0, j], ln[i, 0], mn[0, j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("ngram_join")
        current, leaders = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, leads, size, node, comp = (batch.column(i).to_numpy() for i in range(5))
            marks = batch.column(5).to_pylist()
            begins, sizes = _runs(key)
            out: list[tuple] = []
            for b, s in zip(begins.tolist(), sizes.tolist()):
                if current != key[b]:
                    current, leaders = key[b], None
                first = b + int(leads[b : b + s].sum())
                take = lambda x, y: [*_halves(size[x:y]), node[x:y], comp[x:y], marks[x:y]]
                if first > b:
                    new = take(b, first)
                    leaders = new if leaders is None else [*(np.concatenate(x) for x in zip(leaders[:4], new[:4])), leaders[4] + new[4]]
                if leaders is not None and first < b + s:
                    out += meet(leaders, take(first, b + s))
            if out:
                a, b, na, nb = (np.concatenate(x) for x in zip(*out))
                swap = a > b
                got = np.unique(np.stack([np.where(swap, b, a), np.where(swap, a, b), np.where(swap, nb, na), np.where(swap, na, nb)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(got[:, i]) for i in range(4)], ["a", "b", "na", "nb"])

    return run


def _near(params: JoinParams):
    """Of rows (a, b, na, nb, marks of a, marks of b) the pairs whose signatures allow the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("ngram_join")
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.arange(batch.num_rows)
            both = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            most = (both - _apart(batch.column(4).to_pylist(), at, batch.column(5).to_pylist(), at)) // 2
            near = (100 + params.percent) * most >= params.percent * both
            yield pa.RecordBatch.from_arrays(batch.columns[:4], batch.schema.names[:4]).filter(pa.array(near))

    return run


def _bloom_slots(tags: np.ndarray, bits: int) -> list[np.ndarray]:
    h = _mix(tags.view(np.uint64) + _P)
    return [(h >> np.uint64(64 - bits)).astype(np.int64), (_mix(h) >> np.uint64(64 - bits)).astype(np.int64)]


def _bloom(bits: int):
    """Set bits of a task's tags, as (block, bytes) rows of the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("ngram_join")
        marks = np.zeros(1 << bits, dtype=bool)
        for batch in batches:
            for at in _bloom_slots(batch.column(0).to_numpy(), bits):
                marks[at] = True
        packed = np.packbits(marks, bitorder="little").reshape(-1, 8192)
        for i in np.flatnonzero(packed.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([packed[i].tobytes()], pa.binary())], ["block", "bits"])

    return run


def _or_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    merged: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            merged[block] = merged.get(block, 0) | np.frombuffer(raw, dtype=np.uint8)
    for block, bits in merged.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["block", "bits"])


def _segments(level, bloom, borders, bits: int, params: JoinParams):
    """Step 4: (node, fragment, hashes) of the texts in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("ngram_join")
        sent: set[int] = set()
        table, marks = np.frombuffer(level.value, dtype=np.uint8), np.frombuffer(bloom.value, dtype=np.uint8)
        for batch in slices(batches, 0, params.slice_bytes):
            raw = _raw(batch, 0)
            near = np.ones(len(raw), dtype=bool)
            for at in _bloom_slots(_tags(raw), bits):
                near &= (marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            nodes, parts, values = [], [], []
            for row in np.flatnonzero(near).tolist():
                found = shingles(raw[row], params)
                node = node_key(found)
                if not len(found) or node in sent:
                    continue
                if len(sent) >= _SENT:
                    sent.clear()
                sent.add(node)
                fragment = np.searchsorted(borders, _keys(found, table), side="right")
                for part in range(params.fragments):
                    if len(segment := found[fragment == part]):
                        nodes.append(node)
                        parts.append(part)
                        values.append(segment.view(np.int64))
            if nodes:
                offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(values)))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(parts, pa.int32()), lists], ["node", "fragment", "hashes"])

    return run


def _sketch_bits(docs: DataFrame, params: JoinParams) -> int:
    """From the optimizer's estimate of the input's bytes."""
    if params.sketch_bits:
        return params.sketch_bits
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(24, max(20, math.ceil(math.log2(max(1, size >> 14)))))


class _Join:
    def __init__(self, docs: DataFrame, key: str, text: str, params: JoinParams):
        self.params, self.spark = params, docs.sparkSession
        bounded_batches(self.spark)
        kind = docs.schema[key].dataType.simpleString()
        self.texts = docs.select(F.col(text).alias("text"))
        bits = _sketch_bits(self.texts, params)
        described = materialize(docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(_describe(bits, params), f"id {kind}, n long, node long, tag long, marks binary, block int, counts binary"), "described")
        self.rows = described.where("block IS NULL").select("id", "n", "node", "tag", "marks")
        level = np.zeros(1 << bits, dtype=np.uint8)
        for r in described.where("block IS NOT NULL").select("block", "counts").repartition("block").mapInArrow(_add_blocks, "block int, level binary").collect():  # one byte a counter
            level[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.frombuffer(r["level"], dtype=np.uint8)
        self.borders = pivots(level, params)
        self.level = self.spark.sparkContext.broadcast(level.tobytes())
        self.stored: list[DataFrame] = []

    def candidates(self) -> DataFrame:
        rows = self.texts.mapInArrow(_prefixes(self.level, self.params), "key long, size long, node long")
        listed = rows.repartition("key").sortWithinPartitions("key", "node")
        return materialize(listed.mapInArrow(_candidates(self.params), "a long, b long, na long, nb long, key long, size long, node long"), "lists")

    def segments(self, pairs: DataFrame, sent) -> DataFrame:
        """(node, fragment, hashes) of all nodes in pairs; those not stored yet come from one more pass over the texts."""
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        for held in self.stored:
            nodes = nodes.join(held.select("node"), "node", "left_anti")
        tags = self.rows.select("node", "tag").join(sent(nodes), "node", "left_semi").groupBy("node").agg(F.min("tag").alias("tag")).select("tag")
        bits = min(29, max(16, (32 * pairs.count()).bit_length()))
        marks = np.zeros((1 << bits) // 8, dtype=np.uint8)
        for r in tags.mapInArrow(_bloom(bits), "block int, bits binary").repartition("block").mapInArrow(_or_blocks, "block int, bits binary").collect():  # the filter that is sent
            marks[r["block"] * 8192 : (r["block"] + 1) * 8192] = np.frombuffer(r["bits"], dtype=np.uint8)
        if marks.any():
            bloom = self.spark.sparkContext.broadcast(marks.tobytes())
            made = self.texts.mapInArrow(_segments(self.level, bloom, self.borders, bits, self.params), "node long, fragment int, hashes array<long>")
            # Several tasks may send a node.
            self.stored.append(materialize(made.groupBy("node", "fragment").agg(F.first("hashes").alias("hashes")), "segments"))
        if not self.stored:
            return self.spark.createDataFrame([], "node long, fragment int, hashes array<long>")
        return reduce(DataFrame.unionByName, self.stored)

    def marks(self, nodes: DataFrame) -> DataFrame:
        """(node, marks) of the given nodes."""
        return self.rows.select("node", "marks").join(nodes, "node", "left_semi").groupBy("node").agg(F.max("marks").alias("marks"))

    def met(self, pairs: DataFrame, held: DataFrame, by: list[str], sent) -> DataFrame:
        """pairs with the columns of held of both their nodes, of_a and of_b; a node with many pairs is met in several buckets of its partners."""
        many, value = self.params.hub_pairs, next(c for c in held.columns if c not in ("node", *by))
        hubs = pairs.groupBy("a").count().where(f"count > {many}").select("a", F.ceil(F.col("count") / many).cast("int").alias("buckets"))
        placed = pairs.join(sent(hubs), "a", "left").withColumn("bucket", F.pmod(F.xxhash64("b"), F.coalesce("buckets", F.lit(1))).cast("int")).drop("buckets")
        of_b = held.select(F.col("node").alias("b"), *by, F.col(value).alias("of_b")).join(sent(placed), "b")
        of_a = held.select(F.col("node").alias("a"), *by, F.col(value).alias("of_a")).join(sent(placed.select("a", "bucket").distinct()), "a")
        return of_b.join(of_a, ["a", "bucket", *by])

    def _sent(self, pairs: DataFrame):
        """What is joined with pairs or their nodes: a broadcast of them where they are few."""
        return F.broadcast if pairs.count() <= _SENT_PAIRS else lambda df: df

    def near(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, na, nb) without those that cannot be links by their signatures, a few bits for each element of a set."""
        sent = self._sent(pairs)
        marks = self.marks(sent(pairs.select(F.explode(F.array("a", "b")).alias("node"))))
        met = self.met(pairs, marks, [], sent).select("a", "b", "na", "nb", "of_a", "of_b")
        return materialize(met.mapInArrow(_near(self.params), "a long, b long, na long, nb long"), "pairs")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """Links (a, b) among pairs (a, b, na, nb), by overlaps per fragment."""
        p, sent = self.params, self._sent(pairs)
        met = self.met(pairs, self.segments(pairs, sent), ["fragment"], sent)
        overlap = met.groupBy("a", "b", "na", "nb").agg(F.sum(F.size(F.array_intersect("of_a", "of_b"))).alias("both"))
        return materialize(overlap.where(f"100 * both >= {p.percent} * (na + nb - both)").select("a", "b"), "links")

    def links(self, all_links: bool) -> tuple[DataFrame, DataFrame]:
        """Links that give the components (or all links), and (node, component) of linked nodes."""
        p = self.params
        lists = self.candidates()
        rows = lists.where("a IS NULL").select("key", "size", "node", F.expr(f"key & {~_MAX_BLOCKS}").alias("list"))
        longest = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members")).agg(F.max("members")).collect()[0][0] or 0
        named = materialize(lists.where("a IS NOT NULL").select("a", "b", "na", "nb").distinct(), "named")
        # Further rounds, which judge by signatures as well, name none of the pairs that these rule out.
        seen = self.near(named)
        discard(named)
        links = self.verify(seen)
        known = components(links, "a", "b")
        passed = [lists, seen]  # tables that nothing reads after the last round
        lo, hi = 0, p.first_leaders
        while lo < longest:
            marked = rows.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
            per_list = marked.groupBy("list").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.max("key").alias("last"), F.count(F.lit(1)).alias("members"))
            # At most lo members were all leaders before.
            per_list = per_list.where(F.lit(all_links) | F.expr("least <> most")).where(f"members > {lo}").select("list", "last")
            place = F.row_number().over(Window.partitionBy("key").orderBy("node"))
            opened = listed = materialize(marked.join(per_list, "list").withColumn("place", place), "open")
            passed.append(opened)
            if listed.isEmpty():
                break
            listed = listed.join(self.marks(listed.select("node")), "node")
            # A dealt list's blocks have the keys list + 1 to last, one in one piece has the key list.
            first = F.least(F.col("last"), F.col("list") + 1)
            leaders = listed.where(F.col("place").between(lo + 1, hi)).withColumn("key", F.explode(F.sequence(first, F.col("last"))))
            columns = ["key", "leads", "size", "node", "component", "marks"]
            met = leaders.withColumn("leads", F.lit(1)).select(columns).unionByName(listed.withColumn("leads", F.lit(0)).select(columns))
            met = met.repartition("key").sortWithinPartitions("key", F.desc("leads"))
            more = met.mapInArrow(_further(all_links, p), "a long, b long, na long, nb long").distinct()
            more = materialize(more.join(seen.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
            passed.append(more)
            if not more.isEmpty():
                found = self.verify(more)
                if not found.isEmpty():
                    passed += [links, known]
                    links = materialize(links.unionByName(found), "links")
                    known = components(links, "a", "b")
                passed.append(found)
                seen = seen.unionByName(more)
            lo, hi = hi, hi * 8
        for held in (*passed, *self.stored):
            discard(held)
        return links, known


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", params: JoinParams = JoinParams()) -> DataFrame:
    """(key, n_shingles, component_id), one row per document."""
    join = _Join(docs, key, text, params)
    _, known = join.links(False)
    named = join.rows.groupBy("node").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("members")).join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    firsts = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(firsts, "component").select("node", "component_id")
    return join.rows.join(named, "node").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")
    )


def links(docs: DataFrame, key: str = "doc_id", text: str = "text", params: JoinParams = JoinParams()) -> tuple[DataFrame, DataFrame]:
    """All links between different sets as (a, b) nodes, and the membership (key, n_shingles, node)."""
    join = _Join(docs, key, text, params)
    found, _ = join.links(True)
    return found, join.rows.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "node")
