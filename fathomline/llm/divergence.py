"""Divergence of sources inside each language, by tiling pairs of group blocks.

A group is a (lang, source). Terms are runs of letters (ASCII letters in lower case and all
signs beyond ASCII); a language keeps the terms of at least ``least_docs`` of its documents.
A term's share in a group, smoothed and scaled to whole numbers, is
p = 1 + floor(scale * (count + add) / (N + add * V)), N the group's count over V kept terms.

Terms are counted per batch in Arrow functions, then per (lang, source, term) with map-side
sums. Kept terms are dealt by hash to vocabulary chunks of about ``chunk_terms`` and numbered
inside their chunk; a group's counts of a chunk are one packed row. Groups of a language form
blocks of ``block`` groups. Each packed row is replicated to the tiles (block by block) of its
block, and a tile's runs of ``slab_chunks`` successive chunks are separate tasks: each holds
two blocks of vectors of one slab, walks through its chunks and returns a submatrix of partial
sums, which are added per pair. A chunk that a tile never sees holds no term of its groups;
its terms differ by the constant difference of unseen shares, which the first slab adds for
all V terms and every seen chunk takes back for its own.

All numbers are whole: shares by long division in steps of 1000, so counts up to 9e15 are exact.

Defined results: null text, lang and source are empty strings, and an empty lang is a language;
a group without terms has count 0 everywhere; a language without kept terms has pairs of value
0 and no terms; rows of one id are separate documents; very long texts are taken whole; ties
go by the bytes of the item; extra columns are not returned, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.worker import slices, worker_cache
from fathomline.session import materialize


@dataclass(frozen=True)
class DivergenceParams:
    least_docs: int = 30
    add: int = 5
    top: int = 50
    block: int = 64
    chunk_terms: int = 512
    slab_chunks: int = 4
    slice_bytes: int = 16 << 20


#: A share of 1 is STEP ** 3.
STEP = 1000


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    for low, high in ((0x00, 0x41), (0x5B, 0x61), (0x7B, 0x80)):
        table[low:high] = 0x20
    return table


def term_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of texts without nulls, empty strings among them, and how many each text has."""
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    signs = np.frombuffer(body, dtype=np.uint8)[offsets[0] : offsets[-1]] if body is not None and len(offsets) else np.zeros(0, dtype=np.uint8)
    folded = pa.Array.from_buffers(texts.type, len(texts), [None, pa.py_buffer((offsets - offsets[0]).copy()), pa.py_buffer(_byte_table()[signs])])
    lists = pc.ascii_split_whitespace(folded)
    return pc.list_flatten(lists), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def _count(params: DivergenceParams):
    """(lang, source, term, n, docs) per slice of a batch; term is null once for every group seen."""
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("divergence")
        for batch in slices(batches, 2, params.slice_bytes):
            groups, of_doc = np.unique(
                np.array([f"{a}\0{b}" for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], dtype=object), return_inverse=True
            )
            lang, source = (pa.array([g.split("\0", 1)[i] for g in groups], pa.string()) for i in (0, 1))
            zero = pa.array(np.zeros(len(groups), dtype=np.int64))
            yield pa.RecordBatch.from_arrays([lang, source, pa.nulls(len(groups), pa.string()), zero, zero], names)
            flat, counts = term_lists(batch.column(2))
            coded = flat.dictionary_encode()
            width = max(1, len(coded.dictionary))
            at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(len(counts)), counts)
            real = np.array(pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False), dtype=bool)[at] if len(at) else np.zeros(0, dtype=bool)
            per_doc, n = np.unique(doc[real] * width + at[real], return_counts=True)
            cell = of_doc[per_doc // width] * width + per_doc % width
            cells, where = np.unique(cell, return_inverse=True)
            total = np.bincount(where, weights=n, minlength=len(cells)).astype(np.int64)
            docs = np.bincount(where, minlength=len(cells)).astype(np.int64)
            group, term = pa.array(cells // width), pa.array(cells % width)
            yield pa.RecordBatch.from_arrays([lang.take(group), source.take(group), coded.dictionary.take(term).cast(pa.string()), pa.array(total), pa.array(docs)], names)

    return run


def _share(count: Column, whole: Column, params: DivergenceParams) -> Column:
    """p of a count, by long division; count may be larger than a 64-bit product with the scale would allow."""
    rest, out = count + params.add, F.lit(0).cast("long")
    for _ in range(3):
        scaled = rest * STEP
        out, rest = out * STEP + F.call_function("div", scaled, whole), F.pmod(scaled, whole)
    return out + 1


def shares(counts: np.ndarray, whole: np.ndarray, add: int) -> np.ndarray:
    """p of counts (groups x terms) with a group's N + add * V in whole."""
    rest, out, by = counts + add, np.zeros_like(counts), whole[:, None]
    for _ in range(3):
        digit, rest = np.divmod(rest * STEP, by)
        out = out * STEP + digit
    return out + 1


def _tile(params: DivergenceParams):
    """Partial sums of all pairs of one tile over one slab of chunks.

    Rows: chunk -1 describes a group (source, whole, v), the others hold its counts of a chunk.
    """
    names = ["lang", "a", "b", "value"]

    def run(rows: pa.Table) -> pa.Table:
        worker_cache("divergence")
        col = lambda c: rows.column(c).to_numpy()
        lang, bi, bj, slab = rows.column("lang")[0].as_py(), *(int(col(c)[0]) for c in ("bi", "bj", "slab"))
        described = rows.filter(pc.equal(rows.column("chunk"), -1)).sort_by("g")
        g, whole, v = (described.column(c).to_numpy() for c in ("g", "whole", "v"))
        sources = described.column("source").to_pylist()
        left, right = np.flatnonzero(g // params.block == bi), np.flatnonzero(g // params.block == bj)
        total = np.zeros((len(left), len(right)), dtype=np.int64)
        if len(v) and v[0]:
            unseen = shares(np.zeros((len(g), 1), dtype=np.int64), whole, params.add)[:, 0]
            apart = np.abs(unseen[left][:, None] - unseen[right][None, :])
            total += apart * int(v[0]) if slab == 0 else 0
            chunk = col("chunk")
            order = np.argsort(chunk, kind="stable")
            for number in np.unique(chunk[chunk >= 0]):
                held = order[np.searchsorted(chunk[order], number) : np.searchsorted(chunk[order], number, side="right")]
                part = rows.take(pa.array(held))
                sizes = pc.list_value_length(part.column("terms").combine_chunks()).to_numpy(zero_copy_only=False)
                terms = pc.list_flatten(part.column("terms").combine_chunks()).to_numpy()
                n = pc.list_flatten(part.column("counts").combine_chunks()).to_numpy()
                counts = np.zeros((len(g), int(terms.max()) + 1), dtype=np.int64)
                counts[np.repeat(np.searchsorted(g, part.column("g").to_numpy()), sizes), terms] = n
                p = shares(counts, whole, params.add)
                for i, row in enumerate(left):
                    total[i] += np.abs(p[right] - p[row]).sum(axis=1)
                total -= apart * counts.shape[1]
        i, j = np.nonzero(g[left][:, None] < g[right][None, :])
        a, b = ([sources[k] for k in side] for side in (left[i], right[j]))
        return pa.table([pa.array([lang] * len(i), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(total[i, j])], names=names)

    return run


def pair_values(counted: DataFrame, groups: DataFrame, chunks: int, params: DivergenceParams) -> DataFrame:
    """(lang, a, b, value) for every pair of sources a before b of a language."""
    slabs = -(-chunks // params.slab_chunks)
    packed = counted.groupBy("lang", "g", "chunk").agg(F.sort_array(F.collect_list(F.struct("term_no", "n"))).alias("x"))
    packed = packed.select("lang", "g", "chunk", F.transform("x", lambda t: t["term_no"]).alias("terms"), F.transform("x", lambda t: t["n"]).alias("counts"))
    blocks = groups.select("lang", "g", "n_blocks")
    vectors = packed.join(blocks, ["lang", "g"]).withColumn("slab", F.floor(F.col("chunk") / params.slab_chunks).cast("int"))
    vectors = vectors.select("lang", "g", "n_blocks", "slab", "chunk", F.lit(None).cast("string").alias("source"), F.lit(0).cast("long").alias("whole"), F.lit(0).cast("long").alias("v"), "terms", "counts")
    nothing = F.array().cast("array<int>").alias("terms"), F.array().cast("array<bigint>").alias("counts")
    described = groups.withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit(slabs - 1)))).select("lang", "g", "n_blocks", "slab", F.lit(-1).alias("chunk"), "source", "whole", "v", *nothing)
    own = F.floor(F.col("g") / params.block).cast("int")
    dealt = described.unionByName(vectors).withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    dealt = dealt.withColumn("bi", F.least("_own", "_other")).withColumn("bj", F.greatest("_own", "_other")).drop("_own", "_other", "n_blocks")
    return dealt.groupBy("lang", "bi", "bj", "slab").applyInArrow(_tile(params), "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", params: DivergenceParams = DivergenceParams()) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to all other sources of the language, and its most over-used terms."""
    base = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    found = base.mapInArrow(_count(params), "lang string, source string, term string, n long, docs long")
    cells = materialize(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")
    kept = cells.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("d")).where(F.col("d") >= params.least_docs).drop("d")
    kept = materialize(kept, "kept")
    chunks = max(1, -(-kept.count() // params.chunk_terms))
    number = F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1
    kept = kept.withColumn("chunk", F.pmod(F.xxhash64("term"), F.lit(chunks)).cast("int")).withColumn("term_no", number)
    counted = materialize(cells.where("term IS NOT NULL").join(kept, ["lang", "term"]).drop("docs"), "counted")
    vocabulary = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n_lang").alias("n_lang"))
    of_group = counted.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    in_lang = Window.partitionBy("lang")
    groups = (
        cells.where("term IS NULL").select("lang", "source")
        .join(of_group, ["lang", "source"], "left").join(vocabulary, "lang", "left").na.fill(0, ["n", "v", "n_lang"])
        .withColumn("g", F.row_number().over(in_lang.orderBy("source")) - 1)
        .withColumn("n_blocks", F.ceil(F.count(F.lit(1)).over(in_lang) / params.block).cast("int"))
        .withColumn("whole", F.col("n") + params.add * F.col("v")).withColumn("whole_lang", F.col("n_lang") + params.add * F.col("v"))
    )
    groups = materialize(groups.drop("n", "n_lang"), "groups")
    met = counted.join(groups.select("lang", "source", "g", "whole", "whole_lang"), ["lang", "source"])
    pairs = pair_values(met, groups, chunks, params)
    both = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value")
    p, q = _share(F.col("n"), F.col("whole"), params), _share(F.col("n_lang"), F.col("whole_lang"), params)
    over = met.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = over.withColumn("rank", rank).where(F.col("rank") <= params.top)
    near = both.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value").withColumn("rank", rank)
    return near.unionByName(terms)
