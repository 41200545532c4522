"""Filter audit, mixing and divergence against plain versions, with their edge cases."""

import math
import random
import re
from collections import Counter
from fractions import Fraction
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathomline.llm import audit, divergence, mixing

SCHEMA = "doc_id long, text string, lang string, source string, removed long, size int, term string"


@pytest.fixture(scope="module")
def corpus(spark):
    """Copies, ties, nulls everywhere, empty and long texts, a hot source, columns whose names operators use."""
    rng = random.Random(5)
    words = ["alpha", "beta", "Gamma", "ÉCOLE", "été", "don't", "x1y", "LOUD", "$5", "slow"]
    rows = []
    for i in range(160):
        text = " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 40, 250])))
        rows.append((i, text, rng.choice(["en", "fr", None]), rng.choice(["hot", "hot", "hot", "a", "b", "ü", None, ""]), 1, 2, "t"))
    rows += [(200 + i, rows[i][1], "en", "hot", 1, 2, "t") for i in range(30)]
    rows += [(5, rows[5][1], "en", "hot", 1, 2, "t"), (5, rows[5][1], "en", "hot", 1, 2, "t"), (None, rows[5][1], "en", "a", 1, 2, "t"), (None, None, None, None, None, None, None)]
    rows += [(300, None, "en", "a", 1, 2, "t"), (301, "", "en", "b", 1, 2, "t"), (302, "word " * 30000, "en", "a", 1, 2, "t"), (303, "no letters 123"[10:], "zz", "c", 1, 2, "t"), (304, "1 2", "zz", "d", 1, 2, "t")]
    return spark.createDataFrame(rows, SCHEMA)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 31), st.integers(0, 10**15), max_size=32))
def test_polynomial_is_the_audit_by_hand(counts):
    p = audit.RemovalPolynomial(counts, 5)
    corners = p.corners()
    assert all(corners[s] == sum(n for m, n in counts.items() if m & s) for s in range(32))
    for i in range(5):
        by_orders = sum(corners[sum(1 << j for j in o[: o.index(i) + 1])] - corners[sum(1 << j for j in o[: o.index(i)])] for o in permutations(range(5)))
        assert p.shapley(i) * math.factorial(5) == by_orders
        assert p.shapley(i) == sum((Fraction(n, m.bit_count()) for m, n in counts.items() if m >> i & 1), Fraction(0))


def test_audit_against_filters_run_in_order(spark, corpus):
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(0, 210)] + [(3, 1, None), (None, 1, 1), (7, None, 1)], "doc_id long, quality int, toxic int")
    rows = [r.asDict() for r in corpus.collect()]
    marks = {}
    for r in labels.where("doc_id IS NOT NULL").collect():
        good, toxic = marks.get(r.doc_id, (False, False))
        marks[r.doc_id] = (good or r.quality == 1, toxic or r.toxic == 1)
    for r in rows:
        t, w = r["text"] or "", words_of(r["text"])
        smaller = r["doc_id"] is not None and any(o["doc_id"] is not None and o["doc_id"] < r["doc_id"] and (o["text"] or "") == t for o in rows)
        r["fails"] = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": smaller}
        r["good"], r["toxic"] = marks.get(r["doc_id"], (False, False))
    want, total = {}, Counter()
    parts = {r["source"] or "" for r in rows}
    for part in parts:
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in rows if (r["source"] or "") == part]
            for step, letter in enumerate(order, 1):
                out, left = [r for r in left if r["fails"][letter]], [r for r in left if not r["fails"][letter]]
                all_failing = sum(r["fails"][letter] for r in rows if (r["source"] or "") == part)
                alone = sum(r["fails"][letter] and sum(r["fails"].values()) == 1 for r in rows if (r["source"] or "") == part)
                want[part, order, step] = [len(left), len(out), all_failing - len(out), alone, sum(r["good"] for r in out), sum(r["toxic"] for r in out)]
                total[part, letter] += len(out)
    got = {(r.part, r.filter_order, r.step): r for r in audit.audit(corpus, labels).collect()}
    assert len(got) == len(want) == 600 * len(parts)
    for (part, order, step), values in want.items():
        r = got[part, order, step]
        assert [r[c] for c in audit.COLUMNS] == [*values, total[part, order[step - 1]]] and r.filter == order[step - 1]
    assert audit.audit(corpus.limit(0), labels).count() == 0
    assert audit.audit(corpus, labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing the excess again until none is above."""
    names = sorted(sizes, key=lambda n: (n is None, n or ""))
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while len(fixed) < len(names):
        open_ = [n for n in names if n not in fixed]
        share = Fraction(total - sum(fixed.values()), sum(weight[n] for n in open_))
        above = [n for n in open_ if share * weight[n] > most * sizes[n]]
        if not above:
            return fixed | {n: share * weight[n] for n in open_}
        fixed |= {n: most * sizes[n] for n in above}
    return fixed


@pytest.mark.parametrize("params", [mixing.MixParams(), mixing.MixParams(block_words=37, shards=5, seed=3), mixing.MixParams(block_words=50, groups=2)])
def test_mix_meets_targets_with_disjoint_blocks(corpus, params):
    mixed = mixing.mix(corpus, params=params)
    rows = mixed.collect()
    assert len(rows) == corpus.count()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r.size
    want = plain_targets(sizes)
    taken, blocks, streams = Counter(), {}, {}
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(float(want[r.source]))
        covered = [0] * min(r.size, 100_000)
        for p in r.pieces:
            assert 0 <= p.start and p.length > 0 and p.start + p.length <= r.size and 0 <= p.shard < params.shards
            assert blocks.setdefault((r.group, p.block), p.shard) == p.shard
            taken[r.source] += p.length
            streams.setdefault((r.group, p.block), Counter())[r.source] += p.length
            for i in range(p.start, p.start + p.length):
                covered[i] += 1
        assert all(c <= 3 for c in covered) and max(covered, default=0) - min(covered, default=0) <= 1
    assert {s: taken[s] for s in sizes} == {s: math.floor(want[s] + Fraction(1, 2)) for s in sizes}
    # Exact quotas: shards hold equal numbers of blocks, and every block but a source's last is full.
    per_shard = Counter(blocks.values())
    assert max(per_shard.values()) - min(per_shard[k] for k in range(params.shards)) <= 1
    assert all(len(s) == 1 and sum(s.values()) <= params.block_words for s in streams.values())
    assert sum(sum(s.values()) < params.block_words for s in streams.values()) <= len(sizes)
    again = mixing.mix(corpus.repartition(7), params=params)
    key = lambda df: sorted((str(r.doc_id), r.size, str(r.source), r.taken) for r in df.select("doc_id", "size", "source", mixing.taken_words().alias("taken")).collect())
    assert key(again) == key(mixed)
    laid = mixing.in_order(mixed, params=params).collect()
    assert [r.shard for r in laid] == sorted(r.shard for r in laid) and sum(r.length for r in laid) == sum(taken.values())


def test_mix_edges(spark, corpus):
    assert mixing.mix(corpus.limit(0)).count() == 0
    empty = spark.createDataFrame([(1, None, "a"), (2, " \n", None)], "doc_id long, text string, source string")
    assert [(r.size, r.source_size, r.target, r.pieces) for r in mixing.mix(empty).collect()] == [(0, 0, 0.0, [])] * 2
    split = mixing.split_quotas([1000, 10, 0, 3], 16, 1)
    assert [sum(x) for x in zip(*split)] == [1000, 10, 0, 3] and {sum(x) for x in split} <= {63, 64}


def test_split_is_hypergeometric():
    """Mean and variance of a source's blocks in the first shard over many seeds."""
    draws = [mixing.split_quotas([60, 40], 2, s)[0][0] for s in range(4000)]
    mean = sum(draws) / len(draws)
    variance = sum((d - mean) ** 2 for d in draws) / len(draws)
    assert abs(mean - 30) < 0.2 and abs(variance - 50 * 0.6 * 0.4 * 50 / 99) < 0.4


def plain_divergence(rows, least, add=5, top=50):
    term = lambda t: ["".join(c.lower() if c < "\x80" else c for c in x) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    docs = [(r["lang"] or "", r["source"] or "", Counter(term(r["text"]))) for r in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        have = Counter(t for d in own for t in d[2])
        kept = sorted(t for t, n in have.items() if n >= least)
        groups = {s: Counter() for s in {d[1] for d in own}}
        for _, s, c in own:
            groups[s].update({t: c[t] for t in kept if c[t]})
        share = lambda c: {t: 1 + 10**9 * (c[t] + add) // (sum(c.values()) + add * len(kept)) for t in kept}  # noqa: E731, B023
        whole = share(sum(groups.values(), Counter()))
        p = {s: share(c) for s, c in groups.items()}
        for s in groups:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in groups if o != s]
            terms = [(t, p[s][t] - whole[t]) for t in kept if groups[s][t] and p[s][t] > whole[t]]
            order = lambda xs: sorted(xs, key=lambda x: (-x[1], x[0].encode()))
            out |= {(lang, s, "pair", i, v, k) for k, (i, v) in enumerate(order(pairs), 1)} | {(lang, s, "term", i, v, k) for k, (i, v) in enumerate(order(terms)[:top], 1)}
    return out


@pytest.mark.parametrize("params", [divergence.DivergenceParams(), divergence.DivergenceParams(least_docs=2, block=2, chunk_terms=3, slab_chunks=2, top=3, slice_bytes=500)])
def test_divergence_against_plain_version(corpus, params):
    got = [tuple(r) for r in divergence.divergence(corpus, params=params).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_divergence([r.asDict() for r in corpus.collect()], params.least_docs, params.add, params.top)


def test_divergence_of_many_groups(spark):
    """Several blocks of groups a side, terms that only one group has, and groups without terms."""
    rows = [(i, f"shared own{i % 23} " * (i % 7) + ("extra" if i % 2 else ""), "en", f"s{i % 23:02d}") for i in range(400)] + [(900 + i, None, "en", f"none{i}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    params = divergence.DivergenceParams(least_docs=5, block=4, chunk_terms=2, slab_chunks=1)
    got = {tuple(r) for r in divergence.divergence(docs, params=params).collect()}
    assert got == plain_divergence([r.asDict() for r in docs.collect()], 5)
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_shares_are_exact_for_large_counts(spark):
    import numpy as np

    n, whole = 9_000_000_000_000_000 // 2, 9_000_000_000_000_011
    assert int(divergence.shares(np.array([[n]]), np.array([whole]), 5)[0, 0]) == 1 + 10**9 * (n + 5) // whole
    row = spark.range(1).select(divergence._share(F.lit(n), F.lit(whole), divergence.DivergenceParams()).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 5) // whole
