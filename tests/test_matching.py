"""Best matches of segments in blocks against the pairs of the line join."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.operators import blocks, lines, matching


def segment(names):
    a, b, c, d = names
    return F.array(F.struct(F.col(a).alias("x"), F.col(b).alias("y")), F.struct(F.col(c).alias("x"), F.col(d).alias("y")))


@pytest.mark.parametrize("names", [[1, 2, 3], [f"n{i}" for i in range(400)]])
def test_best_segment_matches(spark, monkeypatch, names):
    """Crowded, crossing and equal segments, points and lone ones; before, all pairs within reach got a row and a window."""
    monkeypatch.setattr(blocks, "RIGHT", 16)  # many blocks in a cell
    random.seed(3)
    at = lambda w: random.uniform(-w, w)
    ends = []
    for _ in range(240):
        x, y = random.choice([(at(9), at(9)), (at(150), at(40)), (3.0, 4.0)])
        ends.append((x, y, x + random.choice([20.0, 20.0, at(30)]), y + random.choice([0.0, 3.0, at(9)])))
    ends += [(5.0, 5.0, 25.0, 5.0)] * 4 + [(900.0, 0.0, 910.0, 0.0), (955.0, 0.0, 956.0, 1.0), (4000.0, 0.0, 4001.0, 0.0), (-300.0, 0.0, 300.0, 60.0)]
    rows = [(i, random.choice(names), *e) for i, e in enumerate(ends)]
    odd = [(500, names[0], float("nan"), 0.0, 1.0, 0.0), (501, names[0], None, 0.0, 1.0, 0.0), (502, None, 0.0, 0.0, 1.0, 0.0), (None, names[0], 0.0, 0.0, 1.0, 0.0), (503, names[0], 0.0, 0.0, float("inf"), 0.0)]
    kind = "string" if isinstance(names[0], str) else "int"
    of = lambda r, key, name, four: spark.createDataFrame(r, f"{key} long, {name} {kind}, " + ", ".join(f"{c} double" for c in four))
    left, right = of(rows + odd, "id", "name", matching.OURS), of(rows + rows[:5] + odd, "candidate", "other_name", matching.THEIRS)
    got = {r.id: r for r in matching.best_segment_matches(left, right, "id", "candidate").collect()}

    p, q = of(rows, "id", "name", matching.OURS).withColumn("p", segment(matching.OURS)), of(rows, "candidate", "other_name", matching.THEIRS).withColumn("q", segment(matching.THEIRS))
    pairs = lines.line_join(p, q, "p", "q", 60.0).where("id <> candidate").withColumn("overlap", F.round(lines.overlap_share(F.col("p"), F.col("q"), 12.0), 9))
    pairs = pairs.withColumn("distance", F.round("distance", 9)).withColumn("name_similarity", (F.col("name") == F.col("other_name")).cast("double"))
    pairs = pairs.withColumn("score", F.round(lines.match_score(F.col("overlap"), F.col("name_similarity"), F.col("distance")), 9))
    want = {r.id: r for r in lines.best_match(pairs, "id", "candidate").collect()}
    assert set(got) == set(want) and 244 in got and 246 not in got
    for k, r in want.items():
        assert got[k].candidate == r.candidate, (got[k], r)
        assert (got[k].distance, got[k].overlap, got[k].name_similarity, got[k].score) == pytest.approx((r.distance, r.overlap, r.name_similarity, r.score), abs=2e-9)


@pytest.mark.parametrize("most", [1, 50, 10**6])
def test_matches_of_blocks_in_any_order(monkeypatch, most):
    """However pairs are cut and blocks come, the best is that of all pairs."""
    monkeypatch.setattr(matching, "PAIRS", most)
    rng = np.random.default_rng(8)

    def side(n, first):
        x, y = rng.uniform(0, 90, n), rng.uniform(0, 30, n)
        return matching._Side((x, y, x + 20, y + rng.integers(0, 4, n)), np.arange(first, first + n), rng.integers(0, 3, n))

    mine, others = side(40, 0), [side(30, 20 + 30 * i) for i in range(5)]
    found = matching._Matches(mine, 60.0, 12.0)
    for some in (others[3:], others[:1], others[1:3]):
        found.add(some)
    every = matching._Side.sides(others)
    at, to = (v.ravel() for v in np.meshgrid(np.arange(40), np.arange(150), indexing="ij"))
    s, o = tuple(e[at] for e in mine.ends), tuple(e[to] for e in every.ends)
    distance, name = matching._nine(matching.distances(s, o)), (mine.name[at] == every.name[to]).astype(float)
    overlap = np.where(distance <= 12, matching._nine(matching.overlaps(s, o, 12.0)), 0.0)
    score = matching._nine(lines.match_score(overlap, name, distance))
    want = {}
    for i, k in zip(at, zip(-score, -overlap, -name, distance, every.key[to])):
        if mine.key[i] != k[-1] and k[3] <= 60:
            want[i] = min(want.get(i, k), k)
    assert {i: (-a, -b, -c, d, k) for i, a, b, c, d, k in zip(*found.rows)} == want and len(want) == 40


def test_best_segment_matches_of_few(spark):
    none = spark.createDataFrame([], "id long, name int, ax double, ay double, bx double, by double")
    other = spark.createDataFrame([(1, 1, 0.0, 0.0, 20.0, 0.0)], "candidate long, other_name int, cx double, cy double, dx double, dy double")
    assert matching.best_segment_matches(none, other, "id", "candidate").count() == 0
    one = spark.createDataFrame([(1, 1, 0.0, 0.0, 20.0, 0.0), (2, 2, 0.0, 60.0, 20.0, 60.0), (3, 1, 0.0, 60.5, 20.0, 61.0)], none.schema)
    assert [tuple(r) for r in matching.best_segment_matches(one, other, "id", "candidate").select("id", "candidate", "distance", "overlap", "score").collect()] == [(2, 1, 60.0, 0.0, -0.3)]
    assert matching.best_segment_matches(one, other, "id", "candidate", reach=10.0).count() == 0
