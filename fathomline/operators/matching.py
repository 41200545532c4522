"""The best match of each line of one segment, from blocks of lines: no row is written for a pair.

Scores are those of ``lines.match_score`` with the overlap of ``lines.overlap_share``. A pair's boxes and names bound its
score, so of the pairs that meet only those get a distance, and of these only those an overlap, that can still be best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.operators.blocks import _part, _sortable, first_of_copies, met, number
from fathomline.operators.lines import best_match, match_score

#: Right blocks that are held for a left one, and pairs that are looked at at once.
HELD, PAIRS = 32, 2**16

#: More than what rounding to nine digits moves a score by.
HAIR = 1e-8

#: Columns of the ends of both sides' segments.
OURS, THEIRS = ("ax", "ay", "bx", "by"), ("cx", "cy", "dx", "dy")

Ends = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _nine(v: np.ndarray) -> np.ndarray:
    return np.trunc(v * 1e9 + np.copysign(0.5, v)) / 1e9


def _turn(ax, ay, bx, by, px, py):
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def _to_segment(px, py, ax, ay, bx, by):
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = ((px - ax) * dx + (py - ay) * dy) / np.where(square > 0, square, 1.0)
    t = np.clip(t, 0.0, 1.0)
    x, y = px - (ax + t * dx), py - (ay + t * dy)
    return np.sqrt(x * x + y * y)


def distances(s: Ends, o: Ends) -> np.ndarray:
    """Distances of pairs of segments, as ``lines.segment_distance``."""
    (ax, ay, bx, by), (cx, cy, dx, dy) = s, o
    cross = (_turn(*s, cx, cy) * _turn(*s, dx, dy) < 0) & (_turn(*o, ax, ay) * _turn(*o, bx, by) < 0)
    ends = np.minimum(np.minimum(_to_segment(ax, ay, *o), _to_segment(bx, by, *o)), np.minimum(_to_segment(cx, cy, *s), _to_segment(dx, dy, *s)))
    return np.where(cross, 0.0, ends)


def _between(at, step, low, high):
    """The t with low <= at + t * step <= high; an empty range is (1, 0)."""
    some = step != 0
    by = np.where(some, step, 1.0)
    one, two = (low - at) / by, (high - at) / by
    inside = (at >= low) & (at <= high)
    return np.where(some, np.minimum(one, two), np.where(inside, 0.0, 1.0)), np.where(some, np.maximum(one, two), np.where(inside, 1.0, 0.0))


def overlaps(s: Ends, o: Ends, reach: float) -> np.ndarray:
    """Shares of segments within reach of another one, as ``lines.overlap_share``: what is near one segment is one range."""
    (ax, ay, bx, by), (cx, cy, dx, dy) = s, o
    ux, uy, vx, vy = bx - ax, by - ay, dx - cx, dy - cy
    uu, vv = ux * ux + uy * uy, vx * vx + vy * vy
    low, high = np.full(len(uu), np.inf), np.full(len(uu), -np.inf)

    def add(ok, lo, hi):
        lo, hi = np.maximum(lo, 0.0), np.minimum(hi, 1.0)
        ok = ok & (hi > lo)
        np.minimum(low, lo, out=low, where=ok)
        np.maximum(high, hi, out=high, where=ok)

    for ex, ey in ((cx, cy), (dx, dy)):
        wx, wy = ax - ex, ay - ey
        uw = ux * wx + uy * wy
        left = uw * uw - uu * (wx * wx + wy * wy - reach * reach)
        root, by_uu = np.sqrt(np.maximum(left, 0.0)), np.where(uu > 0, uu, 1.0)
        add((left >= 0) & (uu > 0), (-uw - root) / by_uu, (-uw + root) / by_uu)
    wx, wy = ax - cx, ay - cy
    along = _between(wx * vx + wy * vy, ux * vx + uy * vy, 0.0, vv)
    aside = _between(vx * wy - vy * wx, vx * uy - vy * ux, -reach * np.sqrt(vv), reach * np.sqrt(vv))
    add(vv > 0, np.maximum(along[0], aside[0]), np.minimum(along[1], aside[1]))
    length = np.sqrt(uu)
    return np.minimum(1.0, length * np.where(high > low, high - low, 0.0) / np.maximum(length, 1.0))


class _Side:
    """Ends, boxes, names and keys of rows; ``sides`` puts some together, in the order of their names."""

    def __init__(self, ends: Ends, key: np.ndarray, name: np.ndarray):
        self.ends, self.key, self.name = ends, key, name
        ax, ay, bx, by = ends
        self.low, self.high = (np.minimum(ax, bx), np.minimum(ay, by)), (np.maximum(ax, bx), np.maximum(ay, by))
        self.box = [(lo.min(), hi.max()) for lo, hi in zip(self.low, self.high)]

    @classmethod
    def of(cls, block: pa.RecordBatch, key: str, name: str, ends: tuple[str, ...]) -> _Side:
        return cls(tuple(number(block, c) for c in ends), number(block, key), number(block, name))

    @classmethod
    def sides(cls, several: list[_Side]) -> _Side:
        name = np.concatenate([o.name for o in several])
        by = np.argsort(name, kind="stable")
        return cls(tuple(np.concatenate(e)[by] for e in zip(*(o.ends for o in several))), np.concatenate([o.key for o in several])[by], name[by])


class _Matches:
    """The best match so far of each row of a left block."""

    def __init__(self, mine: _Side, reach: float, buffer: float):
        self.mine, self.reach, self.buffer = mine, reach, buffer
        self.near = buffer * (1 + 1e-6) + 1e-6
        self.score = np.full(len(mine.key), -np.inf)
        self.rows = None

    def most(self, gap, name: float):
        """What no score at this distance or farther exceeds."""
        return match_score(gap <= self.near, name, gap, self.reach)

    def add(self, several: list[_Side]) -> None:
        """Meet right blocks, but for those whose box is too far for any row to gain: first rows of one name, then, where a score may still be less, the others."""
        gap = [max(max(a[0] - b[1], b[0] - a[1], 0.0) for a, b in zip(self.mine.box, o.box)) for o in several]
        floor = self.score.min() - HAIR
        several = [o for g, o in zip(gap, several) if g <= self.reach * (1 + 1e-9) and self.most(np.float64(g), 1.0) >= floor]
        if not several:
            return
        other = _Side.sides(several)
        begin, end = (np.searchsorted(other.name, self.mine.name, side) for side in ("left", "right"))
        self._runs(other, np.arange(len(begin)), begin, end, 1.0)
        rows = np.flatnonzero(self.score - HAIR <= self.most(np.float64(0.0), 0.0))
        self._runs(other, rows, np.zeros_like(begin[rows]), begin[rows], 0.0)
        self._runs(other, rows, end[rows], np.full_like(end[rows], len(other.key)), 0.0)

    def _runs(self, other: _Side, rows: np.ndarray, begin: np.ndarray, end: np.ndarray, name: float) -> None:
        """Pairs of each of the rows and a run of right rows, at most about PAIRS at once."""
        upto = np.cumsum(end - begin)
        cuts = np.searchsorted(upto, np.arange(PAIRS, upto[-1] + PAIRS, PAIRS)) + 1 if len(rows) else []
        for low, high in zip(np.r_[0, cuts], cuts):
            some = slice(int(low), int(high))
            many = end[some] - begin[some]
            if many.sum():
                at = np.repeat(rows[some], many)
                to = np.arange(len(at)) + np.repeat(begin[some] - np.cumsum(many) + many, many)
                self._pairs(other, at, to, name)

    def _pairs(self, other: _Side, at: np.ndarray, to: np.ndarray, name: float) -> None:
        mine = self.mine
        gap = np.zeros(len(at))
        for axis in (0, 1):
            np.maximum(gap, mine.low[axis][at] - other.high[axis][to], out=gap)
            np.maximum(gap, other.low[axis][to] - mine.high[axis][at], out=gap)
        most = self.most(gap, name)
        may = np.flatnonzero((most >= self.score[at] - HAIR) & (gap <= self.reach * (1 + 1e-9)) & (mine.key[at] != other.key[to]))
        if not len(may):
            return
        at, to, gap, most = at[may], to[may], gap[may], most[may]
        # The nearest pair of each row first, as its score leaves out most of the others.
        rank = gap * 1000
        for axis in (0, 1):
            rank += np.abs(mine.low[axis][at] - other.low[axis][to])
        new = np.r_[True, at[1:] != at[:-1]]
        first = np.flatnonzero(rank == np.minimum.reduceat(rank, np.flatnonzero(new))[np.cumsum(new) - 1])
        first = first[np.r_[True, at[first][1:] != at[first][:-1]]]
        self._scored(other, at[first], to[first], name)
        rest = most >= self.score[at] - HAIR
        rest[first] = False
        self._scored(other, at[rest], to[rest], name)

    def _scored(self, other: _Side, at: np.ndarray, to: np.ndarray, name: float) -> None:
        distance = distances(tuple(e[at] for e in self.mine.ends), tuple(e[to] for e in other.ends))
        may = distance <= self.reach
        may &= self.most(distance, name) >= self.score[at] - HAIR
        at, to, distance = at[may], to[may], distance[may]
        overlap, near = np.zeros(len(at)), distance <= self.near
        overlap[near] = overlaps(tuple(e[at[near]] for e in self.mine.ends), tuple(e[to[near]] for e in other.ends), self.buffer)
        overlap, distance = _nine(overlap), _nine(distance)
        score = _nine(match_score(overlap, name, distance, self.reach))
        good = score >= self.score[at]
        if not good.any():
            return
        rows = [at[good], score[good], overlap[good], np.full(good.sum(), name), distance[good], other.key[to[good]]]
        if self.rows is not None:
            rows = [np.concatenate(c) for c in zip(self.rows, rows)]
        order = np.lexsort([_sortable(pa.array(rows[5])), rows[4], -rows[3], -rows[2], -rows[1], rows[0]])
        order = order[np.r_[True, rows[0][order][1:] != rows[0][order][:-1]]]
        self.rows = [c[order] for c in rows]
        self.score[self.rows[0]] = self.rows[1]


def _best_within(left: DataFrame, right: DataFrame, key: str, right_key: str, radius: float, side: float, reach: float, buffer: float) -> DataFrame:
    """The best match of each left row among the right ones within radius at least."""
    middle = lambda p, q: (F.col(p) + F.col(q)) / 2
    blocks = met(left, right, side, [(middle("ax", "bx"), middle("cx", "dx")), (middle("ay", "by"), middle("cy", "dy"))], then=("name", "other_name"))
    ours, theirs = left.columns, right.columns
    numbers = ["score", "overlap", "name_similarity", "distance"]
    schema = T.StructType([left.schema[key], *(T.StructField(n, T.DoubleType()) for n in numbers), right.schema[right_key]])

    def emit(found: _Matches) -> Iterator[pa.RecordBatch]:
        if found.rows is not None:
            at, *rest, candidate = found.rows
            yield pa.RecordBatch.from_arrays([pa.array(found.mine.key[at]), *(pa.array(c, pa.float64()) for c in rest), pa.array(candidate)], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, found, held = None, None, []
        for batch in batches:
            for row, now in enumerate(batch.column(0).to_pylist()):
                if now != block:
                    if found is not None:
                        found.add(held)
                        yield from emit(found)
                    block, found, held = now, _Matches(_Side.of(_part(batch, row, ours), key, "name", OURS), reach, buffer), []
                held.append(_Side.of(_part(batch, row, theirs), right_key, "other_name", THEIRS))
                if len(held) == HELD:
                    found.add(held)
                    held = []
        if found is not None:
            found.add(held)
            yield from emit(found)

    return blocks.mapInArrow(run, schema)


def best_segment_matches(left: DataFrame, right: DataFrame, key: str, right_key: str, reach: float = 60.0, buffer: float = 12.0) -> DataFrame:
    """(key, right key, distance, overlap, name_similarity, score) of the best match of each segment, as ``lines.best_match`` has it.

    The left side has key, name, ax, ay, bx, by, the right side its key, other_name, cx, cy, dx, dy. Names are alike (1) or
    not (0); numbers are rounded to nine digits. Rows whose keys are equal are no pair. Rows with a null or an end that is no
    finite number match none. Segments without a match are left out. Cells are as wide as the longest segment and the
    radius: first all pairs meet that can share some length, and then, in wider cells, rows that have found no score
    above all that is farther.
    """
    from fathomline.session import discard, materialize

    ours, theirs = [key, "name", *OURS], [right_key, "other_name", *THEIRS]
    whole = lambda df, names: df.select(*names).where(" AND ".join([f"{n} IS NOT NULL" for n in names[:2]] + [f"abs({n}) < double('Infinity')" for n in names[2:]]))
    todo = mine = whole(left, ours)
    few = materialize(first_of_copies(whole(right, theirs).distinct(), right_key, 2), "right")
    span = lambda df, a, b, c, d: df.agg(F.max(F.hypot(F.col(c) - F.col(a), F.col(d) - F.col(b)))).first()[0] or 0.0
    longest = max(span(mine, *OURS), span(few, *THEIRS))
    near, done = buffer * (1 + 1e-6) + 1e-6, None
    for radius in ([near] if near < reach else []) + [reach]:
        found = materialize(best_match(_best_within(todo, few, key, right_key, radius, (radius + longest) * (1 + 1e-9), reach, buffer), key, right_key), "matches")
        if radius < reach:
            found = found.where(F.col("score") > match_score(F.lit(0.0), F.lit(1.0), F.lit(radius), reach) + HAIR)
            todo = materialize(mine.join(found.select(key), key, "left_anti"), "todo")
        done = found if done is None else done.unionByName(found)
        if todo.isEmpty():
            break
    if todo is not mine:
        discard(todo)
    discard(few)
    return done
