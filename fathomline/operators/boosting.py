"""Boosted regression trees on binned features, many fits at once.

A fit is a model: a target, a whole-numbered weight per row (0: not in its training part, k:
drawn k times) and the features it may use. Folds, bootstrap replicates, drop-one and
with/without comparisons are lists of models over one frame, which is binned once.

Bins are the distinct values of a feature, or its quantiles where there are more than
``bins``; missing values (null, NaN) have a bin of their own. A round grows one tree per
model, best split first, to at most ``leaves`` leaves of ``least_rows`` rows. A split's gain is
G_l^2 / (H_l + penalty) + G_r^2 / (H_r + penalty) - G^2 / (H + penalty) from sums of gradients
and Hessians; missing values go to the side with the larger gain (right if equal, and to the
larger side where training had none). Leaf values are -G / (H + penalty), for the absolute
loss the median of the leaf's residuals, times ``rate``. The start is the median, the mean, or
the logarithm of the mean (Poisson).

Growing is a dialogue: a ``Grower`` per model asks for the histograms of nodes and gets each
node's best split back. They are answered in one of two ways, with equal trees:

* by levels: one aggregation per level over the binned rows for all models, keyed by (model,
  node, feature), summed in the map tasks first; the driver sees one candidate per key. Medians
  are selected by counts of 16 bits at a time, so no leaf's rows are gathered.
* a model per task, where the whole binned frame has at most ``resident_rows`` rows: rows are
  sent once to each model that uses them. In a larger frame, rows with the same codes (a cell) get
  the same prediction and always stand in the same node. For the absolute loss a task holds of each
  row only the target, sorted in its cell, up to ``CELL_ROWS`` times as many: trees grow over cells,
  and rows are touched once a round, for the medians. For the other losses, whose sums are linear in
  the target, one row with the mean target stands for its cell. Where no model has more than
  ``resident_rows`` merged rows, a task holds these; all else is fitted by levels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.session import discard, materialize

#: A row of a cell takes a few numbers where a row of its own takes a code for each feature and node.
CELL_ROWS = 16


@dataclass(frozen=True)
class BoostParams:
    loss: str = "absolute"
    rounds: int = 250
    rate: float = 0.05
    leaves: int = 15
    least_rows: int = 20
    penalty: float = 1.0
    bins: int = 255
    least_hessian: float = 1e-3
    resident_rows: int = 1 << 18
    #: Rounds after which running predictions are written again (by levels).
    refresh: int = 20

    def __post_init__(self) -> None:
        if self.loss not in ("absolute", "squared", "poisson") or not 2 <= self.bins <= 255:
            raise ValueError(f"no such loss or number of bins: {self.loss}, {self.bins}")


@dataclass(frozen=True)
class Model:
    """One fit; target and weight are columns of the frame (weight: whole numbers), without a list it uses all features."""

    name: str
    target: Column
    weight: Column
    features: tuple[str, ...] | None = None


@dataclass
class Tree:
    """Nodes in arrays; a leaf has feature -1. Rows with a code up to ``bin`` go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, at: int, missing_left: bool) -> int:
        """Make a node internal; the number of its left child, whose sibling is the next."""
        child = len(self.feature)
        self.feature[node], self.bin[node], self.missing_left[node], self.left[node] = feature, at, missing_left, child
        for column, blank in ((self.feature, -1), (self.bin, 0), (self.missing_left, False), (self.left, -1), (self.value, 0.0)):
            column += [blank, blank]
        return child

    def nodes_of(self, codes: np.ndarray, missing: int) -> np.ndarray:
        """The leaf of each row."""
        feature, at, low, left = np.array(self.feature), np.array(self.bin), np.array(self.missing_left), np.array(self.left)
        node = np.zeros(len(codes), dtype=np.int64)
        rows = np.arange(len(codes))
        while len(rows := rows[feature[node[rows]] >= 0]):
            here = node[rows]
            code = codes[rows, feature[here]]
            goes = np.where(code == missing, low[here], code <= at[here])
            node[rows] = left[here] + ~goes
        return node


def gradients(loss: str, y: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if loss == "absolute":
        return np.where(raw > y, 1.0, -1.0), np.ones(len(y))
    if loss == "squared":
        return raw - y, np.ones(len(y))
    mean = np.exp(raw)
    return mean - y, mean


def histograms(codes: np.ndarray, slot: np.ndarray, slots: int, g: np.ndarray, h: np.ndarray, w: np.ndarray, width: int) -> np.ndarray:
    """Sums of gradient, Hessian and rows (slots x features x bins x 3) over rows in slots 0 to slots - 1."""
    n_features = codes.shape[1]
    out = np.empty((slots, n_features, width, 3))
    for f in range(n_features):
        key = slot * width + codes[:, f]
        for i, v in enumerate((g * w, h * w, w)):
            out[:, f, :, i] = np.bincount(key, weights=v, minlength=slots * width).reshape(slots, width)
    return out


Split = tuple[float, int, bool, np.ndarray, np.ndarray]


def best_splits(hist: np.ndarray, params: BoostParams) -> list[Split | None]:
    """(gain, bin, missing_left, left sums, sums) of each histogram (histograms x bins x 3, the last bin missing); None without a split."""
    whole, gap, upto = hist.sum(axis=1), hist[:, -1], np.cumsum(hist[:, :-1], axis=1)
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + params.penalty)
    base = score(whole)
    rows, each = np.arange(len(hist)), []
    for left in (upto, upto + gap[:, None]):
        # Without missing rows the last bin would leave nothing on the right; with them it parts them from all others.
        right = whole[:, None] - left
        ok = (left[..., 2] >= params.least_rows) & (right[..., 2] >= params.least_rows) & (left[..., 1] >= params.least_hessian) & (right[..., 1] >= params.least_hessian)
        gain = np.where(ok, score(left) + score(right) - base[:, None], -np.inf)
        at = np.argmax(gain, axis=1)
        each.append((gain[rows, at], at, left[rows, at]))
    low = (each[1][0] > each[0][0]) & (gap[:, 2] > 0)
    gain, at = (np.where(low, each[1][i], each[0][i]) for i in (0, 1))
    left = np.where(low[:, None], each[1][2], each[0][2])
    goes = np.where(gap[:, 2] > 0, low, 2 * left[:, 2] >= whole[:, 2])
    good = gain > 1e-9 * np.maximum(1.0, np.abs(base))
    return [(float(gain[i]), int(at[i]), bool(goes[i]), left[i], whole[i]) if good[i] else None for i in range(len(hist))]


class Grower:
    """Grows one tree, best split first, from best splits of nodes that it asks for.

    ``wanted`` are nodes of ``tree`` whose splits are unknown. Nodes are split as soon as they could still be among the
    best, so that a level of all models is answered at once; ``finish`` keeps the splits that best-first order makes.
    """

    def __init__(self, params: BoostParams, allowed: np.ndarray):
        self.params, self.allowed, self.tree = params, allowed, Tree()
        self.found: dict[int, tuple | None] = {}
        self.sums: dict[int, np.ndarray] = {}
        self.wanted = [0]
        #: Numbers of the finished tree's leaves by those of the growing one.
        self.leaves: dict[int, int] = {}

    def feed(self, node: int, candidates: list[tuple[int, tuple]]) -> None:
        """candidates: (feature, its best split) of one node."""
        allowed = [c for c in candidates if self.allowed[c[0]] and c[1] is not None]
        self.found[node] = min(allowed, key=lambda c: (-c[1][0], c[0])) if allowed else None

    def _order(self) -> list[int]:
        """Splits that best-first order makes among those known, at most leaves - 1."""
        open_, made = [0], []
        while len(made) < self.params.leaves - 1:
            ready = [n for n in open_ if self.found.get(n)]
            if not ready:
                break
            node = min(ready, key=lambda n: (-self.found[n][1][0], n))
            open_.remove(node)
            made.append(node)
            if self.tree.feature[node] >= 0:
                open_ += [self.tree.left[node], self.tree.left[node] + 1]
        return made

    def advance(self) -> None:
        """Split every node that best-first order reaches; their children are wanted next."""
        self.wanted = []
        for node in self._order():
            if self.tree.feature[node] < 0:
                feature, (_, at, low, left, whole) = self.found[node]
                child = self.tree.split(node, feature, at, low)
                self.sums[child], self.sums[child + 1] = left, whole - left
                # A child too small to be split again is a leaf, and no histogram is needed.
                self.wanted += [c for c in (child, child + 1) if self.sums[c][2] >= 2 * self.params.least_rows]

    def finish(self) -> Tree:
        """The tree of the splits that were made, with nodes numbered anew and values of leaves from their sums."""
        made, out = set(self._order()), Tree()
        todo = [(0, 0)]
        while todo:
            old, new = todo.pop()
            if old in made:
                child = out.split(new, self.tree.feature[old], self.tree.bin[old], self.tree.missing_left[old])
                todo += [(self.tree.left[old], child), (self.tree.left[old] + 1, child + 1)]
                continue
            self.leaves[old] = new
            if old in self.sums:
                g, h, _ = self.sums[old]
                out.value[new] = float(-g / (h + self.params.penalty) * self.params.rate)
        return out


def weighted_median(values: np.ndarray, weights: np.ndarray) -> float:
    """Median of values repeated by whole weights; the mean of the middle two."""
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(weights[order])
    total = int(upto[-1])
    low, high = (values[order[np.searchsorted(upto, r, side="right")]] for r in ((total - 1) // 2, total // 2))
    return float((low + high) / 2)


def start_value(loss: str, y: np.ndarray, w: np.ndarray) -> float:
    if not w.sum():
        return 0.0
    if loss == "absolute":
        return weighted_median(y, w)
    mean = float((y * w).sum() / w.sum())
    return mean if loss == "squared" else float(np.log(max(mean, 1e-12)))


def fit_resident(codes: np.ndarray, y: np.ndarray, w: np.ndarray, allowed: np.ndarray, params: BoostParams) -> tuple[float, list[Tree]]:
    """One model on rows that one task holds."""
    width = params.bins + 1
    start = start_value(params.loss, y, w)
    raw, trees = np.full(len(y), start), []
    for _ in range(params.rounds):
        g, h = gradients(params.loss, y, raw)
        grower = Grower(params, allowed)
        node = np.zeros(len(y), dtype=np.int64)
        while grower.wanted:
            slots = np.full(len(grower.tree.feature), -1)
            slots[grower.wanted] = np.arange(len(grower.wanted))
            slot = slots[node]
            held = slot >= 0
            hist = histograms(codes[held], slot[held], len(grower.wanted), g[held], h[held], w[held], width)
            splits = best_splits(hist.reshape(-1, width, 3), params)
            for i, one in enumerate(grower.wanted):
                grower.feed(one, list(enumerate(splits[i * codes.shape[1] : (i + 1) * codes.shape[1]])))
            grower.advance()
            node = grower.tree.nodes_of(codes, params.bins)
        tree = grower.finish()
        leaf = tree.nodes_of(codes, params.bins)
        if params.loss == "absolute" and len(tree.feature) > 1:
            order = np.argsort(leaf, kind="stable")
            begins = np.searchsorted(leaf[order], np.arange(len(tree.feature) + 1))
            for one in np.unique(leaf).tolist():
                rows = order[begins[one] : begins[one + 1]]
                tree.value[one] = weighted_median((y - raw)[rows], w[rows]) * params.rate
        trees.append(tree)
        raw = raw + np.array(tree.value)[leaf]
    return start, trees


def median(values: np.ndarray) -> float:
    """Median as weighted_median has it; the order of values is lost."""
    low = (len(values) - 1) // 2
    values.partition(low)
    high = values[low] if len(values) % 2 else values[low + 1 :].min()
    return float((values[low] + high) / 2)


def fit_cells(codes: np.ndarray, begins: np.ndarray, y: np.ndarray, w: np.ndarray, allowed: np.ndarray, params: BoostParams) -> tuple[float, list[Tree]]:
    """One model of the absolute loss, with the trees of fit_resident; codes of each cell, whose rows y[begins[i]:begins[i + 1]] are sorted."""
    missing, width, n_cells, n_features = params.bins, params.bins + 1, *codes.shape
    even = w.sum() <= 4 * len(w)
    if even:  # rows drawn twice stand there twice, and no weights are needed
        begins, y = np.r_[0, np.cumsum(w)].astype(np.int64)[begins], np.repeat(y, w.astype(np.int64))
        w = np.ones(len(y))
    first, after, rows = begins[:-1], begins[1:], np.diff(begins)
    before = np.r_[0.0, np.cumsum(w)]
    weight = before[after] - before[first]
    columns = np.ascontiguousarray(codes.T)
    start = start_value(params.loss, y, w)
    raw, trees = np.full(n_cells, start), []

    # A gradient is at most as large as its weight, so sums of both fit into one float without rounding.
    unit = float(1 << 26) if before[-1] < 1 << 25 else 0.0

    def tally(cells: np.ndarray, values: tuple[np.ndarray, ...]) -> np.ndarray:
        """As histograms, for one node. All sums are whole numbers, so differences of them are exact."""
        values = (values[1] * unit + values[0],) if unit else values
        held = [v[cells] for v in values]
        out = np.empty((n_features, width, 3))
        for f in range(n_features):
            at = columns[f][cells]
            sums = [np.bincount(at, weights=v, minlength=width) for v in held]
            n = np.rint(sums[0] / unit) if unit else sums[1]
            out[f, :, 0], out[f, :, 1], out[f, :, 2] = (sums[0] - n * unit if unit else sums[0]), n, n
        return out

    def under(raw: np.ndarray) -> np.ndarray:
        """The first row of each cell that is not below its prediction."""
        if len(y) <= 16 * n_cells:  # a look at each row costs less than a search in each cell
            upto = np.r_[0, np.cumsum(y < np.repeat(raw, rows))]
            return first + upto[after] - upto[first]
        low, high = first.copy(), after.copy()
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_]) // 2
            below = y[middle] < raw[open_]
            low[open_[below]], high[open_[~below]] = middle[below] + 1, middle[~below]
        return low

    for _ in range(params.rounds):
        low = under(raw)
        sums = 2 * (before[low] - before[first]) - weight, weight
        grower = Grower(params, allowed)
        cells = {0: np.arange(n_cells)}
        hists = {0: tally(cells[0], sums)}
        while grower.wanted:
            splits = best_splits(np.concatenate([hists[one] for one in grower.wanted]), params)
            for i, one in enumerate(grower.wanted):
                grower.feed(one, list(enumerate(splits[i * n_features : (i + 1) * n_features])))
            tree, known = grower.tree, len(grower.tree.feature)
            grower.advance()
            for left in range(known, len(tree.feature), 2):
                node = tree.left.index(left)
                code = columns[tree.feature[node]][cells[node]]
                goes = np.where(code == missing, tree.missing_left[node], code <= tree.bin[node])
                cells[left], cells[left + 1] = cells[node][goes], cells[node][~goes]
                if {left, left + 1} & set(grower.wanted):
                    small = left if len(cells[left]) <= len(cells[left + 1]) else left + 1
                    hists[small] = tally(cells[small], sums)
                    hists[2 * left + 1 - small] = hists[node] - hists[small]
        tree = grower.finish()
        if len(tree.feature) > 1:
            order = np.concatenate([cells[one] for one in grower.leaves])
            n = rows[order]
            ends = np.cumsum(n)
            take = np.arange(ends[-1]) + np.repeat(first[order] - (ends - n), n)
            rest = y[take] - np.repeat(raw[order], n)
            cell = row = 0
            for old, new in grower.leaves.items():
                upto = cell + len(cells[old])
                end = int(ends[upto - 1]) if upto else 0
                if end > row:
                    tree.value[new] = (median(rest[row:end]) if even else weighted_median(rest[row:end], w[take[row:end]])) * params.rate
                raw[cells[old]] += tree.value[new]
                cell, row = upto, end
        trees.append(tree)
    return start, trees


@dataclass
class Ensemble:
    """Fitted models: for each a start and its trees, over shared bins; size is bounded by the parameters and the models."""

    features: list[str]
    edges: list[np.ndarray]
    names: list[str]
    starts: list[float]
    trees: list[list[Tree]]
    params: BoostParams

    def codes(self, columns: list[np.ndarray]) -> np.ndarray:
        """Bin codes of raw values, the number of bins for missing ones."""
        out = np.empty((len(columns[0]) if columns else 0, len(columns)), dtype=np.int64)
        for i, (values, edges) in enumerate(zip(columns, self.edges)):
            out[:, i] = np.where(np.isnan(values), self.params.bins, np.searchsorted(edges, values, side="left"))
        return out

    def raw(self, model: int, codes: np.ndarray) -> np.ndarray:
        out = np.full(len(codes), self.starts[model])
        for tree in self.trees[model]:
            out += np.array(tree.value)[tree.nodes_of(codes, self.params.bins)]
        return out


def _columns(batch: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False).astype(np.float64) for n in names]


def bin_edges(df: DataFrame, features: list[str], bins: int = 255) -> list[np.ndarray]:
    """Upper borders of each feature's bins but the last: halfway between distinct values, or quantiles of many."""
    opened = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f).cast("double").alias("v")) for i, f in enumerate(features)])).alias("x")).select("x.f", "x.v")
    values = materialize(opened.where("v IS NOT NULL AND NOT isnan(v)").groupBy("f", "v").count(), "values")
    many = {r["f"] for r in values.groupBy("f").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bins).collect()}
    edges: list[np.ndarray] = [np.zeros(0)] * len(features)
    few: dict[int, list[float]] = {}
    for r in values.where(~F.col("f").isin([*many, -1])).collect():
        few.setdefault(r["f"], []).append(r["v"])
    for f, vs in few.items():
        vs = np.sort(np.array(vs))
        edges[f] = (vs[1:] + vs[:-1]) / 2
    if many:
        parts = [i / bins for i in range(1, bins)]
        number = lambda f: F.nanvl(F.col(features[f]).cast("double"), F.lit(None).cast("double"))
        row = df.agg(*[F.percentile_approx(number(f), parts, 100_000).alias(f"c{f}") for f in sorted(many)]).first()
        for f in many:
            edges[f] = np.unique(np.array(row[f"c{f}"], dtype=np.float64))
    discard(values)
    return edges


def _binned(df: DataFrame, ensemble: Ensemble, models: list[Model]) -> DataFrame:
    """(x: codes, y and w: one for each model), without rows that no model uses."""
    y = F.array(*[m.target.cast("double") for m in models])
    w = F.array(*[F.when(m.target.isNull(), 0).otherwise(F.coalesce(m.weight.cast("int"), F.lit(0))) for m in models])
    ready = df.select(*[F.col(f).cast("double").alias(f) for f in ensemble.features], y.alias("y"), w.alias("w"))
    names = ensemble.features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = _packed(ensemble.codes(_columns(batch, names)))
            yield pa.RecordBatch.from_arrays([packed, batch.column(len(names)), batch.column(len(names) + 1)], ["x", "y", "w"])

    return ready.where(F.exists("w", lambda n: n > 0)).mapInArrow(run, "x binary, y array<double>, w array<int>")


def _rows(batch: pa.RecordBatch, n_features: int, n_models: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.uint8).reshape(-1, n_features).astype(np.int64)
    flat = lambda i: batch.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n_models)
    return codes, np.nan_to_num(flat(1)), flat(2)


_TREE = "model int, round int, start double, feature array<int>, bin array<int>, missing_left array<boolean>, left array<int>, value array<double>"


def _opened(binned: DataFrame) -> DataFrame:
    """(model, x, y, w): a row for each model that uses it."""
    return binned.select("x", F.posexplode(F.arrays_zip("y", "w")).alias("model", "v")).select("model", "x", "v.y", "v.w").where("w > 0")


def _merged(opened: DataFrame, loss: str) -> DataFrame:
    """Rows that a model cannot tell apart as one, with the sum of their weights."""
    if loss == "absolute":
        return opened.groupBy("model", "x", "y").agg(F.sum("w").alias("w"))
    return opened.groupBy("model", "x").agg((F.sum(F.col("y") * F.col("w")) / F.sum("w")).alias("y"), F.sum("w").alias("w"))


def _packed(codes: np.ndarray) -> pa.Array:
    """Codes of each row as bytes."""
    ends = np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(codes, dtype=np.uint8))])


def _codes(column: pa.ChunkedArray, n_features: int) -> np.ndarray:
    """Packed codes of rows without nulls."""
    parts = []
    for c in column.chunks:
        if len(c) and n_features:
            begin = np.frombuffer(c.buffers()[1], dtype=np.int32, count=c.offset + 1)[c.offset]
            parts.append(np.frombuffer(c.buffers()[2], dtype=np.uint8)[begin : begin + len(c) * n_features])
    return np.concatenate(parts or [np.zeros(0, dtype=np.uint8)]).reshape(len(column), n_features)


def _by_cell(codes: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of each cell, where its rows begin, and y and w in the order of cells and y."""
    packed = np.ascontiguousarray(np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8)))).view(np.uint64)
    order = np.lexsort([y, *packed.T])
    packed = packed[order]
    begins = np.flatnonzero(np.r_[True, (packed[1:] != packed[:-1]).any(axis=1)])
    return codes[order[begins]].astype(np.int64), np.r_[begins, len(y)], y[order], w[order]


def _fit_by_model(opened: DataFrame, allowed: np.ndarray, params: BoostParams, cells: bool = False) -> tuple[list[float], list[list[Tree]]]:
    """A model per task; ``cells``: by fit_cells."""
    n_features = allowed.shape[1]

    def run(rows: pa.Table) -> pa.Table:
        model = rows.column("model")[0].as_py()
        codes = _codes(rows.column("x"), n_features)
        y, w = rows.column("y").to_numpy().astype(np.float64), rows.column("w").to_numpy().astype(np.float64)
        if cells:
            # Features that the model does not use tell no cells apart.
            start, trees = fit_cells(*_by_cell(np.where(allowed[model], codes, 0).astype(np.uint8), y, w), allowed[model], params)
        else:
            # In one order, whatever the shuffle: sums of floats then agree from run to run.
            codes = codes.astype(np.int64)
            order = np.lexsort([w, *codes.T, y])
            start, trees = fit_resident(codes[order], y[order], w[order], allowed[model], params)
        cols = [[model] * len(trees), list(range(len(trees))), [start] * len(trees), *([getattr(t, c) for t in trees] for c in ("feature", "bin", "missing_left", "left", "value"))]
        kinds = [pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.float64())]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=[c.split()[0] for c in _TREE.split(", ")])

    starts, trees = [0.0] * len(allowed), [[] for _ in allowed]
    for r in sorted(opened.repartitionById(len(allowed), "model").groupBy("model").applyInArrow(run, _TREE).collect(), key=lambda r: (r["model"], r["round"])):
        starts[r["model"]] = r["start"]
        trees[r["model"]].append(Tree(list(r["feature"]), list(r["bin"]), list(r["missing_left"]), list(r["left"]), list(r["value"])))
    return starts, trees


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of floats."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def from_ordered_bits(bits: int) -> float:
    raw = bits ^ (1 << 63) if bits >> 63 else ~bits & (1 << 64) - 1
    return float(np.array([raw], dtype=np.uint64).view(np.float64)[0])


class _ByLevels:
    """Fits all models together, a pass over the binned rows for each level of a round's trees."""

    def __init__(self, binned: DataFrame, allowed: np.ndarray, params: BoostParams):
        self.params, self.allowed = params, allowed
        self.n_models, self.n_features = allowed.shape
        self.state = materialize(binned.withColumn("raw", F.array_repeat(F.lit(0.0), self.n_models)), "boost")
        self.recent: list[list[Tree]] = [[] for _ in range(self.n_models)]
        self.trees: list[list[Tree]] = [[] for _ in range(self.n_models)]
        self.starts = [0.0] * self.n_models

    def _pass(self, emit: Callable, schema: str) -> DataFrame:
        """Rows of emit(batch, codes, y, w, raw), which gives lists of Arrow arrays, for each batch of binned rows."""
        n_features, n_models, missing, recent = self.n_features, self.n_models, self.params.bins, self.recent
        names = [c.split()[0] for c in schema.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                codes, y, w = _rows(batch, n_features, n_models)
                raw = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, n_models).copy()
                for m, trees in enumerate(recent):
                    for tree in trees:
                        raw[:, m] += np.array(tree.value)[tree.nodes_of(codes, missing)]
                for arrays in emit(batch, codes, y, w, raw):
                    yield pa.RecordBatch.from_arrays(arrays, names)

        return self.state.select("x", "y", "w", "raw").mapInArrow(run, schema)

    def splits(self, growers: list[Grower]) -> None:
        """Best splits of all wanted nodes of all models, from one aggregation."""
        params, width = self.params, self.params.bins + 1
        asked = [(g.wanted, g.tree) for g in growers]

        def emit(batch, codes, y, w, raw):
            for m, (wanted, tree) in enumerate(asked):
                if not wanted:
                    continue
                slots = np.full(len(tree.feature), -1)
                slots[wanted] = np.arange(len(wanted))
                slot = slots[tree.nodes_of(codes, params.bins)]
                held = (slot >= 0) & (w[:, m] > 0)
                g, h = gradients(params.loss, y[held, m], raw[held, m])
                hist = histograms(codes[held], slot[held], len(wanted), g, h, w[held, m], width)
                some = np.argwhere(hist[..., 2].any(axis=2))
                yield [pa.array(np.full(len(some), m), pa.int32()), pa.array(np.array(wanted)[some[:, 0]], pa.int32()), pa.array(some[:, 1], pa.int32()), pa.array([hist[s, f].tobytes() for s, f in some], pa.binary())]

        def total(rows: pa.Table) -> pa.Table:
            hist = sum(np.frombuffer(b, dtype=np.float64) for b in rows.column("hist").to_pylist()).reshape(width, 3)
            key = [rows.column(c)[:1].combine_chunks() for c in ("model", "node", "feature")]
            names = ["model", "node", "feature", "gain", "bin", "low", "left", "whole"]
            gain, at, low, left, whole = best_splits(hist[None], params)[0] or (0.0, -1, False, np.zeros(3), hist.sum(axis=0))
            return pa.table([*key, pa.array([gain]), pa.array([at], pa.int32()), pa.array([low]), pa.array([left.tolist()]), pa.array([whole.tolist()])], names=names)

        parts = self._pass(emit, "model int, node int, feature int, hist binary")
        best = parts.groupBy("model", "node", "feature").applyInArrow(total, "model int, node int, feature int, gain double, bin int, low boolean, left array<double>, whole array<double>")
        by: dict[tuple[int, int], list] = {}
        for r in best.collect():
            split = (r["gain"], r["bin"], r["low"], np.array(r["left"]), np.array(r["whole"])) if r["bin"] >= 0 else None
            by.setdefault((r["model"], r["node"]), []).append((r["feature"], split))
        for m, g in enumerate(growers):
            for node in g.wanted:
                g.feed(node, by.get((m, node), []))

    def medians(self, trees: list[Tree] | None) -> dict[tuple[int, int], float]:
        """Median residual of each leaf (or of each whole model), by four passes over 16 bits each."""
        missing = self.params.bins
        chosen: dict[tuple[int, int], list[list]] = {}  # (model, leaf) -> [prefix, rank inside it] of the two middle ranks
        for turn in range(4):
            shift = np.uint64(48 - 16 * turn)

            def emit(batch, codes, y, w, raw, shift=shift, turn=turn, chosen=dict(chosen)):
                for m in range(w.shape[1]):
                    held = w[:, m] > 0
                    leaf = trees[m].nodes_of(codes[held], missing) if trees else np.zeros(int(held.sum()), dtype=np.int64)
                    upto = ordered_bits(y[held, m] - raw[held, m]) >> shift
                    if turn:
                        near = np.zeros(len(leaf), dtype=bool)
                        for (model, one), ranks in chosen.items():
                            if model == m:
                                for prefix in {r[0] for r in ranks}:
                                    near |= (leaf == one) & (upto >> np.uint64(16) == np.uint64(prefix))
                    else:
                        near = np.ones(len(leaf), dtype=bool)
                    if near.any():
                        pairs, at = np.unique(np.stack([leaf[near].astype(np.uint64), upto[near]]), axis=1, return_inverse=True)
                        n = np.bincount(at.ravel(), weights=w[held, m][near])
                        yield [pa.array(np.full(len(n), m), pa.int32()), pa.array(pairs[0].astype(np.int64)), pa.array(pairs[1].view(np.int64)), pa.array(n.astype(np.int64))]

            counts = self._pass(emit, "model int, leaf long, code long, n long").groupBy("model", "leaf", "code").agg(F.sum("n").alias("n"))
            per_leaf: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for r in counts.collect():  # at most 2 ** 16 codes for each of two prefixes of a leaf
                per_leaf.setdefault((r["model"], r["leaf"]), []).append((r["code"] & (1 << 64) - 1, r["n"]))
            after = {}
            for key, codes in per_leaf.items():
                codes.sort()
                total = sum(n for _, n in codes)
                ranks = chosen.get(key) or [[None, (total - 1) // 2], [None, total // 2]]
                after[key] = []
                for prefix, rank in ranks:
                    for code, n in codes:
                        if prefix is not None and code >> 16 != prefix:
                            continue
                        if rank < n:
                            after[key].append([code, rank])
                            break
                        rank -= n
            chosen = after
        return {key: sum(from_ordered_bits(r[0]) for r in ranks) / 2 for key, ranks in chosen.items()}

    def begin(self) -> None:
        if self.params.loss == "absolute":
            for (m, _), value in self.medians(None).items():
                self.starts[m] = value
        else:
            sums = self.state.select(F.posexplode(F.arrays_zip("y", "w")).alias("m", "v")).where("v.w > 0").groupBy("m").agg((F.sum(F.col("v.y") * F.col("v.w")) / F.sum("v.w")).alias("mean"))
            for r in sums.collect():
                self.starts[r["m"]] = r["mean"] if self.params.loss == "squared" else float(np.log(max(r["mean"], 1e-12)))
        self.recent = [[Tree(value=[s])] for s in self.starts]

    def refresh(self) -> None:
        def emit(batch, codes, y, w, raw):
            yield [batch.column(0), batch.column(1), batch.column(2), pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1) * raw.shape[1], pa.int32()), pa.array(raw.ravel()))]

        before, self.state = self.state, materialize(self._pass(emit, "x binary, y array<double>, w array<int>, raw array<double>"), "boost")
        discard(before)
        self.recent = [[] for _ in range(self.n_models)]

    def fit(self) -> tuple[list[float], list[list[Tree]]]:
        self.begin()
        for turn in range(self.params.rounds):
            growers = [Grower(self.params, a) for a in self.allowed]
            while any(g.wanted for g in growers):
                self.splits(growers)
                for g in growers:
                    g.advance()
            trees = [g.finish() for g in growers]
            if self.params.loss == "absolute":
                for (m, leaf), value in self.medians(trees).items():
                    if len(trees[m].feature) > 1:
                        trees[m].value[leaf] = value * self.params.rate
            for m, tree in enumerate(trees):
                self.trees[m].append(tree)
                self.recent[m].append(tree)
            if (turn + 1) % self.params.refresh == 0:
                self.refresh()
        discard(self.state)
        return self.starts, self.trees


def _most_rows(binned: DataFrame, n_models: int) -> int:
    """Rows of the model that uses most, or its draws where these are not many more (see fit_cells)."""
    each = lambda m: F.greatest(F.count_if(F.get("w", m) > 0), F.least(F.sum(F.get("w", m)), 4 * F.count_if(F.get("w", m) > 0)))
    return binned.agg(F.greatest(F.lit(0), F.lit(0), *[F.coalesce(each(m), F.lit(0)) for m in range(n_models)])).first()[0]


def fit(df: DataFrame, features: list[str], models: list[Model], params: BoostParams = BoostParams()) -> Ensemble:
    """All models over one frame. Rows with a null target or weight are in no training part."""
    empty = Ensemble(features, bin_edges(df, features, params.bins), [m.name for m in models], [], [], params)
    binned = materialize(_binned(df, empty, models), "binned")
    allowed = np.array([[m.features is None or f in m.features for f in features] for m in models])
    merged = None
    if binned.count() <= params.resident_rows:
        starts, trees = _fit_by_model(_opened(binned), allowed, params)
    elif params.loss == "absolute" and _most_rows(binned, len(models)) <= CELL_ROWS * params.resident_rows:
        starts, trees = _fit_by_model(_opened(binned), allowed, params, cells=True)
    else:
        merged = materialize(_merged(_opened(binned), params.loss), "merged")
        largest = merged.groupBy("model").count().agg(F.max("count")).first()[0] or 0
        starts, trees = _fit_by_model(merged, allowed, params) if largest <= params.resident_rows else _ByLevels(binned, allowed, params).fit()
    discard(binned)
    discard(merged)
    return replace(empty, starts=starts, trees=trees)


def predict(df: DataFrame, ensemble: Ensemble, out: str = "predictions", floor: float | None = None) -> DataFrame:
    """df with an array of each model's prediction, in the order of the models."""
    if out in df.columns:
        raise ValueError(f"column {out} would be overwritten")
    sent = df.sparkSession.sparkContext.broadcast(ensemble)
    names, kept = [f"_x{i}" for i in range(len(ensemble.features))], df.columns
    ready = df.select("*", *[F.col(f).cast("double").alias(n) for n, f in zip(names, ensemble.features)])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = _packed(sent.value.codes(_columns(batch, names)))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), packed], [*kept, "_cell"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for batch in batches:
            codes = _codes(pa.chunked_array([batch.column(0)]), len(names)).astype(np.int64)
            raw = np.stack([held.raw(m, codes) for m in range(len(held.names))], axis=1) if batch.num_rows else np.zeros((0, len(held.names)))
            found = np.exp(raw) if held.params.loss == "poisson" else raw
            found = found if floor is None else np.maximum(found, floor)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * len(held.names), pa.int32()), pa.array(found.ravel()))], ["_cell", out])

    coded = ready.mapInArrow(encode, T.StructType([*df.schema.fields, T.StructField("_cell", T.BinaryType())]))
    # Rows with the same codes have the same prediction: the trees are walked once for each, spread over all tasks.
    cells = coded.select("_cell").distinct().repartition(df.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, f"_cell binary, `{out}` array<double>")
    return coded.join(cells, "_cell").select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{out}`"))


def fold_models(folds: list[int], fold: str, value: str, features: tuple[str, ...] | None = None, prefix: str = "") -> list[Model]:
    """A model per fold, trained on all others."""
    return [Model(f"{prefix}{held}", F.col(value), (F.col(fold) != held).cast("int"), features) for held in folds]


def out_of_fold(df: DataFrame, fold: str, folds: list[int], value: str, features: list[str], params: BoostParams = BoostParams(), floor: float | None = 1.0) -> DataFrame:
    """df with the prediction of the model that did not see the row's fold; rows of other folds are left out."""
    ensemble = fit(df, features, fold_models(folds, fold, value), params)
    own = F.array_position(F.array(*[F.lit(f) for f in folds]), F.col(fold)).cast("int") - 1
    return predict(df.where(F.col(fold).isin(folds)), ensemble, "_all", floor).withColumn("prediction", F.get("_all", own)).drop("_all")


def drop_one(df: DataFrame, fold: str, folds: list[int], value: str, features: list[str], params: BoostParams = BoostParams()) -> DataFrame:
    """(dropped_feature, full_model_mae, mae_without_feature, mae_increase_pct), from out-of-fold fits of all comparisons in one job."""
    kinds = [None, *features]
    models = [m for f in kinds for m in fold_models(folds, fold, value, None if f is None else tuple(g for g in features if g != f), f"{f or 'all'}/")]
    own = F.array_position(F.array(*[F.lit(f) for f in folds]), F.col(fold)).cast("int") - 1
    scored = predict(df.where(F.col(fold).isin(folds) & F.col(value).isNotNull()), fit(df, features, models, params), "_all")
    errors = [F.avg(F.abs(F.get("_all", own + i * len(folds)) - F.col(value))).alias(f"_e{i}") for i in range(len(kinds))]
    row = scored.agg(*errors)
    one = lambda i, f: F.struct(F.lit(f).alias("dropped_feature"), F.col("_e0").alias("full_model_mae"), F.col(f"_e{i}").alias("mae_without_feature"), (100 * F.try_divide(F.col(f"_e{i}") - F.col("_e0"), F.col("_e0"))).alias("mae_increase_pct"))
    return row.select(F.explode(F.array(*[one(i, f) for i, f in enumerate(features, 1)])).alias("x")).select("x.*")


def drawn(key: Column, draw: int | Column, seed: int = 42) -> Column:
    """How often a resample of the rows holds a row: a Poisson count of mean 1 from md5 of seed, draw and the row's key."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), draw.cast("string") if isinstance(draw, Column) else F.lit(str(draw)), key.cast("string"))), 1, 10), 16, 10).cast("long") / float(1 << 40)
    out, upto, term = F.lit(8), 0.0, np.exp(-1.0)
    steps = []
    for k in range(8):
        upto += term
        steps.append((upto, k))
        term /= k + 1
    for upto, k in reversed(steps):
        out = F.when(u < upto, F.lit(k)).otherwise(out)
    return out


def refit_noise(
    df: DataFrame, network: DataFrame, key: str, features: list[str], targets: dict[int, str], pairs: list[tuple[int, int]], placebo: int, draws: int = 30, params: BoostParams = BoostParams(), seed: int = 42
) -> DataFrame:
    """Bootstrap of predicted change over a network, beside the same-year null change.

    Per pair of years: network rows, draws, mean, mean absolute and sd of predicted change, mean sd of change over draws,
    mean sd of the placebo (two resamples of one year), ratio of the two, share of rows with |change| > 2 sd. All years of
    a draw share its resample; the placebo year has a second one. All fits are one job; predictions stay with their row.
    """
    if draws < 2:
        raise ValueError("a spread needs two draws")
    years = list(targets)
    models = [Model(f"point/{y}", F.col(targets[y]), F.lit(1)) for y in years]
    for d in range(draws):
        models += [Model(f"{d}/{y}", F.col(targets[y]), drawn(F.col(key), 2 * d, seed)) for y in years]
        models.append(Model(f"{d}/placebo", F.col(targets[placebo]), drawn(F.col(key), 2 * d + 1, seed)))
    scored = predict(network, fit(df, features, models, params), "_all")
    at = lambda d, i: F.get("_all", len(years) + d * (len(years) + 1) + i)
    index = {y: i for i, y in enumerate(years)}

    def spread(values: list[Column]) -> Column:
        """Sample standard deviation of a row's draws."""
        held = F.array(*values)
        mean = F.aggregate(held, F.lit(0.0), lambda acc, v: acc + v) / draws
        return F.sqrt(F.aggregate(held, F.lit(0.0), lambda acc, v: acc + (v - mean) * (v - mean)) / (draws - 1))

    null = spread([at(d, len(years)) - at(d, index[placebo]) for d in range(draws)])
    rows = scored.select(
        null.alias("_null"),
        *[(F.get("_all", index[b]) - F.get("_all", index[a])).alias(f"_c{k}") for k, (a, b) in enumerate(pairs)],
        *[spread([at(d, index[b]) - at(d, index[a]) for d in range(draws)]).alias(f"_s{k}") for k, (a, b) in enumerate(pairs)],
    )
    parts = []
    for k, (a, b) in enumerate(pairs):
        change, sd = F.col(f"_c{k}"), F.col(f"_s{k}")
        parts.append(
            F.struct(
                F.lit(f"{a}-{b}").alias("period"), F.count(F.lit(1)).alias("network_rows"), F.lit(draws).alias("draws"), F.avg(change).alias("mean_change"), F.avg(F.abs(change)).alias("mean_absolute_change"),
                F.stddev_pop(change).alias("sd_change"), F.avg(sd).alias("mean_refit_sd"), F.avg("_null").alias("mean_placebo_sd"), F.try_divide(F.avg(F.abs(change)), F.avg(sd)).alias("signal_to_noise"),
                (100 * F.avg((F.abs(change) > 2 * sd).cast("double"))).alias("distinguishable_pct"),
            )
        )
    return rows.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def without_feature(df: DataFrame, network: DataFrame, value: str, features: list[str], dropped: str, group: str, params: BoostParams = BoostParams()) -> DataFrame:
    """Per group of network rows: predictions with all features, and how much they change when one is left out."""
    models = [Model("with", F.col(value), F.lit(1)), Model("without", F.col(value), F.lit(1), tuple(f for f in features if f != dropped))]
    scored = predict(network, fit(df, features, models, params), "_all").withColumn("_with", F.get("_all", 0)).withColumn("_moved", F.abs(F.get("_all", 0) - F.get("_all", 1)))
    per = scored.groupBy(group).agg(
        F.count(F.lit(1)).alias("network_rows"), F.avg("_with").alias("prediction_mean"), F.median("_with").alias("prediction_median"),
        F.percentile("_with", 0.1).alias("prediction_q10"), F.percentile("_with", 0.9).alias("prediction_q90"), F.avg("_moved").alias("mean_abs_change"), F.max("_moved").alias("max_abs_change"),
    )
    seen = df.groupBy(F.col(group).alias("_g")).agg(F.count(value).alias("training_rows"), F.avg(value).alias("observed_mean"), F.median(value).alias("observed_median"))
    return per.join(seen, F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g").na.fill(0, ["training_rows"])
