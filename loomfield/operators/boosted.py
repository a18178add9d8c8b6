"""Gradient-boosted trees grown by Spark, and additive contributions of their features.

Features are cut at quantiles into a few bins, stored once as bytes. Every level of a tree is one job: tasks place their
rows in the tree as it stands and send gradient and curvature sums by (class, node, feature, bin), whose number the
parameters bound; the driver picks the splits. Sums are of integers (gradients in fixed point), so that a model does
not depend on how rows are dealt. A missing or NaN value has a bin of its own and goes where it gains more.

Objectives: ``squared`` (a margin), ``logistic`` (0/1) and ``softmax`` (classes 0..k-1). Rows without a label or
with a weight of 0 or less are left out; without rows the model is its base alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.sources.tables import stored

MISSING = 0
#: Fixed-point steps of the largest gradient.
STEPS = float(1 << 30)


@dataclass
class Tree:
    """Nodes as parallel lists; ``feature`` is -1 at a leaf, rows with a bin of at most ``cut`` go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [True])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    cover: list[float] = field(default_factory=lambda: [0.0])

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(x) for x in (self.feature, self.cut, self.missing_left, self.left, self.right))

    def place(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of every row of ``bins``."""
        feature, cut, missing_left, left, right = self.arrays()
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        while True:
            inner = feature[at] >= 0
            if not inner.any():
                return at
            b = bins[rows, np.maximum(feature[at], 0)]
            at = np.where(inner, np.where(np.where(b == MISSING, missing_left[at], b <= cut[at]), left[at], right[at]), at)


@dataclass
class Boosted:
    """A fitted model: cut points by feature, one list of trees for each class, and the base margin of each class."""

    features: list[str]
    objective: str
    cuts: list[np.ndarray]
    base: np.ndarray
    trees: list[list[Tree]] = field(default_factory=list)  # by round, then class

    def bins(self, values: np.ndarray) -> np.ndarray:
        """Bins of raw values: 0 for missing ones, else 1 and the number of cut points below."""
        out = np.zeros(values.shape, np.uint8)
        for k, cuts in enumerate(self.cuts):
            there = ~np.isnan(values[:, k])
            out[there, k] = 1 + np.searchsorted(cuts, values[there, k], side="left")
        return out

    def margins_of(self, bins: np.ndarray, first: int = 0) -> np.ndarray:
        """Sums of the trees from round ``first`` on, without the base, one column a class."""
        out = np.zeros((len(bins), len(self.base)))
        for trees in self.trees[first:]:
            for k, tree in enumerate(trees):
                out[:, k] += np.array(tree.value)[tree.place(bins)]
        return out

    def _column(self, run, returns: str) -> Column:
        call = F.pandas_udf(run, returns)
        return call(*(F.col(f).cast("double") for f in self.features))

    def margins(self) -> Column:
        """The margin of each class as an array."""
        return self._column(_series(lambda x: self.base + self.margins_of(self.bins(x))), "array<double>")

    def prediction(self) -> Column:
        """The margin (squared), the chance of label 1 (logistic), or the chances of all classes (softmax, an array)."""

        def chances(x):
            e = self.base + self.margins_of(self.bins(x))
            e = np.exp(e - e.max(1, keepdims=True))
            return e / e.sum(1, keepdims=True)

        if self.objective == "softmax":
            return self._column(_series(chances), "array<double>")
        m = self.margins()[0]
        return m if self.objective == "squared" else 1 / (1 + F.exp(-m))

    def importance(self) -> dict[str, int]:
        """How many splits use each feature."""
        used = np.bincount([f for trees in self.trees for t in trees for f in t.feature if f >= 0], minlength=len(self.features))
        return dict(zip(self.features, used.tolist()))


def _series(rows_of):
    """A vectorised function of feature columns that returns ``rows_of`` their matrix, one array a row."""

    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series(list(rows_of(_wide(columns))))

    return run


def _wide(columns) -> np.ndarray:
    return np.column_stack([np.asarray(c, np.float64) for c in columns])


def _gradients(objective: str, margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by the margins, one column a class."""
    if objective == "squared":
        return margin - y[:, None], np.ones_like(margin)
    if objective == "logistic":
        p = 1 / (1 + np.exp(-margin))
        return p - y[:, None], np.maximum(p * (1 - p), 1e-16)
    e = np.exp(margin - margin.max(1, keepdims=True))
    p = e / e.sum(1, keepdims=True)
    return p - (np.arange(margin.shape[1]) == y[:, None]), np.maximum(2 * p * (1 - p), 1e-16)


def _best_split(g: np.ndarray, h: np.ndarray, l2: float, min_child: float) -> tuple | None:
    """(feature, cut, missing goes left, left g, left h) of the largest gain over sums by (feature, bin); first of ties."""
    total_g, total_h = g[0].sum(), h[0].sum()
    left_g, left_h = np.cumsum(g[:, 1:], 1), np.cumsum(h[:, 1:], 1)
    lg = np.stack((left_g + g[:, :1], left_g), -1)
    lh = np.stack((left_h + h[:, :1], left_h), -1)
    rg, rh = total_g - lg, total_h - lh
    gain = lg**2 / (lh + l2) + rg**2 / (rh + l2) - total_g**2 / (total_h + l2)
    # a part without rows is no part
    gain = np.where((lh >= min_child) & (rh >= min_child) & (lh > 0) & (rh > 0), gain, -np.inf)
    best = int(np.argmax(gain))
    f, cut, way = np.unravel_index(best, gain.shape)
    if not gain[f, cut, way] > 1e-9 * max(1.0, abs(total_g)):
        return None
    return int(f), int(cut) + 1, way == 0, float(lg[f, cut, way]), float(lh[f, cut, way])


def fit_boosted(
    df: DataFrame, features: list[str], label: str, *, objective: str = "squared", classes: int = 1, weight: str | None = None, rounds: int = 20, depth: int = 3,
    rate: float = 0.3, l2: float = 1.0, min_child: float = 1.0, most_bins: int = 64, keep: int = 10,
) -> Boosted:
    """Boosted trees for ``label`` by ``features``. Margins are stored with the rows every ``keep`` rounds."""
    spark, n_f = df.sparkSession, len(features)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(*(F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")).alias(f"f{k}") for k, f in enumerate(features)), F.col(label).cast("double").alias("y"), w.alias("w"))
    rows = rows.where("y is not null and not isnan(y) and w > 0")
    share = [k / most_bins for k in range(1, most_bins)]
    marks = [F.percentile_approx(f"f{k}", F.array(*map(F.lit, share)), 100_000).alias(f"f{k}") for k in range(n_f)]
    seen = rows.agg(*marks, F.sum(F.col("y") * F.col("w")).alias("sy"), F.sum("w").alias("sw"), F.min("y").alias("lo"), F.max("y").alias("hi"), F.max("w").alias("w")).first()
    cuts = [np.unique(np.array(seen[f"f{k}"] or [], float)) for k in range(n_f)]
    base = np.zeros(classes)
    if seen.sw and objective != "softmax":
        mean = seen.sy / seen.sw
        base[0] = mean if objective == "squared" else np.log(np.clip(mean, 1e-6, 1 - 1e-6) / np.clip(1 - mean, 1e-6, 1 - 1e-6))
    model = Boosted(features, objective, cuts, base)
    if not seen.sw:
        return model
    scale = STEPS / (seen.w * max(1.0, seen.hi - seen.lo if objective == "squared" else 1.0))

    def pack(batches):
        for batch in batches:
            values = _wide([batch.column(k).to_numpy(zero_copy_only=False) for k in range(n_f)])
            n = batch.num_rows
            flat = lambda x, width: pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), n, [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([flat(model.bins(values), n_f), flat(np.tile(base, (n, 1)), 8 * classes), batch.column(n_f), batch.column(n_f + 1)], ["bins", "m", "y", "w"])

    schema = "bins binary, m binary, y double, w double"
    binned, since = stored(rows.mapInArrow(pack, schema), "binned"), 0
    matrix = lambda column, kind: np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)
    n_bins = max(map(len, cuts), default=0) + 2

    def sums(trees: list[Tree], slots: list[dict[int, int]]):
        """(class, slot) -> sums of gradients and curvatures by (feature, bin) of the nodes that are open."""
        width = max(map(len, slots))
        first = since

        def run(batches):
            out = np.zeros((2, classes, width, n_f, n_bins), np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                bins, y, own = matrix(batch.column(0), np.uint8), batch.column(2).to_numpy(), batch.column(3).to_numpy()
                g, h = _gradients(objective, matrix(batch.column(1), np.float64) + model.margins_of(bins, first), y)
                g, h = np.rint(g * own[:, None] * scale), np.rint(h * own[:, None] * scale)
                for k, tree in enumerate(trees):
                    slot_of = np.full(len(tree.feature), -1)
                    for node, slot in slots[k].items():
                        slot_of[node] = slot
                    slot = slot_of[tree.place(bins)]
                    live = slot >= 0
                    for f in range(n_f):
                        key = slot[live] * n_bins + bins[live, f]
                        for part, v in enumerate((g, h)):  # integers far below 2 ** 53
                            out[part, k, :, f] += np.bincount(key, v[live, k], width * n_bins).astype(np.int64).reshape(width, n_bins)
            at = np.flatnonzero(out.any(0).ravel())
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[0].ravel()[at]), pa.array(out[1].ravel()[at])], ["key", "g", "h"])

        total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
        found = binned.mapInArrow(run, "key bigint, g bigint, h bigint").groupBy("key").agg(total("g"), total("h")).collect()
        out = np.zeros((2, classes * width * n_f * n_bins))
        for r in found:
            out[:, r.key] = float(r.g) / scale, float(r.h) / scale
        return out.reshape(2, classes, width, n_f, n_bins)

    for done in range(rounds):
        trees = [Tree() for _ in range(classes)]
        open_nodes = [[0] for _ in range(classes)]
        for level in range(depth):
            slots = [{node: k for k, node in enumerate(nodes)} for nodes in open_nodes]
            if not any(slots):
                break
            g, h = sums(trees, slots)
            for k, tree in enumerate(trees):
                below = []
                for node, slot in slots[k].items():
                    gn, hn = g[k, slot], h[k, slot]
                    total_g, total_h = float(gn[0].sum()), float(hn[0].sum())
                    if level == 0:
                        tree.value[node], tree.cover[node] = -rate * total_g / (total_h + l2), total_h
                    found = _best_split(gn, hn, l2, min_child)
                    if found is None:
                        continue
                    f, cut, missing_left, lg, lh = found
                    tree.feature[node], tree.cut[node], tree.missing_left[node] = f, cut, missing_left
                    tree.left[node], tree.right[node] = len(tree.feature), len(tree.feature) + 1
                    for part_g, part_h in ((lg, lh), (total_g - lg, total_h - lh)):
                        below.append(len(tree.feature))
                        for values, v in ((tree.feature, -1), (tree.cut, 0), (tree.missing_left, True), (tree.left, 0), (tree.right, 0), (tree.value, -rate * part_g / (part_h + l2)), (tree.cover, part_h)):
                            values.append(v)
                open_nodes[k] = below
        model.trees.append(trees)
        if (done + 1) % keep == 0 and done + 1 < rounds:
            first, so_far = since, Boosted(features, objective, cuts, base, list(model.trees))

            def renew(batches, first=first, so_far=so_far):
                for batch in batches:
                    if batch.num_rows:
                        m = matrix(batch.column(1), np.float64) + so_far.margins_of(matrix(batch.column(0), np.uint8), first)
                        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in m], pa.binary()), batch.column(2), batch.column(3)], ["bins", "m", "y", "w"])

            binned, since = stored(binned.mapInArrow(renew, schema), "binned"), done + 1
    return model


def _path_weights(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """For each feature of a path the summed weights of the sets of its other features; ``ones`` by (feature, row)."""
    d, n = ones.shape
    w = np.zeros((d + 1, n))
    w[0] = 1
    for k in range(d):
        size = k + 1
        for j in range(k, -1, -1):
            w[j + 1] += ones[k] * w[j] * (j + 1) / (size + 1)
            w[j] = zeros[k] * w[j] * (size - j) / (size + 1)
    out = np.zeros((d, n))
    for k in range(d):
        one, zero = ones[k] > 0, zeros[k]
        rest = w[d].copy()
        for j in range(d - 1, -1, -1):
            with_one = rest * (d + 1) / (j + 1)
            out[k] += np.where(one, with_one, w[j] * (d + 1) / (zero * (d - j)))
            rest = np.where(one, w[j] - with_one * zero * (d - j) / (d + 1), rest)
    return out


def shapley(model: Boosted, bins: np.ndarray) -> np.ndarray:
    """(row, class, feature and at last the bias): path-dependent Shapley values; a row's sum is its margin."""
    n, n_f = bins.shape
    out = np.zeros((n, len(model.base), n_f + 1))
    out[:, :, n_f] = model.base
    for trees in model.trees:
        for k, tree in enumerate(trees):
            stack = [(0, {})]
            while stack:
                node, path = stack.pop()
                f = tree.feature[node]
                if f >= 0:
                    b = bins[:, f]
                    goes_left = np.where(b == MISSING, tree.missing_left[node], b <= tree.cut[node])
                    for child, goes in ((tree.left[node], goes_left), (tree.right[node], ~goes_left)):
                        one, zero = path.get(f, (np.ones(n, bool), 1.0))
                        stack.append((child, path | {f: (one & goes, zero * tree.cover[child] / tree.cover[node])}))
                    continue
                zeros = np.array([z for _, z in path.values()])
                out[:, k, n_f] += tree.value[node] * zeros.prod()
                if path:
                    ones = np.stack([o for o, _ in path.values()]).astype(float)
                    weights = _path_weights(ones, zeros)
                    for j, f in enumerate(path):
                        out[:, k, f] += weights[j] * (ones[j] - zeros[j]) * tree.value[node]
    return out


def contributions(model: Boosted, of: int = 0) -> Column:
    """Contributions of the features to the margin of class ``of`` as an array, the bias last."""

    return model._column(_series(lambda x: shapley(model, model.bins(x))[:, of]), "array<double>")


def decompose(df: DataFrame, model: Boosted, prefix: str, least: float = 1.0) -> DataFrame:
    """``df`` with the model's decomposition: base, raw margin, the sum of contributions, whether that is at least ``least``
    away from 0 so that shares of it mean something, and for each feature its contribution and share (null for a sum of 0)."""
    all_parts = df.withColumn("_c", contributions(model))
    n = len(model.features)
    total = F.aggregate(F.slice("_c", 1, n), F.lit(0.0), lambda a, b: a + b)
    out = all_parts.withColumn(f"{prefix}_base", F.col("_c")[n]).withColumn(f"{prefix}_weight_denominator", total)
    out = out.withColumn(f"{prefix}_raw", F.col(f"{prefix}_base") + F.col(f"{prefix}_weight_denominator"))
    out = out.withColumn(f"{prefix}_weights_reliable", F.abs(f"{prefix}_weight_denominator") >= least)
    held = F.when(F.abs(f"{prefix}_weight_denominator") >= 1e-12, F.col(f"{prefix}_weight_denominator"))
    for k, f in enumerate(model.features):
        out = out.withColumn(f"{prefix}__{f}__contrib", F.col("_c")[k]).withColumn(f"{prefix}__{f}__weight", F.col("_c")[k] / held)
    return out.drop("_c")


def what_if(df: DataFrame, model: Boosted, values: dict[str, float], where: Column | None = None) -> DataFrame:
    """``df`` with the margin before and after setting ``values`` in the rows ``where``: the model runs again on changed
    inputs, since contributions cannot be edited. Unknown features raise, with the closest names."""
    import difflib

    unknown = {v: difflib.get_close_matches(v, model.features, 5, 0.5) for v in values if v not in model.features}
    if unknown:
        raise ValueError(f"unknown features, with the closest ones: {unknown}")
    chosen = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    before = df.withColumn("margin_before", model.margins()[0])
    changed = before.withColumns({f"_was_{f}": F.col(f) for f in values} | {f: F.when(chosen, F.lit(float(v))).otherwise(F.col(f).cast("double")) for f, v in values.items()})
    after = changed.withColumn("margin_after", model.margins()[0])
    restored = after.withColumns({f: F.col(f"_was_{f}") for f in values}).drop(*(f"_was_{f}" for f in values))
    return restored.withColumn("moved", F.abs(F.col("margin_after") - F.col("margin_before")) > 1e-6)
