"""Isotonic regression over bins by pooling adjacent violators, first within range partitions, then over their blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.sources.tables import stored


def pooled(mean: np.ndarray, weight: np.ndarray) -> list[tuple[int, int]]:
    """Runs (first, last) that one value fits, so that weighted means never fall."""
    runs: list[list[float]] = []
    for k, (y, w) in enumerate(zip(mean.tolist(), weight.tolist())):
        runs.append([y * w, w, k, k])
        while len(runs) > 1 and runs[-2][0] * runs[-1][1] >= runs[-1][0] * runs[-2][1]:
            total, n, _, last = runs.pop()
            runs[-1] = [runs[-1][0] + total, runs[-1][1] + n, runs[-1][2], last]
    return [(int(r[2]), int(r[3])) for r in runs]


def isotonic(bins: DataFrame, x: str, y: str, w: str) -> DataFrame:
    """``bins`` (one row a value of ``x``) with ``fit``: the non-decreasing function of ``x`` nearest to ``y`` in squares weighed by ``w``.

    Pooling runs and then the runs of runs gives what pooling at once does, so a partition pools its own range, and only its
    runs, of which there are at most as many as levels, meet in one task."""
    rows = bins.where(F.col(w) > 0).repartitionByRange(x).sortWithinPartitions(x)
    kind = dict(bins.dtypes)[x]

    def whole(batches, columns, run):
        """One frame of a partition's bins or runs, which a fit on them needs at once."""
        held = [f for f in batches if len(f)]
        if held:
            f = pd.concat(held, ignore_index=True)
            yield run(f, *(f[c].to_numpy(float) for c in columns))

    def own(f, mean, weight):
        first = np.concatenate([np.full(b - a + 1, a) for a, b in pooled(mean, weight)])
        return pd.DataFrame({"x": f[x], "run": f[x].to_numpy()[first], "total": mean * weight, "n": weight})

    def again(f, total, n):
        fit = np.concatenate([np.full(b - a + 1, total[a : b + 1].sum() / n[a : b + 1].sum()) for a, b in pooled(total / n, n)])
        return pd.DataFrame({"run": f["run"], "fit": fit})

    placed = stored(rows.select(x, y, w).mapInPandas(lambda batches: whole(batches, (y, w), own), f"x {kind}, run {kind}, total double, n double"), "runs")
    runs = placed.groupBy("run").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    levels = runs.coalesce(1).sortWithinPartitions("run").mapInPandas(lambda batches: whole(batches, ("total", "n"), again), f"run {kind}, fit double")
    found = placed.join(levels, "run").select(F.col("x").alias(x), "fit")
    return bins.join(found, x)
