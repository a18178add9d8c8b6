"""Boosted trees against a plain single-process version; contributions against enumeration of all feature subsets."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomfield.operators import boosted as B

SCHEMA = "a double, b double, c double, y double, w double"


def rows(n=400, classes=1):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(n, 3)), 1)
    x[:, 2] = rng.integers(0, 3, n)
    y = 2.0 * x[:, 0] + np.where(x[:, 1] > 0, 3.0, 0.0) * (x[:, 2] == 1) + rng.normal(size=n) * 0.1
    if classes == 2:
        y = (y > 0.5).astype(float)
    elif classes > 2:
        y = np.digitize(y, [-1, 1.5]).astype(float)
    gone = rng.random((n, 3)) < 0.1
    out = [(*(None if g else (math.nan if k % 17 == 3 and j == 0 else float(v)) for j, (v, g) in enumerate(zip(r, own))), float(t), 1.0 + k % 3) for k, (r, own, t) in enumerate(zip(x, gone, y))]
    return out + [(1.0, 2.0, 0.0, None, 1.0), (1.0, 2.0, 0.0, 1.0, 0.0), (1.0, 2.0, 0.0, 1.0, None)]


def plain_trees(bins, y, w, base, objective, rounds, depth, rate, l2, min_child, n_bins):
    """Margins by trees grown node by node, every split of every feature tried one after the other."""
    margin = np.tile(base, (len(y), 1)).astype(float)
    for _ in range(rounds):
        if objective == "squared":
            g, h = margin - y[:, None], np.ones_like(margin)
        elif objective == "logistic":
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y[:, None], p * (1 - p)
        else:
            p = np.exp(margin) / np.exp(margin).sum(1, keepdims=True)
            g, h = p - np.eye(margin.shape[1])[y.astype(int)], 2 * p * (1 - p)
        step = np.zeros_like(margin)
        for k in range(margin.shape[1]):

            def grow(own, left, k=k):
                sg, sh = (g[own, k] * w[own]).sum(), (h[own, k] * w[own]).sum()
                step[own, k] = -rate * sg / (sh + l2)
                best = (1e-9 * max(1, abs(sg)), None)
                if left == 0:
                    return
                for f in range(bins.shape[1]):
                    for cut in range(1, n_bins):
                        for way in (True, False):
                            goes = (bins[own, f] == 0) & way | (bins[own, f] > 0) & (bins[own, f] <= cut)
                            a, b = own[goes], own[~goes]
                            ha, hb = (h[a, k] * w[a]).sum(), (h[b, k] * w[b]).sum()
                            if len(a) and len(b) and ha >= min_child and hb >= min_child:
                                ga, gb = (g[a, k] * w[a]).sum(), (g[b, k] * w[b]).sum()
                                gain = ga**2 / (ha + l2) + gb**2 / (hb + l2) - sg**2 / (sh + l2)
                                if gain > best[0] * (1 + 1e-9):
                                    best = (gain, (a, b))
                if best[1]:
                    grow(best[1][0], left - 1)
                    grow(best[1][1], left - 1)

            grow(np.arange(len(y)), depth)
        margin = margin + step
    return margin


@pytest.mark.parametrize(("objective", "classes"), [("squared", 1), ("logistic", 2), ("softmax", 3)])
def test_margins_equal_a_plain_version(spark, objective, classes):
    data = rows(classes=classes)
    n = classes if objective == "softmax" else 1
    args = dict(objective=objective, classes=n, weight="w", rounds=4, depth=3, rate=0.4, l2=0.7, min_child=2.0, most_bins=8)
    df = spark.createDataFrame(data, SCHEMA)
    model = B.fit_boosted(df.repartition(5), ["a", "b", "c"], "y", keep=2, **args)
    kept = [r for r in data if r[3] is not None and r[4]]
    x = np.array([[math.nan if v is None else v for v in r[:3]] for r in kept])
    y, w = (np.array([r[k] for r in kept]) for k in (3, 4))
    bins = model.bins(x)
    want = plain_trees(bins, y, w, model.base, objective, 4, 3, 0.4, 0.7, 2.0, int(bins.max()) + 1)
    assert np.abs(model.base + model.margins_of(bins) - want).max() < 1e-5
    again = B.fit_boosted(df.repartition(2), ["a", "b", "c"], "y", keep=10, **args)
    assert np.array_equal(again.margins_of(bins), model.margins_of(bins)) or np.abs(again.margins_of(bins) - model.margins_of(bins)).max() < 1e-9
    scored = df.where("y is not null and w > 0").select("y", model.margins().alias("m"), model.prediction().alias("p")).collect()
    assert sorted(round(r.m[0], 6) for r in scored) == sorted(np.round(want[:, 0], 6)) or np.abs(np.sort([r.m[0] for r in scored]) - np.sort(want[:, 0])).max() < 1e-5
    if objective == "squared":
        assert np.mean([(r.p - r.y) ** 2 for r in scored]) < 0.35 * np.var(y)
    elif objective == "softmax":
        assert all(abs(sum(r.p) - 1) < 1e-9 for r in scored) and np.mean([np.argmax(r.p) == r.y for r in scored]) > 0.75
    assert sum(model.importance().values()) > 3


def expected(tree, bins, known, node=0):
    """The tree's value where only the features in ``known`` are: other splits by the covers of their sides."""
    f = tree.feature[node]
    if f < 0:
        return tree.value[node]
    left, right = tree.left[node], tree.right[node]
    if f in known:
        goes_left = tree.missing_left[node] if bins[f] == 0 else bins[f] <= tree.cut[node]
        return expected(tree, bins, known, left if goes_left else right)
    share = tree.cover[left] / tree.cover[node]
    return share * expected(tree, bins, known, left) + (1 - share) * expected(tree, bins, known, right)


def test_contributions_equal_enumeration(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    model = B.fit_boosted(df, ["a", "b", "c"], "y", rounds=5, depth=4, most_bins=8, weight="w")
    x = np.array([[math.nan if v is None else v for v in r[:3]] for r in rows()[:25]])
    bins, n = model.bins(x), 3
    got = B.shapley(model, bins)[:, 0]
    for row, own in zip(got, bins):
        for f in range(n):
            want = 0.0
            for size in range(n):
                for s in itertools.combinations([k for k in range(n) if k != f], size):
                    weight = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
                    want += weight * sum(expected(t[0], own, {*s, f}) - expected(t[0], own, set(s)) for t in model.trees)
            assert abs(row[f] - want) < 1e-9
    assert np.abs(got.sum(1) - (model.base + model.margins_of(bins))[:, 0]).max() < 1e-9


def test_decomposition_and_override(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    model = B.fit_boosted(df, ["a", "b", "c"], "y", rounds=3, most_bins=8)
    out = B.decompose(df, model, "pre").withColumn("m", model.margins()[0]).collect()
    for r in out:
        parts = [r[f"pre__{f}__contrib"] for f in "abc"]
        assert abs(r.pre_base + sum(parts) - r.m) < 1e-9 and abs(r.pre_raw - r.m) < 1e-9
        assert r.pre_weights_reliable == (abs(sum(parts)) >= 1)
        if abs(sum(parts)) > 1e-6:
            assert abs(sum(r[f"pre__{f}__weight"] for f in "abc") - 1) < 1e-6
    moved = B.what_if(df, model, {"a": 3.0}, F.col("c") == 1).collect()
    assert all(not r.moved for r in moved if r.c != 1) and any(r.moved for r in moved)
    want = {r.m for r in df.where("c = 1").withColumn("a", F.lit(3.0)).select(model.margins()[0].alias("m")).collect()}
    assert {r.margin_after for r in moved if r.c == 1} == want
    assert [(r.a is None) for r in moved] == [x[0] is None for x in rows()]
    with pytest.raises(ValueError, match="unknown"):
        B.what_if(df, model, {"aa": 1.0})


def test_no_rows_and_constant_features(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    none = B.fit_boosted(df.limit(0), ["a", "b"], "y")
    assert none.trees == [] and [r[0] for r in df.limit(2).select(none.margins()).collect()] == [[0.0], [0.0]]
    flat = B.fit_boosted(df.withColumn("k", F.lit(1.0)), ["k"], "y", rounds=2)
    assert all(t[0].feature == [-1] for t in flat.trees)
