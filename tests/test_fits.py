"""Fits from Spark's sums against dense single-process fits and plain loops."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomfield.operators import likelihood as L
from loomfield.operators.isotonic import isotonic
from loomfield.operators import moments as M


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(12)
    n = 600
    x = rng.normal(size=(n, 3))
    x[:, 2] += 0.5 * x[:, 0]
    y = 1.5 + 2.0 * x[:, 0] - 1.0 * x[:, 1] + rng.normal(size=n)
    return x, y


@pytest.fixture(scope="module")
def table(spark, data):
    x, y = data
    rows = [(k, k % 5, k % 3, *map(float, r), float(t), float(t > 1.5)) for k, (r, t) in enumerate(zip(x, y))]
    rows += [(9000, 0, 0, None, 1.0, 1.0, 1.0, 1.0), (9001, 0, 0, math.nan, 1.0, 1.0, 1.0, 1.0), (9002, 1, 1, 1.0, 1.0, 1.0, None, None)]
    return spark.createDataFrame(rows, "id bigint, fold int, g int, a double, b double, c double, y double, up double").repartition(4)


def test_nonnegative_blend(table, data):
    x, y = data
    got = {r.g: r for r in M.nonnegative_blend(table.where("g < 2 or id < 60"), ["a", "b", "c"], "y", "g", forced=1).collect()}

    def best(own):
        """The least squares over every set of columns that may be free."""
        out = None
        for size in range(4):
            for s in itertools.combinations(range(3), size):
                a = np.column_stack([np.ones(own.sum()), x[own][:, list(s)]])
                b = np.linalg.lstsq(a, y[own], rcond=None)[0]
                if (b[1:] >= 0).all():
                    lost = ((y[own] - a @ b) ** 2).sum()
                    if out is None or lost < out[0] - 1e-9:
                        out = (lost, b[0], dict(zip(s, b[1:])))
        return out

    i = np.arange(len(y))
    _, intercept, w = best(i % 3 == 0)
    assert np.allclose([got[0].w_a, got[0].w_b, got[0].w_c, got[0].intercept], [*(w.get(k, 0) for k in range(3)), intercept], atol=1e-9)
    assert (got[1].w_a, got[1].w_b, got[1].w_c, got[1].intercept) == (1.0, 0.0, 0.0, 0.0)
    _, intercept, w = best((i % 3 < 2) | (i < 60))  # 20 rows: the pooled fit
    assert got[2].rows == 20 and np.allclose([got[2].w_a, got[2].w_b, got[2].w_c, got[2].intercept], [*(w.get(k, 0) for k in range(3)), intercept], atol=1e-9)


def test_clipped_weights(table, data):
    x, y = data
    got = {r.g: r for r in M.clipped_weights(table, ["a", "b", "c"], "y", ["g"]).collect()}
    for g in range(3):
        own = np.arange(len(y)) % 3 == g
        t = (y[own] - y[own].mean()) / y[own].std()
        a = np.column_stack([np.ones(own.sum()), x[own]])
        b = np.linalg.lstsq(a, t, rcond=None)[0]
        w = np.maximum(b[1:], 0) / np.maximum(b[1:], 0).sum()
        assert np.allclose([got[g].w_a, got[g].w_b, got[g].w_c], w, atol=1e-9) and abs(got[g].r2 - (1 - ((t - a @ b) ** 2).sum() / (t**2).sum())) < 1e-9
    few = M.clipped_weights(table.where("id < 90"), ["a", "b", "c"], "y", ["g"]).collect()
    assert all(r.w_a == r.w_b == r.w_c == 1 / 3 and r.r2 is None for r in few)


def test_cross_validated_r2(table, data):
    x, y = data
    sets = {"one": ["a"], "two": ["a", "b"], "all": ["a", "b", "c"]}
    got = M.cross_validated_r2(table, sets, "y", F.col("fold"), alpha=10.0)
    for name, n, r2 in got:
        cols = ["abc".index(c) for c in sets[name]]
        each = []
        for f in range(5):
            own = np.arange(len(y)) % 5 == f
            mean, base = x[~own][:, cols].mean(0), y[~own].mean()
            a = x[~own][:, cols] - mean
            b = np.linalg.solve(a.T @ a + 10 * np.eye(len(cols)), a.T @ (y[~own] - base))
            p = base + (x[own][:, cols] - mean) @ b
            each.append(1 - ((y[own] - p) ** 2).sum() / ((y[own] - y[own].mean()) ** 2).sum())
        assert n == len(cols) and abs(r2 - np.mean(each)) < 1e-9


def test_choose_blend(table, data):
    x, y = data
    grams = [M.matrix(r.moments, 3) for r in M.gram(table.where("g < 2"), ["a", "b", "c"], "y", ["g"]).collect()]
    ticks = [k / 10 for k in range(11)]
    grid = [((p, q), np.array([(1 - q) * (1 - p), (1 - q) * p, q])) for p in ticks for q in ticks]
    got = M.choose_blend(grams, grid, lambda p: p[1])
    i, scored = np.arange(len(y)), []
    for point, w in grid:
        scored.append((np.mean([np.corrcoef(x[i % 3 == g] @ w, y[i % 3 == g])[0, 1] for g in (0, 1)]), point))
    best = max(scored)[0]
    band = 0.5 * (1 - best**2) / math.sqrt((i % 3 < 2).sum())
    r, point = min((s for s in scored if s[0] >= best - band), key=lambda s: (s[1][1], -s[0]))
    assert got["point"] == point and abs(got["r"] - r) < 1e-9 and abs(got["best"] - best) < 1e-9 and got["rows"] == (i % 3 < 2).sum()
    assert M.choose_blend(grams, grid, lambda p: p[1], least_rows=10_000)["point"] is None
    assert all(abs(w.sum() - 1) < 1e-9 for _, w in M.shares_grid(0.25))


def test_walk_forward_search(table, data):
    x, y = data
    grams = {r.fold: M.matrix(r.moments, 3) for r in M.gram(table, ["a", "b", "c"], "y", ["fold"]).collect()}
    default, incumbent = {"alpha": 1.0, "half_life": None, "columns": [0, 1, 2]}, {"alpha": 1000.0, "half_life": None, "columns": [2]}
    candidates = [default, incumbent, {"alpha": 10.0, "half_life": 2.0, "columns": [0, 1]}, *M.random_candidates(17, 5, 3)]
    scored = M.walk_forward_errors(grams, candidates, validate=2)
    i = np.arange(len(y)) % 5
    for error, c in scored:
        lost, n = 0.0, 0
        for s in (3, 4):
            w = np.array([0.0 if t >= s else 1.0 if c["half_life"] is None else 0.5 ** ((s - 1 - t) / c["half_life"]) for t in i])
            a = np.column_stack([np.ones(len(y)), x[:, c["columns"]]])
            pen = np.diag([0.0] + [c["alpha"]] * len(c["columns"]))
            b = np.linalg.solve(a.T @ (a * w[:, None]) + pen, a.T @ (w * y))
            lost, n = lost + ((y - a @ b)[i == s] ** 2).sum(), n + (i == s).sum()
        assert abs(error - math.sqrt(lost / n)) < 1e-9
    assert M.random_candidates(17, 5, 3) == candidates[3:]
    chosen, why = M.keep_or_replace(scored, default, incumbent)
    assert why in ("best", "default") and chosen != incumbent
    assert M.keep_or_replace(scored, default, min(scored, key=lambda s: s[0])[1])[1] == "incumbent"
    assert M.keep_or_replace([(1.0, default), (0.95, incumbent), (0.9, candidates[2])], default, incumbent)[1] == "incumbent"
    assert M.keep_or_replace([(1.0, default), (1.5, incumbent), (1.2, candidates[2])], default, None)[1] == "default"


def test_bootstrap(spark):
    rng = np.random.default_rng(3)
    rows = [(k, "early" if k % 2 else "mid", float(round(v))) for k, v in enumerate(rng.normal(0, [10.0, 12.0] * 300))]
    df = spark.createDataFrame(rows, "k bigint, part string, v double").repartition(3)
    got = {(r.replicate, r.part): (r.n, r.s, r.ss) for r in M.bootstrap_moments(df, "k", "part", "v", 200).collect()}
    keys, v = np.arange(600), np.array([r[2] for r in rows])
    weights = np.stack([np.searchsorted(M._POISSON, M.hashed_uniform(keys, b), side="right") for b in range(200)])
    assert abs(weights.mean() - 1) < 0.02 and abs(weights.var() - 1) < 0.05
    assert abs(np.corrcoef(weights)[np.triu_indices(200, 1)].mean()) < 0.01 and abs(np.corrcoef(weights.T[:100])[np.triu_indices(100, 1)].mean()) < 0.02
    for b in range(200):
        for part in (0, 1):
            w, own = weights[b, part::2], v[part::2]
            assert got[b, ("mid", "early")[part]] == (w.sum(), (w * own).sum(), (w * own * own).sum())
    r = M.bootstrap_sd_ratio(df, "k", "part", "v", "early", "mid", replicates=400).first()
    assert abs(r.ratio - v[1::2].std() / v[::2].std()) < 1e-9
    draws = [rng.choice(v[1::2], 300).std() / rng.choice(v[::2], 300).std() for _ in range(2000)]
    assert abs(r.lo - np.percentile(draws, 2.5)) < 0.04 and abs(r.hi - np.percentile(draws, 97.5)) < 0.04 and r.apart == (r.lo > 1 or r.hi < 1)


def dense_logistic(x, y, penalty=1.0):
    a = np.column_stack([np.ones(len(y)), x])
    b = np.zeros(a.shape[1])
    shrink = np.array([0.0] + [penalty] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ b))
        b = b - np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + np.diag(shrink), a.T @ (p - y) + shrink * b)
    return b


def test_logistic_folds(table, data):
    x, y = data
    up = (y > 1.5).astype(float)
    z = (x - x.mean(0)) / x.std(0)
    whole = table.where("a is not null and not isnan(a) and up is not null")
    model = L.fit_logistic(whole, ["a", "b", "c"], "up", fold=F.col("fold"), folds=5)
    i = np.arange(len(y)) % 5
    for f in range(5):
        assert np.allclose(model.coefficients[f], dense_logistic(z[i != f], up[i != f]), atol=1e-8)
    assert np.allclose(model.coefficients[5], dense_logistic(z, up), atol=1e-8)
    got = {r.id: r.p for r in whole.select("id", model.chance(F.col("fold")).alias("p")).collect()}
    want = [1 / (1 + math.exp(-np.concatenate(([1], z[k])) @ model.coefficients[k % 5])) for k in range(len(y))]
    assert np.allclose([got[k] for k in range(len(y))], want, atol=1e-9)


def test_labels_in_stages(spark, table, data):
    _, y = data
    df = table.withColumn("up", F.when(F.col("id") % 4 > 0, F.col("up"))).withColumn("c", F.when(F.col("id") % 8 != 0, F.col("c"))).withColumn("b", F.when(F.col("id") != 9001, F.col("b")))
    out, reports = L.label_in_stages(df, "up", [["a", "b", "c"], ["a"]], F.col("fold"))
    rows = {r.id: r for r in out.collect()}
    assert rows[1].role_source == "label" and rows[4].role_source == "stage 0" and rows[8].role_source == "stage 1" and rows[9000].role_source == "default"
    missing = out.where("a is null and id < 9000").count()
    assert missing == 0 and all(r["accuracy"] > 0.7 and r["area"] > 0.8 for r in reports)
    assert all((r.role == 1) == (r.chance > 0.5) for r in rows.values() if r.role_source.startswith("stage"))
    few, none = L.label_in_stages(df.where("id < 40"), "up", [["a"]], F.col("fold"))
    assert none[0]["accuracy"] is None and {r.role_source for r in few.collect()} == {"label", "default"}
    p = spark.createDataFrame([(1.0, 0.9), (0.0, 0.2), (1.0, 0.2), (0.0, 0.1), (1.0, 0.6)], "y double, p double")
    assert L.area_and_accuracy(p) == {"accuracy": 0.8, "area": (2 + 2 + 1.5) / 6}


def test_ordered_probit(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(900, 2)), 1)
    y = np.clip(np.round(2 * (x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=900))), -4, 4)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)] + [(None, 1.0, 1.0), (1.0, 1.0, None)], "a double, b double, y double")
    model = L.fit_ordered_probit(df, ["a", "b"], "y")
    levels = np.unique(y)
    assert model.levels == levels.tolist() and (np.diff(model.thresholds) > 0).all()

    def loss(thresholds, slopes):
        line, at = x @ slopes, np.searchsorted(levels, y)
        ends = np.concatenate(([-np.inf], thresholds, [np.inf]))
        return -np.log(L.normal_below(ends[at + 1] - line) - L.normal_below(ends[at] - line)).sum()

    assert abs(loss(model.thresholds, model.slopes) - model.loss) < 1e-6
    point = np.concatenate((model.thresholds, model.slopes))
    for k in range(len(point)):  # no direction goes down
        for eps in (1e-4, -1e-4):
            moved = point.copy()
            moved[k] += eps
            assert loss(moved[: len(levels) - 1], moved[len(levels) - 1 :]) > model.loss - 1e-9
    grad = [(loss(*np.split(point + d, [len(levels) - 1])) - loss(*np.split(point - d, [len(levels) - 1]))) / 2e-5 for d in np.eye(len(point)) * 1e-5]
    assert np.abs(grad).max() < 1e-3
    assert abs(model.slopes[0] - 2 / 2) < 0.15 and abs(model.slopes[1] + 0.5) < 0.15
    ladder = model.ladder(spark.createDataFrame([(0.5, 0.0, "x"), (-1.0, 2.0, "y")], "a double, b double, name string"), ["a", "b"])
    rows = ladder.groupBy("name").agg(F.sum("chance").alias("s"), F.count("*").alias("n")).collect()
    assert all(abs(r.s - 1) < 1e-9 and r.n == len(levels) for r in rows)
    with pytest.raises(ValueError, match="levels"):
        L.fit_ordered_probit(df, ["a"], "y", most_levels=3)
    assert L.fit_ordered_probit(df.limit(0), ["a"], "y").levels == []


def test_isotonic_is_the_nearest_rising_function(spark):
    rng = np.random.default_rng(9)
    y, w = np.arange(60) / 30 + rng.normal(size=60), rng.integers(0, 5, 60).astype(float)
    bins = spark.createDataFrame([(k * 3, float(a), float(b)) for k, (a, b) in enumerate(zip(y, w))], "q int, y double, w double").repartition(5)
    got = {r.q // 3: r.fit for r in isotonic(bins, "q", "y", "w").collect()}
    there = np.flatnonzero(w > 0)
    assert sorted(got) == there.tolist()
    a, b = y[there], w[there]
    mean = lambda i, j: (a[i : j + 1] * b[i : j + 1]).sum() / b[i : j + 1].sum()
    for k, q in enumerate(there):  # the largest over starts of the least over ends
        want = max(min(mean(i, j) for j in range(k, len(a))) for i in range(k + 1))
        assert abs(got[q] - want) < 1e-9
    assert isotonic(bins.limit(0), "q", "y", "w").count() == 0
