"""Linear fits from sums: Spark makes one moment matrix a group in one pass, and everything after works on those alone.

``gram`` gives for each group the sums of products of the columns 1, x1, ..., xk, y in the order of ``pairs``. Fits on
several folds or seasons add and subtract these sums, so the rows are read once however many candidates are scored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k + 2) for j in range(i, k + 2)]


def gram(df: DataFrame, features: list[str], label: str, by: list[str], weight: Column | None = None) -> DataFrame:
    """(by, rows, moments): ``moments`` holds the weighted sums of products of 1, features, label; rows with a null in any are left out."""
    values = [F.lit(1.0), *(F.col(c).cast("double") for c in (*features, label))]
    whole = df.where(" and ".join(f"`{c}` is not null and not isnan(`{c}`)" for c in (*features, label)))
    w = F.lit(1.0) if weight is None else weight
    sums = [F.sum(values[i] * values[j] * w) for i, j in pairs(len(features))]
    return whole.groupBy(*by).agg(F.count("*").alias("rows"), F.array(*sums).alias("moments"))


def matrix(m, k: int) -> np.ndarray:
    """The symmetric matrix of one row of ``gram``."""
    out = np.zeros((k + 2, k + 2))
    for v, (i, j) in zip(m, pairs(k)):
        out[i, j] = out[j, i] = v
    return out


def centred(g: np.ndarray) -> np.ndarray:
    """Sums of products about the means, of x1, ..., xk, y."""
    n = g[0, 0]
    return g[1:, 1:] - np.outer(g[0, 1:], g[0, 1:]) / n if n else g[1:, 1:] * 0


def ridge_of(g: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of ridge regression; the intercept is not penalised."""
    s = centred(g)
    b = np.linalg.lstsq(s[:-1, :-1] + alpha * np.eye(len(s) - 1), s[:-1, -1], rcond=None)[0]
    return b, float((g[0, -1] - b @ g[0, 1:-1]) / g[0, 0]) if g[0, 0] else 0.0


def residual_squares(g: np.ndarray, b: np.ndarray, intercept: float) -> float:
    """The sum of squared residuals of a fit over the rows that ``g`` sums."""
    c = np.concatenate(([intercept], b, [-1.0]))
    return float(c @ g @ c)


def nonnegative(s: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The least w' s w / 2 - c' w over w >= 0, by an active set: the steepest column enters, those that turn negative leave."""
    w, free = np.zeros(len(c)), np.zeros(len(c), bool)
    scale = 1e-10 * max(1.0, float(np.abs(c).max(initial=0)))
    for _ in range(10 * len(c) + 10):
        slope = np.where(free, -np.inf, c - s @ w)
        k = int(np.argmax(slope))
        if slope[k] <= scale:
            break
        free[k] = True
        while free.any():
            z = np.zeros(len(c))
            z[free] = np.linalg.lstsq(s[np.ix_(free, free)], c[free], rcond=None)[0]
            under = free & (z <= 0)
            if not under.any():
                w = z
                break
            step = np.min(w[under] / np.where(w[under] > z[under], w[under] - z[under], np.inf), initial=1.0)
            w = np.maximum(w + step * (z - w), 0)
            free &= ~(under & (w <= 1e-14))
    return w


def _by_group(grams: DataFrame, keys: list[str], schema: str, row_of: Callable) -> DataFrame:
    """One row for each group of ``grams``, made where the group is; nothing passes the driver."""
    at = [grams.columns.index(c) for c in keys]
    rows, m = grams.columns.index("rows"), grams.columns.index("moments")

    def run(batches):
        for frame in batches:
            out = [(*(r[k] for k in at), *row_of(r[rows], r[m])) for r in frame.itertuples(index=False)]
            yield pd.DataFrame(out, columns=[*(f"k{k}" for k in range(len(at))), *(f"v{k}" for k in range(len(out[0]) - len(at)))] if out else None)

    names = ", ".join(f"k{k} {grams.schema[c].dataType.simpleString()}" for k, c in enumerate(keys))
    fields = [part.rsplit(" ", 1) for part in schema.split(", ")]
    renamed = {f"k{k}": c for k, c in enumerate(keys)} | {f"v{k}": name for k, (name, _) in enumerate(fields)}
    return grams.mapInPandas(run, names + ", " + ", ".join(f"v{k} {kind}" for k, (_, kind) in enumerate(fields))).withColumnsRenamed(renamed)


def nonnegative_blend(df: DataFrame, features: list[str], label: str, by: str, *, least_rows: int = 40, forced=None) -> DataFrame:
    """(by, rows, w_<feature>..., intercept): non-negative least squares with an intercept for each value of ``by``. Groups
    under ``least_rows`` take the pooled fit; the group ``forced`` takes the first feature as it is."""
    k = len(features)
    groups = gram(df, features, label, [by])
    pooled = groups.agg(F.array(*(F.sum(F.col("moments")[i]) for i in range(len(pairs(k))))).alias("moments")).first().moments

    def fit(m):
        g = matrix(m, k)
        s = centred(g)
        w = nonnegative(s[:-1, :-1], s[:-1, -1])
        return (*w.tolist(), float((g[0, -1] - w @ g[0, 1:-1]) / g[0, 0]))

    of_all = fit(pooled) if pooled and pooled[0] else (0.0,) * (k + 1)
    fitted = _by_group(groups, [by], "rows bigint, " + ", ".join(f"w_{c} double" for c in features) + ", intercept double", lambda n, m: (n, *(fit(m) if n >= least_rows else of_all)))
    if forced is None:
        return fitted
    own = F.col(by) == F.lit(forced)
    return fitted.withColumns({f"w_{c}": F.when(own, float(i == 0)).otherwise(F.col(f"w_{c}")) for i, c in enumerate(features)} | {"intercept": F.when(own, 0.0).otherwise(F.col("intercept"))})


def clipped_weights(df: DataFrame, features: list[str], label: str, by: list[str], *, least_rows: int = 100) -> DataFrame:
    """(by, rows, w_<feature>..., r2): least squares coefficients on the standardised label, negative ones set to 0, of sum 1.
    Groups under ``least_rows``, or with no positive coefficient, weigh all alike; r2 (of the unclipped fit) is null there."""
    k = len(features)
    equal = (1.0 / k,) * k

    def fit(n, m):
        if n < least_rows:
            return (n, *equal, None)
        s = centred(matrix(m, k))
        b = np.linalg.lstsq(s[:-1, :-1], s[:-1, -1], rcond=None)[0]
        r2 = float(b @ s[:-1, -1] / s[-1, -1]) if s[-1, -1] > 0 else None
        w = np.maximum(b, 0)
        return (n, *((w / w.sum()).tolist() if w.sum() > 0 else equal), r2)

    return _by_group(gram(df, features, label, by), by, "rows bigint, " + ", ".join(f"w_{c} double" for c in features) + ", r2 double", fit)


def cross_validated_r2(df: DataFrame, sets: dict[str, list[str]], label: str, fold: Column, *, alpha: float = 10.0) -> list[tuple[str, int, float]]:
    """(set, features, mean R2 over the folds) of ridge regression for every set of features: a fold is scored by the fit on
    all sums less its own. One pass over the rows, on those where no feature of any set is null."""
    every = sorted({c for cols in sets.values() for c in cols})
    found = {r.fold: matrix(r.moments, len(every)) for r in gram(df.withColumn("fold", fold), every, label, ["fold"]).collect()}
    total = sum(found.values()) if found else None
    out = []
    for name, cols in sets.items():
        at = [0, *(1 + every.index(c) for c in cols), len(every) + 1]
        r2 = []
        for g in found.values():
            own, rest = g[np.ix_(at, at)], (total - g)[np.ix_(at, at)]
            spread = centred(own)[-1, -1]
            if rest[0, 0] and spread > 0:
                r2.append(1 - residual_squares(own, *ridge_of(rest, alpha)) / spread)
        out.append((name, len(cols), float(np.mean(r2)) if r2 else None))
    return out


def correlation_of_blend(g: np.ndarray, w: np.ndarray) -> float:
    """Pearson correlation of the blend of the features by ``w`` with the label."""
    s = centred(g)
    spread = (w @ s[:-1, :-1] @ w) * s[-1, -1]
    return float(w @ s[:-1, -1] / np.sqrt(spread)) if spread > 0 else float("nan")


def choose_blend(grams: list[np.ndarray], grid: list[tuple[tuple, np.ndarray]], lean: Callable, *, least_rows: int = 100, errors: float = 0.5) -> dict:
    """The grid point to take by the correlation averaged over tiers of at least ``least_rows``: of all within ``errors``
    standard errors of the best the one with the least ``lean``, then the best of those."""
    tiers = [g for g in grams if g[0, 0] >= least_rows]
    n = sum(g[0, 0] for g in grams)
    scored = [(float(np.mean([correlation_of_blend(g, w) for g in tiers])), point) for point, w in grid] if tiers else []
    scored = [(r, p) for r, p in scored if not np.isnan(r)]
    if not scored:
        return {"point": None, "r": None, "best": None, "best_point": None, "band": None, "rows": int(n)}
    best, best_point = max(scored)
    band = errors * (1 - best**2) / np.sqrt(n)
    r, point = min((s for s in scored if s[0] >= best - band), key=lambda s: (round(lean(s[1]), 4), -s[0], s[1]))
    return {"point": point, "r": r, "best": best, "best_point": best_point, "band": band, "rows": int(n)}


def shares_grid(step: float = 0.05, most: tuple[float, ...] = (0.8, 0.5, 0.6), most_measured: float = 0.9) -> list[tuple[tuple, np.ndarray]]:
    """((second, third, outside), weights of four parts): the outside part takes its share of the whole, the others theirs of the rest."""
    ticks = [np.round(np.arange(0, m + step / 2, step), 10).tolist() for m in most]
    out = []
    for a, b, c in itertools.product(*ticks):
        if a + b <= most_measured + 1e-9:
            out.append(((a, b, c), np.array([(1 - c) * (1 - a - b), (1 - c) * a, (1 - c) * b, c])))
    return out


def walk_forward_errors(grams: dict[int, np.ndarray], candidates: list[dict], *, validate: int = 3, least_train: int = 2) -> list[tuple[float, dict]]:
    """(root mean squared error, candidate) for candidates of ``alpha``, ``half_life`` (of a season's weight, None: all alike)
    and ``columns`` (positions of features): each of the last seasons is scored by a fit on those before it."""
    seasons = sorted(grams)
    out = []
    for candidate in candidates:
        at = [0, *(1 + c for c in candidate["columns"]), len(next(iter(grams.values()))) - 1]
        lost, n = 0.0, 0.0
        for s in seasons[-validate:]:
            before = [t for t in seasons if t < s]
            if len(before) < least_train:
                continue
            life = candidate["half_life"]
            train = sum(grams[t][np.ix_(at, at)] * (1.0 if life is None else 0.5 ** ((s - 1 - t) / life)) for t in before)
            own = grams[s][np.ix_(at, at)]
            lost += residual_squares(own, *ridge_of(train, candidate["alpha"]))
            n += own[0, 0]
        out.append((float(np.sqrt(max(lost, 0.0) / n)) if n else float("inf"), candidate))
    return out


def random_candidates(seed: int, n: int, k: int) -> list[dict]:
    """Seeded candidates for ``walk_forward_errors``, weighted toward strong penalties."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        columns = np.flatnonzero(rng.random(k) < 0.75)
        out.append({"alpha": float(rng.choice([0.1, 1, 10, 10, 100, 1000])), "half_life": [None, 1.0, 2.0, 4.0][int(rng.integers(4))], "columns": columns.tolist() or [int(rng.integers(k))]})
    return out


def keep_or_replace(scored: list[tuple[float, dict]], default: dict, incumbent: dict | None, least_gain: float = 0.10) -> tuple[dict, str]:
    """The candidate to ship and why: the best one, unless it does not beat the incumbent by more than ``least_gain``, or,
    without an incumbent that holds, the default."""
    best_error, best = min(scored, key=lambda s: s[0])
    error_of = lambda c: next(e for e, x in scored if x == c)
    if incumbent is not None and best_error >= error_of(incumbent) - least_gain:
        return incumbent, "incumbent"
    if best_error >= error_of(default):
        return default, "default"
    return best, "best"


#: Poisson(1) tails: a uniform number over the k-th has at least k + 1 copies.
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate(([1.0], np.arange(1.0, 16.0)))))
PRIME = 2147483647


def hashed_uniform(key: np.ndarray, replicate: int) -> np.ndarray:
    """Numbers in [0, 1) from row keys and a replicate, by squares modulo a prime; the same wherever they are made."""
    x = (key % PRIME * 48271 + replicate * 69621 + 11) % PRIME
    for plus in (1013904223, 12345, 1664525):
        x = (x * x + plus) % PRIME
        x = (x * 16807 + replicate) % PRIME
    return x / PRIME


def bootstrap_moments(df: DataFrame, key: str, group: str, value: str, replicates: int) -> DataFrame:
    """(replicate, group, n, s, ss): weighted counts, sums and squares of ``value`` (whole numbers scale exactly) under
    Poisson weights that follow from (key, replicate). One pass; a task sends one row a group and replicate."""
    kind = df.schema[group].dataType.simpleString()

    def run(batches):
        total: dict = {}
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            v = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
            names, own = np.unique(np.array(batch.column(1).to_pylist(), object), return_inverse=True)
            sums = np.zeros((replicates, len(names), 3))
            for b in range(replicates):
                w = np.searchsorted(_POISSON, hashed_uniform(keys, b), side="right").astype(float)
                for part, x in enumerate((w, w * v, w * v * v)):
                    sums[b, :, part] = np.bincount(own, x, len(names))
            for k, name in enumerate(names):
                total[name] = total.get(name, 0) + sums[:, k]
        for name, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates, dtype=np.int32)), pa.array([name] * replicates), *(pa.array(sums[:, k]) for k in range(3))], ["replicate", group, "n", "s", "ss"])

    rows = df.select(F.col(key).cast("bigint"), group, F.col(value).cast("double")).dropna()
    sums = rows.mapInArrow(run, f"replicate int, {group} {kind}, n double, s double, ss double")
    return sums.groupBy("replicate", group).agg(*(F.sum(c).alias(c) for c in ("n", "s", "ss")))


def bootstrap_sd_ratio(df: DataFrame, key: str, group: str, value: str, first, second, *, replicates: int = 4000, tail: float = 0.025) -> DataFrame:
    """(ratio, lo, hi, apart): the ratio of two groups' standard deviations, its percentile interval over the replicates,
    and whether that leaves out 1."""
    moments = bootstrap_moments(df.where(F.col(group).isin(first, second)), key, group, value, replicates)
    spread = F.sqrt(F.col("ss") / F.col("n") - (F.col("s") / F.col("n")) ** 2)
    sides = moments.groupBy("replicate").agg(F.max(F.when(F.col(group) == first, spread)).alias("a"), F.max(F.when(F.col(group) == second, spread)).alias("b"))
    ends = sides.where("b > 0").select((F.col("a") / F.col("b")).alias("r")).agg(F.percentile("r", tail).alias("lo"), F.percentile("r", 1 - tail).alias("hi"))
    side = lambda g: F.stddev_pop(F.when(F.col(group) == g, F.col(value)))
    ratio = df.agg((side(first) / side(second)).alias("ratio"))
    return ratio.crossJoin(F.broadcast(ends)).withColumn("apart", (F.col("lo") > 1) | (F.col("hi") < 1))  # one row each
