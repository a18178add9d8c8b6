"""Maximum likelihood by Newton steps whose gradients and Hessians Spark sums: logistic regression for all folds at
once, and ordered probit. Tasks send one matrix a model, of a size that the columns and levels bound."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomfield.operators.relational import ordered_numbers
from loomfield.sources.tables import stored


def _summed(rows: DataFrame, size: int, of) -> np.ndarray:
    """The sum over all batches of the vectors that ``of`` gives for each."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += of(batch)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "v"])

    out = np.zeros(size)
    for r in rows.mapInArrow(run, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r.at] = r.v
    return out


class Logistic:
    """Standardised features, one coefficient vector a fold (fitted without it) and, last, that of all rows."""

    def __init__(self, features: list[str], mean: np.ndarray, sd: np.ndarray, coefficients: np.ndarray):
        self.features, self.mean, self.sd, self.coefficients = features, mean, sd, coefficients

    def chance(self, fold: Column | None = None) -> Column:
        """The chance of label 1: by the fit without the row's ``fold``, or by that of all rows; null where a feature is."""
        z = [(F.col(f).cast("double") - float(m)) / float(s) for f, m, s in zip(self.features, self.mean, self.sd)]

        def by(beta):
            line = F.lit(float(beta[0]))
            for b, x in zip(beta[1:], z):
                line = line + float(b) * x
            return 1 / (1 + F.exp(-line))

        if fold is None:
            return by(self.coefficients[-1])
        out = F.lit(None).cast("double")
        for k, beta in enumerate(self.coefficients[:-1]):
            out = F.when(fold == k, by(beta)).otherwise(out)
        return out


def fit_logistic(df: DataFrame, features: list[str], label: str, *, fold: Column | None = None, folds: int = 0, penalty: float = 1.0, steps: int = 30, tolerance: float = 1e-10) -> Logistic:
    """Logistic regression with a squared penalty (halved) on standardised coefficients, none on the intercept; for each of
    ``folds`` on the rows of the others, and on all rows. Every step reads the stored rows once for all of these."""
    k, models = len(features), folds + 1
    f = F.lit(-1) if fold is None else fold
    values = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)]
    rows = stored(df.select(*values, F.col(label).cast("double").alias("y"), f.cast("int").alias("fold")).dropna(), "logistic")
    seen = rows.agg(*(g(f"x{i}").alias(f"{name}{i}") for i in range(k) for name, g in (("m", F.avg), ("s", F.stddev_pop)))).first()
    mean = np.array([seen[f"m{i}"] or 0.0 for i in range(k)])
    sd = np.array([seen[f"s{i}"] or 1.0 for i in range(k)])
    beta = np.zeros((models, k + 1))
    lost, size = np.full(models, np.inf), 1 + (k + 1) + (k + 1) ** 2
    trial, step = beta, np.zeros_like(beta)
    for _ in range(steps):

        def of(batch, trial=trial):
            x = np.column_stack([np.ones(batch.num_rows), *((batch.column(i).to_numpy() - mean[i]) / sd[i] for i in range(k))])
            y, own = batch.column(k).to_numpy(), batch.column(k + 1).to_numpy()
            out = np.zeros((models, size))
            for j in range(models):
                a, b = (x, y) if j == folds else (x[own != j], y[own != j])
                line = a @ trial[j]
                p = 1 / (1 + np.exp(-line))
                out[j] = np.concatenate(([np.sum(np.logaddexp(0, line) - b * line)], a.T @ (p - b), (a.T @ (a * (p * (1 - p))[:, None])).ravel()))
            return out.ravel()

        sums = _summed(rows, models * size, of).reshape(models, size)
        moved = 0.0
        for j in range(models):
            now = sums[j, 0] + penalty / 2 * (trial[j, 1:] ** 2).sum()
            if now > lost[j] + 1e-12 * abs(lost[j]):  # too far: half the step
                step[j] /= 2
                trial[j] = beta[j] - step[j]
                moved = max(moved, float(np.abs(step[j]).max()))
                continue
            beta[j], lost[j] = trial[j], now
            shrink = np.concatenate(([0.0], np.full(k, penalty)))
            hessian = sums[j, k + 2 :].reshape(k + 1, k + 1) + np.diag(shrink)
            step[j] = np.linalg.lstsq(hessian, sums[j, 1 : k + 2] + shrink * beta[j], rcond=None)[0]
            moved = max(moved, float(np.abs(step[j]).max()))
        if moved < tolerance:
            break
        trial = beta - step
    return Logistic(features, mean, sd, beta)


def label_in_stages(df: DataFrame, label: str, stages: list[list[str]], fold: Column, folds: int = 5, *, least_rows: int = 200, default: float = 0.0) -> tuple[DataFrame, list[dict]]:
    """``df`` with ``role`` (0/1), ``role_source`` and ``chance``: labels where they are; else by the first stage whose features
    are all there and which has ``least_rows`` labelled rows; else ``default``. And for each stage its out-of-fold accuracy and area."""
    known = F.col(label).isNotNull()
    chance, source, reports = F.lit(None).cast("double"), F.lit(None).cast("string"), []
    for number, features in enumerate(stages):
        whole = F.lit(True)
        for c in features:
            whole = whole & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
        train = df.where(known & whole)
        n = train.count()
        if n < least_rows:
            reports.append({"stage": number, "rows": n, "accuracy": None, "area": None})
            continue
        model = fit_logistic(train, features, label, fold=fold, folds=folds)
        scored = train.select(F.col(label).cast("double").alias("y"), F.round(model.chance(fold), 9).alias("p"))
        reports.append({"stage": number, "rows": n, **area_and_accuracy(scored)})
        own = whole & chance.isNull()
        source = F.when(own, f"stage {number}").otherwise(source)
        chance = F.when(own, model.chance()).otherwise(chance)
    role = F.when(known, F.col(label).cast("double")).otherwise(F.coalesce((chance > 0.5).cast("double"), F.lit(default)))
    named = F.when(known, "label").otherwise(F.coalesce(source, F.lit("default")))
    return df.withColumns({"role": role, "role_source": named, "chance": F.when(~known, chance)}), reports


def area_and_accuracy(scored: DataFrame) -> dict:
    """Accuracy at 0.5 and the area under the curve of (y, p), from counts by distinct chance, sorted by ranges."""
    counts = scored.groupBy("p").agg(F.sum("y").alias("up"), F.sum(1 - F.col("y")).alias("down"))
    ordered = ordered_numbers(counts, [F.col("p").asc()], "place", lambda x: stored(x, "area"))
    # a running sum in two levels: within stretches of places, then over the stretches
    stretch = F.floor(F.col("place") / 4096)
    within = Window.partitionBy("stretch").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.withColumn("stretch", stretch)
    sums = {r.stretch: r.s for r in parts.groupBy("stretch").agg(F.sum("down").alias("s")).collect()}  # one row for 4,096 chances
    before, rows = 0.0, []
    for s in sorted(sums):
        rows.append((s, before))
        before += sums[s]
    offsets = F.broadcast(scored.sparkSession.createDataFrame(rows, "stretch bigint, before double"))
    joined = parts.withColumn("inside", F.coalesce(F.sum("down").over(within), F.lit(0.0))).join(offsets, "stretch")
    r = joined.agg(
        F.sum(F.col("up") * (F.col("before") + F.col("inside") + F.col("down") / 2)).alias("won"), F.sum("up").alias("up"), F.sum("down").alias("down"),
        F.sum(F.when(F.col("p") > 0.5, F.col("up")).otherwise(F.col("down"))).alias("right"),
    ).first()
    return {"accuracy": r.right / (r.up + r.down), "area": r.won / (r.up * r.down) if r.up and r.down else None}


_ERFC = np.frompyfunc(math.erfc, 1, 1)


def normal_below(x: np.ndarray) -> np.ndarray:
    """The standard normal distribution function."""
    return _ERFC(-np.asarray(x, float) / math.sqrt(2)).astype(float) / 2


def _density(x: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)


def normal_quantile(p: float) -> float:
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (lo, mid)
    return (lo + hi) / 2


class OrderedProbit:
    """P(level <= k) = N(threshold k - slopes x), for the sorted ``levels``."""

    def __init__(self, levels: list[float], thresholds: np.ndarray, slopes: np.ndarray, loss: float):
        self.levels, self.thresholds, self.slopes, self.loss = levels, thresholds, slopes, loss

    def chances(self, x: np.ndarray) -> np.ndarray:
        """One row for each row of ``x``, one column a level."""
        below = normal_below(self.thresholds[None, :] - (x @ self.slopes)[:, None])
        edge = np.zeros((len(x), 1))
        return np.diff(np.concatenate((edge, below, edge + 1), 1), axis=1)

    def ladder(self, rows: DataFrame, features: list[str], name: str = "level") -> DataFrame:
        """``rows`` with one row for each level and its ``chance``."""

        def run(batches):
            for frame in batches:
                p = self.chances(frame[features].to_numpy(float))
                out = frame.loc[frame.index.repeat(len(self.levels))].reset_index(drop=True)
                yield out.assign(**{name: np.tile(self.levels, len(frame)), "chance": p.ravel()})

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        return rows.mapInPandas(run, f"{fields}, `{name}` double, chance double")


def fit_ordered_probit(df: DataFrame, features: list[str], level: str, *, most_levels: int = 1000, steps: int = 60, tolerance: float = 1e-9) -> OrderedProbit:
    """Ordered probit of ``level`` on ``features``: rows collapse to counts of equal ones, which every step reads once.

    The Hessian has a row for each threshold and slope, so more than ``most_levels`` levels raise. Rows with nulls are left out."""
    k = len(features)
    counted = df.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)), F.col(level).cast("double").alias("y")).dropna()
    counted = stored(counted.groupBy(*(f"x{i}" for i in range(k)), "y").agg(F.count("*").cast("double").alias("n")), "probit")
    found = counted.groupBy("y").agg(F.sum("n").alias("n")).orderBy("y").limit(most_levels + 1).collect()
    if len(found) > most_levels:
        raise ValueError(f"more than {most_levels} levels")
    levels = np.array([r.y for r in found])
    t = len(levels) - 1
    if t < 1:
        return OrderedProbit(levels.tolist(), np.zeros(0), np.zeros(k), 0.0)
    share = np.cumsum([r.n for r in found])
    beta = np.concatenate(([normal_quantile(s / share[-1]) for s in share[:-1]], np.zeros(k)))
    size = t + k
    lost, trial, step = np.inf, beta, np.zeros(size)
    for _ in range(steps):
        if (np.diff(trial[:t]) <= 0).any():
            step = step / 2
            trial = beta - step
            continue

        def of(batch, trial=trial):
            x = np.column_stack([batch.column(i).to_numpy() for i in range(k)])
            n = batch.column(k + 1).to_numpy()
            at = np.searchsorted(levels, batch.column(k).to_numpy())
            line = x @ trial[t:]
            ends = np.concatenate(([-np.inf], trial[:t], [np.inf]))
            hi, lo = ends[at + 1] - line, ends[at] - line
            # by the tail that is small, so that far levels keep their digits
            flip = lo > 0
            p = np.where(flip, normal_below(-np.where(flip, lo, 0.0)) - normal_below(np.where(flip, -hi, 0.0)), normal_below(hi) - normal_below(lo))
            p = np.maximum(p, 1e-300)
            slope = lambda z: np.where(np.isfinite(z), z, 0.0) * _density(np.where(np.isfinite(z), z, 40.0))
            fh, fl = _density(np.where(np.isfinite(hi), hi, 40.0)), _density(np.where(np.isfinite(lo), lo, 40.0))
            gh, gl = fh / p, -fl / p  # d log p by the upper and the lower end
            hh, ll, hl = -slope(hi) / p - gh**2, slope(lo) / p - gl**2, -gh * gl
            grad, hess = np.zeros(size), np.zeros((size, size))
            up, down = at < t, at > 0
            np.add.at(grad, at[up], (n * gh)[up])
            np.add.at(grad, at[down] - 1, (n * gl)[down])
            grad[t:] = -(n * (gh + gl)) @ x
            np.add.at(hess, (at[up], at[up]), (n * hh)[up])
            np.add.at(hess, (at[down] - 1, at[down] - 1), (n * ll)[down])
            both = up & down
            np.add.at(hess, (at[both], at[both] - 1), (n * hl)[both])
            np.add.at(hess, (at[both] - 1, at[both]), (n * hl)[both])
            for i in range(k):
                np.add.at(hess, (at[up], t + i), -(n * (hh + hl) * x[:, i])[up])
                np.add.at(hess, (at[down] - 1, t + i), -(n * (ll + hl) * x[:, i])[down])
            hess[t:, t:] = x.T @ (x * (n * (hh + ll + 2 * hl))[:, None])
            hess[t:, :t] = hess[:t, t:].T
            return np.concatenate(([-(n * np.log(p)).sum()], grad, hess.ravel()))

        sums = _summed(counted, 1 + size + size**2, of)
        if sums[0] > lost + 1e-12 * abs(lost):
            step = step / 2
            trial = beta - step
            if np.abs(step).max() < tolerance:
                break
            continue
        beta, lost = trial, sums[0]
        step = np.linalg.lstsq(sums[1 + size :].reshape(size, size), sums[1 : 1 + size], rcond=None)[0]
        if np.abs(step).max() < tolerance:
            break
        trial = beta - step
    return OrderedProbit(levels.tolist(), beta[:t], beta[t:], float(lost))
