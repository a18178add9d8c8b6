"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting visits one feature after the other and adds a shrunken tree of at most three cuts to that
feature's lookup table; then pairs of features, chosen by what they still explain, get tables of two cuts
each. A score is the sum of the looked-up bins, so scoring is vectorised additions. The model is trained on at
most ``max_train_rows`` labelled rows, drawn by a hash of their id; everything else covers all rows.

An empty or null text scores by its zero features. Without labels, or with one class, every score is the share
of that class (0.5 without labels). Repeated documents score alike; repeated labels count once, the larger wins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomfield.operators.relational import free_names

from .features import QUALITY, quality_features
from .shared import materialize, table

MAX_TRAIN_ROWS = 20_000
THRESHOLD = 0.3
BINS = 32
PAIR_BINS = 8


def fold(id_col: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def _cuts(g: np.ndarray, h: np.ndarray, most: int, penalty: float) -> np.ndarray:
    """A shallow tree over ordered bins: greedily the best cut, then the best cut in either half; values per bin."""
    parts = [(0, len(g))]
    for _ in range(most):
        best = (1e-9, None)
        for k, (a, b) in enumerate(parts):
            gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            if not len(gl):
                continue
            gt, ht = g[a:b].sum(), h[a:b].sum()
            gain = gl**2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt**2 / (ht + penalty)
            gain[(hl < 1.0) | (ht - hl < 1.0)] = -1
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                best = (gain[at], (k, a + at + 1))
        if best[1] is None:
            break
        k, at = best[1]
        a, b = parts[k]
        parts[k : k + 1] = [(a, at), (at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + penalty)
    return out


class AdditiveModel:
    """Tables of single features and of pairs; ``score`` adds the looked-up bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, *, rounds: int = 120, pair_rounds: int = 40, pairs: int = 8, rate: float = 0.12, penalty: float = 1.0):
        n, width = x.shape
        rate_1 = float(y.mean()) if n else 0.5
        if n == 0 or rate_1 in (0.0, 1.0):
            self.base = float(np.log((rate_1 + 1e-3) / (1 - rate_1 + 1e-3)))
            self.edges = [np.zeros(0, np.float32)] * width
            self.tables = [np.zeros(1)] * width
            self.pairs = []
            return
        self.base = float(np.log(rate_1 / (1 - rate_1)))
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1]).astype(np.float32)) for k in range(width)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []
        bins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)]
        margin = np.full(n, self.base)
        for _ in range(rounds):
            for k in range(width):
                if len(self.tables[k]) < 2:
                    continue
                p = 1 / (1 + np.exp(-margin))
                g = np.bincount(bins[k], weights=y - p, minlength=len(self.tables[k]))
                h = np.bincount(bins[k], weights=p * (1 - p), minlength=len(self.tables[k]))
                step = rate * _cuts(g, h, 3, penalty)
                self.tables[k] += step
                margin += step[bins[k]]
        self._fit_pairs(x, y, margin, pair_rounds, pairs, rate, penalty)

    def _fit_pairs(self, x, y, margin, rounds, most, rate, penalty):
        coarse = [e[np.unique(np.linspace(0, len(e) - 1, PAIR_BINS - 1).astype(int))] if len(e) else e for e in self.edges]
        bins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(coarse)]
        p = 1 / (1 + np.exp(-margin))
        found = []
        for i in range(len(coarse)):
            for j in range(i + 1, len(coarse)):
                _, gain = self._quadrants(bins[i] * PAIR_BINS + bins[j], y - p, p * (1 - p), penalty)
                found.append((gain, i, j))
        for gain, i, j in sorted(found, reverse=True)[:most]:
            if gain > 1e-6:
                self.pairs.append((i, j, coarse[i], coarse[j], np.zeros(PAIR_BINS * PAIR_BINS)))
        for _ in range(rounds):
            for i, j, _, _, grid in self.pairs:
                cell = bins[i] * PAIR_BINS + bins[j]
                p = 1 / (1 + np.exp(-margin))
                step, _ = self._quadrants(cell, y - p, p * (1 - p), penalty)
                grid += rate * step
                margin += rate * step[cell]

    @staticmethod
    def _quadrants(cell, g, h, penalty):
        """The best pair of cuts, one on each feature: values for all cells, and the gain."""
        size = PAIR_BINS
        gs = np.bincount(cell, weights=g, minlength=size * size).reshape(size, size)
        hs = np.bincount(cell, weights=h, minlength=size * size).reshape(size, size)
        gc, hc = gs.cumsum(0).cumsum(1), hs.cumsum(0).cumsum(1)
        a, b = slice(0, size - 1), slice(0, size - 1)
        parts = []
        for s in (gc, hc):
            both = s[a, b]
            left, top, whole = s[a, -1:], s[-1:, b], s[-1, -1]
            parts.append((both, left - both, top - both, whole - left - top + both))
        gain = sum(x**2 / (w + penalty) for x, w in zip(*parts)) - gc[-1, -1] ** 2 / (hc[-1, -1] + penalty)
        i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
        values = [float(x[i, j] / (w[i, j] + penalty)) for x, w in zip(*parts)]
        out = np.empty((size, size))
        out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
        return out.ravel(), float(gain[i, j])

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.base)
        for k, (e, t) in enumerate(zip(self.edges, self.tables)):
            margin += t[np.searchsorted(e, x[:, k], side="right")]
        for i, j, a, b, grid in self.pairs:
            margin += grid[np.searchsorted(a, x[:, i], side="right") * PAIR_BINS + np.searchsorted(b, x[:, j], side="right")]
        return 1 / (1 + np.exp(-margin))


def feature_rows(docs: DataFrame) -> DataFrame:
    """doc_id and the features of the whole text, packed as float32 bytes."""

    def run(batches):
        for batch in batches:
            x = quality_features(batch.column(1))
            at = np.arange(len(x) + 1) * x.shape[1]
            from .textops import binary_array

            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), binary_array(x.ravel(), at)], ["doc_id", "features"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, features binary")


def one_label(labels: DataFrame, label_col: str) -> DataFrame:
    return labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label"))


def bounded_sample(known: DataFrame, max_rows: int) -> DataFrame:
    """About ``max_rows`` rows at most, drawn by a hash of their id: each row decides alone."""
    share = min(1.0, max_rows / max(1, known.count()))
    return known.where(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))


def _known(labels: DataFrame, label_col: str, folds: int, held: int, max_rows: int) -> DataFrame:
    return bounded_sample(one_label(labels, label_col).where(fold("doc_id", folds) != held), max_rows)


def train(features: DataFrame, labels: DataFrame, *, label_col="quality", folds=5, held=0, max_rows=MAX_TRAIN_ROWS) -> AdditiveModel:
    """Fit on at most ``max_rows`` rows of ``features`` whose fold is not ``held``."""
    known = _known(labels, label_col, folds, held, max_rows)
    sample = features.join(known, "doc_id").orderBy("doc_id", "features").select("features", "label").collect()  # about max_rows at most
    x = np.frombuffer(b"".join(bytes(r.features) for r in sample), np.float32).reshape(len(sample), len(QUALITY))
    return AdditiveModel(x, np.array([r.label for r in sample], float))


def train_on_texts(docs: DataFrame, labels: DataFrame, *, label_col="quality", folds=5, held=0, max_rows=MAX_TRAIN_ROWS) -> AdditiveModel:
    """As ``train``; features are computed for the sampled documents alone, whose ids are bounded by ``max_rows``."""
    known = F.broadcast(_known(labels, label_col, folds, held, max_rows).select("doc_id"))
    own = docs.select("doc_id", "text").join(known, "doc_id", "left_semi")
    return train(feature_rows(own), labels, label_col=label_col, folds=folds, held=held, max_rows=max_rows)


def with_scores(df: DataFrame, model: AdditiveModel, *, text_col: str | None = "text", features_col: str | None = None, name: str = "score") -> DataFrame:
    """``df`` with a column ``name`` of scores from the text, or from features that ``feature_rows`` packed; it takes the
    place of a column of that name. The model is small."""
    shipped = df.sparkSession.sparkContext.broadcast(model)
    source = df.drop(name)
    names = source.columns
    at = names.index(features_col or text_col)

    def run(batches):
        for batch in batches:
            if features_col:
                x = np.frombuffer(b"".join(batch.column(at).to_pylist()), np.float32).reshape(-1, len(QUALITY))
            else:
                x = quality_features(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shipped.value.score(x))], [*batch.schema.names, name])

    return source.mapInArrow(run, StructType([*source.schema.fields, *StructType.fromDDL(f"{name} double").fields]))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier, trained on ``labels`` of ``docs``, does not reject; unchanged."""
    (score,) = free_names(docs, "_score")
    scored = with_scores(docs, train_on_texts(docs, labels), name=score)
    return scored.where(F.col(score) >= threshold).select(*docs.columns)


def op2_quality_gam(spark, sf_dir: str) -> DataFrame:
    features = materialize(feature_rows(table(spark, sf_dir, "documents")), "quality")
    scored = with_scores(features, train(features, table(spark, sf_dir, "labels")), features_col="features")
    return scored.select(
        "doc_id",
        F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
