"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned, not given: words and word beginnings that occur in many toxic and hardly any clean
training documents, beside a short seed list. Half of the bounded training sample teaches the lexicon, the
other half the trees, so that no document is judged by words learned from itself; held-out folds of that half
calibrate the trees' margins by isotonic regression. Samples are bounded by ``max_train_rows`` and drawn by a
hash of the id; scores cover all rows and whole texts.

An empty or null text scores by its zero features; without labels, or with one class, every score is that
class's share (0 without labels). Repeated documents score alike; of repeated labels the larger one holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import features as X
from .quality import bounded_sample, fold, one_label
from .shared import table
from .textops import binary_array

MAX_TRAIN_ROWS = 24_000
THRESHOLD = 0.7
BINS = 48


class BoostedTrees:
    """Histogram trees of depth 3 under logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, *, trees: int = 80, rate: float = 0.12, depth: int = 3, penalty: float = 1.0):
        n, width = x.shape
        share = min(max(float(y.mean()) if n else 0.0, 1e-4), 1 - 1e-4)
        self.base = float(np.log(share / (1 - share)))
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1]).astype(np.float32)) if n else np.zeros(0, np.float32) for k in range(width)]
        self.edges = [np.unique(np.concatenate((e, np.unique(x[x[:, k] > 0, k])[:4]))) if n else e for k, e in enumerate(self.edges)]
        self.depth, self.rate = depth, rate
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if not n or y.min() == y.max():
            return
        bins = self.bin(x)
        most = max(len(e) for e in self.edges) + 1
        margin = np.full(n, self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, most, np.int64)
            for level in range(depth):
                nodes = 2**level
                best = np.full(nodes, 1e-6)
                begin = nodes - 1
                local = node - begin
                for k in range(width):
                    cell = local * most + bins[:, k]
                    gs = np.bincount(cell, weights=g, minlength=nodes * most).reshape(nodes, most)
                    hs = np.bincount(cell, weights=h, minlength=nodes * most).reshape(nodes, most)
                    gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                    gt, ht = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                    gain = gl**2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt**2 / (ht + penalty)
                    gain[(hl < 0.5) | (ht - hl < 0.5)] = -1
                    at = gain.argmax(1)
                    value = gain[np.arange(nodes), at]
                    better = value > best
                    best[better] = value[better]
                    feature[begin : begin + nodes][better] = k
                    cut[begin : begin + nodes][better] = at[better]
                node = 2 * node + 1 + (bins[np.arange(n), feature[node]] > cut[node])
            leaf = node - (2**depth - 1)
            value = rate * np.bincount(leaf, weights=g, minlength=2**depth) / (np.bincount(leaf, weights=h, minlength=2**depth) + penalty)
            margin += value[leaf]
            self.trees.append((feature, cut, value))

    def bin(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)]) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins, rows = self.bin(x), np.arange(len(x))
        out = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (bins[rows, feature[node]] > cut[node])
            out += value[node - (2**self.depth - 1)]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of a non-decreasing function from score to probability."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order].tolist(), y[order].tolist()):
        blocks.append([v, 1.0, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            v2, n2, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + v2, blocks[-1][1] + n2, blocks[-1][2], hi]
    x = np.array([k for b in blocks for k in (b[2], b[3])])
    return x, np.repeat([b[0] / b[1] for b in blocks], 2)


class ToxicityModel:
    def __init__(self, lexicon: X.Lexicon, x: np.ndarray, y: np.ndarray):
        self.lexicon = lexicon
        self.trees = BoostedTrees(x, y)
        self.flat = None if len(y) and y.min() < y.max() else float(y.mean()) if len(y) else 0.0
        if self.flat is None:
            fold_of = np.arange(len(y)) % 3
            out = np.zeros(len(y))
            for k in range(3):
                out[fold_of == k] = BoostedTrees(x[fold_of != k], y[fold_of != k]).margin(x[fold_of == k])
            self.knots = isotonic(out, y)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(x), self.flat)
        margin = self.trees.margin(x)
        return np.clip(np.interp(margin, *self.knots), 0.0, 1.0)


def learn_lexicon(sample: DataFrame, toxic: int, clean: int) -> X.Lexicon:
    """Words and beginnings whose documents are toxic ten times as often as chance; counts are document counts. They come from
    the sampled documents alone, which bounds them."""

    def run(batches):
        for batch in batches:
            label = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), np.int64)
            for lo, hi, data, _, starts, ends, first in X.Words(batch.column(0)):
                doc = np.repeat(np.arange(hi - lo), np.diff(first))
                for k in (0, *X.PREFIXES):
                    keys = X.prefix_keys(data, starts, ends, k) if k else X.word_keys(data, starts, ends)
                    own = np.unique(np.rec.fromarrays((keys, doc)))
                    key, at, n = np.unique(own["f0"], return_index=True, return_counts=True)
                    bad = np.add.reduceat(label[lo + own["f1"]], at) if len(key) else np.zeros(0, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), k, np.int32)), pa.array(key.view(np.int64)), pa.array(bad.astype(np.int64)), pa.array((n - bad).astype(np.int64))], ["kind", "key", "bad", "good"])

    counts = sample.select("text", "label").mapInArrow(run, "kind int, key bigint, bad bigint, good bigint").groupBy("kind", "key").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    least = max(3, toxic // 300)
    odds = (F.col("bad") + 0.1) / max(1, toxic) / ((F.col("good") + 0.1) / max(1, clean))
    top = counts.where((F.col("key") != 0) & (F.col("bad") >= least) & (odds >= 10))
    found: dict[int, dict[int, float]] = {k: {} for k in (0, *X.PREFIXES)}
    for r in top.select("kind", "key", F.log(odds).alias("w")).collect():
        found[r.kind][r.key & ((1 << 64) - 1)] = float(r.w)
    return X.Lexicon(found[0], {k: found[k] for k in X.PREFIXES})


def train(docs: DataFrame, labels: DataFrame, *, label_col="toxic", folds=3, held=1, max_rows=MAX_TRAIN_ROWS) -> ToxicityModel:
    """Fit on at most ``max_rows`` labelled documents whose fold is not ``held``; half of them for the lexicon."""
    spark = docs.sparkSession
    known = one_label(labels, label_col).where(fold("doc_id", folds) != held)
    drawn = bounded_sample(known, max_rows).select("doc_id", "label", (F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(2)) == 0).alias("first"))
    rows = drawn.collect()  # about max_rows ids and labels at most
    drawn = F.broadcast(spark.createDataFrame([(r.doc_id, r.label, r.first) for r in rows], "doc_id bigint, label int, first boolean"))
    own = docs.select("doc_id", "text").join(drawn, "doc_id")
    toxic = sum(r.label for r in rows if r.first)
    lexicon = learn_lexicon(own.where("first"), toxic, sum(1 for r in rows if r.first) - toxic)
    shipped = spark.sparkContext.broadcast(lexicon)

    def run(batches):
        for batch in batches:
            x = X.toxicity_features(batch.column(0), shipped.value)
            yield pa.RecordBatch.from_arrays([batch.column(1), binary_array(x.ravel(), np.arange(len(x) + 1) * x.shape[1]), batch.column(2)], ["label", "features", "doc_id"])

    second = own.where("not first").select("text", "label", "doc_id").mapInArrow(run, "label int, features binary, doc_id bigint")
    got = sorted(second.collect(), key=lambda r: (r.doc_id, bytes(r.features)))  # about half of max_rows
    x = np.frombuffer(b"".join(bytes(r.features) for r in got), np.float32).reshape(len(got), len(X.TOXICITY))
    return ToxicityModel(lexicon, x, np.array([r.label for r in got], float))


def with_scores(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``; a column of that name is replaced."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.drop("score")
    at = source.columns.index(text_col)

    def run(batches):
        for batch in batches:
            x = X.toxicity_features(batch.column(at), shipped.value.lexicon)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shipped.value.score(x))], [*batch.schema.names, "score"])

    return source.mapInArrow(run, StructType([*source.schema.fields, *StructType.fromDDL("score double").fields]))


def op3_toxicity_trees(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_scores(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
