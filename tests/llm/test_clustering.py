"""Dual-tree Lloyd rounds against brute force; cover trees' invariants, ties, copies and awkward rows."""

import hashlib
import math

import numpy as np
import pytest

from loomfield.llm import clustering
from loomfield.llm.cover_tree import CoverTree, nearest, squared

SCHEMA = "vec_id bigint, embedding array<float>, cluster string, distance string, v int"


def brute(rows, k=16, rounds=3, dims=64):
    kept = []
    for i, e in rows:
        if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e):
            held = [max(-(2.0**27), min(2.0**27, 64 * float(np.float32(x)))) for x in e]
            kept.append((i, [math.floor(x) for x in held]))
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    start = sorted(kept, key=lambda r: (digest(f"1:{'' if r[0] is None else r[0]}"), r[1]))[:k]
    centroids = [v for _, v in start]

    def assign():
        out = []
        for _, v in kept:
            far = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            out.append((min(far), far.index(min(far))))
        return out

    for _ in range(rounds):
        own = assign()
        for j in range(len(centroids)):
            members = [v for (_, v), (_, c) in zip(kept, own) if c == j]
            if members:
                centroids[j] = [sum(x) // len(members) for x in zip(*members)]
    own = assign()
    inertia = [sum(d for d, c in own if c == j) for j in range(len(centroids))]
    return sorted(((i, c, d, inertia[c], sum(inertia), digest(",".join(map(str, centroids[c])))) for (i, _), (d, c) in zip(kept, own)), key=str)


def vectors(n=700):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(9, 64))
    rows = [(k, (centre[k % 9] + 0.3 * rng.normal(size=64)).astype(np.float32).tolist()) for k in range(n)]
    rows += [(n + k, rows[3][1]) for k in range(n // 2)]  # a third of the rows are copies
    rows += [(2, rows[5][1]), (2, rows[2][1]), (None, rows[7][1])]
    rows += [(9001, None), (9002, []), (9003, rows[0][1][:63]), (9004, rows[0][1] + [1.0]), (9005, [None] + rows[0][1][1:]), (9006, [math.nan] + rows[0][1][1:]), (9007, [math.inf] + rows[0][1][1:])]
    return rows


@pytest.mark.parametrize("rows", [vectors(), vectors(20)[:5], vectors(20)[:20] + [(8000, [3e38] * 64), (8001, [-3e38] * 32 + [0.0] * 32)], [(k, [0.5] * 64) for k in range(40)]])
def test_query(spark, tmp_path, rows):
    spark.createDataFrame([(i, e, "c", "d", 1) for i, e in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = clustering.op13_dual_tree_lloyd(spark, str(tmp_path))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint", "bigint", "bigint", "string"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert clustering.op13_dual_tree_lloyd(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("spread", [2, 30, 1 << 26])
def test_nearest_is_exact(spread):
    rng = np.random.default_rng(spread)
    for n in (1, 9, 400):
        for k in (1, 2, 16):
            x = rng.integers(-spread, spread + 1, (n, 64))
            x[n // 2 :] = x[rng.integers(0, max(1, n // 2), n - n // 2)]
            c = np.concatenate((x[rng.integers(0, n, k - k // 2)], rng.integers(-spread, spread + 1, (k // 2, 64))))
            tree = CoverTree(x)
            assert sorted(tree.order.tolist()) == list(range(n)) and (tree.points == x[tree.order]).all()
            answer, _ = nearest(tree, CoverTree(c, 1))
            assert (answer == np.stack([squared(tree.points, y) for y in c], 1).argmin(1)).all()


def test_trees_cover_and_bounds_prune():
    rng = np.random.default_rng(4)
    centre = rng.integers(-60, 60, (16, 64))
    x = centre[rng.integers(0, 16, 512)] + rng.integers(-1, 2, (512, 64))
    tree = CoverTree(x)
    for k in range(len(tree.lo)):
        far = np.sqrt(squared(tree.points[tree.lo[k] : tree.hi[k]], tree.points[tree.centre[k]]).astype(float))
        assert tree.lo[k] <= tree.centre[k] < tree.hi[k] and far.max() <= tree.radius[k] + 1e-6
        if tree.children[k]:
            below = slice(tree.child[k], tree.child[k] + tree.children[k])
            assert tree.lo[below][0] == tree.lo[k] and tree.hi[below][-1] == tree.hi[k] and tree.centre[k] in tree.centre[below]
    answer, seen = nearest(tree, CoverTree(centre, 1))
    assert seen["node_pairs"] + seen["point_pairs"] < 512 * 16 / 8 and seen["whole_nodes"] > 0
    assert (answer == np.stack([squared(tree.points, y) for y in centre], 1).argmin(1)).all()
