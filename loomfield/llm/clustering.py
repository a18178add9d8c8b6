"""Centroid clustering by dual-tree Lloyd rounds over integer vectors.

Vectors are cut into blocks of neighbours, each with a cover tree that is built once and stored. In every round a
tree over the centroids meets the trees over the vectors: pairs of nodes go by distance bounds, a node with one
centroid left is assigned whole, leaf pairs are compared exactly. Tasks send sums and counts by cluster, whose
number depends on the centroids alone.

Rows whose vector is null, has another length, or holds a null, NaN or infinite component are left out. Components are
integers floor(scale * x), held to +-2^27, so that a squared distance fits 64 bits. A null id counts as an empty one;
repeated ids are rows of their own, and ids of one hash go by their components. With fewer rows than
centroids every row is one. Other columns are not read. No rows give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .cover_tree import CoverTree, nearest, squared
from .shared import arrow_rows, materialize, table

DIMS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, 1
#: Vectors of a block, and those that a task orders before it cuts blocks.
BLOCK, NEARBY = 512, 8192
LIMIT = 1 << 27
_BLOCKS = "ids binary, absent binary, points binary, " + ", ".join(f"{name} binary" for name in CoverTree.PARTS)
_TYPES = {"radius": np.float64}


def quantised(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: float) -> DataFrame:
    """(vec_id, v) of the rows that are kept; ``v`` has integers."""
    x = F.col(vector_col)
    whole = (F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    held = lambda c: F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), F.lit(float(scale)) * c.cast("double")))
    v = F.transform(x, lambda c: F.floor(held(c)).cast("int"))
    return vectors.where(x.isNotNull() & whole).select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """Vectors of the ``k`` ids with the smallest hashes, in their order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return np.array([r.v for r in rows.select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()], np.int64)


def _stored(blocks: pa.RecordBatch, dims: int):
    """(ids, absent, tree) of every stored block."""
    at = {name: k for k, name in enumerate(blocks.schema.names)}
    for row in range(blocks.num_rows):
        part = lambda name, kind: np.frombuffer(blocks.column(at[name])[row].as_buffer(), kind)
        points = part("points", np.int32).reshape(-1, dims)
        yield part("ids", np.int64), part("absent", np.uint8), CoverTree.of(points, [part(p, _TYPES.get(p, np.int64)) for p in CoverTree.PARTS])


def _tree_blocks(rows: DataFrame, centroids: np.ndarray, dims: int) -> DataFrame:
    """Blocks of neighbours with their trees: rows of a task are ordered by their nearest first centroid and distance."""

    def run(batches):
        def cut(ids, absent, points):
            if len(points) > BLOCK:
                far = np.stack([squared(points, c) for c in centroids], 1)
                order = np.lexsort((far.min(1), far.argmin(1)))
                ids, absent, points = ids[order], absent[order], points[order]
            for lo in range(0, len(ids), BLOCK):
                tree = CoverTree(points[lo : lo + BLOCK])
                own = slice(lo, lo + BLOCK)
                columns = [ids[own][tree.order], absent[own][tree.order].astype(np.uint8), tree.points.astype(np.int32), *(p.astype(_TYPES.get(name, np.int64)) for name, p in zip(CoverTree.PARTS, tree.parts()))]
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in columns], ["ids", "absent", "points", *CoverTree.PARTS])

        held, n = [], 0
        for batch in batches:
            column = batch.column(0)
            points = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
            held.append((np.asarray(column.fill_null(0)), column.is_null().to_numpy(zero_copy_only=False), points))
            n += len(points)
            if n >= NEARBY:
                yield from cut(*map(np.concatenate, zip(*held)))
                held, n = [], 0
        if n:
            yield from cut(*map(np.concatenate, zip(*held)))
        T.release()

    return rows.select("vec_id", "v").mapInArrow(run, _BLOCKS)


def _sums(blocks: DataFrame, centroids: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and componentwise sums of the vectors of every centroid, as Python integers."""
    k = len(centroids)

    def run(batches):
        count, total, others = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), CoverTree(centroids, 1)
        for batch in batches:
            for _, _, tree in _stored(batch, dims):
                answer, _ = nearest(tree, others)
                order = np.argsort(answer, kind="stable")
                first = np.flatnonzero(np.concatenate(([True], answer[order][1:] != answer[order][:-1])))
                own = answer[order][first]
                count += np.bincount(answer, minlength=k)
                total[own] += np.add.reduceat(tree.points[order].astype(np.int64), first)
        cluster = np.repeat(np.arange(k), dims + 1)
        part = np.tile(np.arange(dims + 1), k)
        yield pa.RecordBatch.from_arrays([pa.array(cluster), pa.array(part), pa.array(np.column_stack((total, count)).ravel())], ["cluster", "part", "s"])

    rows = blocks.mapInArrow(run, "cluster bigint, part bigint, s bigint").groupBy("cluster", "part").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    out = np.zeros((k, dims + 1), object)
    for r in rows:  # k * (dims + 1) of them
        out[r.cluster, r.part] = int(r.s)
    return out[:, dims], out[:, :dims]


def _assigned(blocks: DataFrame, centroids: np.ndarray, dims: int) -> DataFrame:
    def run(batches):
        others = CoverTree(centroids, 1)
        for batch in batches:
            for ids, absent, tree in _stored(batch, dims):
                answer, _ = nearest(tree, others)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=absent.astype(bool)), pa.array(answer.astype(np.int32)), pa.array(squared(tree.points, centroids[answer]))], ["vec_id", "cluster", "distance"]
                )

    return blocks.mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


def cluster(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, k: int = CENTROIDS, rounds: int = ROUNDS, scale: float = SCALE, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """(vec_id, cluster, distance) of every kept vector, and (cluster, centroid, n, cluster_inertia) of every centroid."""
    spark = vectors.sparkSession
    rows = quantised(vectors, id_col, vector_col, dims, scale)
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint"), spark.createDataFrame([], "cluster int, centroid array<bigint>, n bigint, cluster_inertia bigint")
    blocks = materialize(_tree_blocks(rows, centroids, dims), "trees")
    with arrow_rows(spark, 16):  # a row is a whole block
        for _ in range(rounds):
            count, total = _sums(blocks, centroids, dims)
            centroids = np.array([t // n if n else c for n, t, c in zip(count, total, centroids)], np.int64)
        assigned = materialize(_assigned(blocks, centroids, dims), "assigned")
    own = spark.createDataFrame([(int(j), [int(x) for x in c]) for j, c in enumerate(centroids)], "cluster int, centroid array<bigint>")
    inertia = assigned.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.col("distance").cast("decimal(38,0)")).try_cast("bigint").alias("cluster_inertia"))
    return assigned, own.join(inertia, "cluster", "left").fillna(0, ["n", "cluster_inertia"])


def op13_dual_tree_lloyd(spark, sf_dir: str) -> DataFrame:
    assigned, clusters = cluster(table(spark, sf_dir, "embeddings"))
    found = clusters.collect()  # one row a centroid
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    own = spark.createDataFrame([(r.cluster, r.cluster_inertia, digest(r.centroid)) for r in found], "cluster int, cluster_inertia bigint, centroid_sha256 string")
    inertia = F.lit(sum(r.cluster_inertia for r in found)).cast("bigint").alias("inertia")
    return assigned.join(F.broadcast(own), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", inertia, "centroid_sha256")


def _lloyd_sql() -> str:
    """DuckDB SQL of the query: each round is an assignment and a mean."""
    assign = """a{r} as materialized (
  select vec_id, v, arg_min(j, d * 16 + j) as j2, min(d) as d from (
    select e.vec_id, e.v, c.j, list_sum(list_transform(list_zip(e.v, c.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::bigint as d from e cross join c{r} c
  ) group by vec_id, v
)"""
    mean = """c{n} as materialized (
  select o.j, list(coalesce(m.floor_div, o.old) order by o.i) as v
  from (select c.j, t.i, c.v[t.i] as old from c{r} c, unnest(range(1, 65)) as t(i)) o left join m{r} m on m.j = o.j and m.i = o.i group by o.j
)"""
    sums = """m{r} as materialized (
  select j2 as j, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::bigint as floor_div
  from (select j2, t.i, v[t.i] as x from a{r}, unnest(range(1, 65)) as t(i)) group by all
)"""
    parts = [
        """e as materialized (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64
)""",
        """c0 as materialized (
  select row_number() over (order by h) - 1 as j, v from (select sha256('1:' || vec_id) as h, v from e order by h limit 16)
)""",
    ]
    for r in range(3):
        parts += [assign.format(r=r), sums.format(r=r), mean.format(r=r, n=r + 1)]
    parts.append(assign.format(r=3))
    return (
        "with " + ",\n".join(parts) + "\nselect vec_id, j2::int as cluster, d as distance, sum(d) over (partition by j2)::bigint as cluster_inertia, sum(d) over ()::bigint as inertia, "
        "sha256(array_to_string(c.v, ',')) as centroid_sha256 from a3 join c3 c on c.j = j2"
    )


OP13_SQL = _lloyd_sql()
