"""N-gram Jaccard join: count vectors in an R-tree, bounds by summed coordinate minima, exact verification.

Documents with equal shingle sets collapse to one node. Two sets that are similar enough differ in at most d shingles, d
following from their sizes. So the space of shingles is cut into more than d parts for each class of sizes: a part
holds four to six shingles of a set, one part at least is the same in both sets, and the shingles of a part together
make one signature, which routes a node to buckets. Texts that share a few shingles by chance share no signature, however
many texts there are. A set with so many empty parts that only these may be the same is routed by its first shingles
instead. In a bucket first the smallest node is compared with all others; most copies link to it and join its
component. Then the buckets of each smallest node are put together, and every such group that still holds several
components is searched whole: its count vectors (shingles hashed into groups) are packed into
an R-tree, whose boxes and points bound the overlap by summed coordinate minima, and only pairs of different
components that pass are verified on their sets. Larger sets have more groups;
boxes use ``GROUPS`` sums of them. So no link is lost, yet pairs inside a component are not
listed. Large groups are cut into pairs of blocks. Components come from large-star and small-star steps.

A null, empty or wordless text has an empty set, links with nothing and is its own component. Fewer words than
``size`` make one shingle. Repeated rows and ties fall into one node; a node's id is its smallest doc_id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.operators.relational import free_names

from . import textops as T
from .graph import components
from .shared import arrow_rows, forget, materialize, spread_join, table, text_digest

SIZE = 4
PERCENT = 85
GROUPS = 64
#: Sizes of one class differ by this factor at most, in eighths.
CLASS_EIGHTHS = 11
#: Nodes of a group, and bytes of their count vectors, that are compared with each other at once.
BLOCK, BLOCK_BYTES = 1024, 1 << 20
#: A node in so many is in the sample that tells hot tokens, those of more nodes of it than this.
SAMPLE, HOT_SAMPLE = 256, 50
#: Bits of the filter that keeps most uninvolved documents from being hashed again; a fixed 1 MB.
FILTER_BITS = 1 << 23
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingle_sets(column, size: int = SIZE):
    """(row, sorted distinct 64-bit shingles) of every text with words."""
    for lo, hi, data, at in T.blocks(column):
        data = T.lower_ascii(data)
        starts, ends = T.word_spans(data, at, T.NOT_SPACE)
        first = T.counts_by_doc(starts, at)
        h = T.span_hashes(data, starts, ends)
        n = np.diff(first)
        if len(h) >= size:
            grams = np.full(len(h) - size + 1, size, np.uint64)
            for k in range(size):
                grams = T.mix(grams * _MULTIPLIERS[k % 5] + h[k : len(h) - size + 1 + k])
        for k in range(hi - lo):
            if n[k] >= size:
                yield lo + k, np.unique(grams[first[k] : first[k + 1] - size + 1])
            elif n[k]:
                whole = np.full(1, int(n[k]), np.uint64)
                for x in h[first[k] : first[k + 1]]:
                    whole = T.mix(whole * _MULTIPLIERS[4] + x)
                yield lo + k, whole


def count_vector(grams: np.ndarray) -> np.ndarray:
    """Counts of shingles by hash group, at least a group for each shingle; 255 stands for 255 or more."""
    bits = min(16, max(6, len(grams).bit_length()))
    return np.minimum(np.bincount((grams >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8)


def unpacked(vector: bytes) -> np.ndarray:
    """Counts as integers; a count that stands for more becomes one that no bound can miss."""
    v = np.frombuffer(vector, np.uint8).astype(np.int32)
    v[v == 255] = 1 << 20
    return v


def folded(v: np.ndarray, groups: int) -> np.ndarray:
    return v if len(v) == groups else v.reshape(groups, -1).sum(1)


def overlap_bound(x: np.ndarray, y: np.ndarray) -> int:
    """Summed coordinate minima of two count vectors, on the coarser one's groups."""
    g = min(len(x), len(y))
    return int(np.minimum(folded(x, g), folded(y, g)).sum())


def _digest(grams: np.ndarray) -> bytes:
    return hashlib.md5(grams.tobytes()).digest()


class Signatures:
    """Keys by which a set of shingles is routed: any two sets of similarity ``percent`` have one in common."""

    def __init__(self, percent: int):
        self.percent = percent
        step = max(CLASS_EIGHTHS, -(-800 // percent))
        self.least = [1]  # the least size of each class
        while self.least[-1] < 1 << 40:
            self.least.append(max(self.least[-1] + 1, self.least[-1] * step // 8))
        self.bounds = np.array(self.least)

    def differ(self, total: int) -> int:
        """Shingles at most that two similar sets of so many shingles in all do not share."""
        return total * (100 - self.percent) // (100 + self.percent)

    def of(self, grams: np.ndarray) -> np.ndarray:
        n = len(grams)
        own = int(np.searchsorted(self.bounds, n, side="right")) - 1
        keys, first = [], False
        for level in (own, own + 1):
            if 100 * n < self.percent * self.least[level]:
                break  # no set of the next class is similar enough
            largest = self.least[level + 1] - 1
            d = self.differ(n + min(largest, 100 * n // self.percent))
            if not d:
                continue  # only equal sets are similar, and those are one node
            parts = self.differ(2 * largest) + 3
            parts += parts // 32
            part = ((grams >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            keys.append(T.mix(np.add.reduceat(T.mix(grams + np.uint64(level)), at) + part[at] * _MULTIPLIERS[1]))
            first |= parts - len(at) >= parts - d
        if first:  # empty parts might be all that two sets have in common
            keys.append(T.mix(grams[: n + (-self.percent * n) // 100 + 1] ^ _MULTIPLIERS[2]))
        return np.concatenate(keys) if keys else grams[:0]


def _profile(docs: DataFrame, size: int, percent: int, carried: str | None = None, router=Signatures) -> DataFrame:
    """doc_id, n, and for non-empty sets their digest, count vector and signatures; a binary column ``carried`` rides along."""
    more = [carried] if carried else []

    def run(batches):
        routes = router(percent)
        for batch in batches:
            keys = batch.column(0)
            n, digest, vector, routed, at = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows, [None] * batch.num_rows, [], np.zeros(batch.num_rows, np.int64)
            for row, grams in shingle_sets(batch.column(1), size):
                n[row] = len(grams)
                digest[row] = _digest(grams)
                vector[row] = count_vector(grams).tobytes()
                routed.append(routes.of(grams).view(np.int64))
                at[row] = len(routed[-1])
            values = pa.array(np.concatenate(routed) if routed else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [keys.cast(pa.int64()), pa.array(n), pa.array(digest, pa.binary()), pa.array(vector, pa.binary()), T.list_array(values, np.concatenate(([0], np.cumsum(at)))), *batch.columns[2:]],
                ["doc_id", "n", "digest", "vector", "routes", *more],
            )

    schema = "doc_id bigint, n bigint, digest binary, vector binary, routes array<bigint>"
    return docs.select("doc_id", "text", *more).mapInArrow(run, ", ".join([schema, *(f"{c} binary" for c in more)]))


def _bit_filter(ids: DataFrame, column: str) -> np.ndarray:
    """A bitmap of fixed size over hashed ids: it may pass others, never stops one of these."""
    bits = ids.select(F.pmod(F.xxhash64(column), F.lit(FILTER_BITS)).alias("bit"))
    words = bits.selectExpr("bit div 32 as w", "shiftleft(1L, cast(bit % 32 as int)) as m")
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    got = words.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    out[got["w"].to_numpy()] = got["m"].to_numpy().astype(np.uint32)
    return out


def _sets_of(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, grams) for nodes (node, doc_id, digest), from their documents' texts."""
    shipped = docs.sparkSession.sparkContext.broadcast(_bit_filter(nodes, "doc_id"))
    keyed = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("bit"))

    def run(batches):
        have = shipped.value
        for batch in batches:
            bit = batch.column(2).to_numpy()
            kept = pa.array(np.flatnonzero((have[bit >> 5] >> (bit & 31).astype(np.uint32)) & np.uint32(1)))
            if not len(kept):
                continue
            keys = batch.column(0).take(kept).cast(pa.int64())
            text = batch.column(1).take(kept)
            rows, digests, grams = [], [], []
            for row, g in shingle_sets(text, size):
                rows.append(row)
                digests.append(_digest(g))
                grams.append(g.tobytes())
            for k in range(0, len(rows), 512):
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows[k : k + 512], pa.int64())), pa.array(digests[k : k + 512], pa.binary()), pa.array(grams[k : k + 512], pa.binary())], ["doc_id", "digest", "grams"])

    sets = keyed.mapInArrow(run, "doc_id bigint, digest binary, grams binary")
    wanted = nodes.select("node", F.col("doc_id").alias("_d"), F.col("digest").alias("_g"))
    found = sets.join(wanted, sets.doc_id.eqNullSafe(F.col("_d")) & (F.col("digest") == F.col("_g")))
    return found.select("node", "grams")


def required(a, b, percent: int):
    """The least overlap of sets of sizes a and b whose Jaccard similarity is percent / 100 or more."""
    return -(-percent * (a + b) // (100 + percent))


class RTree:
    """Points packed into leaves of neighbours; a box is its points' coordinate maxima and least size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, leaf: int = 16, fan: int = 8):
        # neighbours by size, then by the coordinates' coarse pattern
        order = np.lexsort((points[:, 1 % points.shape[1]], points[:, 0], sizes // max(1, int(sizes.max() // 64) if len(sizes) else 1)))
        self.order, self.points, self.sizes = order, points[order], sizes[order]
        self.levels = []
        top, least, width = self.points, self.sizes, leaf
        while len(top) > 1 or not self.levels:
            at = np.arange(0, len(top), width)
            top, least = np.maximum.reduceat(top, at), np.minimum.reduceat(least, at)
            self.levels.append((top, least, width))
            width = fan

    def search(self, q: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Points whose overlap with q may be enough: summed minima over boxes first, then over points."""
        level = len(self.levels) - 1
        live = np.arange(len(self.levels[-1][0]))
        while level >= 0 and len(live):
            top, least, width = self.levels[level]
            live = live[np.minimum(top[live], q).sum(1) >= required(size, least[live], percent)]
            below = len(self.points) if level == 0 else len(self.levels[level - 1][0])
            live = (live[:, None] * width + np.arange(width)).ravel()
            live = live[live < below]
            level -= 1
        near = np.minimum(self.points[live], q).sum(1) >= required(size, self.sizes[live], percent)
        return self.order[live[near]]


def _verify(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """Of candidate pairs (a, b) those whose sets are similar enough."""
    involved = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = materialize(_sets_of(docs, nodes.join(involved, "node").select("node", "doc_id", "digest"), size), "sets")
    first = pairs.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b")
    both = spread_join(first, sets.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a", _counts(pairs), "b").select("a", "b", "ga", "gb")

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                z = np.sort(np.concatenate((x, y)))
                keep[k] = int((z[1:] == z[:-1]).sum()) >= required(len(x), len(y), percent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(run, "a bigint, b bigint")


def _counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a").agg(F.count("*").alias("c"))


def _bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose summed coordinate minima allow a link."""
    own = lambda c: points.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("vector").alias(f"v{c}"))
    wide = spread_join(pairs.join(own("b"), "b"), own("a"), "a", _counts(pairs), "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                bound = [overlap_bound(unpacked(x.as_buffer()), unpacked(y.as_buffer())) for x, y in zip(batch.column(3), batch.column(5))]
                keep = np.array(bound) >= required(batch.column(2).to_numpy(), batch.column(4).to_numpy(), percent)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    return wide.select("a", "b", "na", "va", "nb", "vb").mapInArrow(run, "a bigint, b bigint")


def _groups(groups: DataFrame, settled: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Members (token, c, own, node, component, n, vector) of groups by pivot and size with several components, to be
    cut into c blocks.

    Sizes that may link lie in one class of sizes or in neighbouring ones. A node is at home in the slot of its
    class and, where it may have partners there, a guest in the next one; pairs meet where at least one of them is at
    home, hence once.
    """
    sized = groups.join(points.select("node", "n", F.octet_length("vector").alias("bytes")), "node").join(settled.select("node", "component"), "node", "left")
    near = float(np.log(100 / percent))
    wide = 3 * near
    level = F.floor(F.log("n") / wide).cast("int")
    # only sizes near the end of a class have partners in the next one
    guest = F.when(F.log("n") >= wide * (level + 1) - near - 1e-9, F.struct((level + 1).alias("slot"), F.lit(0).alias("own")))
    slots = sized.select("node", "bytes", F.coalesce("component", "node").alias("component"), F.explode(F.array_compact(F.array(F.struct(level.alias("slot"), F.lit(1).alias("own")), guest))).alias("s"), "pivot")
    slots = slots.select("node", "bytes", "component", "s.own", F.xxhash64("pivot", "s.slot").alias("token"))
    mixed = slots.groupBy("token").agg(F.greatest(F.count("*") / BLOCK, F.sum("bytes") / BLOCK_BYTES).alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("own").alias("home")).where("lo <> hi and home = 1").select("token", F.ceil("c").cast("int").alias("c"))
    return slots.drop("bytes").join(mixed, "token").join(points, "node").select("token", "c", "own", "node", "component", "n", "vector")


def _search_buckets(members: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Candidate pairs of different components in groups (token, c, own, node, component, n, vector); with ``forest``
    only as many as would join the components that candidates may join.

    Large groups are cut; each pair of blocks is a group of its own.
    """
    blocks = F.col("c")
    cut = members.withColumn("_own", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    cut = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cut = cut.select(
        F.xxhash64("token", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("group"),
        "token", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), (F.col("_own") > F.col("_other")).cast("int").alias("side"), "own", "node", "component", "n", "vector",
    )
    schema = "a bigint, b bigint"

    def run(batches):
        rest, found = None, []
        for batch in batches:
            frame = batch.to_pandas()
            frame = frame if rest is None else pd.concat((rest, frame), ignore_index=True)
            key = frame[["token", "i", "j"]].to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            for lo, hi in zip(np.concatenate(([0], cuts[:-1])) if len(cuts) else [], cuts):
                found.append(_pairs_in(frame.iloc[int(lo) : int(hi)], percent, forest))
            rest = frame.iloc[int(cuts[-1]) if len(cuts) else 0 :]
            T.release()
            if sum(map(len, found)) > 200_000:
                yield _pairs_batch(found)
                found = []
        if rest is not None and len(rest):
            found.append(_pairs_in(rest, percent, forest))
        yield _pairs_batch(found)

    spread = cut.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    return spread.select("token", "i", "j", "side", "own", "node", "component", "n", "vector").mapInArrow(run, schema)


def _pairs_batch(found: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].astype(np.int64)), pa.array(pairs[:, 1].astype(np.int64))], ["a", "b"])


def _pairs_in(group: pd.DataFrame, percent: int, forest: bool) -> np.ndarray:
    """Pairs of one group by its R-tree: within a block, or of either block with the other one."""
    component, node, n = (group[c].to_numpy(np.int64) for c in ("component", "node", "n"))
    own = group["own"].to_numpy() == 1
    none = np.zeros((0, 2), np.int64)
    if len(node) < 2 or (component == component[0]).all():
        return none
    fine = [unpacked(v) for v in group["vector"]]
    vectors = np.stack([folded(v, GROUPS) for v in fine])
    stacks = {}
    for g in {len(v) for v in fine}:
        alike = [k for k, v in enumerate(fine) if len(v) == g]
        stacks[g] = (np.stack([fine[k] for k in alike]), dict(zip(alike, range(len(alike)))))
    two = bool((group["i"].to_numpy() != group["j"].to_numpy()).any())
    side = group["side"].to_numpy(np.int64)
    inside = np.flatnonzero(side == 0) if two else np.arange(len(node))
    asking = np.flatnonzero(side == 1) if two else np.arange(len(node))
    if not len(inside) or not len(asking):
        return none
    tree = RTree(vectors[inside], n[inside])
    out = []
    root = {c: c for c in component.tolist()}

    def find(c):
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    for k in asking:
        near = inside[tree.search(vectors[k], int(n[k]), percent)]
        near = near[(component[near] != component[k]) & (own[near] | own[k])]
        if not two:
            near = near[node[near] > node[k]]
        near = near[_finer(fine, stacks, near, int(k)) >= required(n[near], int(n[k]), percent)] if len(near) else near
        if forest and len(near):
            joins = []
            for x in near.tolist():
                a, b = find(int(component[x])), find(int(component[k]))
                if a != b:
                    root[a] = b
                    joins.append(x)
            near = np.array(joins, np.int64)
        if len(near):
            out.append(np.column_stack((np.minimum(node[near], node[k]), np.maximum(node[near], node[k]))))
    return np.concatenate(out) if out else none


def _finer(fine: list[np.ndarray], stacks: dict, near: np.ndarray, k: int) -> np.ndarray:
    """Overlap bounds of vector k with those of ``near`` on the finest groups that both have."""
    out = np.zeros(len(near), np.int64)
    sizes = np.array([len(fine[x]) for x in near])
    for g in np.unique(sizes):
        at = np.flatnonzero(sizes == g)
        rows, index = stacks[int(g)]
        low = min(int(g), len(fine[k]))
        own = rows[[index[int(x)] for x in near[at]]]
        own = own if low == g else own.reshape(len(at), low, -1).sum(2)
        out[at] = np.minimum(own, folded(fine[k], low)).sum(1)
    return out


def jaccard_components(docs: DataFrame, *, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text)."""
    with arrow_rows(docs.sparkSession, 1000):  # pairs carry two sets; every Python step ends in a written table
        return _components_of(docs, size, percent).drop("component")


def signature_tokens(routed: DataFrame) -> DataFrame:
    """(node, token): nodes of one token meet."""
    return routed.select("node", F.explode("routes").alias("token"))


def meetings(tokens: DataFrame) -> DataFrame:
    """(pivot, node): for every token (node, token) of several nodes, one of them with each other one.

    Rows of a token meet by one shuffle and a sort, and its pivot is the first of them. Tokens that many nodes of a hashed
    sample have, 4,096 of them at most, are joined by broadcast instead, with a pivot of the sample; so no
    task holds a hot token, and the sample decides only which way a token goes."""
    part = tokens.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0).groupBy("token").agg(F.count("*").alias("c"), F.min("node").alias("pivot"))
    hot = [(r.token, r.pivot) for r in part.where(F.col("c") > HOT_SAMPLE).orderBy(F.col("c").desc(), "token").limit(4096).collect()]
    light = tokens.select("token", "node")
    if hot:
        few = F.broadcast(tokens.sparkSession.createDataFrame(hot, "token bigint, pivot bigint"))
        light = light.join(few, "token", "left_anti")

    def run(batches):
        last, pivot = None, 0
        for batch in batches:
            token, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(token):
                continue
            fresh = np.concatenate(([last is None or token[0] != last], token[1:] != token[:-1]))
            own = np.concatenate(([pivot], node[fresh]))[np.cumsum(fresh)]
            last, pivot = token[-1], own[-1]
            other = own != node
            yield pa.RecordBatch.from_arrays([pa.array(own[other]), pa.array(node[other])], ["pivot", "node"])

    met = light.repartition("token").sortWithinPartitions("token", "node").mapInArrow(run, "pivot bigint, node bigint")
    return met.union(tokens.join(few, "token").where("node <> pivot").select("pivot", "node")) if hot else met


def _components_of(docs: DataFrame, size: int, percent: int, carried: str | None = None, router=Signatures, tokens_of=signature_tokens) -> DataFrame:
    """doc_id, n_shingles, component_id, component (null for an empty set) and ``carried`` for every row. ``router``
    gives a set its routes, ``tokens_of`` the tokens of all nodes by their routes."""
    more = [carried] if carried else []
    wide = materialize(_profile(docs, size, percent, carried, router), "profile")
    profile = materialize(wide.select("doc_id", "n", "digest", *more), "rows")
    nodes = wide.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("n", "vector", "routes")))
    routed = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "routed")
    forget(wide)
    # all buckets of one pivot make one group, so that a pair meets once and not in every shingle it shares
    with arrow_rows(docs.sparkSession, 1 << 16, narrow=True):
        groups = materialize(meetings(tokens_of(routed)).distinct(), "groups")
    nodes = materialize(routed.drop("routes"), "nodes")
    forget(routed)
    points = nodes.select("node", "n", "vector")
    stars = materialize(_bounded(groups.select(F.col("pivot").alias("a"), F.col("node").alias("b")), points, percent), "stars")
    one_each = stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    linked = materialize(_verify(docs, one_each, nodes, size, percent), "links")
    # a node that links to a pivot goes by it; that chains are not followed yet costs candidates, never links
    settled = linked.select(F.col("b").alias("node"), F.col("a").alias("component"))
    # first as few pairs as would join what may be joined, then, with what is still apart, all that may link
    for forest in (True, False):
        own = lambda c, known=settled: known.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
        pairs = _search_buckets(_groups(groups, settled, points, percent), percent, forest)
        if not forest:
            other = stars.join(one_each, ["a", "b"], "left_anti").join(own("a"), "a", "left").join(own("b"), "b", "left")
            other = other.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
            pairs = pairs.union(other).distinct().join(linked_or_not, ["a", "b"], "left_anti")
        pairs = materialize(pairs.distinct(), "pairs")
        linked_or_not = pairs
        linked = materialize(linked.union(_verify(docs, pairs, nodes, size, percent)), "links")
        settled = components(linked)
    final = settled
    named = nodes.select("node", "digest", "doc_id").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_digest = named.join(smallest, "component").select("digest", "component", "component_id")
    out = profile.select("doc_id", "n", "digest", *more).join(by_digest, "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "component", *more)


def keep_one_of_each(docs: DataFrame, *, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """Of every component one row, unchanged: that of the smallest doc_id (nulls last), then of the smallest digest of
    its text, then of the smallest other columns. Rows without words are components of their own, so all stay."""
    (h,) = free_names(docs, "_h")
    keyed = docs.withColumn(h, text_digest("text"))
    with arrow_rows(docs.sparkSession, 1000):
        rows = _components_of(keyed.select("doc_id", "text", h), size, percent, h)
        rows = materialize(rows.groupBy("component", "doc_id", h).agg(F.count("*").alias("n")), "texts")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", h, "n")
    best = rows.where("component is not null").groupBy("component").agg(F.min(order).alias("best")).select("component", "best.*")
    one = best.where("n = 1").select("doc_id", h).union(rows.where("component is null").select("doc_id", h))
    again = best.where("n > 1").select("doc_id", h)
    on = lambda x: keyed["doc_id"].eqNullSafe(x["doc_id"]) & (keyed[h] == x[h])
    kept = keyed.join(one, on(one), "left_semi").select(*docs.columns)
    several = keyed.join(again, on(again), "left_semi")
    least = F.min_by(F.struct(*docs.columns), F.to_json(F.struct(h, *(c for c in docs.columns if c not in ("doc_id", "text")))))
    return kept.unionByName(several.groupBy("doc_id", h).agg(least.alias("row")).select("row.*"))


def op5_jaccard_rtree(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP5_SQL = r"""
with recursive d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
),
s as (
  select distinct doc_id, case when len(w) >= 4 then array_to_string(w[i:i + 3], ' ') else array_to_string(w, ' ') end as g
  from d, unnest(range(1, greatest(2, len(w) - 2))) as t(i) where len(w) > 0
),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
e as (select a, b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * k >= 85 * (x.n + y.n - k)),
r(doc_id, m) as (select doc_id, doc_id from d union select e.b, r.m from r join e on e.a = r.doc_id),
c as (select doc_id, min(m) as component_id from r group by doc_id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id from d left join n using (doc_id) join c using (doc_id)
"""
