"""Exact top-k BM25 search: inverted indexes with block maxima by shard, WAND pruning, exact merge.

Document counts, lengths and term frequencies are taken over all documents. Equal texts are one class, indexed once with its
number of copies and its ``k`` smallest ids (more cannot be among the best). Classes are dealt out by digest; a
task builds one index after the other, each of a bounded number of postings, and stores it, so that all queries
read what was built once. Lists of frequent words are kept by document too, and cut into blocks of documents, each with its
largest contribution.

A query is first searched in a few shards of its own, which gives it a threshold that holds everywhere: the k-th best
score so far; then in ``WIDEN`` times as many, and so on. WAND's pivot rule is applied to a block of documents at once: the lists' maxima, in a block and at all,
bound what a document may reach, and where they do not add up to the threshold it is not looked at. Lists of rare words are short and are read; those of
frequent words are bounded by their maxima in each block. Documents whose bound reaches the threshold are scored, from
the largest bound down, and the threshold rises with what is found. Scores use global statistics, so shards' best
merge exactly; ties (to nine decimals) go to the smaller document id, nulls last.

Queries go through the driver in blocks of at most ``block_bytes``, one block at a time, each released before the
next. Words are lower-cased ASCII letters and digits and non-ASCII bytes. Null, empty and wordless texts are
found by nothing and find nothing. Repeated rows are documents and queries of their own, ids may be null. Columns
beside doc_id and text are not looked at.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textops as T
from .shared import arrow_rows, materialize, partitions_for, table, text_digest

K = 10
K1, B = 0.9, 0.4
#: Postings and documents of a shard, documents of a block, bytes of a block of queries.
SHARD_POSTINGS, SHARD_DOCS, BLOCK_DOCS, BLOCK_BYTES = 5_000_000, 65_000, 64, 24 << 20
#: Bytes of text of a task that builds indexes, and those for which one is worth while where cores are idle. Large shards are
#: searched faster: what a query costs in a shard besides its postings is the same in any.
TASK_BYTES, LEAST_TASK_BYTES = 48 << 20, 4 << 20
#: Frequent words of a shard at most, and bytes that their lists by document may take.
FREQUENT, FREQUENT_BYTES = 256, 32 << 20
#: Lists of fewer postings are gathered one posting at a time, longer ones copied.
SHORT = 64
#: Share of the threshold that lists which are not read may add.
SHARE = 0.8
#: Documents in which a query is searched for its first threshold, about, and how many times as many for the next.
FIRST_DOCS, WIDEN = 16384, 16
#: Queries whose terms are looked up in a shard at once.
AT_ONCE = 512
EPS = 1e-8


def _bags(column):
    """(row, number of words, sorted distinct terms, their counts) of every text with words."""
    for lo, hi, data, at in T.blocks(column):
        data = T.lower_ascii(data)
        starts, ends = T.word_spans(data, at, T.ALNUM)
        first = T.counts_by_doc(starts, at)
        h = T.span_hashes(data, starts, ends)
        for k in range(hi - lo):
            if first[k + 1] > first[k]:
                yield lo + k, int(first[k + 1] - first[k]), *np.unique(h[first[k] : first[k + 1]], return_counts=True)


def _classes(docs: DataFrame, k: int) -> DataFrame:
    """One row for each distinct text: text, copies, and its k smallest ids."""
    keyed = docs.select(text_digest("text").alias("h"), F.col("doc_id").cast("bigint"), "text").where("text is not null")
    order = Window.partitionBy("h").orderBy(F.col("doc_id").asc_nulls_last())
    best = keyed.select("h", "doc_id").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    ids = best.groupBy("h").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "doc_id"))), lambda x: x["doc_id"]).alias("ids"))
    counted = keyed.groupBy("h").agg(F.count("*").alias("copies"))
    one = keyed.groupBy("h").agg(F.first("text").alias("text"))
    return one.join(counted, "h").join(ids, "h").select("text", "copies", "ids")


_INDEX = "shard bigint, n_docs bigint, n_words bigint, vocabulary binary, at binary, doc binary, tf binary, length binary, copies binary, ids array<bigint>, ids_at binary"


def _indexes(classes: DataFrame, shard_postings: int) -> DataFrame:
    """Stored indexes: postings sorted by term, then by document, the one of the most terms first."""

    def built(number, rows):
        rows.sort(key=lambda r: -len(r[1]))
        length, copies = (np.array([r[k] for r in rows], np.int64) for k in (0, 3))
        ids, ids_at = [i for r in rows for i in r[4]], np.cumsum([0] + [len(r[4]) for r in rows])
        doc = np.repeat(np.arange(len(rows), dtype=np.uint16), [len(r[1]) for r in rows])
        flat, tf = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows]).astype("<u4")
        rows.clear()
        order = np.argsort(flat, kind="stable")
        flat, doc, tf = flat[order], doc[order], tf[order]
        del order
        at = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
        name = (TaskContext.get().partitionId() << 24) + number
        numbers = [pa.array([int(x)], pa.int64()) for x in (name, copies.sum(), (copies * length).sum())]
        raw = [T.binary_array(x, [0, len(x)]) for x in (flat[at], np.concatenate((at, [len(flat)])), doc, tf, length, copies)]
        return pa.RecordBatch.from_arrays([*numbers, *raw, pa.array([ids], pa.list_(pa.int64())), T.binary_array(ids_at, [0, len(ids_at)])], [c.split()[0] for c in _INDEX.split(", ")])

    def run(batches):
        held: list[tuple] = []
        postings = number = 0
        for batch in batches:
            copies, ids = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for row, length, terms, counts in _bags(batch.column(0)):
                held.append((length, terms, counts.astype("<u4"), copies[row], ids[row]))
                postings += len(terms)
                if postings >= shard_postings or len(held) >= SHARD_DOCS:
                    yield built(number, held)
                    held, postings, number = [], 0, number + 1
                    T.release()
        if held:
            yield built(number, held)

    return classes.mapInArrow(run, _INDEX)


def _frequencies(indexes: DataFrame) -> DataFrame:
    """(term, df) over all documents, copies included, from the shards' lists."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                vocabulary, at, doc, copies = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in enumerate((np.int64, np.int64, np.uint16, np.int64)))
                df = np.add.reduceat(copies[doc], at[:-1])
                for x in range(0, len(df), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(vocabulary[x : x + 100_000]), pa.array(df[x : x + 100_000])], ["term", "df"])

    lists = indexes.select("vocabulary", "at", "doc", "copies").mapInArrow(run, "term bigint, df bigint")
    return lists.groupBy("term").agg(F.sum("df").alias("df"))


class ShardIndex:
    """Postings of one shard, weighted for a block of queries; frequent words' contributions by document and their maxima by block of documents."""

    def __init__(self, vocabulary, at, doc, tf, length, copies, mean: float, terms, weights):
        self.at, self.doc, self.copies, self.n_docs = at, doc, copies, len(length)
        slot = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
        self.slot = np.where(vocabulary[slot] == terms, slot, -1)  # where each of the terms stands in the vocabulary
        weight = np.zeros(len(vocabulary))
        weight[self.slot[self.slot >= 0]] = weights[self.slot >= 0]
        n = np.diff(at)
        self.adds = tf * (K1 + 1.0)
        below = (K1 * (1 - B + B * length / mean))[doc]
        below += tf
        self.adds /= below
        del below
        self.adds *= np.repeat(weight, n)
        self.list_max = np.maximum.reduceat(self.adds, at[:-1])
        most = min(FREQUENT, FREQUENT_BYTES // (8 * self.n_docs), len(n))
        often = np.argpartition(-n, most - 1)[:most] if most else np.zeros(0, np.int64)
        often = often[n[often] > 1]
        self.row = np.full(len(n), -1, np.int32)
        self.row[often] = np.arange(len(often))
        self.grid = np.zeros((self.n_docs, len(often)))
        for c, (x, y) in enumerate(zip(at[often].tolist(), at[often + 1].tolist())):
            self.grid[doc[x:y], c] = self.adds[x:y]
        self.block_max = np.maximum.reduceat(self.grid, np.arange(0, self.n_docs, BLOCK_DOCS)).T.copy()

    def _kth(self, score: np.ndarray, docs: np.ndarray, k: int) -> float:
        """The k-th best score, copies counted; nothing where there are fewer."""
        order = np.argsort(-score, kind="stable")
        at = int(np.searchsorted(np.cumsum(self.copies[docs[order]]), k))
        return float(score[order[at]]) if at < len(order) else -np.inf

    def search(self, slot: np.ndarray, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best that reach ``floor``, for the terms at ``slot``."""
        n, begin, end, row = self.n_docs, self.at[slot], self.at[slot + 1], self.row[slot]
        often, read = np.flatnonzero(row >= 0), row < 0
        if floor <= 0 and len(often) and n > 4 * k:  # documents that do best in rare words raise the threshold at once
            part = self._read(begin[read], end[read])
            top = np.argpartition(-part, 2 * k)[: 2 * k]
            floor = max(floor, self._kth(part[top] + self.grid[top[:, None], row[often]].sum(1), top, k))
        # lists up to the pivot are not read: what they may add to a document, at most a share of the threshold, is bounded
        most = self.list_max[slot[often]]
        order = np.argsort(most / (end[often] - begin[often]), kind="stable")
        pivot = int(np.searchsorted(np.cumsum(most[order]), SHARE * floor))
        read[often[order[pivot:]]] = True
        part = self._read(begin[read], end[read])
        row = row[often[order[:pivot]]]
        bound = part + np.repeat(self.block_max[row].sum(0), BLOCK_DOCS)[:n]
        live = np.flatnonzero(bound >= max(floor - EPS, 1e-12))
        live = live[np.argsort(-bound[live], kind="stable")]
        docs, scores = np.zeros(0, np.int64), np.zeros(0)
        x, step = 0, 64
        while x < len(live) and bound[live[x]] >= floor - EPS:
            some = live[x : x + step]
            docs = np.concatenate((docs, some))
            scores = np.concatenate((scores, part[some] + self.grid[some[:, None], row].sum(1)))
            floor = max(floor, self._kth(scores, docs, k))
            good = (scores >= floor - EPS) & (scores > 0)
            docs, scores = docs[good], scores[good]
            x, step = x + step, min(2 * step, 512)
        return docs, np.round(scores, 9)

    def _read(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """What the postings from ``begin`` to ``end`` add to each document."""
        size = end - begin
        short = size < SHORT
        posting = T.ragged(begin[short], size[short])
        docs, adds = [self.doc[posting]], [self.adds[posting]]
        for x, y in zip(begin[~short].tolist(), end[~short].tolist()):
            docs.append(self.doc[x:y])
            adds.append(self.adds[x:y])
        return np.bincount(np.concatenate(docs), weights=np.concatenate(adds), minlength=self.n_docs).astype(float)


def _block_of(rows: pa.Table) -> tuple:
    """Queries (h, home, q: terms and weights) of one block: names, homes, distinct terms and their weights, and each query's own terms by place."""
    rows = rows.combine_chunks()
    lists = rows["q"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    at = np.asarray(lists.offsets).astype(np.int64)
    terms, weights = (lists.values.field(c).to_numpy()[at[0] : at[-1]] for c in ("term", "w"))
    distinct, one, which = np.unique(terms.view(np.uint64), return_index=True, return_inverse=True)
    return rows["h"].to_pylist(), rows["home"].to_numpy(), distinct, weights[one], which.ravel().astype(np.int32), at - at[0]


def _search(indexes: DataFrame, shipped, mean: float, k: int, near: int, far: int) -> DataFrame:
    """(h, doc_id, score): a block of queries in the shards from ``near`` to before ``far``, counted from each one's home."""

    def run(batches):
        (names, home, terms, weights, which, at), floors, shards = shipped.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(k)[i] for k, c in enumerate(batch.schema.names)}
                raw = lambda c, t: np.frombuffer(row[c].as_buffer(), t)  # noqa: E731, B023
                away = (shards[row["shard"].as_py()] - home) % len(shards)
                asked = (away >= near) & (away < far)
                if not asked.any():
                    continue
                index = ShardIndex(raw("vocabulary", np.uint64), raw("at", np.int64), raw("doc", np.uint16), raw("tf", "<u4"), raw("length", np.int64), raw("copies", np.int64), mean, terms, weights)
                ids, ids_at = row["ids"].values, raw("ids_at", np.int64)
                found = []
                for lo in range(0, len(names), AT_ONCE):
                    hi = min(lo + AT_ONCE, len(names))
                    slot = index.slot[which[at[lo] : at[hi]]]
                    own = at[lo : hi + 1] - at[lo]
                    # a shard whose maxima do not add up to the threshold has nothing for a query
                    most = np.bincount(np.repeat(np.arange(hi - lo), np.diff(own)), weights=np.where(slot >= 0, index.list_max[slot], 0), minlength=hi - lo)
                    for q in np.flatnonzero(asked[lo:hi] & (most > 0) & (most >= floors[lo:hi] - EPS)).tolist():
                        here = slot[own[q] : own[q + 1]]
                        docs, scores = index.search(here[here >= 0], k, float(floors[lo + q]))
                        if len(docs):
                            found.append((lo + q, docs, scores))
                if found:
                    docs = np.concatenate([d for _, d, _ in found])
                    n = ids_at[docs + 1] - ids_at[docs]
                    of = np.repeat(np.repeat([q for q, _, _ in found], [len(d) for _, d, _ in found]), n)
                    rows = [pa.array([names[q] for q in of], pa.binary()), ids.take(pa.array(T.ragged(ids_at[docs], n))), pa.array(np.repeat(np.concatenate([s for _, _, s in found]), n))]
                    yield pa.RecordBatch.from_arrays(rows, ["h", "doc_id", "score"])
                del index
                T.release()

    return indexes.mapInArrow(run, "h binary, doc_id bigint, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("h").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(docs: DataFrame, queries: DataFrame, *, k: int = K, block_bytes: int = BLOCK_BYTES, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """(query_id, rank, doc_id, score) of ``queries`` (doc_id, text) against ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    with arrow_rows(spark, 1000):
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        few = min(-(-size // LEAST_TASK_BYTES), 2 * spark.sparkContext.defaultParallelism)
        tasks = max(1, min(partitions_for(spark), max(few, -(-size // TASK_BYTES))))
        indexes = materialize(_indexes(_classes(docs, k).coalesce(tasks), shard_postings), "indexes")
        asked = queries.select(F.col("doc_id").alias("query_id"), text_digest("text").alias("h"), "text").where("text is not null")
    n, total = indexes.agg(F.sum("n_docs"), F.sum("n_words")).first()
    n, mean = n or 0, (total or 1) / max(1, n or 1)
    with arrow_rows(spark, 1):  # a row is a whole shard
        df = materialize(_frequencies(indexes), "frequencies")
    with arrow_rows(spark, 1000):
        weighted, size = _weighted(asked.groupBy("h").agg(F.first("text").alias("text")), df, n)
    shards = {r.shard: i for i, r in enumerate(indexes.select("shard").orderBy("shard").collect())}  # one number for each shard
    homes = max(1, -(-FIRST_DOCS * len(shards) // max(1, n)))
    blocks = max(1, -(-size // block_bytes))
    found = []
    for b in range(blocks):
        # at most about block_bytes, whatever the corpus
        asked_now = _block_of(weighted.where(F.pmod("home", F.lit(blocks)) == b).toArrow())
        floors, mine, near, far = np.zeros(len(asked_now[0])), [], 0, homes
        while not mine or near < len(shards):
            shipped = spark.sparkContext.broadcast((asked_now, floors, shards))
            with arrow_rows(spark, 1):
                mine.append(materialize(_search(indexes, shipped, mean, k, near, far), "found"))
            shipped.destroy()
            near, far = far, far * WIDEN
            if near < len(shards):
                least = _best(reduce(DataFrame.union, mine), k).where(F.col("rank") == k).select("h", "score").toArrow()
                reached = dict(zip(least["h"].to_pylist(), least["score"].to_pylist()))
                floors = np.array([reached.get(h, 0.0) for h in asked_now[0]])
        found += mine
    every = reduce(DataFrame.union, found)
    lists = _best(every, k).groupBy("h").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("best"))
    rows = asked.select("query_id", "h").join(lists, "h").select("query_id", F.explode("best").alias("r"))
    return rows.select("query_id", "r.rank", "r.doc_id", "r.score")


def _weighted(asked: DataFrame, df: DataFrame, n: int) -> tuple[DataFrame, int]:
    """Distinct queries (h, home, q: terms that documents have, with their weights), and about how many bytes they take."""

    def run(batches):
        for batch in batches:
            for row, _, terms, _ in _bags(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(terms), row))), pa.array(terms.view(np.int64))], ["h", "term"])

    own = asked.select("h", "text").mapInArrow(run, "h binary, term bigint").join(df, "term")
    own = own.withColumn("w", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    lists = own.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias("q"))
    weighted = materialize(lists.withColumn("home", F.pmod(F.xxhash64("h"), F.lit(1 << 30))), "weighted")
    return weighted, weighted.agg(F.sum(F.size("q") * 4 + 64)).first()[0] or 0


def op9_bm25_top10(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return top_k(docs, docs.where("doc_id % 50 = 0"))
