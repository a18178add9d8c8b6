"""Flat token files, token counts by separator scan, and training order by a keyed permutation.

A flat token file is one long run of uint16 ids with an end-of-document id after each document and no index.
Files are stored as rows (file, block, payload) of a fixed number of ids, the last block shorter.

``token_counts`` searches each block for the separator with one vectorised comparison. A block then knows its
whole documents and the open ends at its sides; a prefix scan over the blocks' summaries gives each block its
first document's number and the ids already read of it. A document over many blocks is counted like any other.

``training_order`` cuts the files into sequences of a fixed length, numbers them, and gives each a global slot
by a keyed Feistel permutation with cycle-walking: a bijection of 0 .. n - 1 that needs no memory and no sort.
A shard is a range of slots; ``write_training_shards`` stores each as one run of sequences of a fixed stride, and
``read_training_shards`` resumes at any slot: the shard and the offset in it follow by arithmetic.

Null and empty texts are documents of no ids. Repeated rows are documents of their own. No rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import arrow_rows, materialize, table
from .tokens import default_tokenizer_path, text_blocks, worker_tokenizer

EOD = 49407
BLOCK = 1 << 16
SEQUENCE = 2048
SHARD_SLOTS = 2048
#: Files whose numbers are broadcast, of 16 bytes each; beyond, they are joined by a shuffle.
MOST_BROADCAST = 200_000
KEY = 0x5DEECE66D
_KINDS = "kind string, file bigint, block bigint, payload binary, doc_id bigint, ordinal bigint"


def write_token_files(docs: DataFrame, *, tokenizer_path: str | None = None, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(blocks, manifest): file, block, payload; and file, ordinal, doc_id. One file for each input partition."""
    path = tokenizer_path or default_tokenizer_path()

    def run(batches):
        file = TaskContext.get().partitionId()
        tail, n, ordinal = np.zeros(0, "<u2"), 0, 0

        def rows(parts, kind="block"):
            k = len(parts)
            return [kind] * k, [file] * k, list(range(n, n + k)), parts, [None] * k, [None] * k

        def batch_of(columns):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()))], ["kind", "file", "block", "payload", "doc_id", "ordinal"])

        for batch in batches:
            for lo, texts in text_blocks(batch.column(1)):
                ids, at = worker_tokenizer(path, True).encode(texts)
                size = np.diff(at) + 1
                flat = np.full(int(size.sum()), EOD, "<u2")
                flat[np.arange(len(ids)) + np.repeat(np.arange(len(size)), size - 1)] = ids
                k = len(size)
                yield batch_of((["doc"] * k, [file] * k, [None] * k, [None] * k, batch.column(0).slice(lo, k).cast(pa.int64()), np.arange(ordinal, ordinal + k)))
                ordinal += k
                tail = np.concatenate((tail, flat))
                whole = len(tail) // block
                parts = [tail[i * block : (i + 1) * block].tobytes() for i in range(whole)]
                tail = tail[whole * block :]
                if parts:
                    yield batch_of(rows(parts))
                n += whole
        if len(tail):
            yield batch_of(rows([tail.tobytes()]))

    stored = materialize(docs.select("doc_id", "text").mapInArrow(run, _KINDS), "tokens", "kind")
    return stored.where("kind = 'block'").select("file", "block", "payload"), stored.where("kind = 'doc'").select("file", "ordinal", "doc_id")


def token_counts(blocks: DataFrame, *, eod: int = EOD) -> DataFrame:
    """(file, ordinal, start, n_tokens) of every document that ends in the files; a null id count never occurs."""

    def scan(batches):
        for batch in batches:
            ends, sizes = [], []
            for x in batch.column(2):
                ids = np.frombuffer(x.as_buffer(), "<u2")
                ends.append(np.flatnonzero(ids == eod).astype(np.int32))
                sizes.append(len(ids))
            n = [len(e) for e in ends]
            last = [int(s - 1 - e[-1]) if len(e) else s for s, e in zip(sizes, ends)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array(last, pa.int64()), pa.array(ends, pa.list_(pa.int32()))], ["file", "block", "size", "n", "open", "ends"])

    seen = materialize(blocks.select("file", "block", "payload").mapInArrow(scan, "file bigint, block bigint, size bigint, n bigint, open bigint, ends array<int>"), "ends")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # prefix scan over block summaries alone: documents and ids before, and where the last separator before ended
    placed = seen.drop("ends").select("*", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("at"))
    placed = placed.withColumn("begin", F.coalesce(F.max(F.when(F.col("n") > 0, F.col("at") + F.col("size") - F.col("open"))).over(before), F.lit(0)))
    each = placed.where("n > 0").join(seen.select("file", "block", "ends"), ["file", "block"]).select("file", "first", "at", "begin", "ends", F.posexplode("ends").alias("k", "e"))
    start = F.when(F.col("k") == 0, F.col("begin")).otherwise(F.col("at") + F.expr("try_element_at(ends, k)") + 1)
    return each.select("file", (F.col("first") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("at") + F.col("e") - start).alias("n_tokens"))


def op7_separator_scan(spark, sf_dir: str) -> DataFrame:
    blocks, manifest = write_token_files(table(spark, sf_dir, "documents"))
    counts = token_counts(blocks)
    return counts.join(manifest, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal", "start")


def feistel(x: np.ndarray, n: int, key: int = KEY, rounds: int = 6) -> np.ndarray:
    """The slot of each number in a keyed permutation of 0 .. n - 1."""
    half = max(1, ((max(2, n) - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(v):
        left, right = v >> np.uint64(half), v & mask
        for k in range(rounds):
            h = (right + np.uint64((key + 0x9E3779B97F4A7C15 * (k + 1)) & ((1 << 64) - 1))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((h >> np.uint64(32)) & mask)
        return (left << np.uint64(half)) | right

    out = once(x.astype(np.uint64))
    while len(away := np.flatnonzero(out >= n)):  # cycle-walking: the domain is under four times n
        out[away] = once(out[away])
    return out.astype(np.int64)


def training_order(blocks: DataFrame, *, length: int = SEQUENCE, block: int = BLOCK, key: int = KEY, pad: int = EOD) -> DataFrame:
    """(slot, file, sequence, n_tokens, payload): sequences of ``length`` ids with their slots in training order.

    ``block`` is a multiple of ``length``, so no sequence crosses blocks; a file's last sequence is padded.
    """
    sizes = blocks.groupBy("file").agg(F.sum(F.ceil(F.octet_length("payload") / (2 * length))).cast("bigint").alias("n"))
    sizes = materialize(sizes, "sizes")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    starts = sizes.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    total, files = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    per = block // length
    placed = blocks.join(F.broadcast(starts) if files <= MOST_BROADCAST else starts, "file").select("file", "block", "first", "payload")

    def run(batches):
        for batch in batches:
            for file, number, first, payload in zip(*(batch.column(k) for k in range(4))):
                raw = np.frombuffer(payload.as_buffer(), "<u2")
                n = -(-len(raw) // length)
                grid = np.full(n * length, pad, "<u2")
                grid[: len(raw)] = raw
                sequence = number.as_py() * per + np.arange(n)
                used = np.minimum(length, len(raw) - length * np.arange(n))
                data = grid.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(feistel(first.as_py() + sequence, total, key)), pa.array([file.as_py()] * n, pa.int64()), pa.array(sequence), pa.array(used), pa.array([data[2 * length * i : 2 * length * (i + 1)] for i in range(n)], pa.binary())],
                    ["slot", "file", "sequence", "n_tokens", "payload"],
                )

    return placed.mapInArrow(run, "slot bigint, file bigint, sequence bigint, n_tokens bigint, payload binary")


_SHARD = "shard bigint, first bigint, stride int, file array<bigint>, sequence array<bigint>, n_tokens array<bigint>, data binary"


def write_training_shards(ordered: DataFrame, *, length: int = SEQUENCE, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The stored shards: ``data`` holds the shard's sequences in order of slots, each ``stride`` bytes."""

    def one(shard, rows):
        slot, file, sequence, used, payload = zip(*rows)
        arrays = [pa.array([list(x)], pa.list_(pa.int64())) for x in (file, sequence, used)]
        return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([slot[0]]), pa.array([2 * length], pa.int32()), *arrays, pa.array([b"".join(payload)], pa.binary())], [c.split()[0] for c in _SHARD.split(", ")])

    def run(batches):
        held, at = [], None
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if held and row[0] // shard_slots != at:
                    yield one(at, held)
                    held = []
                at = row[0] // shard_slots
                held.append(row)
        if held:
            yield one(at, held)

    # a slot is known before it is written, so nothing is sampled; a shard lies in one task
    dealt = ordered.repartition(F.floor(F.col("slot") / shard_slots)).sortWithinPartitions("slot")
    return materialize(dealt.mapInArrow(run, _SHARD), "shards")


def read_training_shards(shards: DataFrame, slot: int = 0, *, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(slot, shard, at, file, sequence, n_tokens, payload) from ``slot`` on; shards before it are not read. In each
    shard rows come in order of slots, ``at`` is where the sequence begins in ``data``."""

    def run(batches):
        for batch in batches:
            for shard, first, stride, file, sequence, used, data in zip(*batch.columns):
                first, stride, data, n = first.as_py(), stride.as_py(), data.as_buffer(), len(file)
                k = np.arange(max(0, slot - first), n)
                payload = pa.array([data[i * stride : (i + 1) * stride].to_pybytes() for i in k.tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(first + k), pa.array([shard.as_py()] * len(k), pa.int64()), pa.array(k * stride), *(x.values.slice(int(k[0]) if len(k) else 0, len(k)) for x in (file, sequence, used)), payload], ["slot", "shard", "at", "file", "sequence", "n_tokens", "payload"])

    from_there = shards.where(F.col("shard") >= slot // shard_slots)
    return from_there.mapInArrow(run, "slot bigint, shard bigint, at bigint, file bigint, sequence bigint, n_tokens bigint, payload binary")


def op8_feistel_order(spark, sf_dir: str) -> DataFrame:
    blocks, _ = write_token_files(table(spark, sf_dir, "documents"))
    with arrow_rows(spark, 64):  # rows of payloads and whole shards
        shards = write_training_shards(training_order(blocks))
    return read_training_shards(shards).select("slot", "shard", "at", "file", "sequence", "n_tokens", F.crc32("payload").alias("payload_crc32"), "payload")
