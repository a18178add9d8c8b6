"""Suffix-array dedup: remove every byte of a 200-byte string that also starts anywhere else.

All 200-byte windows of the corpus are candidates. A window is routed by the smallest hash among its 64-byte
grams (its anchor), which depends on the window's bytes alone, so equal windows share an anchor; neighbouring
windows of one anchor travel as one segment. Anchors that occur once in the corpus cannot hold a repeat and
are dropped before any text moves. The segments of an anchor meet in one task, which orders all their windows
by deep-shallow suffix sorting; windows equal to a neighbour in that order are repeats. Equal documents
collapse to one beforehand: every window of a copy is a repeat. Anchors with more than ``hot`` bytes of segments, more
than a task sorts at once (a
passage that a third of the rows hold), are not sent to one task: equal segments collapse, and the others descend
a trie of aligned spans, told by 128-bit fingerprints, whose levels are grouped by Spark and spread evenly.

A null or empty text keeps nothing and loses nothing; texts under ``length`` bytes lose nothing. Repeated rows
and ties are copies, and each loses all that repeats. Ids may repeat or be null: texts are told by digest. No rows give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.operators.relational import free_names

from . import textops as T
from .shared import materialize, table, text_digest
from .suffix_sort import sort_windows

LENGTH = 200
GRAM = 64
#: Bytes of an anchor's segments that one task sorts.
HOT = 4 << 20
#: Windows of one segment at most, and bytes of segments that are sorted together.
SEGMENT, SORT_BYTES = 1024, 1 << 20
PIECE = 4 << 20
#: Rows of a key from which it is broadcast, where that is more than one row in 256.
HEAVY = 1000
#: Runs of hot anchors in a chunk, about.
CHUNK = 8
_AT = np.uint64((1 << 24) - 1)


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each ``gram`` bytes (a power of two) by doubling."""
    h = data.astype(np.uint64) + np.uint64(1)
    base, size = 0x9E3779B97F4A7C15 | 1, 1
    while size < gram:
        h = h[:-size] * np.uint64(base) + h[size:]
        base = (base * base) & ((1 << 64) - 1)
        size *= 2
    return T.mix(h)


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def window_runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of windows with one anchor: (anchor, several occurrences, first window, last window, document)."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.view(np.uint64), none, none, none, none
    h = _gram_hashes(data, gram)
    # the leftmost of equal hashes wins, so equal windows choose equal places
    chosen = _window_min((h & ~_AT) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
    n = np.diff(offsets)
    windows = np.maximum(n - length + 1, 0)
    at = T.ragged(offsets[:-1], windows)
    doc = np.repeat(np.arange(len(n)), windows)
    if not len(at):
        return none.view(np.uint64), none, none, none, none
    place = (chosen[at] & _AT).astype(np.int64)
    moved = np.ones(len(at), bool)
    moved[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(moved)
    anchor = h[place[first]]
    fresh = np.ones(len(first), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (doc[first[1:]] != doc[first[:-1]])
    several = np.diff(np.concatenate((np.flatnonzero(fresh), [len(first)]))) > 1
    begin = first[fresh]
    end = np.concatenate((begin[1:], [len(at)])) - 1
    anchor = anchor[fresh]
    pieces = -(-(end - begin + 1) // SEGMENT)
    which = np.repeat(np.arange(len(begin)), pieces)
    begin = begin[which] + SEGMENT * (np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    end = np.minimum(begin + SEGMENT - 1, end[which])
    own = doc[begin]
    return anchor[which], (several | (pieces > 1))[which].astype(np.int64), at[begin] - offsets[own], at[end] - offsets[own], own


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int):
    """Very long documents in overlapping pieces, so that places fit 24 bits: (bytes, offsets, row, shift)."""
    if offsets[-1] <= PIECE:
        yield data, offsets, 0, 0
        return
    for k in range(len(offsets) - 1):
        a, b = int(offsets[k]), int(offsets[k + 1])
        for lo in range(a, max(a + 1, b - length + 1), PIECE - length + 1):
            own = data[lo : min(b, lo + PIECE)]
            yield own, np.array([0, len(own)]), k, lo - a


_RUNS = "doc_id bigint, h binary, sha binary, n_bytes bigint, runs array<struct<m:bigint,c:bigint,a:int,b:int>>"


def _runs(docs: DataFrame, length: int) -> DataFrame:
    """For each document its digest, size and runs of windows."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in T.blocks(batch.column(1)):
                parts = []
                for own, at, row, shift in _pieces(data, offsets, length):
                    m, c, a, b, doc = window_runs(own, at, length)
                    parts.append((m, c, a + shift, b + shift, doc + row))
                m, c, a, b, doc = (np.concatenate(x) for x in zip(*parts))
                raw = data.tobytes()
                sha = [hashlib.sha256(raw[x:y]).digest() for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                rows = pa.StructArray.from_arrays([pa.array(m.view(np.int64)), pa.array(c), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["m", "c", "a", "b"])
                lists = T.list_array(rows, np.searchsorted(doc, np.arange(hi - lo + 1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array([x[:16] for x in sha], pa.binary()), pa.array(sha, pa.binary()), pa.array(np.diff(offsets)), lists], ["doc_id", "h", "sha", "n_bytes", "runs"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, _RUNS)


def _segments(candidates: DataFrame, length: int) -> DataFrame:
    """(m, h, a, segment) of the runs of anchors that are not hot."""

    def run(batches):
        for batch in batches:
            texts, lists = batch.column(1), batch.column(2)
            flat, at = lists.flatten(), np.asarray(lists.offsets)
            at = at - at[0]
            m, a, b, hot = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            doc = np.repeat(np.arange(batch.num_rows), np.diff(at))
            cold = np.flatnonzero(hot == 0)
            for lo in range(0, len(cold), 4096):
                own = cold[lo : lo + 4096]
                raw = {k: texts[int(k)].as_py() for k in np.unique(doc[own])}
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(m[own]),
                        batch.column(0).take(pa.array(doc[own])),
                        pa.array(a[own].astype(np.int32)),
                        pa.array([raw[k][x : y + length] for k, x, y in zip(doc[own], a[own].tolist(), b[own].tolist())], pa.binary()),
                    ],
                    ["m", "h", "a", "segment"],
                )

    return candidates.select("h", "text", "runs").mapInArrow(run, "m bigint, h binary, a int, segment binary")


def sort_segments(segments: list[bytes], length: int) -> list[np.ndarray]:
    """For each segment its windows that start elsewhere too, as rows (first, last)."""
    index: dict[bytes, int] = {}
    of = [index.setdefault(s, len(index)) for s in segments]
    copies = np.bincount(of, minlength=len(index))
    distinct = list(index)
    sizes = np.fromiter(map(len, distinct), np.int64, len(distinct))
    data = np.frombuffer(b"".join(distinct), np.uint8)
    begin = np.concatenate(([0], np.cumsum(sizes)))
    windows = sizes - length + 1
    starts = T.ragged(begin[:-1], windows)
    order, same = sort_windows(data, starts, length)
    repeat = np.zeros(len(starts), bool)
    both = same.copy()
    both[:-1] |= same[1:]
    repeat[order] = both
    repeat |= np.repeat(copies > 1, windows)
    at = np.concatenate(([0], np.cumsum(windows)))
    out = []
    for k in range(len(distinct)):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], repeat[at[k] : at[k + 1]].astype(np.int8), [0]))))
        out.append(np.column_stack((edge[0::2], edge[1::2] - 1)))
    return [out[k] for k in of]


def _repeats(segments: DataFrame, length: int) -> DataFrame:
    """(h, a, b): runs of repeated windows, found by sorting the segments of each anchor together."""

    def sorted_block(m, h, a, seg):
        found = sort_segments(seg, length)
        n = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.concatenate(found) if len(found) else np.zeros((0, 2), np.int64)
        shift = np.repeat(np.array(a, np.int64), n)
        which = np.repeat(np.arange(len(found)), n)
        return pa.RecordBatch.from_arrays([pa.array([h[k] for k in which], pa.binary()), pa.array((flat[:, 0] + shift).astype(np.int32)), pa.array((flat[:, 1] + shift).astype(np.int32))], ["h", "a", "b"])

    def run(batches):
        held: tuple[list, list, list, list] = ([], [], [], [])
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if size >= SORT_BYTES and row[0] != held[0][-1]:
                    yield sorted_block(*held)
                    held, size = ([], [], [], []), 0
                for x, v in zip(held, row):
                    x.append(v)
                size += len(row[3])
        if size:
            yield sorted_block(*held)

    return segments.repartition("m").sortWithinPartitions("m").mapInArrow(run, "h binary, a int, b int")


def _hot_chunks(candidates: DataFrame, length: int) -> DataFrame:
    """(uf, ug, h, a, last, chunk): adjoining runs of hot anchors, cut by the anchors' bits; fingerprint uf, ug. Where
    they are cut decides cost, never results."""

    def run(batches):
        for batch in batches:
            texts, lists = batch.column(1), batch.column(2)
            flat, at = lists.flatten(), np.asarray(lists.offsets)
            m, a, b = (flat.field(k).to_numpy().astype(np.int64) for k in range(3))
            doc = np.repeat(np.arange(batch.num_rows), np.diff(at))
            hot = np.flatnonzero(flat.field(3).to_numpy(zero_copy_only=False))
            hot = hot[np.lexsort((a[hot], doc[hot]))]
            m, a, b, doc = m[hot], a[hot], b[hot], doc[hot]
            fresh = np.ones(len(hot), bool)
            fresh[1:] = (doc[1:] != doc[:-1]) | (a[1:] != b[:-1] + 1) | ((m[1:] >> 40) % CHUNK == 0)
            since = np.arange(len(hot)) - np.maximum.accumulate(np.where(fresh, np.arange(len(hot)), 0))
            first = np.flatnonzero(fresh | (since % (4 * CHUNK) == 0))
            last = np.concatenate((first[1:], [len(hot)])) - 1
            for x in range(0, len(first), 64):
                begin, end, own = a[first[x : x + 64]], b[last[x : x + 64]], doc[first[x : x + 64]]
                raw = {k: texts[int(k)].as_py() for k in np.unique(own)}
                chunks = [raw[k][y : z + length] for k, y, z in zip(own, begin.tolist(), end.tolist())]
                ends = np.cumsum(end - begin + length)
                f, g = T.span_hashes_128(np.frombuffer(b"".join(chunks), np.uint8), np.concatenate(([0], ends[:-1])), ends)
                numbers = [pa.array(f.view(np.int64)), pa.array(g.view(np.int64)), batch.column(0).take(pa.array(own)), pa.array(begin), pa.array(end - begin)]
                yield pa.RecordBatch.from_arrays([*numbers, pa.array(chunks, pa.binary())], ["uf", "ug", "h", "a", "last", "chunk"])

    hot = candidates.where(F.exists("runs", lambda r: r["hot"] == 1))
    return hot.select("h", "text", "runs").mapInArrow(run, "uf bigint, ug bigint, h binary, a bigint, last bigint, chunk binary")


def _hot_segments(chunks: DataFrame, length: int) -> DataFrame:
    """(f, g, uf, ug, alone, a, lo, hi, segment): the windows of chunks (uf, ug, alone, chunk), cut where the place of
    their anchor changes. A window is named by the distance from its start to that place, lo to hi in a segment, so
    that equal windows have equal names; f and g tell the segment and its names."""

    def run(batches):
        for batch in batches:
            for x, y, data, offsets in T.blocks(batch.column(3)):
                windows = np.diff(offsets) - length + 1
                starts, chunk = T.ragged(offsets[:-1], windows), np.repeat(np.arange(y - x), windows)
                hashes = _gram_hashes(data, GRAM)
                chosen = _window_min((hashes & ~_AT) | np.arange(len(hashes), dtype=np.uint64), length - GRAM + 1)
                place = (chosen[starts] & _AT).astype(np.int64)
                fresh = np.ones(len(starts), bool)
                fresh[1:] = (place[1:] != place[:-1]) | (chunk[1:] != chunk[:-1])
                first = np.flatnonzero(fresh)
                n = np.diff(np.concatenate((first, [len(starts)])))
                start, which = starts[first], chunk[first]
                end, far = start + n - 1 + length, place[first] - start
                f, g = (pa.array(_named(v, far).view(np.int64)) for v in T.span_hashes_128(data, start, end))
                raw, take = data.tobytes(), pa.array(which + x)
                parts = pa.array([raw[u:v] for u, v in zip(start.tolist(), end.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [f, g, *(batch.column(k).take(take) for k in range(3)), pa.array(start - offsets[which]), pa.array(far - n + 1), pa.array(far), parts],
                    ["f", "g", "uf", "ug", "alone", "a", "lo", "hi", "segment"],
                )

    schema = "f bigint, g bigint, uf bigint, ug bigint, alone boolean, a bigint, lo bigint, hi bigint, segment binary"
    return chunks.select("uf", "ug", "alone", "chunk").mapInArrow(run, schema)


def _named(hashes: np.ndarray, name: np.ndarray) -> np.ndarray:
    return T.mix(hashes + T.mix(name.astype(np.uint64) + np.uint64(1)))


def _branches(spans: DataFrame, width: int, length: int) -> DataFrame:
    """Spans (kf, kg, lo, hi, segment) cut at multiples of ``width``: their own fingerprint (sf, sg), and that (cf,
    cg) of the core, the bytes that all windows of such a whole block share; equal windows have equal cores."""

    def run(batches):
        for batch in batches:
            for x, y, data, at in T.blocks(batch.column(4)):
                lo, hi = (batch.column(k).slice(x, y - x).to_numpy() for k in (2, 3))
                kids = hi // width - lo // width + 1
                of = np.repeat(np.arange(y - x), kids)
                base = (lo[of] // width + T.ragged(np.zeros(y - x, np.int64), kids)) * width
                c1, c2, top = np.maximum(base, lo[of]), np.minimum(base + width - 1, hi[of]), np.minimum(base + width - 1, length - GRAM)
                zero = at[:-1][of] + hi[of]
                start, end = zero - c2, zero - c1 + length
                sf, sg = (_named(_named(v, c1), c2) for v in T.span_hashes_128(data, start, end))
                cf, cg = (_named(v, base) for v in T.span_hashes_128(data, zero - base, zero - top + length))
                raw, take = data.tobytes(), pa.array(of + x)
                numbers = [pa.array(v.view(np.int64)) for v in (sf, sg, cf, cg)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(c1), pa.array(c2), pa.array([raw[u:v] for u, v in zip(start.tolist(), end.tolist())], pa.binary()), *numbers],
                    ["kf", "kg", "lo", "hi", "segment", "sf", "sg", "cf", "cg"],
                )

    schema = "kf bigint, kg bigint, lo bigint, hi bigint, segment binary, sf bigint, sg bigint, cf bigint, cg bigint"
    return spans.select("kf", "kg", "lo", "hi", "segment").mapInArrow(run, schema)


def _with_keys(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` joined with ``keys`` (on, n, ...), where n is the number of rows of a key. Keys of more than one row
    in 256 (so at most 256 of them) are broadcast, and only the others' rows are dealt out by key."""
    heavy = F.col("n") > max(HEAVY, rows.count() // 256)
    large = F.broadcast(keys.where(heavy).drop("n"))
    rest = rows.join(F.broadcast(keys.where(heavy).select(*on)), on, "left_anti").join(keys.where(~heavy).drop("n"), on)
    return rows.join(large, on).unionByName(rest)


def _hot_repeats(candidates: DataFrame, length: int) -> DataFrame:
    """(h, windows): repeated windows of hot anchors, by descending a trie of spans around the anchor.

    Equal chunks collapse to one first, then equal segments, and all their windows are repeats. Then the others
    branch by blocks of 64, 16, 4 and 1 windows: a block that also occurs elsewhere is repeated as a whole, one whose core has no other
    block ends there, and of equal blocks one goes on for all, so work follows the places where texts part.
    """
    chunks = materialize(_hot_chunks(candidates, length), "chunks")
    kinds = chunks.groupBy("uf", "ug").agg(F.count("*").alias("n"), F.first("last").alias("last"), F.first("chunk").alias("chunk"))
    kinds = materialize(kinds.withColumn("alone", F.col("n") == 1), "kinds")
    segments = materialize(_hot_segments(kinds, length), "segments")
    distinct = segments.groupBy("f", "g").agg(F.count("*").alias("n"), F.first(F.struct("lo", "hi", "segment")).alias("s"))
    distinct = materialize(distinct.select(F.col("f").alias("kf"), F.col("g").alias("kg"), "n", "s.*"), "distinct")
    found, spans = distinct.where("n > 1").select("kf", "kg", "lo", "hi"), distinct
    width = 1
    while width * 4 <= length - GRAM:
        width *= 4
    while width:
        parts = materialize(_branches(spans, width, length), f"branches{width}")
        blocks = parts.groupBy("sf", "sg", "cf", "cg").agg(F.count("*").alias("n"), F.first(F.struct("kf", "kg", "lo", "hi", "segment")).alias("s"))
        blocks = materialize(blocks, f"blocks{width}")
        twice = blocks.where("n > 1").select("sf", "sg", "n")
        found = found.union(_with_keys(parts.select("sf", "sg", "kf", "kg", "lo", "hi"), twice, ["sf", "sg"]).select("kf", "kg", "lo", "hi"))
        if width > 1:
            parting = blocks.groupBy("cf", "cg").agg(F.count("*").alias("n")).where("n > 1")
            spans = _with_keys(blocks.select("cf", "cg", "s"), parting, ["cf", "cg"]).select("s.*")
        width //= 4
    joined = F.aggregate(
        F.array_sort(F.collect_list(F.struct("lo", "hi"))),
        F.array().cast("array<struct<lo:bigint,hi:bigint>>"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["hi"] >= x["lo"] - 1),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["lo"].alias("lo"), F.greatest(F.element_at(done, -1)["hi"], x["hi"]).alias("hi")))),
        ).otherwise(F.concat(done, F.array(x))),
    )
    repeats = materialize(found.groupBy("kf", "kg").agg(joined.alias("names")), "repeats")
    keys = repeats.join(distinct.select("kf", "kg", "n"), ["kf", "kg"]).select(F.col("kf").alias("f"), F.col("kg").alias("g"), "names", "n")
    out = _with_keys(segments.where("alone").select("f", "g", "uf", "ug", "a", F.col("hi").alias("far")), keys, ["f", "g"])
    span = lambda lo, hi: F.struct(lo.cast("int").alias("a"), hi.cast("int").alias("b"))
    windows = F.transform("names", lambda x: span(F.col("a") + F.col("far") - x["hi"], F.col("a") + F.col("far") - x["lo"]))
    parts = out.groupBy("uf", "ug").agg(F.flatten(F.collect_list(windows)).alias("windows")).withColumn("n", F.lit(1).cast("bigint"))
    whole = kinds.where("n > 1").select("uf", "ug", F.array(span(F.lit(0), F.col("last"))).alias("windows"), "n")
    known = materialize(parts.unionByName(whole), "known")
    found = _with_keys(chunks.select("uf", "ug", "h", "a"), known, ["uf", "ug"])
    return found.select("h", F.transform("windows", lambda x: span(F.col("a") + x["a"], F.col("a") + x["b"])).alias("windows"))


_CUT = "h binary, n_removed bigint, n_spans bigint, kept_sha binary, spans array<struct<start:int,end:int>>, kept binary"


def _cut(candidates: DataFrame, found: DataFrame, length: int, keep_text: bool) -> DataFrame:
    """Remove the bytes of all repeated windows from their documents."""
    lists = found.groupBy("h").agg(F.flatten(F.collect_list("windows")).alias("windows"))

    def run(batches):
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py()
                runs = batch.column(2)[k].values
                a, b = runs.field(0).to_numpy().astype(np.int64), runs.field(1).to_numpy().astype(np.int64) + length
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate(b[order])
                first = np.ones(len(a), bool)
                first[1:] = a[1:] > b[:-1]
                begin = a[first]
                end = b[np.concatenate((np.flatnonzero(first)[1:], [len(a)])) - 1]
                edges = np.concatenate(([0], np.column_stack((begin, end)).ravel(), [len(text)])).tolist()
                kept = b"".join(text[x:y] for x, y in zip(edges[0::2], edges[1::2]))
                out.append((batch.column(0)[k].as_py(), int((end - begin).sum()), len(begin), hashlib.sha256(kept).digest(), [{"start": x, "end": y} for x, y in zip(begin.tolist(), end.tolist())], kept.decode(errors="ignore").encode() if keep_text else None))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.binary()))] if out else [],
                ["h", "n_removed", "n_spans", "kept_sha", "spans", "kept"],
            )

    return candidates.select("h", "text").join(lists, "h").mapInArrow(run, _CUT)


def find_repeats(docs: DataFrame, *, length: int = LENGTH, hot: int = HOT, keep_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, cuts): documents (doc_id, h, sha, n_bytes, copies) for every row of ``docs`` (doc_id, text), and
    cuts, one for each digest h of the texts that hold repeated windows; a text of at least ``length`` bytes that has
    copies is lost whole."""
    runs = materialize(_runs(docs, length).withColumn("row", F.monotonically_increasing_id()), "runs")
    groups = runs.groupBy("h").agg(F.count("*").alias("copies"), F.min("row").alias("rep"))
    copied = materialize(groups.where("copies > 1"), "copies")
    one = runs.where("n_bytes >= %d" % length).join(copied.select("h", "rep"), "h", "left")
    # one row of each digest stands for its copies, whatever their ids
    one = one.where("rep is null or row = rep").select("h", F.explode("runs").alias("r")).select("h", "r.*")
    size = F.sum(F.col("b") - F.col("a") + length).alias("size")
    counts = one.groupBy("m").agg(F.sum(F.col("c") + 1).alias("n"), size).where("n > 1").select("m", (F.col("size") > hot).cast("int").alias("hot"))
    lists = one.join(counts, "m").groupBy("h").agg(F.collect_list(F.struct("m", "a", "b", "hot")).alias("runs"))
    texts = docs.select(text_digest("text").alias("h"), F.col("text").cast("binary").alias("text")).where(F.octet_length("text") >= length)
    candidates = texts.groupBy("h").agg(F.first("text").alias("text")).join(lists, "h")
    candidates = materialize(candidates.select("h", "text", "runs"), "candidates")
    cold = _repeats(_segments(candidates, length), length)
    found = cold.select("h", F.array(F.struct("a", "b")).alias("windows")).union(_hot_repeats(candidates, length))
    return runs.drop("runs", "row").join(copied.select("h", "copies"), "h", "left"), _cut(candidates, found, length, keep_text)


def remove_repeats(docs: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated bytes cut from their texts; documents of which nothing is left go.

    A cut may fall inside a character; such broken bytes are left out. A column n_chars follows the text.
    """
    rows, cuts = find_repeats(docs.select("doc_id", "text"), length=length, keep_text=True)
    gone = rows.where((F.col("copies") > 1) & (F.col("n_bytes") >= length)).select("h", "copies").distinct()
    heavy = F.col("copies") > max(HEAVY, rows.count() // 256)
    # what a text loses depends on its bytes alone, so cuts come back by digest; heavy ones meet no join by key
    h, kept = free_names(docs, "_h", "_kept")
    light = gone.where(~heavy).select("h", F.lit(b"").alias(kept))
    changed = cuts.join(gone, "h", "left_anti").select("h", F.col("kept").alias(kept)).union(light).withColumnRenamed("h", h)
    names = docs.columns
    out = docs.withColumn(h, text_digest("text")).join(F.broadcast(gone.where(heavy).select(F.col("h").alias(h))), h, "left_anti").join(changed, h, "left")
    text = F.when(F.col(kept).isNull(), F.col("text")).otherwise(F.decode(kept, "UTF-8"))
    out = out.withColumn("text", text).where(F.col(kept).isNull() | (F.octet_length("text") > 0))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col(kept).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*names)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    rows, cuts = find_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    whole = (F.coalesce("copies", F.lit(1)) > 1) & (F.col("n_bytes") >= LENGTH)
    found = rows.join(cuts.select("h", "n_removed", "n_spans", "kept_sha"), "h", "left")
    return found.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.lower(F.when(whole, F.sha2(F.lit(b""), 256)).otherwise(F.hex(F.coalesce("kept_sha", "sha")))).alias("kept_sha256"),
    )
