"""Benchmark decontamination with one FM-index per bounded training shard.

``find_contamination`` cuts each partition of the documents into shards of whole documents, indexes every
shard's words, searches all benchmark windows backwards through wavelet-tree ranks, locates the occurrences
from sampled suffix positions, and merges them to spans. A document lies in one shard, so nothing is shuffled.

Words are `[0-9a-z]` and non-ASCII bytes after lower-casing A-Z. A window is ``window`` consecutive words of
an item; an item of fewer words is one window. Null, empty or wordless texts have no words and are never
contaminated; wordless items have no windows; equal items count by their distinct ids; repeated documents are
judged each on their own. Items are cut into pieces of hashed words by Spark. What of them is searched at once is
bounded by ``block_bytes`` of windows and by the index's alphabet; a larger benchmark is searched block by block,
each block's spans are written and its broadcast released before the next, and spans are merged by text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import textops as T
from .fm_index import FMIndex
from .shared import materialize, table, text_digest

WINDOW = 13
BLOCK_BYTES = 16 << 20
#: Distinct words that an index can tell, windows of a piece at most, and bytes that a window takes in a block.
VOCABULARY, PIECE, WINDOW_BYTES = 65534, 4096, 48
_SPANS = "array<struct<first:int,last:int,start:int,end:int>>"


def _words(column: pa.Array):
    """Per block: lower-cased bytes, document offsets, word starts and ends, first word of each document."""
    for lo, hi, data, at in T.blocks(column):
        data = T.lower_ascii(data)
        starts, ends = T.word_spans(data, at, T.ALNUM)
        yield lo, hi, data, at, starts, ends, T.counts_by_doc(starts, at)


class Phrases:
    """Distinct windows of pieces of items (id, hashes of its words) as symbols of their own vocabulary."""

    def __init__(self, ids: list[str], words: list[np.ndarray], window: int = WINDOW):
        n = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.ids = ids
        self.vocabulary, symbol = np.unique(flat, return_inverse=True)
        if len(self.vocabulary) > VOCABULARY:
            raise OverflowError(len(self.vocabulary))
        windows = np.where(n > 0, np.maximum(n - window + 1, 1), 0)
        owner = np.repeat(np.arange(len(words)), windows)
        lengths = np.minimum(n[owner], window)
        end = T.ragged(np.cumsum(n) - n, windows) + lengths
        # a window stands at the right end of its row, and its length in the column after that
        both = np.zeros((len(owner), window + 1), np.uint16)
        both[:, window] = lengths
        padded = np.concatenate((np.zeros(window, np.uint16), (symbol.ravel() + 1).astype(np.uint16)))
        for k in range(window):
            both[:, k] = np.where(window - k <= lengths, padded[end + k], 0)
        _, first, of = np.unique(both.view(f"V{2 * window + 2}").ravel(), return_index=True, return_inverse=True)
        order = np.argsort(of.ravel(), kind="stable")
        self.owners, self.owner_at = owner[order].astype(np.int32), np.searchsorted(of.ravel()[order], np.arange(len(first) + 1))
        self.rows, self.lengths = np.ascontiguousarray(both[first, :window]), both[first, window].astype(np.int64)

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


def search_shard(hashes: np.ndarray, doc_of: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, first word, words) of every occurrence of a window in a shard of words ``hashes``.

    Runs of benchmark words shorter than the shortest window cannot hold one; they are left out of the index.
    """
    none = np.zeros(0, np.int64)
    if not len(phrases.lengths) or not len(hashes):
        return none, none, none
    symbol = phrases.symbols(hashes)
    known = symbol > 0
    begins = known.copy()
    begins[1:] &= ~known[:-1] | (doc_of[1:] != doc_of[:-1])
    ends = known.copy()
    ends[:-1] &= ~known[1:] | (doc_of[1:] != doc_of[:-1])
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    long = end - begin >= phrases.lengths.min()
    begin, end = begin[long], end[long]
    if not len(begin):
        return none, none, none
    place = T.ragged(begin, end - begin + 1)  # one more for the separator
    tail = np.cumsum(end - begin + 1) - 1
    text = symbol[np.minimum(place, len(symbol) - 1)]
    text[tail] = 0
    index = FMIndex(text, len(phrases.vocabulary))
    lo, hi = index.search(phrases.rows, phrases.lengths)
    found = np.flatnonzero(hi > lo)
    rows = T.ragged(lo[found], hi[found] - lo[found])
    which = np.repeat(found, hi[found] - lo[found])
    return which, place[index.locate(rows)], phrases.lengths[which]


def _merged(first: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """Which of n words any of the spans covers."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + size, -1)
    return np.cumsum(edge[:-1]) > 0


def _search(batches: Iterator[pa.RecordBatch], phrases: Phrases) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets, starts, ends, at in _words(batch.column(1)):
            n_docs = hi - lo
            n_words = np.diff(at)
            doc_of = np.repeat(np.arange(n_docs), n_words)
            which, first, size = search_shard(T.span_hashes(data, starts, ends), doc_of, phrases)
            hit = _merged(first, size, len(starts))
            n_hit = np.bincount(doc_of[hit], minlength=n_docs)
            edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
            run_first, run_last = edge[0::2], edge[1::2] - 1
            # a run of hit words may pass from one document to the next
            cut = at[1:-1][(n_words[:-1] > 0)] if n_docs > 1 else np.zeros(0, np.int64)
            cut = np.unique(cut)
            cut = cut[(cut > 0) & (cut < len(hit))]
            cut = cut[hit[cut] & hit[cut - 1]]
            run_first, run_last = np.sort(np.concatenate((run_first, cut))), np.sort(np.concatenate((run_last, cut - 1)))
            spans_at = np.searchsorted(run_first, at)
            own = doc_of[run_first]
            spans = pa.StructArray.from_arrays(
                [pa.array(x.astype(np.int32)) for x in (run_first - at[own], run_last - at[own], starts[run_first] - offsets[own], ends[run_last] - offsets[own])],
                ["first", "last", "start", "end"],
            )
            reach = phrases.owner_at[which + 1] - phrases.owner_at[which]
            pairs = np.unique(np.column_stack((np.repeat(doc_of[first], reach), phrases.owners[T.ragged(phrases.owner_at[which], reach)])), axis=0)
            items_at = np.searchsorted(pairs[:, 0], np.arange(n_docs + 1))
            names = pa.array([phrases.ids[k] for k in pairs[:, 1]], pa.string())  # an item of several pieces may repeat
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, n_docs), pa.array(n_words), pa.array(n_hit), T.list_array(spans, spans_at), T.list_array(names, items_at)],
                ["key", "n_words", "n_hit", "hits", "items"],
            )


def _pieces(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(id, words, size): hashed words of items, long items in pieces that share ``window`` - 1 words."""
    most = min(PIECE, VOCABULARY - window + 1)

    def run(batches):
        for batch in batches:
            for lo, _, data, _, starts, ends, at in _words(batch.column(1)):
                h = T.span_hashes(data, starts, ends)
                rows, parts = [], []
                for k in range(len(at) - 1):
                    for x in range(int(at[k]), max(int(at[k]) + 1, int(at[k + 1]) - window + 1) if at[k + 1] > at[k] else 0, most):
                        rows.append(lo + k)
                        parts.append(h[x : min(x + most + window - 1, int(at[k + 1]))].tobytes())
                        if len(parts) == 256:
                            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(parts, pa.binary())], ["id", "words"])
                            rows, parts = [], []
                if parts:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(parts, pa.binary())], ["id", "words"])

    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("None")).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    pieces = items.mapInArrow(run, "id string, words binary").distinct()
    windows = F.greatest(F.octet_length("words") / 8 - (window - 1), F.lit(1))
    return pieces.withColumn("size", (windows * WINDOW_BYTES + F.octet_length("id") + 32).cast("bigint"))


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> Iterator[tuple[bool, Phrases]]:
    """(only one, phrases) for blocks of pieces; a block of too many distinct words is cut again by hash."""
    pieces = _pieces(benchmark, id_col, text_col, window)
    pieces = materialize(pieces.withColumn("key", F.xxhash64("id", "words")), "pieces")
    size = pieces.agg(F.sum("size")).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    todo = [(k, n) for k in range(n - 1, -1, -1)]
    while todo:
        k, of = todo.pop()
        rows = pieces.where(F.pmod("key", F.lit(of)) == k).select("id", "words").collect()
        try:
            phrases = Phrases([r.id for r in rows], [np.frombuffer(r.words, np.uint64) for r in rows], window)
        except OverflowError:
            todo += [(k + of, 2 * of), (k, 2 * of)]
            continue
        yield of == 1, phrases


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, text_col="text", item_col="item_id", item_text_col="text", window=WINDOW, block_bytes=BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit, hits (merged spans: words first..last, bytes start..end) and items added.

    The added columns take the place of columns of these names. All columns of ``docs`` stay.
    """
    spark = docs.sparkSession
    added = ["n_words", "n_hit", "hits", "items"]
    kept = docs.drop(*added)
    texts = kept.select(text_digest(text_col).alias("_h"), F.col(text_col).alias("text"))
    found = None
    for only, phrases in _blocks(benchmark, item_col, item_text_col, window, block_bytes):
        shipped = spark.sparkContext.broadcast(phrases)
        if only:
            distinct = F.array_distinct("items")
            return _attach(kept, text_col, shipped).withColumn("items", distinct).select(*kept.columns, *added)
        hit = _attach(texts, "text", shipped).where("n_hit > 0").select("_h", "hits", "items").dropDuplicates(["_h"])
        hit = materialize(hit, "spans")
        shipped.destroy()
        found = hit if found is None else found.union(hit)
    # spans depend on the text alone, so those of all blocks meet by its digest
    merged = found.groupBy("_h").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    merged = merged.withColumn("hits", _merge_spans("hits")).withColumn("n_hit", F.aggregate("hits", F.lit(0).cast("bigint"), lambda a, x: a + x["last"] - x["first"] + 1))
    merged = materialize(merged, "merged")
    counted = _attach(kept, text_col, spark.sparkContext.broadcast(Phrases([], [], window))).drop("n_hit", "hits", "items")
    out = counted.withColumn("_h", text_digest(text_col)).join(merged, "_h", "left")
    none = {"n_hit": "0L", "hits": f"cast(array() as {_SPANS})", "items": "cast(array() as array<string>)"}
    return out.select(*kept.columns, "n_words", *(F.expr(f"coalesce({c}, {x})").alias(c) for c, x in none.items()))


def _merge_spans(column: str):
    """Overlapping spans of several blocks to disjoint ones."""

    def step(done, x):
        top = F.try_element_at(done, F.lit(-1))
        joined = F.struct(top["first"].alias("first"), F.greatest(top["last"], x["last"]).alias("last"), top["start"].alias("start"), F.greatest(top["end"], x["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (x["first"] <= top["last"] + 1), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(column), F.expr(f"cast(array() as {_SPANS})"), step)


def _attach(docs: DataFrame, text_col: str, shipped) -> DataFrame:
    """One pass of a block over all rows; the other columns ride along untouched."""
    schema = docs.schema
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        phrases = shipped.value
        for batch in batches:
            keys = pa.array(np.arange(batch.num_rows))
            for out in _search([pa.RecordBatch.from_arrays([keys, batch.column(at)], ["key", "text"])], phrases):
                lo, n = out.column(0)[0].as_py(), out.num_rows
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, n) for k in range(len(names))), *out.columns[1:]], [*names, *out.schema.names[1:]])

    extra = StructType.fromDDL(f"n_words bigint, n_hit bigint, hits {_SPANS}, items array<string>")
    return docs.mapInArrow(run, StructType([*schema.fields, *extra.fields]))


def is_contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, unchanged, columns of the names that ``find_contamination`` adds included."""
    own = docs.toDF(*(f"_own_{c}" for c in docs.columns))
    kept = find_contamination(own, benchmark, text_col="_own_text").where(~is_contaminated())
    return kept.select(*(F.col(f"_own_{c}").alias(c) for c in docs.columns))


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


_FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = rf"list_filter(regexp_split_to_array({_FOLD}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
OP6_SQL = f"""
with d as (select doc_id, coalesce({_SPLIT}, []) as w from documents),
b as (select item_id, {_SPLIT} as w from benchmark where text is not null),
bw as (
  select distinct item_id, least(13, len(w)) as k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') as g
  from b, unnest(range(1, greatest(2, len(w) - 11))) as t(i) where len(w) > 0
),
ks as (select distinct k from bw),
dw as (
  select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') as g
  from d, ks, unnest(range(1, len(w) - k + 2)) as t(i)
),
m as (select dw.doc_id, dw.i, dw.k, bw.item_id from dw join bw on dw.k = bw.k and dw.g = bw.g),
h as (select doc_id, count(distinct p) as n_hit from m, unnest(range(i, i + k)) as t(p) group by doc_id),
it as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as ids from (select distinct doc_id, cast(item_id as varchar) as s from m) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(h.n_hit, 0) as n_hit, coalesce(it.n_items, 0) as n_items,
  sha256(coalesce(it.ids, '')) as items_sha256,
  coalesce(h.n_hit, 0) > 0 and 20 * coalesce(h.n_hit, 0) >= len(d.w) as contaminated
from d left join h using (doc_id) left join it using (doc_id)
"""
