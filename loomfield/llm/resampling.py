"""Target-distribution importance resampling of hashed n-gram features, counted by DuckDB inside Spark's tasks.

Each task hands its documents, a few megabytes at a time, to an in-process DuckDB: SQL splits the words, unnests them,
windows runs of words to n-grams, hashes them with a registered zlib CRC function and counts buckets by document. Spark
spills these counts to Parquet in the shared folder, merges them to corpus counts, and turns both corpora's counts into
the gain of each bucket. A document's weight is the mean gain of its features; a Gumbel draw from the hash of its id makes
the sampling without replacement a top list, whose ranks come from range partitions and the sums of their sizes.

A null text is an empty one; a text without words has no features, weight 0 and is never drawn. Very long texts go in
pieces cut between words, each opening with the word before it, so that no run of words is lost. Repeated rows
are rows of their own with one score. A null id hashes as an empty one and stands after all others among ties. Other columns
are not read. No rows give no rows; an empty target has counts of 0.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.operators.relational import ordered_numbers

from . import textops as T
from .shared import materialize, table

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10000, 2, 20, 25, 7
#: Bytes of text that DuckDB gets at once, and of a piece of one text.
BLOCK_BYTES = 1 << 20
MEMORY = "512MB"
_LETTERS = T.ALNUM | T.byte_class(range(65, 91))
_COUNTS = "key bigint, doc_id bigint, bucket int, n bigint"

#: (key, bucket, n) of texts (key, cont, text); in a piece that goes on, features of its first word alone are counted already.
_SQL = """
with words as (
  select key, cont, unnest(w) as word, unnest(range(len(w))) as p from (
    select key, cont, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') as w from texts
  )
),
windowed as (select key, cont, p, word, {leads} from words window run as (partition by key, cont order by p)),
features as materialized ({runs}),
hashed as (select feature, (crc(feature) % {buckets})::int as bucket from (select distinct feature from features))
select key, bucket, count(*) as n from features join hashed using (feature) group by all
"""


def _features_sql(longest: int, buckets: int) -> str:
    leads = ", ".join(f"lead(word, {k}) over run as w{k}" for k in range(1, longest)) or "0 as w0"
    runs, text = [], "word"
    for k in range(longest):
        if k:
            text += f" || ' ' || w{k}"
        # runs that lie whole in the words that the piece before ended with have been counted there
        runs.append(f"select key, {text} as feature from windowed where p >= cont - {k}" + (f" and w{k} is not null" if k else ""))
    return _SQL.format(leads=leads, runs=" union all ".join(runs), buckets=buckets)


def _crc(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return pa.array(np.fromiter(map(zlib.crc32, column.cast(pa.binary()).to_pylist()), np.int64, len(column)))


def _connect():
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
    con.create_function("crc", _crc, ["VARCHAR"], "BIGINT", type="arrow")
    return con


def text_pieces(raw: bytes, overlap: int, most: int = BLOCK_BYTES):
    """(words that the piece before had too, piece): cut between words, each opening with the last ``overlap`` words before."""
    data = np.frombuffer(raw, np.uint8)
    begin = cont = end = 0
    while end + most < len(data):
        end += most
        while end < len(data):  # to the end of the word
            gap = np.flatnonzero(~_LETTERS[data[end : end + most]])
            end = min(len(data), end + (int(gap[0]) if len(gap) else most))
            if len(gap):
                break
        yield cont, raw[begin:end]
        back, starts = 4096, []
        while True:
            since = max(begin, end - back)
            starts, _ = T.word_spans(data[since:end], np.array([0, end - since]), _LETTERS)
            if since == begin or len(starts) > overlap:  # the first may be cut
                break
            back *= 4
        cont = min(overlap, len(starts))
        begin = since + int(starts[len(starts) - cont]) if cont else end
    yield cont, raw[begin:]


def _spill(docs: DataFrame, longest: int, buckets: int) -> DataFrame:
    """(key, doc_id, bucket, n): how many features a document has in a bucket; the row without a bucket has its words."""
    sql = _features_sql(longest, buckets)

    def counted(con, keys, conts, texts):
        con.register("texts", pa.table({"key": pa.array(keys, pa.int64()), "cont": pa.array(conts, pa.int64()), "text": pa.array(texts, pa.large_binary()).cast(pa.large_string())}))
        found = con.sql(sql).to_arrow_table()
        con.unregister("texts")
        none = pa.nulls(len(found), pa.int64())
        yield from pa.table([found["key"], none, found["bucket"].cast(pa.int32()), found["n"]], ["key", "doc_id", "bucket", "n"]).to_batches(1 << 16)

    def words_of(raw):
        return len(T.word_spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), _LETTERS)[0])

    def run(batches):
        con = _connect()
        try:
            for batch in batches:
                for lo, hi, data, at in T.blocks(batch.column(2), BLOCK_BYTES):
                    keys, ids = batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo)
                    raw = data.tobytes()
                    if len(raw) <= BLOCK_BYTES:
                        n = np.diff(T.counts_by_doc(T.word_spans(data, at, _LETTERS)[0], at))
                        yield from counted(con, keys, np.zeros(hi - lo, np.int64), [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())])
                    else:  # one text that is longer than a block
                        n = np.zeros(1, np.int64)
                        for cont, piece in text_pieces(raw, longest - 1):
                            n += words_of(piece) - cont
                            yield from counted(con, keys, [cont], [piece])
                    yield pa.RecordBatch.from_arrays([keys, ids.cast(pa.int64()), pa.nulls(hi - lo, pa.int32()), pa.array(n)], ["key", "doc_id", "bucket", "n"])
        finally:
            con.close()

    keyed = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return materialize(keyed.mapInArrow(run, _COUNTS), "features")


def bucket_counts(counts: DataFrame, name: str) -> DataFrame:
    return counts.where("bucket is not null").groupBy("bucket").agg(F.sum("n").alias(name))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of all buckets: floored thousandths of the logarithm of the smoothed ratio of the shares."""
    found = bucket_counts(corpus, "s").join(bucket_counts(target, "t"), "bucket", "full")
    known = {r.bucket: (r.s or 0, r.t or 0) for r in found.collect()}  # one row a bucket
    rows = [(b, *known.get(b, (0, 0))) for b in range(buckets)]
    s, t = (sum(r[k] for r in rows) for k in (1, 2))
    double = lambda c: c.cast("double")
    ratio = double(F.col("t") + 1) * double(F.lit(s + buckets)) / (double(F.col("s") + 1) * double(F.lit(t + buckets)))
    return corpus.sparkSession.createDataFrame(rows, "bucket int, s bigint, t bigint").select("bucket", F.floor(1000 * F.log(ratio)).cast("bigint").alias("gain"))


def gumbel(doc_id: Column, seed: int) -> Column:
    """Floored thousandths of a standard Gumbel draw by the hash of an id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def floored_mean(total: str, n: str) -> Column:
    """Exact integer floor(total / n); 0 where n is 0."""
    return F.expr(f"case when {n} = 0 then 0L else ({total} - pmod({total}, {n})) div {n} end")


def resample(
    docs: DataFrame, target: DataFrame, *, longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null where not drawn) for every row of ``docs`` (doc_id, text)."""
    corpus = _spill(docs, longest, buckets)
    aimed = _spill(target.select(F.lit(None).cast("bigint").alias("doc_id"), "text"), longest, buckets)
    gains = F.broadcast(bucket_gains(corpus, aimed, buckets))  # a row a bucket
    feature = F.col("bucket").isNotNull()
    summed = corpus.join(gains, "bucket", "left").groupBy("key").agg(
        F.max("doc_id").alias("doc_id"), F.coalesce(F.sum(F.when(~feature, F.col("n"))), F.lit(0)).alias("n_words"),
        F.coalesce(F.sum(F.when(feature, F.col("n"))), F.lit(0)).alias("n_features"), F.coalesce(F.sum(F.col("gain") * F.col("n")), F.lit(0)).alias("total"),
    )
    weight = floored_mean("total", "n_features")
    scored = summed.select("key", "doc_id", "n_words", "n_features", weight.alias("weight"), (weight + gumbel(F.col("doc_id"), seed)).alias("score"))
    scored = materialize(scored, "scored")
    able = scored.where(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("key").asc()]
    ranked = ordered_numbers(able, order, "rank", lambda df: materialize(df, "ordered")).where(F.col("rank") <= drawn)
    rest = scored.join(ranked.select("key"), "key", "left_anti").withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.unionByName(rest).select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


OP11_SQL = r"""
with recursive tbl as materialized (
  select list(c order by i) as l from (select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) as t(i))
),
texts as materialized (
  select kind, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w
  from (select 0 as kind, doc_id, coalesce(text, '') as text from documents union all select 1, item_id, coalesce(text, '') from benchmark)
),
grams as materialized (
  select kind, doc_id, unnest(w) as f from texts
  union all select kind, doc_id, w[i] || ' ' || w[i + 1] from (select kind, doc_id, w, unnest(range(1, len(w))) as i from texts)
),
hashed as materialized (
  select f, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(x), 2), lambda i: ('0x' || x[i + 1:i + 2])::bigint)), lambda c, b: xor(c >> 8, l[(xor(c, b) & 255) + 1])), 4294967295) % 10000 as bucket
  from (select f, hex(encode(f)) as x from (select distinct f from grams)), tbl
),
counted as materialized (select kind, doc_id, bucket, count(*) as n from grams join hashed using (f) group by all),
b as (select bucket, sum(n) filter (where kind = 0) as s, sum(n) filter (where kind = 1) as t from counted group by bucket),
totals as (select coalesce(sum(s), 0) as ss, coalesce(sum(t), 0) as tt from b),
g as (
  select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * (ss + 10000)::double / ((coalesce(s, 0) + 1)::double * (tt + 10000)::double)))::bigint as gain from b, totals
),
d as (select doc_id, sum(n)::bigint as n_features, sum(n * gain)::bigint as total from counted join g using (bucket) where kind = 0 group by doc_id),
s as (
  select t.doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features,
    case when n_features is null then 0 else (total - ((total % n_features) + n_features) % n_features) // n_features end as weight,
    floor(-1000 * ln(-ln((('0x' || sha256('7:' || t.doc_id)[1:8])::bigint + 0.5::double) / 4294967296::double)))::bigint as gumbel
  from texts t left join d using (doc_id) where kind = 0
),
r as (select doc_id, row_number() over (order by weight + gumbel desc, doc_id) as rank, count(*) over () as n from s where n_words >= 20)
select s.doc_id, s.n_features, s.weight::bigint as weight, (s.weight + s.gumbel)::bigint as score, r.rank
from s left join r on r.doc_id = s.doc_id and r.rank <= 25 * r.n // 100
"""
