"""Two-pass external shuffle, in DataFrame operations only.

Pass one scatters rows uniformly into memory-sized buckets by a seeded hash. Pass two puts each bucket in a
fixed order, applies Spark's Fisher-Yates ``shuffle`` to it, and numbers its rows on from the rows of the
buckets before it. Row number p goes to shard p mod n at slot p div n, so that shards' row counts are at most
one apart (the law ``rows``) and every shard is a uniform draw, also where a third of all rows are equal.

The order follows from the seed and the rows alone: Spark's shuffle draws by seed and partition number, and a bucket's
partition and its place in it depend on the number of buckets, hence on the rows, not on settings or on how the input is cut.

Nulls are hashed and kept like any value, a null text has no bytes, no rows give no rows. Rows that are equal in
every column are counted first and scatter by their number, so none of them fills a bucket; copies of a text under
other ids scatter like any rows. Columns named ``shard`` or ``slot`` are replaced; all others stay, those of maps too.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomfield.operators.relational import free_names

from .shared import table, with_maps, without_maps

SHARDS = 8
SEED = 20_240_607
BUCKET_BYTES = 8 << 20
#: Partitions of buckets; beyond that a partition holds several buckets, one after the other, but not over so many bytes.
MOST_PARTITIONS, PARTITION_BYTES = 8192, 1 << 30
#: Offsets of buckets are broadcast up to this many rows of 16 bytes, and joined by a shuffle beyond.
MOST_BROADCAST = 200_000


def row_bytes(text_col: str = "text"):
    return F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1


def external_shuffle(df: DataFrame, *, shards: int = SHARDS, seed: int = SEED, size=None, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``df`` with shard (0 to shards - 1) and slot (gapless from 0 in each shard), in uniformly random order."""
    df = df.drop("shard", "slot")
    schema, names = df.schema, df.columns
    size = size if size is not None else F.lit(64)
    stats = df.agg(F.sum(size), F.count("*")).first()
    buckets = max(1, math.ceil((stats[0] or 0) / bucket_bytes), math.ceil(stats[1] / 50_000))
    h, n = free_names(df, "_h", "_n")
    hashed = without_maps(df).withColumn(h, F.xxhash64(F.lit(seed), *names)).withColumn(n, F.lit(1))
    if not hashed.groupBy(h).count().where("count > 1").isEmpty():
        hashed = hashed.groupBy(h, *names).agg(F.count("*").alias(n)).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))))
    bucket = F.pmod(F.xxhash64(h, n, F.lit(seed + 1)), F.lit(buckets))
    keyed = hashed.select(F.struct(*names).alias("_row"), bucket.alias("_bucket"), F.col(h).alias("_h"))
    dealt = keyed.repartition(min(buckets, max(MOST_PARTITIONS, math.ceil((stats[0] or 0) / PARTITION_BYTES))), "_bucket")
    gathered = dealt.groupBy("_bucket").agg(F.collect_list(F.struct("_h", "_row")).alias("_rows"))
    gathered = gathered.sortWithinPartitions("_bucket").select(
        "_bucket", F.shuffle(F.sort_array("_rows"), F.lit(seed)).alias("_rows")
    )
    sizes = keyed.groupBy("_bucket").count()
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    starts = F.broadcast(starts) if buckets <= MOST_BROADCAST else starts
    placed = gathered.join(starts, "_bucket").select("_start", F.posexplode("_rows").alias("_at", "_item"))
    position = F.col("_start") + F.col("_at")
    out = placed.select("_item._row.*", (position % shards).cast("int").alias("shard"), F.floor(position / shards).cast("long").alias("slot"))
    return with_maps(out, schema)


def write_shards(df: DataFrame, path: str, **how) -> None:
    """Write shuffled rows to one folder per shard, each in order of slots."""
    out = external_shuffle(df, **how)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op4_external_shuffle(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    out = external_shuffle(docs, size=row_bytes())
    return out.select(
        "doc_id",
        row_bytes().alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
