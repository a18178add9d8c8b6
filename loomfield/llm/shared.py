"""Where jobs leave tables that later jobs read: the folder that the whole cluster shares."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset a local session, as in tests, gets a temporary folder, and
    any other raises: its executors would not see one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="loomfield-")
    return "file://" + _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/loomfield/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` wrote and that nothing reads any more."""
    for df in tables:
        delete(df.sparkSession, df.stored_at)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a table in the shared folder through Hadoop's file system, wherever that is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _holds_map(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _holds_map(kind.elementType)
    return isinstance(kind, MapType) or isinstance(kind, StructType) and any(_holds_map(f.dataType) for f in kind.fields)


def _entries(c: Column, kind: DataType, back: bool) -> Column:
    """A value with its maps as arrays of entries, which can be hashed, grouped and ordered, or ``back``."""
    if not _holds_map(kind):
        return c
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*(_entries(c.getField(f.name), f.dataType, back).alias(f.name) for f in kind.fields)))
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: _entries(x, kind.elementType, back))
    pair = lambda e: F.struct(e["key"].alias("key"), _entries(e["value"], kind.valueType, back).alias("value"))
    return F.map_from_entries(F.transform(c, pair)) if back else F.transform(F.map_entries(c), pair)


def without_maps(df: DataFrame) -> DataFrame:
    return df.select(*(_entries(df[f"`{f.name}`"], f.dataType, False).alias(f.name) for f in df.schema.fields)) if any(_holds_map(f.dataType) for f in df.schema.fields) else df


def with_maps(df: DataFrame, schema: StructType) -> DataFrame:
    """``df`` with the columns of ``schema`` that ``without_maps`` changed as they were."""
    kinds = {f.name: f.dataType for f in schema.fields if _holds_map(f.dataType)}
    return df.withColumns({c: _entries(F.col(f"`{c}`"), k, True) for c, k in kinds.items()}) if kinds else df


def text_digest(column: str) -> Column:
    """The first 16 bytes of the SHA-256 of a text; a null text is an empty one."""
    return F.unhex(F.substring(F.sha2(F.coalesce(F.col(column).cast("binary"), F.lit(b"")), 256), 1, 32))


def spread_join(many: DataFrame, one: DataFrame, key: str, counts: DataFrame, by: str) -> DataFrame:
    """``many`` joined to the one row a ``key`` of ``one``; ``counts`` (key, c) says how many rows of ``many`` a key has.

    Keys with more than one row in 4,096 are dealt over several tasks by ``by``, and their row of ``one`` is repeated for
    each; there are at most 4,096 such keys, with as many repeats, so what is broadcast does not grow with the data."""
    total = counts.agg(F.sum("c")).first()[0] or 0
    most = max(1000, total // 4096)
    heavy = [(r[0], -(-r[1] // most)) for r in counts.where(F.col("c") > most).select(key, "c").collect()]
    if not heavy:
        return many.join(one, key)
    few = F.broadcast(many.sparkSession.createDataFrame(heavy, f"{key} bigint, _parts bigint"))
    left = many.join(few, key, "left").withColumn("_part", F.pmod(F.xxhash64(by), F.coalesce("_parts", F.lit(1)))).drop("_parts")
    right = one.join(few, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return left.join(right, [key, "_part"]).drop("_part")


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int, narrow: bool = False):
    """Within it, jobs over wide rows hand Python at most so many rows at once; those over ``narrow`` ones so many."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(rows, int(before)) if int(before) > 0 and not narrow else rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)
