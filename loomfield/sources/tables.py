"""Reading tables and nested records: declared columns, safe paths, outer explodes, guarded writes."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_optional(df: DataFrame, name: str, default) -> DataFrame:
    """``df`` with a column of this name, ``default`` where the input has none."""
    return df if name in df.columns else df.withColumn(name, F.lit(default))


def union_files(*frames: DataFrame) -> DataFrame:
    """All rows by column name; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def json_path(column: str, path: str, kind: str, default=None) -> Column:
    """A typed value at a JSON path, ``default`` where it is missing or of another kind."""
    got = F.get_json_object(column, path).try_cast(kind)
    return got if default is None else F.coalesce(got, F.lit(default).cast(kind))


def json_rows(df: DataFrame, column: str, schema: str, outer: bool = True) -> DataFrame:
    """One row for each element of a JSON array; an empty array keeps its row when ``outer``."""
    explode = F.explode_outer if outer else F.explode
    return df.withColumn("item", explode(F.from_json(column, schema)))


def write_guarded(df: DataFrame, path: str, least_rows: int) -> int:
    """Overwrite ``path`` only if there are enough rows, so that a truncated result replaces nothing."""
    n = df.count()
    if n < least_rows:
        raise ValueError(f"{n} rows; at least {least_rows} are expected")
    df.write.mode("overwrite").parquet(path)
    return n


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)


def flatten_struct(df: DataFrame, column: str) -> DataFrame:
    """The fields of a struct as columns of their own, named after it."""
    fields = df.schema[column].dataType.names
    return df.select(*(c for c in df.columns if c != column), *(F.col(f"{column}.{f}").alias(f"{column}_{f}") for f in fields))


_OWN: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder under the checkpoint folder, which the whole cluster shares. Where none is named a local session, as in
    tests, gets a temporary one, and any other raises: executors would not see it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _OWN.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="loomfield-")
        _OWN[spark.sparkContext.applicationId] = base
    return f"{base.rstrip('/')}/loomfield/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later jobs start from the table, on whatever executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_csv_by(df: DataFrame, path: str, by: str) -> None:
    """One folder of CSV files with headers for each value of ``by``."""
    df.repartition(by).write.option("header", True).partitionBy(by).csv(path)


def read_csv_seasons(spark: SparkSession, path: str, name: str = "season", schema: str | None = None) -> DataFrame:
    """All season files under ``path`` as one table, the season from each file's own path; without a ``schema`` the types are
    inferred, which reads every file twice."""
    reader = spark.read.option("header", True).option("recursiveFileLookup", True)
    files = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    return files.withColumn(name, F.regexp_extract(F.input_file_name(), rf"{name}=(\d+)", 1).cast("int"))


def check_columns(df: DataFrame, expected: list[str]) -> None:
    """Raise where columns are missing, surplus or in another order than a model was trained on."""
    missing, more = [c for c in expected if c not in df.columns], [c for c in df.columns if c not in expected]
    if missing or more or df.columns != expected:
        raise ValueError(f"missing {missing}, surplus {more}" if missing or more else "columns are in another order")


def numeric_columns(df: DataFrame, *leave_out: str) -> list[str]:
    return [f.name for f in df.schema.fields if f.name not in leave_out and f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")]


def fetch_pages(requests: DataFrame, get, *, tries: int = 4, wait: float = 1.0, most_pages: int = 1000, pause=None) -> DataFrame:
    """(request, page, body, error) for every row of ``requests`` (request): ``get(request, page)`` returns (body, whether more
    pages follow) and runs where the row is. A failed call is tried again after ``wait``, twice that, and so on; after
    ``tries`` the row says why, and its later pages are not asked for. Fetched rows should be written before they are used, since a
    lost task asks again."""

    def run(batches):
        import time

        for frame in batches:
            out = []
            for request in frame["request"]:
                page, more = 1, True
                while more and page <= most_pages:
                    for attempt in range(tries):
                        try:
                            body, more = get(request, page)
                            out.append((request, page, body, None))
                            break
                        except Exception as error:  # what a caller's fetcher raises is not known here; it is kept in the row
                            if attempt + 1 == tries:
                                out.append((request, page, None, f"{type(error).__name__}: {error}"))
                                more = False
                            else:
                                (pause or time.sleep)(wait * 2**attempt)
                    page += 1
            yield pd.DataFrame(out, columns=["request", "page", "body", "error"])

    return requests.select("request").mapInPandas(run, "request string, page int, body string, error string")
