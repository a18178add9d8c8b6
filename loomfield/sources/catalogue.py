"""A catalogue of fitted models: versions in a shared folder, the newest loaded by name, other columns refused."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.sources.tables import check_columns


@dataclass
class Saved:
    kind: str
    version: str
    columns: list[str]
    parameters: dict

    def checked(self, df: DataFrame, *leave_out: str) -> DataFrame:
        """``df``, whose columns but for ``leave_out`` must be those that the model was fitted on, in their order."""
        check_columns(df.drop(*leave_out), self.columns)
        return df


class Catalogue:
    """Models under ``path``, one row each; reading needs nothing but Spark's own readers, wherever the folder is."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def save(self, kind: str, columns: list[str], parameters: dict, version: str | None = None) -> str:
        """Add a version, named by the time where no name is given; names sort by age. A version is never overwritten."""
        version = version or datetime.now(timezone.utc).strftime("%Y-%m-%d-%H-%M-%S-%f")
        row = self.spark.createDataFrame([(kind, version, columns, json.dumps(parameters))], "kind string, version string, columns array<string>, parameters string")
        row.coalesce(1).write.mode("error").parquet(f"{self.path}/{kind}/{version}")
        return version

    def versions(self, kind: str) -> list[str]:
        """Names of all versions of a kind, oldest first; none where the kind is not known."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        files = where.getFileSystem(conf)
        if not files.exists(where):
            return []
        done = lambda s: files.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
        return sorted(s.getPath().getName() for s in files.listStatus(where) if s.isDirectory() and done(s))

    def load(self, kind: str, version: str | None = None) -> Saved:
        """One version, by default the newest that is written whole."""
        if version is None:
            known = self.versions(kind)
            if not known:
                raise FileNotFoundError(f"no model of kind {kind} under {self.path}")
            version = known[-1]
        r = self.spark.read.parquet(f"{self.path}/{kind}/{version}").first()
        return Saved(kind, version, list(r.columns), json.loads(r.parameters))


def fit_scaler(df: DataFrame, columns: list[str]) -> dict:
    """Means and standard deviations (of the whole, not of a sample) by column; a constant column is divided by 1."""
    seen = df.agg(*(g(F.col(c).cast("double")).alias(f"{name}{k}") for k, c in enumerate(columns) for name, g in (("m", F.avg), ("s", F.stddev_pop)))).first()
    return {"mean": [seen[f"m{k}"] or 0.0 for k in range(len(columns))], "sd": [seen[f"s{k}"] or 1.0 for k in range(len(columns))]}


def scaled(df: DataFrame, model: Saved, *leave_out: str) -> DataFrame:
    """``df`` with the model's columns scaled; refused where the columns are others or stand in another order."""
    model.checked(df, *leave_out)
    p = model.parameters
    return df.withColumns({c: (F.col(c).cast("double") - m) / s for c, m, s in zip(model.columns, p["mean"], p["sd"])})
