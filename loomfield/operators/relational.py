"""Joins and groupings of the library: role-playing dimensions, as-of, nearest, fallback keys, ratios."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomfield.sources.tables import stored

#: Distinct values that one task may hold.
FEW = 1 << 16


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def prefixed(df: DataFrame, prefix: str, *keep: str) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def role_join(fact: DataFrame, dim: DataFrame, key: str, **roles: str) -> DataFrame:
    """Join one dimension once per role: role name -> key column of the fact."""
    for role, column in roles.items():
        own = prefixed(dim, f"{role}_")
        fact = fact.join(own, fact[column] == own[f"{role}_{key}"], "left").drop(f"{role}_{key}")
    return fact


def full_outer_fold(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, keys, "full"), frames)


def ratio_of_sums(df: DataFrame, keys: list[str], rates: dict[str, tuple[Column, Column]], digits: int = 6) -> DataFrame:
    """Per group sum(numerator) / sum(denominator), 0 where the denominator is 0."""
    return df.groupBy(*keys).agg(*[F.round(F.coalesce(F.try_divide(F.sum(a), F.sum(b)), F.lit(0.0)), digits).alias(k) for k, (a, b) in rates.items()])


def first_row(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row for each key, the first in a total order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def latest_before(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """As-of join: for each left row the values of the latest right row of its key at or before its time.

    Both sides pass one sort by key and time, so the cost is that of one shuffle, not of all pairs.
    """
    a = left.select("*", F.col(left_time).alias("_t"), F.lit(1).alias("_side"), *[F.lit(None).cast(right.schema[v].dataType).alias(f"_{v}") for v in values])
    b = right.select(F.col(key), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), *[F.col(v).alias(f"_{v}") for v in values])
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.select("*", *[F.last(F.when(F.col("_side") == 0, F.struct(F.col(f"_{v}").alias("v"))), ignorenulls=True).over(w)["v"].alias(v) for v in values])
    return filled.where("_side = 1").select(*left.columns, *values)


def nearest(df: DataFrame, value: str, grid: list[float], name: str) -> DataFrame:
    """The grid value closest to ``value``, of two the lower one; the grid is a short sorted list."""
    points = F.lit(sorted(grid))
    best = F.array_min(F.transform(points, lambda g: F.struct(F.abs(F.col(value) - g).alias("d"), g.alias("g"))))["g"]
    return df.withColumn(name, best)


def dense_grid(df: DataFrame, entity: str, period: str) -> DataFrame:
    """Every entity with every period from the first to the last one."""
    span = df.agg(F.min(period).alias("lo"), F.max(period).alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias(period))
    return df.select(entity).distinct().crossJoin(F.broadcast(span))


def join_null_safe(df: DataFrame, other: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on ``keys``, nulls equal to each other; the other side's keys go."""
    named = other.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(c for c in other.columns if c not in keys))
    on = reduce(lambda a, b: a & b, (df[k].eqNullSafe(named[f"_k_{k}"]) for k in keys))
    return df.join(named, on, how).drop(*(f"_k_{k}" for k in keys))


def with_moments(df: DataFrame, keys: list[str], value) -> DataFrame:
    """``df`` with _mean, _sd, _sdp and _n of ``value`` in its group: partial sums and a join, so that a few large groups need no one task."""
    g = df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd"), F.stddev_pop(value).alias("_sdp"), F.count("*").alias("_n"))
    return join_null_safe(df, g, keys)


def with_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``df`` with _rank, _mean_rank, _rank_desc and _n of ``value`` in its group: counts of distinct values, summed up over range
    partitions of (keys, value), so that no task holds a key's rows or values. Up to ``FEW`` of them all are summed by a window."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    if counts.limit(FEW + 1).count() <= FEW:
        summed = counts.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    else:
        summed = ordered_sums(counts, [F.col(c).asc() for c in (*keys, value)], "_c", "_upto", lambda x: stored(x, "ranks"))
    group = summed.groupBy(*keys).agg(F.min(F.col("_upto") - F.col("_c")).alias("_base"), F.sum("_c").alias("_n"))
    before = F.col("_upto") - F.col("_c") - F.col("_base")
    ranks = join_null_safe(summed, group, keys).select(*keys, value, (before + 1).alias("_rank"), (before + (F.col("_c") + 1) / 2).alias("_mean_rank"), (F.col("_n") - before - F.col("_c") + 1).alias("_rank_desc"), "_n")
    return join_null_safe(df, ranks, [*keys, value])


def with_positions(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """``df`` with _at, its place from 0 in its group by ``order``, and _n, the group's rows; by range partitions too."""
    summed = ordered_sums(df.withColumn("_one", F.lit(1).cast("bigint")), [*(F.col(c).asc() for c in keys), *order], "_one", "_upto", lambda x: stored(x, "places"))
    group = summed.groupBy(*keys).agg(F.min("_upto").alias("_first"), F.count("*").alias("_n"))
    return join_null_safe(summed, group, keys).withColumn("_at", F.col("_upto") - F.col("_first")).drop("_one", "_upto", "_first")


def ordered_sums(df: DataFrame, order: list, value: str, name: str, store) -> DataFrame:
    """``df`` with the sum of the whole numbers ``value`` of all rows up to its own in ``order``: within range partitions first, then
    the totals of those before are added. One total a partition passes the driver."""
    own, base = free_names(df, "_part", "_before")
    kept = store(df.repartitionByRange(*order).withColumn(own, F.spark_partition_id()))
    before, rows = 0, []
    for p, n in sorted((r[0], r[1]) for r in kept.groupBy(own).agg(F.sum(value)).collect()):
        rows.append((p, before))
        before += n
    offsets = F.broadcast(df.sparkSession.createDataFrame(rows, f"`{own}` int, `{base}` bigint"))
    upto = F.sum(value).over(Window.partitionBy(own).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return kept.withColumn(name, upto).join(offsets, own).withColumn(name, F.col(name) + F.col(base)).drop(own, base)


def ordered_numbers(df: DataFrame, order: list, name: str, store) -> DataFrame:
    """``df`` with 1, 2, 3... in ``order``: range partitions are sorted each by itself, and the sizes of those before are added.

    No task holds more than a partition. ``store`` writes a table where all executors read it back, so that ranges are cut
    once; one number a partition passes the driver. ``order`` should tell rows apart, for ties cannot be split."""
    at, own, base = free_names(df, "_at", "_part", "_before")
    sorted_parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = store(sorted_parts.withColumn(at, F.monotonically_increasing_id()))
    part, within = F.shiftright(at, 33), F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r[0], r[1]) for r in stored.groupBy(part.alias("part")).count().collect())
    before, rows = 0, []
    for p, n in sizes:
        rows.append((p, before))
        before += n
    offsets = F.broadcast(df.sparkSession.createDataFrame(rows, f"`{own}` bigint, `{base}` bigint"))
    return stored.withColumn(own, part).join(offsets, own).withColumn(name, F.col(base) + within + 1).drop(at, own, base)
