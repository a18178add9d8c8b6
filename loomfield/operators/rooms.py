"""Players into teams: records shrunk toward a prior, rooms of the best few, credit shared among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shrunk(record: Column, n: Column, prior: Column, strength: float) -> Column:
    """The mean of a record over ``n`` events and a prior that counts for ``strength`` of them; either alone where the other is missing."""
    both = (record * n + prior * strength) / (n + strength)
    return F.when(record.isNull(), prior).when(prior.isNull(), record).otherwise(both)


def room(players: DataFrame, keys: list[str], order: list[Column], places: int | Column) -> DataFrame:
    """The first ``places`` rows of each group by ``order``, with their ``place``. Spark keeps the best of a partition before
    any row moves where ``places`` is a number, so a large group sends few rows."""
    ranked = players.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("place") <= places)


def room_rating(members: DataFrame, keys: list[str], value: str, places: int | Column, fill: float, *more: Column) -> DataFrame:
    """(keys, members, rating): the mean over all places of a room, those without a rated member at ``fill``. ``more``: further
    aggregates of the room, from the same pass."""
    there = F.count(value)
    size = F.lit(places) if isinstance(places, int) else F.max(places)
    return members.groupBy(*keys).agg(F.count("*").alias("members"), ((F.coalesce(F.sum(value), F.lit(0.0)) + (size - there) * F.lit(fill)) / size).alias("rating"), *more)


def shared_credit(members: DataFrame, keys: list[str], total: str, part: str, name: str = "credit") -> DataFrame:
    """``members`` with their share of the group's ``total`` in proportion to ``part``; alike where all parts are 0."""
    sums = members.groupBy(*keys).agg(F.sum(part).alias("_sum"), F.count("*").alias("_n"))
    x = members.join(sums, keys)
    return x.withColumn(name, F.when(F.col("_sum") > 0, F.col(total) * F.col(part) / F.col("_sum")).otherwise(F.col(total) / F.col("_n"))).drop("_sum", "_n")
