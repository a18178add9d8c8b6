"""Feature matrices as they stood at a point in time: many families of observations meet requests by one sort.

Observations and requests of an entity and season are put in order together, and each family's latest observation strictly
before a request is carried to it. A family may also reach back to earlier seasons, by one row a season. Groups are an
entity's season, whose length the schedule bounds, so an entity with a long history is spread over its seasons.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass
class Family:
    """Observations (entity, season, at, columns). ``gate``: withheld from requests earlier in the season than this.
    ``scope``: "season" (of the request's own), "before" (the latest of earlier seasons) or "both" (the own one's, else that)."""

    rows: DataFrame
    columns: list[str]
    gate: int | None = None
    scope: str = "season"


def point_in_time(requests: DataFrame, families: dict[str, Family], *, entity: str = "entity", season: str = "season", at: str = "at") -> DataFrame:
    """``requests`` with every family's columns as ``<family>_<column>``; null where nothing is known yet or it is withheld.

    Every request keeps its row, repeated ones too. Of several observations at one time the largest values win."""
    names = list(families)
    packed = lambda name: F.struct(*(F.col(c).alias(c) for c in families[name].columns))
    wide = requests.select(F.col(entity).alias("_e"), F.col(season).alias("_s"), F.col(at).alias("_t"), F.lit(0).alias("_k"), F.struct(*requests.columns).alias("_r"))
    seasons, orders = [], []
    for name in names:
        own = families[name].rows
        rows = own.select(F.col(entity).alias("_e"), F.col(season).alias("_s"), F.col(at).alias("_t"), packed(name).alias(f"_f_{name}"))
        if families[name].scope != "before":
            wide = wide.unionByName(rows.withColumn("_k", F.lit(1)), allowMissingColumns=True)
            orders.append(f"_f_{name}")
        if families[name].scope != "season":
            seasons.append((name, rows.groupBy("_e", "_s").agg(F.max(F.struct("_t", f"_f_{name}")).alias("_last")).select("_e", "_s", F.col(f"_last._f_{name}").alias(f"_b_{name}"))))
    w = Window.partitionBy("_e", "_s").orderBy("_t", "_k", *orders).rowsBetween(Window.unboundedPreceding, -1)
    known = wide.select("_e", "_s", "_t", "_k", "_r", *(F.last(c, True).over(w).alias(c) for c in orders)).where("_k = 0")
    if seasons:  # one row a season of an entity
        ends = requests.select(F.col(entity).alias("_e"), F.col(season).alias("_s")).distinct()
        for _, rows in seasons:
            ends = ends.join(rows, ["_e", "_s"], "full")
        back = Window.partitionBy("_e").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select("_e", "_s", *(F.last(f"_b_{name}", True).over(back).alias(f"_b_{name}") for name, _ in seasons))
        known = known.join(ends, ["_e", "_s"], "left")
    out = []
    for name in names:
        family = families[name]
        found = {"season": lambda n: F.col(f"_f_{n}"), "before": lambda n: F.col(f"_b_{n}"), "both": lambda n: F.coalesce(f"_f_{n}", f"_b_{n}")}[family.scope](name)
        late = F.lit(True) if family.gate is None else F.col("_t") >= family.gate
        out += [F.when(late, found[c]).alias(f"{name}_{c}") for c in family.columns]
    return known.select("_r.*", *out)


def two_sided(games: DataFrame, families: dict[str, Family], *, key: str, home: str = "home", away: str = "away", season: str = "season", at: str = "at", needed: list[str] | None = None) -> DataFrame:
    """One row a game with both teams' features as ``home_...`` and ``away_...``; games without a ``needed`` feature of either
    team go, as openers do that have no form yet. ``key`` tells games apart."""
    side = lambda s: games.select(key, F.col(s).alias("entity"), F.col(season).alias("season"), F.col(at).alias("at"), F.lit(s).alias("side"))
    x = point_in_time(side(home).unionByName(side(away)), families)
    names = [f"{n}_{c}" for n, f in families.items() for c in f.columns]
    pick = lambda s, label: [F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{label}_{c}") for c in names]
    out = x.groupBy(key).agg(*pick(home, "home"), *pick(away, "away"))
    return out.dropna(subset=[f"{label}_{c}" for label in ("home", "away") for c in (needed or [])]) if needed else out


def lagged_grid(rows: DataFrame, value: str, lags: int, *, entity: str = "entity", season: str = "season", ahead: int = 1) -> DataFrame:
    """(entity, season, lag1, ...): values of the seasons before, for every season from an entity's first to the table's last and
    ``ahead`` more, so that a missing season is a null lag and not a shift of the others."""
    last = rows.agg(F.max(season).alias("_last"))  # one row
    grid = rows.groupBy(entity).agg(F.min(season).alias("_first")).crossJoin(F.broadcast(last)).select(entity, F.explode(F.sequence("_first", F.col("_last") + ahead)).alias(season))
    dense = grid.join(rows.select(entity, season, value), [entity, season], "left")
    w = Window.partitionBy(entity).orderBy(season)
    return dense.select(entity, season, *(F.lag(value, k).over(w).alias(f"lag{k}") for k in range(1, lags + 1)))


def decayed(lags: list[str], weights: list[float]):
    """The weighted mean of the lags that are there; null where none is."""
    total = sum((F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in zip(lags, weights)), F.lit(0.0))
    return sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in zip(lags, weights)), F.lit(0.0)) / F.nullif(total, F.lit(0.0))
