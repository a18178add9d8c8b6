"""Opponent adjustment by ridge regression, on sums that Spark aggregates.

A rating model has an unpenalised intercept, an effect of each entity and one of each opponent, both penalised by
``alpha``. Entities may be as many as the data has; their block of the normal equations is diagonal, so each is solved
for in terms of the rest and eliminated in Spark, and only the opponents' small system of each group meets in a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.operators.relational import join_null_safe
from loomfield.sources.tables import stored

INTERCEPT = "__intercept__"
#: What keeps the system of margins regular where levels or the edge are not told apart.
UNPENALISED = 1e-9


def solve_opponents(system: pd.DataFrame, alpha: float) -> pd.DataFrame:
    """Effects by name from rows (j, k, a, b): an entry of the symmetric matrix, and of the right side where j = k."""
    names = pd.Index(sorted(system["j"].unique()))
    i, k = names.get_indexer(system["j"]), names.get_indexer(system["k"])
    a, b = np.zeros((len(names), len(names))), np.zeros(len(names))
    np.add.at(a, (i, k), system["a"].to_numpy(float))
    np.add.at(b, i, system["b"].to_numpy(float))
    penalty = np.where(names == INTERCEPT, 0.0, alpha)
    return pd.DataFrame({"j": names, "effect": np.linalg.solve(a + np.diag(penalty), b)})


def ridge_ratings(
    cells: DataFrame, group: str, alpha: float = 1.0, *, least_cells: int = 10, least_entities: int = 4, least_spread: float = 1e-3, least_own: int = 1, least_r2: float | None = None, members: DataFrame | None = None
) -> DataFrame:
    """(group, entity, rating) from cells (group, entity, opponent, mean, weight): intercept, effect and mean opponent.

    Groups of fewer cells or entities, or of means with less spread, carry no rating; cells without a weight or mean count for nothing.
    ``members`` (group, opponent) are the only opponents that count, entities of fewer than ``least_own`` cells are fitted but not
    rated, and a group whose fit explains less than ``least_r2`` of the weighted variance is left out.
    """
    if members is not None:
        cells = cells.join(members.select(group, "opponent").distinct(), [group, "opponent"], "left_semi")
    cells = stored(cells.where("weight > 0 and mean is not null").withColumn("opponent", F.col("opponent").cast("string")), "cells")
    fit = cells.groupBy(group).agg(F.count("*").alias("n"), F.count_distinct("entity").alias("e"), F.stddev_samp("mean").alias("s"))
    fit = fit.where((F.col("n") >= least_cells) & (F.col("e") >= least_entities) & (F.col("s") >= least_spread)).select(group)
    cells = cells.join(fit, group).select(group, "entity", F.col("opponent").alias("j"), F.col("weight").alias("w"), (F.col("weight") * F.col("mean")).alias("wy"))
    # one row for each entity and column of the opponents' system, the intercept's among them
    own = cells.groupBy(group, "entity").agg(F.sum("w").alias("w"), F.sum("wy").alias("wy"))
    rows = cells.unionByName(own.withColumn("j", F.lit(INTERCEPT)))
    total = own.select(group, "entity", (F.col("w") + alpha).alias("d"), F.col("wy").alias("all"))
    rows = left = stored(rows.join(total, [group, "entity"]), "rows")
    total = rows.where(F.col("j") == INTERCEPT).select(group, "entity", "d", "all")
    right = rows.select(group, "entity", F.col("j").alias("k"), F.col("w").alias("v"))
    # what eliminating the entities takes off, opponents by opponents
    off = left.join(right, [group, "entity"]).groupBy(group, "j", "k").agg((-F.sum(F.col("w") * F.col("v") / F.col("d"))).alias("a"))
    side = left.groupBy(group, "j").agg(F.sum(F.col("wy") - F.col("w") * F.col("all") / F.col("d")).alias("b"), F.sum("w").alias("w"))
    diagonal = side.select(group, "j", F.col("j").alias("k"), F.col("w").alias("a"), "b")
    borders = side.where(F.col("j") != INTERCEPT).select(group, F.explode(F.array(F.struct(F.col("j"), F.lit(INTERCEPT).alias("k")), F.struct(F.lit(INTERCEPT).alias("j"), F.col("j").alias("k")))).alias("x"), F.col("w").alias("a"))
    system = diagonal.unionByName(borders.select(group, "x.*", "a", F.lit(0.0).alias("b"))).unionByName(off.withColumn("b", F.lit(0.0)))
    kind = dict(cells.dtypes)[group]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return solve_opponents(pdf, alpha).assign(**{group: key[0]})[[group, "j", "effect"]]

    effects = stored(system.groupBy(group).applyInPandas(run, f"{group} {kind}, j string, effect double"), "effects")
    base = effects.groupBy(group).agg(F.sum(F.when(F.col("j") == INTERCEPT, F.col("effect"))).alias("intercept"), F.avg(F.when(F.col("j") != INTERCEPT, F.col("effect"))).alias("mean"))
    gone = rows.join(effects, [group, "j"]).groupBy(group, "entity").agg(F.sum(F.col("w") * F.col("effect")).alias("gone"))
    out = total.join(gone, [group, "entity"]).join(base, group).withColumn("own", (F.col("all") - F.col("gone")) / F.col("d"))
    if least_r2 is not None:
        # the sum of squared residuals of a cell needs its mean again: wy / w
        x = rows.where(F.col("j") != INTERCEPT).join(effects, [group, "j"]).join(out.select(group, "entity", "intercept", "own"), [group, "entity"])
        y, gap = F.col("wy") / F.col("w"), F.col("wy") / F.col("w") - F.col("intercept") - F.col("own") - F.col("effect")
        spread = F.sum(F.col("w") * y * y) - F.sum("wy") * F.sum("wy") / F.sum("w")
        good = x.groupBy(group).agg((1 - F.sum(F.col("w") * gap * gap) / spread).alias("r2")).where(F.col("r2") >= least_r2)
        out = out.join(good.select(group), group, "left_semi")
    if least_own > 1:
        enough = rows.where(F.col("j") != INTERCEPT).groupBy(group, "entity").agg(F.count("*").alias("n")).where(F.col("n") >= least_own)
        out = out.join(enough.select(group, "entity"), [group, "entity"], "left_semi")
    return out.select(group, "entity", (F.col("intercept") + F.col("mean") + F.col("own")).alias("rating"))


def ridge_rates(cells: DataFrame, group: str, rates: list[str], alpha: float = 1.0, **how) -> DataFrame:
    """(group, entity, rating_<rate>...) from cells with a mean ``<rate>`` and a weight ``<rate>_n`` for each rate, each weighed by
    its own denominator; all rates are fitted in one run, a null where one is not rated."""
    parts = F.explode(F.array(*(F.struct(F.lit(r).alias("rate"), F.col(r).cast("double").alias("mean"), F.col(f"{r}_n").cast("double").alias("weight")) for r in rates)))
    long = cells.select(group, "entity", "opponent", parts.alias("p")).select(group, "entity", "opponent", "p.*").withColumn("_both", F.concat_ws("|", F.col(group).cast("string"), "rate"))
    if how.get("members") is not None:
        how["members"] = how["members"].crossJoin(F.broadcast(long.select("rate").distinct())).withColumn("_both", F.concat_ws("|", F.col(group).cast("string"), "rate"))
    found = ridge_ratings(long, "_both", alpha, **how)
    kind = dict(cells.dtypes)[group]
    found = found.select(F.regexp_extract("_both", "^(.*)[|]", 1).cast(kind).alias(group), F.regexp_extract("_both", "[|]([^|]*)$", 1).alias("rate"), "entity", "rating")
    return found.groupBy(group, "entity").agg(*(F.max(F.when(F.col("rate") == r, F.col("rating"))).alias(f"rating_{r}") for r in rates))


def solve_margins(pdf: pd.DataFrame, alpha: float) -> pd.DataFrame:
    """(team, rating, edge) of one group from sums (home, away, home_level, away_level, n, s), by its normal equations as one matrix."""
    teams = pd.concat((pdf[["home", "home_level"]].set_axis(["team", "level"], axis=1), pdf[["away", "away_level"]].set_axis(["team", "level"], axis=1))).groupby("team")["level"].min()
    levels = pd.Index(sorted(teams.unique()))
    n, m = len(teams), len(levels)
    level = levels.get_indexer(teams.to_numpy())
    home, away = (teams.index.get_indexer(pdf[side]) for side in ("home", "away"))
    # a game's row: both teams, the home edge in the place of the first level, which is the base, and the other levels
    entries = [(home, 1.0), (away, -1.0), (np.full(len(pdf), n), 1.0), (n + level[home], np.where(level[home] > 0, 1.0, 0.0)), (n + level[away], np.where(level[away] > 0, -1.0, 0.0))]
    count, total = pdf["n"].to_numpy(float), pdf["s"].to_numpy(float)
    a, b = np.zeros((n + m, n + m)), np.zeros(n + m)
    for i, x in entries:
        np.add.at(b, i, x * total)
        for k, y in entries:
            np.add.at(a, (i, k), x * y * count)
    b = np.linalg.solve(a + np.diag(np.concatenate((np.full(n, alpha), np.full(m, UNPENALISED)))), b)
    step = np.concatenate(([0.0], b[n + 1 :]))
    return pd.DataFrame({"team": teams.index, "rating": b[:n] + step[level], "edge": b[n]})


def margin_ratings(games: DataFrame, group: str, alpha: float = 25.0, *, most_teams: int = 1024) -> DataFrame:
    """(group, team, rating, edge) from games (group, home, away, home_level, away_level, margin): a team's level and the edge
    of the home side are unpenalised, what a team is above its level is penalised. Games collapse to sums by pair of teams.

    A group of up to ``most_teams`` is solved as one matrix in a task, one of more by ``iterated_margins`` over all tasks."""
    kind = dict(games.dtypes)
    cells = games.groupBy(group, "home", "away", "home_level", "away_level").agg(F.count("margin").alias("n"), F.sum("margin").cast("double").alias("s")).where("n > 0")
    cells = stored(cells, "pairs")
    both = cells.select(group, F.explode(F.array("home", "away")).alias("team")).distinct()
    large = both.groupBy(group).count().where(F.col("count") > most_teams).select(group).collect()  # fewer than a row for each thousand teams
    named = cells.sparkSession.createDataFrame([(r[0], k) for k, r in enumerate(large)], f"`{group}` {kind[group]}, _g int")
    split = join_null_safe(cells, F.broadcast(named), [group])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return solve_margins(pdf, alpha).assign(**{group: key[0]})[[group, "team", "rating", "edge"]]

    out = split.where("_g is null").drop("_g").groupBy(group).applyInPandas(run, f"`{group}` {kind[group]}, team {kind['home']}, rating double, edge double")
    if not large:
        return out
    found = iterated_margins(split.where("_g is not null").drop(group), alpha)
    return out.unionByName(found.join(F.broadcast(named), "_g").select(group, "team", "rating", "edge"))


def iterated_margins(cells: DataFrame, alpha: float, tolerance: float = 1e-12, most_steps: int = 2000) -> DataFrame:
    """(_g, team, rating, edge) from sums (_g, home, away, home_level, away_level, n, s), for groups of any number of teams.

    The edge and the levels, a few numbers, are eliminated; the teams' system, which the penalty keeps positive, is solved by
    conjugate gradients scaled by its diagonal (Chronopoulos and Gear's form: one round of sums a step). A step sends each team's
    number to all it met, by a join and a sum; a few sums of each group pass the driver. It ends where every group's scaled residual
    is ``tolerance`` of its first one, and raises where ``most_steps`` do not get there."""
    home, away = (cells.select("_g", F.col(s).alias("team"), F.col(f"{s}_level").alias("level")) for s in ("home", "away"))
    teams = stored(home.unionByName(away).groupBy("_g", "team").agg(F.min("level").alias("level")), "teams")
    levels = sorted(r[0] for r in teams.select("level").distinct().collect())  # divisions: a few
    own = lambda s: teams.select("_g", F.col("team").alias(s), F.col("level").alias(f"{s}_own"))
    pairs = cells.select("_g", "home", "away", "n", "s").join(own("home"), ["_g", "home"]).join(own("away"), ["_g", "away"])
    view = lambda a, b, x: F.struct(F.col(a).alias("team"), F.col(b).alias("other"), F.col(f"{a}_own").alias("level"), F.col(f"{b}_own").alias("other_level"), F.col("n").cast("double").alias("n"), (x * F.col("n")).alias("edge"), (x * F.col("s")).alias("s"))
    links = stored(pairs.select("_g", F.explode(F.array(view("home", "away", 1.0), view("away", "home", -1.0))).alias("x")).select("_g", "x.*"), "links")

    # the eliminated block: the edge and the levels, of every game once
    m, small, right, present = 1 + len(levels), {}, {}, {}
    for r in links.where("edge > 0").groupBy("_g", "level", "other_level").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
        g, at = r["_g"], np.array([1.0] + [float(r["level"] == v) - float(r["other_level"] == v) for v in levels])
        small[g] = small.get(g, 0.0) + r["n"] * np.outer(at, at)
        right[g] = right.get(g, 0.0) + r["s"] * at
        present.setdefault(g, set()).update((1 + levels.index(r["level"]), 1 + levels.index(r["other_level"])))

    def solve_small(g: int, b: np.ndarray) -> np.ndarray:
        out, free = np.zeros(m), [0, *sorted(present[g])[1:]]  # a group's first level is its base
        out[free] = np.linalg.solve(small[g][np.ix_(free, free)] + UNPENALISED * np.eye(len(free)), b[free])
        return out

    def with_numbers(df: DataFrame, numbers: dict, names: list[str]) -> DataFrame:
        rows = [(g, *(float(x) for x in v)) for g, v in numbers.items()]
        return df.join(F.broadcast(df.sparkSession.createDataFrame(rows, ", ".join(["_g int", *(f"{c} double" for c in names)]))), "_g")

    border, held = [f"_b{i}" for i in range(m)], [f"_v{i}" for i in range(m)]
    dot = lambda names, of: sum((F.col(a) * F.col(b) for a, b in zip(names, of)), F.lit(0.0))
    met = F.col("team") != F.col("other")
    is_level = lambda c, v: F.when(F.col(c) == v, F.col("n")).otherwise(0.0)
    nodes = links.groupBy("_g", "team").agg(
        F.min("level").alias("level"), (F.sum(F.when(met, F.col("n")).otherwise(0.0)) + alpha).alias("d"), F.sum("s").alias("r"), F.sum("edge").alias("_b0"), *(F.sum(is_level("level", v) - is_level("other_level", v)).alias(b) for b, v in zip(border[1:], levels))
    )
    sends = links.where(met).groupBy("_g", "team", "other").agg(F.sum("n").alias("n")).groupBy("_g", "team", F.pmod(F.hash("other"), F.lit(8)).alias("part")).agg(F.collect_list(F.struct("other", "n")).alias("to"))
    sends = stored(sends.drop("part"), "sends")
    zero = F.lit(0.0)
    start = with_numbers(nodes, {g: solve_small(g, b) for g, b in right.items()}, held)
    state = stored(start.select("_g", "team", "level", "d", *border, (F.col("r") - dot(border, held)).alias("r"), zero.alias("x"), zero.alias("p"), zero.alias("q")), "start")
    first, last = {}, {}
    for _ in range(most_steps):
        u = F.col("r") / F.col("d")
        got = sends.join(state.select("_g", "team", u.alias("u")), ["_g", "team"]).select("_g", "u", F.explode("to").alias("to")).groupBy("_g", F.col("to.other").alias("team")).agg(F.sum(F.col("to.n") * F.col("u")).alias("got"))
        now = stored(state.join(got, ["_g", "team"], "left").withColumn("a", F.col("r") - F.coalesce("got", zero)).drop("got"), "step")
        numbers, going = {}, False
        for row in now.groupBy("_g").agg(F.sum(F.col("r") * u), F.sum(u * F.col("a")), *(F.sum(F.col(b) * u) for b in border)).collect():
            g, gamma, delta, t = row[0], row[1], row[2], np.array(row[3:])
            v = solve_small(g, t)
            if gamma <= tolerance**2 * first.setdefault(g, gamma):
                numbers[g] = (0.0, 0.0, *v)
                continue
            going, beta = True, gamma / last[g][0] if g in last else 0.0
            move = gamma / (delta - t @ v - (beta * gamma / last[g][1] if g in last else 0.0))
            last[g], numbers[g] = (gamma, move), (move, beta, *v)
        if not going:
            break
        p, q = u + F.col("_beta") * F.col("p"), F.col("a") - dot(border, held) + F.col("_beta") * F.col("q")
        moved = with_numbers(now, numbers, ["_move", "_beta", *held]).withColumns({"p": p, "q": q})
        state = moved.select("_g", "team", "level", "d", *border, (F.col("r") - F.col("_move") * F.col("q")).alias("r"), (F.col("x") + F.col("_move") * F.col("p")).alias("x"), "p", "q")
    else:
        raise RuntimeError(f"margin ratings: no solution after {most_steps} steps")
    sums = now.groupBy("_g").agg(*(F.sum(F.col(b) * F.col("x")) for b in border)).collect()
    out = with_numbers(now, {row[0]: solve_small(row[0], right[row[0]] - np.array(row[1:])) for row in sums}, held)
    step = sum((F.when(F.col("level") == v, F.col(h)).otherwise(0.0) for h, v in zip(held[1:], levels)), zero)
    return out.select("_g", "team", (F.col("x") + step).alias("rating"), F.col("_v0").alias("edge"))
