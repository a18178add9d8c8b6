"""Queries of the fitted models: boosted trees and their decomposition, likelihood fits, searches over moment matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomfield.operators import boosted, likelihood
from loomfield.operators import moments as M
from loomfield.sources.tables import read_table

QUERIES: dict = {}
SQL: dict = {}

#: Points of the event that comes next, by its place in the sorted list of types.
EVENT_POINTS = (7.0, 3.0, 2.0, -2.0, -3.0, -7.0)
REPLICATES = 200
FEATURES = ["balance", "cust", "month", "priority"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _orders(spark, d):
    """Orders with features of their customer and a margin to fit."""
    o = read_table(spark, d, "orders").join(read_table(spark, d, "customer").select("c_custkey", "c_acctbal"), F.expr("o_custkey = c_custkey"))
    return o.select(
        "o_orderkey", F.year("o_orderdate").alias("season"), (F.col("o_orderkey") % 5).cast("int").alias("fold"), (F.col("c_acctbal") / 1000).alias("balance"), ((F.col("o_custkey") % 97) / 10).alias("cust"),
        F.month("o_orderdate").cast("double").alias("month"), F.substring("o_orderpriority", 1, 1).cast("double").alias("priority"), (F.col("o_totalprice") / 10000 + F.col("c_acctbal") / 2000).alias("y"),
    )


_X = """x as (select o_orderkey, year(o_orderdate) as season, o_orderkey % 5 as fold, c_acctbal / 1000 as balance, (o_custkey % 97) / 10 as cust, cast(month(o_orderdate) as double) as month,
o_totalprice / 10000 + c_acctbal / 2000 as y from orders join customer on o_custkey = c_custkey)"""


def _margin_model(rows):
    return boosted.fit_boosted(rows, FEATURES, "y", rounds=5, depth=3, most_bins=32)


@query()
def boosted_margin(spark, d):
    """Margins of all orders by boosted trees."""
    rows = _orders(spark, d)
    return rows.select("o_orderkey", F.round(_margin_model(rows).prediction(), 6).alias("margin"))


@query()
def next_event_points(spark, d):
    """Expected points of every event: chances of the type of the user's next event by multiclass trees, times its points."""
    e = read_table(spark, d, "events")
    names = F.broadcast(e.select("event_type").distinct().select("event_type", (F.row_number().over(Window.orderBy("event_type")) - 1).alias("kind")))  # one row a type
    own = e.join(names, "event_type")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = own.select("event_id", "value", F.hour("ts").alias("hour"), "kind", F.get_json_object("props", "$.k").cast("double").alias("k"), F.lead("kind").over(w).alias("next"))
    classes = names.count()
    model = boosted.fit_boosted(x, ["value", "hour", "kind", "k"], "next", objective="softmax", classes=classes, rounds=2, depth=3, most_bins=32)
    points = [EVENT_POINTS[k % len(EVENT_POINTS)] for k in range(classes)]
    p = x.select("event_id", model.prediction().alias("p"))
    worth = sum((F.col("p")[k] * v for k, v in enumerate(points)), F.lit(0.0))
    return p.select("event_id", F.round(worth, 6).alias("expected_points"), F.array_position("p", F.array_max("p")).cast("int").alias("likeliest"))


@query()
def margin_decomposition(spark, d):
    """One row an order and variable: value, contribution, share of all contributions, and whether shares mean something."""
    rows = _orders(spark, d)
    model = _margin_model(rows)
    wide = boosted.decompose(rows, model, "m")
    parts = F.array(*(F.struct(F.lit(f).alias("variable"), F.col(f).alias("value"), F.col(f"m__{f}__contrib").alias("contrib"), F.col(f"m__{f}__weight").alias("weight")) for f in FEATURES))
    long = wide.select("o_orderkey", "m_base", "m_raw", "m_weights_reliable", F.explode(parts).alias("v"))
    r = lambda c: F.round(c, 6)
    return long.select("o_orderkey", "v.variable", r("v.value").alias("value"), r("v.contrib").alias("contrib"), r("v.weight").alias("weight"), r("m_base").alias("base"), r("m_raw").alias("raw"), F.col("m_weights_reliable").alias("reliable"))


@query()
def margin_override(spark, d):
    """Margins of the orders of each December before and after their customers' balance is set to 9."""
    rows = _orders(spark, d)
    out = boosted.what_if(rows, _margin_model(rows), {"balance": 9.0}, F.col("month") == 12)
    return out.select("o_orderkey", F.round("margin_before", 6).alias("before"), F.round("margin_after", 6).alias("after"), "moved")


@query()
def probit_ladder(spark, d):
    """Chances of every whole-number margin for spreads from -8 to 8 in halves, by ordered probit on all lines."""
    x = read_table(spark, d, "lineitem").select(F.round((F.col("l_extendedprice") - 38000) / 4000 * 2).alias("s"), F.greatest(F.lit(-12), F.least(F.lit(12), F.floor((F.col("l_quantity") - 25) / 2))).cast("double").alias("margin"))
    model = likelihood.fit_ordered_probit(x.select((F.greatest(F.lit(-16), F.least(F.lit(16), "s")) / 2).alias("spread"), "margin"), ["spread"], "margin")
    spreads = spark.range(-16, 17).select((F.col("id") / 2).alias("spread"))
    return model.ladder(spreads, ["spread"], "margin").select("spread", "margin", F.round("chance", 6).alias("chance"))


@query()
def role_by_stages(spark, d):
    """The role of every part: labelled brands keep theirs, others go by a fit on size and price, on size alone, or a default."""
    p = read_table(spark, d, "part")
    name = F.col("p_partkey") % 10
    x = p.select("p_partkey", F.when(name > 2, (F.col("p_retailprice") > 20 * F.col("p_size") + 700).cast("int")).alias("label"), F.when(name != 1, F.col("p_size")).alias("size"), F.when(name != 2, F.col("p_retailprice") / 100).alias("price"))
    out, _ = likelihood.label_in_stages(x, "label", [["size", "price"], ["size"]], F.col("p_partkey") % 5, least_rows=50)
    return out.select("p_partkey", "role", "role_source", F.round("chance", 6).alias("chance"))


_CV = f"""with {_X}, f as (select fold, cast(count(*) as double) as n, sum(balance) as a, sum(cust) as b, sum(y) as y, sum(balance * balance) as aa, sum(cust * cust) as bb, sum(balance * cust) as ab, sum(balance * y) as ay, sum(cust * y) as by_, sum(y * y) as yy from x group by fold),
t as (select sum(n) as n, sum(a) as a, sum(b) as b, sum(y) as y, sum(aa) as aa, sum(bb) as bb, sum(ab) as ab, sum(ay) as ay, sum(by_) as by_ from f),
r as (select f.*, t.n - f.n as rn, t.a - f.a as ra, t.b - f.b as rb, t.y - f.y as ry, t.aa - f.aa as raa, t.bb - f.bb as rbb, t.ab - f.ab as rab, t.ay - f.ay as ray, t.by_ - f.by_ as rby from f, t),
c as (select *, raa - ra * ra / rn + 10 as caa, rbb - rb * rb / rn + 10 as cbb, rab - ra * rb / rn as cab, ray - ra * ry / rn as cay, rby - rb * ry / rn as cby from r),
w as (select *, 'balance' as k, 1 as nf, cay / caa as wa, 0.0 as wb from c union all select *, 'cust', 1, 0.0, cby / cbb from c union all select *, 'both', 2, (cay * cbb - cby * cab) / (caa * cbb - cab * cab), (cby * caa - cay * cab) / (caa * cbb - cab * cab) from c),
i as (select *, (ry - wa * ra - wb * rb) / rn as w0 from w),
e as (select k, nf, 1 - (yy + w0 * w0 * n + wa * wa * aa + wb * wb * bb - 2 * w0 * y - 2 * wa * ay - 2 * wb * by_ + 2 * w0 * wa * a + 2 * w0 * wb * b + 2 * wa * wb * ab) / (yy - y * y / n) as r2 from i)
select k as features, cast(nf as integer) as n, round(avg(r2), 6) as r2 from e group by 1, 2"""


@query(_CV)
def ridge_cv_r2(spark, d):
    """Five-fold R2 of ridge regression for sets of features, all from the sums by fold."""
    sets = {"balance": ["balance"], "cust": ["cust"], "both": ["balance", "cust"]}
    rows = M.cross_validated_r2(_orders(spark, d), sets, "y", F.col("fold"), alpha=10.0)
    return spark.createDataFrame(rows, "features string, n int, r2 double").withColumn("r2", F.round("r2", 6))


_PARTS = ["balance", "cust", "month"]
_GRID = f"""with {_X}, g as (select a / 20 as p, b / 20 as q from range(0, 17) t(a), range(0, 13) u(b)), w as (select p, q, (1 - q) * (1 - p) as w0, (1 - q) * p as w1, q as w2 from g),
m as (select season % 2 as tier, count(*) as n, covar_pop(balance, balance) as s00, covar_pop(balance, cust) as s01, covar_pop(balance, month) as s02, covar_pop(cust, cust) as s11, covar_pop(cust, month) as s12, covar_pop(month, month) as s22,
covar_pop(balance, y) as c0, covar_pop(cust, y) as c1, covar_pop(month, y) as c2, covar_pop(y, y) as v from x group by 1),
r as (select p, q, avg(case when n >= 100 then (w0 * c0 + w1 * c1 + w2 * c2) / sqrt((w0 * w0 * s00 + w1 * w1 * s11 + w2 * w2 * s22 + 2 * w0 * w1 * s01 + 2 * w0 * w2 * s02 + 2 * w1 * w2 * s12) * v) end) as r, sum(n) as n from w, m group by 1, 2),
b as (select max(r) as best, arg_max(p, r) as bp, arg_max(q, r) as bq, max(n) as n from r), k as (select r.*, b.* exclude (n), 0.5 * (1 - best * best) / sqrt(r.n) as band from r, b)
select round(arg_min(p, (q, -r)), 6) as second, round(arg_min(q, (q, -r)), 6) as outside, round(arg_min(r, (q, -r)), 6) as r, round(any_value(best), 6) as best, round(any_value(bp), 6) as best_second, round(any_value(bq), 6) as best_outside, round(any_value(band), 6) as band from k where r >= best - band"""


@query(_GRID)
def blend_grid_choice(spark, d):
    """Shares of three parts by the correlation averaged over two tiers; of shares about as good as the best, those that lean
    least on the part from outside. One moment matrix a tier serves the whole grid."""
    grams = [M.matrix(r.moments, 3) for r in M.gram(_orders(spark, d).withColumn("tier", F.col("season") % 2), _PARTS, "y", ["tier"]).collect()]
    grid = [((a / 20, b / 20), np.array([(1 - b / 20) * (1 - a / 20), (1 - b / 20) * a / 20, b / 20])) for a in range(17) for b in range(13)]
    c = M.choose_blend(grams, grid, lambda p: p[1])
    row = (*c["point"], c["r"], c["best"], *c["best_point"], c["band"])
    names = ["second", "outside", "r", "best", "best_second", "best_outside", "band"]
    return spark.createDataFrame([tuple(round(float(v), 6) for v in row)], ", ".join(f"{n} double" for n in names))


_POISSON_CASE = " + ".join(f"(u >= {float(c)!r})::int" for c in M._POISSON)
_BOOT = f"""with v as (select o_orderkey as k, case when month(o_orderdate) <= 5 then 'early' else 'mid' end as part, cast(round(o_totalprice / 100) as double) as v from orders),
h0 as (select part, v, b, (k % 2147483647 * 48271 + b * 69621 + 11) % 2147483647 as x from v, range(0, {REPLICATES}) t(b)),
h1 as (select part, v, b, ((x * x + 1013904223) % 2147483647 * 16807 + b) % 2147483647 as x from h0), h2 as (select part, v, b, ((x * x + 12345) % 2147483647 * 16807 + b) % 2147483647 as x from h1), h3 as (select part, v, b, ((x * x + 1664525) % 2147483647 * 16807 + b) % 2147483647 as x from h2),
w as (select part, v, b, {_POISSON_CASE} as w from (select part, v, b, x / 2147483647 as u from h3)),
s as (select b, part, sqrt(sum(w * v * v) / sum(w) - (sum(w * v) / sum(w)) * (sum(w * v) / sum(w))) as sd from w group by 1, 2),
r as (select b, max(case when part = 'early' then sd end) / max(case when part = 'mid' then sd end) as r from s group by 1), q as (select quantile_cont(r, 0.025) as lo, quantile_cont(r, 0.975) as hi from r)
select round((select stddev_pop(v) filter (where part = 'early') / stddev_pop(v) filter (where part = 'mid') from v), 6) as ratio, round(lo, 6) as lo, round(hi, 6) as hi, lo > 1 or hi < 1 as apart from q"""


@query(_BOOT)
def bootstrap_spread_ratio(spark, d):
    """The ratio of two parts' standard deviations with its bootstrap interval, by Poisson weights hashed from the order."""
    o = read_table(spark, d, "orders")
    x = o.select("o_orderkey", F.when(F.month("o_orderdate") <= 5, "early").otherwise("mid").alias("part"), F.round(F.col("o_totalprice") / 100).alias("v"))
    out = M.bootstrap_sd_ratio(x, "o_orderkey", "part", "v", "early", "mid", replicates=REPLICATES)
    return out.select(*(F.round(c, 6).alias(c) for c in ("ratio", "lo", "hi")), "apart")


_CLIPPED = f"""with {_X}, g as (select season, count(*) as n, covar_pop(balance, balance) as aa, covar_pop(cust, cust) as bb, covar_pop(balance, cust) as ab, covar_pop(balance, y) as ay, covar_pop(cust, y) as by_, var_pop(y) as yy from x group by 1),
b as (select season, n, (ay * bb - by_ * ab) / (aa * bb - ab * ab) as wa, (by_ * aa - ay * ab) / (aa * bb - ab * ab) as wb, ay, by_, yy from g),
c as (select *, greatest(wa, 0) + greatest(wb, 0) as t from b)
select cast(season as integer) as season, n as rows, round(case when n < 100 or t <= 0 then 0.5 else greatest(wa, 0) / t end, 6) as w_balance, round(case when n < 100 or t <= 0 then 0.5 else greatest(wb, 0) / t end, 6) as w_cust, round(case when n >= 100 then (wa * ay + wb * by_) / yy end, 6) as r2 from c"""


@query(_CLIPPED)
def clipped_component_weights(spark, d):
    """Least squares weights of two parts for each season, negative ones set to 0, of sum 1."""
    out = M.clipped_weights(_orders(spark, d), ["balance", "cust"], "y", ["season"])
    return out.select("season", "rows", *(F.round(c, 6).alias(c) for c in ("w_balance", "w_cust", "r2")))


@query()
def search_with_incumbent(spark, d):
    """Candidates of a seeded search with their walk-forward error over the last seasons, and which of them ships."""
    k = len(_PARTS)
    grams = {r.season: M.matrix(r.moments, k) for r in M.gram(_orders(spark, d), _PARTS, "y", ["season"]).collect()}  # one row a season
    default, incumbent = {"alpha": 1.0, "half_life": None, "columns": [0, 1, 2]}, {"alpha": 100.0, "half_life": 4.0, "columns": [0, 1]}
    candidates = [default, *M.random_candidates(17, 20, k), incumbent]
    scored = M.walk_forward_errors(grams, candidates)
    chosen, why = M.keep_or_replace(scored, default, incumbent)
    rows = [(i, c["alpha"], c["half_life"], ",".join(_PARTS[j] for j in c["columns"]), round(e, 6), why if c is chosen else None) for i, (e, c) in enumerate(scored)]
    return spark.createDataFrame(rows, "candidate int, alpha double, half_life double, features string, error double, chosen string")
