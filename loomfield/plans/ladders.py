"""Queries on distributions, gaps, calibrations and shares, and the remaining joins and cleanings."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomfield.functions import scalars as S
from loomfield.operators import relational as R
from loomfield.operators.isotonic import isotonic
from loomfield.sources.tables import check_columns, numeric_columns, read_table, scratch_path, stored, write_csv_by

QUERIES: dict = {}
SQL: dict = {}

#: Weights of a class by its age in a rolling talent window, and the least sum of weights.
TALENT = {1: 0.9, 2: 1.0, 3: 1.0, 4: 0.7}
LEAST_TALENT = 2.0
#: Rows of lines that one task of a large join takes.
TASK_ROWS = 1 << 19


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query("""with h as (select l_linenumber as line, cast(l_quantity as integer) - 25 as m, count(*) as n from lineitem group by all), g as (select l.line, r.m from (select distinct line from h) l, (select unnest(range(-25, 26)) as m) r),
f as (select g.line, g.m, (coalesce(a.n, 0) + coalesce(b.n, 0)) / 2.0 as s from g left join h a on a.line = g.line and a.m = g.m left join h b on b.line = g.line and b.m = -g.m), p as (select line, m, s / sum(s) over (partition by line) as p from f),
c as (select *, sum(p) over (partition by line order by m) as cum from p)
select line, cast(m as integer) as m, round(p, 9) as p, round(cum - p, 9) as lose, round(1 - cum, 9) as win, round((1 - cum) / nullif(1 - p, 0), 9) as win_no_push, round(1 - cum + p / 2, 9) as half_point, cast(min(case when cum >= 0.5 - 1e-9 then m end) over (partition by line) as integer) as median from c""")
def symmetric_ladder(spark, d):
    """A margin's distribution by line: filled on a grid, made symmetric, normalised, and laddered with pushes and half points."""
    h = read_table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("line"), (F.col("l_quantity").cast("int") - 25).alias("m")).count()
    grid = h.select("line").distinct().withColumn("m", F.explode(F.sequence(F.lit(-25), F.lit(25))))
    both = h.unionByName(h.withColumn("m", -F.col("m"))).groupBy("line", "m").agg((F.sum("count") / 2).alias("s"))
    f = grid.join(both, ["line", "m"], "left").fillna(0.0, ["s"])  # at most 51 rows a line
    line = Window.partitionBy("line")
    p = f.withColumn("p", F.col("s") / F.sum("s").over(line)).withColumn("cum", F.sum("p").over(line.orderBy("m")))
    nine = lambda c: F.round(c, 9)
    cum, q = F.col("cum"), F.col("p")
    return p.select("line", "m", nine(q).alias("p"), nine(cum - q).alias("lose"), nine(1 - cum).alias("win"), nine((1 - cum) / F.nullif(1 - q, F.lit(0.0))).alias("win_no_push"), nine(1 - cum + q / 2).alias("half_point"), F.min(F.when(cum >= 0.5 - 1e-9, F.col("m"))).over(line).alias("median"))


@query("""with v as (select user_id, cast(ts as date) as day, sum(value) as v from events group by all), s as (select user_id, min(day) as a, max(day) as b from v group by user_id), g as (select user_id, cast(unnest(generate_series(a, b, interval 1 day)) as date) as day from s), x as (select g.user_id, g.day, v.v from g left join v using (user_id, day)),
k as (select *, last_value(case when v is not null then day end ignore nulls) over (partition by user_id order by day) as d0, first_value(case when v is not null then day end ignore nulls) over (partition by user_id order by day rows between current row and unbounded following) as d1, last_value(v ignore nulls) over (partition by user_id order by day) as v0, first_value(v ignore nulls) over (partition by user_id order by day rows between current row and unbounded following) as v1 from x)
select user_id, cast(day as varchar) as day, round(case when d0 = d1 then v0 else v0 + (v1 - v0) * date_diff('day', d0, day) / date_diff('day', d0, d1) end, 6) as filled, case when v is null and (lag(v) over w is not null or lead(v) over w is not null) then round((coalesce(lag(v) over w, lead(v) over w) + coalesce(lead(v) over w, lag(v) over w)) / 2, 6) end as near from k window w as (partition by user_id order by day)""")
def interpolate_gaps(spark, d):
    """Days without a value take the line between their neighbours, and the mean of the days next to them."""
    v = read_table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    days = v.groupBy("user_id").agg(F.sequence(F.min("day"), F.max("day")).alias("s")).select("user_id", F.explode("s").alias("day"))
    w = Window.partitionBy("user_id").orderBy("day")
    back, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("v").isNotNull(), F.struct("day", "v"))
    x = days.join(v, ["user_id", "day"], "left").withColumn("p", F.last(known, ignorenulls=True).over(back)).withColumn("n", F.first(known, ignorenulls=True).over(on))
    line = F.col("p.v") + (F.col("n.v") - F.col("p.v")) * F.datediff("day", "p.day") / F.datediff("n.day", "p.day")
    one, two = F.lag("v").over(w), F.lead("v").over(w)
    near = F.when(F.col("v").isNull() & (one.isNotNull() | two.isNotNull()), F.round((F.coalesce(one, two) + F.coalesce(two, one)) / 2, 6))
    return x.select("user_id", F.col("day").cast("string").alias("day"), F.round(F.when(F.col("p.day") == F.col("n.day"), F.col("p.v")).otherwise(line), 6).alias("filled"), near.alias("near"))


@query("""with f as (select *, case when value < 30 then 1 else 0 end as zero from events), i as (select *, sum(1 - zero) over (partition by user_id order by event_id) as island from f), r as (select *, sum(zero) over (partition by user_id, island order by event_id) as run from i), k as (select user_id, island, first(value order by event_id) as v0, count(*) as n from i group by all), nx as (select *, lead(v0) over (partition by user_id order by island) as v1 from k)
select event_id, cast(run as bigint) as run, round(v0 + (coalesce(v1, v0) - v0) * (row_number() over (partition by r.user_id, r.island order by event_id) - 1) / n, 6) as ramp, round(max(least(value, 60)) over (partition by r.user_id order by event_id), 6) as never_falling from r join nx on nx.user_id = r.user_id and nx.island = r.island""")
def runs_ramps_and_repairs(spark, d):
    """Counters that start anew after a non-zero, plateaus turned into ramps to the next one, a value that must not fall."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    x = read_table(spark, d, "events").withColumn("zero", F.when(F.col("value") < 30, 1).otherwise(0)).withColumn("island", F.sum(1 - F.col("zero")).over(upto))
    k = x.groupBy("user_id", "island").agg(F.min_by("value", "event_id").alias("v0"), F.count("*").alias("n"))
    k = k.withColumn("v1", F.coalesce(F.lead("v0").over(Window.partitionBy("user_id").orderBy("island")), "v0"))
    run = Window.partitionBy("user_id", "island").orderBy("event_id")
    j = x.join(k, ["user_id", "island"])
    ramp = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.row_number().over(run) - 1) / F.col("n")
    return j.select("event_id", F.sum("zero").over(run.rowsBetween(Window.unboundedPreceding, 0)).alias("run"), F.round(ramp, 6).alias("ramp"), F.round(F.max(F.least("value", F.lit(60.0))).over(upto), 6).alias("never_falling"))


@query("""with c as (select user_id, event_id, value, (rank() over (partition by user_id order by value) + (count(*) over (partition by user_id, value) - 1) / 2.0 - 1) / nullif(count(*) over (partition by user_id) - 1, 0) as pct from events where event_type = 'click'), v as (select user_id, list_sort(list(value)) as target from events where event_type = 'view' group by user_id),
j as (select event_id, target, coalesce(pct, 0.5) * (len(target) - 1) as h from c join v using (user_id)) select event_id, round(target[cast(floor(h) as bigint) + 1] + (target[least(cast(floor(h) as bigint) + 2, len(target))] - target[cast(floor(h) as bigint) + 1]) * (h - floor(h)), 6) as mapped from j""")
def quantile_mapping(spark, d):
    """A value's average-rank share among a user's clicks, read off as a quantile of the same user's views."""
    e = read_table(spark, d, "events").select("user_id", "event_id", "value", "event_type")
    c = R.with_ranks(e.where("event_type = 'click'"), ["user_id"], "value")
    c = c.select("user_id", "event_id", F.coalesce((F.col("_mean_rank") - 1) / F.nullif(F.col("_n") - 1, F.lit(0)), F.lit(0.5)).alias("pct"))
    v = R.with_positions(e.where("event_type = 'view'"), ["user_id"], [F.col("value").asc(), F.col("event_id").asc()])
    j = c.join(v.groupBy("user_id").agg((F.max("_n") - 1).alias("top")), "user_id").withColumn("h", F.col("pct") * F.col("top")).withColumn("k", F.floor("h"))
    # a click meets the two views about its quantile by place, never all of its user's
    side = lambda name: v.select("user_id", F.col("_at").alias(name), F.col("value").alias(f"{name}_value"))
    j = j.withColumn("low", F.col("k")).withColumn("high", F.least(F.col("k") + 1, F.col("top"))).join(side("low"), ["user_id", "low"]).join(side("high"), ["user_id", "high"])
    return j.select("event_id", F.round(F.col("low_value") + (F.col("high_value") - F.col("low_value")) * (F.col("h") - F.col("k")), 6).alias("mapped"))


@query("""with b as (select cast(l_quantity as integer) as q, avg(case when l_returnflag = 'R' then 1.0 else 0.0 end) as y, count(*) as w from lineitem group by 1), r as (select a.q as lo, c.q as hi, sum(b.y * b.w) / sum(b.w) as m from b a join b c on a.q <= c.q join b on b.q between a.q and c.q group by all),
f as (select lo, q, min(m) as m from r join b on r.hi >= b.q where r.lo <= b.q group by all) select q, round(least(greatest(max(m), 0.01), 0.99), 9) as calibrated from f group by q""")
def isotonic_calibration(spark, d):
    """Weighted isotonic regression of a rate on fifty bins, clipped."""
    b = read_table(spark, d, "lineitem").groupBy(F.col("l_quantity").cast("int").alias("q")).agg(F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("y"), F.count("*").alias("w"))  # fifty rows
    return isotonic(b, "q", "y", "w").select("q", F.round(S.clip("fit", 0.01, 0.99), 9).alias("calibrated"))


@query("""with x as (select year(o_orderdate) as season, o_totalprice / 1000 as y, o_custkey % 200 as p, o_orderkey % 5 = 0 as neutral from orders), s as (select season, avg(y - p) as resid, stddev_samp(y - p) as sigma, dense_rank() over (order by season desc) as back from x group by season)
select round(avg(resid) filter (where back <= 2), 6) as drift, round(avg(sigma), 6) as sigma, (select case when count(*) < 40 then -3.0 else round(least(greatest((avg(y - p) - 3) / 2, -6), 0), 6) end from x where neutral) as neutral_shift from s""")
def drift_and_neutral_shift(spark, d):
    """The last two seasons' mean residual, the spread, and half the neutral games' shift, held to a range."""
    x = read_table(spark, d, "orders").select(F.year("o_orderdate").alias("season"), (F.col("o_totalprice") / 1000 - F.col("o_custkey") % 200).alias("r"), (F.col("o_orderkey") % 5 == 0).alias("neutral"))
    s = x.groupBy("season").agg(F.avg("r").alias("resid"), F.stddev_samp("r").alias("sigma")).withColumn("back", F.dense_rank().over(Window.orderBy(F.desc("season"))))  # a row a season
    shift = x.where("neutral").agg(F.when(F.count("*") < 40, -3.0).otherwise(F.round(S.clip((F.avg("r") - 3) / 2, -6.0, 0.0), 6)).alias("neutral_shift"))
    return s.agg(F.round(F.avg(F.when(F.col("back") <= 2, F.col("resid"))), 6).alias("drift"), F.round(F.avg("sigma"), 6).alias("sigma")).crossJoin(shift)  # one row each


@query("""with x as (select p_brand as g, case when p_size > 25 then 1 else 0 end as big, p_retailprice as y from part) select g, round(avg(case when big = 1 then y end) - avg(case when big = 0 then y end), 6) as difference,
round(sqrt(var_samp(case when big = 1 then y end) / sum(big) + var_samp(case when big = 0 then y end) / sum(1 - big)), 6) as se from x group by g having sum(big) >= 2 and sum(1 - big) >= 2""")
def mean_difference_by_group(spark, d):
    """Difference of two means with its standard error."""
    x = read_table(spark, d, "part").select(F.col("p_brand").alias("g"), (F.col("p_size") > 25).alias("big"), F.col("p_retailprice").alias("y"))
    y = lambda big: F.when(F.col("big") if big else ~F.col("big"), F.col("y"))
    a, b = y(True), y(False)
    out = x.groupBy("g").agg(F.round(F.avg(a) - F.avg(b), 6).alias("difference"), F.round(F.sqrt(F.var_samp(a) / F.count(a) + F.var_samp(b) / F.count(b)), 6).alias("se"), F.least(F.count(a), F.count(b)).alias("n"))
    return out.where("n >= 2").drop("n")


@query("""with x as (select p_size - 25.0 as a, p_retailprice / 1000 as b, p_partkey % 17 + p_size * 0.3 as y from part), m as (select count(*) as n, covar_samp(a, a) as saa, covar_samp(b, b) as sbb, covar_samp(a, b) as sab, covar_samp(a, y) as say, covar_samp(b, y) as sby, covar_samp(y, y) as syy from x), s as (select *, saa * sbb - sab * sab as det from m),
c as (select *, (say * sbb - sby * sab) / det as ba, (sby * saa - say * sab) / det as bb from s), e as (select *, (syy - ba * say - bb * sby) * (n - 1) / (n - 3) / (n - 1) as v from c)
select round(ba, 6) as slope_a, round(bb, 6) as slope_b, round(ba / sqrt(v * sbb / det), 6) as t_a, round(bb / sqrt(v * saa / det), 6) as t_b, round(-v * sab / det, 9) as covariance from e""")
def ols_covariance(spark, d):
    """Two slopes with their covariance and t statistics, from one pass of moments."""
    x = read_table(spark, d, "part").selectExpr("p_size - 25.0D as a", "p_retailprice / 1000 as b", "p_partkey % 17 + p_size * 0.3D as y")
    m = x.agg(F.count("*").alias("n"), *(F.covar_samp(p, q).alias(f"s{p}{q}") for p, q in ("aa", "bb", "ab", "ay", "by", "yy")))
    s = m.withColumn("det", F.expr("saa * sbb - sab * sab")).withColumn("ba", F.expr("(say * sbb - sby * sab) / det")).withColumn("bb", F.expr("(sby * saa - say * sab) / det"))
    e = s.withColumn("v", F.expr("(syy - ba * say - bb * sby) / (n - 3)"))
    six = lambda c, n: F.round(F.expr(c), 6).alias(n)
    return e.select(six("ba", "slope_a"), six("bb", "slope_b"), six("ba / sqrt(v * sbb / det)", "t_a"), six("bb / sqrt(v * saa / det)", "t_b"), F.round(F.expr("-v * sab / det"), 9).alias("covariance"))


@query("""with g as (select l_orderkey, l_suppkey, min(l_linenumber) as pos, sum(l_quantity) as q, max(l_discount) as top from lineitem group by all), h as (select *, pos = min(pos) over (partition by l_orderkey) as home from g), t as (select l_orderkey, sum(q) as total from g group by 1)
select l_suppkey, round(avg(case when home then q end), 6) as home_offense, round(avg(case when not home then q end), 6) as away_offense, round(avg(case when home then total - q end), 6) as home_defense, round(avg(case when not home then total - q end), 6) as away_defense, round(case when max(top) <= 1 then avg(top) else sum(top) end, 6) as by_rule from h join t using (l_orderkey) group by l_suppkey""")
def home_away_summaries(spark, d):
    """Each side's own and the other side's totals, at home and away; a column without a rate's name is a mean up to 1, else a sum."""
    g = read_table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("pos"), F.sum("l_quantity").alias("q"), F.max("l_discount").alias("top"))
    order = Window.partitionBy("l_orderkey")
    h = g.withColumn("home", F.col("pos") == F.min("pos").over(order)).withColumn("against", F.sum("q").over(order) - F.col("q"))
    mean = lambda c, side, n: F.round(F.avg(F.when(F.col("home") if side else ~F.col("home"), F.col(c))), 6).alias(n)
    return h.groupBy("l_suppkey").agg(mean("q", 1, "home_offense"), mean("q", 0, "away_offense"), mean("against", 1, "home_defense"), mean("against", 0, "away_defense"), F.round(F.when(F.max("top") <= 1, F.avg("top")).otherwise(F.sum("top")), 6).alias("by_rule"))


@query("""with x as (select o_custkey, case when o_orderkey % 2 = 0 then 'a' else 'b' end as half, o_totalprice / 1000 as v from orders), g as (select o_custkey, avg(case when half = 'a' then v end) as ma, avg(case when half = 'b' then v end) as mb, count(case when half = 'a' then 1 end) as na, count(case when half = 'b' then 1 end) as nb, avg(v) as m, var_samp(v) / count(*) as noise from x group by 1)
select round(var_samp(m), 6) as observed, round(avg(noise), 6) as expected_noise, round(greatest(var_samp(m) - avg(noise), 0), 6) as signal, round(corr(ma, mb), 6) as split_half, count(*) as groups from g where na >= 5 and nb >= 5""")
def variance_split(spark, d):
    """Observed variance of group means less what chance explains, and the correlation of two halves."""
    x = read_table(spark, d, "orders").select("o_custkey", (F.col("o_orderkey") % 2 == 0).alias("a"), (F.col("o_totalprice") / 1000).alias("v"))
    va, vb = F.when(F.col("a"), F.col("v")), F.when(~F.col("a"), F.col("v"))
    g = x.groupBy("o_custkey").agg(F.avg(va).alias("ma"), F.avg(vb).alias("mb"), F.count(va).alias("na"), F.count(vb).alias("nb"), F.avg("v").alias("m"), (F.var_samp("v") / F.count("*")).alias("noise")).where("na >= 5 and nb >= 5")
    return g.agg(F.round(F.var_samp("m"), 6).alias("observed"), F.round(F.avg("noise"), 6).alias("expected_noise"), F.round(F.greatest(F.var_samp("m") - F.avg("noise"), F.lit(0.0)), 6).alias("signal"), F.round(F.corr("ma", "mb"), 6).alias("split_half"), F.count("*").alias("groups"))


@query("""with s as (select l_suppkey, p_type, sum(l_quantity) as q, sum(case when l_returnflag = 'N' then l_quantity else 0 end) as kept from lineitem join part on p_partkey = l_partkey group by all), t as (select p_type, median(q) as med from s group by p_type), x as (select *, case when q >= med then 'top' else 'rest' end as tier from s join t using (p_type))
select l_suppkey, round(sum(case when tier = 'top' then kept end) / nullif(sum(case when tier = 'top' then q end), 0), 6) as top_share, round(sum(case when tier = 'rest' then kept end) / nullif(sum(case when tier = 'rest' then q end), 0), 6) as rest_share, round(sum(kept) / sum(q), 6) as share,
round(sum(case when p_type = 'SMALL' then kept end) / nullif(sum(case when p_type = 'SMALL' then q end), 0), 6) as small_share from x group by l_suppkey""")
def returning_shares_by_tier(spark, d):
    """What of each team's volume returns, for groups above and below the median of their kind, as one wide row."""
    s = read_table(spark, d, "lineitem").join(read_table(spark, d, "part"), F.expr("p_partkey = l_partkey")).groupBy("l_suppkey", "p_type").agg(F.sum("l_quantity").alias("q"), F.sum(F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).otherwise(0.0)).alias("kept"))
    t = s.groupBy("p_type").agg(F.median("q").alias("med"))
    x = s.join(F.broadcast(t), "p_type").withColumn("top", F.col("q") >= F.col("med"))  # a row for each kind
    share = lambda c, n: F.round(F.sum(F.when(c, F.col("kept"))) / F.nullif(F.sum(F.when(c, F.col("q"))), F.lit(0.0)), 6).alias(n)
    return x.groupBy("l_suppkey").agg(share(F.col("top"), "top_share"), share(~F.col("top"), "rest_share"), share(F.lit(True), "share"), share(F.col("p_type") == "SMALL", "small_share"))


@query("""with g as (select o_custkey, year(o_orderdate) as y, avg(o_totalprice) as v from orders group by all), k as (select * from (values (1, 0.9), (2, 1.0), (3, 1.0), (4, 0.7)) t(age, w)), s as (select a.o_custkey, a.y, sum(b.v * w) / sum(w) as talent, sum(w) as sw from g a join g b on a.o_custkey = b.o_custkey join k on a.y - b.y = k.age - 1 group by all)
select o_custkey, cast(y as integer) as y, round(talent, 6) as talent, rank() over (partition by y order by round(talent, 6) desc) as place from s where sw >= 2""")
def talent_window(spark, d):
    """Four classes, each weighing by its age, where the weights add up to enough; ranked within the season."""
    price, exact = F.col("o_totalprice"), F.col("o_totalprice").try_cast("decimal(20,8)")
    o = read_table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("y"), price, F.when(exact.cast("double") == price, exact).alias("exact"))
    total = F.when(F.count("exact") == F.count("o_totalprice"), F.sum("exact")).try_cast("decimal(22,8)")
    g = o.groupBy("o_custkey", "y").agg(F.avg("o_totalprice").alias("v"), F.try_divide(total, F.count("o_totalprice").cast("decimal(10,0)")).alias("e"))
    parts = F.explode(F.array(*(F.struct(F.lit(age - 1).alias("on"), F.lit(w).cast("decimal(2,1)").alias("w")) for age, w in TALENT.items())))
    spread = g.select("o_custkey", "y", "v", "e", parts.alias("k")).select("o_custkey", (F.col("y") + F.col("k.on")).alias("y"), F.col("k.w").alias("w"), (F.col("v") * F.col("k.w").cast("double")).alias("vw"), (F.col("e") * F.col("k.w")).alias("ew"))
    # in decimals, where prices have them, halves of the last digit do not hang on the order of sums; they go up
    last = F.round(F.round(F.try_divide(F.sum("ew"), F.sum("w")), 12), 6).cast("double")
    talent = F.coalesce(F.when(F.count("ew") == F.count("vw"), last), F.round(F.sum("vw") / F.sum("w").cast("double"), 6))
    s = spread.groupBy("o_custkey", "y").agg(talent.alias("talent"), F.sum("w").alias("sw")).where(F.col("sw") >= LEAST_TALENT)
    s = stored(s.join(g.select("o_custkey", "y"), ["o_custkey", "y"]).select("o_custkey", "y", "talent"), "talent")  # ranked and met by the same numbers
    return R.with_ranks(s, ["y"], "talent").select("o_custkey", "y", "talent", F.col("_rank_desc").alias("place"))


@query("""select o_orderkey, case when y > m then 1 when y < m then 0 end as covered, round(avg(case when y > m then 1 when y < m then 0 end) over (partition by o_orderpriority), 6) as rate, round(avg(case when abs(y - m) >= 20 then case when y > m then 1 when y < m then 0 end end) over (partition by o_orderpriority), 6) as large_rate,
round(coalesce(case when w is null then a when a is null then b else w * a + (1 - w) * b end, 0), 6) as blended from (select *, cast(floor(o_totalprice / 1000) as integer) % 60 as y, cast(o_custkey % 60 as integer) as m, case when o_custkey % 4 > 0 then (o_custkey % 4) / 4.0 end as w, nullif(o_orderkey % 7, 0) as a, nullif(o_orderkey % 5, 0) as b from orders)""")
def grading_with_pushes_and_blends(spark, d):
    """Covers graded with pushes left out, overall and for large edges; blends that fall back where a part is missing."""
    x = read_table(spark, d, "orders").selectExpr("o_orderkey", "o_orderpriority", "cast(floor(o_totalprice / 1000) as int) % 60 as y", "cast(o_custkey % 60 as int) as m", "case when o_custkey % 4 > 0 then (o_custkey % 4) / 4 end as w", "nullif(o_orderkey % 7, 0) as a", "nullif(o_orderkey % 5, 0) as b")
    cover = F.when(F.col("y") > F.col("m"), 1).when(F.col("y") < F.col("m"), 0)
    x = x.withColumn("covered", cover).withColumn("large", F.when(F.abs(F.col("y") - F.col("m")) >= 20, F.col("covered")))
    rates = x.groupBy("o_orderpriority").agg(F.round(F.avg("covered"), 6).alias("rate"), F.round(F.avg("large"), 6).alias("large_rate"))
    w, a, b = (F.col(c) for c in "wab")
    blended = F.when(w.isNull(), a).when(a.isNull(), b).otherwise(w * a + (1 - w) * b)
    return x.join(F.broadcast(rates), "o_orderpriority").select("o_orderkey", "covered", "rate", "large_rate", F.round(F.coalesce(blended, F.lit(0)), 6).alias("blended"))


@query("""with c as (select c_custkey, c_nationkey, nullif(cast(floor(c_acctbal) as integer) % 5, 0) as score, case c_mktsegment when 'HOUSEHOLD' then '0' when 'MACHINERY' then '1..5' when 'FURNITURE' then 'NL' else '2' end as raw from customer), m as (select median(score) as med from c), f as (select c_custkey, c_nationkey, coalesce(score, med) as score, cast(case raw when '1..5' then '1.5' else raw end as double) as line from c, m where raw <> 'NL'),
b as (select c_nationkey, round(avg(score), 6) as base from f group by 1), p as (select s_nationkey as c_nationkey, round(avg(s_acctbal), 6) as preferred from supplier where s_acctbal > 3000 group by 1)
select coalesce(b.c_nationkey, p.c_nationkey) as nation, coalesce(p.preferred, b.base) as value, n_name from b full join p on b.c_nationkey = p.c_nationkey right join nation on n_nationkey = coalesce(b.c_nationkey, p.c_nationkey) where exists (select 1 from orders where o_orderstatus = 'F')""")
def cleaned_override_dimension(spark, d):
    """Literals mended, nulls filled by the median, a dimension of two sources whose preferred one wins, every nation kept."""
    seg = F.col("c_mktsegment")
    raw = F.when(seg == "HOUSEHOLD", "0").when(seg == "MACHINERY", "1..5").when(seg == "FURNITURE", "NL").otherwise("2")
    c = read_table(spark, d, "customer").select("c_custkey", "c_nationkey", F.nullif(F.floor("c_acctbal").cast("int") % 5, F.lit(0)).alias("score"), raw.alias("raw"))
    m = c.agg(F.median("score").alias("med"))  # one row
    f = c.where("raw <> 'NL'").replace({"1..5": "1.5"}, subset=["raw"]).crossJoin(F.broadcast(m)).select("c_nationkey", F.coalesce("score", "med").alias("score"), F.col("raw").try_cast("double").alias("line")).na.drop(subset=["line"])
    check_columns(f, ["c_nationkey", "score", "line"])
    b = f.groupBy(F.col("c_nationkey").alias("nation")).agg(*(F.round(F.avg(c), 6).alias("base") for c in numeric_columns(f, "c_nationkey", "line")))
    p = read_table(spark, d, "supplier").where("s_acctbal > 3000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.round(F.avg("s_acctbal"), 6).alias("preferred"))
    dim = b.join(p, "nation", "full").select("nation", F.coalesce("preferred", "base").alias("value"))
    final = read_table(spark, d, "orders").where("o_orderstatus = 'F'").limit(1).select(F.lit(1).alias("one"))
    return dim.join(read_table(spark, d, "nation").select("n_nationkey", "n_name"), F.expr("nation = n_nationkey"), "right").join(final, F.lit(True), "left_semi").select("nation", "value", "n_name")


@query("""with l as (select cast(l_quantity as integer) as spread, count(*) as n, round(avg(l_discount), 6) as odds, l_linenumber as rung from lineitem group by all), g as (select o_orderkey, cast(1 + o_orderkey % 50 as integer) as spread, year(o_orderdate) as season from orders where o_orderstatus <> 'P')
select o_orderkey, g.spread, rung, odds, n from g join l using (spread)""")
def odds_ladder_rows(spark, d):
    """Each game with every rung of its spread's ladder; pending games are left out unless asked for."""
    return ladder_rows(spark, d, with_pending=False)


@query("""with l as (select cast(l_quantity as integer) as spread, count(*) as n, round(avg(l_discount), 6) as odds, l_linenumber as rung from lineitem group by all), g as (select o_orderkey as game, cast(1 + o_orderkey % 50 as integer) as spread from orders where cast(o_orderdate as date) = (select max(cast(o_orderdate as date)) from orders))
select game, spread, rung, odds, n from g join l using (spread)""")
def ladder_files_of_the_day(spark, d):
    """The coming day's games, which is what a run predicts, each with a folder of its own that holds its ladder; read back from there."""
    o = read_table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    coming = o.join(F.broadcast(o.agg(F.max("day").alias("day"))), "day").select("o_orderkey")  # one row
    x = ladder_rows(spark, d, with_pending=True).join(coming, "o_orderkey").withColumnRenamed("o_orderkey", "game")
    path = scratch_path(spark, "ladders")
    write_csv_by(x, path, "game")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in x.schema.fields if f.name != "game") + ", game bigint"
    return spark.read.option("header", True).schema(schema).csv(path)


def ladder_rows(spark, d, with_pending: bool):
    ladder = read_table(spark, d, "lineitem").groupBy(F.col("l_quantity").cast("int").alias("spread"), F.col("l_linenumber").alias("rung")).agg(F.count("*").alias("n"), F.round(F.avg("l_discount"), 6).alias("odds"))
    games = read_table(spark, d, "orders").select("o_orderkey", "o_orderstatus", (1 + F.col("o_orderkey") % 50).cast("int").alias("spread"))
    games = games if with_pending else games.where("o_orderstatus <> 'P'")
    return games.join(ladder, "spread").select("o_orderkey", "spread", "rung", "odds", "n")


@query("""with v as (select s_suppkey, (s_nationkey * 2.5) - 30 as lat, (s_suppkey % 60) - 100.0 as lon, s_acctbal / 10 as elevation from supplier), n as (select o_custkey, l_suppkey, count(*) as n from orders join lineitem on l_orderkey = o_orderkey group by all), h as (select o_custkey as team, l_suppkey as venue from n qualify row_number() over (partition by o_custkey order by n desc, l_suppkey) = 1),
g as (select distinct o_orderkey, o_custkey, l_suppkey from orders join lineitem on l_orderkey = o_orderkey)
select o_orderkey, l_suppkey as venue, h.venue as home_venue, round(a.elevation - b.elevation, 4) as climb, round(2 * 3958.8 * asin(sqrt(power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2))), 4) as miles from g join h on h.team = o_custkey join v a on a.s_suppkey = l_suppkey join v b on b.s_suppkey = h.venue""")
def venue_travel(spark, d):
    """A team's home is its most frequent venue; miles and metres of climb to each game's."""
    v = read_table(spark, d, "supplier").select("s_suppkey", (F.col("s_nationkey") * 2.5 - 30).alias("lat"), ((F.col("s_suppkey") % 60) - 100.0).alias("lon"), (F.col("s_acctbal") / 10).alias("elevation"))
    o, l = read_table(spark, d, "orders").select("o_orderkey", "o_custkey"), read_table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")  # noqa: E741
    n = 1 + l.count() // TASK_ROWS  # as many tasks as the rows need, so that what one sorts and counts does not grow with them
    games = o.repartition(n, "o_orderkey").groupBy("o_orderkey", "o_custkey").agg(F.count("*").alias("orders"))
    by_order = lambda x: x.repartition(n, "l_orderkey").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("lines"))
    # a line of no venue may decide a home but is no journey; apart from the others, whose shuffle so serves the homes and the journeys
    lines, blank = by_order(l.where("l_suppkey is not null")), by_order(l.where("l_suppkey is null"))
    visits = lambda x: games.join(x, F.expr("l_orderkey = o_orderkey")).select("o_custkey", "l_suppkey", F.expr("orders * lines").alias("n"))
    often = visits(lines).union(visits(blank)).repartition(n, "o_custkey", "l_suppkey").groupBy("o_custkey", "l_suppkey").agg(F.sum("n").alias("n"))
    h = often.groupBy("o_custkey").agg(F.min(F.struct(-F.col("n"), "l_suppkey"))["l_suppkey"].alias("home_venue"))
    # homes go to the orders, which are fewer than their lines
    homes = games.join(h.hint("shuffle_hash"), "o_custkey").select("o_orderkey", "home_venue").repartition(n, "o_orderkey")
    side = lambda s, key: v.select(F.col("s_suppkey").alias(key), *(F.col(c).alias(f"{c}_{s}") for c in ("lat", "lon", "elevation")))
    g = homes.join(lines, F.expr("l_orderkey = o_orderkey")).join(side("a", "l_suppkey"), "l_suppkey").join(side("b", "home_venue"), "home_venue")
    return g.select("o_orderkey", F.col("l_suppkey").alias("venue"), "home_venue", F.round(F.col("elevation_a") - F.col("elevation_b"), 4).alias("climb"), F.round(S.haversine_miles(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")), 4).alias("miles"))
