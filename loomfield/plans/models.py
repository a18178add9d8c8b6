"""Queries of the statistical part: adjustment, regression, blends, distributions, calibration, features."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomfield.operators import relational as R
from loomfield.operators.moments import nonnegative_blend
from loomfield.operators.ridge import margin_ratings, ridge_rates, ridge_ratings
from loomfield.sources.tables import read_table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _cells(spark, d, weight="1.0D", **keys):
    x = read_table(spark, d, "lineitem").join(read_table(spark, d, "part").select("p_partkey", "p_brand"), F.expr("l_partkey = p_partkey"))
    x = x.select(F.year("l_shipdate").alias("season"), F.col("l_suppkey").alias("entity"), F.col("p_brand").alias("opponent"), "l_discount", F.expr(weight).alias("w"), *[F.expr(e).alias(k) for k, e in keys.items()])
    return x.groupBy("season", *keys, "entity", "opponent").agg((F.sum(F.col("l_discount") * F.col("w")) / F.sum("w")).alias("mean"), F.sum("w").alias("weight"))


@query()
def ridge_opponent_adjust(spark, d):
    return ridge_ratings(_cells(spark, d), "season")


@query()
def ridge_weighted(spark, d):
    return ridge_ratings(_cells(spark, d, weight="l_quantity"), "season", alpha=25.0)


@query()
def ridge_asof(spark, d):
    """Ratings before each quarter of a season from its earlier quarters alone."""
    cells = _cells(spark, d, q="quarter(l_shipdate)")
    later = cells.withColumn("before", F.explode(F.sequence(F.col("q") + 1, F.lit(5)))).withColumn("group", F.col("season") * 10 + F.col("before"))
    x = later.groupBy("group", "entity", "opponent").agg((F.sum(F.expr("mean * weight")) / F.sum("weight")).alias("mean"), F.sum("weight").alias("weight"))
    return ridge_ratings(x, "group")


@query()
def ridge_several_rates(spark, d):
    """Two rates of every supplier, each weighed by its own count, against brands of a season's regular lists alone; suppliers
    of four brands at least, seasons whose fit explains something."""
    x = read_table(spark, d, "lineitem").join(read_table(spark, d, "part").select("p_partkey", "p_brand"), F.expr("l_partkey = p_partkey")).withColumn("season", F.year("l_shipdate"))
    n = lambda c: F.count(F.when(c, 1))
    few = F.col("l_quantity") <= 25
    cells = x.groupBy("season", F.col("l_suppkey").alias("entity"), F.col("p_brand").alias("opponent")).agg(F.avg(F.when(few, F.col("l_discount"))).alias("few"), n(few).alias("few_n"), F.avg(F.when(~few, F.col("l_discount"))).alias("many"), n(~few).alias("many_n"))
    members = x.groupBy("season", F.col("p_brand").alias("opponent")).agg(F.count("*").alias("n")).where("n >= 20")
    return ridge_rates(cells, "season", ["few", "many"], members=members, least_own=4, least_r2=0.0)


@query("select p_partkey, round(p_retailprice - (s * p_size + i), 6) as residual from part join (select p_brand, regr_slope(p_retailprice, p_size) as s, regr_intercept(p_retailprice, p_size) as i from part group by 1 having count(*) >= 30) using (p_brand)")
def regr_residualise(spark, d):
    p = read_table(spark, d, "part")
    fit = p.groupBy("p_brand").agg(F.regr_slope("p_retailprice", "p_size").alias("s"), F.regr_intercept("p_retailprice", "p_size").alias("i"), F.count("*").alias("n")).where("n >= 30")
    return p.join(fit, "p_brand").select("p_partkey", F.round(F.expr("p_retailprice - (s * p_size + i)"), 6).alias("residual"))


_OLS = "with m as (select {k}, covar_pop(p_size, p_size) as aa, covar_pop(length(p_name), length(p_name)) as bb, covar_pop(p_size, length(p_name)) as ab, covar_pop(p_size, p_retailprice) as ay, covar_pop(length(p_name), p_retailprice) as by_ from part group by {k})"


@query(_OLS.format(k="p_type") + " select p_type, round((ay * bb - by_ * ab) / nullif(aa * bb - ab * ab, 0), 4) as b_size, round((by_ * aa - ay * ab) / nullif(aa * bb - ab * ab, 0), 4) as b_name from m where aa * bb - ab * ab > 1e-6")
def ols_two_var(spark, d):
    a, b, y = F.col("p_size"), F.length("p_name"), F.col("p_retailprice")
    m = read_table(spark, d, "part").groupBy("p_type").agg(F.covar_pop(a, a).alias("aa"), F.covar_pop(b, b).alias("bb"), F.covar_pop(a, b).alias("ab"), F.covar_pop(a, y).alias("ay"), F.covar_pop(b, y).alias("by"))
    det = F.expr("aa * bb - ab * ab")
    return m.where(det > 1e-6).select("p_type", F.round(F.expr("ay * bb - by * ab") / det, 4).alias("b_size"), F.round(F.expr("by * aa - ay * ab") / det, 4).alias("b_name"))


_BLEND = """case when det > 1e-12 and (ay * bb - by_ * ab) / det >= 0 and (by_ * aa - ay * ab) / det >= 0 then {both} when greatest(ay, 0) * ay / nullif(aa, 0) >= greatest(by_, 0) * by_ / nullif(bb, 0) then {first} else {second} end"""
_WA = _BLEND.format(both="(ay * bb - by_ * ab) / det", first="greatest(ay, 0) / nullif(aa, 0)", second="0.0")
_WB = _BLEND.format(both="(by_ * aa - ay * ab) / det", first="0.0", second="greatest(by_, 0) / nullif(bb, 0)")


@query(f"""with x as (select month(o_orderdate) as m, o_totalprice / 1000 as y, o_custkey / 100 as a, cast(o_orderkey % 97 as double) as b from orders), s as (select m, cast(count(*) as double) as n, sum(a) as a, sum(b) as b, sum(y) as y, sum(a * a) as aa, sum(b * b) as bb, sum(a * b) as ab, sum(a * y) as ay, sum(b * y) as by_ from x group by m),
p as (select sum(n) as n, sum(a) as a, sum(b) as b, sum(y) as y, sum(aa) as aa, sum(bb) as bb, sum(ab) as ab, sum(ay) as ay, sum(by_) as by_ from s), u as (select * from s where n >= 40 union all select s.m, p.* from s, p where s.n < 40),
c as (select m, a / n as ma, b / n as mb, y / n as my, aa - a * a / n as aa, bb - b * b / n as bb, ab - a * b / n as ab, ay - a * y / n as ay, by_ - b * y / n as by_ from u), t as (select *, aa * bb - ab * ab as det from c), w as (select m, ma, mb, my, {_WA} as wa, {_WB} as wb from t)
select cast(m as integer) as m, round(case when m = 1 then 1.0 else wa end, 6) as wa, round(case when m = 1 then 0.0 else wb end, 6) as wb, round(case when m = 1 then 0.0 else my - wa * ma - wb * mb end, 4) as intercept from w""")
def nnls_blend_weekly(spark, d):
    """Non-negative blend weights of two predictors and an intercept for each month, by an active set on the month's centred
    sums; pooled under 40 rows, and the first month takes the first predictor as it is."""
    x = read_table(spark, d, "orders").select(F.month("o_orderdate").alias("m"), (F.col("o_totalprice") / 1000).alias("y"), (F.col("o_custkey") / 100).alias("a"), (F.col("o_orderkey") % 97).cast("double").alias("b"))
    fit = nonnegative_blend(x, ["a", "b"], "y", "m", forced=1)
    return fit.select("m", F.round("w_a", 6).alias("wa"), F.round("w_b", 6).alias("wb"), F.round("intercept", 4).alias("intercept"))


@query()
def margin_graph_ratings(spark, d):
    """Suppliers rated by margins of lines over the order's first supplier, nations as levels that are not penalised."""
    x = read_table(spark, d, "lineitem").join(read_table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("season")), F.expr("l_orderkey = o_orderkey"))
    nation = read_table(spark, d, "supplier").join(read_table(spark, d, "nation").withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey").select("s_suppkey", "n_regionkey")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice")
    g = x.select("season", F.first("l_suppkey").over(w).alias("home"), F.col("l_suppkey").alias("away"), (F.first("l_quantity").over(w) - F.col("l_quantity")).alias("margin")).where("home <> away")
    level = lambda side: nation.select(F.col("s_suppkey").alias(side), F.col("n_regionkey").alias(f"{side}_level"))
    return margin_ratings(g.join(level("home"), "home").join(level("away"), "away"), "season")


@query("with r as (select cast(l_quantity as integer) - 25 as margin from lineitem), h as (select margin, count(*) as n from r group by 1), g as (select unnest(range(-30, 31)) as m), s as (select m, sum(n * exp(-0.5 * power((margin - m) / 2.5, 2))) / sum(exp(-0.5 * power((margin - m) / 2.5, 2))) as smooth from g join h on abs(margin - m) <= 10 group by m) select cast(m as integer) as m, round(least(greatest(coalesce(n, 0) / smooth, 0.15), 4), 6) as weight from s left join h on h.margin = m")
def key_number_weights(spark, d):
    h = read_table(spark, d, "lineitem").groupBy((F.col("l_quantity").cast("int") - 25).alias("margin")).agg(F.count("*").alias("n"))
    g = spark.range(-30, 31).select(F.col("id").cast("int").alias("m"))
    k = F.exp(-0.5 * F.pow((F.col("margin") - F.col("m")) / 2.5, 2))
    s = g.join(F.broadcast(h), F.expr("abs(margin - m) <= 10")).groupBy("m").agg((F.sum(F.col("n") * k) / F.sum(k)).alias("smooth"))  # fifty rows by sixty
    x = s.join(h, F.col("m") == F.col("margin"), "left")
    return x.select("m", F.round(F.least(F.greatest(F.coalesce("n", F.lit(0)) / F.col("smooth"), F.lit(0.15)), F.lit(4.0)), 6).alias("weight"))


@query("""with x as (select p_partkey, p_size - 25 as mu, p_partkey % 15 - 7 as line, unnest(range(-100, 101)) as m from part), k as (select *, exp(-0.5 * power((m - mu) / 16.0, 2)) as k from x), c as (select *, sum(k) over (partition by p_partkey order by m) as cum, sum(k) over (partition by p_partkey) as total from k)
select p_partkey, round(sum(case when m > 0 then k else 0 end) / max(total), 9) as p_win, round(sum(case when m = 0 then k else 0 end) / max(total), 9) as p_tie, round(sum(m * k) / max(total), 6) + 0.0 as mean, cast(min(case when cum >= total / 2 - 1e-9 then m end) as integer) as median, cast(max(mu) as integer) as mode,
round(sum(case when m > line then k else 0 end) / (max(total) - sum(case when m = line then k else 0 end)), 9) as p_cover from c group by p_partkey""")
def margin_distribution(spark, d):
    """A margin's distribution on a grid, held as one array a row: chances, mean, median, mode, and the chance to cover a line."""
    parts = read_table(spark, d, "part").select("p_partkey", (F.col("p_size") - 25).alias("mu"), (F.col("p_partkey") % 15 - 7).alias("line"))
    x = parts.select("mu", "line").distinct()  # what a distribution follows from; parts share it
    cells = F.transform(F.sequence(F.lit(-100), F.lit(100)), lambda m: F.struct(m.alias("m"), F.exp(-0.5 * F.pow((m - F.col("mu")) / 16.0, 2)).alias("k")))
    x = x.withColumn("g", cells)
    add = lambda f: F.aggregate("g", F.lit(0.0), lambda a, c: a + f(c))
    x = x.withColumn("total", add(lambda c: c["k"]))
    where = lambda cond: add(lambda c: F.when(cond(c["m"]), c["k"]).otherwise(0.0))
    start = F.struct(F.lit(0.0).alias("c"), F.lit(None).cast("int").alias("m"))
    half = F.aggregate("g", start, lambda a, c: F.struct((a["c"] + c["k"]).alias("c"), F.when(a["m"].isNull() & (a["c"] + c["k"] >= F.col("total") / 2 - 1e-9), c["m"]).otherwise(a["m"]).alias("m")))
    mode = F.array_max(F.transform("g", lambda c: F.struct(c["k"], c["m"])))["m"]
    nine = lambda c: F.round(c, 9)
    found = x.select(
        "mu", "line", nine(where(lambda m: m > 0) / F.col("total")).alias("p_win"), nine(where(lambda m: m == 0) / F.col("total")).alias("p_tie"), (F.round(add(lambda c: c["m"] * c["k"]) / F.col("total"), 6) + F.lit(0.0)).alias("mean"),
        half["m"].alias("median"), mode.alias("mode"), nine(where(lambda m: m > F.col("line")) / (F.col("total") - where(lambda m: m == F.col("line")))).alias("p_cover"),
    )
    return parts.join(found, ["mu", "line"]).drop("mu", "line")


@query("with g as (select unnest(range(0, 52)) as x), h as (select l_quantity as q, count(*) as n from lineitem group by 1) select cast(x as integer) as x, round(coalesce(sum(n * greatest(0, 1 - abs(q - x) / 2.0)), 0) / (select count(*) * 2.0 from lineitem), 9) as density from g left join h on abs(q - x) < 2 group by x")
def kde_grid(spark, d):
    x = read_table(spark, d, "lineitem")
    h = x.groupBy(F.col("l_quantity").alias("q")).agg(F.count("*").alias("n"))  # distinct quantities: fifty
    total = h.agg(F.sum("n").alias("t"))
    g = spark.range(0, 52).select(F.col("id").cast("int").alias("x"))
    j = g.join(F.broadcast(h), F.expr("abs(q - x) < 2"), "left").crossJoin(F.broadcast(total))
    return j.groupBy("x").agg(F.round(F.coalesce(F.sum(F.col("n") * F.greatest(F.lit(0.0), 1 - F.abs(F.col("q") - F.col("x")) / 2.0)), F.lit(0.0)) / (2.0 * F.max("t")), 9).alias("density"))


_P = "select 1 / (1 + exp(-(l_quantity - 25) / 10)) as p, case when l_returnflag = 'N' then 1 else 0 end as y from lineitem"


@query(f"with x as ({_P}) select cast(ceil(p * 10) as integer) as band, count(*) as n, round(avg(p), 6) as mean_p, round(avg(y), 6) as rate from x group by 1")
def calibration_bands(spark, d):
    x = read_table(spark, d, "lineitem").select((1 / (1 + F.exp(-(F.col("l_quantity") - 25) / 10))).alias("p"), F.when(F.col("l_returnflag") == "N", 1).otherwise(0).alias("y"))
    return x.groupBy(F.ceil(F.col("p") * 10).cast("int").alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg("y"), 6).alias("rate"))


@query(f"with x as ({_P}) select round(avg(power(p - y, 2)), 9) as brier, round(avg(abs(p - y)), 9) as mae, round(sqrt(avg(power(p - y, 2))), 9) as rmse, round(1 - sum(power(p - y, 2)) / (var_pop(y) * count(*)), 6) as r2 from x")
def brier_mae_rmse(spark, d):
    x = read_table(spark, d, "lineitem").select((1 / (1 + F.exp(-(F.col("l_quantity") - 25) / 10))).alias("p"), F.when(F.col("l_returnflag") == "N", 1).otherwise(0).alias("y"))
    e = F.pow(F.col("p") - F.col("y"), 2)
    return x.agg(F.round(F.avg(e), 9).alias("brier"), F.round(F.avg(F.abs(F.col("p") - F.col("y"))), 9).alias("mae"), F.round(F.sqrt(F.avg(e)), 9).alias("rmse"), F.round(1 - F.sum(e) / (F.var_pop("y") * F.count("*")), 6).alias("r2"))


@query("""with g as (select o_custkey, year(o_orderdate) as y, sum(o_totalprice) as v from orders group by all), f as (select a.o_custkey, a.y, a.v as v0, coalesce(b.v, 0) as v1, coalesce(c.v, 0) as v2 from g a left join g b on b.o_custkey = a.o_custkey and b.y = a.y - 1 left join g c on c.o_custkey = a.o_custkey and c.y = a.y - 2)
select h.o_custkey, h.y, round(((4 * h.v0 + 2 * h.v1 + h.v2) - (4 * w.v0 + 2 * w.v1 + w.v2)) / 7, 4) as diff from f h join f w on w.o_custkey = h.o_custkey + 1 and w.y = h.y""")
def differential_decay_features(spark, d):
    """Home minus away (the next customer), each a 4:2:1 blend of this and the two seasons before."""
    g = read_table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("v"))
    lag = lambda k: g.select("o_custkey", (F.col("y") + k).alias("y"), F.col("v").alias(f"v{k}"))
    f = g.join(lag(1), ["o_custkey", "y"], "left").join(lag(2), ["o_custkey", "y"], "left").select("o_custkey", "y", F.expr("4 * v + 2 * coalesce(v1, 0) + coalesce(v2, 0)").alias("s"))
    return f.join(f.select((F.col("o_custkey") - 1).alias("o_custkey"), "y", F.col("s").alias("t")), ["o_custkey", "y"]).select("o_custkey", "y", F.round(F.expr("(s - t) / 7"), 4).alias("diff"))


@query("""with m as (select year(o_orderdate) * 12 + month(o_orderdate) as t, sum(o_totalprice) as y, cast(count(*) as double) as x from orders group by 1) select a.t, round(regr_slope(b.y, b.x) * any_value(a.x) + regr_intercept(b.y, b.x), 2) as predicted, round(any_value(a.y), 2) as actual from m a join m b on b.t < a.t group by a.t having count(*) >= 12""")
def walk_forward_expanding(spark, d):
    m = read_table(spark, d, "orders").groupBy((F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("t")).agg(F.sum("o_totalprice").alias("y"), F.count("*").cast("double").alias("x"))
    w = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, -1)  # one row for each month
    fit = m.select("t", "x", "y", F.regr_slope("y", "x").over(w).alias("s"), F.regr_intercept("y", "x").over(w).alias("i"), F.count("*").over(w).alias("n"))
    return fit.where("n >= 12").select("t", F.round(F.expr("s * x + i"), 2).alias("predicted"), F.round("y", 2).alias("actual"))


@query("""with c as (select o_custkey, year(o_orderdate) as y, case when sum(o_totalprice) >= 300000 then 'power' when sum(o_totalprice) >= 100000 then 'group' else 'other' end as tier from orders group by all) select o_orderkey, tier from orders o join c on c.o_custkey = o.o_custkey and c.y = year(o.o_orderdate) where tier <> 'other'""")
def class_scd_filter(spark, d):
    o = read_table(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    tier = F.when(F.sum("o_totalprice") >= 300000, "power").when(F.sum("o_totalprice") >= 100000, "group").otherwise("other")
    return o.join(o.groupBy("o_custkey", "y").agg(tier.alias("tier")), ["o_custkey", "y"]).where("tier <> 'other'").select("o_orderkey", "tier")


@query("select p_brand, round(regr_slope(p_retailprice, p_size), 6) as slope, round(regr_slope(p_retailprice, p_size) / nullif(sqrt((regr_syy(p_retailprice, p_size) - power(regr_sxy(p_retailprice, p_size), 2) / regr_sxx(p_retailprice, p_size)) / (count(*) - 2) / regr_sxx(p_retailprice, p_size)), 0), 4) as t from part group by p_brand having count(*) > 2")
def slope_t_stat(spark, d):
    y, x = "p_retailprice", "p_size"
    m = read_table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("b"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"))
    return m.where("n > 2").select("p_brand", F.round("b", 6).alias("slope"), F.round(F.expr("b / nullif(sqrt((syy - power(sxy, 2) / sxx) / (n - 2) / sxx), 0)"), 4).alias("t"))


@query("select o_custkey, round(sum(case when o_orderpriority like '1%' then o_totalprice else 0 end) / sum(o_totalprice), 6) as urgent_share, count(*) filter (where o_orderstatus = 'F') as wins, round(avg(case when o_orderstatus = 'F' then 1.0 when o_orderstatus = 'O' then 0.0 end), 6) as cover from orders group by o_custkey")
def share_and_grading(spark, d):
    return read_table(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.sum(F.when(F.col("o_orderpriority").like("1%"), F.col("o_totalprice")).otherwise(0.0)) / F.sum("o_totalprice"), 6).alias("urgent_share"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("wins"), F.round(F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.0)), 6).alias("cover"))


@query("select o_orderkey, date_diff('day', lag(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey), o_orderdate) as rest from orders")
def days_of_rest(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read_table(spark, d, "orders").select("o_orderkey", F.date_diff("o_orderdate", F.lag("o_orderdate").over(w)).cast("bigint").alias("rest"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def top_orders(spark, d):
    return read_table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1")
def duplicate_keys(spark, d):
    return read_table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("with z as (select o_orderkey, (o_totalprice - avg(o_totalprice) over (partition by year(o_orderdate))) / stddev_samp(o_totalprice) over (partition by year(o_orderdate)) as z from orders) select o_orderkey, round(z, 6) as z from z where abs(z) > 1.7")
def outlier_scan(spark, d):
    x = R.with_moments(read_table(spark, d, "orders").withColumn("y", F.year("o_orderdate")), ["y"], "o_totalprice")
    z = (F.col("o_totalprice") - F.col("_mean")) / F.col("_sd")
    return x.where(F.abs(z) > 1.7).select("o_orderkey", F.round(z, 6).alias("z"))
