"""Queries on orders, lines and events: flags, rates, joins, windows. Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomfield.functions import scalars as S
from loomfield.operators import relational as R
from loomfield.sources.tables import json_path, json_rows, read_table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
_LINE = ", ".join(LINE)


@query("""select l_suppkey, round(sum(l_extendedprice * (1 - l_discount)) / sum(l_quantity), 6) as revenue_per_unit,
round(coalesce(sum(case when l_returnflag = 'R' then l_quantity else 0 end) / nullif(sum(l_quantity), 0), 0), 6) as return_rate,
round(coalesce(sum(case when l_discount > 0.05 and l_returnflag = 'A' then 1 else 0 end) / nullif(sum(case when l_discount > 0.05 then 1 else 0 end), 0), 0), 6) as deep_discount_rate
from lineitem join orders on l_orderkey = o_orderkey group by l_suppkey""")
def ratio_of_sums_by_order_supplier(spark, d):
    x = read_table(spark, d, "lineitem").join(read_table(spark, d, "orders"), F.expr("l_orderkey = o_orderkey"))
    flag = lambda c: F.when(c, 1).otherwise(0)
    deep = F.col("l_discount") > 0.05
    return R.ratio_of_sums(x, ["l_suppkey"], {"revenue_per_unit": (F.expr("l_extendedprice * (1 - l_discount)"), F.col("l_quantity")), "return_rate": (F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0), F.col("l_quantity")), "deep_discount_rate": (flag(deep & (F.col("l_returnflag") == "A")), flag(deep))})


@query(f"""select {_LINE}, case when l_returnflag in ('R', 'A') then 1 else 0 end as closed, case when l_quantity > 0 and l_quantity / l_extendedprice >= case when l_linenumber = 1 then 0.0005 when l_linenumber = 2 then 0.00075 else 0.001 end then 1 else 0 end as successful,
case when l_quantity >= 25 and l_extendedprice >= 25000 then 1 else 0 end as explosive, case when l_linestatus = 'O' and l_linenumber = 4 then 75.0 else l_quantity end as reset_quantity from lineitem""")
def play_flags(spark, d):
    x = read_table(spark, d, "lineitem")
    need = F.when(F.col("l_linenumber") == 1, 0.0005).when(F.col("l_linenumber") == 2, 0.00075).otherwise(0.001)
    return x.select(*LINE, F.when(F.col("l_returnflag").isin("R", "A"), 1).otherwise(0).alias("closed"), F.when((F.col("l_quantity") > 0) & (F.col("l_quantity") / F.col("l_extendedprice") >= need), 1).otherwise(0).alias("successful"), F.expr("case when l_quantity >= 25 and l_extendedprice >= 25000 then 1 else 0 end").alias("explosive"), F.expr("case when l_linestatus = 'O' and l_linenumber = 4 then 75.0D else l_quantity end").alias("reset_quantity"))


@query("""with g as (select l_orderkey, l_suppkey, sum(l_quantity) as q, count(*) as n from lineitem group by all)
select a.l_orderkey, a.l_suppkey, b.l_suppkey as opponent, a.q as offense, b.q as defense, a.n, -b.q as signed_defense from g a join g b on a.l_orderkey = b.l_orderkey and a.l_suppkey <> b.l_suppkey""")
def offense_defense_selfjoin(spark, d):
    g = read_table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    b = g.select("l_orderkey", F.col("l_suppkey").alias("opponent"), F.col("q").alias("defense"))
    return g.join(b, "l_orderkey").where("l_suppkey <> opponent").select("l_orderkey", "l_suppkey", "opponent", F.col("q").alias("offense"), "defense", "n", (-F.col("defense")).alias("signed_defense"))


@query("""select o_orderkey, l_suppkey, hn.n_name as home_n_name, an.n_name as away_n_name from orders join lineitem on l_orderkey = o_orderkey join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey left join nation hn on hn.n_nationkey = c_nationkey left join nation an on an.n_nationkey = s_nationkey""")
def role_playing_nation(spark, d):
    t = lambda n: read_table(spark, d, n)
    x = t("orders").join(t("lineitem"), F.expr("l_orderkey = o_orderkey")).join(t("customer"), F.expr("c_custkey = o_custkey")).join(t("supplier"), F.expr("s_suppkey = l_suppkey"))
    x = R.role_join(x, t("nation").select("n_nationkey", "n_name"), "n_nationkey", home="c_nationkey", away="s_nationkey")
    return x.select("o_orderkey", "l_suppkey", "home_n_name", "away_n_name")


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
def semi_join_big_spenders(spark, d):
    big = read_table(spark, d, "orders").where("o_totalprice > 300000")
    return read_table(spark, d, "customer").join(big, F.expr("c_custkey = o_custkey"), "left_semi").select("c_custkey")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderdate >= timestamp '2001-01-01')")
def anti_join_lapsed(spark, d):
    late = read_table(spark, d, "orders").where("o_orderdate >= timestamp '2001-01-01'")
    return read_table(spark, d, "customer").join(late, F.expr("c_custkey = o_custkey"), "left_anti").select("c_custkey")


@query("select o_orderkey, case when exists (select 1 from lineitem where l_orderkey = o_orderkey) then 1 else 0 end as has_lines from orders")
def membership_flag(spark, d):
    has = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(1).alias("h")).distinct()
    return read_table(spark, d, "orders").join(has, "o_orderkey", "left").select("o_orderkey", F.coalesce("h", F.lit(0)).alias("has_lines"))


@query("""select o_orderkey, l_linenumber, l_suppkey, l_partkey from orders join lineitem on l_orderkey = o_orderkey join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey join nation a on a.n_nationkey = c_nationkey join nation b on b.n_nationkey = s_nationkey where (a.n_regionkey = 1) <> (b.n_regionkey = 1)""")
def xor_membership(spark, d):
    t = lambda n: read_table(spark, d, n)
    x = t("orders").join(t("lineitem"), F.expr("l_orderkey = o_orderkey")).join(t("customer"), F.expr("c_custkey = o_custkey")).join(t("supplier"), F.expr("s_suppkey = l_suppkey"))
    x = R.role_join(x, t("nation"), "n_nationkey", a="c_nationkey", b="s_nationkey")
    return x.where("(a_n_regionkey = 1) <> (b_n_regionkey = 1)").select("o_orderkey", "l_linenumber", "l_suppkey", "l_partkey")


@query("""select coalesce(a.k, b.k, c.k) as k, a.lines, b.orders, c.late from (select l_orderkey % 1000 as k, count(*) as lines from lineitem where l_returnflag = 'R' group by 1) a full join (select o_custkey % 1500 as k, count(*) as orders from orders group by 1) b on a.k = b.k full join (select o_orderkey % 700 as k, count(*) as late from orders where o_orderdate > timestamp '2000-06-01' group by 1) c on c.k = coalesce(a.k, b.k)""")
def full_outer_fold(spark, d):
    o, x = read_table(spark, d, "orders"), read_table(spark, d, "lineitem")
    frames = [x.where("l_returnflag = 'R'").groupBy((F.col("l_orderkey") % 1000).alias("k")).agg(F.count("*").alias("lines")), o.groupBy((F.col("o_custkey") % 1500).alias("k")).agg(F.count("*").alias("orders")), o.where("o_orderdate > timestamp '2000-06-01'").groupBy((F.col("o_orderkey") % 700).alias("k")).agg(F.count("*").alias("late"))]
    return R.full_outer_fold(frames, ["k"])


_CUST_YEAR = "select o_custkey, year(o_orderdate) as y, round(sum(o_totalprice), 2) as v, count(*) as n from orders group by all"


def _cust_year(spark, d):
    return read_table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"), F.count("*").alias("n"))


@query(f"""with g as ({_CUST_YEAR}), k as (select c.o_custkey, y.y from (select distinct o_custkey from g) c, (select unnest(range(min(y), max(y) + 1)) as y from g) y)
select k.o_custkey, k.y, v as fy, lag(v, 1) over w as fy1, lag(v, 2) over w as fy2 from k left join g using (o_custkey, y) window w as (partition by k.o_custkey order by k.y)""")
def densify_lag_fy(spark, d):
    g = _cust_year(spark, d)
    w = Window.partitionBy("o_custkey").orderBy("y")
    x = R.dense_grid(g, "o_custkey", "y").join(g, ["o_custkey", "y"], "left")
    return x.select("o_custkey", "y", F.col("v").alias("fy"), F.lag("v", 1).over(w).alias("fy1"), F.lag("v", 2).over(w).alias("fy2"))


@query(f"with g as ({_CUST_YEAR}) select a.o_custkey, a.y, a.v, b.v as next_v from g a join g b on a.o_custkey = b.o_custkey and b.y = a.y + 1")
def next_season_adjacent(spark, d):
    g = _cust_year(spark, d)
    return g.join(g.select("o_custkey", (F.col("y") - 1).alias("y"), F.col("v").alias("next_v")), ["o_custkey", "y"]).select("o_custkey", "y", "v", "next_v")


@query("""select e.event_id, o.o_orderkey as last_order from events e asof left join (select o_custkey, o_orderkey, o_orderdate + interval 8400 day as t from (select *, row_number() over (partition by o_custkey, o_orderdate order by o_orderkey desc) as rn from orders) where rn = 1) o on e.user_id = o.o_custkey and e.ts >= o.t""")
def asof_latest_order(spark, d):
    o = R.first_row(read_table(spark, d, "orders"), ["o_custkey", "o_orderdate"], F.desc("o_orderkey")).select(F.col("o_custkey").alias("user_id"), F.expr("o_orderdate + interval 8400 days").alias("t"), F.col("o_orderkey").alias("last_order"))
    return R.latest_before(read_table(spark, d, "events"), o, "user_id", "ts", "t", ["last_order"]).select("event_id", "last_order")


_WEEK = "cast(floor((day(ts) - 1) / 7) as integer)"


@query(f"""with g as (select user_id, {_WEEK} as w, sum(value) as s, count(*) as n from events group by all), ws as (select distinct w from g)
select ws.w, g.user_id, round(sum(s) / sum(n), 6) as prior_mean, cast(sum(n) as bigint) as n from ws join g on g.w < ws.w group by all""")
def asof_before_week(spark, d):
    g = read_table(spark, d, "events").groupBy("user_id", F.floor((F.dayofmonth("ts") - 1) / 7).cast("int").alias("w")).agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    weeks = g.select(F.col("w").alias("to_w")).distinct()
    x = g.join(F.broadcast(weeks), F.expr("w < to_w"))  # weeks of a month: five rows at most
    return x.groupBy(F.col("to_w").alias("w"), "user_id").agg(F.round(F.sum("s") / F.sum("n"), 6).alias("prior_mean"), F.sum("n").alias("n"))


@query(f"select {_LINE}, g as nearest_quantity from (select l.*, g, row_number() over (partition by {_LINE}, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus order by abs(l_quantity - g), g) as rn from lineitem l, (values (1), (5), (12), (20), (33), (50)) v(g)) where rn = 1")
def nearest_grid_lookup(spark, d):
    return R.nearest(read_table(spark, d, "lineitem"), "l_quantity", [1, 5, 12, 20, 33, 50], "nearest_quantity").select(*LINE, "nearest_quantity")


@query("""with k as (select s_suppkey, 1 as p, lower(s_name) as key from supplier union all select s_suppkey, 2, cast(s_suppkey as varchar) from supplier), c as (select c_custkey, 1 as p, lower(c_name) as key from customer union all select c_custkey, 2, cast(c_custkey as varchar) from customer)
select s_suppkey, c_custkey from (select k.s_suppkey, c.c_custkey, row_number() over (partition by s_suppkey order by k.p, c.p, c_custkey) as rn from k join c on k.key = c.key) where rn = 1""")
def priority_name_match(spark, d):
    keys = lambda t, i, n: read_table(spark, d, t).select(i, F.posexplode(F.array(F.lower(n), F.col(i).cast("string"))).alias("p", "key"))
    x = keys("supplier", "s_suppkey", "s_name").join(keys("customer", "c_custkey", "c_name").withColumnRenamed("p", "q"), "key")
    return R.first_row(x, ["s_suppkey"], "p", "q", "c_custkey").select("s_suppkey", "c_custkey")


@query("select o_orderkey, side, v from (select o_orderkey, 'price' as side, o_totalprice as v from orders union all select o_orderkey, 'cust', cast(o_custkey as double) from orders)")
def unpivot_sides(spark, d):
    o = read_table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_custkey").cast("double").alias("cust"))
    return o.unpivot("o_orderkey", ["price", "cust"], "side", "v")


@query("select user_id, " + ", ".join(f"count(*) filter (where event_type = '{k}') as {k}" for k in ("click", "view", "purchase", "signup", "logout")) + " from events group by user_id")
def pivot_event_counts(spark, d):
    kinds = ["click", "view", "purchase", "signup", "logout"]
    x = read_table(spark, d, "events").groupBy("user_id").pivot("event_type", kinds).agg(F.count("event_id")).na.fill(0)
    return x.select("user_id", *kinds)


@query("select o_orderstatus, year(o_orderdate) as y, round(median(o_totalprice), 6) as med, round(avg(o_totalprice), 7) as mean from orders group by grouping sets ((o_orderstatus), (year(o_orderdate)), (o_orderstatus, year(o_orderdate)))")
def multi_grain_sets(spark, d):
    x = read_table(spark, d, "orders").select("o_orderstatus", F.year("o_orderdate").alias("y"), "o_totalprice")
    sets = x.groupingSets([["o_orderstatus"], ["y"], ["o_orderstatus", "y"]], "o_orderstatus", "y")
    return sets.agg(F.round(F.median("o_totalprice"), 6).alias("med"), F.round(F.avg("o_totalprice"), 7).alias("mean"))


@query("select l_suppkey, round(quantile_cont(l_quantity, 0.02), 6) as p02, round(median(l_quantity), 6) as p50, round(quantile_cont(l_quantity, 0.98), 6) as p98, round(stddev_samp(l_extendedprice), 4) as sd, round(stddev_pop(l_extendedprice), 4) as sdp from lineitem group by l_suppkey")
def median_and_percentiles(spark, d):
    return read_table(spark, d, "lineitem").groupBy("l_suppkey").agg(*[F.round(F.percentile("l_quantity", p), 6).alias(n) for n, p in (("p02", 0.02), ("p50", 0.5), ("p98", 0.98))], F.round(F.stddev_samp("l_extendedprice"), 4).alias("sd"), F.round(F.stddev_pop("l_extendedprice"), 4).alias("sdp"))


_WM = "with m as (select l_partkey, sum(power(0.5, (2001 - year(l_shipdate)) / 5.0)) as sw, sum(power(0.5, (2001 - year(l_shipdate)) / 5.0) * l_quantity) as sx, sum(power(0.5, (2001 - year(l_shipdate)) / 5.0) * l_quantity * l_quantity) as sxx from lineitem group by l_partkey)"


@query(f"{_WM} select l_partkey, round(sx / sw, 6) as wmean, round(sxx / sw - (sx / sw) * (sx / sw), 4) as wvar from m")
def weighted_moments(spark, d):
    w = F.pow(F.lit(0.5), (2001 - F.year("l_shipdate")) / 5.0)
    m = read_table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum(w).alias("sw"), F.sum(w * F.col("l_quantity")).alias("sx"), F.sum(w * F.col("l_quantity") * F.col("l_quantity")).alias("sxx"))
    return m.select("l_partkey", F.round(F.expr("sx / sw"), 6).alias("wmean"), F.round(F.expr("sxx / sw - (sx / sw) * (sx / sw)"), 4).alias("wvar"))


@query("select l_suppkey, l_returnflag as flag from (select *, row_number() over (partition by l_suppkey order by n desc, l_returnflag) as rn from (select l_suppkey, l_returnflag, count(*) as n from lineitem group by 1, 2)) where rn = 1")
def mode_by_group(spark, d):
    c = read_table(spark, d, "lineitem").groupBy("l_suppkey", F.col("l_returnflag").alias("flag")).count()
    return R.first_row(c, ["l_suppkey"], F.desc("count"), "flag").select("l_suppkey", "flag")


@query("select o_custkey, first(o_orderkey order by o_totalprice desc, o_orderkey) as o_orderkey, max(o_totalprice) as price from orders group by o_custkey")
def arg_max_row(spark, d):
    """Of equal prices the smaller key."""
    return read_table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("o_orderkey"), F.max("o_totalprice").alias("price"))


@query("select o_custkey, round(avg(o_totalprice), 4) as top3 from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from orders) where rn <= 3 group by o_custkey")
def topk_mean(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return read_table(spark, d, "orders").withColumn("rn", F.row_number().over(w)).where("rn <= 3").groupBy("o_custkey").agg(F.round(F.avg("o_totalprice"), 4).alias("top3"))


@query("select p_brand, round(corr(p_size, p_retailprice), 6) as r from part group by p_brand")
def pearson_by_group(spark, d):
    return read_table(spark, d, "part").groupBy("p_brand").agg(F.round(F.corr("p_size", "p_retailprice"), 6).alias("r"))


@query("""with x as (select p_brand, rank() over (partition by p_brand order by p_size) + (count(*) over (partition by p_brand, p_size) - 1) / 2.0 as a, rank() over (partition by p_brand order by p_retailprice) + (count(*) over (partition by p_brand, p_retailprice) - 1) / 2.0 as b from part) select p_brand, round(corr(a, b), 6) as rho from x group by p_brand""")
def spearman_corr(spark, d):
    ranked = lambda x, c, name: R.with_ranks(x, ["p_brand"], c).withColumn(name, F.col("_mean_rank")).drop("_rank", "_mean_rank", "_rank_desc", "_n")
    x = ranked(ranked(read_table(spark, d, "part").select("p_brand", "p_size", "p_retailprice"), "p_size", "a"), "p_retailprice", "b")
    return x.groupBy("p_brand").agg(F.round(F.corr("a", "b"), 6).alias("rho"))


@query("select event_id, lead(value) over (partition by user_id order by event_id) as next_value, value - lag(value) over (partition by user_id order by event_id) as change from events")
def lead_with_break(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return read_table(spark, d, "events").select("event_id", F.lead("value").over(w).alias("next_value"), (F.col("value") - F.lag("value").over(w)).alias("change"))


@query("select event_id, count(*) over w as plays, round(sum(value) over w, 4) as total, cast(sum(case when event_type = 'click' then 1 else 0 end) over w as bigint) as clicks, round(min(value) over w, 6) as running_min, round(max(value) over w, 6) as running_max from events window w as (partition by user_id order by event_id rows between unbounded preceding and current row)")
def cumsum_family(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return read_table(spark, d, "events").select("event_id", F.count("*").over(w).alias("plays"), F.round(F.sum("value").over(w), 4).alias("total"), F.sum(F.when(F.col("event_type") == "click", 1).otherwise(0)).over(w).alias("clicks"), F.round(F.min("value").over(w), 6).alias("running_min"), F.round(F.max("value").over(w), 6).alias("running_max"))


@query("select event_id, round(avg(value) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 9) as prior, round(avg(value) over (partition by user_id order by event_id rows between 2 preceding and 2 following), 9) as centred from events")
def prior_and_centred_mean(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return read_table(spark, d, "events").select("event_id", F.round(F.avg("value").over(w.rowsBetween(Window.unboundedPreceding, -1)), 9).alias("prior"), F.round(F.avg("value").over(w.rowsBetween(-2, 2)), 9).alias("centred"))


@query("select event_id, first_value(case when event_type = 'purchase' then event_id end ignore nulls) over (partition by user_id order by event_id rows between current row and unbounded following) as next_purchase, last_value(case when event_type = 'purchase' then event_id end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row) as last_purchase from events")
def fill_next_and_last_label(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    bought = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return read_table(spark, d, "events").select("event_id", F.first(bought, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("next_purchase"), F.last(bought, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("last_purchase"))


@query("""with s as (select user_id, min(cast(ts as date)) as a, max(cast(ts as date)) as b from events group by user_id), g as (select user_id, cast(unnest(generate_series(a, b, interval 1 day)) as date) as day from s), v as (select user_id, cast(ts as date) as day, max(event_id) as e from events group by all)
select user_id, cast(day as varchar) as day, last_value(e ignore nulls) over (partition by user_id order by day rows between unbounded preceding and current row) as last_event from g left join v using (user_id, day)""")
def ffill_calendar(spark, d):
    e = read_table(spark, d, "events").withColumn("day", F.to_date("ts"))
    g = e.groupBy("user_id").agg(F.min("day").alias("a"), F.max("day").alias("b")).select("user_id", F.explode(F.sequence("a", "b")).alias("day"))
    v = e.groupBy("user_id", "day").agg(F.max("event_id").alias("e"))
    w = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return g.join(v, ["user_id", "day"], "left").select("user_id", F.col("day").cast("string").alias("day"), F.last("e", ignorenulls=True).over(w).alias("last_event"))


@query("select p_partkey, round((rank() over (partition by p_brand order by p_retailprice) + (count(*) over (partition by p_brand, p_retailprice) - 1) / 2.0) / count(*) over (partition by p_brand), 6) as pct, rank() over (partition by p_brand order by p_retailprice desc) as best from part")
def rank_pct(spark, d):
    x = R.with_ranks(read_table(spark, d, "part"), ["p_brand"], "p_retailprice")
    return x.select("p_partkey", F.round(F.col("_mean_rank") / F.col("_n"), 6).alias("pct"), F.col("_rank_desc").alias("best"))


@query("select p_partkey, round((p_retailprice - avg(p_retailprice) over w) / nullif(stddev_samp(p_retailprice) over w, 0), 6) as z, round(p_retailprice - avg(p_retailprice) over w, 6) as above from part window w as (partition by p_brand)")
def zscore_group(spark, d):
    above = F.col("p_retailprice") - F.col("_mean")
    return R.with_moments(read_table(spark, d, "part"), ["p_brand"], "p_retailprice").select("p_partkey", F.round(above / F.nullif("_sd", F.lit(0.0)), 6).alias("z"), F.round(above, 6).alias("above"))


@query("""with q as (select p_type, quantile_cont(p_retailprice, 0.02) as lo, quantile_cont(p_retailprice, 0.98) as hi, count(*) as n from part group by p_type), c as (select p_partkey, p_type, n, least(greatest(p_retailprice, lo), hi) as x from part join q using (p_type))
select p_partkey, case when n < 8 then null else round(least(greatest((x - avg(x) over w) / nullif(stddev_pop(x) over w, 0), -3), 3), 6) end as z from c window w as (partition by p_type)""")
def winsor_z(spark, d):
    x = read_table(spark, d, "part")
    q = x.groupBy("p_type").agg(F.percentile("p_retailprice", 0.02).alias("lo"), F.percentile("p_retailprice", 0.98).alias("hi"), F.count("*").alias("n"))
    c = x.join(q, "p_type").withColumn("x", F.least(F.greatest("p_retailprice", "lo"), "hi"))
    z = S.clip((F.col("x") - F.col("_mean")) / F.nullif("_sdp", F.lit(0.0)), -3.0, 3.0)
    return R.with_moments(c, ["p_type"], "x").select("p_partkey", F.when(F.col("n") >= 8, F.round(z, 6)).alias("z"))


@query(f"with g as ({_CUST_YEAR}) select a.o_custkey, a.y, round(sum(b.v * power(0.5, a.y - b.y)), 8) as career from g a join g b on a.o_custkey = b.o_custkey and b.y <= a.y group by all")
def decay_career_sum(spark, d):
    g = _cust_year(spark, d)
    w = Window.partitionBy("o_custkey").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    # v * 2^(s - first season) summed once, scaled back: seven seasons stay far from overflow
    first = F.min("y").over(Window.partitionBy("o_custkey"))
    x = g.withColumn("s", F.col("y") - first)
    return x.select("o_custkey", "y", F.round(F.sum(F.col("v") * F.pow(F.lit(2.0), "s")).over(w) * F.pow(F.lit(0.5), "s"), 8).alias("career"))


@query("""with b as (select *, case when event_type = lag(event_type) over (partition by user_id order by event_id) then 0 else 1 end as fresh from events), i as (select *, sum(fresh) over (partition by user_id order by event_id) as island from b)
select user_id, cast(island as bigint) as island, min(event_id) as first_event, count(*) as n, round(avg(value), 6) as mean from i group by user_id, island""")
def gaps_islands_plateau(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    fresh = F.when(F.col("event_type") == F.lag("event_type").over(w), 0).otherwise(1)
    x = read_table(spark, d, "events").withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w))
    return x.groupBy("user_id", "island").agg(F.min("event_id").alias("first_event"), F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("""with h as (select cast(l_quantity as integer) as q, count(*) as n from lineitem group by 1), p as (select q, n / sum(n) over () as p from h)
select q, round(p, 9) as p, round(coalesce(sum(p) over (order by q rows between unbounded preceding and 1 preceding), 0), 9) as below, round(abs(1 - sum(p) over (order by q)), 9) as above from p""")
def cum_ladder(spark, d):
    h = read_table(spark, d, "lineitem").groupBy(F.col("l_quantity").cast("int").alias("q")).count()  # fifty rows
    w = Window.orderBy("q")
    p = h.select("q", (F.col("count") / F.sum("count").over(Window.partitionBy())).alias("p"))
    return p.select("q", F.round("p", 9).alias("p"), F.round(F.coalesce(F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), 9).alias("below"), F.round(F.abs(1 - F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, 0))), 9).alias("above"))


@query("select o_custkey, string_agg(distinct o_orderpriority, ', ' order by o_orderpriority) as kinds from orders group by o_custkey")
def string_collapse(spark, d):
    return read_table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ", ").alias("kinds"))


@query("select l_orderkey, cast(sum(case when l_returnflag = 'A' then 7 when l_returnflag = 'R' then 3 else 0 end) as bigint) as points, count(distinct case when l_discount > 0.05 then l_suppkey end) as trips, sum(l_quantity) filter (where l_linestatus = 'F') as closed_quantity from lineitem group by l_orderkey having count(*) >= 2")
def drive_points_fold(spark, d):
    x = read_table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.expr("sum(case when l_returnflag = 'A' then 7 when l_returnflag = 'R' then 3 else 0 end)").alias("points"), F.count_distinct(F.when(F.col("l_discount") > 0.05, F.col("l_suppkey"))).alias("trips"), F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))).alias("closed_quantity"), F.count("*").alias("n"))
    return x.where("n >= 2").drop("n")


@query("""select event_id, cast(hour(ts) as integer) * 3600 + cast(minute(ts) as integer) * 60 + cast(second(ts) as integer) as seconds, round_even(value * 2, 0) / 2 as half, round(1 / (1 + exp(-value / 10)), 9) as p, cast(floor(value / 5) * 5 as integer) as band,
round(case when value < 0 then 1.2 * value when value <= 4 then value when value <= 10 then 4 + 0.5 * (value - 4) else 7 end, 6) as yards from events""")
def scalar_functions(spark, d):
    v = F.col("value")
    return read_table(spark, d, "events").select("event_id", S.clock_seconds(F.date_format("ts", "HH:mm:ss")).alias("seconds"), S.half_point(v).alias("half"), F.round(S.logistic(v, 10.0), 9).alias("p"), S.band(v, 5).alias("band"), F.round(S.tiered_yards(v), 6).alias("yards"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(case when l_discount * 9 + 0.05 <= 0.5 then 100 / (l_discount * 9 + 0.05) - 100 else -100 * (l_discount * 9 + 0.05) / (1 - (l_discount * 9 + 0.05)) end, 4) as odds from lineitem")
def american_odds(spark, d):
    return read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(S.american_odds(F.col("l_discount") * 9 + 0.05), 4).alias("odds"))


@query("select a.n_name as a, b.n_name as b, round(2 * 3958.8 * asin(sqrt(power(sin(radians(b.n_nationkey - a.n_nationkey)), 2) + cos(radians(2 * a.n_nationkey)) * cos(radians(2 * b.n_nationkey)) * power(sin(radians((b.n_regionkey - a.n_regionkey) * 5)), 2))), 4) as miles from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")
def haversine(spark, d):
    n = read_table(spark, d, "nation")
    x = R.prefixed(n, "x_").join(R.prefixed(n, "y_"), F.expr("x_n_regionkey = y_n_regionkey and x_n_nationkey < y_n_nationkey"))
    miles = S.haversine_miles(F.col("x_n_nationkey") * 2, F.col("x_n_regionkey") * 10, F.col("y_n_nationkey") * 2, F.col("y_n_regionkey") * 10)
    return x.select(F.col("x_n_name").alias("a"), F.col("y_n_name").alias("b"), F.round(miles, 4).alias("miles"))


@query("select event_id, coalesce(try_cast(json_extract_string(props, '$.k') as integer), 999) as k, coalesce(json_extract_string(props, '$.missing'), 'none') as missing, '{\"k\":' || json_extract_string(props, '$.k') || '}' as again from events")
def json_props_extract(spark, d):
    e = read_table(spark, d, "events")
    return e.select("event_id", json_path("props", "$.k", "int", 999).alias("k"), json_path("props", "$.missing", "string", "none").alias("missing"), F.to_json(F.from_json("props", "k int")).alias("again"))


@query("select event_id, unnest(case when event_id % 3 = 0 then [null] when event_id % 3 = 1 then [event_id] else [event_id, event_id + 1] end) as line from events")
def json_outer_explode(spark, d):
    e = read_table(spark, d, "events").select("event_id", F.expr("case when event_id % 3 = 0 then '[]' when event_id % 3 = 1 then concat('[', event_id, ']') else concat('[', event_id, ',', event_id + 1, ']') end").alias("lines"))
    return json_rows(e, "lines", "array<bigint>").select("event_id", F.col("item").alias("line"))


@query("select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as n_links from pages")
def html_title_and_links(spark, d):
    return read_table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).cast("bigint").alias("n_links"))


@query("select doc_id, regexp_extract(text, '^([A-Z][a-z]+) ([a-z]+)', 1) as lead, regexp_extract(text, '^([A-Z][a-z]+) ([a-z]+)', 2) as second from documents")
def regex_lead_name(spark, d):
    p = "^([A-Z][a-z]+) ([a-z]+)"
    return read_table(spark, d, "documents").select("doc_id", F.regexp_extract("text", p, 1).alias("lead"), F.regexp_extract("text", p, 2).alias("second"))


@query("select doc_id, lang, source from (select doc_id, lang, source, row_number() over (partition by text order by doc_id) as rn from documents) where rn = 1")
def dedup_keep_first(spark, d):
    """The row of the smallest key of each text; texts are told by digest and length, so that none is sorted."""
    row = F.min(F.struct("doc_id", "lang", "source"))
    return read_table(spark, d, "documents").groupBy(F.sha2("text", 256), F.length("text")).agg(row.alias("r")).select("r.*")


@query("select o_custkey as k from orders where o_totalprice > 400000 union select l_suppkey from lineitem where l_quantity = 50")
def union_dedup(spark, d):
    a = read_table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("k"))
    return a.union(read_table(spark, d, "lineitem").where("l_quantity = 50").select("l_suppkey")).distinct()


@query("select c_custkey as k from customer except select o_custkey from orders where o_orderdate >= timestamp '2000-01-01'")
def set_difference(spark, d):
    return read_table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(read_table(spark, d, "orders").where("o_orderdate >= timestamp '2000-01-01'").select("o_custkey"))


@query("with m as (select l_partkey, median(l_discount) as consensus from lineitem group by 1) select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_discount - consensus, 6) as edge from lineitem join m using (l_partkey)")
def consensus_edge(spark, d):
    x = read_table(spark, d, "lineitem")
    return x.join(x.groupBy("l_partkey").agg(F.median("l_discount").alias("consensus")), "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_discount") - F.col("consensus"), 6).alias("edge"))
