"""Queries on ordered repairs, segments and keys in text. Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

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


def _by_user():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


@query("select event_id, user_id, min(value) over (partition by user_id order by ts, event_id rows unbounded preceding) as clamped from events")
def running_min_clamp(spark, d):
    return read_table(spark, d, "events").select("event_id", "user_id", F.min("value").over(_by_user().rowsBetween(Window.unboundedPreceding, 0)).alias("clamped"))


@query("""with x as (select event_id, value, lag(value) over w as before, lead(value) over w as after from events window w as (partition by user_id order by ts, event_id))
select event_id, case when value > before or after > value then 1 else 0 end as anomaly from x""")
def rising_pair_flags(spark, d):
    rises = (F.col("value") > F.lag("value").over(_by_user())) | (F.lead("value").over(_by_user()) > F.col("value"))
    return read_table(spark, d, "events").select("event_id", F.when(rises, 1).otherwise(0).alias("anomaly"))


@query("""with c as (select o_custkey, count(*) as n, avg(o_totalprice) as price from orders group by 1), m as (select median(n) as mn, median(price) as mp from c)
select n > mn as often, price > mp as dear, count(*) as customers, round(avg(c_acctbal), 4) as mean_balance from c join customer on c_custkey = o_custkey cross join m group by 1, 2""")
def median_quadrants(spark, d):
    c = read_table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("price"))
    middle = F.broadcast(c.agg(F.median("n").alias("mn"), F.median("price").alias("mp")))  # one row
    x = c.crossJoin(middle).join(read_table(spark, d, "customer"), F.expr("c_custkey = o_custkey"))
    halves = x.groupBy((F.col("n") > F.col("mn")).alias("often"), (F.col("price") > F.col("mp")).alias("dear"))
    return halves.agg(F.count("*").alias("customers"), F.round(F.avg("c_acctbal"), 4).alias("mean_balance"))


@query("""select case when month(l_shipdate) <= 3 then 'early' when month(l_shipdate) = 12 and l_quantity >= 40 then 'final' when month(l_shipdate) <= 11 then 'middle' else 'late' end as segment,
count(*) as n, round(avg(l_discount - l_tax), 6) as bias, round(stddev_samp(l_discount - l_tax), 6) as spread from lineitem group by 1""")
def named_segments(spark, d):
    month = F.month("l_shipdate")
    name = F.when(month <= 3, "early").when((month == 12) & (F.col("l_quantity") >= 40), "final").when(month <= 11, "middle").otherwise("late")
    gap = F.col("l_discount") - F.col("l_tax")
    return read_table(spark, d, "lineitem").groupBy(name.alias("segment")).agg(F.count("*").alias("n"), F.round(F.avg(gap), 6).alias("bias"), F.round(F.stddev_samp(gap), 6).alias("spread"))


@query("select o_orderkey, coalesce(try_cast(regexp_extract(o_orderpriority, '([0-9]+)', 1) as int), 999) as natural_key from orders")
def natural_order_key(spark, d):
    digits = F.regexp_extract("o_orderpriority", "([0-9]+)", 1)
    return read_table(spark, d, "orders").select("o_orderkey", F.coalesce(digits.try_cast("int"), F.lit(999)).alias("natural_key"))


@query("""with x as (select l_orderkey, cast(l_suppkey as varchar) as k from lineitem group by 1, 2), f as (select l_orderkey, min(k) as id from x group by 1)
select x.l_orderkey, s_suppkey, s_nationkey, x.k = f.id as first_listed from x join f using (l_orderkey) join supplier on s_suppkey = cast(x.k as bigint)""")
def stringified_list_bridge(spark, d):
    """Lists that were stored as text, as ['7', '12'], read back as lists; which of its entries comes first."""
    ids = F.concat(F.lit("['"), F.array_join(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))), "', '"), F.lit("']"))
    x = read_table(spark, d, "lineitem").groupBy("l_orderkey").agg(ids.alias("ids"))
    parsed = F.from_json("ids", "array<string>", {"allowSingleQuotes": "true"})
    y = x.select("l_orderkey", F.posexplode(parsed).alias("place", "id"))
    return y.join(read_table(spark, d, "supplier"), F.expr("s_suppkey = cast(id as bigint)")).select("l_orderkey", "s_suppkey", "s_nationkey", (F.col("place") == 0).alias("first_listed"))


@query("""select l_orderkey, '{"lines":' || count(*) || ',"suppliers":' || count(distinct l_suppkey) || '}' as summary from lineitem group by 1""")
def json_summary_column(spark, d):
    counts = F.struct(F.count("*").alias("lines"), F.count_distinct("l_suppkey").alias("suppliers"))
    return read_table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.to_json(counts).alias("summary"))


@query("""select o_orderkey, o_custkey from (select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by md5('42:' || o_orderkey), o_orderkey) as rn from orders) where rn <= 3""")
def seeded_sample_per_group(spark, d):
    """A sampling operator: three orders of each customer, by a seeded hash."""
    w = Window.partitionBy("o_custkey").orderBy(F.md5(F.concat(F.lit("42:"), F.col("o_orderkey").cast("string"))), "o_orderkey")
    return read_table(spark, d, "orders").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("o_orderkey", "o_custkey")
