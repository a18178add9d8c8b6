"""Queries on results, order, lookups, splits and talent: what the other parts leave to be completed."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomfield.functions import scalars as S
from loomfield.operators import relational as R
from loomfield.sources.tables import read_table, scratch_path, stored, write_guarded

QUERIES: dict = {}
SQL: dict = {}

#: A tie's chance before all three outcomes are scaled to one, preferred segments, how many make a roster's top.
TIE_CHANCE = 0.05
PREFERRED = ("BUILDING", "MACHINERY")
TOP_FEW = 4
HOLDOUT = 200


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_GAMES = "g as (select o_orderkey as game, year(o_orderdate) as season, o_custkey % 20 as home, 20 + o_orderkey % 20 as away, cast(floor(o_totalprice / 1000) as integer) % 40 as hs, cast(o_custkey % 40 as integer) as vs from orders)"


def _games(spark, d):
    return read_table(spark, d, "orders").select(
        F.col("o_orderkey").alias("game"), F.year("o_orderdate").alias("season"), (F.col("o_custkey") % 20).alias("home"), (20 + F.col("o_orderkey") % 20).alias("away"),
        (F.floor(F.col("o_totalprice") / 1000).cast("int") % 40).alias("hs"), (F.col("o_custkey") % 40).cast("int").alias("vs"),
    )


@query(f"""with {_GAMES}, t as (select game, season, home as team, home, away, hs - vs as margin from g union all select game, season, away, home, away, vs - hs from g), o as (select *, case when team = home then away else home end as opponent from t)
select team, season, count(*) as games, count(distinct opponent) as opponents, count(*) filter (where margin > 0) as wins, count(*) filter (where margin < 0) as losses, count(*) filter (where margin = 0) as ties, round((count(*) filter (where margin > 0) + 0.5 * count(*) filter (where margin = 0)) / count(*), 6) as win_share from o group by all""")
def team_records(spark, d):
    """Two rows a game, the other side as the opponent; wins, losses and ties of a team's season, a tie as half a win."""
    g = _games(spark, d)
    sides = F.explode(F.array(F.struct(F.col("home").alias("team"), (F.col("hs") - F.col("vs")).alias("margin")), F.struct(F.col("away").alias("team"), (F.col("vs") - F.col("hs")).alias("margin"))))
    x = g.select("season", "home", "away", sides.alias("t")).select("season", "t.team", "t.margin", F.when(F.col("t.team") == F.col("home"), F.col("away")).otherwise(F.col("home")).alias("opponent"))
    n = lambda c: F.count(F.when(c, 1))
    m = F.col("margin")
    return x.groupBy("team", "season").agg(
        F.count("*").alias("games"), F.count_distinct("opponent").alias("opponents"), n(m > 0).alias("wins"), n(m < 0).alias("losses"), n(m == 0).alias("ties"), F.round((n(m > 0) + 0.5 * n(m == 0)) / F.count("*"), 6).alias("win_share")
    )


@query("""select p_brand, count(*) as count, round(avg(p_retailprice), 6) as mean, round(stddev_samp(p_retailprice), 6) as std, min(p_retailprice) as min, round(quantile_cont(p_retailprice, 0.25), 6) as q25, round(quantile_cont(p_retailprice, 0.5), 6) as q50, round(quantile_cont(p_retailprice, 0.75), 6) as q75, max(p_retailprice) as max from part group by 1""")
def describe_by_group(spark, d):
    v = F.col("p_retailprice")
    q = lambda s, n: F.round(F.percentile(v, s), 6).alias(n)
    return read_table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("count"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 6).alias("std"), F.min(v).alias("min"), q(0.25, "q25"), q(0.5, "q50"), q(0.75, "q75"), F.max(v).alias("max"))


@query("""with x as (select cast(l_quantity as integer) - 25 as margin, power(0.5, (2001 - year(l_shipdate)) / 2.0) as w from lineitem), h as (select margin, sum(w) as w, count(*) as n from x group by 1), g as (select unnest(range(-30, 31)) as m)
select cast(m as integer) as m, coalesce(n, 0) as n, round(coalesce(w, 0) / (select sum(w) from h), 9) as share from g left join h on margin = m""")
def weighted_histogram(spark, d):
    """Margins on a whole grid, each weighing by its age."""
    w = F.pow(F.lit(0.5), (2001 - F.year("l_shipdate")) / 2.0)
    h = read_table(spark, d, "lineitem").select((F.col("l_quantity").cast("int") - 25).alias("margin"), w.alias("w")).groupBy("margin").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
    total = h.agg(F.sum("w").alias("t"))  # one row
    g = spark.range(-30, 31).select(F.col("id").cast("int").alias("m"))
    return g.join(F.broadcast(h), F.col("m") == F.col("margin"), "left").crossJoin(F.broadcast(total)).select("m", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("w", F.lit(0.0)) / F.col("t"), 9).alias("share"))


@query("""with x as (select o_orderkey, nullif(o_custkey % 7, 0) as k, o_totalprice from orders), n as (select *, row_number() over (order by k nulls last, o_orderkey) as place from x)
select o_orderkey, place, lead(o_totalprice) over (order by place) - o_totalprice as step from n""")
def stable_order_and_next_row(spark, d):
    """A stable sort by a key that is sometimes missing (those last), and the step to the next row of the whole file, no matter
    where a partition ends."""
    x = read_table(spark, d, "orders").select("o_orderkey", F.nullif(F.col("o_custkey") % 7, F.lit(0)).alias("k"), "o_totalprice")
    n = R.ordered_numbers(x, [F.col("k").asc_nulls_last(), F.col("o_orderkey").asc()], "place", lambda df: stored(df, "order"))
    after = n.select((F.col("place") - 1).alias("place"), F.col("o_totalprice").alias("after"))
    return n.join(after, "place", "left").select("o_orderkey", "place", (F.col("after") - F.col("o_totalprice")).alias("step"))


@query("""with c as (select p_size // 10 * 10 as gs, floor(p_retailprice / 100) * 100 as gp, avg(p_retailprice) as v from part group by all), s as (select distinct gs from c), p as (select distinct gp from c), x as (select p_partkey, p_size + p_partkey % 3 as size, p_retailprice + p_partkey % 50 as price from part),
n as (select p_partkey, (select arg_min(gs, abs(gs - size) * 1000 + gs) from s) as gs, (select arg_min(gp, abs(gp - price) * 100000 + gp) from p) as gp from x)
select p_partkey, cast(n.gs as integer) as size_cell, cast(n.gp as double) as price_cell, round(v, 6) as value from n left join c on c.gs = n.gs and c.gp = n.gp""")
def nearest_cell(spark, d):
    """Each part's nearest cell of a table in two dimensions, and what the table holds there, if anything."""
    p = read_table(spark, d, "part")
    cells = p.groupBy((F.floor(F.col("p_size") / 10) * 10).cast("int").alias("size_cell"), (F.floor(F.col("p_retailprice") / 100) * 100).cast("double").alias("price_cell")).agg(F.avg("p_retailprice").alias("v"))
    x = p.select("p_partkey", (F.col("p_size") + F.col("p_partkey") % 3).alias("size"), (F.col("p_retailprice") + F.col("p_partkey") % 50).alias("price"))

    def nearest(x, value, cell):
        """The grid of one dimension has few values; the array of them is searched, ties to the smaller one."""
        grid = cells.agg(F.array_sort(F.collect_set(cell)).alias("grid"))
        gap = F.array_min(F.transform("grid", lambda g: F.struct(F.abs(g - F.col(value)).alias("gap"), g.alias("at"))))
        return x.crossJoin(F.broadcast(grid)).withColumn(cell, gap["at"]).drop("grid")

    x = nearest(nearest(x, "size", "size_cell"), "price", "price_cell")
    return x.join(cells, ["size_cell", "price_cell"], "left").select("p_partkey", "size_cell", "price_cell", F.round("v", 6).alias("value"))


@query("""select c_nationkey, arg_min(c_custkey, (case c_mktsegment when 'BUILDING' then 0 when 'MACHINERY' then 1 else 2 end, c_custkey)) as chosen, bool_or(c_mktsegment = 'BUILDING') as preferred from customer group by 1""")
def preferred_lookup(spark, d):
    """One customer a nation: of the preferred segment if there is one, then of the next, the first of several."""
    seg = F.col("c_mktsegment")
    rank = F.when(seg == PREFERRED[0], 0).when(seg == PREFERRED[1], 1).otherwise(2)
    return read_table(spark, d, "customer").groupBy("c_nationkey").agg(F.min_by("c_custkey", F.struct(rank, "c_custkey")).alias("chosen"), F.bool_or(seg == PREFERRED[0]).alias("preferred"))


@query("select c_nationkey as nation from customer where c_acctbal > 9000 intersect select s_nationkey from supplier where s_acctbal > 5000")
def shared_keys(spark, d):
    rich = read_table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation"))
    return rich.intersect(read_table(spark, d, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


@query("""with x as (select o_custkey as team, cast(sum(case when o_orderstatus = 'F' then 1 else 0 end) as double) as a, cast(sum(case when o_orderstatus = 'O' then 1 else 0 end) as double) as b from orders group by 1)
select team, case when b = 0 and a = 0 then 0.0 when b = 0 then 0.0 else round(a / b, 6) end as ratio, b = 0 and a > 0 as endless from x""")
def ratio_keeps_infinity(spark, d):
    """Nothing over nothing is the default; something over nothing stays infinite, and says so."""
    x = read_table(spark, d, "orders").groupBy(F.col("o_custkey").alias("team")).agg(F.sum(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("a"), F.sum(F.when(F.col("o_orderstatus") == "O", 1.0).otherwise(0.0)).alias("b"))
    ratio = F.when(F.col("b") != 0, F.col("a") / F.col("b")).when(F.col("a") == 0, 0.0).otherwise(F.col("a") * F.lit(float("inf")))
    x = x.withColumn("ratio", ratio)
    endless = F.abs("ratio") == float("inf")
    return x.select("team", F.when(endless, 0.0).otherwise(F.round("ratio", 6)).alias("ratio"), endless.alias("endless"))


@query(f"""with {_GAMES}, p as (select game, -(hs - vs) as spread, 1 / (1 + exp(-(hs - vs) / 10.0)) as w from g), t as (select game, spread, w, 1 - w as l, {TIE_CHANCE} as t from p)
select game, spread, round(w / (w + l + t), 9) as p_home, round(l / (w + l + t), 9) as p_away, round(t / (w + l + t), 9) as p_tie, round(-spread - cast(game % 21 as integer) + 10, 6) as edge from t""")
def outcome_chances(spark, d):
    """Chances of three outcomes scaled to one; a spread is the margin with its sign turned, an edge the margin over the market's."""
    x = _games(spark, d).select("game", (-(F.col("hs") - F.col("vs"))).alias("spread"), (1 / (1 + F.exp(-(F.col("hs") - F.col("vs")) / 10.0))).alias("w"))
    whole = F.col("w") + (1 - F.col("w")) + TIE_CHANCE
    nine = lambda c, n: F.round(c / whole, 9).alias(n)
    return x.select("game", "spread", nine(F.col("w"), "p_home"), nine(1 - F.col("w"), "p_away"), nine(F.lit(TIE_CHANCE), "p_tie"), (-F.col("spread") - (F.col("game") % 21).cast("int") + 10).cast("double").alias("edge"))


@query("""with x as (select c_custkey, 1992 + cast(c_custkey % 8 as integer) as season, case when c_custkey % 5 > 0 then 1988 + cast(c_custkey % 11 as integer) end as recruited, cast(c_custkey % 4 as integer) + 1 as roster_year from customer)
select c_custkey, case when season - recruited + 1 between 1 and 6 then season - recruited + 1 else roster_year end as class_year from x""")
def class_year_with_fallback(spark, d):
    """The year in school from the recruiting class where that is 1 to 6, else the roster's."""
    x = read_table(spark, d, "customer").select("c_custkey", (1992 + F.col("c_custkey") % 8).alias("season"), F.when(F.col("c_custkey") % 5 > 0, 1988 + F.col("c_custkey") % 11).alias("recruited"), (F.col("c_custkey") % 4 + 1).alias("roster_year"))
    year = F.col("season") - F.col("recruited") + 1
    return x.select("c_custkey", F.when(year.between(1, 6), year).otherwise(F.col("roster_year")).cast("int").alias("class_year"))


@query(f"""with x as (select year(o_orderdate) as season, c_acctbal / 1000 as a, o_totalprice / 10000 + c_acctbal / 2000 as y, (o_orderkey * 7919 + 17) % 1000 < {HOLDOUT} as held from orders join customer on o_custkey = c_custkey), f as (select season, regr_slope(y, a) as s, regr_intercept(y, a) as i from x where not held group by 1)
select cast(x.season as integer) as season, round(any_value(s), 6) as slope, count(*) filter (where held) as held_rows, round(corr(y, s * a + i) filter (where held), 6) as holdout_r, round(avg(abs(y - s * a - i)) filter (where held), 6) as holdout_mae from x join f using (season) group by x.season""")
def holdout_by_season(spark, d):
    """A seeded fifth of each season is held out; a slope fitted on the rest is judged on it."""
    o = read_table(spark, d, "orders").join(read_table(spark, d, "customer").select("c_custkey", "c_acctbal"), F.expr("o_custkey = c_custkey"))
    x = o.select(F.year("o_orderdate").alias("season"), (F.col("c_acctbal") / 1000).alias("a"), (F.col("o_totalprice") / 10000 + F.col("c_acctbal") / 2000).alias("y"), ((F.col("o_orderkey") * 7919 + 17) % 1000 < HOLDOUT).alias("held"))
    f = x.where("not held").groupBy("season").agg(F.regr_slope("y", "a").alias("s"), F.regr_intercept("y", "a").alias("i"))  # a row a season
    t = x.join(F.broadcast(f), "season").where("held").withColumn("p", F.expr("s * a + i"))
    return t.groupBy("season").agg(F.round(F.first("s"), 6).alias("slope"), F.count("*").alias("held_rows"), F.round(F.corr("y", "p"), 6).alias("holdout_r"), F.round(F.avg(F.abs(F.col("y") - F.col("p"))), 6).alias("holdout_mae"))


@query("""with g as (select o_custkey, year(o_orderdate) as y, avg(o_totalprice) as v, count(*) as n from orders group by all), j as (select a.v as target, a.v + a.n as same, b.v as before from g a join g b on a.o_custkey = b.o_custkey and a.y = b.y + 1)
select count(*) as pairs, round(corr(same, target), 6) as r_same, round(corr(before, target), 6) as r_before, corr(same, target) > corr(before, target) + 0.2 as suspect from j""")
def leakage_check(spark, d):
    """A feature that tells its own season far better than the season before does is suspect."""
    g = read_table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.avg("o_totalprice").alias("v"), F.count("*").alias("n"))
    j = g.select("o_custkey", "y", F.col("v").alias("target"), (F.col("v") + F.col("n")).alias("same")).join(g.select("o_custkey", (F.col("y") + 1).alias("y"), F.col("v").alias("before")), ["o_custkey", "y"])
    r = lambda c: F.corr(c, "target")
    return j.agg(F.count("*").alias("pairs"), F.round(r("same"), 6).alias("r_same"), F.round(r("before"), 6).alias("r_before"), (r("same") > r("before") + 0.2).alias("suspect"))


@query("""with s as (select year(o_orderdate) as season, min(cast(o_orderdate as date)) as lo, max(cast(o_orderdate as date)) as hi from orders group by 1), w as (select season, lo, hi, unnest(range(0, date_diff('day', lo, hi) // 7 + 1)) as k from s)
select cast(season as integer) as season, cast(k + 1 as integer) as week, cast(lo + cast(k * 7 as integer) as varchar) as first_day, cast(least(lo + cast(k * 7 + 6 as integer), hi) as varchar) as last_day, 'games?days=' || strftime(lo + cast(k * 7 as integer), '%Y%m%d') || '-' || strftime(least(lo + cast(k * 7 + 6 as integer), hi), '%Y%m%d') || '&most=500' as request from w""")
def weekly_windows(spark, d):
    """Windows of seven days over each season, the last one cut, and the request that each makes."""
    s = read_table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("season")).agg(F.min(F.to_date("o_orderdate")).alias("lo"), F.max(F.to_date("o_orderdate")).alias("hi"))
    w = s.select("season", "hi", F.posexplode(F.sequence("lo", "hi", F.expr("interval 7 days"))).alias("k", "first"))
    last = F.least(F.date_add("first", 6), F.col("hi"))
    day = lambda c: F.date_format(c, "yyyyMMdd")
    return w.select("season", (F.col("k") + 1).alias("week"), F.col("first").cast("string").alias("first_day"), last.cast("string").alias("last_day"), F.concat(F.lit("games?days="), day("first"), F.lit("-"), day(last), F.lit("&most=500")).alias("request"))


@query(r"""with r as (select page_id, unnest(list_slice(string_split(html, '<li>'), 2, 1000000)) as r, unnest(range(1, len(string_split(html, '<li>')))) as place from pages)
select page_id, cast(place as integer) as place, regexp_extract(r, 'href="([^"]*)"', 1) as link, regexp_replace(split_part(r, '</li>', 1), '<[^>]*>', '', 'g') as label from r""")
def html_rows(spark, d):
    """A list in a page as a table: split at its rows' tags, then each row's link and label without tags."""
    rows = F.split("html", "<li>")
    x = read_table(spark, d, "pages").select("page_id", F.posexplode(rows).alias("place", "r")).where("place > 0")
    return x.select("page_id", "place", F.regexp_extract("r", 'href="([^"]*)"', 1).alias("link"), F.regexp_replace(F.get(F.split("r", "</li>"), F.lit(0)), "<[^>]*>", "").alias("label"))


@query(f"""with x as (select c_nationkey as team, 1995 + c_custkey % 4 as season, case c_custkey % 3 when 0 then 'line' when 1 then 'back' else 'end' end as kind, c_acctbal / 10007 as rating, c_acctbal >= 6000 as blue from customer),
r as (select team, season, count(*) as linked, avg(case when blue then 1.0 else 0.0 end) as chips, avg(rating) filter (where kind = 'line') as line, avg(rating) filter (where kind = 'back') as back, max(rating) filter (where kind = 'end') as best_end, (select avg(v) from (select unnest(list_slice(list_reverse_sort(list(rating)), 1, {TOP_FEW})) as v)) as top from x group by all)
select cast(team as integer) as team, cast(season as integer) as season, linked, round(chips, 6) as chips, round(line, 6) as line, round(back, 6) as back, round(best_end, 6) as best_end, round(top, 6) as top, round((rank() over (partition by season order by round(top, 9)) + (count(*) over (partition by season, round(top, 9)) - 1) / 2.0) / count(*) over (partition by season), 6) as top_share from r""")
def roster_talent(spark, d):
    """A roster's share of blue chips, its groups' means, the best of one group, the mean of its top few, ranked within the season."""
    c = read_table(spark, d, "customer")
    kind = F.when(F.col("c_custkey") % 3 == 0, "line").when(F.col("c_custkey") % 3 == 1, "back").otherwise("end")
    x = c.select(F.col("c_nationkey").alias("team"), (1995 + F.col("c_custkey") % 4).cast("int").alias("season"), kind.alias("kind"), (F.col("c_acctbal") / 10007).alias("rating"), (F.col("c_acctbal") >= 6000).alias("blue"), "c_custkey")
    keys = ["team", "season"]
    best = x.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("rating").desc(), "c_custkey"))).where(F.col("n") <= TOP_FEW)
    top = best.groupBy(*keys).agg(F.round(F.avg("rating"), 9).alias("top"))
    mean = lambda k: F.round(F.avg(F.when(F.col("kind") == k, F.col("rating"))), 6)
    r = x.groupBy(*keys).agg(F.count("*").alias("linked"), F.round(F.avg(F.when(F.col("blue"), 1.0).otherwise(0.0)), 6).alias("chips"), mean("line").alias("line"), mean("back").alias("back"), F.round(F.max(F.when(F.col("kind") == "end", F.col("rating"))), 6).alias("best_end"))
    ranked = R.with_ranks(top, ["season"], "top").select(*keys, F.round("top", 6).alias("top"), F.round(F.col("_mean_rank") / F.col("_n"), 6).alias("top_share"))
    return r.join(ranked, keys)


@query("""with b as (select l_partkey as game, l_linenumber % 4 as book, avg(l_discount * 100) as spread from lineitem group by all), m as (select game, median(spread) as consensus, count(*) as books, max(spread) - min(spread) as spread_gap from b group by 1)
select game, round(consensus, 6) as consensus, books, round(spread_gap, 6) as disagreement, round(avg(p_size) / 10 - any_value(consensus), 6) as edge, any_value(case when books >= 3 and spread_gap <= 3 then 'firm' when books >= 2 then 'loose' else 'single' end) as quality from m join part on p_partkey = game group by game, consensus, books, spread_gap""")
def market_consensus(spark, d):
    """Books' medians for every game, how far they disagree, and the model's edge over them."""
    x = read_table(spark, d, "lineitem").select(F.col("l_partkey").alias("game"), (F.col("l_linenumber") % 4).alias("book"), (F.col("l_discount") * 100).alias("spread"), F.struct("_metadata.file_path", "_metadata.row_index").alias("at"))
    # a gap of exactly the limit hangs on the last digit of a mean: a book's few lines are added in the table's order, however they are dealt
    kept = F.array_sort(F.collect_list(F.when(F.col("spread").isNotNull(), F.struct("at", "spread"))))
    b = x.groupBy("game", "book").agg(kept.alias("kept")).withColumn("spread", F.try_divide(F.aggregate("kept", F.lit(0.0), lambda a, c: a + c["spread"]), F.size("kept")))
    m = b.groupBy("game").agg(F.median("spread").alias("consensus"), F.count("*").alias("books"), (F.max("spread") - F.min("spread")).alias("gap"))
    x = m.join(read_table(spark, d, "part").groupBy(F.col("p_partkey").alias("game")).agg(F.avg("p_size").alias("p_size")), "game")  # a part may be there twice
    quality = F.when((F.col("books") >= 3) & (F.col("gap") <= 3), "firm").when(F.col("books") >= 2, "loose").otherwise("single")
    return x.select("game", F.round("consensus", 6).alias("consensus"), "books", F.round("gap", 6).alias("disagreement"), F.round(F.col("p_size") / 10 - F.col("consensus"), 6).alias("edge"), quality.alias("quality"))


@query("select s_suppkey, s_nationkey, round(s_acctbal, 2) as balance from supplier")
def guarded_export(spark, d):
    """Suppliers written only if there are as many as a full export has, and read back from there."""
    x = read_table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.round("s_acctbal", 2).alias("balance"))
    path = scratch_path(spark, "export")
    write_guarded(x, path, read_table(spark, d, "nation").select("n_nationkey").distinct().count() // 5)
    return spark.read.schema(x.schema).parquet(path)


@query("""with x as (select s_suppkey, s_name || ' ' || chr(192 + cast(s_suppkey % 6 as integer)) || chr(232) || 'B-' || chr(255) || chr(241) || ' Neil' as name from supplier)
select s_suppkey, regexp_replace(lower(strip_accents(name)), '[^a-z]+', '', 'g') as key from x""")
def accent_free_keys(spark, d):
    """Names as keys of plain letters, whatever accents they carry."""
    name = F.concat("s_name", F.lit(" "), F.expr("char(192 + s_suppkey % 6)"), F.lit("\u00e8B-\u00ff\u00f1 Neil"))
    return read_table(spark, d, "supplier").select("s_suppkey", S.letters_only(name).alias("key"))


@query()
def closest_name_by_ratio(spark, d):
    """The known type closest to a mistyped one by matching blocks, null where none is close; each distinct word is matched once."""
    p = read_table(spark, d, "part").select("p_partkey", F.expr("concat(left(p_type, 2), substr(p_type, 4), 'x')").alias("typed"), "p_type")
    known = sorted(r[0] for r in p.select("p_type").distinct().limit(1000).collect())  # types are a handful
    typed = p.select("typed").distinct().withColumn("suggestion", S.closest_by_ratio(known)("typed"))
    return p.join(typed, "typed").select("p_partkey", "typed", "suggestion")


@query("""with l as (select l_orderkey, sum(case when l_linenumber % 4 = 1 then l_quantity end) as q1, sum(case when l_linenumber % 4 = 2 then l_quantity end) as q2, sum(case when l_linenumber % 4 = 3 then l_quantity end) as q3, sum(case when l_linenumber % 4 = 0 then l_quantity end) as q4, sum(l_quantity) as total from lineitem group by 1)
select o_orderkey as game, cast(year(o_orderdate) as integer) as season, case o_orderstatus when 'F' then 'STATUS_FINAL' else 'STATUS_SCHEDULED' end as status, cast(o_custkey % 20 as bigint) as home_team, cast(20 + o_orderkey % 20 as bigint) as away_team, cast(coalesce(total, 0) as integer) as home_score, cast(o_custkey % 40 as integer) as away_score,
cast(coalesce(q1, 999) as integer) as home_q1, cast(coalesce(q2, 999) as integer) as home_q2, cast(coalesce(q3, 999) as integer) as home_q3, cast(coalesce(q4, 999) as integer) as home_q4 from orders left join l on l_orderkey = o_orderkey""")
def games_from_responses(spark, d):
    """Scoreboard responses, one JSON text of a day's games by hundreds, flattened to a row a game; a missing quarter is 999."""
    q = lambda k: F.sum(F.when(F.col("l_linenumber") % 4 == k % 4, F.col("l_quantity"))).cast("int").alias(f"q{k}")
    lines = read_table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(*(q(k) for k in (1, 2, 3, 4)), F.sum("l_quantity").cast("int").alias("total"))
    o = read_table(spark, d, "orders").join(lines, "o_orderkey", "left")
    quarters = F.array_compact(F.array(*(F.when(F.col(f"q{k}").isNotNull(), F.struct(F.lit(k).alias("period"), F.col(f"q{k}").alias("value"))) for k in (1, 2, 3, 4))))
    side = lambda team, score, which, lines: F.struct(team.cast("bigint").alias("id"), F.lit(which).alias("homeAway"), score.cast("int").alias("score"), lines.alias("linescores"))
    none = F.array_compact(F.array(F.lit(None).cast("struct<period:int,value:int>")))
    game = F.struct(
        F.col("o_orderkey").alias("id"), F.struct(F.year("o_orderdate").alias("year")).alias("season"), F.struct(F.struct(F.when(F.col("o_orderstatus") == "F", "STATUS_FINAL").otherwise("STATUS_SCHEDULED").alias("name")).alias("type")).alias("status"),
        F.array(F.struct(F.array(side(F.col("o_custkey") % 20, F.coalesce("total", F.lit(0)), "home", quarters), side(20 + F.col("o_orderkey") % 20, F.col("o_custkey") % 40, "away", none)).alias("competitors"))).alias("competitions"),
    )
    responses = o.groupBy(F.to_date("o_orderdate").alias("day"), F.floor(F.col("o_orderkey") / 100)).agg(F.to_json(F.struct(F.collect_list(game).alias("events"))).alias("json"))
    team = "struct<id:bigint,homeAway:string,score:int,linescores:array<struct<period:int,value:int>>>"
    kind = f"struct<events:array<struct<id:bigint,season:struct<year:int>,status:struct<type:struct<name:string>>,competitions:array<struct<competitors:array<{team}>>>>>>"
    e = responses.select(F.explode(F.from_json("json", kind)["events"]).alias("e"))
    who = lambda side: F.get(F.filter(F.get(F.col("e.competitions"), F.lit(0))["competitors"], lambda c: c["homeAway"] == side), F.lit(0))
    x = e.select("e", who("home").alias("h"), who("away").alias("a"))
    quarter = lambda k: F.coalesce(F.get(F.filter("h.linescores", lambda s: s["period"] == k), F.lit(0))["value"], F.lit(999)).alias(f"home_q{k}")
    return x.select(F.col("e.id").alias("game"), F.col("e.season.year").alias("season"), F.col("e.status.type.name").alias("status"), F.col("h.id").alias("home_team"), F.col("a.id").alias("away_team"), F.col("h.score").alias("home_score"), F.col("a.score").alias("away_score"), *(quarter(k) for k in (1, 2, 3, 4)))
