"""Queries end to end: point-in-time matrices, stored scalers, players' production, rooms and shared credit."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomfield.operators import matrix as X
from loomfield.operators import rooms
from loomfield.operators.ridge import ridge_ratings
from loomfield.sources.catalogue import Catalogue, fit_scaler, scaled
from loomfield.sources.tables import read_table, scratch_path

QUERIES: dict = {}
SQL: dict = {}

#: Weights of the last three seasons, first week of adjusted form, decay of a season, strength of a prior, places.
LAG_WEIGHTS = [4.0, 2.0, 1.0]
FIRST_ADJUSTED_WEEK = 5
SEASON_DECAY = 0.6
PRIOR_EVENTS = 6.0
PLACES = {0: 4, 1: 3, 2: 2}
KIND_WEIGHTS = {0: 0.5, 1: 0.3, 2: 0.2}
COVERAGE_SLOTS, LEAST_TACKLES = 5, 10


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_GAMES = """g as (select o_orderkey as game, year(o_orderdate) as season, (dayofyear(o_orderdate) - 1) // 23 + 1 as wk, o_custkey % 50 as home, 50 + o_orderkey % 50 as away, o_totalprice / 1001 as hv, o_custkey / 97 as av from orders),
t as (select home as entity, season, wk, hv as v from g union all select away, season, wk, av from g), w as (select entity, season, wk, sum(v) as s, count(*) as n from t group by all)"""


def _games(spark, d):
    """Games of two teams in numbered weeks, and each team's sums by week."""
    week = F.floor((F.dayofyear("o_orderdate") - 1) / 23).cast("int") + 1
    g = read_table(spark, d, "orders").select(
        F.col("o_orderkey").alias("game"), F.year("o_orderdate").alias("season"), week.alias("at"), (F.col("o_custkey") % 50).alias("home"), (F.col("o_orderkey") % 50 + 50).alias("away"), (F.col("o_totalprice") / 1001).alias("hv"), (F.col("o_custkey") / 97).alias("av")
    )
    side = lambda team, v: g.select(F.col(team).alias("entity"), "season", "at", F.col(v).alias("v"))
    return g, side("home", "hv").unionByName(side("away", "av")).groupBy("entity", "season", "at").agg(F.sum("v").alias("s"), F.count("*").alias("n"))


@query(f"""with {_GAMES}, c as (select entity, season, wk, sum(s) over (partition by entity, season order by wk) / sum(n) over (partition by entity, season order by wk) as form from w),
l as (select season, wk, sum(s) over (partition by season order by wk) / sum(n) over (partition by season order by wk) as league from (select season, wk, sum(s) as s, sum(n) as n from w group by all)),
a as (select c.*, form - league as adj from c join l using (season, wk)), p as (select entity, season, sum(s) / sum(n) as prior from w group by all),
x as (select game, home as entity, season, wk, 'home' as side from g union all select game, away, season, wk, 'away' from g),
f as (select x.game, x.side, a.form, case when x.wk >= {FIRST_ADJUSTED_WEEK} then a.adj end as adj, p.prior from x asof left join a on x.entity = a.entity and x.season = a.season and x.wk > a.wk asof left join p on x.entity = p.entity and x.season > p.season)
select game, round(max(form) filter (side = 'home'), 6) as home_form, round(max(form) filter (side = 'away'), 6) as away_form, round(max(adj) filter (side = 'home'), 6) as home_adjusted, round(max(adj) filter (side = 'away'), 6) as away_adjusted, round(max(prior) filter (side = 'home'), 6) as home_prior, round(max(prior) filter (side = 'away'), 6) as away_prior
from f group by game having home_form is not null and away_form is not null""")
def in_season_matrix(spark, d):
    """Both teams' form, adjusted form (withheld early in a season) and last season, as they stood before each game."""
    g, w = _games(spark, d)
    run = Window.partitionBy("entity", "season").orderBy("at")
    form = w.select("entity", "season", "at", (F.sum("s").over(run) / F.sum("n").over(run)).alias("form"))
    league = w.groupBy("season", "at").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))  # a row a week
    upto = Window.partitionBy("season").orderBy("at")
    league = league.select("season", "at", (F.sum("s").over(upto) / F.sum("n").over(upto)).alias("league"))
    adjusted = form.join(F.broadcast(league), ["season", "at"]).select("entity", "season", "at", (F.col("form") - F.col("league")).alias("adjusted"))
    prior = w.groupBy("entity", "season").agg((F.sum("s") / F.sum("n")).alias("prior")).withColumn("at", F.lit(0))
    families = {"f": X.Family(form, ["form"]), "a": X.Family(adjusted, ["adjusted"], gate=FIRST_ADJUSTED_WEEK), "p": X.Family(prior, ["prior"], scope="before")}
    out = X.two_sided(g, families, key="game", needed=["f_form"])
    return out.select("game", *(F.round(f"{s}_{c[0]}_{c}", 6).alias(f"{s}_{c}") for c in ("form", "adjusted", "prior") for s in ("home", "away")))


@query(f"""with {_GAMES}, p as (select entity, season, sum(s) / sum(n) as v from w group by all), k as (select entity, unnest(range(min(season), (select max(season) from p) + 2)) as season from p group by entity), q as (select k.entity, k.season, v from k left join p using (entity, season)),
r as (select entity, season, lag(v, 1) over (partition by entity order by season) as l1, lag(v, 2) over (partition by entity order by season) as l2, lag(v, 3) over (partition by entity order by season) as l3 from q),
e as (select *, (coalesce(4 * l1, 0) + coalesce(2 * l2, 0) + coalesce(l3, 0)) / nullif(case when l1 is null then 0 else 4 end + case when l2 is null then 0 else 2 end + case when l3 is null then 0 else 1 end, 0) as e from r)
select game, round(h.l1, 6) as home_last, round(a.l1, 6) as away_last, round(h.e - a.e, 6) as decayed_edge from g join e h on h.entity = home and h.season = g.season join e a on a.entity = away and a.season = g.season where h.e is not null and a.e is not null""")
def preseason_matrix(spark, d):
    """What is known of both teams before a season: last season, and the edge of three seasons' decayed means."""
    g, w = _games(spark, d)
    grid = X.lagged_grid(w.groupBy("entity", "season").agg((F.sum("s") / F.sum("n")).alias("v")), "v", 3)
    e = grid.select("entity", "season", "lag1", X.decayed(["lag1", "lag2", "lag3"], LAG_WEIGHTS).alias("e")).where("e is not null")
    side = lambda s: e.select(F.col("entity").alias(s), "season", F.col("lag1").alias(f"{s}_last"), F.col("e").alias(f"{s}_e"))
    x = g.join(side("home"), ["home", "season"]).join(side("away"), ["away", "season"])
    return x.select("game", F.round("home_last", 6).alias("home_last"), F.round("away_last", 6).alias("away_last"), F.round(F.col("home_e") - F.col("away_e"), 6).alias("decayed_edge"))


@query("""with x as (select o_orderkey, o_totalprice / 1000 as price, cast(o_custkey % 97 as double) as cust, 1.0 as flat from orders)
select o_orderkey, round((price - avg(price) over ()) / stddev_pop(price) over (), 6) as price, round((cust - avg(cust) over ()) / stddev_pop(cust) over (), 6) as cust, 0.0 as flat from x""")
def scaled_by_newest(spark, d):
    """Orders scaled by the newest of two stored scalers, whose columns they must have."""
    x = read_table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("price"), (F.col("o_custkey") % 97).cast("double").alias("cust"), F.lit(1.0).alias("flat"))
    columns = ["price", "cust", "flat"]
    models = Catalogue(spark, scratch_path(spark, "models"))
    models.save("scaler", columns, fit_scaler(x.where("cust < 10"), columns))
    models.save("scaler", columns, fit_scaler(x, columns))
    return scaled(x, models.load("scaler"), "o_orderkey").select("o_orderkey", *(F.round(c, 6).alias(c) for c in columns))


_LINES = """x as (select l_suppkey as team, year(l_shipdate) as season, p_partkey as player, p_size % 3 as kind, p_brand as opponent, l_quantity as q, l_discount as disc, case when p_partkey % 4 > 0 then p_retailprice / 50 end as rating from lineitem join part on p_partkey = l_partkey)"""


def _lines(spark, d):
    x = read_table(spark, d, "lineitem").join(read_table(spark, d, "part"), F.expr("p_partkey = l_partkey"))
    return x.select(
        F.col("l_suppkey").alias("team"), F.year("l_shipdate").alias("season"), F.col("p_partkey").alias("player"), (F.col("p_size") % 3).alias("kind"), F.col("p_brand").alias("opponent"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("disc"),
        F.when(F.col("p_partkey") % 4 > 0, F.col("p_retailprice") / 50).alias("rating"),
    )


@query(f"""with {_LINES}, c as (select player, season, opponent, kind, sum(q) as s, count(*) as n from x group by all), o as (select season, kind, sum(s) / sum(n) as allowed from c group by all), z as (select season, (avg(allowed)) as m, stddev_pop(allowed) as sd from o group by season),
f as (select o.season, o.kind, least(greatest(1 + 0.15 * coalesce((m - allowed) / nullif(sd, 0), 0), 0.7), 1.3) as factor from o join z using (season)),
p as (select player, season, sum(s * factor) / sum(n) as v, sum(n) as n from c join f using (season, kind) group by all)
select a.player, cast(a.season as integer) as season, cast(a.n as bigint) as events, round(a.v, 6) as production, round(sum(b.v * b.n * power({SEASON_DECAY}, a.season - b.season)) / sum(b.n * power({SEASON_DECAY}, a.season - b.season)), 6) as career from p a left join p b on a.player = b.player and b.season < a.season group by all""")
def player_production(spark, d):
    """A player's season, each event weighed by how much its kind of opponent allows, and the career strictly before it by
    volume and age."""
    c = _lines(spark, d).groupBy("player", "season", "kind").agg(F.sum("q").alias("s"), F.count("*").alias("n"))
    o = c.groupBy("season", "kind").agg((F.sum("s") / F.sum("n")).alias("allowed"))  # a few rows a season
    z = o.groupBy("season").agg(F.avg("allowed").alias("m"), F.stddev_pop("allowed").alias("sd"))
    factor = F.least(F.greatest(1 + 0.15 * F.coalesce((F.col("m") - F.col("allowed")) / F.nullif(F.col("sd"), F.lit(0.0)), F.lit(0.0)), F.lit(0.7)), F.lit(1.3))
    f = F.broadcast(o.join(z, "season").select("season", "kind", factor.alias("factor")))
    p = c.join(f, ["season", "kind"]).groupBy("player", "season").agg((F.sum(F.col("s") * F.col("factor")) / F.sum("n")).alias("v"), F.sum("n").alias("n"))
    # the season's own power cancels in the ratio, so running sums of a player's seasons do; any year near will do as the base
    age = F.pow(F.lit(SEASON_DECAY), (2000 - F.col("season")).cast("double"))
    before = Window.partitionBy("player").orderBy("season").rowsBetween(Window.unboundedPreceding, -1)
    career = F.sum(F.col("v") * F.col("n") * age).over(before) / F.sum(F.col("n") * age).over(before)
    return p.select("player", "season", F.col("n").alias("events"), F.round("v", 6).alias("production"), F.round(career, 6).alias("career"))


@query(f"""with {_LINES}, p as (select team, season, kind, player, sum(q) / count(*) as record, count(*) as n, max(rating) as rating from x group by all), s as (select *, case when rating is null then record else (record * n + rating * {PRIOR_EVENTS}) / (n + {PRIOR_EVENTS}) end as projected from p),
r as (select *, row_number() over (partition by team, season, kind order by projected desc, player) as place, case kind when 0 then 4 when 1 then 3 else 2 end as places from s qualify place <= places)
select team, cast(season as integer) as season, cast(kind as integer) as kind, count(*) as members, round((sum(projected) + (max(places) - count(*)) * 15.0) / max(places), 6) as rating, cast(min(player) filter (place = 1) as bigint) as best from r group by team, season, kind""")
def position_rooms(spark, d):
    """A team's room of each kind: its best few by records shrunk toward their rating, empty places at replacement level."""
    x = _lines(spark, d).where("team is not null and season is not null and kind is not null")  # others are in no room
    p = x.groupBy("team", "season", "kind", "player").agg((F.sum("q") / F.count("*")).alias("record"), F.count("*").alias("n"), F.max("rating").alias("rating"))
    s = p.withColumn("projected", rooms.shrunk(F.col("record"), F.col("n"), F.col("rating"), PRIOR_EVENTS))
    keys = ["team", "season", "kind"]
    most = rooms.room(s, keys, [F.col("projected").desc(), F.col("player").asc()], max(PLACES.values()))
    places = F.create_map(*(F.lit(v) for pair in PLACES.items() for v in pair))[F.col("kind").cast("int")]
    members = most.withColumn("places", places).where("place <= places")
    best = F.min(F.when(F.col("place") == 1, F.col("player"))).alias("best")
    rated = rooms.room_rating(members, keys, "projected", F.col("places"), 15.0, best)
    return rated.select("team", "season", "kind", "members", F.round("rating", 6).alias("rating"), "best")


@query(f"""with {_LINES}, t as (select team, season, avg(disc) as allowed, count(*) as n from x group by all), l as (select season, sum(allowed * n) / sum(n) as league from t group by season), v as (select team, season, (league - allowed) * n as saved from t join l using (season)),
p as (select team, season, player, sum(q) as tackles from x group by all having sum(q) >= {LEAST_TACKLES}), r as (select * from p qualify row_number() over (partition by team, season order by tackles desc, player) <= {COVERAGE_SLOTS})
select r.team, cast(r.season as integer) as season, r.player, round(saved * tackles / sum(tackles) over (partition by r.team, r.season), 6) as credit from r join v on v.team = r.team and v.season = r.season""")
def coverage_credit(spark, d):
    """What a team allows less than the league, shared by the men who play most, in proportion to their tackles."""
    x = _lines(spark, d)
    t = x.groupBy("team", "season").agg(F.avg("disc").alias("allowed"), F.count("*").alias("n"))
    league = t.groupBy("season").agg((F.sum(F.col("allowed") * F.col("n")) / F.sum("n")).alias("league"))  # a row a season
    saved = t.join(F.broadcast(league), "season").select("team", "season", ((F.col("league") - F.col("allowed")) * F.col("n")).alias("saved"))
    p = x.groupBy("team", "season", "player").agg(F.sum("q").alias("tackles")).where(F.col("tackles") >= LEAST_TACKLES)
    members = rooms.room(p, ["team", "season"], [F.col("tackles").desc(), F.col("player").asc()], COVERAGE_SLOTS).join(saved, ["team", "season"])
    return rooms.shared_credit(members, ["team", "season"], "saved", "tackles").select("team", "season", "player", F.round("credit", 6).alias("credit"))


@query(f"""with {_LINES}, k as (select team, season, kind, player, sum(q) as q from x group by all), n as (select k.*, exists (select 1 from k b where b.team = k.team and b.player = k.player and b.season = k.season + 1) as back from k),
s as (select team, season, kind, sum(q) filter (where back) / sum(q) as share, sum(q) as q from n group by all), w as (select *, case kind when 0 then {KIND_WEIGHTS[0]} when 1 then {KIND_WEIGHTS[1]} else {KIND_WEIGHTS[2]} end as w from s)
select team, cast(season as integer) as season, round(sum(coalesce(share, 0) * w) / sum(w), 6) as returning, round(sum(coalesce(share, 0) * q) / sum(q), 6) as plain from w where season < (select max(season) from x) group by team, season""")
def returning_production(spark, d):
    """What part of a team's production comes back next season: shares by kind, weighed by what a kind is worth, of the kinds there are."""
    k = _lines(spark, d).groupBy("team", "season", "kind", "player").agg(F.sum("q").alias("q"))
    back = k.select("team", (F.col("season") - 1).alias("season"), "player", F.lit(True).alias("back")).distinct()
    s = k.join(back, ["team", "season", "player"], "left").groupBy("team", "season", "kind").agg((F.coalesce(F.sum(F.when(F.col("back"), F.col("q"))), F.lit(0.0)) / F.sum("q")).alias("share"), F.sum("q").alias("q"))
    last = s.agg(F.max("season").alias("last"))  # one row
    weight = F.create_map(*(F.lit(v) for pair in KIND_WEIGHTS.items() for v in pair))[F.col("kind").cast("int")]
    x = s.join(F.broadcast(last), F.col("season") < F.col("last")).withColumn("w", weight)
    return x.groupBy("team", "season").agg(F.round(F.sum(F.col("share") * F.col("w")) / F.sum("w"), 6).alias("returning"), F.round(F.sum(F.col("share") * F.col("q")) / F.sum("q"), 6).alias("plain"))


@query()
def season_summaries_adjusted(spark, d):
    """Teams' means by game and opponent, adjusted for the opponents of each season, beside the plain season mean and its running
    form: summaries, then the adjusted season, then what is known before each week."""
    g, _ = _games(spark, d)
    side = lambda team, other, v: g.select("game", "season", "at", F.col(team).alias("entity"), F.col(other).alias("opponent"), F.col(v).alias("v"))
    rows = side("home", "away", "hv").unionByName(side("away", "home", "av"))
    cells = rows.groupBy("season", "entity", "opponent").agg(F.avg("v").alias("mean"), F.count("*").cast("double").alias("weight"))
    rated = ridge_ratings(cells, "season", 10.0, least_own=4, least_r2=0.0)
    plain = rows.groupBy("season", "entity").agg(F.avg("v").alias("plain"), F.count("*").alias("games"))
    weeks = rows.groupBy("season", "entity", "at").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    before = Window.partitionBy("season", "entity").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    form = weeks.select("season", "entity", "at", (F.sum("s").over(before) / F.sum("n").over(before)).alias("form"))
    out = form.join(plain, ["season", "entity"]).join(rated, ["season", "entity"], "left")
    return out.select("season", "entity", "at", "games", *(F.round(c, 6).alias(c) for c in ("form", "plain", "rating")))
