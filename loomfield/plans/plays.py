"""Queries of the play-by-play chain on the event stream: clocks, repairs, labels, expected points, unit ratings.

A user's events stand for a game's plays in order, a day of them for a half; kinds of events stand for kinds of plays:
purchase and signup score 7 and 3 points, error turns the ball over, view and click are ordinary.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomfield.functions import scalars as S
from loomfield.operators import relational as R
from loomfield.sources.tables import read_table

QUERIES: dict = {}
SQL: dict = {}

#: Points by kind of play, lead that makes a game's quarter garbage time.
POINTS = {"purchase": 7, "signup": 3}
GARBAGE_LEAD = {1: 43, 2: 37, 3: 27, 4: 22}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


_PLAYS = """select event_id, user_id as game, cast(ts as date) as half, event_type as kind, cast(event_id % 4 + 1 as integer) as down,
cast(1 + cast(floor(value) as bigint) % 25 as integer) as distance, cast(1 + (event_id * 7) % 99 as integer) as yards,
cast(900 - (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) % 900 as integer) as clock, cast(1 + hour(ts) // 6 as integer) as period, value from events"""


def plays(spark, d):
    return read_table(spark, d, "events").selectExpr(
        "event_id", "user_id as game", "to_date(ts) as half", "event_type as kind", "cast(event_id % 4 + 1 as int) as down",
        "cast(1 + cast(floor(value) as bigint) % 25 as int) as distance", "cast(1 + (event_id * 7) % 99 as int) as yards",
        "cast(900 - (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) % 900 as int) as clock", "cast(1 + hour(ts) div 6 as int) as period", "value",
    )


def points(kind="kind"):
    return F.coalesce(*(F.when(F.col(kind) == k, v) for k, v in POINTS.items()))


@query(f"""with p as ({_PLAYS}) select event_id, clock + case when period in (1, 3) then 900 else 0 end as half_seconds,
case when clock > 600 then 900 when clock > 300 then 600 when clock > 120 then 300 when clock > 60 then 120 else 60 end as bucket, clock // 30 * 30 as floor_30,
case when yards < 10 then least(distance, yards) else least(distance, 20) end as repaired_distance, case when distance > 20 or (yards < 10 and distance > yards) then 1 else 0 end as repaired,
case when down = 4 and kind not in ('purchase', 'signup') and value < 20 then 1 else 0 end as lost_on_downs, case when (down = 4 and kind not in ('purchase', 'signup') and value < 20) or kind = 'error' then 1 else 0 end as turnover from p where kind not in ('view') and value > 0""")
def clock_buckets_and_repairs(spark, d):
    """Half seconds, time buckets, capped and goal-line distances, turnovers; one kind of play is left out."""
    c = F.col("clock")
    bucket = F.when(c > 600, 900).when(c > 300, 600).when(c > 120, 300).when(c > 60, 120).otherwise(60)
    repaired = F.when(F.col("yards") < 10, F.least("distance", "yards")).otherwise(F.least(F.col("distance"), F.lit(20)))
    lost = (F.col("down") == 4) & ~F.col("kind").isin(*POINTS) & (F.col("value") < 20)
    flag = lambda x: F.when(x, 1).otherwise(0)
    return plays(spark, d).where(~F.col("kind").isin("view") & (F.col("value") > 0)).select(
        "event_id", (c + F.when(F.col("period").isin(1, 3), 900).otherwise(0)).alias("half_seconds"), bucket.alias("bucket"), S.band(c, 30).alias("floor_30"),
        repaired.alias("repaired_distance"), flag(repaired != F.col("distance")).alias("repaired"), flag(lost).alias("lost_on_downs"), flag(lost | (F.col("kind") == "error")).alias("turnover"),
    )


@query(f"""with p as ({_PLAYS}), s as (select *, coalesce(sum(case when kind = 'purchase' then 7 when kind = 'signup' then -7 end) over (partition by game order by event_id), 0) as lead from p)
select event_id, period, cast(lead as bigint) as lead, case when period > 4 then 0 when abs(lead) > case period when 1 then 43 when 2 then 37 when 3 then 27 else 22 end then 1 else 0 end as garbage from s""")
def garbage_time(spark, d):
    w = Window.partitionBy("game").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    lead = F.coalesce(F.sum(F.when(F.col("kind") == "purchase", 7).when(F.col("kind") == "signup", -7)).over(w), F.lit(0))
    limit = F.create_map(*(F.lit(x) for kv in GARBAGE_LEAD.items() for x in kv))
    return plays(spark, d).select("event_id", "period", lead.alias("lead"), F.when(F.abs(lead) > F.try_element_at(limit, F.col("period")), 1).otherwise(0).alias("garbage"))


_LABELS = f"""labelled as (select *, cast(coalesce(first_value(case kind when 'purchase' then 7 when 'signup' then 3 end ignore nulls) over (partition by game, half order by event_id rows between current row and unbounded following), 0) as integer) as label from ({_PLAYS}))"""


def next_score_labels(x):
    """Points of the next score in the half, this play's included; 0 where none follows."""
    w = Window.partitionBy("game", "half").orderBy("event_id").rowsBetween(0, Window.unboundedFollowing)
    return x.withColumn("label", F.coalesce(F.first(points(), ignorenulls=True).over(w), F.lit(0)))


@query(f"with {_LABELS} select event_id, label, cast(sum(case when label > 0 then 1 else 0 end) over (partition by game, half) as bigint) as labelled_in_half from labelled")
def next_score_label(spark, d):
    return next_score_labels(plays(spark, d)).select("event_id", "label", F.sum(F.when(F.col("label") > 0, 1).otherwise(0)).over(Window.partitionBy("game", "half")).alias("labelled_in_half"))


_LOOKUP = f"""{_LABELS}, cells as (select down, distance // 5 as dband, yards // 10 as yband, count(*) as n, avg(label) as m from labelled group by all), downs as (select down, avg(label) as m0 from labelled group by down),
lookup as (select down, dband, yband, n, case when n < 15 then m0 else m end as ep from cells join downs using (down))"""


def ep_cells(labelled, least_plays: int = 15):
    """Mean next score by down and bands of distance and yards; cells of few plays take their down's mean."""
    bands = labelled.withColumn("dband", F.expr("distance div 5").cast("int")).withColumn("yband", F.expr("yards div 10").cast("int"))
    cells = bands.groupBy("down", "dband", "yband").agg(F.count("*").alias("n"), F.avg("label").alias("m"))
    downs = labelled.groupBy("down").agg(F.avg("label").alias("m0"))  # four rows
    return cells.join(F.broadcast(downs), "down").select("down", "dband", "yband", "n", F.when(F.col("n") < least_plays, F.col("m0")).otherwise(F.col("m")).alias("ep"))


@query(f"with {_LOOKUP} select down, dband, yband, n, round(ep, 9) as ep from lookup")
def ep_lookup(spark, d):
    return ep_cells(next_score_labels(plays(spark, d))).withColumn("ep", F.round("ep", 9))


@query(f"""with {_LOOKUP}, m as (select *, min(ep) over w as fallen, lag(ep) over (partition by down, dband order by yband) as above, lead(ep) over (partition by down, dband order by yband) as below,
avg(ep) over (partition by down, dband order by yband rows between 2 preceding and 2 following) as smooth from lookup window w as (partition by down, dband order by yband rows between unbounded preceding and current row))
select down, dband, yband, round(fallen, 9) as monotone, round(smooth, 9) as smooth, case when coalesce(ep > above, false) or coalesce(below > ep, false) then 1 else 0 end as anomaly, case when ep - above > 0.5 then 'high' when ep - above > 0.1 then 'medium' else 'none' end as severity from m""")
def ep_monotone(spark, d):
    """Expected points must not rise with the yards to go: clamped, smoothed, and both rows of a rise flagged."""
    x = ep_cells(next_score_labels(plays(spark, d)))
    w = Window.partitionBy("down", "dband").orderBy("yband")
    above, below, ep = F.lag("ep").over(w), F.lead("ep").over(w), F.col("ep")
    rises = F.coalesce(ep > above, F.lit(False)) | F.coalesce(below > ep, F.lit(False))
    severity = F.when(ep - above > 0.5, "high").when(ep - above > 0.1, "medium").otherwise("none")
    return x.select("down", "dband", "yband", F.round(F.min("ep").over(w.rowsBetween(Window.unboundedPreceding, 0)), 9).alias("monotone"), F.round(F.avg("ep").over(w.rowsBetween(-2, 2)), 9).alias("smooth"), F.when(rises, 1).otherwise(0).alias("anomaly"), severity.alias("severity"))


_EPA = f"""{_LOOKUP}, placed as (select l.*, k.ep from labelled l join lookup k on k.down = l.down and k.dband = l.distance // 5 and k.yband = l.yards // 10),
nexts as (select *, lead(ep) over (partition by game order by event_id) as next_ep, lead(half) over (partition by game order by event_id) as next_half from placed),
epa as (select event_id, game, half, kind, down, value, ep, case when kind = 'purchase' then 7 - ep when kind = 'signup' then 3 - ep when kind = 'error' then -coalesce(next_ep, 0) - ep when next_half is distinct from half then 0 else coalesce(next_ep, 0) - ep end as epa from nexts)"""


def with_epa(x):
    """Expected points added: a score counts its points, a turnover turns the next value round, a half's last play counts 0."""
    labelled = next_score_labels(x)
    keyed = labelled.withColumn("dband", F.expr("distance div 5").cast("int")).withColumn("yband", F.expr("yards div 10").cast("int"))
    placed = keyed.join(F.broadcast(ep_cells(labelled).drop("n")), ["down", "dband", "yband"])  # at most 4 x 6 x 10 cells
    w = Window.partitionBy("game").orderBy("event_id")
    follows = F.coalesce(F.lead("ep").over(w), F.lit(0.0))
    ends = ~F.lead("half").over(w).eqNullSafe(F.col("half"))
    epa = F.when(points().isNotNull(), points() - F.col("ep")).when(F.col("kind") == "error", -follows - F.col("ep")).when(ends, 0.0).otherwise(follows - F.col("ep"))
    return placed.withColumn("epa", epa)


@query(f"with {_EPA} select event_id, round(ep, 9) as ep, round(epa, 9) as epa from epa")
def expected_points_added(spark, d):
    return with_epa(plays(spark, d)).select("event_id", F.round("ep", 9).alias("ep"), F.round("epa", 9).alias("epa"))


@query(f"""with {_EPA}, g as (select game, half, count(*) as n, avg(epa) as epa_play, coalesce(sum(case when down <= 2 then epa end) / nullif(sum(case when down <= 2 then 1 end), 0), 0) as epa_early, avg(case when value > 30 then 1.0 else 0.0 end) as success from epa group by all)
select game, cast(half as varchar) as half, n, round(epa_play, 9) as epa_play, round(epa_early, 9) as epa_early, round(success, 9) as success,
round(avg(epa_play) over w, 9) as prior_epa, case when row_number() over (partition by game order by half) < 5 then null else round(avg(success) over w, 9) end as gated_success from g window w as (partition by game order by half rows between unbounded preceding and 1 preceding)""")
def half_summaries_rolling(spark, d):
    """Rates of each half, means of strictly earlier ones, withheld before the fifth."""
    early = F.col("down") <= 2
    g = with_epa(plays(spark, d)).groupBy("game", "half").agg(
        F.count("*").alias("n"), F.avg("epa").alias("epa_play"), F.coalesce(F.try_divide(F.sum(F.when(early, F.col("epa"))), F.sum(F.when(early, 1))), F.lit(0.0)).alias("epa_early"), F.avg(F.when(F.col("value") > 30, 1.0).otherwise(0.0)).alias("success")
    )
    w = Window.partitionBy("game").orderBy("half")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    nine = lambda c: F.round(c, 9)
    return g.select("game", F.col("half").cast("string").alias("half"), "n", nine("epa_play").alias("epa_play"), nine("epa_early").alias("epa_early"), nine("success").alias("success"), nine(F.avg("epa_play").over(before)).alias("prior_epa"), F.when(F.row_number().over(w) >= 5, nine(F.avg("success").over(before))).alias("gated_success"))


@query(f"""with p as ({_PLAYS}), x as (select *, lead(kind) over (partition by game, half order by event_id) as nxt from p)
select game, round(coalesce(sum(case when kind = 'error' then 1 end) / nullif(sum(case when down in (1, 2) then 1 end), 0), 0), 9) as early_rate, round(coalesce(sum(case when kind = 'click' and value < 10 then 1 end) / nullif(sum(case when kind = 'click' then 1 end), 0), 0), 9) as stuffed_rate,
round(coalesce(sum(case when down in (3, 4) and kind = 'error' then 1 end) / nullif(sum(case when down in (3, 4) then 1 end), 0), 0), 9) as late_rate, round(coalesce(count(distinct case when yards <= 20 and nxt = 'purchase' then half end) / nullif(count(distinct case when yards <= 20 then half end), 0), 0), 9) as red_zone_rate,
round(coalesce(sum(case when kind = 'view' and value < 5 then 1 end) / nullif(sum(case when kind = 'view' then 1 end), 0), 0), 9) as sack_rate, round(coalesce(sum(case when kind = 'view' and value between 5 and 10 then 1 end) / nullif(sum(case when kind = 'view' then 1 end), 0), 0), 9) as defensed_rate,
round(coalesce(sum(case when kind = 'view' and nxt = 'error' then 1 end) / nullif(sum(case when kind = 'view' then 1 end), 0), 0), 9) as interception_rate, round(coalesce(sum(case when kind = 'error' and value > 20 then 1 end) / nullif(count(*), 0), 0), 9) as fumble_rate,
count(*) as plays, count(*) filter (where kind = 'view') as pass_plays, count(*) filter (where kind = 'click') as rush_plays from x group by game""")
def havoc_rates(spark, d):
    """Rates with denominators of their own; the red zone's counts halves, by the next play of the half."""
    x = plays(spark, d).withColumn("nxt", F.lead("kind").over(Window.partitionBy("game", "half").orderBy("event_id")))
    n = lambda c: F.sum(F.when(F.expr(c), 1))
    halves = lambda c: F.count_distinct(F.when(F.expr(c), F.col("half")))
    rate = lambda a, b: F.round(S.ratio(a, F.nullif(b, F.lit(0))), 9)
    return x.groupBy("game").agg(
        rate(n("kind = 'error'"), n("down in (1, 2)")).alias("early_rate"), rate(n("kind = 'click' and value < 10"), n("kind = 'click'")).alias("stuffed_rate"),
        rate(n("down in (3, 4) and kind = 'error'"), n("down in (3, 4)")).alias("late_rate"), rate(halves("yards <= 20 and nxt = 'purchase'"), halves("yards <= 20")).alias("red_zone_rate"),
        rate(n("kind = 'view' and value < 5"), n("kind = 'view'")).alias("sack_rate"), rate(n("kind = 'view' and value between 5 and 10"), n("kind = 'view'")).alias("defensed_rate"),
        rate(n("kind = 'view' and nxt = 'error'"), n("kind = 'view'")).alias("interception_rate"), rate(n("kind = 'error' and value > 20"), F.count("*")).alias("fumble_rate"),
        F.count("*").alias("plays"), F.count(F.when(F.col("kind") == "view", 1)).alias("pass_plays"), F.count(F.when(F.col("kind") == "click", 1)).alias("rush_plays"),
    )


@query(f"""with p as ({_PLAYS}), g as (select game, half, min_by(yards, event_id) as first_yards, max_by(kind, event_id) as last_kind, bool_or(kind = 'error') as any_turnover, sum(case kind when 'purchase' then 7 when 'signup' then 3 else 0 end) as pts, max(case when yards <= 40 and down = 1 then 1 else 0 end) as trip, sum(case when down = 4 then 1 else 0 end) as fourth from p group by all)
select game, count(*) as drives, round(avg(pts), 9) as points_per_drive, round(avg(first_yards), 9) as start_yards, round(coalesce(sum(case when trip = 1 then pts end) / nullif(sum(trip), 0), 0), 9) as points_per_trip, cast(sum(case when last_kind = 'error' then 1 else 0 end) as bigint) as ended_by_turnover, cast(sum(case when any_turnover then 1 else 0 end) as bigint) as with_turnover from g group by game having count(*) >= 3""")
def drive_factors(spark, d):
    score = F.coalesce(points(), F.lit(0))
    g = plays(spark, d).groupBy("game", "half").agg(F.min_by("yards", "event_id").alias("first_yards"), F.max_by("kind", "event_id").alias("last_kind"), F.bool_or(F.col("kind") == "error").alias("any_turnover"), F.sum(score).alias("pts"), F.max(F.when((F.col("yards") <= 40) & (F.col("down") == 1), 1).otherwise(0)).alias("trip"))
    out = g.groupBy("game").agg(
        F.count("*").alias("drives"), F.round(F.avg("pts"), 9).alias("points_per_drive"), F.round(F.avg("first_yards"), 9).alias("start_yards"), F.round(S.ratio(F.sum(F.when(F.col("trip") == 1, F.col("pts"))), F.nullif(F.sum("trip"), F.lit(0))), 9).alias("points_per_trip"),
        F.sum(F.when(F.col("last_kind") == "error", 1).otherwise(0)).alias("ended_by_turnover"), F.sum(F.when(F.col("any_turnover"), 1).otherwise(0)).alias("with_turnover"),
    )
    return out.where("drives >= 3")


@query(f"""with p as ({_PLAYS}), n as (select * from p where down in (1, 2) and period <= 3 and abs(value - 50) <= 30)
select game, round(avg(case when kind = 'click' then 1.0 else 0.0 end), 9) as run_share, count(*) as plays from n where kind in ('click', 'view') group by game having count(*) > 5""")
def neutral_run_share(spark, d):
    n = plays(spark, d).where("down in (1, 2) and period <= 3 and abs(value - 50) <= 30 and kind in ('click', 'view')")
    return n.groupBy("game").agg(F.round(F.avg(F.when(F.col("kind") == "click", 1.0).otherwise(0.0)), 9).alias("run_share"), F.count("*").alias("plays")).where("plays > 5")


@query(f"""with p as ({_PLAYS}), k as (select *, month(half) * 100 + day(half) // 10 as season, yards // 10 as band from p where kind in ('purchase', 'signup')), e as (select season, kind, band, avg(value) as expected from k group by all), v as (select k.game, k.season, k.value - e.expected as above from k join e using (season, kind, band)),
t as (select game, season, sum(above) as total, count(*) as n from v group by all having count(*) >= 2)
select game, cast(season + 1 as integer) as season, n, round(total, 6) as total, round((total - avg(total) over (partition by season)) / nullif(stddev_samp(total) over (partition by season), 0), 6) as z from t""")
def special_teams_above_expectation(spark, d):
    """Value above the mean of season, kind and band; rated within the season and stamped for the next one."""
    k = plays(spark, d).where(F.col("kind").isin(*POINTS)).withColumn("season", (F.month("half") * 100 + F.expr("day(half) div 10")).cast("int")).withColumn("band", F.expr("yards div 10"))
    e = k.groupBy("season", "kind", "band").agg(F.avg("value").alias("expected"))
    t = k.join(e, ["season", "kind", "band"]).groupBy("game", "season").agg(F.sum(F.col("value") - F.col("expected")).alias("total"), F.count("*").alias("n")).where("n >= 2")
    m = t.groupBy("season").agg(F.avg("total").alias("mean"), F.stddev_samp("total").alias("sd"))
    return t.join(F.broadcast(m), "season").select("game", (F.col("season") + 1).alias("season"), "n", F.round("total", 6).alias("total"), F.round((F.col("total") - F.col("mean")) / F.nullif(F.col("sd"), F.lit(0.0)), 6).alias("z"))


@query(f"""with p as ({_PLAYS}), g as (select d.range as down, x.range as distance, y.range as yards, b.bucket from range(1, 5) d, range(1, 26) x, range(1, 100) y, (values (1500), (300), (240), (180), (120), (60)) b(bucket) where not (y.range < 10 and x.range > y.range)), n as (select down, distance, yards, count(*) as n from p group by all)
select cast(g.down as integer) as down, cast(g.distance as integer) as distance, bucket, count(*) as cells, cast(sum(coalesce(n, 0)) as bigint) as plays from g left join n using (down, distance, yards) group by all""")
def situation_grid(spark, d):
    """The grid of downs, distances, yards and time buckets, impossible cells left out, with the plays that fell on it."""
    grid = spark.range(1, 5).select(F.col("id").cast("int").alias("down"))
    for name, values in (("distance", range(1, 26)), ("yards", range(1, 100)), ("bucket", (1500, 300, 240, 180, 120, 60))):
        grid = grid.withColumn(name, F.explode(F.lit(list(values))))
    grid = grid.where("not (yards < 10 and distance > yards)")
    n = plays(spark, d).groupBy("down", "distance", "yards").count()
    return grid.join(n, ["down", "distance", "yards"], "left").groupBy("down", "distance", "bucket").agg(F.count("*").alias("cells"), F.sum(F.coalesce("count", F.lit(0))).alias("plays"))


@query(f"""with p as ({_PLAYS}), c as (select game, half, kind, avg(value) as m, count(*) as n from p group by all), w as (select game, kind, sum(m * n) / sum(n) as rate, sum(n) as n from c group by all having sum(n) >= 4), o as (select half, avg(value) as day_mean, stddev_samp(value) as day_sd from p group by half)
select c.game, cast(c.half as varchar) as half, c.kind, round(w.rate, 9) as rate, round(case when day_sd is null or day_sd = 0 then 0.5 else least(greatest(1 + 0.15 * (m - day_mean) / day_sd, 0.7), 1.3) end, 9) as opponent_factor from c join w using (game, kind) join o using (half)""")
def opponent_factors(spark, d):
    """Cell means with counts, volume-weighted rates above a minimum, and clipped factors of the opposition."""
    x = plays(spark, d)
    c = x.groupBy("game", "half", "kind").agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    w = c.groupBy("game", "kind").agg((F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("rate"), F.sum("n").alias("all")).where("all >= 4").drop("all")
    o = x.groupBy("half").agg(F.avg("value").alias("day_mean"), F.stddev_samp("value").alias("day_sd"))
    factor = F.when(F.coalesce("day_sd", F.lit(0.0)) == 0, 0.5).otherwise(S.clip(1 + 0.15 * (F.col("m") - F.col("day_mean")) / F.nullif(F.col("day_sd"), F.lit(0.0)), 0.7, 1.3))
    return c.join(w, ["game", "kind"]).join(F.broadcast(o), "half").select("game", F.col("half").cast("string").alias("half"), "kind", F.round("rate", 9).alias("rate"), F.round(factor, 9).alias("opponent_factor"))


@query(f"""with p as ({_PLAYS}), r as (select game, half, sum(value) as v from p group by all), a as (select a.game, a.half, sum(b.v * power(0.9, date_diff('day', b.half, a.half))) / sum(power(0.9, date_diff('day', b.half, a.half))) as form from r a join r b on a.game = b.game and b.half < a.half group by all)
select r.game, cast(r.half as varchar) as half, round(v, 6) as v, round(form, 6) as form from r left join a using (game, half)""")
def recency_weighted_form(spark, d):
    """Mean of strictly earlier days, each day back weighing nine tenths of the next."""
    r = plays(spark, d).groupBy("game", "half").agg(F.sum("value").alias("v")).withColumn("t", F.datediff("half", F.lit("2024-01-01")))
    w = Window.partitionBy("game").orderBy("half").rowsBetween(Window.unboundedPreceding, -1)
    weight = F.pow(F.lit(0.9), -F.col("t"))
    return r.select("game", F.col("half").cast("string").alias("half"), F.round("v", 6).alias("v"), F.round(F.sum(F.col("v") * weight).over(w) / F.sum(weight).over(w), 6).alias("form"))
