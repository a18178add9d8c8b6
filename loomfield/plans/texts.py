"""Queries on names, free text and nested records: keys, extractions, explodes, flattened structs and maps, files."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomfield.functions import scalars as S
from loomfield.sources import tables as T
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


@query("""with t as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-zà-ž]+'), lambda x: x <> '') as w from documents), n as (select doc_id, w[1] as first, w[2] as last, case when w[3] in ('jr', 'sr', 'ii', 'iii', 'iv') then w[3] end as suffix from t where len(w) >= 2)
select doc_id, first, last, regexp_replace(strip_accents(first || last), '[^a-z]', '', 'g') as full_key, regexp_replace(strip_accents(left(first, 1) || last), '[^a-z]', '', 'g') as initial_key, regexp_replace(strip_accents(last), '[^a-z]', '', 'g') as last_key, suffix from n""")
def name_keys(spark, d):
    """Names in tokens, a suffix set apart, and the keys by which they are matched, most exact first."""
    w = F.filter(F.split(F.lower("text"), "[^a-zà-ž]+"), lambda x: x != "")
    n = read_table(spark, d, "documents").select("doc_id", w.alias("w")).where("size(w) >= 2")
    n = n.select("doc_id", F.get("w", F.lit(0)).alias("first"), F.get("w", F.lit(1)).alias("last"), F.get("w", F.lit(2)).alias("third"))
    key = lambda *c: S.name_letters(F.concat(*c))
    suffix = F.when(F.col("third").isin("jr", "sr", "ii", "iii", "iv"), F.col("third"))
    return n.select("doc_id", "first", "last", key("first", "last").alias("full_key"), key(F.substring("first", 1, 1), "last").alias("initial_key"), key("last").alias("last_key"), suffix.alias("suffix"))


@query("select s_suppkey, 'Supplier, ' || right(s_name, 4) as listed, right(s_name, 4) || ' Supplier' as flipped, '#' || (s_suppkey % 99) || ' ' || s_name as jersey, s_name as stripped from supplier")
def flip_and_strip_names(spark, d):
    """'Last, First' turned round, and a leading jersey number taken off."""
    x = read_table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("Supplier, "), F.substring("s_name", -4, 4)).alias("listed"), F.concat(F.lit("#"), F.col("s_suppkey") % 99, F.lit(" "), F.col("s_name")).alias("jersey"))
    part = F.split("listed", ",\\s*")
    return x.select("s_suppkey", "listed", F.concat_ws(" ", F.get(part, F.lit(1)), F.get(part, F.lit(0))).alias("flipped"), "jersey", F.regexp_replace("jersey", "^#\\d+\\s*", "").alias("stripped"))


@query("""with w as (select doc_id, i, w[i] as lead, w[i + 1] as word from (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') as w from documents), unnest(range(1, len(w))) as t(i)),
f as (select doc_id, i, word from w where lead = 'the' and word not in ('and', 'of', 'in', 'to', 'the')) select doc_id, min_by(word, i) as named, count(*) as found from f group by doc_id""")
def leading_word_with_stops(spark, d):
    """The first word after a marker that is none of the stop words: a negative look-ahead."""
    found = F.regexp_extract_all(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), F.lit("(?:^|(?<= ))the (?!(?:and|of|in|to|the)(?: |$))([a-z]+)"), F.lit(1))
    x = read_table(spark, d, "documents").select("doc_id", found.alias("f"))
    return x.where("size(f) > 0").select("doc_id", F.get("f", F.lit(0)).alias("named"), F.size("f").cast("bigint").alias("found"))


@query("""with t as (select doc_id, regexp_extract_all(lower(text), '[a-z]*(?:tion|ment|ing)[a-z]*') as f from documents), e as (select doc_id, unnest(list_distinct(f)) as event, len(list_distinct(f)) as n from t where len(f) > 0)
select event, round(sum(case when n = 1 then 1.0 else 0.5 end), 6) as credit, count(*) as documents from e group by event""")
def event_explode_credit(spark, d):
    """Every event named in a text, one row each; an event alone gets whole credit, shared ones half."""
    x = read_table(spark, d, "documents").select("doc_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]*(?:tion|ment|ing)[a-z]*"), F.lit(0))).alias("f"))
    e = x.select(F.explode("f").alias("event"), F.when(F.size("f") == 1, 1.0).otherwise(0.5).alias("c"))
    return e.groupBy("event").agg(F.round(F.sum("c"), 6).alias("credit"), F.count("*").alias("documents"))


@query("select event_id, case when contains(event_type, 'ur') and value > 10 then 1 else 0 end as run_flag, case when starts_with(event_type, 'vi') or ends_with(event_type, 'or') then 1 else 0 end as pass_flag, trim('  ' || upper(event_type) || ' ') as tidy, cast(regexp_extract('Week ' || (event_id % 15 + 1), '(\\d+)', 1) as integer) as week, split_part(strftime(ts, '%Y-%m-%dT%H:%M:%S'), 'T', 1) as day_text, cast(user_id as varchar) || '-' || event_type as both_key from events")
def text_flags_and_keys(spark, d):
    return read_table(spark, d, "events").select(
        "event_id", F.when(F.coalesce(F.col("event_type").contains("ur"), F.lit(False)) & (F.col("value") > 10), 1).otherwise(0).alias("run_flag"), F.when(F.col("event_type").startswith("vi") | F.col("event_type").endswith("or"), 1).otherwise(0).alias("pass_flag"),
        F.trim(F.concat(F.lit("  "), F.upper("event_type"), F.lit(" "))).alias("tidy"), F.regexp_extract(F.concat(F.lit("Week "), F.col("event_id") % 15 + 1), "(\\d+)", 1).cast("int").alias("week"),
        F.get(F.split(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "T"), F.lit(0)).alias("day_text"), F.concat_ws("-", "user_id", "event_type").alias("both_key"),
    )


@query("""select event_id, cast(case when hour(ts) < 5 then cast(ts as date) - 1 else cast(ts as date) end as varchar) as eastern_day, cast(2024 - case when month(ts) < 8 then 1 else 0 end as integer) as season, case when value = 0 then null else round(ln(value), 9) end as log_value, round(ln(1 + value) * (event_id % 7), 9) as log_interaction, round(case when value = 50 then 0.05 else 1 / (1 + exp(-(value - 50) / 10)) end, 9) as p from events""")
def days_seasons_and_logs(spark, d):
    """UTC to eastern days (winter), the season of a day, logarithms, and a win probability with a floor for ties."""
    v = F.col("value")
    return read_table(spark, d, "events").select(
        "event_id", F.to_date(F.from_utc_timestamp("ts", "America/New_York")).cast("string").alias("eastern_day"), S.season_of(F.col("ts")).alias("season"), F.round(F.when(v != 0, F.ln(v)), 9).alias("log_value"),
        F.round(F.ln(1 + v) * (F.col("event_id") % 7), 9).alias("log_interaction"), F.round(F.when(v == 50, 0.05).otherwise(S.logistic(v - 50, 10.0)), 9).alias("p"),
    )


@query("""select o_orderkey, p1 + p2 + p3 + p4 as regulation, greatest(0, total - (p1 + p2 + p3 + p4)) as overtime, p1 + p2 as first_half, p3 + p4 as second_half, (p1 + p2) - (p3 + p4) as half_difference, least(greatest(cast(y as integer) - k + 1, 1), 6) as class_year, case when r >= 0.98 then 5 when r >= 0.89 then 4 when r >= 0.79 then 3 else 2 end as stars
from (select *, cast(floor(o_totalprice) as bigint) % 50 as total, cast(o_orderkey % 14 as integer) as p1, cast(o_orderkey % 11 as integer) as p2, cast(o_custkey % 9 as integer) as p3, cast(o_custkey % 7 as integer) as p4, year(o_orderdate) as y, 1994 + cast(o_custkey % 5 as integer) as k, (o_orderkey % 1000) / 1000.0 as r from orders)""")
def points_classes_and_stars(spark, d):
    """Halves and overtime from quarters, class years held to 1..6, star bands from ratings."""
    x = read_table(spark, d, "orders").selectExpr("*", "cast(floor(o_totalprice) as bigint) % 50 as total", "cast(o_orderkey % 14 as int) as p1", "cast(o_orderkey % 11 as int) as p2", "cast(o_custkey % 9 as int) as p3", "cast(o_custkey % 7 as int) as p4", "year(o_orderdate) as y", "1994 + cast(o_custkey % 5 as int) as k", "(o_orderkey % 1000) / 1000 as r")
    stars = F.when(F.col("r") >= 0.98, 5).when(F.col("r") >= 0.89, 4).when(F.col("r") >= 0.79, 3).otherwise(2)
    all4 = F.expr("p1 + p2 + p3 + p4")
    return x.select("o_orderkey", all4.alias("regulation"), F.greatest(F.lit(0).cast("bigint"), F.col("total") - all4).alias("overtime"), F.expr("p1 + p2").alias("first_half"), F.expr("p3 + p4").alias("second_half"), F.expr("(p1 + p2) - (p3 + p4)").alias("half_difference"), S.clip(F.col("y") - F.col("k") + 1, 1, 6).alias("class_year"), stars.alias("stars"))


_BOX = "select event_id, event_id // 500 as game, user_id % 3 as team, case when event_type in ('view', 'click') then 'passing' else 'rushing' end as category, event_type as kind, user_id as athlete, value from events"


@query(f"""with b as ({_BOX}), t as (select game, team, category, kind, athlete, round(sum(value), 4) as total from b group by all), o as (select game, string_agg(distinct cast(team as varchar), ',' order by cast(team as varchar)) as teams from b group by game)
select game, team, category, kind, athlete, total, nullif(array_to_string(list_filter(string_split(teams, ','), lambda x: x <> cast(team as varchar)), ','), '') as opponents from t join o using (game)""")
def box_score_five_levels(spark, d):
    """Nested game, team, category, kind, athlete records built, serialised and read back level by level, siblings kept."""
    b = read_table(spark, d, "events").select(F.floor(F.col("event_id") / 500).alias("game"),  # a game's record holds 500 events at most
         (F.col("user_id") % 3).alias("team"), F.when(F.col("event_type").isin("view", "click"), "passing").otherwise("rushing").alias("category"), F.col("event_type").alias("kind"), F.col("user_id").alias("athlete"), "value")
    x = b.groupBy("game", "team", "category", "kind", "athlete").agg(F.round(F.sum("value"), 4).alias("total"))
    nest = lambda x, keys, *cols, name: x.groupBy(*keys).agg(F.collect_list(F.struct(*cols)).alias(name))
    x = nest(x, ["game", "team", "category", "kind"], "athlete", "total", name="athletes")
    x = nest(x, ["game", "team", "category"], "kind", "athletes", name="types")
    x = nest(x, ["game", "team"], "category", "types", name="categories")
    x = nest(x, ["game"], "team", "categories", name="teams").select("game", F.to_json("teams").alias("json"))
    kind = "array<struct<team:bigint,categories:array<struct<category:string,types:array<struct<kind:string,athletes:array<struct<athlete:bigint,total:double>>>>>>>>"
    x = T.json_rows(x, "json", kind, outer=False).withColumn("all", F.from_json("json", kind))
    opponents = F.array_join(F.array_sort(F.transform(F.filter(F.col("all")["team"], lambda t: t != F.col("item.team")), lambda t: t.cast("string"))), ",")
    x = x.select("game", F.col("item.team").alias("team"), F.nullif(opponents, F.lit("")).alias("opponents"), F.explode("item.categories").alias("c"))
    x = x.select("game", "team", "opponents", F.col("c.category").alias("category"), F.explode("c.types").alias("t"))
    x = x.select("game", "team", "opponents", "category", F.col("t.kind").alias("kind"), F.explode("t.athletes").alias("a"))
    return x.select("game", "team", "category", "kind", "a.athlete", "a.total", "opponents")


@query("select r_regionkey, r_name, n_nationkey, n_name, c_custkey from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey")
def three_level_explode(spark, d):
    """Regions holding nations holding customers, as JSON texts of a region's customers by thousands, read back by three explodes."""
    t = lambda n: read_table(spark, d, n)
    page = F.floor(F.col("c_custkey") / 1000).alias("page")
    n = t("customer").groupBy(F.col("c_nationkey").alias("n_nationkey"), page).agg(F.collect_list("c_custkey").alias("customers")).join(t("nation"), "n_nationkey")
    r = n.groupBy(F.col("n_regionkey").alias("r_regionkey"), "page").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name", "customers"))).alias("json")).join(t("region"), "r_regionkey")
    x = T.json_rows(r, "json", "array<struct<n_nationkey:int,n_name:string,customers:array<bigint>>>", outer=False)
    return x.select("r_regionkey", "r_name", "item.n_nationkey", "item.n_name", F.explode("item.customers").alias("c_custkey"))


@query("select user_id, round(avg(case when event_type = 'view' then value end), 6) as usage_view, round(avg(case when event_type = 'click' then value end), 6) as usage_click, round(sum(value), 4) as totals_value, count(*) as totals_count from events group by user_id")
def flatten_maps_and_structs(spark, d):
    """A map's keys to columns with a prefix, and a struct's fields likewise."""
    x = read_table(spark, d, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("m"), F.sum("value").alias("s"), F.count("*").alias("n"))
    x = x.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "m"))).alias("usage"), F.struct(F.round(F.sum("s"), 4).alias("value"), F.sum("n").alias("count")).alias("totals"))
    return T.flatten_struct(x.select("user_id", "totals", *(F.round(F.try_element_at("usage", F.lit(k)), 6).alias(f"usage_{k}") for k in ("view", "click"))), "totals")


@query("select o_custkey as cust_key, o_orderstatus as order_status, count(*) as order_count from orders group by all")
def snake_case_columns(spark, d):
    x = read_table(spark, d, "orders").groupBy(F.col("o_custkey").alias("custKey"), F.col("o_orderstatus").alias("orderStatus")).agg(F.count("*").alias("orderCount"))
    return x.toDF(*map(S.snake_case, x.columns))


@query("""with k as (select distinct p_type as word from part), m as (select p_partkey, p_type, left(p_type, len(p_type) - 1) || 'x' as typed from part)
select p_partkey, typed, min_by(word, levenshtein(typed, word) * 1000 + ascii(word)) as suggestion, min(levenshtein(typed, word)) as distance from m, k group by all having min(levenshtein(typed, word)) <= 3""")
def closest_name(spark, d):
    """The known word closest to a mistyped one; the known words are a handful."""
    x = read_table(spark, d, "part").select("p_partkey", F.expr("concat(left(p_type, length(p_type) - 1), 'x')").alias("typed"))
    known = read_table(spark, d, "part").select(F.col("p_type").alias("word")).distinct()
    typed = x.select("typed").distinct().crossJoin(F.broadcast(known)).withColumn("distance", F.levenshtein("typed", "word"))
    best = typed.groupBy("typed").agg(F.min_by("word", F.col("distance") * 1000 + F.ascii("word")).alias("suggestion"), F.min("distance").cast("bigint").alias("distance")).where("distance <= 3")
    return x.join(F.broadcast(best), "typed").select("p_partkey", "typed", "suggestion", "distance")


@query("select year(o_orderdate) as season, o_orderkey, o_custkey, round(o_totalprice, 2) as price from orders")
def csv_season_files(spark, d):
    """Orders written as one CSV folder a season with headers, read back by their columns, the season from the path."""
    x = read_table(spark, d, "orders").select(F.year("o_orderdate").alias("season"), "o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("price"))
    path = T.scratch_path(spark, "season-files")
    T.write_csv_by(x, path, "season")
    back = T.read_csv_seasons(spark, path, schema="o_orderkey bigint, o_custkey bigint, price double")
    return back.select(F.col("season").cast("bigint"), F.col("o_orderkey").cast("bigint"), F.col("o_custkey").cast("bigint"), F.col("price").cast("double"))


@query("""with e as (select user_id, cast(ts as date) as day, event_id, value from events) select user_id, cast(day as varchar) as day, min_by(value, event_id) as first_value, max_by(value, event_id) as last_value, bool_or(value > 100) as any_large, max_by(event_id, value * 1000000 + event_id) as best_event from e group by all""")
def first_last_any(spark, d):
    x = read_table(spark, d, "events").withColumn("day", F.to_date("ts").cast("string"))
    return x.groupBy("user_id", "day").agg(F.min_by("value", "event_id").alias("first_value"), F.max_by("value", "event_id").alias("last_value"), F.bool_or(F.col("value") > 100).alias("any_large"), F.max_by("event_id", F.col("value") * 1000000 + F.col("event_id")).alias("best_event"))


@query("select o_orderkey, o_totalprice, row_number() over (order by abs(o_totalprice - 150000) desc, o_orderkey) as place from orders qualify place <= 50")
def largest_by_absolute_value(spark, d):
    """Ordered by distance from the mark, ties by key, nulls last; the first fifty."""
    x = read_table(spark, d, "orders").withColumn("gap", F.abs(F.col("o_totalprice") - 150000)).orderBy(F.col("gap").desc_nulls_last(), "o_orderkey").limit(50)
    return x.withColumn("place", F.row_number().over(Window.orderBy(F.col("gap").desc_nulls_last(), "o_orderkey")).cast("bigint")).select("o_orderkey", "o_totalprice", "place")
