import numpy as np
import pytest
from pyspark.sql import functions as F

from loomfield.functions import scalars as S
from loomfield.operators import relational as R
from loomfield.operators import ridge
from loomfield.operators.ridge import margin_ratings, ridge_rates, ridge_ratings
from loomfield.plans import models
from loomfield.sources import tables as T


def test_clock_and_rounding(spark):
    df = spark.createDataFrame([("14:46", 0.25), ("1:02:03", 0.75), (None, -0.25), ("x", 1.0)], "c string, v double")
    got = df.select(S.clock_seconds(F.col("c")).alias("s"), S.half_point(F.col("v")).alias("h")).collect()
    assert [r.s for r in got] == [886, 3723, None, None]
    assert [abs(r.h) for r in got] == [0.0, 1.0, 0.0, 1.0]


def test_ratio_of_zero(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 4.0)], "k int, a double, b double")
    got = {r.k: r.r for r in R.ratio_of_sums(df, ["k"], {"r": (F.col("a"), F.col("b"))}).collect()}
    assert got == {1: 0.0, 2: 0.25}


def test_latest_before_takes_equal_times_and_leaves_gaps(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 1, "b"), (2, 9, "c")], "k int, t int, id string")
    right = spark.createDataFrame([(1, 5, 50), (1, 3, 30)], "k int, u int, v int")
    got = {r.id: r.v for r in R.latest_before(left, right, "k", "t", "u", ["v"]).collect()}
    assert got == {"a": 50, "b": None, "c": None}


def test_nearest_prefers_lower(spark):
    df = spark.createDataFrame([(3.0,), (8.0,)], "v double")
    assert [r.n for r in R.nearest(df, "v", [1.0, 5.0, 11.0], "n").collect()] == [1.0, 5.0]


def closed_form(rows, alpha):
    """Ratings from single observations (entity, opponent, y, weight): weighted, centred, penalised least squares."""
    e, o = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    x = np.zeros((len(rows), len(e) + len(o)))
    for k, r in enumerate(rows):
        x[k, e.index(r[0])] = x[k, len(e) + o.index(r[1])] = 1.0
    y, w = np.array([r[2] for r in rows]), np.array([r[3] for r in rows], float)
    mx, my = np.average(x, axis=0, weights=w), np.average(y, weights=w)
    b = np.linalg.solve((x - mx).T @ ((x - mx) * w[:, None]) + alpha * np.eye(x.shape[1]), (x - mx).T @ (w * (y - my)))
    return {k: my - mx @ b + b[i] + b[len(e) :].mean() for i, k in enumerate(e)}


@pytest.mark.parametrize("alpha,weighted", [(1.0, False), (25.0, True)])
def test_ridge_equals_the_closed_form_on_rows(spark, alpha, weighted):
    rng = np.random.default_rng(1)
    rows = [(s, int(rng.integers(0, 7)), f"t{rng.integers(0, 5)}", float(rng.normal()), float(rng.integers(1, 9)) if weighted else 1.0) for s in (1, 2) for _ in range(90)]
    few = [(3, 1, "t1", 1.0, 1.0), (4, 1, "t1", 1.0, 0.0)]
    df = spark.createDataFrame(rows + few, "season int, entity int, opponent string, y double, w double")
    cells = df.groupBy("season", "entity", "opponent").agg(F.try_divide(F.sum(F.col("y") * F.col("w")), F.sum("w")).alias("mean"), F.sum("w").alias("weight"))
    got = {(r.season, r.entity): r.rating for r in ridge_ratings(cells, "season", alpha).collect()}
    want = {(s, k): v for s in (1, 2) for k, v in closed_form([r[1:] for r in rows if r[0] == s], alpha).items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_ridge_queries_equal_the_closed_form(spark):
    sf = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").join(spark.read.parquet(f"{sf}/part.parquet"), F.expr("l_partkey = p_partkey"))
    lines = lines.selectExpr("year(l_shipdate) as season", "quarter(l_shipdate) as q", "l_suppkey", "p_brand", "l_discount", "l_quantity").collect()
    for name, alpha, weight in (("ridge_opponent_adjust", 1.0, lambda r: 1.0), ("ridge_weighted", 25.0, lambda r: r.l_quantity)):
        got = {(r.season, r.entity): r.rating for r in models.QUERIES[name](spark, sf).collect()}
        for season in sorted({r.season for r in lines})[1:3]:
            want = closed_form([(r.l_suppkey, r.p_brand, r.l_discount, weight(r)) for r in lines if r.season == season], alpha)
            assert all(abs(got[season, k] - v) < 1e-9 for k, v in want.items())
    got = {(r.group, r.entity): r.rating for r in models.QUERIES["ridge_asof"](spark, sf).collect()}
    season = sorted({r.season for r in lines})[2]
    for before in (2, 4):
        want = closed_form([(r.l_suppkey, r.p_brand, r.l_discount, 1.0) for r in lines if r.season == season and r.q < before], 1.0)
        assert all(abs(got[season * 10 + before, k] - v) < 1e-9 for k, v in want.items())


def test_margin_ratings_leave_levels_and_the_home_edge_unpenalised(spark):
    rng = np.random.default_rng(2)
    strength, level = rng.normal(0, 1, 8), [0, 0, 0, 0, 1, 1, 1, 1]
    games = [(1, int(h), int(a), level[h], level[a], float(strength[h] - strength[a] + 20 * (level[h] - level[a]) + 3 + rng.normal(0, 0.1))) for h, a in (rng.choice(8, 2, replace=False) for _ in range(400))]
    got = {r.team: r for r in margin_ratings(spark.createDataFrame(games, "season int, home int, away int, home_level int, away_level int, margin double"), "season", alpha=1.0).collect()}
    assert abs(got[0].edge - 3) < 0.1
    for a in range(8):
        for b in range(8):
            assert abs((got[a].rating - got[b].rating) - (strength[a] - strength[b] + 20 * (level[a] - level[b]))) < 0.3


def test_margin_ratings_equal_the_closed_form(spark):
    rng = np.random.default_rng(4)
    level = [0, 0, 0, 1, 1, 2]
    games = [(k % 2, int(h), int(a), level[h], level[a], float(rng.integers(-30, 30))) for k, (h, a) in enumerate(rng.choice(6, 2, replace=False) for _ in range(80))]
    df = spark.createDataFrame(games + [(0, 0, 1, 0, 0, None)], "season int, home int, away int, home_level int, away_level int, margin double")
    got = {(r.season, r.team): (r.rating, r.edge) for r in margin_ratings(df, "season", alpha=25.0).collect()}
    for season in (0, 1):
        own = [g for g in games if g[0] == season]
        x = np.zeros((len(own), 6 + 3))
        for row, (_, h, a, lh, la, _) in zip(x, own):
            row[6] = 1
            row[h] += 1
            row[a] -= 1
            for at, sign in ((lh, 1), (la, -1)):
                if at:
                    row[6 + at] += sign
        penalty = np.diag([25.0] * 6 + [1e-9] * 3)
        b = np.linalg.solve(x.T @ x + penalty, x.T @ np.array([g[5] for g in own]))
        for t in range(6):
            assert abs(got[season, t][0] - (b[t] + (b[6 + level[t]] if level[t] else 0))) < 1e-9 and abs(got[season, t][1] - b[6]) < 1e-9


def test_large_groups_of_margins_are_solved_without_a_matrix(spark, monkeypatch):
    rng = np.random.default_rng(8)
    level = [k % 3 if k < 20 else 3 for k in range(24)]
    games = [(s, int(h), int(a), level[h], level[a], float(rng.integers(-30, 30))) for s, n in ((0, 16), (1, 6), (None, 24), (2, 20)) for h, a in rng.integers(0, n, (150, 2))]
    games.append((0, 3, 4, 2, 1, 7.0))  # a level that is not its team's lowest, and teams that met themselves above
    df = spark.createDataFrame(games, "season int, home int, away int, home_level int, away_level int, margin double")
    want = {(r.season, r.team): (r.rating, r.edge) for r in margin_ratings(df, "season").collect()}

    calls, run = [], ridge.iterated_margins
    monkeypatch.setattr(ridge, "iterated_margins", lambda cells, alpha: calls.append(cells.select("_g").distinct().count()) or run(cells, alpha))
    got = {(r.season, r.team): (r.rating, r.edge) for r in margin_ratings(df, "season", most_teams=10).collect()}
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-9 for k in want for a, b in zip(got[k], want[k]))
    assert calls == [3]  # all but season 1, whose teams are few


def test_guarded_write(spark, tmp_path):
    df = spark.range(3)
    with pytest.raises(ValueError):
        T.write_guarded(df, str(tmp_path / "x"), 4)
    assert T.write_guarded(df, str(tmp_path / "x"), 3) == 3


def test_outer_explode_keeps_empty(spark):
    df = spark.createDataFrame([(1, "[]"), (2, "[4,5]")], "k int, j string")
    assert sorted((r.k, r.item or 0) for r in T.json_rows(df, "j", "array<int>").collect()) == [(1, 0), (2, 4), (2, 5)]


def test_ordered_numbers(spark, tmp_path):
    def store(df):
        df.write.parquet(f"{tmp_path}/t")
        return spark.read.parquet(f"{tmp_path}/t")

    df = spark.range(0, 3000).select("id", (F.col("id") * 7919 % 100).alias("score")).repartition(7)
    got = R.ordered_numbers(df, [F.col("score").desc(), F.col("id").asc()], "n", store)
    want = sorted((-r.score, r.id) for r in df.collect())
    assert sorted((r.n, -r.score, r.id) for r in got.collect()) == [(k + 1, *w) for k, w in enumerate(want)]
    none = R.ordered_numbers(df.limit(0), [F.col("id").asc()], "n", lambda x: x)
    assert none.count() == 0 and none.columns == ["id", "score", "n"]


@pytest.mark.parametrize("few", [1 << 16, 10])
def test_ranks_and_positions_equal_windows(spark, monkeypatch, few):
    monkeypatch.setattr(R, "FEW", few)
    rows = [(k % 3 if k % 10 else None, float(k * 7919 % 20) if k % 9 else None, k) for k in range(400)]
    df = spark.createDataFrame(rows, "g int, v double, id int").repartition(6)
    got = {r.id: (r._rank, r._mean_rank, r._rank_desc, r._n) for r in R.with_ranks(df, ["g"], "v").collect()}
    places = {r.id: (r._at, r._n) for r in R.with_positions(df, ["g"], [F.col("v").asc(), F.col("id").asc()]).collect()}
    low = lambda v: -1.0 if v is None else v  # nulls first
    for g, v, k in rows:
        own = sorted((low(w), i) for h, w, i in rows if h == g)
        less, same = sum(w < low(v) for w, _ in own), sum(w == low(v) for w, _ in own)
        assert got[k] == (less + 1, less + (same + 1) / 2, len(own) - less - same + 1, len(own))
        assert places[k] == (own.index((low(v), k)), len(own))
    assert R.with_ranks(df.limit(0), ["g"], "v").count() == 0


def test_ridge_rates_members_and_guards(spark):
    rng = np.random.default_rng(8)
    rows = [(g, int(e), f"o{o}", float(rng.normal(e * 0.1, 0.5)), float(rng.integers(1, 9)), float(rng.normal()), float(rng.integers(0, 4))) for g in (1, 2) for e in range(9) for o in range(6) if rng.random() < 0.7]
    rows += [(1, 50, "o1", 0.3, 2.0, 0.1, 2.0)]  # one cell alone
    cells = spark.createDataFrame(rows, "season int, entity int, opponent string, a double, a_n double, b double, b_n double")
    members = spark.createDataFrame([(g, f"o{o}") for g in (1, 2) for o in range(5)], "season int, opponent string")
    got = {(r.season, r.entity): r for r in ridge_rates(cells, "season", ["a", "b"], 2.0, members=members, least_own=2).collect()}
    for season in (1, 2):
        for name, at in (("a", 3), ("b", 5)):
            own = [(r[1], r[2], r[at], r[at + 1]) for r in rows if r[0] == season and r[2] != "o5" and r[at + 1] > 0]
            want = closed_form(own, 2.0)
            for e in {x[0] for x in own}:
                v = got[season, e][f"rating_{name}"] if (season, e) in got else None
                assert v is None if sum(x[0] == e for x in own) < 2 else abs(v - want[e]) < 1e-9
    assert (1, 50) not in got
    noise = spark.createDataFrame([(1, e, f"o{o}", float(rng.normal()), 1.0) for e in range(9) for o in range(6)], "season int, entity int, opponent string, mean double, weight double")
    assert ridge_ratings(noise, "season", 1.0, least_r2=0.99).count() == 0 and ridge_ratings(noise, "season", 1.0, least_r2=0.0).count() == 9


def test_letters_and_closest(spark):
    df = spark.createDataFrame([("Ünïcode ÇÉD-2 Ñandú",), ("O'Neil Jr.",), (None,), ("ﬁne Å",)], "n string")
    assert [r[0] for r in df.select(S.letters_only(F.col("n"))).collect()] == ["unicodecednandu", "oneiljr", None, "finea"]
    words = spark.createDataFrame([("ECNOMY",), ("zzz",), (None,)], "w string")
    assert [r[0] for r in words.select(S.closest_by_ratio(["ECONOMY", "SMALL"])("w")).collect()] == ["ECONOMY", None, None]


def test_fetch_retries_and_pages(spark):
    def get(request, page):
        if request == "down":
            raise TimeoutError("no answer")
        if request == "flaky":
            state["calls"] = state.get("calls", 0) + 1
            if state["calls"] % 3:
                raise ConnectionError("again")
        return f"{request}-{page}", page < 3

    state = {}
    out = T.fetch_pages(spark.createDataFrame([("ok",), ("down",), ("flaky",)], "request string").coalesce(1), get, tries=3, wait=0.001).collect()
    assert sorted((r.request, r.page, r.body or "") for r in out) == [("down", 1, ""), ("flaky", 1, "flaky-1"), ("flaky", 2, "flaky-2"), ("flaky", 3, "flaky-3"), ("ok", 1, "ok-1"), ("ok", 2, "ok-2"), ("ok", 3, "ok-3")]
    assert [r.error for r in out if r.request == "down"] == ["TimeoutError: no answer"]


def test_column_order_is_refused(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    T.check_columns(df, ["a", "b"])
    for wrong in (["a"], ["a", "b", "c"], ["b", "a"]):
        with pytest.raises(ValueError):
            T.check_columns(df, wrong)


def test_scratch_folder_is_shared_or_local(spark):
    class Other:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"
            applicationId = "x"

    with pytest.raises(ValueError, match="checkpoint"):
        T.scratch_path(Other, "t")
