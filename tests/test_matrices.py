"""Point-in-time families, the model catalogue, rooms and shared credit against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomfield.operators import matrix as X
from loomfield.operators import rooms
from loomfield.sources.catalogue import Catalogue, fit_scaler, scaled


def test_point_in_time_equals_a_search(spark):
    rng = np.random.default_rng(7)
    obs = [(int(e), int(s), int(t), float(v), None if v < -1 else float(v) * 2) for e, s, t, v in zip(rng.integers(0, 4, 120), rng.integers(2000, 2004, 120), rng.integers(0, 12, 120), rng.normal(size=120).round(3))]
    asks = [(k, int(e), int(s), int(t)) for k, (e, s, t) in enumerate(zip(rng.integers(0, 5, 90), rng.integers(1999, 2005, 90), rng.integers(0, 13, 90)))]
    asks += [(200, 1, 2002, 5), (200, 1, 2002, 5)]  # a repeated request
    rows = spark.createDataFrame(obs, "entity int, season int, at int, v double, w double")
    families = {
        "own": X.Family(rows, ["v", "w"]), "late": X.Family(rows, ["v"], gate=6), "past": X.Family(rows, ["v"], scope="before"), "any": X.Family(rows, ["v"], scope="both"),
    }
    got = X.point_in_time(spark.createDataFrame(asks, "k int, entity int, season int, at int").repartition(4), families).collect()
    assert len(got) == len(asks)

    def latest(keep):
        known = [(s, t, v, -9 if w is None else w, w) for e, s, t, v, w in obs if keep(e, s, t)]
        return max(known) if known else (None,) * 5

    for r in got:
        own = latest(lambda e, s, t: (e, s) == (r.entity, r.season) and t < r.at)
        past = latest(lambda e, s, t: e == r.entity and s < r.season)
        assert (r.own_v, r.own_w) == (own[2], own[4])
        assert r.late_v == (own[2] if r.at >= 6 else None) and r.past_v == past[2]
        assert r.any_v == (past[2] if own[0] is None else own[2])


def test_two_sides_and_needed_features(spark):
    rows = spark.createDataFrame([(1, 2000, 1, 5.0), (2, 2000, 2, 7.0)], "entity int, season int, at int, v double")
    games = spark.createDataFrame([(10, 1, 2, 2000, 3), (11, 1, 2, 2000, 2), (12, 2, 1, 2001, 1)], "game int, home int, away int, season int, at int")
    out = {r.game: (r.home_f_v, r.away_f_v) for r in X.two_sided(games, {"f": X.Family(rows, ["v"])}, key="game").collect()}
    assert out == {10: (5.0, 7.0), 11: (5.0, None), 12: (None, None)}
    assert [r.game for r in X.two_sided(games, {"f": X.Family(rows, ["v"])}, key="game", needed=["f_v"]).collect()] == [10]


def test_lags_keep_gaps(spark):
    rows = spark.createDataFrame([(1, 2000, 1.0), (1, 2002, 3.0), (2, 2001, 5.0)], "entity int, season int, v double")
    got = {(r.entity, r.season): (r.lag1, r.lag2, r.e) for r in X.lagged_grid(rows, "v", 2).withColumn("e", X.decayed(["lag1", "lag2"], [4.0, 2.0])).collect()}
    assert got[1, 2001] == (1.0, None, 1.0) and got[1, 2002] == (None, 1.0, 1.0) and got[1, 2003] == (3.0, None, 3.0) and got[2, 2003] == (None, 5.0, 5.0)
    assert got[1, 2000] == (None, None, None) and (2, 2000) not in got


def test_catalogue(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0), (3, 8.0, 5.0)], "k int, a double, b double")
    models = Catalogue(spark, f"file://{tmp_path}/models")
    with pytest.raises(FileNotFoundError):
        models.load("scaler")
    first = models.save("scaler", ["a", "b"], {"mean": [0.0, 0.0], "sd": [1.0, 1.0]}, "2020-01-01")
    models.save("scaler", ["a", "b"], fit_scaler(df, ["a", "b"]))
    assert models.versions("scaler")[0] == first and len(models.versions("scaler")) == 2 and models.versions("other") == []
    (tmp_path / "models" / "scaler" / "9999-unfinished").mkdir()  # a version that was never written whole
    newest = models.load("scaler")
    got = scaled(df, newest, "k").orderBy("k").collect()
    a = np.array([1.0, 3.0, 8.0])
    assert np.allclose([r.a for r in got], (a - a.mean()) / a.std()) and [r.b for r in got] == [0.0] * 3
    assert models.load("scaler", "2020-01-01").parameters["sd"] == [1.0, 1.0]
    with pytest.raises(Exception, match="(?i)exist"):
        models.save("scaler", ["a"], {}, "2020-01-01")
    for wrong in (df.drop("b"), df.withColumn("c", F.lit(1.0)), df.select("k", "b", "a")):
        with pytest.raises(ValueError, match="missing|order"):
            scaled(wrong, newest, "k")


def test_rooms_and_credit(spark):
    players = spark.createDataFrame([(1, "a", 10.0, 4, 20.0), (1, "b", None, 0, 12.0), (1, "c", 9.0, 2, None), (1, "d", 1.0, 1, 1.0), (2, "e", 5.0, 1, None)], "team int, who string, record double, n int, prior double")
    x = players.withColumn("p", rooms.shrunk(F.col("record"), F.col("n"), F.col("prior"), 6.0))
    assert {r.who: r.p for r in x.collect()} == {"a": 16.0, "b": 12.0, "c": 9.0, "d": 1.0, "e": 5.0}
    members = rooms.room(x, ["team"], [F.col("p").desc()], 3)
    assert {(r.who, r.place) for r in members.collect()} == {("a", 1), ("b", 2), ("c", 3), ("e", 1)}
    assert {r.team: (r.members, r.rating) for r in rooms.room_rating(members, ["team"], "p", 3, 2.0).collect()} == {1: (3, 37 / 3), 2: (1, 3.0)}
    credit = rooms.shared_credit(members.withColumn("total", F.lit(6.0)).withColumn("part", F.when(F.col("team") == 1, F.col("p")).otherwise(0.0)), ["team"], "total", "part")
    assert {r.who: round(r.credit, 9) for r in credit.collect()} == {"a": round(6 * 16 / 37, 9), "b": round(6 * 12 / 37, 9), "c": round(6 * 9 / 37, 9), "e": 6.0}
