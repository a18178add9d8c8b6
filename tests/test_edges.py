"""Rows at the edge of a limit or of a rounding, against the query's SQL."""

import datetime
import math
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from loomfield.plans import ladders, registry


def both(spark, folder, name, **tables):
    """A query's rows and those of its SQL, over ``tables`` of columns."""
    con = duckdb.connect()
    for t, columns in tables.items():
        pq.write_table(pa.table(columns), f"{folder}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got = registry.queries()[name](spark, str(folder))
    want = con.execute(f"select {', '.join(got.columns)} from ({registry.oracle_sql()[name]})").fetchall()
    return sorted(tuple(r) for r in got.collect()), sorted(want)


def test_outliers_are_told_before_rounding(spark, tmp_path):
    z = 1.7000002  # beyond the limit, but 1.7 when rounded
    x = 1000 * math.sqrt(8 * z * z / (9 - 2 * z * z))
    price = [x, -x] + [1000.0, -1000.0] * 4
    got, want = both(spark, tmp_path, "outlier_scan", orders={"o_orderkey": list(range(10)), "o_totalprice": price, "o_orderdate": [datetime.datetime(1996, 5, 1)] * 10})
    assert got == want == [(0, 1.7), (1, -1.7)]


def test_travel_takes_more_tasks_for_more_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ladders, "TASK_ROWS", 16)
    n = 160
    lines = {"l_orderkey": [k * 7 % 23 for k in range(n)], "l_suppkey": [k * k % 5 for k in range(n)]}
    orders = {"o_orderkey": [*range(23), 3], "o_custkey": [*(k % 4 for k in range(23)), 3]}  # an order twice
    supplier = {"s_suppkey": list(range(5)), "s_nationkey": [3, 9, 14, 2, 20], "s_acctbal": [10.5, 20.0, -3.25, 900.0, 7.0]}
    got, want = both(spark, tmp_path, "venue_travel", orders=orders, lineitem=lines, supplier=supplier)
    assert got == want and len(got) > 23
    plan = registry.queries()["venue_travel"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "l_orderkey" in plan and plan.count(f", {1 + n // 16}), REPARTITION_BY_NUM") >= 3


def test_halves_of_the_last_digit_of_talent_go_up(spark, tmp_path):
    # the same 32 prices in each of four seasons, their cents an odd sum: the mean, and so the talent, ends in half a digit
    cents = {c: [25000000 + 3731 * c + 100977 * k + 10 * k * k for k in range(32)] for c in range(60)}
    for own in cents.values():
        own[5] += 1 - sum(own) % 2
    rows = [(c, datetime.datetime(y, 3, 1), x / 100) for c, own in cents.items() for y in (1996, 1997, 1998, 1999) for x in own]
    pq.write_table(pa.table(dict(zip(("o_custkey", "o_orderdate", "o_totalprice"), zip(*rows)))), tmp_path / "orders.parquet")
    got = {(r.o_custkey, r.y): r.talent for r in registry.queries()["talent_window"](spark, str(tmp_path)).collect()}
    assert got == {(c, y): (sum(own) * 625 + 1) // 2 / 10**6 for c, own in cents.items() for y in (1998, 1999)}


def test_books_are_added_in_the_tables_order(spark, tmp_path):
    # a gap of exactly 3 by the table's order; Spark takes the larger, later files first, and that sum ends in another digit
    book, games = [2] * 6 + [3] * 5 + [1], list(range(60))
    folder = tmp_path / "lineitem.parquet"
    folder.mkdir()
    for k, discount in enumerate([0.02, 0.06, 0.01, 0.07, 0.07, 0.07, 0.04, 0.03, 0.0, 0.0, 0.03, 0.05]):
        more = list(range(1000, 1000 + 500 * k))  # lines of no game
        n = len(games + more)
        pq.write_table(pa.table({"l_partkey": games + more, "l_linenumber": pa.array([book[k]] * n, pa.int32()), "l_discount": [discount] * n}), folder / f"part-{k:02}.parquet")
    pq.write_table(pa.table({"p_partkey": games, "p_size": pa.array([10] * 60, pa.int32())}), tmp_path / "part.parquet")
    got = {(r.game, r.quality) for r in registry.queries()["market_consensus"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"set threads = 1; create view lineitem as select * from '{folder}/*.parquet'; create view part as select * from '{tmp_path}/part.parquet'")
    assert got == set(con.execute(f"select game, quality from ({registry.oracle_sql()['market_consensus']})").fetchall()) == {(g, "firm") for g in games}


def test_a_part_that_is_there_twice_gives_one_row(spark, tmp_path):
    lines = {"l_partkey": [1, 1, 1, 2, 3], "l_linenumber": pa.array([1, 2, 3, 1, 1], pa.int32()), "l_discount": [0.01, 0.02, 0.04, 0.05, 0.06]}
    part = {"p_partkey": [1, 1, 2, 2, 4], "p_size": pa.array([10, 40, 7, 9, 5], pa.int32())}
    got, want = both(spark, tmp_path, "market_consensus", lineitem=lines, part=part)
    assert got == want == [(1, 2.0, 3, 3.0, 0.5, "firm"), (2, 5.0, 1, 0.0, -4.2, "single")]


def test_travel_moves_lines_by_order_once_whatever_rows_there_are(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ladders, "TASK_ROWS", 8)
    # order 2 of two customers, 3 of none, 1 twice; no venue is customer 5's most frequent and ties with 6's; customer 7 ties at 1 and 3
    orders = [(1, 4), (1, 4), (2, 4), (2, 8), (3, None), (4, 5), (5, 6), (6, 7), (None, 4)]
    lines = [(1, 2), (1, 2), (1, 1), (2, 1), (2, 3), (2, 9), (3, 2), (4, None), (4, None), (4, 1), (5, None), (5, 2), (6, 3), (6, 1), (None, 3), (99, 1)]
    supplier = [(1, 3, 10.5), (2, 9, 20.0), (2, 9, 20.0), (3, None, 7.0), (None, 1, 1.0)]  # one twice, one of no nation
    for t, names, rows in (("orders", ("o_orderkey", "o_custkey"), orders), ("lineitem", ("l_orderkey", "l_suppkey"), lines), ("supplier", ("s_suppkey", "s_nationkey", "s_acctbal"), supplier)):
        pq.write_table(pa.table(dict(zip(names, zip(*rows)))), tmp_path / f"{t}.parquet")
    x = registry.queries()["venue_travel"](spark, str(tmp_path))
    got = sorted((r.o_orderkey, r.venue, r.home_venue, r.climb, r.miles is None) for r in x.collect())
    visits = [(o, c, s) for o, c in orders for k, s in lines if o == k is not None and c is not None]
    count = Counter((c, s) for _, c, s in visits)
    home = {c: min((-n, s is not None, s or 0) for (d, s), n in count.items() if c == d) for _, c, _ in visits}
    home = {c: s for c, (_, known, s) in home.items() if known}
    at = [(s, nation, metres) for s, nation, metres in supplier if s is not None]
    assert got == sorted((o, s, home[c], round((a[2] - b[2]) / 10, 4), None in (a[1], b[1])) for o, c, s in set(visits) if c in home for a in at for b in at if a[0] == s and b[0] == home[c])
    assert home == {4: 2, 7: 1, 8: 1} and len(got) == 14
    ran = x._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    read = [re.findall(r"\w+\(l_suppkey\)", scan.split("\n")[0]) for scan in ran.split("FileScan ")[1:] if scan.startswith("parquet [l_orderkey")]
    assert sorted(read) == [["IsNotNull(l_suppkey)"], ["IsNull(l_suppkey)"]], ran


def test_rooms_are_rated_in_one_pass_whatever_rows_there_are(spark, tmp_path):
    # seven players of a room of four, two of them alike; a part twice; lines of no team, no day, no part; parts of no size and of one below 0
    size = {1: 3, 2: 3, 3: 3, 5: 6, 6: 6, 7: 0, 8: 9, 9: 4, 10: 5, 11: None, 13: -1}
    parts = [*size.items(), (2, 6), (None, 3)]
    lines = [(7, p, 1996, 10.0 + 3 * (p % 5)) for p in size] + [(7, 2, 1996, 40.0), (7, 7, 1997, 1.0), (None, 2, 1996, 5.0), (7, 3, None, 50.0), (7, None, 1996, 5.0), (8, 10, 1996, 4.0), (8, 99, 1996, 4.0)]
    day = lambda y: y and datetime.datetime(y, 3, 1)
    part = {"p_partkey": [p for p, _ in parts], "p_size": pa.array([s for _, s in parts], pa.int32()), "p_brand": ["b"] * len(parts), "p_retailprice": [900.0 + 5 * (s or 0) for _, s in parts]}
    line = {"l_suppkey": [x[0] for x in lines], "l_partkey": [x[1] for x in lines], "l_shipdate": [day(x[2]) for x in lines], "l_quantity": [x[3] for x in lines], "l_discount": [0.1] * len(lines)}
    pq.write_table(pa.table(part), tmp_path / "part.parquet")
    pq.write_table(pa.table(line), tmp_path / "lineitem.parquet")
    x = registry.queries()["position_rooms"](spark, str(tmp_path))
    got = sorted(tuple(r) for r in x.collect())
    con = duckdb.connect()
    con.execute(f"create view part as from '{tmp_path}/part.parquet'; create view lineitem as from '{tmp_path}/lineitem.parquet'")
    sql = registry.oracle_sql()["position_rooms"]
    want = con.execute(f"select {', '.join(x.columns)} from ({sql}) where team is not null and season is not null and kind between 0 and 2").fetchall()
    assert got == sorted(want) and [r[:4] for r in got] == [(7, 1996, 0, 4), (7, 1996, 1, 1), (7, 1996, 2, 1), (7, 1997, 0, 1), (8, 1996, 2, 1)]
    ran = x._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert ran.count("FileScan parquet [l_suppkey") == ran.count("Window [") == 1, ran
