"""All queries of the library, by name."""

from __future__ import annotations

from loomfield.plans import events_lineitem, fitted, ladders, matrices, models, plays, repairs, results, texts

_PARTS = (events_lineitem, models, repairs, plays, texts, ladders, fitted, matrices, results)


def queries():
    return {name: f for part in _PARTS for name, f in part.QUERIES.items()}


def oracle_sql():
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
