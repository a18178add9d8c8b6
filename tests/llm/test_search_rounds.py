"""Rounds of op9's search over many shards."""

import random

from loomfield.llm import search


def test_thresholds_rise_from_round_to_round(spark, monkeypatch):
    """Widening rounds give what one pass over all shards gives, and find fewer rows on the way."""
    draw, kept = random.Random(5), []
    words = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([(k, " ".join(draw.choices(words, k=20))) for k in range(1500)], "doc_id bigint, text string").coalesce(1)
    asked = docs.where("doc_id % 50 = 0")
    rows = lambda: sorted(map(tuple, search.top_k(docs, asked, k=2, shard_postings=150).collect()))
    want = rows()
    write = search.materialize

    def counted(df, name, *by):
        out = write(df, name, *by)
        kept.extend([out.count()] if name == "found" else [])
        return out

    monkeypatch.setattr(search, "materialize", counted)
    monkeypatch.setattr(search, "FIRST_DOCS", 8)
    monkeypatch.setattr(search, "WIDEN", 4, raising=False)
    assert rows() == want and len({r[0] for r in want}) == 30
    assert len(kept) >= 4 and sum(kept) < 30 * 2 * 20
