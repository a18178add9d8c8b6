"""Importance resampling against a plain Python version; pieces of long texts; awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loomfield.llm import resampling

LOW = {k: k + 32 for k in range(65, 91)}
DOCS = "doc_id bigint, text string, key string, bucket string, score int, rank int"


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def features(t, longest=2):
    w = words(t)
    return [" ".join(w[k : k + n]) for n in range(1, longest + 1) for k in range(len(w) - n + 1)]


def brute(docs, items, longest=2, buckets=10000, least=20, percent=25, seed=7):
    count = lambda t: Counter(zlib.crc32(f.encode()) % buckets for f in features(t, longest))
    own = [count(t) for _, t in docs]
    s, t = sum(own, Counter()), sum((count(x) for x in items), Counter())
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in range(buckets)}
    rows = []
    for (i, text), c in zip(docs, own):
        n = sum(c.values())
        weight = sum(gain[b] * k for b, k in c.items()) // n if n else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= least))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = able[: percent * len(able) // 100]
    out = [(*r[:4], k + 1) for k, r in enumerate(drawn)]
    left = Counter(r[:4] for r in rows) - Counter(r[:4] for r in drawn)
    return sorted(out + [(*r, None) for r in left.elements()], key=str)


def corpus():
    rng = np.random.default_rng(8)
    text = lambda n, top: " ".join(f"Word{x}" for x in rng.integers(0, top, n))
    texts = [None, "", " .,;! \n", "one", "two words", "Ünïcode ÇÉD 中文 it's a.b_c 12", "a\x00b c\x00", "x" * 9000, text(20000, 300), "the same text " * 30, "the same text " * 30]
    texts += [text(int(rng.integers(5, 300)), 40 if k % 3 else 4000) for k in range(60)]
    rows = list(enumerate(texts))
    return rows + [(9, texts[9]), (None, texts[20]), (None, None)]


ITEMS = [" ".join(f"word{k % 40}" for k in range(200)), None, "", "Two words, 12"]


@pytest.mark.parametrize("block", [1 << 20, 700])
def test_query(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(resampling, "BLOCK_BYTES", block)
    monkeypatch.setattr(resampling.text_pieces, "__defaults__", (block,))
    spark.createDataFrame([(i, t, "k", "b", 1, 2) for i, t in corpus()], DOCS).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, t) for k, t in enumerate(ITEMS)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = resampling.op11_importance_resampling(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {f.dataType.simpleString() for f in got.schema} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=str) == brute(corpus(), ITEMS)


def test_longer_runs_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, t, "k", "b", 1, 2) for i, t in corpus()], DOCS)
    items = spark.createDataFrame([(t,) for t in ITEMS], "text string")
    got = resampling.resample(docs, items, longest=3, buckets=97, least_words=1, percent=50, seed=3)
    got = got.select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted(map(tuple, got.collect()), key=str) == brute(corpus(), ITEMS, 3, 97, 1, 50, 3)
    none = resampling.resample(docs, items.limit(0))
    assert sorted((tuple(r)[0], r.n_features, r.weight, r.score, r["rank"]) for r in none.where("doc_id is not null").collect()) == sorted(r for r in brute(corpus(), []) if r[0] is not None)
    assert resampling.resample(docs.limit(0), items).count() == 0


@pytest.mark.parametrize("overlap", [0, 1, 2])
def test_pieces_lose_no_run_of_words(overlap):
    rng = np.random.default_rng(overlap)
    for most in (5, 40, 3000):
        text = " ".join("w" * int(n) for n in rng.choice([1, 2, 7, 60], 400)) + " .. end"
        parts = list(resampling.text_pieces(text.encode(), overlap, most))
        found = Counter()
        for cont, piece in parts:
            w = words(piece.decode())
            for n in range(1, overlap + 2):
                found.update(" ".join(w[k : k + n]) for k in range(len(w) - n + 1) if k + n > cont)
        assert found == Counter(features(text, overlap + 1))
        assert all(len(p) <= 2 * most + 200 * (overlap + 1) for _, p in parts)
