"""Tensored banding against brute force: links, components, awkward rows, hot groups."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomfield.llm import jaccard, minhash, shared
from loomfield.llm.minhash import Bands, bands_for, minhash_components

LOW = {k: k + 32 for k in range(65, 91)}
SCHEMA = "doc_id bigint, text string, component_id string, node int, token int"


def sets_of(rows, size):
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        out.append(frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset())
    return out


def brute(rows, size, percent):
    """(doc_id, n_shingles, component_id) by all pairs."""
    sets, root = sets_of(rows, size), list(range(len(rows)))
    ids = [i for i, _ in rows]

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for k, i in enumerate(ids):
        c = find(k)
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return sorted(((i, len(sets[k]), least.get(find(k), i)) for k, i in enumerate(ids)), key=str)


def corpus():
    """Awkward rows, and families of edited copies around the threshold, one of them a third of all rows."""
    rng = np.random.default_rng(3)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    texts = [None, "", " \t\n", "one", "One", "a b c", "a b c d e", "x" * 5000, " ".join(f"long{k}" for k in range(30000))]
    for _ in range(12):
        base = word(int(rng.integers(20, 200)))
        for _ in range(4):
            own = list(base)
            for k in rng.integers(0, len(own), int(rng.integers(0, 1 + len(own) // 30))):
                own[k] = f"edit{rng.integers(0, 9999)}"
            texts.append(" ".join(own))
    base = word(150)
    for _ in range(30):
        own = list(base)
        for k in rng.integers(0, 150, 3):
            own[k] = f"hot{rng.integers(0, 9999)}"
        texts.append(" ".join(own))
    rows = list(enumerate(texts))
    return rows + [(20, texts[20]), (None, texts[21]), (None, "text of a row without an id")]


@pytest.mark.parametrize(("size", "percent"), [(5, 85), (5, 80), (3, 60)])
def test_components(spark, size, percent):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "c", 1, 2) for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash_components(docs, size=size, percent=percent).collect()), key=str)
    assert got == brute(rows, size, percent)


def test_query(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame([(i, t, "c", 1, 2) for i, t in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = minhash.op12_tensored_minhash(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    want = [(i, n, c, i == c) for i, n, c in brute(rows, 5, 85)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    none = spark.createDataFrame([], SCHEMA)
    assert minhash_components(none).count() == 0


def test_band_counts_and_misses():
    for percent in (50, 80, 85, 100):
        m, alike = bands_for(percent), (percent / 100) ** minhash.ROWS
        assert 2 * (1 - alike) ** m <= minhash.MISS
    assert 2 * bands_for(85) * minhash.ROWS <= 48  # minhashes for 144 tables of four
    rng = np.random.default_rng(9)
    bands, met, alike = Bands(85), 0, []
    for _ in range(400):
        grams = rng.integers(0, 1 << 64, 300, np.uint64)
        other = np.concatenate((grams[23:], rng.integers(0, 1 << 64, 23, np.uint64)))
        same = bands.of(grams) == bands.of(other)
        alike.append((bands.minhashes(grams) == bands.minhashes(other)).mean())
        met += bool(same[: bands.m].any() and same[bands.m :].any())
    assert met == 400
    assert abs(np.mean(alike) - 277 / 323) < 0.01  # minhashes agree as often as the sets are similar


def test_long_sets_are_hashed_in_chunks():
    grams = np.random.default_rng(1).integers(0, 1 << 64, 3 * minhash.CHUNK + 7, np.uint64)
    bands = Bands(85)
    assert (bands.minhashes(grams) == (grams[:, None] * bands.times + bands.plus).min(0)).all()


def test_spread_join_keeps_rows_of_heavy_keys(spark):
    many = spark.range(5000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id") % 50).cast("bigint").alias("key"), "id")
    one = spark.range(0, 40).select(F.col("id").alias("key"), (F.col("id") * 10).alias("value"))
    counts = many.groupBy("key").agg(F.count("*").alias("c"))
    got = shared.spread_join(many, one, "key", counts, "id")
    assert sorted(map(tuple, got.select("key", "id", "value").collect())) == sorted(map(tuple, many.join(one, "key").select("key", "id", "value").collect()))


@pytest.mark.parametrize("hot", [(256, 50), (1, 20)])
def test_meetings_join_all_nodes_of_a_token(spark, monkeypatch, hot):
    monkeypatch.setattr(jaccard, "SAMPLE", hot[0])
    monkeypatch.setattr(jaccard, "HOT_SAMPLE", hot[1])
    rows = [(n, n % 7) for n in range(300)] + [(n, 100 + n) for n in range(300)] + [(5, 5), (7, 200), (8, 200)]
    tokens = spark.createDataFrame(rows, "node bigint, token bigint").repartition(5)
    met = {tuple(r) for r in jaccard.meetings(tokens).collect()}
    want = {}
    for n, t in rows:
        want.setdefault(t, set()).add(n)
    assert all(a != b and any({a, b} <= s for s in want.values()) for a, b in met)
    for s in want.values():  # a star over every token's nodes
        assert len(s) == 1 or any(all((c, n) in met for n in s - {c}) for c in s)
