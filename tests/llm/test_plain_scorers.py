"""The classifiers' queries and the training order against plain Python: features, tables, trees and permutation one by one."""

import bisect
import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loomfield.llm import features as X
from loomfield.llm import quality, token_files, toxicity
from loomfield.llm.tokens import WordTokenizer, default_tokenizer_path

SPACE = set(b" \t\n\v\f\r")


def corpus():
    rng = np.random.default_rng(21)
    good = [" ".join(f"Word{x} text." for x in rng.integers(0, 900, int(rng.integers(5, 60)))) for _ in range(60)]
    junk = [" ".join(f"$$BUY{x % 3}!! | idiot you" for x in rng.integers(0, 9, int(rng.integers(3, 40)))) + "\n" * (k % 4) for k in range(60)]
    odd = [None, "", " \n", "one", "ÜÑÏ code. Ça 中文", "x" * 3000, "same line\n" * 20, "a1b 1d10t you"]
    texts = [*good, *junk, *odd]
    return list(enumerate(texts)) + [(5, texts[5]), (None, texts[70])]


def plain_quality(text):
    """One row of QUALITY of a text, from its bytes."""
    b = (text or "").encode()
    n = max(1, len(b))
    words, here = [], b""
    for x in b + b" ":
        if x in SPACE:
            words, here = (words + [here] if here else words), b""
        else:
            here += bytes([x])
    w = max(1, len(words))
    length = [len(x) for x in words]
    mean = sum(length) / w
    sd = math.sqrt(max(0.0, sum(x * x for x in length) / w - mean**2))
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(b).values())
    rates = [sum(bool(v[x]) for x in b) / n for v in X._BYTE_CLASSES.values()]
    pairs = list(zip(words, words[1:]))
    lines = [x for x in b.split(b"\n") if x]
    stops = sum(x in b".!?" for x in b)
    tail = set(b"#$%&*@^~=+<>_\\!|")
    return [
        math.log1p(len(b)), math.log1p(len(words)), mean, sd, max(length, default=0), entropy, *rates, len(set(words)) / math.sqrt(w), len(set(pairs)) / len(pairs) if pairs else 1.0,
        max(Counter(words).values(), default=0) / w, len(set(lines)) / len(lines) if lines else 1.0, len(words) / max(1, len(lines)), sum(65 <= x[0] <= 90 for x in words) / w, sum(x[-1] in tail for x in words) / w,
        sum(97 <= x[0] <= 122 for x in words) / w, len(words) / (1 + stops),
    ]


def plain_gam(model, x):
    margin = model.base
    for edges, table, v in zip(model.edges, model.tables, x):
        margin += table[bisect.bisect_right(edges.tolist(), v)]
    for i, j, a, b, grid in model.pairs:
        margin += grid[bisect.bisect_right(a.tolist(), x[i]) * quality.PAIR_BINS + bisect.bisect_right(b.tolist(), x[j])]
    return 1 / (1 + math.exp(-margin))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plain"))
    spark.createDataFrame(corpus(), "doc_id bigint, text string").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, int(k < 60), int(60 <= k < 120)) for k in range(0, 120)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_quality_features():
    texts = [t for _, t in corpus()]
    got = X.quality_features(pa.array(texts, pa.string()))
    want = np.array([plain_quality(t) for t in texts])
    assert got.shape == want.shape and np.allclose(got, want, rtol=1e-5, atol=1e-5)


def test_quality_query(spark, tables):
    docs, labels = spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/labels.parquet")
    model = quality.train_on_texts(docs, labels)
    assert model.pairs and sum(len(t) for t in model.tables) > len(model.tables)
    want = []
    for i, t in corpus():
        score = plain_gam(model, np.array(plain_quality(t), np.float32))
        want.append((i, i is not None and zlib.crc32(str(i).encode()) % 5 == 0, score))
    got = quality.op2_quality_gam(spark, tables).collect()
    key = lambda r: (str(r[0]), round(r[2], 6))
    got = sorted(((r.doc_id, r.held_out, r.score, r.predicted) for r in got), key=key)
    for g, w in zip(got, sorted(want, key=key), strict=True):
        assert g[:2] == w[:2] and abs(g[2] - w[2]) < 1e-6 and g[3] == int(g[2] >= 0.3)
    held = [g for g in got if g[1] and g[0] is not None and g[0] < 120]
    assert np.mean([g[3] == (g[0] < 60) for g in held]) > 0.9


def test_toxicity_query(spark, tables):
    docs, labels = spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/labels.parquet")
    model = toxicity.train(docs, labels)
    x = X.toxicity_features(pa.array([t for _, t in corpus()], pa.string()), model.lexicon)
    names = dict(zip(X.TOXICITY, range(len(X.TOXICITY))))
    want = []
    for (i, t), row in zip(corpus(), x):
        words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
        w = max(1, len(words))
        assert abs(row[names["log_words"]] - math.log1p(len(words))) < 1e-5
        assert abs(row[names["second_person_density"]] - sum(x in X.SECOND_PERSON for x in words) / w) < 1e-5
        assert row[names["seed_hits"]] == sum(x in X.SEED_LEXICON for x in words)
        assert abs(row[names["shout_rate"]] - (t or "").count("!") / max(1, len((t or "").encode()))) < 1e-5
        margin = model.trees.base
        for feature, cut, value in model.trees.trees:
            node = 0
            for _ in range(model.trees.depth):
                k = feature[node]
                node = 2 * node + 1 + (bisect.bisect_right(model.trees.edges[k].tolist(), row[k]) > cut[node])
            margin += value[node - (2**model.trees.depth - 1)]
        xs, ys = (v.tolist() for v in model.knots)
        if margin <= xs[0] or margin >= xs[-1]:
            score = ys[0] if margin <= xs[0] else ys[-1]
        else:
            k = bisect.bisect_right(xs, margin)
            score = ys[k - 1] + (ys[k] - ys[k - 1]) * (margin - xs[k - 1]) / (xs[k] - xs[k - 1])
        want.append((i, i is not None and zlib.crc32(str(i).encode()) % 3 == 1, score))
    key = lambda r: (str(r[0]), round(r[2], 6))
    got = sorted(((r.doc_id, r.held_out, r.score, r.predicted) for r in toxicity.op3_toxicity_trees(spark, tables).collect()), key=key)
    for g, w in zip(got, sorted(want, key=key), strict=True):
        assert g[:2] == w[:2] and abs(g[2] - w[2]) < 1e-6 and g[3] == int(g[2] >= 0.7)
    assert np.mean([g[3] == (g[0] >= 60) for g in got if g[0] is not None and g[0] < 120]) > 0.9


def plain_slot(x, n, key, rounds=6):
    """The slot of sequence ``x`` of ``n`` in plain integers: Feistel rounds on halves of a power of four, walked on until inside."""
    m, half = (1 << 64) - 1, 1
    while 4**half < n:
        half += 1
    mask = (1 << half) - 1
    while True:
        left, right = x >> half, x & mask
        for k in range(1, rounds + 1):
            h = (right + key + 0x9E3779B97F4A7C15 * k) * 0xBF58476D1CE4E5B9 & m
            h = (h ^ h >> 29) * 0x94D049BB133111EB & m
            left, right = right, left ^ (h >> 32 & mask)
        x = left << half | right
        if x < n:
            return x


def test_order_is_a_permutation_of_whole_sequences(spark, tables):
    tok = WordTokenizer(default_tokenizer_path(), special_as_text=True)
    rows = token_files.op8_feistel_order(spark, tables).collect()
    n = len(rows)
    assert sorted(r.slot for r in rows) == list(range(n)) and n > 3
    assert all(r.payload_crc32 == zlib.crc32(bytes(r.payload)) and len(r.payload) == 2 * token_files.SEQUENCE for r in rows)
    # by file and sequence the payloads are the documents' ids, each document ended once
    ids = []
    for r in sorted(rows, key=lambda r: (r.file, r.sequence)):
        ids += np.frombuffer(bytes(r.payload), "<u2")[: r.n_tokens].tolist()
    docs, here = [], []
    for x in ids:
        here.append(x)
        if x == token_files.EOD:
            docs.append(tuple(here[:-1]))
            here = []
    want = []
    for _, t in corpus():
        got, at = tok.encode([t or ""])
        want.append(tuple(got.tolist()))
    assert not here and sorted(docs) == sorted(want)
    for number, r in enumerate(sorted(rows, key=lambda r: (r.file, r.sequence))):
        assert r.slot == plain_slot(number, n, token_files.KEY)


def test_permutation():
    for n in (1, 2, 3, 5, 64, 65, 1000):
        got = token_files.feistel(np.arange(n), n, 77).tolist()
        assert sorted(got) == list(range(n)) and got == [plain_slot(x, n, 77) for x in range(n)]


def test_long_texts_take_a_bounded_multiple_of_their_bytes():
    text = pa.array([" ".join(f"w{k % 5000}" for k in range(400_000))])
    size = len(text[0].as_py())
    for run, most in ((X.quality_features, 14), (lambda t: X.toxicity_features(t, X.Lexicon({}, {k: {} for k in X.PREFIXES})), 30)):
        tracemalloc.start()
        run(text)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most * size
