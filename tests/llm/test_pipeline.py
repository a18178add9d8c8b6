"""The whole pipeline against brute force, on rows with nulls, repeats, copies, near copies, passages and benchmark text."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from test_plain_scorers import plain_gam, plain_quality

import corpus_pipeline
from loomfield.llm import quality
from loomfield.llm.tokens import WordTokenizer, default_tokenizer_path

LOW = {k: k + 32 for k in range(65, 91)}
A = " ".join(f"alpha{k} Beta{k % 7}" for k in range(60))
B = " ".join(f"gamma{k} delta{k % 5}" for k in range(80))
PASSAGE = " ".join(f"shared{k} passage" for k in range(40))
ITEM = " ".join(f"question{k}" for k in range(20))


def rows():
    texts = [(1, A), (2, A), (2, A), (None, A), (3, A.replace("alpha30 ", "edited ")), (4, B + " tail"), (5, "head " + B.replace("gamma9 ", "other ")), (6, None), (7, ""), (8, "  "), (9, "one two"), (9, "one two"),
             (10, "start of ten. " + PASSAGE + " end of ten"), (11, "another start. " + PASSAGE + " and its own end here"), (12, "before " + ITEM + " after"), (13, ITEM + " " + " ".join(f"filler{k}" for k in range(900))),
             (None, "no id and some words of its own"), (14, " ".join(f"long{k}" for k in range(6000))), (15, "x" * 700), (16, "Ünïcode çédille " * 3)]
    return [(i, t, "en", "web", None if t is None else len(t)) for i, t in texts]


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def one_of_each(docs):
    sets = [shingles(r[1]) for r in docs]
    comp = list(range(len(docs)))
    for _ in docs:
        for a in range(len(docs)):
            for b in range(len(docs)):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    best = lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).digest())
    return [min((docs[k] for k in range(len(docs)) if comp[k] == c), key=best) for c in sorted(set(comp))]


def without_repeats(docs):
    raw = [(r[1] or "").encode() for r in docs]
    seen = Counter(b[k : k + 200] for b in raw for k in range(len(b) - 199))
    out = []
    for r, b in zip(docs, raw):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        if gone.any():
            text = bytes(x for x, g in zip(b, gone) if not g).decode(errors="ignore")
            out += [(r[0], text, r[2], r[3], len(text))] if text else []
        else:
            out.append(r)
    return out


def uncontaminated(docs):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    v = words(ITEM)
    windows = {tuple(v[k : k + 13]) for k in range(len(v) - 12)}
    out = []
    for r in docs:
        w = words(r[1])
        hit = {p for k in range(len(w) - 12) if tuple(w[k : k + 13]) in windows for p in range(k, k + 13)}
        out += [r] if not hit or 20 * len(hit) < len(w) else []
    return out


def pieces(docs):
    whole = WordTokenizer(default_tokenizer_path()).whole
    out = []
    for r in docs:
        ids = np.array([*whole.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        out += [(r[0], k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    return out


def same(got, want):
    return sorted(map(str, got)) == sorted(map(str, want))


def junk():
    """Rows that their labels call bad, and good ones, told apart by their signs and capitals; copies among them."""
    rng = np.random.default_rng(13)
    bad = [" ".join(f"$$BUY{x}!! | {x}{x}{x}#" for x in rng.integers(0, 99, int(rng.integers(6, 30)))) for _ in range(40)]
    good = [" ".join(f"calm{x} words." for x in rng.integers(0, 900, int(rng.integers(30, 60)))) for _ in range(40)]
    texts = [*bad, *good, bad[3], good[5], good[5]]
    return [(100 + k, t, "en", "web", len(t)) for k, t in enumerate(texts)]


@pytest.mark.parametrize("classes", [1, 2])
def test_pipeline_equals_brute_force(spark, tmp_path, classes):
    base = rows() + (junk() if classes == 2 else [])
    docs = spark.createDataFrame(base, "doc_id bigint, text string, lang string, source string, n_chars int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    # with one class of labels the classifier rejects nothing
    labels = [(1, 1, 0), (4, 1, 0)] if classes == 1 else [(r[0], int(r[0] >= 140), 0) for r in junk()[:80]]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    model = quality.train_on_texts(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))

    def good_enough(docs):
        kept = [r for r in docs if plain_gam(model, np.array(plain_quality(r[1]), np.float32)) >= quality.THRESHOLD]
        assert (len(kept) < len(docs)) == (classes == 2)
        return kept

    got, want = docs, base
    for (name, stage), brute in zip(corpus_pipeline.STAGES[:-1], (good_enough, one_of_each, without_repeats, uncontaminated)):
        got = corpus_pipeline.materialize(stage(spark, got, str(tmp_path)), name)
        want = brute(want)
        assert got.columns == docs.columns and same((tuple(r) for r in got.collect()), want), name
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert same(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed), pieces(want))
    filled = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 2048


def test_quality_stage_keeps_what_the_trained_model_scores_high_enough(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(quality.feature_rows(docs), labels)
    base = docs.collect()
    scores = model.score(quality.quality_features(pa.array([r.text for r in base])))
    got = corpus_pipeline.quality_classifier(spark, docs, sf).collect()
    assert same(got, [r for r, s in zip(base, scores) if s >= quality.THRESHOLD])
