"""Rows that share an id, hold no id or are repeated whole: each stage keeps and cuts what brute force does."""

import hashlib
import re
from collections import Counter

import numpy as np

from loomfield.llm import jaccard, suffix_dedup

SCHEMA = "doc_id bigint, text string, lang string"
A = " ".join(f"alpha{k} Beta{k % 7}" for k in range(60))
B = " ".join(f"gamma{k} delta{k % 5}" for k in range(80))
C = " ".join(f"none{k} like{k % 9}" for k in range(70))


def rows():
    """Repeated rows, one text under many ids and under none, several texts of one id, unrelated texts without an id."""
    texts = [(1, A)] * 4 + [(2, A)] * 2 + [(None, A)] * 3 + [(3, B), (3, "short text of an id that repeats"), (3, B[:300] + " and more of it")]
    texts += [(None, C)] * 3 + [(None, "unrelated words and no id"), (None, B[40:260] + " some other end"), (None, None), (4, ""), (4, ""), (5, None)]
    return [(i, t, "abc"[k % 3]) for k, (i, t) in enumerate(texts)]


def cut_by_brute_force(texts):
    seen = Counter(b[k : k + 200] for b in texts for k in range(len(b) - 199))
    out = []
    for b in texts:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        out.append((int(gone.sum()), bytes(x for x, g in zip(b, gone) if not g)))
    return out


def test_op1_gives_one_row_a_row(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    texts = [(t or "").encode() for _, t, _ in rows()]
    want = [(i, len(b), n, hashlib.sha256(kept).hexdigest()) for (i, *_), b, (n, kept) in zip(rows(), texts, cut_by_brute_force(texts))]
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.op1_suffix_dedup(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_remove_repeats_cuts_each_row_by_its_own_text(spark, monkeypatch):
    texts = [(t or "").encode() for _, t, _ in rows()]
    want = [(i, t if not n else kept.decode(), c) for (i, t, c), (n, kept) in zip(rows(), cut_by_brute_force(texts)) if not n or kept]
    docs = spark.createDataFrame(rows(), SCHEMA)
    for heavy in (1000, 3):
        monkeypatch.setattr(suffix_dedup, "HEAVY", heavy)
        got = [tuple(r) for r in suffix_dedup.remove_repeats(docs).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_keep_one_of_each_keeps_one_row_a_component(spark):
    size, percent = 4, 85
    low = {k: k + 32 for k in range(65, 91)}
    base = rows()
    sets = []
    for _, t, _ in base:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append(frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset())
    comp = list(range(len(base)))
    for _ in base:
        for a in range(len(base)):
            for b in range(len(base)):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    want = []
    for c in set(comp):
        own = [base[k] for k in range(len(base)) if comp[k] == c]
        want.append(min(own, key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).digest(), r[2])))
    got = [tuple(r) for r in jaccard.keep_one_of_each(spark.createDataFrame(base, SCHEMA), size=size, percent=percent).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
