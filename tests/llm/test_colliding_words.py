"""Words that polynomials modulo 2^64 cannot tell apart: every operator that hashes words tells them apart."""

import numpy as np
from tokenizers import Tokenizer

from loomfield.llm import decontaminate, jaccard, search, textops
from loomfield.llm.tokens import WordTokenizer, default_tokenizer_path

#: Thue-Morse string of 1,024 letters and its complement
ONE = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
TWO = ONE.translate({97: 98, 98: 97})
SCHEMA = "doc_id bigint, text string"


def test_hashes_differ():
    data = np.frombuffer((ONE + TWO).encode(), np.uint8)
    at = np.array([0, 1024]), np.array([1024, 2048])
    for h in (textops.span_hashes(data, *at), *textops.span_hashes_128(data, *at)):
        assert h[0] != h[1]


def test_hashes_are_of_bytes_alone():
    rng = np.random.default_rng(5)
    for n in (0, 1, 7, 8, 9, 63, 64, 65, 256, 257, 5000):
        word = rng.integers(0, 256, n).astype(np.uint8)
        seen = set()
        for before, after in ((0, 0), (3, 11), (17, 1)):
            data = np.concatenate((rng.integers(0, 256, before), word, rng.integers(0, 256, after))).astype(np.uint8)
            at = np.array([before]), np.array([before + n])
            seen.add((int(textops.span_hashes(data, *at)[0]), *(int(x[0]) for x in textops.span_hashes_128(data, *at))))
        assert len(seen) == 1


def test_links_hits_and_terms(spark):
    docs = spark.createDataFrame([(1, ONE), (2, TWO)], SCHEMA)
    assert sorted(r.component_id for r in jaccard.jaccard_components(docs).collect()) == [1, 2]
    items = spark.createDataFrame([(7, ONE)], "item_id bigint, text string")
    assert sorted((r.doc_id, r.n_hit) for r in decontaminate.find_contamination(docs, items).collect()) == [(1, 1), (2, 0)]
    assert all(r.query_id == r.doc_id for r in search.top_k(docs, docs, k=10).collect())


def test_tokens(monkeypatch):
    path = default_tokenizer_path()
    whole = Tokenizer.from_file(path)
    texts = [ONE, TWO, "plain words and 12 numbers", ONE[:300] + " " + TWO[:300]]
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    for same in (False, True):
        if same:  # even where every hash collides
            monkeypatch.setattr(textops, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
        own = WordTokenizer(path)
        for _ in range(2):
            ids, at = own.encode(texts)
            assert [ids[at[k] : at[k + 1]].tolist() for k in range(len(texts))] == want
