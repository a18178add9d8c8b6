"""The training-data operators against brute force, round trips and held-out labels, and on awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomfield.llm import decontaminate, jaccard, packing, quality, search, sharding, suffix_dedup, token_files, toxicity
from loomfield.llm.fm_index import suffix_order
from loomfield.llm.suffix_sort import sort_windows
from loomfield.llm.tokens import WordTokenizer, default_tokenizer_path

LOW = {k: k + 32 for k in range(65, 91)}
A = " ".join(f"alpha{k} Beta{k % 7}" for k in range(60))
SCHEMA = "doc_id bigint, text string, shard string, score string, n_words int"


def rows():
    """Nulls, empties, copies, near copies, a very long text, ties, repeated rows; columns of clashing names."""
    texts = [None, "", " \n", "one", "a b c", A, A, A + " tail end of it", A.replace("alpha3 ", "alphaX "), "prefix words " + A, "x" * 5000, "ab " * 900, "Ünïcode çédille ¿qué? 中文 it's <|endoftext|> 12 3",
             " ".join(f"w{k}" for k in range(20000)), "zz " + " ".join(f"w{k}" for k in range(100, 400))]
    return [(k, t, "s", "y", 1) for k, t in enumerate(texts)] + [(5, A, "s", "y", 1), (None, "no id here at all", "s", "y", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words5(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))


def words6(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def test_sorters():
    rng = np.random.default_rng(0)
    for _ in range(30):
        base = rng.integers(97, 100, 300).astype(np.uint8)
        data = np.concatenate((base, base[:150], np.full(100, 97, np.uint8)))
        at = rng.permutation(len(data) - 63)
        order, same = sort_windows(data, at, 64)
        got = [data[s : s + 64].tobytes() for s in at[order]]
        assert got == sorted(got) and all(same[k] == (got[k] == got[k - 1]) for k in range(1, len(got)))
        s = np.concatenate((rng.integers(0, 4, 199), [0]))
        key = lambda p: (*s[p : p + next((k for k in range(200 - p) if s[p + k] == 0), 200 - p)], 0, p)
        assert suffix_order(s).tolist() == sorted(range(200), key=key)


@pytest.mark.parametrize("hot", [4 << 20, 500])
def test_suffix_dedup(spark, docs, none, hot):
    base = [(r[0], r[1]) for r in rows()]
    windows = Counter()
    for _, t in base:
        b = (t or "").encode()
        windows.update(b[k : k + 200] for k in range(len(b) - 199))
    want = []
    for i, t in base:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 199):
            if windows[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        want.append((i, len(b), int(gone.sum()), bytes(x for x, g in zip(b, gone) if not g)))
    found, cuts = suffix_dedup.find_repeats(docs.select("doc_id", "text"), hot=hot, keep_text=True)
    cut = {bytes(r.h): r for r in cuts.collect()}
    got = []
    for r in found.collect():
        if (r.copies or 1) > 1 and r.n_bytes >= 200:
            got.append((r.doc_id, r.n_bytes, r.n_bytes, hashlib.sha256(b"").digest()))
        else:
            c = cut.get(bytes(r.h))
            got.append((r.doc_id, r.n_bytes, c.n_removed if c else 0, bytes(c.kept_sha if c else r.sha)))
    assert sorted(got, key=str) == sorted([(i, n, g, hashlib.sha256(k).digest()) for i, n, g, k in want], key=str)
    assert suffix_dedup.remove_repeats(docs).columns == docs.columns
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_suffix_dedup_of_parts_of_one_passage(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HEAVY", 3)
    rng = np.random.default_rng(11)
    word = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8))
    passage, beat = word(700), word(90)
    texts = []
    for k in range(70):
        x = int(rng.integers(0, 400)) if k % 2 else 100
        part = bytearray(passage[x : x + int(rng.integers(150, 600))])
        if k % 5 == 0 and len(part) > 300:
            part[int(rng.integers(0, len(part)))] = 65
        texts.append((word(int(rng.integers(0, 60))) + bytes(part) + word(int(rng.integers(0, 60))) + (beat * (k % 4) if k % 7 == 0 else b"")).decode())
    seen = Counter(t.encode()[k : k + 200] for t in texts for k in range(len(t) - 199))
    want = []
    for t in texts:
        hit = np.zeros(len(t), bool)
        for k in range(len(t) - 199):
            if seen[t.encode()[k : k + 200]] > 1:
                hit[k : k + 200] = True
        want.append(int(hit.sum()))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for hot in (300, 6000):
        found, cuts = suffix_dedup.find_repeats(docs, hot=hot)
        lost = found.join(cuts, "h", "left").selectExpr("doc_id", "coalesce(n_removed, 0) as n")
        assert [r.n for r in lost.orderBy("doc_id").collect()] == want


def test_jaccard(spark, docs, none):
    sets = {}
    for i, t, *_ in rows():
        w = words5(t)
        sets.setdefault(i, frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset())
    ids = [i for i in sets if i is not None]
    comp = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert {i: got[i] for i in ids} == {i: (len(sets[i]), comp[i]) for i in ids}
    assert jaccard.jaccard_components(none).count() == 0


def test_jaccard_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = np.random.default_rng(3)
    base = [f"t{k}" for k in range(120)]
    texts = []
    for k in range(60):
        w = list(base)
        for p in rng.choice(120, k % 9, replace=False):
            w[p] = f"e{k}_{p}"
        texts.append((k, " ".join(w)))
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(117)} for i, t in texts}
    comp = {i: i for i in sets}
    for _ in range(6):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    got = jaccard.jaccard_components(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == comp


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontaminate(spark, docs, none, block_bytes):
    items = [(1, " ".join(f"alpha{k} beta{k % 7}" for k in range(10, 30))), (2, "A, b c!"), (3, None), (4, "..."), (5, "w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17 w18 w19 w20"), (5, "one")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = []
    for i, t, *_ in rows():
        w, hit, found = words6(t), set(), set()
        for item, x in items:
            v = words6(x)
            n = min(13, len(v))
            for s in range(len(v) - n + 1 if v else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit.update(range(p, p + n))
                        found.add(str(item))
        want.append((i, len(w), len(hit), sorted(found)))
    got = [(r.doc_id, r.n_words, r.n_hit, sorted(r["items"])) for r in decontaminate.find_contamination(docs, bench, block_bytes=block_bytes).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert decontaminate.find_contamination(none, bench).count() == 0
    assert decontaminate.find_contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_sharding(spark, docs, none):
    more = docs.unionByName(docs.where("doc_id = 5")).unionByName(spark.createDataFrame([(9, "same row", None, None, None)] * 40, SCHEMA))
    placed = []
    for parts, adaptive, cut in ((8, "true", 1), (3, "true", 5), (5, "false", 2)):  # the order follows from seed and rows alone
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        placed.append([tuple(r) for r in sharding.external_shuffle(more.repartition(cut), size=sharding.row_bytes(), bucket_bytes=4000).collect()])
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted(placed[0], key=str) == sorted(placed[1], key=str) == sorted(placed[2], key=str)
    other = sharding.external_shuffle(more, size=sharding.row_bytes(), bucket_bytes=4000, seed=1).collect()
    assert sorted(map(str, other)) != sorted(map(str, placed[0]))
    names = [c for c in docs.columns if c != "shard"]
    want = Counter(tuple(r[c] for c in names) for r in more.collect())
    got = sharding.external_shuffle(more, size=sharding.row_bytes(), bucket_bytes=4000)
    assert got.columns == [*names, "shard", "slot"]
    slots, found = defaultdict(list), Counter()
    for r in got.collect():
        slots[r["shard"]].append(r.slot)
        found[tuple(r[c] for c in names)] += 1
    assert found == want and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.external_shuffle(none).count() == 0


def test_op4_rows_are_those_of_the_table(spark):
    sf = "/root/testdata/sf0.001"
    base = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {r.doc_id: (len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in base}
    got = sharding.op4_external_shuffle(spark, sf).collect()
    assert {r.doc_id: (r["size"], r.text_crc32) for r in got} == want and len(got) == len(base)
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values()) and {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}


def test_tokens_and_packing(spark, docs, none):
    whole = WordTokenizer(default_tokenizer_path())
    for t in (r[1] for r in rows()):
        ids, _ = whole.encode([t])
        assert ids.tolist() == whole.whole.encode(t or "", add_special_tokens=False).ids
    got = packing.pack_documents(docs).toPandas()
    want = []
    for i, t, *_ in rows():  # every row's whole ids and the end id, cut by brute force
        ids = np.array([*whole.whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(str(i), p, 2048 * p, ids[2048 * p : 2048 * (p + 1)].tobytes()) for p in range(-(-len(ids) // 2048))]
    found = [(str(None if i != i else int(i)), p, s, bytes(x)) for i, p, s, x in zip(got["doc_id"], got["piece"], got["start"], got["ids"])]
    assert sorted(found) == sorted(want)
    assert [zlib.crc32(x) for x in got["ids"]] == got["ids_crc32"].tolist() and [len(x) // 4 for x in got["ids"]] == got["length"].tolist()
    seq = got.sort_values(["sequence_id", "offset"])
    assert (seq["offset"] == seq.groupby("sequence_id")["length"].cumsum() - seq["length"]).all()
    assert seq.groupby("sequence_id")["length"].sum().max() <= 2048
    assert packing.pack_documents(none).count() == 0


def test_plan_uses_every_piece_and_leaves_little_to_best_fit(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    own = np.zeros(2049, np.int64)
    for r in packing.tokenize_pieces(docs, keep_ids=False).groupBy("length").count().collect():
        own[r["length"]] = r["count"]
    even = np.bincount(np.random.default_rng(0).integers(1, 2049, 5000), minlength=2049)
    for counts, most_left in ((own, 0.05), (own * 25, 0.05), (even, 1.0), (np.bincount([2048, 1, 1024, 1024, 7], minlength=2049), 1.0), (own * 0, 0)):
        used, n = np.zeros(2049, np.int64), 0
        plan, left = packing._fitted(counts)
        for pattern, repeats in plan:
            assert sum(pattern) <= 2048
            n += repeats
            for x in pattern:
                used[x] += repeats
        assert (used == counts).all() and n <= 1.01 * (counts * np.arange(2049)).sum() / 2048 + 1
        assert left <= most_left * counts[:2048].sum()


def test_token_files(spark, docs, none):
    blocks, manifest = token_files.write_token_files(docs, block=4096)
    got = token_files.token_counts(blocks).join(manifest, ["file", "ordinal"]).collect()
    tok = WordTokenizer(default_tokenizer_path(), True)
    want = sorted((str(r[0]), len(tok.encode([r[1]])[0])) for r in rows())
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == want
    flat = defaultdict(bytes)
    for r in blocks.orderBy("file", "block").collect():
        flat[r.file] += bytes(r.payload)
    stride, per_shard = 1024, 8  # brute force: pad, cut, number in order of files, and place by the permutation
    cut = [(f, i, x[stride * i : stride * (i + 1)]) for f, x in sorted(flat.items()) for i in range(-(-len(x) // stride))]
    slots = token_files.feistel(np.arange(len(cut)), len(cut)).tolist()
    pad = token_files.EOD.to_bytes(2, "little")
    brute = {s: (f, i, len(x) // 2, x + pad * ((stride - len(x)) // 2)) for s, (f, i, x) in zip(slots, cut)}
    shards = token_files.write_training_shards(token_files.training_order(blocks, length=512, block=4096), length=512, shard_slots=per_shard)
    assert shards.count() == -(-len(cut) // per_shard)
    for begin in (0, 1, per_shard, per_shard + 3, len(cut) - 1, len(cut), len(cut) + 100):
        got = token_files.read_training_shards(shards, begin, shard_slots=per_shard).collect()
        assert {r.slot: (r.file, r.sequence, r.n_tokens, bytes(r.payload)) for r in got} == {s: v for s, v in brute.items() if s >= begin}
        assert all(r.shard == r.slot // per_shard and r["at"] == r.slot % per_shard * stride for r in got)
    assert token_files.write_training_shards(token_files.training_order(token_files.write_token_files(none)[0])).count() == 0
    for n in (1, 2, 5, 1000):
        assert sorted(token_files.feistel(np.arange(n), n).tolist()) == list(range(n))
    assert token_files.token_counts(token_files.write_token_files(none)[0]).count() == 0


def brute_search(base, asked, k):
    """Sorted (query, rank, document, score) of every query row, by scoring all rows."""
    counts = [(i, Counter(words6(t))) for i, t in base if words6(t)]
    n, mean = len(counts), sum(sum(c.values()) for _, c in counts) / max(1, len(counts))
    df = Counter(t for _, c in counts for t in c)
    out = []
    for i, text in asked:
        scored = []
        for j, c in counts:
            both = set(words6(text)) & set(c)
            score = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 1.9 / (c[t] + 0.9 * (0.6 + 0.4 * sum(c.values()) / mean)) for t in both)
            scored += [(-round(score, 7), j is None, j or 0, j)] if both else []
        out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return out


@pytest.mark.parametrize("postings,block_bytes", [(2_000_000, 8 << 20), (400, 200_000)])
def test_search(spark, docs, none, postings, block_bytes):
    """Null and repeated ids, repeated queries and ties; many small shards and several blocks of queries give the same."""
    base = [(r[0], r[1]) for r in rows()] + [(k, f"tie one two w{k % 4}") for k in range(100, 140)] + [(None, "tie one"), (None, "tie one")]
    own = spark.createDataFrame(base, "doc_id bigint, text string").withColumn("score", F.lit("x")).repartition(7)
    asked = [r for r in base if r[0] is None or r[0] % 2] + [(5, A), (7, "no such words here"), (9, None)]
    got = search.top_k(own, spark.createDataFrame(asked, "doc_id bigint, text string"), k=4, block_bytes=block_bytes, shard_postings=postings).collect()
    assert sorted(((r.query_id, r.rank, r.doc_id, round(r.score, 5)) for r in got), key=str) == sorted(((q, r, d, round(s, 5)) for q, r, d, s in brute_search(base, asked, 4)), key=str)
    assert search.top_k(none.select("doc_id", "text"), none.select("doc_id", "text")).count() == 0
    assert search.top_k(own, none.select("doc_id", "text")).count() == 0


@pytest.mark.parametrize("op,label,threshold", [(quality.op2_quality_gam, "quality", 0.3), (toxicity.op3_toxicity_trees, "toxic", 0.7)])
def test_classifiers_on_held_out_labels(spark, op, label, threshold):
    sf = "/root/testdata/sf0.01"
    got = op(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got[label]).mean() >= 0.93
    y, p = got[label].to_numpy() == 1, got["predicted"].to_numpy() == 1
    ranks = got["score"].rank().to_numpy()
    auc = (ranks[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert auc >= 0.9 and (p & y).sum() >= 0.7 * y.sum() and (p & y).sum() >= 0.9 * p.sum()
    assert got["score"].between(0, 1).all() and ((got["score"] >= threshold) == got["predicted"]).all()


def test_classifiers_on_awkward_rows(spark, docs, none):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (5, 1, None), (5, 0, 1), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    for labelled in (labels, labels.limit(0)):
        model = quality.train(quality.feature_rows(docs), labelled)
        scored = quality.with_scores(docs, model)
        assert scored.count() == len(rows()) and scored.where("score between 0 and 1").count() == len(rows())
        trees = toxicity.train(docs, labelled)
        assert toxicity.with_scores(docs, trees).where("score between 0 and 1").count() == len(rows())
    kept = quality.keep_good(docs, labels, threshold=0.0)  # a column of the caller's named score stays as it is
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
    bench = spark.createDataFrame([(1, "w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17 w18 w19 w20"), (2, "b c")], "item_id bigint, text string")
    clean = decontaminate.remove_contaminated(docs, bench)
    assert clean.columns == docs.columns and sorted(map(str, clean.collect())) == sorted(str(r) for r in docs.collect() if r.doc_id != 4)
    assert quality.keep_good(none, labels).count() == 0 and toxicity.with_scores(none, toxicity.train(none, labels)).count() == 0


def test_pipeline_keeps_columns_and_takes_effect(spark):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, stage in P.STAGES[:-1]:
        docs = P.materialize(stage(spark, docs, sf), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert docs.count() <= before
        before = docs.count()
    packed = P.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == before
