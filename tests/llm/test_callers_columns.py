"""Columns of a caller under every name that the operators use inside: all stay as they are, also maps."""

import pytest
from pyspark.sql import functions as F

from loomfield.llm import decontaminate, jaccard, packing, quality, search, sharding, suffix_dedup, toxicity

NAMES = ["_h", "_n", "_score", "_kept", "_salt", "_in", "_before", "_number", "_row", "_bucket", "component", "n", "digest", "runs", "hits"]
A = " ".join(f"alpha{k} beta{k % 7}" for k in range(60))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t) for k, t in enumerate([A, A + " more", "short", None, "", "quite another text of a few words", A])]
    df = spark.createDataFrame(rows + [(3, None)], "doc_id bigint, text string")
    df = df.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in NAMES})
    return df.withColumn("m", F.create_map(F.lit("k"), F.array(F.create_map(F.lit(1), F.col("doc_id"))))).withColumn("s", F.struct(F.create_map(F.lit("x"), F.lit(2)).alias("inner"))).cache()


def intact(out, docs):
    assert out.columns[: len(docs.columns)] == docs.columns and [f.dataType.simpleString() for f in out.schema.fields][: len(docs.columns)] == [f.dataType.simpleString() for f in docs.schema.fields]
    rows = out.collect()
    assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in NAMES)
    assert all(r.m == {"k": [{1: r.doc_id}]} and r.s.inner == {"x": 2} for r in rows)
    return rows


def test_shuffle(docs):
    rows = intact(sharding.external_shuffle(docs, shards=3), docs)
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in docs.collect())
    assert sorted((r.slot, r.shard) for r in rows) == [(k // 3, k % 3) for k in range(8)]


def test_stages(spark, docs):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(7)], "doc_id bigint, quality int, toxic int")
    assert len(intact(quality.keep_good(docs, labels, threshold=-1.0), docs)) == 8
    intact(jaccard.keep_one_of_each(docs), docs)
    intact(suffix_dedup.remove_repeats(docs), docs)
    items = spark.createDataFrame([(1, "quite another text of a few words")], "item_id bigint, text string")
    assert len(intact(decontaminate.remove_contaminated(docs, items), docs)) == 7
    intact(toxicity.with_scores(docs.drop("score"), toxicity.train(docs, labels)), docs)


def test_pack(docs):
    pieces = packing.tokenize_pieces(docs.select("doc_id", "text")).join(docs.drop("text"), "doc_id")
    out = packing.pack(pieces.select("doc_id", "piece", "start", "length", "ids_crc32", *NAMES))
    rows = out.collect()
    assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in NAMES) and {"sequence_id", "offset"} <= set(out.columns)


def test_search_reads_only_its_columns(docs):
    assert search.top_k(docs, docs, k=2).columns == ["query_id", "rank", "doc_id", "score"]
