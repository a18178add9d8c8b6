import corpus_pipeline


def test_near_duplicates_links_five_word_copies_of_similarity_080(spark):
    words = [f"t{k}" for k in range(100)]
    edited = ["x" if k == 30 else "y" if k == 60 else w for k, w in enumerate(words)]  # 86 of 106 five-word shingles
    apart = ["x" if k == 30 else "y" if k == 60 else "z" if k == 80 else w for k, w in enumerate(words)]
    docs = [(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join("q" + w for w in apart))]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(docs, "doc_id bigint, text string"), "")
    assert sorted(r.doc_id for r in got.collect()) == [1, 3]
