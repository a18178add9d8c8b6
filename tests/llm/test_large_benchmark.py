"""A benchmark of more distinct words than one index can tell, in many items and in one."""

from loomfield.llm import decontaminate


def test_more_distinct_words_than_an_index_can_tell(spark):
    long = [f"w{k}" for k in range(70000)]
    items = [("whole", " ".join(long)), ("tail", " ".join(long[69000:])), ("short", "only two")] + [(f"i{k}", " ".join(f"v{k}x{j}" for j in range(20))) for k in range(400)]
    docs = [(1, " ".join(long[4090:4120])), (2, "begin " + " ".join(long[69980:])), (3, "these only two words"), (4, " ".join(long[5:17])), (5, "a " + " ".join(f"v7x{j}" for j in range(13))), (None, None)]
    docs += [(1, " ".join(long[4090:4120])), (6, " ".join(long[10:30]) + " gap " + " ".join(long[60000:60013]))]
    want = [(1, 30, 30, ["whole"])] * 2 + [(2, 21, 20, ["tail", "whole"]), (3, 4, 2, ["short"]), (4, 12, 0, []), (5, 14, 13, ["i7"]), (None, 0, 0, []), (6, 34, 33, ["whole"])]
    found = decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id string, text string"))
    got = [(r.doc_id, r.n_words, r.n_hit, sorted(r["items"])) for r in found.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
