"""Items of one to four words in the query over whole tables."""

from keyfold.llm import queries


def test_short_items_match_exactly(spark, docs, tmp_path):
    items = [(1, "Tiber"), (2, "two words"), (3, "one two three four"), (4, "..."), (5, "a b c d e")]
    rows = [(10, "the tiber runs"), (11, "tibers run. Two, words!"), (12, "one two three five"), (13, "so one two three four end"), (14, "a b x d e"), (15, "")]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.op4_decontamination(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["item_id"], r["distance"], r["budget"]) for r in got) == [(10, 1, 0, 0), (11, 2, 0, 0), (13, 3, 0, 0), (14, 5, 1, 1)]
