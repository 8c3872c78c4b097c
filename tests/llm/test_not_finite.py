"""Vectors with components that are no numbers take no part in the search."""

from keyfold.llm import topk_search


def test_nan_query_and_candidate(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0]), (20, [nan, 5.0]), (40, [inf, 5.0]), (1, [nan, 9.0]), (2, [-inf, 9.0]), (3, [0.5, None]), (4, [0.5, 0.5]), (5, [-1.0, 0.0]), (6, [0.0, -2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk_search.top_k(df.where("vec_id % 20 = 0"), df, 2)
    k = 1024 * 1024
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == [(0, 1, 4, k), (0, 2, 5, -k)]
