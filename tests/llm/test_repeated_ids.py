"""Rows of one id with different texts in the near-duplicate stage."""

import random

from test_operators import prose

from keyfold.llm import simhash_dedup


def test_each_group_keeps_a_row(spark, docs):
    rng = random.Random(8)
    a, b, c, d = (prose(rng, 90) for _ in range(4))
    # id 5 has a text of its own and a copy of id 1's; ids 7 and 8 have both texts c and d
    rows = [(1, a), (5, b), (5, a), (7, c), (7, d), (8, c), (8, d), (9, d), (9, d)]
    out = simhash_dedup.keep_one(docs(rows))
    assert out.columns == docs(rows).columns
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == sorted([(1, a), (5, b), (7, c), (7, d)])
