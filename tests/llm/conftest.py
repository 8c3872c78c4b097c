import pytest


@pytest.fixture
def docs(spark):
    """A small table with every oddity: nulls, empty texts, repeated rows and ids, and extra columns
    named like the operators' own."""

    def make(rows):
        more = "id long, key string, fp string, text_ string, rank int, copy int, score double, spans string, anchor long, _kept long, _rank int, _copy int, _order long, _text string"
        return spark.createDataFrame(
            [(*r, "en", f"src{i % 3}", len(r[1] or ""), i, "k", "f", "t", 1, 2, 0.5, "s", 7, 1, 1, 1, 1, "x") for i, r in enumerate(rows)],
            f"doc_id long, text string, lang string, source string, n_chars long, {more}",
        )

    return make
