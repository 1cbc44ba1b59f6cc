import pytest

from pactum.llm import exact_dedup, jaccard

#: Copies with a repeated id and with a null id, and a unique text whose id also has a copy.
ROWS = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (2, "unique text of row two"), (None, "only null"), (None, "only null"), (3, "z")]


@pytest.mark.parametrize("dedup", [exact_dedup.dedup, jaccard.dedup])
def test_one_row_of_each_text_stays(spark, dedup):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = sorted((r.text, r.doc_id) for r in dedup(docs).collect())
    assert got == [("a b c d e f", 1), ("only null", None), ("unique text of row two", 2), ("z", 3)]


def test_largest_stays(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = sorted((r.text, r.doc_id) for r in exact_dedup.dedup(docs, keep="largest").collect())
    assert got == [("a b c d e f", 2), ("only null", None), ("unique text of row two", 2), ("z", 3)]


def test_near_copies_with_null_ids(spark):
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(None, text), (None, text + " x"), (7, text + " y")], "doc_id long, text string")
    assert [r.doc_id for r in jaccard.dedup(docs).collect()] == [7]
