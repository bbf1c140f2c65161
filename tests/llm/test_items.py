"""Items without an id, and columns named as the helpers are."""

import pytest

from weftline.llm import decontaminate


def test_items_without_id_hit_and_are_not_listed(spark):
    docs = spark.createDataFrame([(1, "the lazy dog and the quick fox", 5, 6, 7)], "doc_id long, text string, _text int, _found int, __end int")
    items = spark.createDataFrame([(None, "lazy dog"), (3, "quick fox"), (None, None)], "item_id long, text string")
    [row] = decontaminate.find_items(docs, items).collect()
    assert (row.n_words, row.n_hit, row["items"], row._text, row._found, row["__end"]) == (7, 4, [3], 5, 6, 7)
    [row] = decontaminate.find_items(docs, items.where("item_id IS NULL"), keep=["doc_id"]).collect()
    assert (row.n_hit, row["items"]) == (2, [])


@pytest.mark.parametrize("words", [1, 1_000_000])
def test_blocks_of_items_add_up(spark, monkeypatch, words):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", words)
    docs = spark.createDataFrame([(1, "a b c d e"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b"), (None, "b c"), (2, "e"), (2, "x")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.find_items(docs, items).collect()}
    assert got == {1: (5, 4, [1, 2]), 2: (0, 0, [])}
