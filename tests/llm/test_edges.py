"""Every operator and stage on awkward tables: nulls, empty and long texts, repeated
rows, no rows, and columns whose names the operators use themselves."""

import pytest
from pyspark.sql import Row, functions as F

import corpus_pipeline
from weftline.llm import (
    decontaminate, fingerprint, jaccard_join, language_id, license_scan, line_dedup, lm_score, packing, passages, warc,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, score double, node string, n int, token int, place int"
LONG = "word " * 300_000 + "x" * 1_500_000


def awkward(spark):
    texts = [
        (1, "The quick brown fox jumps over the lazy dog.", "en"), (1, "The quick brown fox jumps over the lazy dog.", "en"),
        (2, None, "en"), (3, "", None), (None, "a row without an id", "en"), (None, None, None), (4, " \t\r\n\n ", "de"),
        (5, LONG, "en"), (6, "12 34 !!", "fr"), (7, "üß 日本語 \U0001f600", "de"), (5, "another text of that id", "en"),
    ]
    rows = [(d, t, g, None, None, 1, 0.5, "x", 2, 3, 4) for d, t, g in texts]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def items(spark):
    return spark.createDataFrame([(1, "quick brown fox"), (1, "quick brown fox"), (2, None), (None, "lazy"), (3, "")], "item_id long, text string")


def train(docs):
    return language_id.train(docs, F.lit(True))


RESULTS = {}


def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


CASES = {
    "pack": lambda s, d: packing.pack(d, tokenizer()[0], ranks_path=tokenizer()[1]),
    "score": lambda s, d: lm_score.score(d, F.col("doc_id") == 3),
    "score without training": lambda s, d: lm_score.score(d, F.lit(True)),
    "linked": lambda s, d: jaccard_join.linked(d),
    "representatives": lambda s, d: jaccard_join.representatives(d),
    "passages": lambda s, d: passages.repeated(d),
    "items": lambda s, d: decontaminate.find_items(d, items(s)),
    "no items": lambda s, d: decontaminate.find_items(d, items(s).limit(0)),
    "licenses": lambda s, d: license_scan.find_licenses(d),
    "lines": lambda s, d: line_dedup.drop_shared_lines(d, min_docs=2),
    "fingerprints": lambda s, d: fingerprint.fingerprints(d),
    "language": lambda s, d: language_id.identify(d, train(d)),
    "no language": lambda s, d: language_id.identify(d, train(d.limit(0))),
}
PER_ROW = {"score", "score without training", "linked", "items", "no items", "lines", "fingerprints", "language", "no language"}


def result(spark, name):
    """The rows of a case, computed once."""
    if name not in RESULTS:
        RESULTS[name] = CASES[name](spark, awkward(spark)).collect()
    return RESULTS[name]


@pytest.mark.parametrize("name", CASES)
def test_awkward_rows(spark, name):
    rows = result(spark, name)
    if name in PER_ROW:
        assert len(rows) == 11


@pytest.mark.parametrize("name", CASES)
def test_no_rows(spark, name):
    assert CASES[name](spark, empty(spark)).collect() == []


def by_text(rows):
    return {(r["doc_id"], r["text"]): r for r in rows}


def test_pack_gives_every_row_its_tokens(spark):
    rows = result(spark, "pack")
    ends = [r for r in rows if r.doc_id == 2]
    assert [(r.start, r.length, r.doc_tokens) for r in ends] == [(0, 1, 1)]
    assert sum(r.start == 0 for r in rows) == 11


def test_linked_rows(spark):
    rows = result(spark, "linked")
    ones = [r for r in rows if r.doc_id == 1]
    assert [(r.n_shingles, r.component_id) for r in ones] == [(5, 1), (5, 1)]
    assert {(r.n_shingles, r.component_id) for r in rows if r.doc_id in (2, 3, 4)} == {(0, 2), (0, 3), (0, 4)}
    assert all(r.component_id is None for r in rows if r.doc_id is None)


def test_representatives_keep_rows_without_id(spark):
    rows = result(spark, "representatives")
    assert sum(r.doc_id is None for r in rows) == 2
    assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5, 6, 7, None}


def test_items_of_short_and_repeated_items(spark):
    found = by_text(result(spark, "items"))
    fox = found[1, "The quick brown fox jumps over the lazy dog."]
    assert (fox["n_words"], fox["n_hit"], fox["items"]) == (9, 3, [1])
    assert (found[2, None]["n_words"], found[2, None]["n_hit"]) == (0, 0)
    assert found[5, LONG]["n_words"] == 300_001


def test_lines_of_null_and_empty_texts(spark):
    rows = [r for r in result(spark, "lines") if r["doc_id"] in (2, 3)]
    assert [(r["text"], r["n_lines"], r["n_dropped"]) for r in rows] == [("", 1, 0)] * 2


def test_language_of_texts_without_letters(spark):
    found = by_text(result(spark, "language"))
    for key in ((2, None), (3, ""), (6, "12 34 !!"), (4, " \t\r\n\n ")):
        assert (found[key]["lang_pred"], found[key]["score"]) == ("und", 0.0)
    assert found[1, "The quick brown fox jumps over the lazy dog."]["lang_pred"] == "en"


def test_fingerprints_of_equal_and_empty_texts(spark):
    rows = result(spark, "fingerprints")
    first, second = [r for r in rows if r.doc_id == 1]
    assert first.fingerprint == second.fingerprint
    empties = [r for r in rows if r.n_chars == 0]
    assert {r.fingerprint for r in empties} == {""} and all(r.near_edited == 1.0 for r in empties)


def test_single_row_follows_itself(spark):
    [row] = fingerprint.fingerprints(spark.createDataFrame([Row(doc_id=9, text="abcdefgh" * 9)])).collect()
    assert row.near_next == 1.0


def test_archives_of_awkward_pages(spark, tmp_path):
    body = "x" * 1200
    rows = [(1, "http://a", body, 0), (2, None, body, 0), (None, "http://c", body, 0), (3, "http://d\r\nX: y", None, 0), (4, "u", "", 0), (2, None, body, 0), (5, "v", "WARC/1.1\r\n\r\n\x1f", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, size int")
    files = warc.write_archives(pages, str(tmp_path / "warc"))
    got = warc.read_archives(files, split_bytes=100).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in got) == sorted(
        [(1, "revisit", 2, 1200), (2, "response", None, 1200), (2, "response", None, 1200), (0, "revisit", 2, 1200), (3, "response", None, 0), (4, "response", None, 0), (5, "response", None, 13)],
        key=lambda r: (r[0], r[1]),
    )
    none = warc.write_archives(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_archives(none).collect() == []


@pytest.mark.parametrize("make", [awkward, empty])
def test_pipeline_stages(spark, make, tmp_path):
    items(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = make(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "packing" or out.columns == docs.columns
        rows = out.collect()
        if make is empty:
            assert rows == []
