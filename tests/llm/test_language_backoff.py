"""Word-first backoff against a plain version, and the bounds of training."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from weftline.llm import language_id, queries
from weftline.session import load

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def pieces(word, size):
    framed = f"<{word}>"
    return [framed[i : i + size] for i in range(len(framed) - size + 1)]


class Plain:
    """Counts in dictionaries, scores as the operator defines them."""

    def __init__(self, rows, least=2, longest=4):
        self.longest = longest
        counts = [collections.defaultdict(collections.Counter) for _ in range(longest + 1)]
        for text, lang in rows:
            for w in words(text):
                counts[0][w][lang] += 1
                for size in range(1, longest + 1):
                    for p in pieces(w, size):
                        counts[size][p][lang] += 1
        self.languages = sorted({lang for c in counts[0].values() for lang in c})
        total = [collections.Counter() for _ in counts]
        for t, c in zip(total, counts, strict=True):
            for by in c.values():
                t.update(by)
        self.scores = []
        for c, t in zip(counts, total, strict=True):
            known = {k: [by[v] / max(1, t[v]) for v in self.languages] for k, by in c.items() if sum(by.values()) >= least}
            self.scores.append({k: [math.log(0.9 * f + 0.1 * sum(row) / len(row)) for f in row] for k, row in known.items()})

    def word(self, w):
        if w in self.scores[0]:
            return self.scores[0][w]
        for size in range(self.longest, 0, -1):
            rows = [self.scores[size][p] for p in pieces(w, size) if p in self.scores[size]]
            if rows:
                return [sum(c) / len(rows) for c in zip(*rows, strict=True)]
        return [0.0] * len(self.languages)

    def text(self, text):
        total = [sum(c) for c in zip(*[self.word(w) for w in words(text)], strict=True)]
        best = max(total)
        return self.languages[total.index(best)], 1 / sum(math.exp(t - best) for t in total)


def test_query_against_plain_backoff(spark):
    docs = load(spark, entry.SMOKE_DIR, "documents").collect()
    model = Plain([(r.text, r.lang) for r in docs if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.lang and r.text])
    rows = {r.doc_id: r for r in queries.op10_language_id(spark, entry.SMOKE_DIR).collect()}
    for r in docs:
        if any(c.isalpha() for c in r.text or ""):
            lang, score = model.text(r.text)
            assert (rows[r.doc_id].lang_pred, rows[r.doc_id].score) == (lang, pytest.approx(score, abs=1e-3))
        else:
            assert (rows[r.doc_id].lang_pred, rows[r.doc_id].score) == ("und", 0.0)


def test_unseen_words_of_any_length():
    rows = [("der die das und " * 3, "de"), ("the and of to " * 3, "en"), ("übergröße 日本 " * 2, "de")]
    plain = Plain(rows)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([g for _, g in rows]), pa.array([t for t, _ in rows])], names=["lang", "text"])
    counts = collections.defaultdict(lambda: np.zeros(2))
    for made in language_id._counted(4)([batch]):
        for r in made.to_pylist():
            counts[r["size"], r["key"]][plain.languages.index(r["lang"])] += r["n"]
    keys, scores = [], []
    for size in range(5):
        mine = sorted((k & (2**64 - 1), n) for (s, k), n in counts.items() if s == size and n.sum() >= 2)
        total = sum(n for (s, _), n in counts.items() if s == size)
        share = np.array([n for _, n in mine]).reshape(len(mine), 2) / total
        keys.append(np.array([k for k, _ in mine], dtype=np.uint64))
        scores.append(np.log(0.9 * share + 0.1 * share.mean(axis=1, keepdims=True)))
    model = language_id.Model(plain.languages, keys, scores)
    odd = ["dasund", "theof", "q", "qqqq", "日", "übe", "öße", "x" * 500_000, "derdas" * 40_000]
    got = model.of_unseen([w.encode() for w in odd])
    for w, row in zip(odd, got, strict=True):
        assert row == pytest.approx(plain.word(w)), w[:20]


def test_sample_is_bounded_by_documents_and_bytes(spark):
    docs = load(spark, entry.SMOKE_DIR, "documents")
    whole = language_id.train(docs, F.lit(True))
    for bound in ({"max_docs": 40}, {"max_bytes": 40_000}):
        part = language_id.train(docs, F.lit(True), **bound)
        assert 0 < len(part.keys[0]) < len(whole.keys[0]) / 2


def test_columns_named_as_helpers_are(spark):
    docs = spark.createDataFrame([(1, "der die das", "de", 5, 6, 7)], "doc_id long, text string, lang string, _text int, size int, n int")
    model = language_id.train(docs, F.lit(True), least=1)
    [row] = language_id.identify(docs, model).collect()
    assert (row.lang_pred, row._text, row.n) == ("de", 5, 7)
