"""The quality classifier: statistics against plain ones, trees against walks, held-out accuracy."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from weftline.llm import hashing, quality, queries
from weftline.session import load

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = ["", None, "a", "The cat. The CAT sat, 12 times!\nthe cat. |\n\n", "éß | 日本 ü*** $$$ a a a", "x" * 30 + " y\tz", "\n\n", "one two one two three"]


def plain(text):
    """Some of the statistics, as they are defined."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    lines = [line for line in text.translate(LOWER).split("\n") if line]
    n, chars, pairs = max(1, len(w)), max(1, len(text)), list(zip(w, w[1:], strict=False))
    return {
        "log_chars": np.log1p(chars),
        "log_words": np.log1p(len(w)),
        "upper": sum("A" <= c <= "Z" for c in text) / chars,
        "digits": sum("0" <= c <= "9" for c in text) / chars,
        "stops": sum(c in ".!?" for c in text) / n,
        "word_length": sum(len(x.encode()) for x in w) / n,
        "distinct_words": len(set(w)) / n,
        "commonest_word": max((w.count(x) for x in w), default=0) / n,
        "repeated_next": sum(a == b for a, b in pairs) / n,
        "distinct_pairs": len(set(pairs)) / max(1, len(w) - 1),
        "words_a_line": len(w) / (text.count("\n") + 1),
        "distinct_lines": len(set(lines)) / max(1, len(lines)),
        "line_stops": sum(line[-1] in ".!?" for line in lines) / max(1, len(lines)),
    }


@pytest.mark.parametrize("block", [1 << 20, 16])
def test_statistics(monkeypatch, block):
    hashing._tables.cache_clear()
    monkeypatch.setattr(hashing, "BLOCK", block)
    monkeypatch.setattr(quality, "BLOCK", block)
    got = quality.features(pa.array(TEXTS, pa.string()))
    hashing._tables.cache_clear()
    for text, row in zip(TEXTS, got, strict=True):
        for name, value in plain(text).items():
            assert row[quality.FEATURES.index(name)] == pytest.approx(value), (text, name)
    assert np.isfinite(got).all()


def walk(model, row):
    """One row down every tree, node by node."""
    total = model.base
    for node in model.root:
        while model.left[node] != node:
            node = model.left[node] if row[model.feature[node]] <= model.threshold[node] else model.right[node]
        total += model.value[node]
    return 1 / (1 + np.exp(-total))


def test_trees_are_walked_and_learn():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    model = quality.fit(x[:2000], y[:2000], trees=60)
    score = model.score(x)
    assert score[:50] == pytest.approx([walk(model, row) for row in x[:50]])
    assert ((score[2000:] >= 0.5) == y[2000:]).mean() > 0.95
    shuffled = rng.permutation(2000)
    assert np.array_equal(quality.fit(x[shuffled], y[shuffled], trees=60).score(x), score)


def test_first_tree_takes_the_best_split():
    """Against every cut of every feature, by the gain as it is defined."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 9, size=(400, 3)).astype(float)
    y = (x[:, 1] + rng.normal(size=400) > 4).astype(float)
    model = quality.fit(x, y, trees=1, depth=1, rate=1.0)
    p = y.mean()
    g, h = y - p, np.full(400, p * (1 - p))
    best = (0.0, None)
    for f in range(3):
        for cut in range(8):
            low = x[:, f] <= cut
            if min(h[low].sum(), h[~low].sum()) >= 2.0:
                gain = sum(g[k].sum() ** 2 / (h[k].sum() + 1) for k in (low, ~low)) - g.sum() ** 2 / (h.sum() + 1)
                best = max(best, (gain, (f, cut)), key=lambda b: b[0])
    f, cut = best[1]
    low = x[:, f] <= cut
    assert np.array_equal(x[:, model.feature[0]] <= model.threshold[0], low)
    leaves = [g[k].sum() / (h[k].sum() + 1) for k in (low, ~low)]
    assert model.value[[model.left[0], model.right[0]]] == pytest.approx(leaves)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in load(spark, folder, "labels").collect()}
    rows = queries.op13_quality(spark, folder).collect()
    assert len(rows) == load(spark, folder, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.9
    good, bad = ([r.score for r in held if labels[r.doc_id] == v] for v in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.95


def test_labels_of_the_held_out_fold_are_not_read(spark):
    docs, labels = (load(spark, entry.SMOKE_DIR, t) for t in ("documents", "labels"))
    kept = queries.fold(5) != 0
    other = labels.withColumn("quality", F.when(kept, F.col("quality")).otherwise(1 - F.col("quality")))
    one, two = (quality.train(docs, given, kept, trees=5) for given in (labels, other))
    assert np.array_equal(one.threshold, two.threshold) and np.array_equal(one.value, two.value)


def test_sample_is_bounded(spark):
    docs, labels = (load(spark, entry.SMOKE_DIR, t) for t in ("documents", "labels"))
    seen = []
    quality.fit, fit = lambda x, y, **_: seen.append(len(y)), quality.fit
    try:
        quality.train(docs, labels, F.lit(True), max_rows=30)
    finally:
        quality.fit = fit
    assert seen == [30]


SCHEMA = "doc_id long, text string, label double, x double, id string, score double"


def test_awkward_rows(spark):
    texts = [(1, "The cat sat.", 1), (1, "The cat sat.", 1), (2, None, 0), (3, "", None), (None, "no id", 1), (4, "word " * 300_000 + "x" * 1_500_000, 0), (5, " \n\t", 1)]
    docs = spark.createDataFrame([(d, t, 0.0, 0.0, "i", 9.0) for d, t, _ in texts], SCHEMA)
    labels = spark.createDataFrame([(d, q, q) for d, _, q in texts] * 3 + [(99, 1, 1)], "doc_id long, quality int, label int")
    model = quality.train(docs, labels, F.lit(True), least=0.1)
    rows = quality.score(docs, model).collect()
    assert len(rows) == 7 and all(0 <= r.score <= 1 for r in rows) and {r.id for r in rows} == {"i"}
    by = {(r.doc_id, r.text): r.score for r in rows}
    assert by[2, None] == by[3, ""]


def test_no_rows_and_no_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(docs, labels, F.lit(True))
    assert [r.score for r in quality.score(docs, model).collect()] == [0.5]
    assert quality.score(docs.limit(0), model).collect() == []
