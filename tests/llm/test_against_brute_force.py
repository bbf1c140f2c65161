"""Operators against plain versions of what they compute, on the smallest tables."""

import collections
import itertools
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from weftline.llm import hashing, jaccard_join, license_scan, packing, queries
from weftline.session import load

FOLDER = entry.SMOKE_DIR
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in load(spark, FOLDER, "documents").collect()}


def result(spark, name):
    return queries.QUERIES[name](spark, FOLDER).collect()


def test_pack(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = result(spark, "op1_pack")
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc, row in documents.items():
        ids = np.array(tokenizer.encode(row.text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            at += r.length
            assert zlib.crc32(ids[r.start : at].tobytes()) == r.ids_crc32
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert sum(r.length for r in rows) > 0.95 * 2048 * (len(sequences) - 1)


@pytest.mark.parametrize("seed", range(3))
def test_patterns_place_every_piece(seed):
    rng = np.random.default_rng(seed)
    lengths, counts = np.unique(rng.integers(1, 129, 5000), return_counts=True)
    histogram = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
    plan = packing.patterns(histogram, 128)
    placed = collections.Counter()
    for times, pattern in plan:
        assert sum(n * k for n, k in pattern.items()) <= 128
        for n, k in pattern.items():
            placed[n] += times * k
    assert placed == histogram
    least = sum(n * k for n, k in histogram.items()) / 128
    assert sum(t for t, _ in plan) <= 1.02 * least + 2


@pytest.mark.parametrize("most", [1, 4, 9, 40])
def test_length_classes_round_up_least(most):
    rng = np.random.default_rng(most)
    histogram = {int(n): int(k) for n, k in zip(rng.choice(60, 12, replace=False) + 1, rng.integers(1, 50, 12), strict=True)}
    got = packing.classes(histogram, most)
    lengths = sorted(histogram)
    assert sorted(got) == lengths and len(set(got.values())) <= most
    if most >= len(lengths):
        assert got == {n: n for n in lengths}

    def rounded(ends):
        return sum((next(e for e in ends if e >= n) - n) * k for n, k in histogram.items())

    tries = itertools.combinations(lengths[:-1], min(most, len(lengths)) - 1)
    assert rounded(sorted(set(got.values()))) == min(rounded([*t, lengths[-1]]) for t in tries)


def test_short_documents_are_packed_full(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "if(id % 2 = 0, '', 'a b c') AS text")
    import public_tokenizers

    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert len(rows) == 20_000 and sum(r.length for r in rows) == 50_000
    assert len({r.sequence_id for r in rows}) == 25


def test_both_tokenizer_libraries_agree():
    import public_tokenizers

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    fast, plain = packing._encoder(*paths), packing._encoder(paths[0], None)
    odd = ["", " ", "  a", "a \n b", "it's we'll", "<|endoftext|> a", "a\x85b\xa0c᠎d​e　f", "日本語 กำ", "x" * 3000]
    odd += [f"a{chr(c)}b {chr(c)} 1{chr(c)}.{chr(c)}{chr(c)}" for c in range(0, 0x2FFF, 7)]
    for text in odd:
        assert fast.ids(text).tolist() == plain.ids(text).tolist(), repr(text)


def test_lm_counts(spark, documents):
    tokens = {d: [*words(r.text), None] for d, r in documents.items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    count = collections.Counter(w for d, t in tokens.items() if not held[d] for w in t)
    total = sum(count.values())
    for r in result(spark, "op2_lm_score"):
        mine = tokens[r.doc_id]
        base = sum(math.log10((count[w] + 1) / (total + len(count) + 1)) for w in mine)
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(mine), total)
        assert r.n_known == sum(count[w] > 0 for w in mine)
        assert r.base_score == pytest.approx(base)
        assert -30 * len(mine) < r.score < 0


def test_lm_knows_its_language_from_noise(spark):
    from pyspark.sql import functions as F
    from weftline.llm import lm_score

    docs = load(spark, FOLDER, "documents").select("doc_id", "text").where("doc_id < 150")
    noise = docs.limit(40).select((F.col("doc_id") + 10_000).alias("doc_id"), F.translate("text", "etaoinshr", "qzxjkvwpy").alias("text"))
    scored = lm_score.score(docs.union(noise), F.col("doc_id") >= 10_000).where("n_tokens > 20")
    each = {r.doc_id: r.score / r.n_tokens for r in scored.collect()}
    plain = [v for k, v in each.items() if k < 10_000]
    strange = [v for k, v in each.items() if k >= 10_000]
    assert np.median(strange) < 2 * np.median(plain)


def test_passages(spark, documents):
    size = 50
    holders = collections.defaultdict(set)
    tokens = {d: words(r.text) for d, r in documents.items()}
    for d, t in tokens.items():
        for i in range(len(t) - size + 1):
            holders[tuple(t[i : i + size])].add(d)
    expected = collections.defaultdict(set)
    for d, t in tokens.items():
        for i in range(len(t) - size + 1):
            if len(holders[tuple(t[i : i + size])]) > 1:
                expected[d].update(range(i, i + size))
    got = collections.defaultdict(set)
    for r in result(spark, "op4_passages"):
        assert r.twin_doc_id != r.doc_id
        got[r.doc_id].update(range(r.start, r.start + r.n_words))
    assert got == expected and expected


def test_licenses(spark, documents):
    expected = {
        (d, i, name)
        for d, r in documents.items()
        for i, line in enumerate((r.text or "").split("\n"))
        for name, text in license_scan.TEMPLATES.items()
        if text.lower() in line.lower()
    }
    assert {(r.doc_id, r.line, r.license) for r in result(spark, "op7_license_scan")} == expected and expected


def test_license_wording(spark):
    texts = [
        "Foo. This work is licensed\nunder the GNU  General Public License,\nversion 3. Bar",
        "this work is licensed under the gnu general public licence version 3",
        "A license to drive is not given here.",
        "No licence",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.license, r.n_changed) for r in license_scan.find_licenses(docs).collect()}
    assert got == {(0, "GPL-3.0", 0), (1, "GPL-3.0", 1)}


def test_fingerprints(spark, documents):
    ids = sorted(documents)
    rows = {r.doc_id: r for r in result(spark, "op9_fingerprint")}

    def phrases(data):
        known, w = set(), b""
        for i in range(len(data)):
            w += data[i : i + 1]
            if w not in known:
                known.add(w)
                w = b""
        return known

    for i, d in enumerate(ids):
        text, following = documents[d].text or "", documents[ids[(i + 1) % len(ids)]].text or ""
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + following[:quarter]
        r = rows[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = phrases(text.encode()), phrases(edited.encode()), phrases(following.encode())
        assert abs(len(a & b) / max(1, len(a | b)) - r.near_edited) < 0.2 or len(a | b) < 30
        assert abs(len(a & c) / max(1, len(a | c)) - r.near_next) < 0.2 or len(a | c) < 30


def test_language_held_out_accuracy(spark, documents):
    rows = [r for r in result(spark, "op10_language_id") if r.held_out]
    right = sum(r.lang_pred == documents[r.doc_id].lang for r in rows)
    assert right >= 0.95 * len(rows) and len(rows) > 20


@pytest.mark.parametrize(("size", "percent"), [(5, 80), (2, 60), (3, 100)])
def test_components(spark, size, percent):
    rng = np.random.default_rng(percent)
    texts = []
    for g in range(12):
        base = rng.integers(0, 40, 60)
        for _ in range(8):
            copy = base.copy()
            change = rng.random(60) < rng.choice([0.0, 0.01, 0.03, 0.06])
            copy[change] = rng.integers(0, 4000, change.sum())
            texts.append(" ".join(f"w{x}" for x in copy[: rng.integers(48, 61)]))
    texts += ["a", "a b", "A B", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets = []
    for t in texts:
        w = words(t)
        k = min(size, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.linked(docs, size=size, percent=percent).collect()}
    assert got == {i: (len(s), root(i)) for i, s in enumerate(sets)}


def test_words_are_cut_alike_in_blocks_and_beyond(monkeypatch):
    import pyarrow as pa

    texts = ["Ab  c\td", "", None, "x" * 50 + " y", " lead", "éß z", "tail "] * 5
    monkeypatch.setattr(hashing, "BLOCK", 1 << 20)
    whole = [(first, h.tolist()) for first, _, h, *_ in hashing.word_blocks(pa.array(texts), hashing.BLANK_SEPARATED)]
    [(_, expected)] = whole
    hashing._tables.cache_clear()
    monkeypatch.setattr(hashing, "BLOCK", 7)
    small = [x for _, _, h, *_ in hashing.word_blocks(pa.array(texts), hashing.BLANK_SEPARATED) for x in h.tolist()]
    hashing._tables.cache_clear()
    assert small == expected
