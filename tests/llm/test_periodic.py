"""Periodic runs against a search at every lag."""

import hashlib
import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from weftline.llm import hashing, periodic, queries
from weftline.session import load


def plain_runs(w, least=6, exponent=4):
    """Every run of the sequence, by trying all periods."""
    ids = np.unique(np.array(w, dtype=object), return_inverse=True)[1] if len(w) else np.zeros(0, int)
    out, n = [], len(w)
    for q in range(1, n // exponent + 1):
        same = np.concatenate([[False], ids[q:] == ids[:-q], [False]])
        step = np.flatnonzero(same[1:] != same[:-1])
        for start, end in zip(step[::2].tolist(), step[1::2].tolist()):
            length = end - start + q
            if length >= max(least, exponent * q):
                run = ids[start : start + length]
                if not any(np.array_equal(run[p:], run[:-p]) for p in range(1, q)):
                    out.append((start, length, q))
    return sorted((s, n_, q) for s, n_, q in out)


def found(sequences):
    counts = np.array([len(s) for s in sequences])
    words = np.array([hash(x) & (2**64 - 1) for s in sequences for x in s], dtype=np.uint64)
    out = [[] for _ in sequences]
    for text, *run in zip(*(c.tolist() for c in periodic.runs(words, counts)), strict=True):
        out[text].append(tuple(run))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_runs_of_made_sequences(seed):
    rng = np.random.default_rng(seed)
    sequences = [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 500, ["a", "b"] * 300]
    for _ in range(60):
        parts = []
        for _ in range(rng.integers(1, 6)):
            unit = [f"w{x}" for x in rng.integers(0, rng.choice([2, 3, 50]), rng.integers(1, rng.choice([4, 12, 70])))]
            parts += unit * rng.integers(1, 9) + unit[: rng.integers(0, len(unit) + 1)]
            if rng.random() < 0.5:
                unit = parts[-rng.integers(1, len(parts) + 1) :]
                parts += unit * rng.integers(0, 5)
        sequences.append(parts[:3000])
    assert found(sequences) == [plain_runs(s) for s in sequences]


def test_runs_of_one_text_do_not_reach_the_next():
    assert found([["x"] * 4, ["x"] * 4]) == [[], []]


def test_query(spark):
    documents = {r.doc_id: r.text for r in load(spark, entry.SMOKE_DIR, "documents").collect()}
    rows = {r.doc_id: r for r in queries.op11_periodic_runs(spark, entry.SMOKE_DIR).collect()}
    assert rows.keys() == documents.keys()
    some = 0
    for doc, text in documents.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(w), zlib.crc32(str(doc).encode())
        if h % 10 == 0 and n > 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        gone = set()
        for s, length, q in runs:
            gone.update(range(s + q, s + length))
        r = rows[doc]
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        assert r.n_runs == len(runs)
        expected = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert (r.start, r.length, r.period, r.exponent_milli) == expected
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n_},{q}\n" for s, n_, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()
        some += bool(runs)
    assert some > 5


LONG = "alpha beta  gamma\n" * 100_000 + "x" * 1_500_000
SCHEMA = "doc_id long, text string, runs int, collapsed string, n_words int, start int, period int"


@pytest.fixture(scope="module")
def awkward(spark):
    texts = [(1, "a b " * 9), (1, "a b " * 9), (2, None), (3, ""), (4, " \t\r\n"), (None, "A a A a A a A a A a"), (5, LONG), (6, "\x1c \x85 y")]
    return spark.createDataFrame([(d, t, 1, "c", 2, 3, 4) for d, t in texts], SCHEMA)


def test_awkward_rows(awkward):
    rows = periodic.find_runs(awkward).collect()
    got = {(r.doc_id, r.text): (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in rows}
    assert len(rows) == 8 and rows[0].start == 3
    assert got[1, "a b " * 9] == (18, [(0, 18, 2)], "a b")
    assert got[2, None] == got[3, ""] == got[4, " \t\r\n"] == (0, [], "")
    assert got[None, "A a A a A a A a A a"] == (10, [(0, 10, 2)], "A a")
    assert got[5, LONG] == (300_001, [(0, 300_000, 3)], "alpha beta gamma " + "x" * 1_500_000)
    assert got[6, "\x1c \x85 y"] == (3, [], "\x1c \x85 y")


def test_no_rows(awkward):
    assert periodic.find_runs(awkward.limit(0)).collect() == []


def test_bounds_are_checked(awkward):
    with pytest.raises(ValueError):
        periodic.find_runs(awkward, exponent=3)


def test_words_differ_by_case():
    import pyarrow as pa

    [(_, _, hashes, *_)] = hashing.word_blocks(pa.array(["A a"]), hashing.BLANK_SEPARATED, hashing.AS_IS)
    assert hashes[0] != hashes[1]
