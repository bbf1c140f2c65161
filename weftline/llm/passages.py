"""Repeated passages by sparse suffix arrays.

Of all suffixes of the texts only those at content-selected places are kept: the
minimisers, the shingle of the smallest hash among any WINDOW in a row.  A passage
selects the same places in every text, the first at most WINDOW - 1 words from its
beginning; so of a passage of ``words`` words, at least words - WINDOW + 1 follow.
Suffixes whose beginnings of that length meet no equal one are done with.  Matches of
the others are extended to the left, up to the passage's beginning, and to the right.

Sorted neighbours agree best to the right only: where the left part decides whether a
match is long enough, the partner may stand further away.  So extended matches are
compared by hashes of all their ``words``, which finds every partner, and splits evenly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from weftline.llm.hashing import BLANK_SEPARATED, mix, shingles, word_blocks
from weftline.llm.runs import prepare, stored

#: Words in a shingle, and shingles of which the smallest is kept.
SHINGLE, WINDOW = 6, 32
_ROWS = 1 << 15


def _texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    for first, counts, hashes, *_ in word_blocks(column, BLANK_SEPARATED):
        edge = np.concatenate([[0], np.cumsum(counts)])
        for k in range(len(counts)):
            yield first + k, hashes[edge[k] : edge[k + 1]]


def minimisers(words: np.ndarray) -> np.ndarray:
    """For each run of WINDOW shingles, the place of its smallest (the first of equals)."""
    grams = shingles(words, SHINGLE)
    many = len(grams) - WINDOW + 1
    if len(words) < SHINGLE or many < 1:
        return np.zeros(0, dtype=np.int64)
    runs = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)
    place = np.concatenate([runs[a : a + _ROWS].argmin(axis=1) for a in range(0, many, _ROWS)])
    return place + np.arange(many)


def _hash_at(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The hash of the ``size`` words from each place."""
    out = np.full(len(at), size, dtype=np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + words[at + k])
    return out.view(np.int64)


def _suffixes(words: int):
    ahead = words - WINDOW + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            group = batch.column(0).to_pylist()
            keys, groups, places = [], [], []
            for i, hashes in _texts(batch.column(1)):
                if len(hashes) < words or group[i] in seen:
                    continue
                seen.add(group[i])  # copies select alike
                at = np.unique(minimisers(hashes))
                at = at[at + ahead <= len(hashes)]
                keys.append(_hash_at(hashes, at, ahead))
                places.append(at)
                groups.append(np.full(len(at), group[i]))
            columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in (keys, groups, places)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "copy", "place"])

    return run


def _matches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, places = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            found, groups, starts = [], [], []
            for i, hashes in _texts(batch.column(1)):
                start = np.arange(max(0, len(hashes) - words + 1))
                chosen = minimisers(hashes)[: len(start)]  # the suffix that speaks for each start
                start = start[np.isin(chosen, np.array(places[i]))]
                found.append(_hash_at(hashes, start, words))
                starts.append(start)
                groups.append(np.full(len(start), group[i]))
            columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in (found, groups, starts)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["match", "copy", "start"])

    return run


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = np.zeros(batch.num_rows, dtype=np.int64)
        for first, counts, *_ in word_blocks(batch.column(2), BLANK_SEPARATED):
            n[first : first + len(counts)] = counts
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n)], names=["doc", "copy", "n"])


def repeated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 50) -> DataFrame:
    """doc_id, start, n_words, twin_doc_id, n_copies: the maximal runs of words that are
    covered by passages of at least ``words`` words which another document has too.

    Words are separated by ASCII blanks, A-Z in lower case; ``start`` counts from 0.
    ``twin_doc_id`` is another document that has some of the run.  Of a text that
    ``n_copies`` > 1 documents have, all is one run.  A document without repeated
    passages gives no row; nor does a null, empty or short text.  Passages that repeat
    within one document only are not meant.  Rows that share an id are one document if
    their texts are equal; a row with a null id takes part under a null id.  An empty
    table gives no rows; other columns are not looked at.
    """
    if words < WINDOW + SHINGLE:
        raise ValueError(f"passages need at least {WINDOW + SHINGLE} words")
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text)).alias("doc"), F.xxhash64(text).alias("copy"), text.alias("text"), F.col(id_col).cast("long").alias("given"))
    listed = stored(source.select("doc", "copy", "text").mapInArrow(_lengths, "doc long, copy long, n long"), "lengths")
    listed = listed.where(F.col("n") >= words)
    copies = listed.groupBy("copy").agg(F.count_distinct("doc").alias("n_copies"), F.min("doc").alias("first"), F.max("doc").alias("last"), F.max("n").alias("n"))
    copies = stored(copies, "copies")

    suffixes = source.select("copy", "text").mapInArrow(_suffixes(words), "key long, copy long, place long")
    met = suffixes.groupBy("key").agg(F.min("copy").alias("_a"), F.max("copy").alias("_b")).where("_a <> _b").select("key")
    places = suffixes.join(stored(met, "keys"), "key").groupBy("copy").agg(F.collect_set("place").alias("places"))
    # one document speaks for all copies
    chosen = source.join(places.join(copies.select("copy", F.col("first").alias("doc")), "copy"), ["doc", "copy"])
    matches = stored(chosen.dropDuplicates(["copy"]).select("copy", "text", "places").mapInArrow(_matches(words), "match long, copy long, start long"), "matches")
    partner = matches.groupBy("match").agg(F.min("copy").alias("_a"), F.max("copy").alias("_b")).where("_a <> _b")
    common = matches.join(stored(partner, "partners"), "match")
    common = common.select("copy", "start", F.when(F.col("_a") == F.col("copy"), F.col("_b")).otherwise(F.col("_a")).alias("twin")).distinct()

    # a document's matches, joined where they overlap or touch
    ordered = Window.partitionBy("copy").orderBy("start")
    begins = F.coalesce((F.col("start") > F.lag("start").over(ordered) + words).cast("int"), F.lit(1))
    runs = common.withColumn("_begins", begins).withColumn("_run", F.sum("_begins").over(ordered))
    runs = runs.groupBy("copy", "_run").agg(F.min("start").alias("start"), (F.max("start") + words - F.min("start")).alias("n_words"), F.min("twin").alias("twin")).drop("_run")
    runs = runs.join(copies.select(F.col("copy").alias("twin"), F.col("first").alias("twin_doc")), "twin").drop("twin")
    runs = runs.join(copies.where("n_copies = 1").select("copy"), "copy", "left_semi")
    whole = copies.where("n_copies > 1").select(
        "copy", F.lit(0).cast("long").alias("start"), F.col("n").alias("n_words"), F.col("first").alias("twin_doc")
    )
    runs = stored(runs.unionByName(whole), "runs")
    ids = listed.join(copies.select("copy", "n_copies", "last"), "copy")
    # names of rows without an id are not ids
    none = source.where("given IS NULL").select("doc").distinct()
    out = ids.join(runs, "copy").withColumn("twin_doc", F.when(F.col("twin_doc") == F.col("doc"), F.col("last")).otherwise(F.col("twin_doc")))
    out = out.select("doc", "start", "n_words", "twin_doc", "n_copies").distinct()
    if not none.isEmpty():
        for name in ("doc", "twin_doc"):
            out = out.join(none.select(F.col("doc").alias(name), F.lit(True).alias("_none")), name, "left")
            out = out.withColumn(name, F.when(F.col("_none").isNull(), F.col(name))).drop("_none")
    return out.select(F.col("doc").alias("doc_id"), "start", "n_words", F.col("twin_doc").alias("twin_doc_id"), "n_copies")
