"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into dictionary phrases: each is the longest phrase met before plus
one byte.  The fingerprint holds the smallest hashes of the phrase set; comparing two
estimates how many phrases the texts share, a likeness like that of compressing both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weftline.llm.runs import prepare

#: Hashes in a fingerprint; the standard error of a likeness p is sqrt(p(1-p)/LENGTH).
LENGTH = 128

_NO_ID = -(1 << 63)


def phrases(data: bytes, known: set[bytes], begin: int = 0, end: int | None = None) -> int:
    """Adds the phrases of data[begin:end] to ``known``; returns where the open one begins.

    Any start of a phrase is a phrase, so the longest known one is found by stepping on.
    """
    end = len(data) if end is None else end
    at, step = begin, begin + 1
    add = known.add
    while step <= end:
        phrase = data[at:step]
        if phrase in known:
            step += 1
        else:
            add(phrase)
            at = step
            step += 1
    return at


def signature(known: set[bytes]) -> np.ndarray:
    """The LENGTH smallest 32-bit hashes of a phrase set."""
    h = np.fromiter(map(crc32, known), dtype=np.uint64, count=len(known))
    h = h * np.uint64(0xFF51AFD7ED558CCD) + np.uint64(0x9E3779B97F4A7C15)
    h = ((h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)) >> np.uint64(32)
    return np.unique(h)[:LENGTH].astype(np.uint32)


def spelled(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of two phrase sets; 1 for two empty ones."""
    either = np.union1d(a, b)[:LENGTH]
    if not len(either):
        return 1.0
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(either, both, assume_unique=True).sum() / len(either))


def edit(text: str, following: str) -> tuple[str, int]:
    """(edited text, characters kept): the last quarter gives way to the start of the next."""
    quarter = len(text) // 4
    kept = len(text) - quarter
    return text[:kept] + following[:quarter], kept


def _both(text: str, following: str) -> tuple[str, np.ndarray, np.ndarray]:
    """(edited text, its signature, that of the text); what both begin with is parsed once."""
    edited, kept = edit(text, following)
    data, other = text.encode(), edited.encode()
    shared = len(text[:kept].encode())
    known: set[bytes] = set()
    at = phrases(data, known, 0, shared)
    mine = set(known)
    phrases(data, mine, at)
    own = signature(mine)
    if edited == text:
        return edited, own, own
    phrases(other, known, at)
    return edited, signature(known), own


_COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, doc); each bucket ends with the row that follows it."""
    waiting = None  # (bucket, doc, text) whose next row has not come yet
    for batch in batches:
        out = []
        for bucket, doc, text, guest in zip(*(batch.column(c) for c in ("bucket", "doc_id", "text", "guest")), strict=True):
            row = (bucket.as_py(), doc.as_py(), text.as_py() or "", guest.as_py())
            if waiting is not None and waiting[0] == row[0] and not waiting[3]:
                out.append((waiting, row[2]))
            waiting = row
        yield _rows(out)


def _rows(pairs: list) -> pa.RecordBatch:
    """A row per (row, text that follows it)."""
    rows = []
    for (_, doc, text, _), following in pairs:
        edited, of_edited, own = _both(text, following)
        rows.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, of_edited))
    nexts = []
    for i, (_, following) in enumerate(pairs):
        if i + 1 < len(pairs) and pairs[i + 1][0][2] == following:
            nexts.append(rows[i + 1][3])  # as most often, the next row is that text
        else:
            known: set[bytes] = set()
            phrases(following.encode(), known)
            nexts.append(signature(known))
    columns = [
        pa.array([r[0] for r in rows], pa.int64()),
        pa.array([r[1] for r in rows], pa.int64()),
        pa.array([r[2] for r in rows], pa.string()),
        pa.array([spelled(r[3]) for r in rows], pa.string()),
        pa.array([spelled(r[4]) for r in rows], pa.string()),
        pa.array([likeness(r[3], r[4]) for r in rows], pa.float64()),
        pa.array([likeness(r[3], n) for r, n in zip(rows, nexts, strict=True)], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _COLUMNS.split(", ")])


def _bucket(doc, bounds: list[int]):
    """How many bounds are at most ``doc``: a search in groups, then within one."""
    if not bounds:
        return F.lit(0)
    each = int(len(bounds) ** 0.5) + 1
    groups = [bounds[i : i + each] for i in range(0, len(bounds), each)]
    whole = F.array(*[F.lit(g[0]) for g in groups])
    fine = F.array(*[F.array(*[F.lit(b) for b in g]) for g in groups])
    reached = F.size(F.filter(whole, lambda b: b <= doc))
    inside = F.size(F.filter(F.get(fine, reached - 1), lambda b: b <= doc))
    return F.when(reached == 0, 0).otherwise((reached - 1) * each + inside)


def with_neighbours(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, doc_id, text, guest): buckets of neighbours by id, each sorted and in one
    partition, and behind each, as a guest, the row that follows it; after the last, the first.

    Four buckets per shuffle partition are cut at quantiles of the ids, which alone are
    read for that.  Texts are shuffled once.
    """
    spark = docs.sparkSession
    prepare(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))
    cuts = 4 * partitions
    quantiles = F.percentile_approx(order, [i / cuts for i in range(1, cuts)], F.lit(20 * cuts))
    bounds = sorted({int(b) for b in docs.agg(quantiles).head()[0] or []})
    bucket = _bucket(order, bounds)
    firsts = {r["b"]: r["d"] for r in docs.groupBy(bucket.alias("b")).agg(F.min(order).alias("d")).collect()}
    filled = sorted(firsts)
    before = {b: filled[i - 1] for i, b in enumerate(filled)}  # the first follows the last
    first_of = F.array(*[F.lit(firsts.get(b)).cast("long") for b in range(len(bounds) + 1)])
    host_of = F.array(*[F.lit(before.get(b)).cast("int") for b in range(len(bounds) + 1)])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), order.alias("_order"), bucket.cast("int").alias("_own"))
    place = lambda b, guest: F.struct(b.alias("bucket"), F.lit(guest).alias("guest"))
    own = F.array(place(F.col("_own"), False))
    both = F.array(place(F.col("_own"), False), place(F.get(host_of, F.col("_own")), True))
    rows = rows.withColumn("_place", F.explode(F.when(F.col("_order") == F.get(first_of, F.col("_own")), both).otherwise(own)))
    rows = rows.select("_place.bucket", "doc_id", "text", "_place.guest", "_order")
    rows = rows.repartition(partitions, "bucket").sortWithinPartitions("bucket", "guest", "_order", "text")
    return rows.drop("_order")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 4) characters replaced by the first as
    many of the text that follows by id (all of it if it is shorter).  ``near_edited`` and
    ``near_next`` compare the fingerprint with that of the edited text and of the text
    that follows, from 0 to 1.

    A null text is empty; an empty text has the empty fingerprint, whose likeness to
    itself is 1.  Null ids come first; rows that share an id follow each other in the
    order of their texts.  A single row follows itself.  An empty table gives no rows;
    other columns are not looked at.
    """
    return with_neighbours(docs, id_col=id_col, text_col=text_col).mapInArrow(_walk, _COLUMNS)
