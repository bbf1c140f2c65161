"""Benchmark decontamination: exact windows of benchmark items inside documents.

A prefix-filtered set join.  Containment of a window needs all of its words, so
its necessary prefix under the order "rarest first" is one word: its rarest word in
the documents.  Document words meet windows on that word only; a meeting survives if
the window fits into the document at that place (positions and lengths) and if all
its words stand there in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weftline.llm.hashing import ALPHANUMERIC, word_blocks
from weftline.llm.runs import free_names, prepare



def _hashes(texts: list[str | None]) -> list[np.ndarray]:
    """The word hashes of each text."""
    out = []
    for _, counts, hashes, *_ in word_blocks(pa.array(texts, pa.large_string()), ALPHANUMERIC):
        out += np.split(hashes, np.cumsum(counts)[:-1])
    return out


class _Windows:
    """Windows of one block of items, found by the hash of their rarest word.

    Windows are keyed by anchor word and, behind it, laid out flat, so that all
    meetings of a block of documents are looked up and compared in one go.
    """

    def __init__(self, items: list[tuple[int, np.ndarray]], size: int, frequency: dict[int, int]):
        rows: dict[tuple[int, int, bytes], set[int]] = {}
        for number, (_, words) in enumerate(items):
            width = min(size, len(words))
            for at in range(len(words) - width + 1 if width else 0):
                window = words[at : at + width]
                count = [frequency.get(int(w), 0) for w in window]
                anchor = int(np.argmin(count))
                if count[anchor]:  # a window with a word that no document has occurs nowhere
                    rows.setdefault((int(window[anchor]), anchor, window.tobytes()), set()).add(number)
        keys = sorted(rows, key=lambda k: k[0])
        self.items = [i for i, _ in items]
        self.anchor = np.array([k[0] for k in keys], dtype=np.uint64)
        self.offset = np.array([k[1] for k in keys], dtype=np.int64)
        words = [np.frombuffer(k[2], dtype=np.uint64) for k in keys]
        self.width = np.array([len(w) for w in words], dtype=np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.width)]).astype(np.int64)
        self.words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.owners = [np.array(sorted(rows[k]), dtype=np.int64) for k in keys]
        self.distinct, self.first = np.unique(self.anchor, return_index=True)
        self.many = np.diff(np.append(self.first, len(self.anchor)))

    def meetings(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the anchor, window) for each word that is an anchor."""
        if not len(self.distinct):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        slot = np.minimum(np.searchsorted(self.distinct, words), len(self.distinct) - 1)
        place = np.flatnonzero(self.distinct[slot] == words)
        slot = slot[place]
        many = self.many[slot]
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(place, many), np.repeat(self.first[slot], many) + step

    def found(self, words: np.ndarray, doc_begin: np.ndarray, doc_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of each occurrence; doc_begin, doc_end: the document's
        words around each word."""
        place, window = self.meetings(words)
        start = place - self.offset[window]
        fits = (start >= doc_begin[place]) & (start + self.width[window] <= doc_end[place])
        start, window = start[fits], window[fits]
        k = 0
        while len(start) and k < self.width.max():  # one word further each time, only what still agrees
            more = k < self.width[window]
            same = np.ones(len(start), dtype=bool)
            same[more] = words[start[more] + k] == self.words[self.begin[window[more]] + k]
            start, window = start[same], window[same]
            k += 1
        return start, window




def _merge(begins: list[int], ends: list[int]) -> tuple[list[int], list[int]]:
    """The union of half-open ranges, as ranges apart from each other."""
    out_b: list[int] = []
    out_e: list[int] = []
    for b, e in sorted(zip(begins, ends, strict=True)):
        if out_e and b <= out_e[-1]:
            out_e[-1] = max(out_e[-1], e)
        else:
            out_b.append(b)
            out_e.append(e)
    return out_b, out_e


def _scan(windows, last: bool):
    """Adds one block's hits to the last five columns: text, words, begins and ends of hits, items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: _Windows = windows.value
        for batch in batches:
            n = batch.num_rows
            *others, text, _, begins, ends, items = batch.columns
            total = np.zeros(n, dtype=np.int64)
            begins, ends, items = begins.to_pylist(), ends.to_pylist(), items.to_pylist()
            for first, counts, hashes, *_ in word_blocks(text, ALPHANUMERIC):
                total[first : first + len(counts)] = counts
                edge = np.concatenate([[0], np.cumsum(counts)])
                start, window = block.found(hashes, np.repeat(edge[:-1], counts), np.repeat(edge[1:], counts))
                doc = np.searchsorted(edge, start, side="right") - 1
                for d in np.unique(doc):
                    mine = doc == d
                    at, which = start[mine] - edge[d], window[mine]
                    i = first + int(d)
                    begins[i], ends[i] = _merge(
                        begins[i] + at.tolist(), ends[i] + (at + block.width[which]).tolist()
                    )
                    numbers = {int(o) for w in np.unique(which) for o in block.owners[w]}
                    items[i] = sorted({*items[i], *(block.items[o] for o in numbers if block.items[o] is not None)})
            made = [pa.array(total), *(pa.array(values, pa.list_(pa.int64())) for values in (begins, ends, items))]
            names = batch.schema.names
            columns = [*others, *made] if last else [*others, text, *made]
            yield pa.RecordBatch.from_arrays(columns, names=[*names[:-5], *names[-4:]] if last else names)

    return run


def _frequencies(docs: DataFrame, text_col: str, vocabulary: np.ndarray) -> dict[int, int]:
    """How often each word of ``vocabulary`` (sorted) stands in the documents."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        total = np.zeros(len(known.value), dtype=np.int64)
        for batch in batches:
            for _, _, hashes, *_ in word_blocks(batch.column(0), ALPHANUMERIC):
                slot = np.minimum(np.searchsorted(known.value, hashes), len(total) - 1)
                slot = slot[known.value[slot] == hashes]
                total += np.bincount(slot, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["word", "n"])

    if not len(vocabulary):
        return {}
    counts = docs.select(text_col).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {int(vocabulary[r["word"]]): int(r["n"]) for r in counts.collect()}


#: Words of benchmark items that are broadcast at once: 8 bytes a word, and about
#: ``size`` times that for the windows.
BLOCK_WORDS = 1_000_000


def _item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    block, words = [], 0
    for row in items.select(F.col(id_col).cast("long"), text_col).toLocalIterator():
        [hashes] = _hashes([row[1]])
        if not len(hashes):
            continue
        block.append((row[0], hashes))
        words += len(hashes)
        if words >= BLOCK_WORDS:
            yield block
            block, words = [], 0
    if block:
        yield block


def find_items(
    docs: DataFrame,
    items: DataFrame,
    *,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    size: int = 13,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit`` and ``items`` (ids of items that occur).

    Words are runs of ASCII digits, letters in lower case and characters beyond
    ASCII.  A window is ``size`` words in a row of an item, or the whole item if it
    has fewer; a document word inside any occurrence of a window is hit.

    The query set is worked through in blocks of BLOCK_WORDS words, one map-only
    pass each over all documents; documents are never shuffled.  A null or empty
    text has no words and no hits; an item without words has no windows; one with a null
    id hits as any other, but is not listed.  Repeated rows, and repeated item ids, are each looked at (an id is
    listed once).  An empty ``docs`` or ``items`` is fine.  The columns ``keep``, or all, pass
    through, except that ``n_words``, ``n_hit`` and ``items`` are replaced.
    """
    spark = docs.sparkSession
    prepare(spark)
    keep = [c for c in keep or docs.columns if c not in ("n_words", "n_hit", "items")]
    none = F.array().cast("array<bigint>")
    text, n_words, begin, end, found = names = free_names(keep, "text", "n_words", "begin", "end", "found")
    values = (F.col(text_col).cast("string"), F.lit(0).cast("long"), none, none, none)
    work = docs.select(*keep, *[v.alias(n) for v, n in zip(values, names, strict=True)])
    waiting = None

    def scanned(block: list, last: bool) -> DataFrame:
        vocabulary = np.unique(np.concatenate([w for _, w in block])) if block else np.zeros(0, np.uint64)
        windows = _Windows(block, size, _frequencies(docs, text_col, vocabulary))
        return work.mapInArrow(_scan(spark.sparkContext.broadcast(windows), last), (work.drop(text) if last else work).schema)

    for block in _item_blocks(items, item_id, item_text):
        if waiting is not None:
            work = scanned(waiting, False)
        waiting = block
    work = scanned(waiting or [], True)  # texts do not come back from the last scan
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return work.select(*keep, F.col(n_words).alias("n_words"), (total(end) - total(begin)).alias("n_hit"), F.col(found).alias("items"))


def is_contaminated(share: int = 20):
    """The rule: something is hit, and at least one word in ``share`` is."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))
