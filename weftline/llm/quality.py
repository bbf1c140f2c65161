"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are taken block by block in tasks.  A bounded sample of labelled
rows is fitted on the driver: features are cut into at most BINS bins by their quantiles,
every tree grows level by level from histograms of gradients, and all trees are laid out in
flat arrays.  Scoring is one map-only pass that moves all rows of a batch down a tree at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from weftline.llm.hashing import BLANK_SEPARATED, BLOCK, mix, text_bytes, word_blocks
from weftline.llm.runs import prepare

U = np.uint64
BINS = 64

#: The class of every byte, and of a word's last and first byte.
_LOWER, _UPPER, _DIGIT, _SPACE, _NEWLINE, _BLANK, _STOP, _PAUSE, _SYMBOL, _LEAD, _NEXT = range(11)
_CLASSES = 11


def _byte_classes() -> np.ndarray:
    kind = np.full(256, _SYMBOL, dtype=np.uint8)
    kind[97:123], kind[65:91], kind[48:58] = _LOWER, _UPPER, _DIGIT
    kind[[9, 11, 12, 13]] = _BLANK
    kind[32], kind[10] = _SPACE, _NEWLINE
    for ends, what in ((b".!?", _STOP), (b",;:'\"()-", _PAUSE)):
        kind[list(ends)] = what
    kind[128:192], kind[192:] = _NEXT, _LEAD
    return kind


_KIND = _byte_classes()

FEATURES = (
    "log_chars", "log_words", "log_lines", "letters", "upper", "digits", "blanks", "stops", "pauses", "symbols", "beyond_ascii",
    "word_length", "word_spread", "longest_word", "distinct_words", "commonest_word", "repeated_next", "distinct_pairs",
    "wordless", "symbol_ends", "stop_ends", "upper_starts", "words_a_line", "distinct_lines", "line_stops", "short_words",
)


def _histogram(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Bytes of each class in each text."""
    n = len(edges) - 1
    if n == 1:
        total = np.zeros(_CLASSES, np.int64)
        for at in range(0, len(data), BLOCK):
            total += np.bincount(_KIND[data[at : at + BLOCK]], minlength=_CLASSES)
        return total[None, :]
    of = np.repeat(np.arange(n) * _CLASSES, np.diff(edges))
    return np.bincount(of + _KIND[data], minlength=n * _CLASSES).reshape(n, _CLASSES)


def _distinct(keys: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many keys each text has, and how often its commonest occurs."""
    _, first, many = np.unique(mix(keys + of.astype(U) * U(0xD1342543DE82EF95)), return_index=True, return_counts=True)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, of[first], many)
    return np.bincount(of[first], minlength=n), most


_IN_LINE = np.ones(256, dtype=bool)
_IN_LINE[10] = False


def features(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for every text; null counts as empty."""
    raw, where = text_bytes(column)
    out = np.zeros((len(where) - 1, len(FEATURES)))
    for first, counts, hashes, begins, ends, data in word_blocks(column, BLANK_SEPARATED):
        n = len(counts)
        edges = where[first : first + n + 1] - where[first]
        kinds = _histogram(raw[where[first] : where[first + n]], edges)
        chars = np.maximum(edges[1:] - edges[:-1] - kinds[:, _NEXT], 1)
        of = np.repeat(np.arange(n), counts)
        per_word = 1.0 / np.maximum(counts, 1)
        share = lambda flags: np.bincount(of, flags, minlength=n) * per_word
        length = (ends - begins).astype(float)
        mean = share(length)
        longest = np.zeros(n)
        np.maximum.at(longest, of, length)
        inside = of[1:] == of[:-1]
        distinct, most = _distinct(hashes, of, n)
        pairs, _ = _distinct((hashes[:-1] * U(3) + hashes[1:])[inside], of[1:][inside], n)
        start, last = _KIND[data[begins]], _KIND[data[ends - 1]]
        plain = (last <= _DIGIT) | (last >= _LEAD)
        same = np.zeros(len(of), dtype=bool)
        same[1:] = inside & (hashes[1:] == hashes[:-1])
        lines = kinds[:, _NEWLINE] + 1
        out[first : first + n] = np.column_stack(
            [
                np.log1p(chars), np.log1p(counts), np.log1p(lines),
                (kinds[:, _LOWER] + kinds[:, _UPPER]) / chars, kinds[:, _UPPER] / chars, kinds[:, _DIGIT] / chars,
                (kinds[:, _SPACE] + kinds[:, _BLANK]) / chars, kinds[:, _STOP] * per_word, kinds[:, _PAUSE] * per_word,
                kinds[:, _SYMBOL] / chars, kinds[:, _LEAD] / chars,
                mean, np.sqrt(np.maximum(share(length**2) - mean**2, 0)), np.log1p(longest),
                distinct * per_word, most * per_word, share(same), pairs / np.maximum(counts - 1, 1),
                share((start == _SYMBOL) & (length < 4)), share(last == _SYMBOL), share(last == _STOP),
                share(start == _UPPER), counts / lines, np.ones(n), np.zeros(n), share(plain & (length < 4)),
            ]
        )
    for first, counts, hashes, _, ends, data in word_blocks(column, _IN_LINE):
        n, per_line = len(counts), 1.0 / np.maximum(counts, 1)
        of = np.repeat(np.arange(n), counts)
        distinct, _ = _distinct(hashes, of, n)
        out[first : first + n, FEATURES.index("distinct_lines")] = distinct * per_line
        out[first : first + n, FEATURES.index("line_stops")] = np.bincount(of, _KIND[data[ends - 1]] == _STOP, minlength=n) * per_line
    return out


@dataclass
class Trees:
    """All nodes of all trees in flat arrays; a leaf leads to itself.

    ``root`` has the first node of each tree, ``depth`` the steps that reach any leaf.
    """

    base: float
    root: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """The log odds of each row."""
        total, row = np.full(len(x), self.base), np.arange(len(x))
        for root in self.root:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                low = x[row, self.feature[node]] <= self.threshold[node]
                node = np.where(low, self.left[node], self.right[node])
            total += self.value[node]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))


def fit(
    x: np.ndarray, y: np.ndarray, *, trees: int = 120, depth: int = 4, rate: float = 0.1, penalty: float = 1.0, least: float = 2.0
) -> Trees:
    """Boosted trees for labels ``y`` from 0 to 1, by Newton steps on the log loss.

    A split needs a weight (sum of p(1-p)) of ``least`` on both sides, ``penalty`` shrinks
    leaf values, ``rate`` each tree's share.  No rows: even odds and no trees.  The result does not
    depend on the order of rows.
    """
    order = np.lexsort((y, *x.T[::-1])) if len(y) else np.zeros(0, int)
    x, y = x[order], y[order]
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
    base = float(np.log(mean / (1 - mean)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T] if len(y) else []
    # bin b of a feature holds the values above cut b - 1, up to cut b
    bins = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)]) if len(y) else None
    root, nodes, margin = [], [], np.full(len(y), base)
    for _ in range(trees if len(y) else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        root.append(len(nodes))
        nodes.append(None)
        at, open_nodes = np.full(len(y), len(nodes) - 1), [len(nodes) - 1]
        for level in range(depth + 1):
            slot = np.full(len(nodes), -1)
            slot[open_nodes] = np.arange(len(open_nodes))
            live = np.flatnonzero(slot[at] >= 0)
            mine, many = slot[at[live]], len(open_nodes)
            sum_g, sum_h = (np.bincount(mine, v[live], minlength=many) for v in (g, h))
            gain, best = np.zeros(many), np.zeros((many, 2), int)
            if level < depth:
                for f in range(x.shape[1]):
                    key = mine * BINS + bins[live, f]
                    lg, lh = (np.bincount(key, v[live], minlength=many * BINS).reshape(many, BINS).cumsum(axis=1)[:, :-1] for v in (g, h))
                    rg, rh = sum_g[:, None] - lg, sum_h[:, None] - lh
                    won = lg**2 / (lh + penalty) + rg**2 / (rh + penalty) - (sum_g**2 / (sum_h + penalty))[:, None]
                    won = np.where((lh >= least) & (rh >= least), won, 0)
                    cut = won.argmax(axis=1)
                    top = won[np.arange(many), cut]
                    better = top > gain + 1e-9
                    gain, best[better] = np.where(better, top, gain), np.column_stack([np.full(many, f), cut])[better]
            following = []
            for k, node in enumerate(open_nodes):
                if gain[k] <= 1e-9:
                    nodes[node] = (0, np.inf, node, node, rate * sum_g[k] / (sum_h[k] + penalty))
                    continue
                f, cut = best[k]
                nodes[node] = (f, cuts[f][cut], len(nodes), len(nodes) + 1, 0.0)
                following += [len(nodes), len(nodes) + 1]
                nodes += [None, None]
            split = live[gain[mine] > 1e-9]
            if not len(split):
                break
            f, cut = best[slot[at[split]]].T
            low = bins[split, f] <= cut
            pair = np.array([nodes[n][2] for n in at[split]])
            at[split] = np.where(low, pair, pair + 1)
            open_nodes = following
        margin = margin + np.array([n[4] for n in nodes[root[-1] :]])[at - root[-1]]
    feature, threshold, left, right, value = zip(*nodes, strict=True) if nodes else [()] * 5
    whole = lambda v: np.array(v, dtype=np.int64)
    return Trees(base, whole(root), whole(feature), np.array(threshold, float), whole(left), whole(right), np.array(value, float), depth)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features(batch.column(2))
        rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), rows], names=["id", "label", "x"])


def train(
    docs: DataFrame,
    labels: DataFrame,
    use: Column,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_rows: int = 20_000,
    **options,
) -> Trees:
    """Fits trees on the documents whose labels ``use``, a condition on ``labels``, admits.

    Of more than ``max_rows`` labelled ids, ``max_rows`` are used, those of the least hash of
    the id; so what is broadcast and fitted is bounded.  Several labels of one id count as
    their mean; of several documents of one id the one with the least statistics counts.
    Null labels and ids, and ids without a document, are no use.  Without any usable row
    every score is 0.5.  ``options`` are those of ``fit``.
    """
    prepare(docs.sparkSession)
    given = labels.where(use & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    given = given.groupBy(F.col(id_col).alias("id")).agg(F.avg(F.col(label_col).cast("double")).alias("label"))
    rank = F.pmod(F.xxhash64("id", F.lit("quality")), F.lit(1 << 40))
    # some more than are wanted, so the sort that cuts them off is small
    share = 1.25 * max_rows / max(1, given.count())
    if share < 1:
        given = given.where(rank < int(share * (1 << 40)))
    chosen = given.orderBy(rank, "id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").select("id", "label", "text")
    schema = StructType([rows.schema["id"], StructField("label", DoubleType())]).add("x", ArrayType(DoubleType()))
    got = rows.mapInArrow(_measured, schema).groupBy("id").agg(F.min("x").alias("x"), F.first("label").alias("label")).toArrow()
    x = got["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(got.num_rows, len(FEATURES))
    return fit(x, np.clip(got["label"].to_numpy(), 0, 1), **options)


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Trees = shared.value
        for batch in batches:
            score = model.score(features(batch.column(batch.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], names=batch.schema.names)

    return run


def score(docs: DataFrame, model: Trees, *, text_col: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs``, or all, with ``score``, the chance of label 1.

    Every row is scored on its whole text alone; equal texts have equal scores.  A null text
    counts as empty, and an empty one has statistics, and a score, as any other.  No rows, no
    result.  A column named ``score`` is replaced.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.select(*[c for c in keep or docs.columns if c != "score"])
    schema = StructType([*plain.schema.fields, StructField("score", DoubleType())])
    # by position: the text goes last, whatever names there are
    return docs.select(*plain.columns, F.col(text_col).cast("string").alias("score")).mapInArrow(_scored(shared), schema)
