"""Packing into fixed-length sequences by cutting-stock column generation.

Documents are tokenised, cut into full sequences and one remainder each.  Only the
histogram of piece lengths (at most ``capacity`` numbers) reaches the driver: a linear
program over patterns of length classes, whose columns are priced by a knapsack, says
which lengths to put together and how often.  Pieces, ranked within their length
class, then look up their sequence.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from weftline.llm.runs import prepare, stored

# --- the linear program -------------------------------------------------------


def classes(histogram: dict[int, int], most: int) -> dict[int, int]:
    """{length: the length that stands for it}: at most ``most`` classes of neighbouring
    lengths, each as long as its longest, with the least total of ids rounded up.

    Up to ``most`` different lengths stand for themselves.
    """
    lengths = sorted(n for n, k in histogram.items() if k)
    if len(lengths) <= most:
        return {n: n for n in lengths}
    size = np.array(lengths, dtype=float)
    pieces = np.concatenate([[0.0], np.cumsum([histogram[n] for n in lengths])])
    ids = np.concatenate([[0.0], np.cumsum([n * histogram[n] for n in lengths])])
    m = len(lengths)
    # lost[j, i]: ids added where one class holds the lengths i..j
    lost = size[:, None] * (pieces[1:, None] - pieces[None, :-1]) - (ids[1:, None] - ids[None, :-1])
    lost[np.triu_indices(m, 1)] = np.inf
    least, cuts, total = lost[:, 0], [], np.empty_like(lost)
    for _ in range(most - 1):
        np.add(np.concatenate([[np.inf], least[:-1]])[None, :], lost, out=total)
        begin = total.argmin(axis=1)
        cuts.append(begin)
        least = total[np.arange(m), begin]
    out, end = {}, m - 1
    for begin in [*reversed(cuts), np.zeros(m, dtype=int)]:
        first = int(begin[end])
        out |= {n: lengths[end] for n in lengths[first : end + 1]}
        end = first - 1
        if end < 0:
            break
    return out


def _price(duals: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of the largest dual value: an unbounded knapsack over capacities.

    Each length is offered one, two, four, ... times, so that any number of it can be
    made up; an offer is weighed for all capacities at once.
    """
    best, offers, taken = np.zeros(capacity + 1), [], []
    for k in np.flatnonzero(duals > 1e-12):
        times = 1
        while times * sizes[k] <= capacity:
            weight = int(times * sizes[k])
            value = best[:-weight] + times * duals[k]
            better = value > best[weight:] + 1e-12
            if better.any():
                best[weight:][better] = value[better]
                offers.append((int(k), times, weight))
                taken.append(better)
            times *= 2
    pattern, room = np.zeros(len(sizes), dtype=np.int64), capacity
    for (k, times, weight), better in zip(reversed(offers), reversed(taken), strict=True):
        if room >= weight and better[room - weight]:
            pattern[k] += times
            room -= weight
    return float(best[capacity]), pattern


def _largest_first(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """A feasible basis and its inverse: the largest lengths left fill a pattern, which is
    used until one of them is used up.  Column k is the pattern that used up length k.

    No pattern holds a length that is used up, so in the order of using up the basis is
    triangular, and its inverse needs no general solver.
    """
    order = []
    columns, left, active = np.zeros((len(sizes), len(sizes))), demand.copy(), np.ones(len(sizes), dtype=bool)
    for _ in sizes:
        pattern, room = np.zeros(len(sizes)), capacity
        for i in np.flatnonzero(active)[::-1]:
            pattern[i] = room // sizes[i]
            room -= int(pattern[i]) * int(sizes[i])
        used = np.flatnonzero(pattern)
        times = left[used] / pattern[used]
        gone = used[times.argmin()]
        left = np.maximum(left - times.min() * pattern, 0.0)
        columns[:, gone], active[gone] = pattern, False
        order.append(gone)
    inverse = np.zeros_like(columns)
    for k, gone in enumerate(order):
        earlier = order[:k]
        row = -(columns[gone, earlier][:, None] * inverse[earlier]).sum(axis=0)
        row[gone] += 1.0
        inverse[gone] = row / columns[gone, gone]
    return columns, inverse


def _relaxed(
    sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int, gap: float
) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as columns, how often each) of the linear program.

    Revised simplex from the largest-first patterns.  Every basis on the way is feasible, so
    ``rounds`` bounds the work and costs only padding.  Duals divided by the worth of
    the best pattern are feasible, so each round says how many sequences any solution
    needs; it ends within one sequence, or ``gap`` of all, of the most that was needed.
    """
    m = len(sizes)
    columns, inverse = _largest_first(sizes, demand, capacity)
    level, needed = np.maximum(inverse @ demand, 0.0), 0.0
    for _ in range(rounds):
        value, pattern = _price(inverse.sum(axis=0), sizes, capacity)
        needed = max(needed, level.sum() / max(value, 1.0))
        if value <= 1 + 1e-9 or level.sum() - needed <= max(1.0, gap * needed):
            break
        move = inverse @ pattern
        ratio = np.full(m, np.inf)
        np.divide(level, move, out=ratio, where=move > 1e-9)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        level = level - ratio[out] * move
        level[out] = ratio[out]
        pivot = inverse[out] / move[out]
        inverse = inverse - np.outer(move, pivot)
        inverse[out] = pivot
        columns[:, out] = pattern
    return columns.astype(np.int64), level


def patterns(
    histogram: dict[int, int], capacity: int, rounds: int = 1500, gap: float = 0.002
) -> list[tuple[int, dict[int, int]]]:
    """(how often, {length: how many}) so that every piece of the histogram has a place.

    The linear program's counts are rounded down; what is left over, fewer than one
    pattern per length, is packed largest first.
    """
    lengths = sorted(n for n, k in histogram.items() if k)
    if not lengths:
        return []
    sizes = np.array(lengths, dtype=np.int64)
    left = np.array([histogram[n] for n in lengths], dtype=np.int64)
    out = []
    columns, level = _relaxed(sizes, left.astype(float), capacity, rounds, gap)
    for k in np.argsort(-level):
        pattern = columns[:, k]
        used = pattern > 0
        times = min(int(level[k] + 1e-7), int((left[used] // pattern[used]).min()))
        if times > 0:
            left = left - times * pattern
            out.append((times, {int(sizes[i]): int(pattern[i]) for i in np.flatnonzero(used)}))
    while left.any():
        pattern, room = np.zeros_like(left), capacity
        for i in range(len(sizes) - 1, -1, -1):
            pattern[i] = min(left[i], room // sizes[i])
            room -= int(pattern[i] * sizes[i])
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        left = left - times * pattern
        out.append((times, {int(sizes[i]): int(pattern[i]) for i in np.flatnonzero(used)}))
    return out


@dataclass
class Slots:
    """For each length class: the first rank of each run of slots, the sequence the run
    begins with, and how many slots of the class one sequence of the run has."""

    rank: dict[int, np.ndarray]
    sequence: dict[int, np.ndarray]
    each: dict[int, np.ndarray]

    @classmethod
    def of(cls, plan: list[tuple[int, dict[int, int]]]) -> Slots:
        runs: dict[int, list[tuple[int, int, int]]] = {}
        given: dict[int, int] = {}
        base = 0
        for times, pattern in plan:
            for length, each in pattern.items():
                runs.setdefault(length, []).append((given.get(length, 0), base, each))
                given[length] = given.get(length, 0) + times * each
            base += times
        pick = lambda k: {n: np.array([r[k] for r in v], dtype=np.int64) for n, v in runs.items()}
        return cls(pick(0), pick(1), pick(2))

    def sequences(self, length: int, ranks: np.ndarray) -> np.ndarray:
        run = np.searchsorted(self.rank[length], ranks, side="right") - 1
        return self.sequence[length][run] + (ranks - self.rank[length][run]) // self.each[length][run]


# --- tokens -------------------------------------------------------------------

@dataclass
class _Encoder:
    """A vocabulary; with its rank file, texts without special tokens take the faster way."""

    tokenizer: object
    ranks: object
    special: list[str]

    def ids(self, text: str) -> np.ndarray:
        if self.ranks is None or any(t in text for t in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(self.ranks.encode_ordinary(text), dtype="<u4")


@lru_cache(maxsize=2)
def _encoder(path: str, ranks_path: str | None) -> _Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
    from tokenizers import Tokenizer

    tokenizer, ranks = Tokenizer.from_file(path), None
    if ranks_path:
        import public_tokenizers
        import tiktoken

        lines = Path(ranks_path).read_bytes().split(b"\n")
        pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, lines))}
        ranks = tiktoken.Encoding(ranks_path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs, special_tokens={})
    return _Encoder(tokenizer, ranks, [t.content for t in tokenizer.get_added_tokens_decoder().values()])


def _cut(path: str, ranks_path: str | None, capacity: int, end_id: int):
    """Pieces of each text, numbered within (task, length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(path, ranks_path), TaskContext.get().partitionId()
        given: dict[int, int] = {}
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encoder.ids(text.as_py() or ""), end_id).astype("<u4")
                n = len(ids)
                for start in range(0, n, capacity):
                    piece = ids[start : start + capacity]
                    length = len(piece)
                    rank = given[length] = given.get(length, -1) + 1
                    rows.append((doc, start, length, zlib.crc32(piece.tobytes()), n, part, rank))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * 7, names=_PIECE)

    return run


_PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank"]


def _place(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots: Slots = shared.value
        for batch in batches:
            group, rank = batch.column("class").to_numpy(), batch.column("rank").to_numpy()
            out = np.zeros(len(group), dtype=np.int64)
            for g in np.unique(group):
                mine = group == g
                out[mine] = slots.sequences(int(g), rank[mine])
            yield batch.append_column("sequence_id", pa.array(out))

    return run


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    ranks_path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    most_classes: int = 128,
    end_id: int = 1,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids, with ``end_id`` behind them, are cut into sequences of
    ``capacity`` ids; what remains is one piece.  Up to ``most_classes`` different
    lengths enter the linear program as they are; of more, neighbours share a class as
    long as its longest, cut so that the least is rounded up (``classes``).  ``sequence_id`` counts from 0 without gaps; ``offset`` is gapless
    from 0 within a sequence.

    ``ranks_path`` may name a rank file of the same vocabulary; ids are the same, sooner.

    A null or empty text is ``end_id`` alone.  Rows are packed one by one, so repeated
    rows, equal or null ids give pieces of their own.  An empty table gives no rows;
    other columns are not looked at.
    """
    spark = docs.sparkSession
    prepare(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = ", ".join(f"{c} long" for c in _PIECE)
    pieces = stored(source.mapInArrow(_cut(tokenizer_path, ranks_path, capacity, end_id), schema), "pieces")
    # at most one row a task and length
    by_part = stored(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    class_of = classes(histogram, most_classes)
    demand: dict[int, int] = {}
    for length, n in histogram.items():
        demand[class_of[length]] = demand.get(class_of[length], 0) + n
    slots = spark.sparkContext.broadcast(Slots.of(patterns(demand, capacity)))
    named = spark.createDataFrame(list(class_of.items()), "length long, class long")
    before = Window.partitionBy("class").orderBy("length", "part")
    starts = by_part.join(named, "length").withColumn("before", F.sum("n").over(before) - F.col("n")).drop("n")
    ranked = pieces.join(starts, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "part")
    placed = ranked.mapInArrow(_place(slots), ranked.withColumn("sequence_id", F.lit(0).cast("long")).schema)
    # a sequence holds at most ``capacity`` pieces
    earlier = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("long").alias("offset"),
    )
