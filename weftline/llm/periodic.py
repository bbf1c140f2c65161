"""Periodic runs of words: stretches that repeat a unit over and over.

A run of period q agrees with itself q words on, so every stretch of words that comes
back at that distance is a sign of it.

* Multi-scale minimizers.  At scale W, for periods in (W/2, W], each place has the hash of
  the W words from there, and a place is a minimizer when its hash is the least of some W
  places in a row.  W words hold a whole period, so inside a run two places have equal
  hashes only when they lie whole periods apart, and every W places in a row have the same
  least hash.  A run of four periods holds two of its minimizers, one period apart: equal
  minimizers, W/2 to W words apart, are the seeds.
* Each seed is extended to both sides as long as words agree at its distance.
* Periods below the smallest scale are too short for that: they are looked for directly,
  lag by lag, at every so many places that no run can lie between two.

Scales double, and a text takes part up to the scale that its length admits, so the work
for n words is n log n, however long the runs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from weftline.llm.hashing import AS_IS, BLANK_SEPARATED, mix, text_bytes, word_blocks
from weftline.llm.runs import prepare

U = np.uint64
#: Longest period that is looked for lag by lag; half the smallest scale.
SHORT = 8
_BASE = U(0x9E3779B97F4A7C15 | 1)
_BACK = U(pow(int(_BASE), -1, 1 << 64))


def _sliding(values: np.ndarray, width: int, best, none) -> np.ndarray:
    """``best`` over every ``width`` values in a row, from running bests of blocks."""
    full = -(-len(values) // width) * width
    blocks = np.full(full, none, dtype=U)
    blocks[: len(values)] = values
    blocks = blocks.reshape(-1, width)
    ahead = best.accumulate(blocks, axis=1).ravel()
    behind = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    last = len(values) - width + 1
    return best(behind[:last], ahead[width - 1 : width - 1 + last])


def _minimizers(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the minimizers of this scale, and their hashes."""
    power = np.full(len(words) + 1, _BASE, dtype=U)
    back = np.full(len(words) - width + 1, _BACK, dtype=U)
    power[0] = back[0] = 1
    total = np.zeros(len(words) + 1, dtype=U)
    np.cumsum(words * np.cumprod(power, dtype=U)[:-1], out=total[1:])
    grams = mix((total[width:] - total[:-width]) * np.cumprod(back, dtype=U))
    if len(grams) < width:
        return np.zeros(0, np.int64), np.zeros(0, U)
    least = np.zeros(len(grams) + width - 1, dtype=U)
    least[width - 1 : len(grams)] = _sliding(grams, width, np.minimum, U(0xFFFFFFFFFFFFFFFF))
    places = np.flatnonzero(grams == _sliding(least, width, np.maximum, U(0)))
    return places, grams[places]


def _right(words: np.ndarray, place: int, lag: int) -> int:
    """The first place from ``place`` on whose word differs from that ``lag`` on."""
    end, step = len(words) - lag, 64
    while place < end:
        stop = min(end, place + step)
        differ = words[place:stop] != words[place + lag : stop + lag]
        at = int(differ.argmax())
        if differ[at]:
            return place + at
        place, step = stop, min(2 * step, 1 << 20)
    return end


def _left(words: np.ndarray, place: int, lag: int) -> int:
    """The first place of the agreeing stretch that ``place`` ends."""
    step = 64
    while place > 0:
        start = max(0, place - step)
        differ = (words[start:place] != words[start + lag : place + lag])[::-1]
        at = int(differ.argmax())
        if differ[at]:
            return place - at
        place, step = start, min(2 * step, 1 << 20)
    return 0


def _primitive(unit: np.ndarray) -> bool:
    """Whether no shorter unit repeated gives this one."""
    q, rest, p = len(unit), len(unit), 2
    while rest > 1:
        if p * p > rest:
            p = rest
        if rest % p == 0:
            d = q // p
            if np.array_equal(unit[d:], unit[:-d]):
                return False
            while rest % p == 0:
                rest //= p
        p += 1
    return True


def _extended(words: np.ndarray, seeds: np.ndarray, lags: np.ndarray, needed) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of the runs that seeds, in the order of lag and place, lie in."""
    done, of = 0, 0
    for place, lag in zip(seeds.tolist(), lags.tolist(), strict=True):
        if lag == of and place < done:
            continue
        start, done, of = _left(words, place, lag), _right(words, place, lag), lag
        length = done - start + lag
        if length >= needed(lag) and _primitive(words[start : start + lag]):
            yield start, length, lag


def _short_seeds(words: np.ndarray, lag: int, matches: int) -> np.ndarray:
    """One place or more in each stretch of ``matches`` words that agree at this lag."""
    end = len(words) - lag
    seeds = np.arange(0, max(end, 0), matches)
    seeds = seeds[words[seeds] == words[seeds + lag]]
    low, high = seeds.copy(), seeds.copy()
    for side, step, limit in ((low, -1, -1), (high, 1, end)):
        going = np.arange(len(seeds))
        for _ in range(matches):
            to = side[going] + step
            going, to = going[to != limit], to[to != limit]
            agree = words[to] == words[to + lag]
            going = going[agree]
            if not len(going):
                break
            side[going] = to[agree]
    return seeds[high - low + 1 >= matches]


def runs(words: np.ndarray, counts: np.ndarray, least: int = 6, exponent: int = 4) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of every run, sorted, of texts laid end to end.

    ``words`` are hashes, ``counts`` the words of each text.
    """
    text = np.repeat(np.arange(len(counts)), counts)
    # a word of one text differs from the same word of another, so no run crosses texts
    words = mix(words + text.astype(U) * U(0xD1342543DE82EF95) + U(1))
    numbers, found = np.arange(len(counts)), []
    needed = lambda lag: max(least, exponent * lag)

    def add(runs_at: Iterator[tuple[int, int, int]]) -> None:
        edges = np.cumsum(counts) - counts
        for start, length, period in runs_at:
            k = int(np.searchsorted(edges, start, side="right")) - 1
            found.append((int(numbers[k]), start - int(edges[k]), length, period))

    for lag in range(1, SHORT + 1):
        seeds = _short_seeds(words, lag, needed(lag) - lag)
        add(_extended(words, seeds, np.full(len(seeds), lag), needed))
    width = 2 * SHORT
    while True:
        able = counts >= needed(width // 2 + 1)
        if not able.any():
            break
        if not able.all():
            words, numbers, counts = words[np.repeat(able, counts)], numbers[able], counts[able]
        places, hashes = _minimizers(words, width)
        order = np.lexsort((places, hashes))
        places, hashes = places[order], hashes[order]
        lag = np.diff(places)
        near = (hashes[1:] == hashes[:-1]) & (lag > width // 2) & (lag <= width)
        seeds, lag = places[:-1][near], lag[near]
        order = np.lexsort((seeds, lag))
        add(_extended(words, seeds[order], lag[order], needed))
        width *= 2
    return tuple(np.array(c, dtype=np.int64) for c in zip(*sorted(found), strict=True)) or (np.zeros(0, np.int64),) * 4


def _work(least: int, exponent: int):
    names = ["start", "length", "period"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            data, where = text_bytes(texts)
            n_words, parts, collapsed = np.zeros(batch.num_rows, np.int64), [], []
            for first, counts, hashes, *_ in word_blocks(texts, BLANK_SEPARATED, AS_IS):
                n_words[first : first + len(counts)] = counts
                text, start, length, period = runs(hashes, counts, least, exponent)
                parts.append((text + first, start, length, period))
                edges = np.concatenate([[0], np.cumsum(counts)])
                dropped = np.zeros(len(hashes) + 1, dtype=np.int64)
                np.add.at(dropped, edges[text] + start + period, 1)
                np.add.at(dropped, edges[text] + start + length, -1)
                kept = np.cumsum(dropped[:-1]) == 0
                with_runs = set(text.tolist())
                for k in range(len(counts)):
                    at = first + k
                    spelled = data[where[at] : where[at + 1]].tobytes().split()
                    if k in with_runs:
                        spelled = compress(spelled, kept[edges[k] : edges[k + 1]].tolist())
                    collapsed.append(b" ".join(spelled))
            text, *columns = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 4
            offsets = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
            structs = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array(n_words, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), structs),
                    pa.array(collapsed, pa.binary()).cast(pa.string()),
                ],
                names=[*batch.schema.names[:-1], "n_words", "runs", "collapsed"],
            )

    return run


def find_runs(
    docs: DataFrame, *, text_col: str = "text", keep: Sequence[str] | None = None, least: int = 6, exponent: int = 4
) -> DataFrame:
    """The columns ``keep`` of ``docs``, or all, with ``n_words``, ``runs`` and ``collapsed``.

    Words are what ASCII blanks separate, as they are written.  A run is a stretch of words
    with smallest period q, of at least ``least`` words and ``exponent`` periods (4 or more),
    that cannot be prolonged; ``runs`` is an array of (start, length, period), words numbered
    from 0, sorted.  ``collapsed`` is the text without the words that some run repeats, the
    first period of each run staying, joined by single blanks.

    One row per row, in one map-only pass over whole texts of any length.  A null, empty or
    blank text has no words and no runs, and collapses to ''.  Equal rows give equal rows; an
    empty table gives an empty one.  Columns named ``n_words``, ``runs`` or ``collapsed`` are
    replaced.  Words are told apart by 64-bit hashes.
    """
    if exponent < 4 or least < 1:
        raise ValueError("exponent must be 4 or more, least 1 or more")
    prepare(docs.sparkSession)
    made = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    plain = docs.select(*[c for c in keep or docs.columns if c not in ("n_words", "runs", "collapsed")])
    schema = StructType([*plain.schema.fields, *StructType.fromDDL(made).fields])
    # by position: the text goes last, whatever names there are
    source = docs.select(*plain.columns, F.col(text_col).cast("string").alias("collapsed"))
    return source.mapInArrow(_work(least, exponent), schema)
