"""Language ID by word-first backoff.

A known word counts by its log frequency in each language.  A word that the model
does not know falls back to its longest character n-grams that it does know.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from weftline.llm.hashing import ALPHANUMERIC, BLOCK, mix, shingles, text_bytes, word_blocks
from weftline.llm.runs import prepare, stored

#: No language: no text, or no letter in it.
UNDETERMINED = "und"

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


#: Signs that frame a word; no word holds them.
_OPEN, _CLOSE = ord("<"), ord(">")


def _framed(words: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first, characters, word of each) of framed words, some at a time, A-Z in lower case."""
    at = 0
    while at < len(words):
        end, size = at, 0
        while end < len(words) and (end == at or size + len(words[end]) <= BLOCK):
            size += len(words[end])
            end += 1
        text = b"<" + b"><".join(words[at:end]) + b">"
        chars = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
        chars = np.where((chars >= 65) & (chars <= 90), chars + 32, chars)
        yield at, chars, np.cumsum(chars == _OPEN) - 1
        at = end


def _grams(chars: np.ndarray, word: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, hash) of all n-grams of one size, a bounded number at a time."""
    for at in range(0, len(chars) - size + 1, BLOCK):
        part = chars[at : at + BLOCK + size - 1].astype(np.uint64)
        of = word[at : at + BLOCK + size - 1]
        inside = of[: len(of) - size + 1] == of[size - 1 :]
        yield of[: len(of) - size + 1][inside], shingles(mix(part + np.uint64(1)), size)[inside]


def _found(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are among the sorted known ones, and where."""
    if not len(known):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    slot = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return known[slot] == keys, slot


@dataclass
class Model:
    """Log frequencies per language: of words (``keys[0]``, sorted hashes, with ``scores[0]``)
    and of the n-grams of each size."""

    languages: list[str]
    keys: list[np.ndarray]
    scores: list[np.ndarray]

    def of_unseen(self, words: list[bytes]) -> np.ndarray:
        """Per word, the mean over the known n-grams of the longest size that has any."""
        out = np.zeros((len(words), len(self.languages)))
        for first, chars, word in _framed(words):
            some = np.arange(word[-1] + 1)
            for size in range(len(self.keys) - 1, 0, -1):
                many, total = np.zeros(len(some)), np.zeros((len(some), len(self.languages)))
                for of, gram in _grams(chars, word, size):
                    known, slot = _found(self.keys[size], gram)
                    of, slot = of[known], slot[known]
                    many += np.bincount(of, minlength=len(some))
                    for k in range(len(self.languages)):
                        total[:, k] += np.bincount(of, self.scores[size][slot, k], minlength=len(some))
                done = many > 0
                out[first + some[done]] = total[done] / many[done, None]
                # on with the words that have none of this size
                left = ~done
                chars, word = chars[left[word]], word[left[word]]
                if not len(chars):
                    break
                number = np.cumsum(left) - 1
                some, word = some[left], number[word]
        return out


def _counted(longest: int):
    """Counts of words (size 0) and n-grams per language, of a block of texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            names, lang = langs.dictionary, langs.indices.to_numpy()
            for first, counts, hashes, begins, ends, data in word_blocks(batch.column(1), ALPHANUMERIC):
                if not len(hashes):
                    continue
                # one entry per distinct word and language
                mine = np.repeat(lang[first : first + len(counts)], counts)
                order = np.lexsort((mine, hashes))
                word, of = hashes[order], mine[order]
                new = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (of[1:] != of[:-1])]))
                many = np.diff(np.append(new, len(word)))
                word, of, place = word[new], of[new], order[new]
                yield _rows(0, word, of, many, names)
                spelled = [data[b:e].tobytes() for b, e in zip(begins[place].tolist(), ends[place].tolist(), strict=True)]
                for at, chars, owner in _framed(spelled):
                    for size in range(1, longest + 1):
                        for which, gram in _grams(chars, owner, size):
                            which = which + at
                            order = np.lexsort((of[which], gram))
                            which, gram = which[order], gram[order]
                            new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (of[which][1:] != of[which][:-1])]) if len(gram) else np.zeros(0, bool)
                            new = np.flatnonzero(new)
                            if len(new):
                                yield _rows(size, gram[new], of[which][new], np.add.reduceat(many[which], new), names)

    return run


def _rows(size: int, key: np.ndarray, lang: np.ndarray, n: np.ndarray, names: pa.Array) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(key), size), pa.int32()), pa.array(key.view(np.int64)), names.take(pa.array(lang)), pa.array(n, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["size", "key", "lang", "n"])


def train(
    docs: DataFrame,
    use: Column,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    max_docs: int = 10_000,
    max_bytes: int = 32 << 20,
    least: int = 2,
    longest: int = 4,
    common: float = 0.1,
) -> Model:
    """Fits the model on the labelled rows that ``use`` admits.

    Of more than ``max_docs`` such rows, or ``max_bytes`` of text in them, an even share by a
    hash of the text is used, so that about as many are left.  Words, and n-grams of up to
    ``longest`` characters, that these texts hold ``least`` times are known; nothing else
    bounds the model, so its size follows from that of the sample.  A frequency in a language
    is mixed with its mean over all languages, of weight ``common``, so a language of little
    text does not win by what it has not shown.  Rows without text or label are no use.  No usable row: a model of no language.  Columns of other names are
    not looked at.
    """
    prepare(docs.sparkSession)
    good = docs.where(use & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    good = good.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    many, size = good.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()
    share = min(1.0, max_docs / max(1, many), max_bytes / max(1, size))
    if share < 1:
        good = good.where(F.pmod(F.xxhash64("text", F.lit("train")), F.lit(1 << 20)) < int(share * (1 << 20)))
    counts = good.mapInArrow(_counted(longest), "size int, key long, lang string, n long")
    counts = counts.groupBy("size", "key", "lang").agg(F.sum("n").alias("n"))
    counts = counts.groupBy("size", "key").agg(F.sum("n").alias("_all"), F.collect_list(F.struct("lang", "n")).alias("_by"))
    # a row per known key and language, and what each language has of each size in all
    counts = stored(counts, "language-counts")
    totals = {(r["size"], r["lang"]): r["n"] for r in counts.select("size", F.inline("_by")).groupBy("size", "lang").agg(F.sum("n").alias("n")).collect()}
    got = counts.where(F.col("_all") >= least).select("size", "key", F.inline("_by")).toArrow()
    languages = sorted({lang for _, lang in totals})
    size, key, n = (got[c].to_numpy() for c in ("size", "key", "n"))
    lang = pc.index_in(got["lang"], pa.array(languages, pa.string())).to_numpy()
    keys, scores = [], []
    for k in range(longest + 1):
        known, row = np.unique(key[size == k].view(np.uint64), return_inverse=True)
        table = np.zeros((len(known), len(languages)))
        table[row, lang[size == k]] = n[size == k]
        share = table / np.array([max(1.0, totals.get((k, v), 0)) for v in languages])
        keys.append(known)
        scores.append(np.log((1 - common) * share + common * share.sum(axis=1, keepdims=True) / max(1, len(languages))).astype(np.float32))
    return Model(languages, keys, scores)


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        width = len(model.languages)
        names = np.array([*model.languages, UNDETERMINED], dtype=object)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            total = np.zeros((batch.num_rows, width))
            for first, counts, hashes, begins, ends, data in word_blocks(texts, ALPHANUMERIC):
                if not width or not len(hashes):
                    continue
                doc = np.repeat(np.arange(first, first + len(counts)), counts)
                seen, slot = _found(model.keys[0], hashes)
                new, place, back = np.unique(hashes[~seen], return_index=True, return_inverse=True)
                where = np.flatnonzero(~seen)[place]
                extra = model.of_unseen([data[begins[i] : ends[i]].tobytes() for i in where.tolist()])
                for k in range(width):
                    total[:, k] += np.bincount(doc[seen], model.scores[0][slot[seen], k], minlength=batch.num_rows)
                    if len(new):
                        total[:, k] += np.bincount(doc[~seen], extra[back, k], minlength=batch.num_rows)
            letters = _has_letter(texts)
            if width:
                likely = np.exp(total - total.max(axis=1, keepdims=True))
                likely /= likely.sum(axis=1, keepdims=True)
                best = np.where(letters, likely.argmax(axis=1), width)
                score = np.where(letters, likely.max(axis=1), 0.0)
            else:
                best, score = np.zeros(batch.num_rows, int), np.zeros(batch.num_rows)
            columns = [*batch.columns[:-1], pa.array(names[best].tolist(), pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return run


def _has_letter(texts: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script."""
    data, where = text_bytes(texts)
    base = where[0] if len(where) else 0
    seen = np.concatenate([[0], np.cumsum(_LETTER[data[base : where[-1]]], dtype=np.int64)])
    out = seen[where[1:] - base] > seen[where[:-1] - base]
    for i in np.flatnonzero(~out & (where[1:] > where[:-1])):
        out[i] = any(c.isalpha() for c in data[where[i] : where[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs``, or all, with ``lang_pred`` and ``score``, the
    posterior of that language.

    Every row is judged on its whole text alone, in one map-only pass.  A null text,
    one without letters, and a model of no language give ``und`` with score 0.  Of
    equally likely languages the first by name wins.  Columns named ``lang_pred`` or
    ``score`` are replaced.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.select(*[c for c in keep or docs.columns if c not in ("lang_pred", "score")])
    schema = StructType([*plain.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    # by position: the text goes last, whatever names there are
    source = docs.select(*plain.columns, F.col(text_col).cast("string").alias("score"))
    return source.mapInArrow(_predict(shared), schema)
