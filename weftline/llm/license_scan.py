"""License scans by conditional compression.

A block of a text's words that may be a license notice is compared word by word with
the templates it shares a piece with.  Where the wording differs little from several, the
block is compressed on its own and with each of them as a raw zstandard dictionary; the
one that saves most is the license.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weftline.llm.license_texts import WORDINGS
from weftline.llm.runs import prepare

# The usual short notices of common licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "Released into the public domain under CC0 1.0.",
}

#: All wordings by license: the notices above and those of license_texts.
LICENSES = {name: [*([TEMPLATES[name]] if name in TEMPLATES else []), *WORDINGS.get(name, [])] for name in [*TEMPLATES, *(n for n in WORDINGS if n not in TEMPLATES)]}

_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def wording(text: str) -> list[str]:
    """The words of a notice, in lower case; hyphens and points inside stay (3.0, BY-NC)."""
    return _WORD.findall(text.lower())


@dataclass(frozen=True)
class _Template:
    name: str
    words: tuple[str, ...]
    allowed: int  # changed words
    pieces: tuple[tuple[int, str, frozenset[str]], ...]  # first word, wording between blanks, words
    packer: object


@lru_cache(maxsize=4)
def _templates(templates: tuple[tuple[str, str], ...], share: float):
    import zstandard

    plain = zstandard.ZstdCompressor(level=3, write_content_size=False)
    out = []
    for name, text in templates:
        words = wording(text)
        if not words:
            continue
        # at least one word must stand; of one piece more than changes, one stands unchanged
        allowed = max(0, min(int(share * len(words)), len(words) - 1))
        cuts = [len(words) * i // (allowed + 1) for i in range(allowed + 2)]
        pieces = tuple((a, f" {' '.join(words[a:b])} ", frozenset(words[a:b])) for a, b in zip(cuts, cuts[1:], strict=False))
        shared = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        packer = zstandard.ZstdCompressor(level=3, dict_data=shared, write_content_size=False)
        out.append(_Template(name, tuple(words), allowed, pieces, packer))
    return plain, out, frozenset(w for t in out for w in t.words)


def _blocks(words: list[str], known: list[_Template], vocabulary: frozenset[str]) -> Iterator[tuple[_Template, int, int]]:
    """(template, begin, end): where a notice of that template can stand, overlapping blocks as one."""
    present, joined = vocabulary.intersection(words), None
    for template in known:
        found = []
        for offset, piece, needed in template.pieces:
            if not needed <= present:
                continue
            if joined is None:
                joined = f" {' '.join(words)} "
                begins = np.cumsum([0, *(len(w) + 1 for w in words[:-1])])
            at = joined.find(piece)
            while at >= 0:
                found.append(int(np.searchsorted(begins, at)) - offset)
                at = joined.find(piece, at + 1)
        end = None
        for place in sorted(found):
            a = max(0, place - template.allowed)
            b = min(len(words), place + len(template.words) + template.allowed)
            if end is not None and a <= end:
                end = max(end, b)
                continue
            if end is not None:
                yield template, begin, end
            begin, end = a, b
        if end is not None:
            yield template, begin, end


def changes(block: list[str], template: _Template) -> list[tuple[int, int, int]]:
    """(words to put in, take out or replace, begin, end) of the block's parts that are the
    template but for the allowed changes; of parts that overlap, the one with the fewest."""
    numbers = {w: i for i, w in enumerate(dict.fromkeys(template.words))}
    text = np.array([numbers.get(w, -1) for w in block], dtype=np.int64)
    one, place = np.int64(1 << 32), np.arange(len(block) + 1, dtype=np.int64)
    # least cost of the words so far of the template, by end in the block; the latest begin of equal ones
    cost = len(block) - place
    for word in template.words:
        step = cost + one
        step[1:] = np.minimum(step[1:], cost[:-1] + one * (text != numbers[word]))
        cost = np.minimum.accumulate(step - place * one) + place * one
    n, begin = cost // one, len(block) - cost % one
    out: list[tuple[int, int, int]] = []
    taken = np.zeros(len(block), bool)
    ends = np.flatnonzero(n <= template.allowed)
    for end in ends[np.argsort(n[ends], kind="stable")].tolist():
        a = int(begin[end])
        if a < end and not taken[a:end].any():
            taken[a:end] = True
            out.append((int(n[end]), a, end))
    return out


def notices(words: list[str], templates: tuple[tuple[str, str], ...], share: float) -> list[tuple[int, int, str, float, int]]:
    """(begin, end, license, share of bytes saved, changed words) of every notice, in order."""
    plain, known, vocabulary = _templates(templates, share)
    ranked = []
    for template, a, b in _blocks(words, known, vocabulary):
        for n, begin, end in changes(words[a:b], template):
            data = " ".join(words[a + begin : a + end]).encode()
            alone = len(plain.compress(data))
            less = alone - len(template.packer.compress(data))
            ranked.append((-less, n, template.name, a + begin, a + end, less / max(1, alone)))
    # of notices that overlap, the one whose template saves most
    taken, out = np.zeros(len(words) if ranked else 0, bool), []
    for _, n, name, begin, end, saved in sorted(ranked):
        if not taken[begin:end].any():
            taken[begin:end] = True
            out.append((begin, end, name, saved, n))
    return sorted(out)


def _scan(templates: tuple[tuple[str, str], ...], share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = (text.as_py() or "").lower()
                found = notices(_WORD.findall(text), templates, share)
                if not found:
                    continue
                places = [m.start() for m in _WORD.finditer(text)]
                line, last = 0, 0
                for begin, _, *rest in found:
                    line, last = line + text.count("\n", last, places[begin]), places[begin]
                    rows.append((doc, line, *rest))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "line", "license", "saved", "n_changed"]
            )

    return run


def find_licenses(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str | Sequence[str]] = LICENSES, share: float = 0.1
) -> DataFrame:
    """doc_id, line, license, saved, n_changed: the license notices of the texts.

    A notice is a run of words, across line breaks, that differs from a template by at
    most ``share`` of the template's words; each one of a text gives a row, with the line
    it begins on (``line`` counts from 0).  A license may have several templates.  Candidates are the places where a piece of a
    template stands word for word: with one piece more than changes allowed, no notice is
    without.  Of templates confirmed at overlapping places the one that saves most bytes
    wins (of equal ones, the one with fewer changes).  Case, blanks and punctuation do not
    matter.

    All words of every text are looked at, in one map-only pass.  A text without notices,
    empty or null gives no row; repeated rows give their rows each; a null id stays null.
    No templates, or an empty table, no rows; other columns are not looked at.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pairs = tuple((name, text) for name, texts in templates.items() for text in ([texts] if isinstance(texts, str) else texts))
    return source.mapInArrow(
        _scan(pairs, share), "doc_id long, line long, license string, saved double, n_changed long"
    )
