"""Records of delimited text whose quoted fields may hold line breaks, read in splits.

A line break ends a record only outside quotes, and whether a split of a file begins inside
quotes depends on all that stands before it.  So every split first says, for both answers,
in which state it ends; running over the splits of a file settles the states; then each
split cuts its lines into records.  A record belongs to the split it starts in: what the
following splits hold of it is sent there.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.session import scratch_path

_QUOTE = '"'


def ends_inside(line: str, inside: bool, sep: str) -> bool:
    """Whether a line ends within quotes.  A quote opens a field only where the field begins;
    two in a row stand for one."""
    if _QUOTE not in line:
        return inside
    at = 0
    while True:
        if inside:
            at = line.find(_QUOTE, at)
            if at < 0:
                return True
            if line.startswith(_QUOTE, at + 1):
                at += 2
                continue
            inside, at = False, at + 1
        elif line.startswith(_QUOTE, at) and (at == 0 or line.startswith(sep, at - len(sep))):
            inside, at = True, at + 1
            continue
        at = line.find(sep + _QUOTE, at)
        if at < 0:
            return False
        at += len(sep)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[str], list[int]]]:
    """((file, split), lines, the numbers of those with a quote) in the order of the file, as
    they come."""
    for batch in batches:
        files, splits, values = batch.columns
        place = np.stack([files.to_numpy(), splits.to_numpy()])
        edges = [0, *(np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:], strict=False):
            if start < end:
                lines = values.slice(start, end - start)
                quoted = np.flatnonzero(pc.match_substring(lines, _QUOTE).to_numpy(zero_copy_only=False))
                yield (files[start].as_py(), splits[start].as_py()), lines.to_pylist(), quoted.tolist()


def _states(sep: str):
    """Per split: the state at its end if it begins outside, and if inside, and whether in
    that case some line ends outside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, out, within, closed = None, False, True, False

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"file": [place[0]], "split": [place[1]], "out": [out], "within": [within], "closed": [closed]})

        for key, lines, quoted in _lines(batches):
            if key != place:
                if place is not None:
                    yield row()
                place, out, within, closed = key, False, True, False
            # a line without a quote ends as it begins
            for at in quoted:
                out, within = ends_inside(lines[at], out, sep), ends_inside(lines[at], within, sep)
                closed = closed or not within
        if place is not None:
            yield row()

    return run


def _cut(shared, sep: str):
    """(file, owner, split, value): whole records without an owner, else parts of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners: dict[tuple[int, int], int] = shared.value
        place, owner, inside, held = None, None, False, []
        for key, lines, quoted in _lines(batches):
            rows = []
            if key != place:
                if held:
                    rows.append((place[0], place[1] if owner is None else owner, place[1], "\n".join(held)))
                place, owner, held = key, owners.get(key), []
                inside = owner is not None
            done = 0
            for at in [*quoted, len(lines)]:
                # up to the next quote, lines are records outside quotes and all of one inside
                if inside:
                    held += lines[done:at]
                else:
                    rows += [(key[0], None, key[1], line) for line in lines[done:at]]
                done = at
                if at < len(lines):
                    held.append(lines[at])
                    inside, done = ends_inside(lines[at], inside, sep), at + 1
                    if not inside:
                        rows.append((key[0], owner, key[1], "\n".join(held) if len(held) > 1 else lines[at]))
                        owner, held = None, []
            yield _batch(rows)
        if held:
            yield _batch([(place[0], place[1] if owner is None else owner, place[1], "\n".join(held))])

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "owner", "split", "value"])


def broken_lines(spark: SparkSession, paths: Sequence[str], recursive: bool = False) -> bool:
    """Whether some line has an odd number of quotes, as the first line of a broken field has."""
    lines = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("lineSep", "\n").text(list(paths))
    quotes = F.length("value") - F.length(F.replace("value", F.lit(_QUOTE), F.lit("")))
    return not lines.where(quotes % 2 == 1).isEmpty()


def records(spark: SparkSession, paths: Sequence[str], sep: str, recursive: bool = False) -> tuple[DataFrame, str | None]:
    """(value) per record, line breaks within quotes kept, and the first record.

    No task holds more than a split and the records that start in it.  The driver gets one
    row for each split that begins inside quotes, which is what is broadcast.  The records
    are written to the shared folder once.  A quote that is never closed makes the rest of
    its file one record.  Empty lines outside quotes are left out.
    """
    lines = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("lineSep", "\n").text(list(paths))
    lines = lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")

    states = lines.mapInArrow(_states(sep), "file long, split long, out boolean, within boolean, closed boolean")
    order = Window.partitionBy("file").orderBy("split")
    # a split that ends alike in both cases settles the state, one that ends otherwise turns it
    settled, turns = F.col("out") == F.col("within"), F.col("out") & ~F.col("within")
    states = states.withColumn("since", F.sum(settled.cast("int")).over(order))
    part = Window.partitionBy("file", "since").orderBy("split")
    turned = F.sum(turns.cast("int")).over(part) % 2 == 1
    states = states.withColumn("ends", turned != F.coalesce(F.first(F.when(settled, F.col("out"))).over(part), F.lit(False)))
    states = states.withColumn("starts", F.coalesce(F.lag("ends").over(order), F.lit(False)))
    opens = F.col("ends") & (~F.col("starts") | F.col("closed"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    states = states.withColumn("owner", F.last(F.when(opens, F.col("split")), ignorenulls=True).over(before))
    inside = states.where("starts").select("file", "split", "owner").toArrow().to_pylist()
    shared = spark.sparkContext.broadcast({(r["file"], r["split"]): r["owner"] for r in inside})

    cut = lines.mapInArrow(_cut(shared, sep), "file long, owner long, split long, value string")
    head = next((r["value"] for r in cut.where("owner IS NULL").head(1)), None)
    path = scratch_path(spark, "records")
    cut.write.parquet(path)
    cut = spark.read.schema(cut.schema).parquet(path)
    parts = cut.where("owner IS NOT NULL").groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("split", "value"))).alias("parts"))
    joined = parts.select(F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("value"))
    whole = cut.where("owner IS NULL").select("value").unionByName(joined)
    tidy = F.regexp_replace("value", r"\r$", "")
    return whole.select(tidy.alias("value")).where("value <> ''"), head.removesuffix("\r") if head else head
