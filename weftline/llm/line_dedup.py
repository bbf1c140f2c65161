"""Line dedup: drop long lines that many documents share, but for one keeper each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weftline.llm.runs import lookup

_BLANKS = " \t\n\u000b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_ID = -(1 << 63)


def line_key(line: Column) -> Column:
    """A line without ASCII blanks at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(_BLANKS)), _UPPER, _LOWER)


def drop_shared_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5
) -> DataFrame:
    """``docs`` with ``text_col`` rebuilt, plus ``n_lines`` and ``n_dropped``.

    Lines (split at ``\\n``) are normalised by ``line_key`` and hashed to 128 bits.
    A key of at least ``min_chars`` code points that at least ``min_docs`` documents
    hold loses all its lines, except in the largest id that holds it.  Other lines
    are joined again in their order.

    Every row of ``docs`` gives one row; other columns pass through.  A null or
    empty text is one empty line and comes back as ''.  Rows that share an id are
    one document for the count; a null id counts as one document below all others.
    An empty table gives an empty one.  ``docs`` must not use the names ``n_lines``,
    ``n_dropped`` itself: they are replaced.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    text = F.coalesce(F.col(text_col), F.lit(""))
    # the join key of a row: its id and a hash of its text; equal rows get equal decisions
    row_id, row_hash = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)), F.xxhash64(text)

    lines = docs.select(row_id.alias("_d"), row_hash.alias("_t"), F.posexplode(F.split(text, "\n", -1)).alias("_pos", "_line"))
    # a key is never longer than its line, so most lines go before they are normalised
    lines = lines.where(F.length("_line") >= min_chars).withColumn("_key", line_key(F.col("_line")))
    lines = lines.where(F.length("_key") >= min_chars).select(
        "_d", "_t", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(min_chars), "_key").alias("_h2")
    )
    holders = lines.groupBy("_h1", "_h2", "_d").agg(F.count("*").alias("_rows"))
    shared = holders.groupBy("_h1", "_h2").agg(
        F.count("*").alias("_docs"), F.max("_d").alias("_keeper"), F.sum("_rows").alias("_held")
    )
    shared = shared.where(F.col("_docs") >= min_docs).drop("_docs")
    total = docs.count()
    gone = lookup(lines, shared, ["_h1", "_h2"], "_held", total)
    gone = gone.where(F.col("_keeper") != F.col("_d")).groupBy("_d", "_t").agg(F.collect_set("_pos").alias("_gone"))

    whole = docs.select(*keep, row_id.alias("_d"), row_hash.alias("_t")).join(gone, ["_d", "_t"], "left")
    whole = whole.withColumn("_lines", F.split(text, "\n", -1)).withColumn("n_lines", F.size("_lines").cast("long"))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    rebuilt = F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n")
    return whole.select(
        *[F.when(F.col("_gone").isNull(), text).otherwise(rebuilt).alias(c) if c == text_col else F.col(c) for c in keep],
        "n_lines",
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("n_dropped"),
    )
