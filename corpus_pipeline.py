"""The corpus pipeline: five stages over ``documents``, each written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.llm import decontaminate, jaccard_join, language_id, line_dedup, packing
from weftline.llm.runs import stored
from weftline.session import load

#: A document is rejected when no language is that likely, or when it has none.
LEAST_LIKELY = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of no clear language, go.

    A null, empty or letterless text has no language, so its row goes.  The model is learned
    from rows that have text and ``lang``; without any, all rows go.  Every row is judged by
    its own text: repeated rows stay or go together, whatever their ids.  No rows, no result.
    """
    model = language_id.train(docs, F.lit(True))
    judged = language_id.identify(docs, model)
    return judged.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_LIKELY)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them.

    Every row stays; a null text comes back empty, and a text may become empty.  Of the
    documents that share a line the largest id keeps it; rows of one id count as one
    document, null ids as one below all others.  ``n_chars`` is counted anew.  No rows, no result.
    """
    kept = line_dedup.drop_shared_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the smallest id.

    A null, empty or blank text is near nothing and stays.  Repeated rows of the id that
    stays remain, as do rows without an id.  No rows, no result.
    """
    return jaccard_join.representatives(docs, size=5, percent=80).select(*docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go.

    A null or empty text is hit by nothing and stays.  Items without an id, repeated items
    and short ones all count; without items every row stays.  Repeated rows stay or go together.
    """
    found = decontaminate.find_items(docs, load(spark, sf_dir, "benchmark"))
    return found.where(~decontaminate.is_contaminated()).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences.

    A null or empty text is one piece, its end id.  Every row is packed for itself, repeated
    rows and ids too.  No rows, no result.
    """
    vocabulary, ranks = (public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken"))
    return packing.pack(docs, vocabulary, ranks_path=ranks)


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_free),
    ("packing", packed),
]

#: Language ID, near duplicates and packing are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
