"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.llm import decontaminate, fingerprint, jaccard_join, language_id, license_scan, line_dedup, lm_score, merkle, packing, passages, periodic, quality, sql, warc
from weftline.session import load

QUERIES: dict = {}
ORACLES: dict = {}


def _query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


def fold(modulus: int):
    """The fold of a row: crc32 of its id as text; rows without an id are in fold 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus, F.lit(0))


@_query()
def op1_pack(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    vocabulary, ranks = (public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken"))
    return packing.pack(load(spark, folder, "documents"), vocabulary, ranks_path=ranks)


@_query()
def op2_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return lm_score.score(load(spark, folder, "documents"), fold(7) == 2)


@_query(sql.OP3)
def op3_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.linked(load(spark, folder, "documents"), size=3, percent=90)


@_query()
def op4_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passages.repeated(load(spark, folder, "documents"))


@_query(sql.OP5)
def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents")
    found = decontaminate.find_items(docs, load(spark, folder, "benchmark"), keep=["doc_id"])
    items = F.concat_ws(",", F.array_sort(F.transform("items", lambda i: i.cast("string"))))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(items, 256).alias("items_sha256"),
        decontaminate.is_contaminated().alias("contaminated"),
    )


@_query(sql.OP6)
def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = warc.write_archives(load(spark, folder, "pages"), warc.new_folder(spark))
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query()
def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.find_licenses(load(spark, folder, "documents"))


@_query(sql.OP8)
def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents").select("doc_id", "text")
    kept = line_dedup.drop_shared_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@_query()
def op9_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint.fingerprints(load(spark, folder, "documents"))


@_query()
def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents")
    model = language_id.train(docs, fold(3) != 1)
    held_out = (fold(3) == 1).alias("held_out")
    return language_id.identify(docs.select("doc_id", held_out, "text"), model, keep=["doc_id", "held_out"])


@_query(sql.OP12)
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    def leaf(n_chars):
        return merkle.row_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))

    docs = load(spark, folder, "documents")
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, leaf(F.col("n_chars") + 1))
    made = merkle.manifest(docs.withColumn("changed", changed), leaf(F.col("n_chars")), keep=["doc_id", "changed"])
    folded = merkle.fold(F.coalesce("changed", "leaf"), F.col("path"))
    made = made.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))


def planted_repeats(text, h):
    """``text``, or where ``h`` % 10 is 0 its words with the unit from word a on, of p words, over and over."""
    blanks = F.lit(" \t\n\u000b\f\r")
    g = F.floor(h / 10)

    def repeated(words):
        n = F.size(words)
        a = (g % n).cast("int")
        p = F.floor(1 + (n - a) / (3 + g % 8)).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p))), " ")

    words = F.split(F.btrim(text, blanks), r"[\x20\x09-\x0D]+")
    # by way of an array of one, so the words are split once a row
    tampered = F.get(F.transform(F.array(words), repeated), 0)
    return F.when((h % 10 == 0) & (F.btrim(text, blanks) != ""), tampered).otherwise(text)


@_query()
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents")
    docs = docs.select("doc_id", planted_repeats(F.col("text"), F.crc32(F.col("doc_id").cast("string"))).alias("text"))
    found = periodic.find_runs(docs, keep=["doc_id"])
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    found = found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    return found.withColumn("exponent_milli", F.expr("1000 * length div period")).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"
    )


@_query()
def op13_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents")
    model = quality.train(docs, load(spark, folder, "labels"), fold(5) != 0)
    held_out = (fold(5) == 0).alias("held_out")
    scored = quality.score(docs.select("doc_id", held_out, "text"), model, keep=["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
