"""Imports and exports.  Inputs are files that Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.registry import register, register_sql
from weftline import Workspace
from weftline.session import load, load_views, scratch_path
from weftline.sources.readers import read, read_regex
from weftline.sources.writers import export


def _workspace(spark) -> Workspace:
    return Workspace(spark, scratch_path(spark, "tables"))


@register("src01_csv_import", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def src01(spark, folder):
    path = export(load(spark, folder, "part"), scratch_path(spark, "csv"))
    ws = _workspace(spark)
    ws.into("part_csv", path, "csv")
    return ws.table("part_csv").selectExpr(
        "cast(p_partkey AS BIGINT) AS p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"
    )


@register(
    "src02_headerless",
    "SELECT o_orderkey AS column0, o_orderstatus AS column1, o_totalprice AS column2, o_orderdate AS column3 FROM orders",
)
def src02(spark, folder):
    path = scratch_path(spark, "bare")
    load(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate").write.option(
        "header", "false"
    ).csv(path)
    out = read(spark, path, "csv")
    return out.withColumn("column0", F.col("column0").cast("bigint"))


@register("src03_tsv", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def src03(spark, folder):
    path = scratch_path(spark, "tsv")
    load(spark, folder, "supplier").write.option("header", "true").option("sep", "\t").csv(path)
    return read(spark, path, "tsv").withColumn("s_suppkey", F.col("s_suppkey").cast("bigint"))


@register(
    "src01_quoted_breaks",
    """SELECT how, doc_id, text, lang, source, n_chars FROM documents, (VALUES ('csv'), ('tsv')) AS h(how)""",
)
def src01_breaks(spark, folder):
    """Whole texts, line breaks and all, written as delimited text and read again."""
    documents = load(spark, folder, "documents")
    path = export(documents, scratch_path(spark, "texts"))
    ws = _workspace(spark)
    ws.into("texts_csv", path, "csv")
    tabbed = scratch_path(spark, "tabbed")
    documents.write.option("header", "true").option("sep", "\t").option("escape", '"').option("ignoreLeadingWhiteSpace", "false").option(
        "ignoreTrailingWhiteSpace", "false"
    ).csv(tabbed)
    both = [ws.table("texts_csv").withColumn("how", F.lit("csv")), read(spark, tabbed, "tsv").withColumn("how", F.lit("tsv"))]
    wide = [t.selectExpr("how", "cast(doc_id AS BIGINT) AS doc_id", "text", "lang", "source", "cast(n_chars AS BIGINT) AS n_chars") for t in both]
    return wide[0].unionByName(wide[1])


@register(
    "src04_separator_names",
    """SELECT 'pipe' AS how, l_orderkey AS a, cast(l_linenumber AS BIGINT) AS b, l_quantity AS c FROM lineitem
       UNION ALL SELECT 'blanks', l_orderkey, l_linenumber, l_quantity FROM lineitem""",
)
def src04(spark, folder):
    lines = load(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    piped, spaced = scratch_path(spark, "pipe"), scratch_path(spark, "blanks")
    lines.write.option("sep", "|").csv(piped)
    blank = F.format_string("%8d   %d %10.1f ", "l_orderkey", "l_linenumber", "l_quantity")
    lines.select(blank.alias("value")).write.text(spaced)
    names = ["a", "b", "c"]
    pipe = read(spark, piped, sep="|", header=names).select(F.lit("pipe").alias("how"), *names)
    blanks = read(spark, spaced, sep=" ", header=names).select(F.lit("blanks").alias("how"), *names)
    kinds = ["how", "cast(a AS BIGINT) AS a", "cast(b AS BIGINT) AS b", "cast(c AS DOUBLE) AS c"]
    return pipe.selectExpr(*kinds).union(blanks.selectExpr(*kinds))


@register(
    "src05_json_lines",
    """SELECT event_id, event_type, user_id AS uid, CASE WHEN event_id % 3 = 0 THEN value END AS v,
              cast(event_id % 5 + 1 AS BIGINT) AS parts FROM events""",
)
def src05(spark, folder):
    path = scratch_path(spark, "json")
    load(spark, folder, "events").select(
        "event_id",
        "event_type",
        F.struct(F.col("user_id").alias("id")).alias("user"),
        F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("value"),
        F.sequence(F.lit(0), (F.col("event_id") % 5).cast("int")).alias("parts"),
    ).write.json(path)
    return read(spark, path, "json").select(
        "event_id", "event_type", F.col("user.id").alias("uid"), F.col("value").alias("v"),
        F.size("parts").cast("bigint").alias("parts"),
    )


@register(
    "src06_regex",
    """SELECT cast(user_id AS VARCHAR) AS uid, event_type AS kind, count(*) AS n, (SELECT count(*) FROM events WHERE event_type = 'view') AS rejected
       FROM events WHERE event_type <> 'view' GROUP BY 1, 2""",
)
def src06(spark, folder):
    path = scratch_path(spark, "log")
    shown = F.when(F.col("event_type") == "view", F.concat(F.lit("noise "), "event_id")).otherwise(
        F.concat(F.lit("user="), "user_id", F.lit(" did <"), "event_type", F.lit("> at "), F.col("ts").cast("string"))
    )
    load(spark, folder, "events").select(shown.alias("value")).write.text(path)
    table, rejects = read_regex(spark, path, r"user=(\d+) did <(\w+)>", ["uid", "kind"])
    lost = rejects.head()["rejected"]
    return table.groupBy("uid", "kind").agg(F.count(F.lit(1)).alias("n")).withColumn("rejected", F.lit(lost))


@register("src07_parquet", "SELECT * FROM supplier")
def src07(spark, folder):
    ws = _workspace(spark)
    ws.into("supplier_copy", f"{folder}/supplier.parquet")
    return ws.table("supplier_copy")


@register(
    "src08_auto_format",
    """SELECT fmt, n_nationkey, n_name FROM nation, (VALUES ('csv'), ('tsv'), ('jsonl'), ('parquet')) AS f(fmt)""",
)
def src08(spark, folder):
    nation = load(spark, folder, "nation").select("n_nationkey", "n_name")
    base = scratch_path(spark, "auto")
    nation.write.option("header", "true").csv(f"{base}/nation.csv")
    nation.write.option("header", "true").option("sep", "\t").csv(f"{base}/nation.tsv")
    nation.write.json(f"{base}/nation.jsonl")
    nation.write.parquet(f"{base}/nation.parquet")
    out = None
    for fmt in ("csv", "tsv", "jsonl", "parquet"):
        part = read(spark, f"{base}/nation.{fmt}").select(
            F.lit(fmt).alias("fmt"), F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name"
        )
        out = part if out is None else out.union(part)
    return out


@register(
    "src09_compressed",
    """SELECT codec, c_custkey, c_acctbal FROM customer, (VALUES ('gz'), ('bz2')) AS f(codec)""",
)
def src09(spark, folder):
    customer = load(spark, folder, "customer").select("c_custkey", "c_acctbal")
    out = None
    for codec, suffix in (("gzip", "gz"), ("bzip2", "bz2")):
        path = export(customer, scratch_path(spark, suffix), compression=codec)
        part = read(spark, f"{path}/*.csv.{suffix}").select(
            F.lit(suffix).alias("codec"), F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_acctbal"
        )
        out = part if out is None else out.union(part)
    return out


@register(
    "src10_directory_glob",
    """SELECT 'tree' AS how, count(*) AS n, cast(sum(o_orderkey) AS BIGINT) AS keys FROM orders
       UNION ALL SELECT 'glob', count(*), cast(sum(o_orderkey) AS BIGINT) FROM orders WHERE o_orderstatus IN ('F', 'O')""",
)
def src10(spark, folder):
    base = scratch_path(spark, "split")
    load(spark, folder, "orders").write.partitionBy("o_orderstatus").parquet(base)
    whole = read(spark, base, "parquet", recursive=True)
    some = read(spark, f"{base}/o_orderstatus=[FO]/*.parquet")
    size = [F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys")]
    return whole.agg(*size).select(F.lit("tree").alias("how"), "n", "keys").union(
        some.agg(*size).select(F.lit("glob"), "n", "keys")
    )


register_sql(
    "src11_values",
    "events",
    """SELECT v.label, count(*) AS n, max(e.value) AS top
       FROM (VALUES ('click', 'pointer'), ('view', 'eyes'), ('error', 'pain')) AS v(kind, label)
       JOIN events e ON e.event_type = v.kind GROUP BY v.label""",
)


@register(
    "src12_into_many",
    """SELECT 'kinds' AS part, event_type AS label, count(*) AS n FROM events GROUP BY event_type
       UNION ALL SELECT 'users', cast(user_id AS VARCHAR), count(*) FROM events GROUP BY user_id""",
)
def src12(spark, folder):
    events = load(spark, folder, "events")
    count = F.count(F.lit(1)).alias("n")
    ws = _workspace(spark)
    ws.into_many(
        "weftline_log.",
        {
            "kinds": events.groupBy(F.col("event_type").alias("label")).agg(count),
            "users": events.groupBy(F.col("user_id").cast("string").alias("label")).agg(count),
        },
    )
    return spark.sql(
        """SELECT 'kinds' AS part, label, n FROM weftline_log.kinds
           UNION ALL SELECT 'users', label, n FROM weftline_log.users"""
    )


# --- sinks --------------------------------------------------------------------------


@register(
    "snk01_create_table_as",
    "SELECT c_mktsegment, count(*) AS n, max(c_acctbal) AS top FROM customer GROUP BY c_mktsegment",
)
def snk01(spark, folder):
    ws = _workspace(spark)
    load_views(spark, folder, "customer")
    query = "SELECT c_mktsegment, count(*) AS n, max(c_acctbal) AS top FROM customer GROUP BY c_mktsegment"
    ws.sql("CREATE OR REPLACE TABLE weftline_segments AS SELECT 1 AS stale")
    return ws.sql(f"CREATE OR REPLACE TABLE weftline_segments AS {query}")


@register("snk02_named_view", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 250000 GROUP BY 1")
def snk02(spark, folder):
    ws = Workspace(spark)
    load_views(spark, folder, "orders")
    ws.sql("SELECT * FROM orders WHERE o_totalprice > 250000", name="big_orders")
    return ws.sql("SELECT o_orderstatus, count(*) AS n FROM big_orders GROUP BY 1", name="big_by_status")


@register(
    "snk03_insert_select",
    """SELECT s_nationkey AS nation, count(*) AS n FROM (
         SELECT s_nationkey FROM supplier UNION ALL SELECT c_nationkey FROM customer) x GROUP BY 1""",
)
def snk03(spark, folder):
    ws = _workspace(spark)
    load_views(spark, folder, "supplier", "customer")
    ws.sql("CREATE OR REPLACE TABLE weftline_parties AS SELECT s_nationkey AS nation FROM supplier")
    ws.sql("INSERT INTO weftline_parties SELECT c_nationkey FROM customer")
    return ws.sql("SELECT nation, count(*) AS n FROM weftline_parties GROUP BY nation")


@register(
    "snk04_export",
    """SELECT fmt, o_orderkey, o_totalprice, o_orderpriority FROM orders, (VALUES ('csv'), ('jsonl'), ('parquet')) AS f(fmt)""",
)
def snk04(spark, folder):
    ws = Workspace(spark)
    load_views(spark, folder, "orders")
    ws.sql("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders", name="priced")
    out = None
    for fmt, kind in (("csv", "csv"), ("jsonl", "json"), ("parquet", "parquet")):
        path = ws.export("priced", scratch_path(spark, "export"), fmt)
        back = read(spark, path, kind, header=True).select(
            F.lit(fmt).alias("fmt"), F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "o_totalprice", "o_orderpriority"
        )
        out = back if out is None else out.union(back)
    return out
