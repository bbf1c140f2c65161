"""Reading files as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.sources.quoted import broken_lines, records

# Format by file extension, after any compression extension.
FORMATS = {".csv": "csv", ".tsv": "tsv", ".json": "json", ".jsonl": "json", ".ndjson": "json", ".parquet": "parquet"}
COMPRESSED = (".gz", ".bz2")
UNREADABLE = (".zst", ".zstd")


def detect_format(path: str) -> str:
    """The format a path's extension stands for; plain ``csv`` when unknown."""
    bare = path.lower().rstrip("/*")
    if bare.endswith(UNREADABLE):
        raise ValueError(f"zstd text cannot be read here, recompress as gz or bz2: {path}")
    for ext in COMPRESSED:
        bare = bare.removesuffix(ext)
    for ext, fmt in FORMATS.items():
        if bare.endswith(ext):
            return fmt
    return "csv"


def read(
    spark: SparkSession,
    path: str | Sequence[str],
    fmt: str | None = None,
    *,
    schema: str | T.StructType | None = None,
    header: bool | Sequence[str] | None = None,
    sep: str | None = None,
    regex: str | None = None,
    cols: Sequence[str] = (),
    recursive: bool = False,
    line_breaks: bool | None = None,
) -> DataFrame:
    """One table from a file, directory, glob or list of them.

    ``header``: True/False, a list of column names for files without one, or
    None to find out.  ``sep=" "`` means runs of blanks.  ``regex`` with
    ``cols`` turns unstructured lines into columns.  ``line_breaks`` says whether
    quoted fields of delimited text may hold line breaks, None to find out, which
    reads the text once more; such files are still read in splits.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if regex is not None:
        return read_regex(spark, paths, regex, cols, recursive=recursive)[0]
    if fmt is None:
        fmt = "csv" if sep is not None else detect_format(paths[0])
    elif any(p.lower().endswith(UNREADABLE) for p in paths) and fmt != "parquet":
        raise ValueError("zstd text cannot be read here, recompress as gz or bz2")
    base = spark.read
    if recursive:
        base = base.option("recursiveFileLookup", "true")
    if schema is not None:
        base = base.schema(schema)
    if fmt == "parquet":
        return base.parquet(*paths)
    if fmt == "json":
        return base.json(paths)
    if fmt not in ("csv", "tsv"):
        raise ValueError(f"unknown format {fmt!r}")
    if sep is None:
        sep = "\t" if fmt == "tsv" else ","
    if sep.isspace() and sep != "\t":
        return _read_blanks(spark, paths, header, schema, recursive)
    if line_breaks is None:
        line_breaks = broken_lines(spark, paths, recursive)
    if line_breaks:
        return _read_records(spark, paths, sep, header, schema, recursive)
    return _read_delimited(spark, paths, sep, header, schema, recursive)


def _names(count: int) -> list[str]:
    return [f"column{i}" for i in range(count)]


def _csv(spark: SparkSession, sep: str, recursive: bool):
    return (
        spark.read.option("sep", sep)
        .option("escape", '"')
        .option("recursiveFileLookup", str(recursive).lower())
        .option("timestampType", "timestamp_ntz")
        .option("inferTimestampNTZ", "true")
        .option("prefersDate", "true")
    )


def _read_delimited(spark, paths, sep, header, schema, recursive) -> DataFrame:
    reader = _csv(spark, sep, recursive)
    if schema is not None:
        return reader.schema(schema).option("header", str(header is None or header is True).lower()).csv(paths)
    if header is None:
        header = _has_header(spark, paths, sep, recursive)
    if header is True:
        return reader.option("header", "true").option("inferSchema", "true").csv(paths)
    out = reader.option("header", "false").option("inferSchema", "true").csv(paths)
    names = _names(len(out.columns)) if header is False else list(header)
    if len(names) != len(out.columns):
        raise ValueError(f"{len(names)} column names for {len(out.columns)} columns")
    return out.toDF(*names)


def _read_records(spark, paths, sep, header, schema, recursive) -> DataFrame:
    """Delimited text with line breaks in quoted fields."""
    rows, head = records(spark, paths, sep, recursive)
    reader = _csv(spark, sep, False).option("multiLine", "true")
    if schema is not None:
        reader = reader.schema(schema)
        header = header is None or header is True
    else:
        reader = reader.option("inferSchema", "true")
    if header is None:
        first = spark.createDataFrame([(head,)], "value string")
        rest = rows.where(F.col("value") != head)
        # where there is a header, these are the rows and types to read: found out once
        body = _parsed(spark, reader.option("header", "false"), rest) if head is not None else None
        header = head is not None and _is_header(spark, first, head, rest, sep, body.dtypes)
        if header and body.columns:
            reader = reader.schema(body.schema)
    names = list(header) if isinstance(header, (list, tuple)) else None
    if header is True and head is not None:
        # every file repeats it
        rows = rows.where(F.col("value") != head)
        if schema is None:
            titles = _csv(spark, sep, False).option("multiLine", "true").option("header", "true")
            names = _parsed(spark, titles, spark.createDataFrame([(head,)], "value string")).columns
    out = _parsed(spark, reader.option("header", "false"), rows)
    if schema is not None:
        return out
    names = names or _names(len(out.columns))
    if len(names) != len(out.columns):
        raise ValueError(f"{len(names)} column names for {len(out.columns)} columns")
    return out.toDF(*names)


def _parsed(spark, reader, lines: DataFrame) -> DataFrame:
    texts = getattr(lines._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(reader._jreader.csv(texts), spark)


def _has_header(spark, paths, sep, recursive) -> bool:
    """True unless the first line fits the types of all lines after it."""
    lines = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(paths)
    head = lines.head()
    if head is None:
        return False
    # files of one directory repeat the header; it says nothing about the types
    return _is_header(spark, lines.limit(1), head[0], lines.where(F.col("value") != head[0]), sep)


def _is_header(spark, first: DataFrame, head: str, rest: DataFrame, sep: str, body: list | None = None) -> bool:
    reader = _csv(spark, sep, False).option("inferSchema", "true")
    top = _infer(reader, spark, first)
    if rest.isEmpty():
        return all(kind == "string" for _, kind in top)
    body = body or _infer(reader, spark, rest)
    if len(body) != len(top):
        return False
    typed = [(a, b) for (_, a), (_, b) in zip(top, body)]
    if any(b != "string" and a == "string" for a, b in typed):
        return True
    if any(b != "string" for _, b in typed):
        return False
    # all text: a header repeats nowhere below and its names differ
    names = [v.strip().strip('"') for v in head.split(sep)]
    if len(set(names)) < len(names) or not all(re.fullmatch(r"[A-Za-z_][\w ]*", n) for n in names):
        return False
    cells = F.split("value", re.escape(sep))
    bare = F.transform(cells, lambda v: F.regexp_replace(F.regexp_replace(v, r"^\s+|\s+$", ""), '^"+|"+$', ""))
    return rest.where(F.arrays_overlap(bare, F.array(*[F.lit(n) for n in names]))).isEmpty()


def _infer(reader, spark, lines: DataFrame) -> list[tuple[str, str]]:
    return _parsed(spark, reader.option("header", "false"), lines).dtypes


def _read_blanks(spark, paths, header, schema, recursive=False) -> DataFrame:
    lines = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(paths).where(F.trim("value") != "")
    parts = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    first = lines.select(parts.alias("p")).head()
    if first is None:
        raise ValueError("no lines to read")
    count = len(first["p"])
    if header is None:
        header = all(not re.fullmatch(r"[+-]?\d+(\.\d+)?", v) for v in first["p"])
    if header is True:
        names = list(first["p"])
        lines = lines.where(~(parts == F.array(*[F.lit(v) for v in names])))
    elif header is False:
        names = _names(count)
    else:
        names = list(header)
        if len(names) != count:
            raise ValueError(f"{len(names)} column names for {count} columns")
    most = lines.agg(F.max(F.size(parts))).head()[0] or 0
    if most > count:
        raise ValueError(f"a line has {most} fields, the first line {count}")
    cut = lines.select(parts.alias("p")).select(*[F.get("p", F.lit(i)).alias(n) for i, n in enumerate(names)])
    if schema is not None:
        kinds = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        return cut.select(*[F.col(quote_name(n)).try_cast(f.dataType).alias(f.name) for n, f in zip(names, kinds.fields)])
    return _narrow(cut)


def quote_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _narrow(df: DataFrame) -> DataFrame:
    """Text columns to bigint or double where every value converts."""
    kinds = ("bigint", "double")
    cells = []
    for i, c in enumerate(df.columns):
        x = F.col(quote_name(c))
        cells.append(F.count(x).alias(f"n{i}"))
        cells += [F.count(x.try_cast(k)).alias(f"{k}{i}") for k in kinds]
    row = df.agg(*cells).head()
    out = []
    for i, c in enumerate(df.columns):
        fits = [k for k in kinds if row[f"n{i}"] and row[f"{k}{i}"] == row[f"n{i}"]]
        x = F.col(quote_name(c))
        out.append(x.cast(fits[0]).alias(c) if fits else x)
    return df.select(*out)


def group_count(pattern: str) -> int:
    """Number of capture groups of a Java-style pattern."""
    return len(re.findall(r"(?<!\\)(?:\\\\)*\((?!\?)|\(\?<[A-Za-z]", re.sub(r"\[(?:\\.|[^\]])*\]", "", pattern)))


def read_regex(
    spark: SparkSession, path: str | Sequence[str], regex: str, cols: Sequence[str], *, recursive: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(table, rejects): one column per capture group, and (matched, rejected)
    line counts.  Lines that do not match are counted, not kept."""
    lines = spark.read.option("recursiveFileLookup", str(recursive).lower()).text([path] if isinstance(path, str) else list(path))
    return parse_regex(lines, "value", regex, cols)


def parse_regex(df: DataFrame, line: str, regex: str, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    cols = list(cols)
    groups = group_count(regex)
    if groups != len(cols):
        raise ValueError(f"the pattern has {groups} groups for {len(cols)} column names")
    hit = F.col(line).rlike(regex)
    table = df.where(hit).select(*[F.regexp_extract(line, regex, i + 1).alias(c) for i, c in enumerate(cols)])
    rejects = df.agg(
        F.count_if(hit).alias("matched"), F.count_if(F.coalesce(~hit, F.lit(True))).alias("rejected")
    )
    return table, rejects
