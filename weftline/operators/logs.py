"""Log template mining: masks, skeletons, and merging by group statistics.

Nothing depends on arrival order: lines are reduced to skeleton counts, and
skeletons of equal token count and first token merge on the positions where
they take more than ``distinct_limit`` different tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.plans.ordered import rank_rows
from weftline.session import durable, spread

# What counts as a variable token, tried in this order.
MASKS = (
    ("<quoted>", r'"[^"]*"|\'[^\']*\''),
    ("<uuid>", r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"),
    ("<ip>", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?::\d+)?\b"),
    ("<path>", r"(?<![\w<])/[\w.\-]+(?:/[\w.\-]*)*"),
    ("<hex>", r"\b0[xX][0-9a-fA-F]+\b"),
    ("<num>", r"(?<![\w<])[+-]?\d+(?:[.:,\-]\d+)*(?![\w>])"),
)
WILDCARD = "<*>"
_ANY_MASK = "|".join(f"(?:{pattern})" for _, pattern in MASKS)


# A character each mask cannot do without, as a pattern.
_NEEDS = {"<quoted>": "[\"']", "<uuid>": "-", "<ip>": "[0-9]", "<path>": "/", "<hex>": "[0-9]", "<num>": "[0-9]"}


def with_skeleton(df: DataFrame, line: str, name: str = "skeleton") -> DataFrame:
    """Adds the line with its variable tokens masked and blanks collapsed.

    A mask only runs on lines that hold a character it needs.  The steps are
    separate projections, since each one uses the one before twice.
    """
    out = spread(df).withColumn(name, F.col(line))
    for mask, pattern in MASKS:
        hit = F.regexp_replace(F.col(name), pattern, mask)
        out = out.withColumn(name, F.when(F.col(line).rlike(_NEEDS[mask]), hit).otherwise(F.col(name)))
    return out.withColumn(name, F.trim(F.regexp_replace(F.col(name), r"\s+", " ")))


def _shape(skel: str = "skeleton") -> list[Column]:
    tokens = F.split(F.col(skel), " ")
    return [F.size(tokens).alias("_len"), tokens[0].alias("_first")]


# Shapes of more skeletons than this are compared token by token across tasks, so that
# no task holds one; the others whole, where one shuffle of the skeletons is all it takes.
HOT_SHAPE = 100_000
# Templates from which on they are numbered by a distributed sort: rows are whole lines.
SORTED_ROWS = 100_000


def _wildcards(skeletons: DataFrame, distinct_limit: int, hot_shape: int | None = None) -> DataFrame:
    """(_len, _first, _wild): the positions to blank out in each shape.

    A position takes at most as many tokens as its shape has skeletons, so shapes of few
    skeletons are not looked at.
    """
    hot = HOT_SHAPE if hot_shape is None else hot_shape
    shape = ["_len", "_first"]
    sizes = skeletons.groupBy(*shape).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > distinct_limit)
    # merge: shuffled by shape, so that the groupings below need no shuffle of their own
    some = skeletons.select(*shape, "skeleton").hint("merge").join(sizes.where(F.col("_size") <= hot).select(*shape), shape)
    # fewer than skeletons / hot_shape
    many = skeletons.select(*shape, "skeleton").join(F.broadcast(sizes.where(F.col("_size") > hot).select(*shape)), shape)

    def wild(rows: DataFrame) -> DataFrame:
        tokens = rows.select(*shape, F.posexplode(F.split(F.col("skeleton"), " ")).alias("_at", "_token")).where("_at > 0")
        spread = tokens.groupBy(*shape, "_at").agg(F.count_distinct("_token").alias("_d"))
        # at most as many positions per shape as a line has tokens
        return spread.where(F.col("_d") > distinct_limit).groupBy(*shape).agg(F.collect_set("_at").alias("_wild"))

    return wild(some).unionByName(wild(many))


def _pattern() -> Column:
    tokens = F.split(F.col("skeleton"), " ")
    blanked = F.transform(
        tokens, lambda t, i: F.when(F.array_contains(F.col("_wild"), i), F.lit(WILDCARD)).otherwise(t)
    )
    return F.when(F.col("_wild").isNull(), F.col("skeleton")).otherwise(F.array_join(blanked, " "))


def _skeleton_counts(df: DataFrame, line: str) -> DataFrame:
    """(skeleton, n, example, shape): the one pass over the lines.

    Written out, because merging reads it twice and masking is the dear part.
    """
    lines = df.where(F.col(line).isNotNull()).select(F.col(line).alias("_line"))
    counted = (
        with_skeleton(lines, "_line")
        .groupBy("skeleton")
        .agg(F.count(F.lit(1)).alias("n"), F.min("_line").alias("example"))
    )
    return durable(counted.select("*", *_shape()))


def _merged(skeletons: DataFrame, distinct_limit: int) -> DataFrame:
    wild = _wildcards(skeletons, distinct_limit)
    joined = skeletons.join(wild, ["_len", "_first"], "left")
    return joined.select("skeleton", _pattern().alias("pattern"), "n", "example")


def _numbered(mapping: DataFrame, rows: int, hot_rows: int | None = None) -> DataFrame:
    """``rows``: of the mapping, which are at least as many as there are templates."""
    merged = mapping.groupBy("pattern").agg(F.sum("n").alias("count"), F.min("example").alias("example"))
    hot_rows = SORTED_ROWS if hot_rows is None else hot_rows
    numbered = rank_rows(merged, [F.desc("count"), F.asc("pattern")], "template_id", hot_rows, rows)
    return numbered.select("template_id", "pattern", "count", "example")


def template_map(df: DataFrame, line: str, distinct_limit: int = 8) -> DataFrame:
    """(skeleton, pattern, n, example) for every distinct skeleton."""
    return _merged(_skeleton_counts(df, line), distinct_limit)


def log_templates(df: DataFrame, line: str, distinct_limit: int = 8, *, hot_rows: int | None = None) -> DataFrame:
    """(template_id, pattern, count, example), ids by count desc then pattern."""
    skeletons = _skeleton_counts(df, line)
    return _numbered(_merged(skeletons, distinct_limit), skeletons.count(), hot_rows)


def log_records(
    df: DataFrame, line: str, templates: DataFrame | None = None, distinct_limit: int = 8, *, hot_rows: int | None = None
) -> DataFrame:
    """Every line with its ``template_id`` and the masked values it carried.

    ``templates`` is the result of ``log_templates`` over the same lines; tokens
    blanked by merging are part of ``values`` too, in line order.
    """
    skeletons = _skeleton_counts(df, line)
    mapping = _merged(skeletons, distinct_limit)
    ids = (templates if templates is not None else _numbered(mapping, skeletons.count(), hot_rows)).select("template_id", "pattern")
    keyed = mapping.select("skeleton", "pattern").join(ids, "pattern")
    masked = with_skeleton(df.where(F.col(line).isNotNull()), line)
    joined = masked.join(keyed, "skeleton")

    # tokens of the raw line, a masked value staying one token; possessive, as a greedy
    # group would recurse once per character of a token
    raw = F.regexp_extract_all(F.col(line), F.lit(rf"((?:{_ANY_MASK}|\S)++)"), F.lit(1))
    pattern = F.split(F.col("pattern"), " ")
    variable = F.transform(
        raw,
        lambda t, i: F.when(F.get(pattern, i) == WILDCARD, F.array(t)).otherwise(
            F.when(F.get(pattern, i).contains("<"), F.regexp_extract_all(t, F.lit(f"({_ANY_MASK})"), F.lit(1)))
            .otherwise(F.array().cast("array<string>"))
        ),
    )
    return joined.select(*df.columns, "template_id", F.flatten(variable).alias("values"))
