"""The lineage graph as two DataFrames, and operators over it.

nodes(name, kind, status, command, ...) and edges(child, parent).  A small
graph is walked in one task.  A large one is made smaller first, chains and twigs
left out round by round; what remains large is walked in rounds: a join of the
frontier with the edges, less what was seen, and edges that get longer round by
round.  Each round is written to the shared folder, so the plan stays short and a
lost executor costs one round at most; a small round stays a local relation instead.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import durable, settle, settle_large, spread

_PART = r"(?:\"[^\"]+\"|`[^`]+`|[A-Za-z_]\w*)"
# atomic: once a whole name is read it is not shortened to please what follows
_IDENT = rf"(?>{_PART}(?:\.{_PART})*)"


# --- query texts ---------------------------------------------------------------


# one left-to-right reading: a quote in a comment opens nothing, dashes in a literal neither;
# possessive throughout, so that no text is too long
_QUIET = (
    r"(')[^']*+(?:''[^']*+)*+(')"  # a literal
    r"|(\"[^\"]*+\"|`[^`]*+`)"  # a quoted name
    r"|--[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/"
)
# FROM that names no table: in a function's arguments, and in IS DISTINCT FROM
_ARGUMENT_FROM = r"(?i)\b(extract|trim|substring|overlay|position)\s*+\(([^()]*?)\bfrom\b"
_DISTINCT_FROM = r"(?i)\bdistinct\s++from\b"


def _bare(sql: Column) -> Column:
    """The text without the contents of literals and comments, blanks collapsed, and
    without FROM where it names no table."""
    out = F.regexp_replace(sql, _QUIET, "$1$2$3\u0001")
    out = F.regexp_replace(out, "(?<=['\"`])\u0001", "")
    out = F.translate(out, "\u0001", " ")
    out = F.regexp_replace(F.regexp_replace(out, _ARGUMENT_FROM, "$1($2,"), _DISTINCT_FROM, "distinct")
    return F.trim(F.regexp_replace(out, r"\s++", " "))


def _unquoted(name: Column) -> Column:
    return F.regexp_replace(name, "[\"`]", "")


# words that end a FROM list; what follows a comma after them is no table
_STOP = (
    "where", "group", "order", "having", "limit", "union", "intersect", "except", "qualify", "window",
    "on", "using", "select", "set", "values", "returning",
)


def table_refs(queries: DataFrame, id: str, sql: str) -> DataFrame:
    """(id, ref): the distinct tables each query text refers to.

    Covers FROM, every JOIN, comma lists, sub-queries, set operations and the
    target of INSERT.  Names a WITH clause defines and table functions are left
    out.  This reads text with regular expressions; for a single statement the
    workspace asks Spark's own parser instead.
    """
    text = spread(queries.select(F.col(id).alias("id"), F.col(sql).alias("t"))).select("id", _bare(F.col("t")).alias("t"))
    # a table position: after FROM / JOIN / INTO, or after a comma within a FROM list
    starts = F.regexp_extract_all(
        "t", F.lit(rf"(?i)\b(?:from|join|insert into|insert overwrite(?: table)?)\s+\(*\s*({_IDENT})(?!\s*\()"), F.lit(1)
    )
    stop = "|".join(_STOP)
    lists = F.regexp_extract_all("t", F.lit(rf"(?i)\bfrom\s+((?:(?!\b(?:{stop})\b)[^()]|\([^()]*+\))*+)"), F.lit(1))
    items = F.flatten(F.transform(lists, lambda part: F.slice(F.split(part, ","), F.lit(2), F.size(F.split(part, ",")) - 1)))
    after_comma = F.filter(
        F.transform(items, lambda item: F.regexp_extract(item, rf"^\s*({_IDENT})(?!\s*\()", 1)),
        lambda name: name != "",
    )
    # WITH a AS (...), b AS (...): every "name AS (" or "name (cols) AS (" outside CAST
    defined = F.transform(
        F.regexp_extract_all(
            "t", F.lit(rf"(?i)(?:\bwith\s+(?:recursive\s+)?|\)\s*,\s*)({_IDENT})\s*(?:\([^()]*\)\s*)?as\s+(?:(?:not\s+)?materialized\s+)?\("), F.lit(1)
        ),
        lambda name: F.lower(_unquoted(name)),
    )
    # one row per reference before the WITH names are taken out: inside a lambda
    # the list of names would be extracted again for every reference
    each = text.select(
        "id",
        F.when(F.col("t").rlike(r"(?i)\bwith\b"), defined).alias("_defined"),
        F.explode(F.array_distinct(F.concat(starts, after_comma))).alias("_ref"),
    )
    named = each.select("id", "_defined", _unquoted(F.col("_ref")).alias("ref"))
    is_table = ~F.lower("ref").isin("select", "values", "lateral", "unnest", "table")
    shown = F.coalesce(~F.array_contains("_defined", F.lower("ref")), F.lit(True))
    return named.where(is_table & shown).select(F.col("id").alias(id), "ref").distinct()


def created_table(queries: DataFrame, id: str, sql: str) -> DataFrame:
    """(id, created): the table a CREATE [OR REPLACE] TABLE [IF NOT EXISTS] makes."""
    name = F.regexp_extract(
        _bare(F.col(sql)),
        rf"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?table\s+(?:if\s+not\s+exists\s+)?({_IDENT})",
        1,
    )
    return queries.select(F.col(id), _unquoted(name).alias("created")).where("created != ''")


def unknown_refs(refs: DataFrame, known: DataFrame, ref: str = "ref", name: str = "name") -> DataFrame:
    """The rows of ``refs`` whose table is not among ``known``, ignoring case."""
    names = known.select(F.lower(F.col(name)).alias("_known")).distinct()
    return refs.join(names, F.lower(F.col(ref)) == F.col("_known"), "left_anti")


# --- walks ----------------------------------------------------------------------


PLAIN_ROUNDS = 3
# Rows that carry paths are long, so fewer of them come to the driver.
SMALL_PATHS = 5_000


def _kept(df: DataFrame, count: int | None) -> DataFrame:
    """A settled ``df`` in a join: a large one, for which Spark may still have the size of
    the table it comes from, is not broadcast."""
    return df.hint("merge") if count is None else df


def _pointers(step: DataFrame) -> DataFrame:
    """(_side, _node, _next, _steps): the only way into a node (side 0) and the
    only way out of one (side 1), where there is just one."""
    nearest = F.min("_steps").alias("_steps")
    inward = step.groupBy(F.col("_to").alias("_node")).agg(F.min("_from").alias("_next"), F.max("_from").alias("_last"), nearest)
    outward = step.groupBy(F.col("_from").alias("_node")).agg(F.min("_to").alias("_next"), F.max("_to").alias("_last"), nearest)
    both = inward.withColumn("_side", F.lit(0)).unionByName(outward.withColumn("_side", F.lit(1)))
    return both.where("_next = _last and _next != _node").select("_side", "_node", "_next", "_steps")


def _doubled(pointers: DataFrame, many: int | None) -> DataFrame:
    """Pointers twice as far, where the way goes on."""
    far = pointers.select("_side", F.col("_node").alias("_next"), F.col("_next").alias("_far"), F.col("_steps").alias("_more"))
    return pointers.join(_kept(far, many), ["_side", "_next"]).select(
        "_side", "_node", F.col("_far").alias("_next"), (F.col("_steps") + F.col("_more")).alias("_steps")
    )


def _shortcuts(pointers: DataFrame) -> DataFrame:
    """Pointers as edges of the walk: (_from, _to, _steps)."""
    into = F.col("_side") == 0
    return pointers.select(
        F.when(into, F.col("_next")).otherwise(F.col("_node")).alias("_from"),
        F.when(into, F.col("_node")).otherwise(F.col("_next")).alias("_to"),
        "_steps",
    )


# A round that leaves out fewer than one in so many edges of a large graph is the last.
LEAST_SHARE = 12


def _contracted(step: DataFrame, roots: Sequence) -> tuple[DataFrame, int | None, list[DataFrame]]:
    """``step``, large, without most of its chains, twigs and dead ends, and how many edges
    that is (None for many); also what each round left out, (_node, _in, _steps): a node,
    the only one before it and the way from there.

    A node with one way in and one out becomes an edge past it, one with one way in and
    none out goes with its edge; of two neighbours only that of the lesser hash, so the
    node before stays for the round.  What only nodes with no way in lead to is not
    reached.  Each round writes what is left, so all rounds write in proportion to the graph.
    """
    kind = dict(step.dtypes)["_from"]
    roots = [r for r in roots if r is not None]
    none, fixed = F.lit(None).cast(kind), lambda c: F.col(c).isin(roots) if roots else F.lit(False)
    # a way into a root or from a node to itself shortens none
    step, known = durable(step.where((F.col("_from") != F.col("_to")) & ~fixed("_to")).distinct()), None
    many, gone = step.count(), []
    one_in, one_out = F.col("_in") == F.col("_in2"), F.col("_out") == F.col("_out2")
    while known is None:
        ends = step.select(F.inline(F.array(
            F.struct(F.col("_to").alias("_node"), F.col("_from").alias("_in"), none.alias("_out"), "_steps"),
            F.struct(F.col("_from").alias("_node"), none.alias("_in"), F.col("_to").alias("_out"), "_steps"),
        )))
        each = ends.groupBy("_node").agg(
            F.min("_in").alias("_in"), F.max("_in").alias("_in2"), F.min(F.expr("if(_in is null, null, _steps)")).alias("_steps"),
            F.min("_out").alias("_out"), F.max("_out").alias("_out2"), F.min(F.expr("if(_out is null, null, _steps)")).alias("_more"),
        )
        rank = lambda c: F.xxhash64(c, F.lit(len(gone)))
        less = lambda c: rank("_node") < rank(c)
        inner = one_in & one_out & less("_in") & less("_out")
        twig = one_in & F.col("_out").isNull() & less("_in")
        unmet = F.col("_in").isNull() & one_out
        out = durable(each.where((inner | twig | unmet) & ~fixed("_node")).select("_node", "_in", "_steps", "_out", "_more"))
        left_out = out.count()
        if left_out * LEAST_SHARE < many:
            break
        many -= left_out
        gone.append(out.where("_in is not null").select("_node", "_in", "_steps"))
        # zero steps: the edge is gone
        zero = F.lit(0).cast("long").alias("_steps")
        edits = out.select(F.inline(F.array(
            F.struct(F.col("_in").alias("_from"), F.col("_node").alias("_to"), zero),
            F.struct(F.col("_node").alias("_from"), F.col("_out").alias("_to"), zero),
            F.struct(F.col("_in").alias("_from"), F.col("_out").alias("_to"), (F.col("_steps") + F.col("_more")).alias("_steps")),
        )))
        now = step.union(edits.where("_from != _to")).groupBy("_from", "_to").agg(F.min("_steps").alias("_steps"))
        step, known = settle_large(now.where("_steps > 0"))
    return step, known, gone


def _expanded(seen: DataFrame, gone: list[DataFrame]) -> DataFrame:
    """``seen`` (node, depth) and the nodes left out that it leads to."""
    seen, count = settle_large(seen)
    for rounds, out in enumerate(reversed(gone), 1):
        back = out.hint("merge").join(_kept(seen, count), F.col("_in") == F.col("node"))
        met, count = settle_large(back.select(F.col("_node").alias("node"), (F.col("depth") + F.col("_steps")).alias("depth")))
        seen, count = seen.union(met), None
        if rounds % 8 == 0:
            seen, count = settle_large(seen)
    return seen


# Kinds of nodes whose equal values are equal in every language.
_NAMES = ("string", "binary", "tinyint", "smallint", "int", "bigint", "date")


def _least_depths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, depth) of edges (_from, _to, _steps) that all are in one task; a null _from
    marks a root."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    edges = pa.Table.from_batches(batches)
    ends = pa.chunked_array(edges["_from"].chunks + edges["_to"].chunks).combine_chunks().dictionary_encode()
    code = ends.indices.fill_null(-1).to_numpy().astype(np.int64)
    begin, end, steps = code[: edges.num_rows], code[edges.num_rows :], edges["_steps"].to_numpy()
    order = np.argsort(begin, kind="stable")
    first = np.searchsorted(begin[order], np.arange(len(ends.dictionary) + 1)).tolist()
    end, steps = end[order].tolist(), steps[order].tolist()
    depth: dict[int, int] = {}
    ahead = [(0, root) for root in end[: first[0]]]
    while ahead:
        far, node = heappop(ahead)
        if node not in depth:
            depth[node] = far
            for at in range(first[node], first[node + 1]):
                if end[at] not in depth:
                    heappush(ahead, (far + steps[at], end[at]))
    yield pa.RecordBatch.from_arrays(
        [ends.dictionary.take(pa.array(list(depth), pa.int64())), pa.array(depth.values(), pa.int64())], names=["node", "depth"]
    )


def _closure(edges: DataFrame, roots: Sequence, source: str, target: str) -> DataFrame:
    """(node, depth) of all that the roots lead to, at its least depth.

    A small graph is walked in one task.  On a large one the first rounds take one
    generation each; if they do not exhaust it, chains, twigs and dead ends are left out
    until what remains is small or little more goes, the rest is walked, and what was
    left out follows from the nodes before it.
    """
    spark = edges.sparkSession
    kinds = dict(edges.dtypes)
    kind, plain = kinds[source], kinds[source] == kinds[target] and kinds[source] in _NAMES
    step = edges.select(F.col(source).alias("_from"), F.col(target).alias("_to")).where(
        "_from is not null and _to is not null"
    )
    # read once: every round joins it
    step, known = settle(step)
    step = step.withColumn("_steps", F.lit(1).cast("long"))
    start = spark.createDataFrame([(r,) for r in roots], f"node {kind}").where("node is not null").distinct()
    start, _ = settle(start.select("node", F.lit(0).cast("long").alias("depth")))
    seen, gone = None, []
    if plain and known is None:
        seen = _walked(step, start, known, PLAIN_ROUNDS)
        if seen is None:
            step, known, gone = _contracted(step, roots)
    if seen is None and plain and known is not None:
        begins = start.select(F.lit(None).cast(kind).alias("_from"), F.col("node").alias("_to"), F.col("depth").alias("_steps"))
        seen = step.union(begins).coalesce(1).mapInArrow(_least_depths, f"node {kind}, depth long")
    if seen is None:
        seen = _walked(step, start, known)
    if gone:
        seen = _expanded(seen, gone)
    return seen.where("depth > 0").select("node", F.col("depth").cast("int").alias("depth"))


def _walked(step: DataFrame, start: DataFrame, known: int | None, most: int | None = None) -> DataFrame | None:
    """(node, depth) of all that ``start`` leads to, in rounds; None if ``most`` rounds do
    not exhaust it.

    After the first rounds each also doubles pointers along nodes with one way in or one
    way out and walks the longer edges so made, so a chain of n nodes takes about log2(n)
    rounds.  A node found again by a shorter way goes on from there once more; nothing is
    left to walk when no depth falls any further.
    """
    small = known is not None
    # what is known to be small stays in one task: a round is then one stage
    packed = lambda df: df.coalesce(1) if small else df
    ways, frontier, seen = packed(step), start, start
    pointers, rounds, count = None, 0, 0
    while rounds != most:
        rounds += 1
        found = _reached(ways, frontier, known, count)
        # a long holds what thirty doublings reach
        if PLAIN_ROUNDS < rounds <= PLAIN_ROUNDS + 30:
            if pointers is None:
                pointers, more = (settle if small else settle_large)(packed(_pointers(step)))
            pointers, more = (settle_large if more is None else settle)(packed(_doubled(packed(pointers), more)))
            if more != 0:
                longer = packed(_shortcuts(pointers))
                found = found.union(_reached(longer, seen, more, None))
                ways = packed(ways.union(longer))
        # one grouping: the least depth there was, and the least of all
        now = seen.withColumn("_old", F.col("depth")).union(found.withColumn("_old", F.lit(None).cast("long")))
        least = packed(now).groupBy("node").agg(F.min("depth").alias("depth"), F.min("_old").alias("_old"))
        fresh = least.where("_old is null or depth < _old").select("node", "depth")
        frontier, count = (settle_large if count is None else settle)(fresh)
        if count == 0 or (count is None and frontier.isEmpty()):
            return seen.groupBy("node").agg(F.min("depth").alias("depth"))
        seen = packed(seen.union(frontier))
        if rounds % 8 == 0:
            seen, _ = (settle_large if count is None else settle)(seen.groupBy("node").agg(F.min("depth").alias("depth")))
    return None


def _reached(ways: DataFrame, nodes: DataFrame, many: int | None, count: int | None) -> DataFrame:
    """What ``nodes`` lead to; ``many`` ways and ``count`` nodes, None for large."""
    if many is None:
        nodes = nodes.hint("merge") if count is None else F.broadcast(nodes)
    ends = ways.join(nodes, F.col("_from") == F.col("node"))
    return ends.select(F.col("_to").alias("node"), (F.col("depth") + F.col("_steps")).alias("depth"))


def descendants(edges: DataFrame, root, *more) -> DataFrame:
    """(node, depth): everything derived from the roots, once, at its least depth."""
    return _closure(edges, [root, *more], "parent", "child")


def ancestors(edges: DataFrame, node, *more) -> DataFrame:
    """(node, depth): everything the nodes derive from."""
    return _closure(edges, [node, *more], "child", "parent")


def mark_dirty(nodes: DataFrame, edges: DataFrame, changed, *more) -> DataFrame:
    """``nodes`` with every transitive descendant of the changed ones Dirty."""
    below = descendants(edges, changed, *more).select(F.col("node").alias("name"), F.lit(True).alias("_hit"))
    status = F.when(F.col("_hit"), "Dirty").otherwise(F.col("status"))
    return nodes.join(below, "name", "left").withColumn("status", status).select(*nodes.columns)


def _subtree(nodes: DataFrame, edges: DataFrame, root) -> DataFrame:
    kind = dict(edges.dtypes)["child"]
    top = nodes.sparkSession.createDataFrame([(root,)], f"node {kind}")
    return top.union(descendants(edges, root).select("node"))


def remove_subtree(nodes: DataFrame, edges: DataFrame, root) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, removed): without the root and its descendants."""
    gone = _subtree(nodes, edges, root)
    kept_nodes = nodes.join(gone, nodes["name"] == gone["node"], "left_anti")
    ends = gone.select(F.col("node").alias("_gone"))
    kept_edges = edges.join(ends, F.col("child") == F.col("_gone"), "left_anti").join(
        ends, F.col("parent") == F.col("_gone"), "left_anti"
    )
    removed = nodes.join(gone, nodes["name"] == gone["node"], "left_semi").select("name")
    return kept_nodes, kept_edges, removed


# a literal or a comment, or what stands between them
_PIECES = r"(?s)'[^']*+(?:''[^']*+)*+'?|--[^\n]*+|/\*(?:[^*]++|\*(?!/))*+(?:\*/)?|(?:[^'\-/]++|-(?!-)|/(?!\*))++"


def _renamed(text: Column, name: Column, suffix: str) -> Column:
    """``text``, free of literals, with the table ``name`` given the suffix."""
    word = F.concat(F.lit(r"\Q"), name, F.lit(r"\E(?![\w.])"))
    new = F.concat(F.lit("${h}"), F.regexp_replace(F.concat(name, F.lit(suffix)), r"([\\$])", r"\\$1"))
    opened = F.lit(r"(?i)(?<h>\b(?:from|join|into|table|exists)\s++\(*+\s*+)")
    listed = F.lit(rf"(?i)(?<h>\bfrom\s(?:(?!\b(?:{'|'.join(_STOP)})\b)[^()])*?,\s*+)")
    before = F.concat(F.lit(r"(?<h>)(?<![\w.])\Q"), name, F.lit(r"\E(?=\s*+\.)"))
    out = F.regexp_replace(text, F.concat(opened, word), new)
    out = F.regexp_replace(out, F.concat(listed, word), new)
    return F.regexp_replace(out, before, new)


def clone_subtree(
    nodes: DataFrame, edges: DataFrame, root, suffix: str = "_copy"
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the copies alone: names get the suffix, parents inside
    the subtree too, parents outside stay, status is Empty.

    A ``command`` column is rewritten to the new names, so that copies run: where
    a table is named and before its columns, not in literals, comments or aliases.
    """
    inside, _ = settle(_subtree(nodes, edges, root))
    member = inside.select(F.col("node").alias("_in"))
    copied = nodes.join(inside, nodes["name"] == inside["node"], "left_semi")
    inner = edges.join(member, F.col("child") == F.col("_in"), "left_semi")
    flagged = inner.join(inside, F.col("parent") == F.col("node"), "left")
    new_parent = F.when(F.col("node").isNotNull(), F.concat(F.col("parent").cast("string"), F.lit(suffix)))
    new_edges = flagged.select(
        F.concat(F.col("child").cast("string"), F.lit(suffix)).alias("child"),
        F.coalesce(new_parent, F.col("parent").cast("string")).alias("parent"),
        F.col("child").alias("_child"),
        F.col("parent").alias("_parent"),
        F.col("node").isNotNull().alias("_inner"),
    )
    out = copied
    if "command" in nodes.columns:
        # the parents named in one node's own command
        renamed = new_edges.where("_inner").groupBy(F.col("_child").alias("name")).agg(
            F.collect_set(F.col("_parent").cast("string")).alias("_names")
        )
        out = out.join(renamed, "name", "left")
        names = F.array_append(F.coalesce("_names", F.array().cast("array<string>")), F.col("name").cast("string"))
        rewritten = F.array_join(
            F.transform(
                F.regexp_extract_all("command", F.lit(_PIECES), F.lit(0)),
                lambda piece: F.when(piece.rlike(r"^(?:'|--|/\*)"), piece).otherwise(
                    F.aggregate(names, piece, lambda text, n: _renamed(text, n, suffix))
                ),
            ),
            "",
        )
        out = out.withColumn("command", rewritten).select(*nodes.columns)
    out = out.withColumn("name", F.concat(F.col("name").cast("string"), F.lit(suffix))).withColumn("status", F.lit("Empty"))
    return out, new_edges.select("child", "parent")


def tree(nodes: DataFrame, edges: DataFrame, compact: bool = False) -> DataFrame:
    """(path, node, depth, note): every way down from the roots, depth first by path.

    A node with several parents is listed under each.  ``note`` is ``orphan``
    for a node listed at the top because a parent is missing, and ``cycle`` for
    one that no root leads to.

    Diamonds double the ways down: twenty in a row give a million paths to the
    last node.  With ``compact`` a node's descendants are listed once, where it
    is nearest to a root (of several such places at the least path); under its
    other parents there is one row with the note ``see <that path>``.  Rows are
    then at most as many as nodes and edges.
    """
    names = nodes.select(F.col("name").alias("node")).distinct()
    known = edges.join(names.withColumnRenamed("node", "_p").hint("merge"), F.col("parent") == F.col("_p"), "left")
    parents = known.groupBy(F.col("child").alias("node")).agg(
        F.count_if(F.col("_p").isNotNull()).alias("_known"), F.count_if(F.col("_p").isNull()).alias("_missing")
    )
    placed = names.join(parents.hint("merge"), "node", "left").na.fill(0, ["_known", "_missing"])
    note = F.when(F.col("_missing") > 0, "orphan").otherwise("")
    start = placed.where("_known = 0").select(
        F.array("node").alias("path"), "node", F.lit(0).alias("depth"), note.alias("note")
    )
    step, steps = settle(known.where("_p is not null").select(F.col("child").alias("_c"), "parent").distinct())
    level, count = settle(start, SMALL_PATHS)
    listed, rounds = level, 0
    while True:
        rounds += 1
        below = (F.broadcast(level) if count is not None else level.hint("merge")).join(step, F.col("node") == F.col("parent")).where(~F.array_contains("path", F.col("_c")))
        found = below.select(
            F.array_append("path", F.col("_c")).alias("path"),
            F.col("_c").alias("node"),
            (F.col("depth") + 1).alias("depth"),
            F.lit("").alias("note"),
        )
        if compact:
            # only where a node is met first do its own children follow
            fresh = found.join(_kept(listed.select("node"), steps), "node", "left_anti")
            found = fresh.groupBy("node").agg(F.min_by(F.struct("path", "depth", "note"), "path").alias("_at")).select("_at.path", "node", "_at.depth", "_at.note")
        # after a large level another is likely
        level, count = (settle_large if count is None else settle)(found, SMALL_PATHS)
        if count == 0 or (count is None and level.isEmpty()):
            break
        listed = listed.union(level)
        if rounds % 16 == 0:
            listed, _ = settle_large(listed, SMALL_PATHS)
    if compact:
        listed, _ = settle_large(listed, SMALL_PATHS)
        listed = listed.union(_further_parents(listed, step, steps))
    lost = names.join(_kept(listed.select("node").distinct(), steps), "node", "left_anti").select(
        F.array("node").alias("path"), "node", F.lit(0).alias("depth"), F.lit("cycle").alias("note")
    )
    return listed.union(lost).orderBy("path").select(F.array_join(F.col("path").cast("array<string>"), " / ").alias("path"), "node", "depth", "note")


def _further_parents(listed: DataFrame, step: DataFrame, steps: int | None) -> DataFrame:
    """One row for each edge that the listed tree leaves out, ways back up excepted."""
    home = listed.select(F.col("node").alias("_c"), F.col("path").alias("_home"))
    under = listed.join(_kept(step, steps), F.col("node") == F.col("parent")).where(~F.array_contains("path", F.col("_c")))
    rows = under.select(F.array_append("path", F.col("_c")).alias("path"), "_c", (F.col("depth") + 1).alias("depth")).join(_kept(home, steps), "_c")
    see = F.concat(F.lit("see "), F.array_join(F.col("_home").cast("array<string>"), " / "))
    return rows.where("path != _home").select("path", F.col("_c").alias("node"), "depth", see.alias("note"))
