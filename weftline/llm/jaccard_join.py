"""N-gram Jaccard join with set-relation skipping.

Documents link when the Jaccard similarity of their shingle sets reaches a threshold.

* Equal sets are one node.  An inverted index holds the necessary prefix of each
  node's set under the order "rarest first" (by counts of frequent shingles, then by
  how rare the words of a shingle are), prolonged so that linked nodes meet on
  MEETINGS lists at least.  Lists are cut into cells by set size; nodes that meet too
  few others of a size they could link with are done.
* Relations between sets spare most comparisons.  Nodes that meet on index lists
  gather round a base set.  Each is compared with its base once, and from then on is
  the base plus a short difference: the overlap of two nodes of one base follows from
  the sizes of their differences and from what those have in common,

      |x & y| = |b| - |b-x| - |b-y| + |D(x) & D(y)|,      D(x) = (x-b) + (b-x).

  This holds for any set b, so each base is moved to the middle of its nodes: it gets
  what more than half of them have.  Nodes near the middle are linked with the nearest
  of all without looking at any set, others are searched by an index of the
  differences alone.
* Every node is first compared with one stand of each list.  What these links connect
  is one component, and only nodes of different components are compared after that.
* On lists that hold nodes of several components a node probes the size blocks that it
  can reach, and skips entries whose positions leave too little overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from weftline.llm.components import components
from weftline.llm.hashing import BLANK_SEPARATED, distinct_shingles, mix, shingles, word_blocks
from weftline.llm.runs import prepare, stored

#: How many of the most frequent shingles, and of words, the order knows by their
#: frequency; it bounds what is broadcast.  Any order is right.
FREQUENT = 1 << 18
#: Lists on which linked nodes meet (or on as many as the overlap they need has shingles).
MEETINGS = 10
#: A task reports a shingle that this many of a block's distinct sets hold.
_REPORTED = 4
_BLOCK = 2_000_000


def _texts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word hashes) of each text."""
    for first, counts, hashes, *_ in word_blocks(texts, BLANK_SEPARATED):
        edge = np.concatenate([[0], np.cumsum(counts)])
        for k in range(len(counts)):
            yield first + k, hashes[edge[k] : edge[k + 1]]


def _known(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The count of each key in the sorted table, 0 where it has none."""
    known, count = table
    if not len(known):
        return np.zeros(len(keys), np.int64)
    slot = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[slot] == keys, count[slot], 0)


def _rarity(words: np.ndarray, size: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Per shingle the sum over its words of the logarithm of their counts, in eighths."""
    common = np.rint(8 * np.log2(_known(table, words) + 1)).astype(np.int64)
    size = min(size, len(words))
    return sum(common[k : len(words) - size + 1 + k] for k in range(size))


def _node(shingles: np.ndarray) -> int:
    """The name of a set: a 64-bit hash of its members."""
    if not len(shingles):
        return 0
    total = mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(mix(np.array([total], dtype=np.uint64))[0].view(np.int64))


def _summaries(size: int):
    """A row per document, and rows for shingles and words that are frequent among a block's sets."""
    names = ["doc", "n", "node", "shingle", "word", "count"]

    def rows(many: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * many), pa.int64()) for c in names], names=names)

    def frequent(**held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, arrays in held.items():
            if arrays:
                key, n = np.unique(np.concatenate(arrays), return_counts=True)
                often = n >= _REPORTED
                yield rows(int(often.sum()), **{name: key[often].view(np.int64), "count": n[often].astype(np.int64)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: list[np.ndarray] = []
        spelled: list[np.ndarray] = []
        seen: set[int] = set()
        weight = 0
        for batch in batches:
            n, node = [0] * batch.num_rows, [0] * batch.num_rows
            for i, words in _texts(batch.column(1)):
                found = distinct_shingles(words, size)
                n[i], node[i] = len(found), _node(found)
                if node[i] not in seen:
                    seen.add(node[i])
                    sets.append(found)
                    spelled.append(words)
                    weight += len(words)
                if weight >= _BLOCK:
                    yield from frequent(shingle=sets, word=spelled)
                    sets, spelled, weight, seen = [], [], 0, set()
            yield rows(batch.num_rows, doc=batch.column(0), n=n, node=node)
        yield from frequent(shingle=sets, word=spelled)

    return run


def _prefixes(shared, size: int, percent: int):
    """The necessary prefix of each distinct set of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, common = shared.value
        seen: set[int] = set()
        for batch in batches:
            node, n, prefix = [], [], []
            for _, words in _texts(batch.column(0)):
                found, place = np.unique(shingles(words, size), return_index=True)
                name, many = _node(found), len(found)
                if not many or name in seen:
                    continue
                seen.add(name)
                keep = min(many, many - -(-percent * many // 100) + MEETINGS)
                rarity = _rarity(words, size, common)[place]
                chosen = np.lexsort((mix(found ^ np.uint64(percent)), rarity, _known(frequent, found)))[:keep]
                node.append(name)
                n.append(many)
                prefix.append(found[chosen].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(prefix, pa.list_(pa.int64()))],
                names=["node", "n", "prefix"],
            )

    return run


def _whole_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            wanted = batch.column(1).to_pylist()
            node, members = [], []
            for i, words in _texts(batch.column(0)):
                found = distinct_shingles(words, size)
                # rows that share an id may have other texts; equal ones lie in one task
                if _node(found) == wanted[i] and wanted[i] not in seen:
                    seen.add(wanted[i])
                    node.append(wanted[i])
                    members.append(found.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(node, pa.int64()), pa.array(members, pa.list_(pa.int64()))], names=["node", "members"]
            )

    return run


def _frequent(counts: DataFrame, key: str) -> tuple[np.ndarray, np.ndarray]:
    """At most FREQUENT keys and their counts, sorted by key."""
    counts = counts.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum("count").alias("n"))
    counts = stored(counts.withColumn("size", F.floor(F.log2("n") * 8)), "frequent")
    sizes = sorted(((r["size"], r["many"]) for r in counts.groupBy("size").agg(F.count("*").alias("many")).collect()), reverse=True)
    least, room = None, FREQUENT
    for size, many in sizes:
        room -= many
        if room < 0:
            break
        least = size
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    got = counts.where(F.col("size") >= least).select(key, "n").toArrow()
    keys, n = got[key].to_numpy().view(np.uint64), got["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def _edges(source: DataFrame, summary: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (u, v) between nodes, enough to connect all that are connected."""
    spark = source.sparkSession
    shared = spark.sparkContext.broadcast(tuple(_frequent(summary, key) for key in ("shingle", "word")))
    prefixes = source.select("text").mapInArrow(_prefixes(shared, size, percent), "node long, n long, prefix array<long>")
    prefixes = stored(prefixes, "prefixes")
    entries = prefixes.select("node", "n", F.posexplode("prefix").alias("at", "token"))

    # index lists with at least two nodes
    lists = entries.groupBy("token").agg(F.min("node").alias("_a"), F.max("node").alias("_b")).where("_a <> _b").select("token")
    entries = stored(entries.join(stored(lists, "tokens"), "token").distinct(), "lists")
    # nodes that may link lie in one size block or in two next to each other, so they share
    # a cell of one of two grids; the least node of a cell stands for a base
    cell = F.floor((_block(percent) + F.col("grid")) / 2)
    cells = entries.select("token", "node", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("grid")).withColumn("cell", cell)
    stands = cells.groupBy("token", "grid", "cell").agg(F.min("node").alias("stand"), F.max("node").alias("_b")).where("stand <> _b").drop("_b")
    met = cells.join(stored(stands, "cells"), ["token", "grid", "cell"]).select("node", "n", "token", "stand")
    met = stored(met.groupBy("node", "n", "stand").agg(F.collect_set("token").alias("tokens")), "met")
    enough = met.groupBy("node", "n").agg(F.size(F.array_distinct(F.flatten(F.collect_list("tokens")))).alias("many"))
    enough = enough.where(F.col("many") >= _needed(F.col("n"), percent)).select("node")
    votes = met.join(enough, "node", "left_semi").select("node", "stand", F.size("tokens").alias("many"))
    base = votes.groupBy("node").agg(F.max(F.struct("many", -F.col("stand"), "stand"))["stand"].alias("base"))
    base = stored(base, "bases")
    for _ in range(2):  # the base of a base
        following = base.select(F.col("node").alias("base"), F.col("base").alias("_next"))
        base = base.join(following, "base", "left").select("node", F.coalesce("_next", "base").alias("base"))
    base = stored(base, "bases")

    # the sets of nodes that meet any other
    first = summary.where("doc IS NOT NULL").join(base.select("node"), "node", "left_semi").groupBy("node").agg(F.min("doc").alias("doc"))
    chosen = source.join(first, "doc").select("text", "node")
    sets = chosen.mapInArrow(_whole_sets(size), "node long, members array<long>")
    sets = stored(sets.withColumn("n", F.size("members").cast("long")), "sets")

    # each node as its base and a difference, where that is short; else it is its own base
    of_base = sets.select(F.col("node").alias("base"), F.col("members").alias("_b"), F.col("n").alias("nb"))
    near = sets.join(base, "node").where("node <> base").join(of_base, "base")
    near = near.select(
        "node", "base", "n", "nb", F.array_except("_b", "members").alias("gone"), F.array_except("members", "_b").alias("new")
    ).withColumn("_both", F.col("n") - F.size("new"))
    loose = percent - 30
    near = near.where(F.col("_both") * 100 >= (F.col("n") + F.col("nb") - F.col("_both")) * loose)
    near = stored(near.select("node", "base", "nb", "gone", "new"), "differences")
    bases = near.select("node", "base")
    to_base = near.where(_weight(percent) <= _slack(percent)).select(F.col("node").alias("u"), F.col("base").alias("v"))

    near = stored(_centred(near, percent), "centred")
    tokens = stored(_searched(near, percent), "searched")
    first = stored(to_base.unionByName(_to_nearest(near, percent)).unionByName(_to_stands(near, tokens, percent)), "first-links")
    roots = stored(components(first), "first-roots")
    entries = entries.join(base.select("node"), "node", "left_semi")
    return first.unionByName(_same_base(near, tokens, roots, percent)).unionByName(_across(entries, bases, roots, sets, percent))


def _weight(percent: int):
    """What a difference costs: x and y of one base b link when
    (100 + percent) * |D(x) & D(y)| >= weight(x) + weight(y) - slack(b)."""
    return (100 * F.size("gone") + percent * F.size("new")).cast("long")


def _slack(percent: int):
    return (100 - percent) * F.col("nb")


def _centred(near: DataFrame, percent: int) -> DataFrame:
    """(node, base, diff, weight, slack, least) with each base moved to the middle of its nodes.

    ``least`` is the least (weight, node) of the base.  A base is a node of itself.
    """
    own = near.select("base", "nb").distinct().select(F.col("base").alias("node"), "base", "nb", *[F.array().cast("array<long>").alias(c) for c in ("gone", "new")])
    near = near.unionByName(own)
    members = near.groupBy("base").agg(F.count("*").alias("members"))
    held = near.select("base", F.lit(True).alias("lost"), F.explode("gone").alias("token")).unionByName(
        near.select("base", F.lit(False).alias("lost"), F.explode("new").alias("token"))
    )
    held = held.groupBy("base", "lost", "token").agg(F.count("*").alias("held")).join(members, "base").where("2 * held > members")
    # no more than twice what the nodes of a base have on average
    turned = held.groupBy("base").agg(*[F.collect_list(F.when(F.col("lost") == lost, F.col("token"))).alias(c) for c, lost in (("_out", True), ("_in", False))])
    near = near.join(turned, "base", "left").withColumns({c: F.coalesce(c, F.array().cast("array<long>")) for c in ("_out", "_in")})
    near = near.select(
        "node", "base", (F.col("nb") - F.size("_out") + F.size("_in")).alias("nb"),
        F.concat(F.array_except("gone", "_out"), F.array_except("_in", "new")).alias("gone"),
        F.concat(F.array_except("new", "_in"), F.array_except("_out", "gone")).alias("new"),
    )
    near = stored(near.select("node", "base", F.concat("gone", "new").alias("diff"), _weight(percent).alias("weight"), _slack(percent).alias("slack")), "middle")
    least = near.groupBy("base").agg(F.min(F.struct("weight", "node")).alias("least"))
    return near.join(least, "base")


def _linked(pairs: DataFrame, near: DataFrame, percent: int) -> DataFrame:
    """The pairs (base, u, v) that link, by their differences."""
    of = lambda name: near.select(
        "base", F.col("node").alias(name), F.col("diff").alias(f"d{name}"), F.col("weight").alias(f"w{name}"), F.col("slack").alias(f"s{name}")
    )
    both = pairs.join(of("u"), ["base", "u"]).join(of("v"), ["base", "v"])
    overlap = F.size(F.array_intersect("du", "dv")) * (100 + percent)
    return both.where(overlap >= F.col("wu") + F.col("wv") - F.col("su")).select("u", "v")


def _to_nearest(near: DataFrame, percent: int) -> DataFrame:
    """Links with the node nearest to the middle of the base."""
    nearest = near.where("node = least.node").select("base", F.col("diff").alias("_d"))
    both = near.where("node <> least.node").join(nearest, "base")
    overlap = F.size(F.array_intersect("diff", "_d")) * (100 + percent)
    return both.where(overlap >= F.col("weight") + F.col("least.weight") - F.col("slack")).select(F.col("node").alias("u"), F.col("least.node").alias("v"))


def _searched(near: DataFrame, percent: int) -> DataFrame:
    """Tokens of differences by which nodes of one base, one of them far, can find each other.

    A node is far when its weight and the least of the base exceed the slack; any other
    links with the nearest.  A far x needs a common token with whom it links, and so has
    one in the prefix of its difference under the order "rarest at this base first".
    What no other node of the base has comes first in every prefix and meets nothing, so
    nodes with too little else are left out, and that once more for what is left.
    """
    unit = 100 + percent
    far = F.col("weight") + F.col("least.weight") > F.col("slack")
    # the overlap needed at least: of a far node with any other, and of any node with a far one
    probe_need = F.ceil((F.col("weight") + F.col("least.weight") - F.col("slack")) / unit)
    index_need = F.ceil((F.col("weight") - F.col("least.weight") + 1) / unit)
    need = F.when(far, F.least(probe_need, index_need)).otherwise(index_need)
    tokens = near.withColumns({"far": far, "need": need, "probe_need": probe_need, "index_need": index_need}).select(
        "node", "base", "weight", "slack", "far", "need", "probe_need", "index_need", F.size("diff").alias("size"), F.explode("diff").alias("token")
    )
    for _ in range(2):
        shared = tokens.groupBy("base", "token").agg(F.count("*").alias("held")).where("held > 1")
        tokens = tokens.drop("held", "able").join(shared, ["base", "token"])
        tokens = tokens.withColumn("able", F.count("*").over(Window.partitionBy("base", "node"))).where("able >= need")
    place = F.row_number().over(Window.partitionBy("base", "node").orderBy("held", "token")) + F.col("size") - F.col("able")
    tokens = tokens.withColumn("place", place)
    tokens = tokens.withColumn("probe", F.col("far") & (F.col("able") >= F.col("probe_need")) & (F.col("place") <= F.col("size") - F.col("probe_need") + 1))
    tokens = tokens.withColumn("index", (F.col("able") >= F.col("index_need")) & (F.col("place") <= F.col("size") - F.col("index_need") + 1))
    return tokens.where("probe OR index").select("node", "base", "token", "weight", "slack", "far", "able", "probe", "index")


def _to_stands(near: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """Links of nodes with the least of those that their tokens lead to, one a token."""
    stands = tokens.where("index").groupBy("base", "token").agg(F.min(F.struct("weight", "node"))["node"].alias("v"))
    pairs = tokens.where("probe").select("base", "token", F.col("node").alias("u")).join(stands, ["base", "token"]).where("u <> v")
    return _linked(stored(pairs.select("base", "u", "v").distinct(), "stands"), near, percent)


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with the component of their ``node``, itself where it has no link yet."""
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _block(percent: int):
    """The size block of ``n``: sizes in proportion ``percent`` or more are at most one apart."""
    if percent == 100:
        return F.col("n")
    return F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9)


def _needed(n, percent: int):
    """Lists on which a set of n meets any set it links with."""
    return F.least(F.lit(MEETINGS), F.ceil(n * percent / 100))


def _same_base(near: DataFrame, tokens: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Links of nodes of one base that the first links leave in different components."""
    tokens = _rooted(tokens, roots)
    mixed = tokens.groupBy("base", "token").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).where("_a <> _b").select("base", "token")
    tokens = stored(tokens.join(mixed, ["base", "token"]), "apart")
    side = lambda name: [F.col("node").alias(name), F.col("able").alias(f"a{name}"), F.col("weight").alias(f"w{name}"), F.col("root").alias(f"r{name}")]
    probe = tokens.where("probe").select("base", "token", "slack", *side("u"))
    index = tokens.where("index").select("base", "token", "far", *side("v"))
    reach = F.least("au", "av") * (100 + percent) >= F.col("wu") + F.col("wv") - F.col("slack")
    pairs = probe.join(index, ["base", "token"]).where(F.expr("ru <> rv AND (NOT far OR u < v)") & reach).select("base", "u", "v").distinct()
    return _linked(pairs, near, percent)


def _across(entries: DataFrame, bases: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of nodes of different bases and components, from lists cut into blocks by set size."""
    placed = entries.join(bases, "node", "left").withColumn("base", F.coalesce("base", "node"))
    placed = _rooted(placed, roots).withColumn("block", _block(percent))
    ends = [f(c).alias(f"_{f.__name__}_{c}") for c in ("base", "root") for f in (F.min, F.max)]
    for k in range(2):
        # lists of several bases and components, and nodes on enough of them to link on
        mixed = placed.groupBy("token").agg(*ends).where("_min_base <> _max_base AND _min_root <> _max_root").select("token", F.col("_min_base").alias("main"))
        placed = stored(placed.drop("main").join(mixed, "token"), f"mixed-{k}")
        enough = placed.groupBy("node", "n").agg(F.count("*").alias("many")).where(F.col("many") >= _needed(F.col("n"), percent))
        placed = placed.join(enough.select("node"), "node", "left_semi")
    placed = stored(placed, "mixed")
    side = lambda name: [F.col("node").alias(name), *[F.col(c).alias(f"{c[0]}{name}") for c in ("n", "at", "base", "root")]]
    # all nodes of a list's main base are spared among themselves
    probe = placed.where("base <> main").select("token", *side("u"), F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("block"))
    index = placed.select("token", "block", "main", *side("v"))
    # an overlap is what lies before a common token in both, and from it on
    most = F.least("au", "av") + F.least(F.col("nu") - F.col("au"), F.col("nv") - F.col("av"))
    enough = most * (100 + percent) >= (F.col("nu") + F.col("nv")) * percent
    apart = F.expr("bu <> bv AND ru <> rv AND (bv = main OR u < v)")
    pairs = probe.join(index, ["token", "block"]).where(apart & enough)
    # one order for a pair, whichever of the two a list's main base spares
    one, other = (F.when(F.col("u") < F.col("v"), F.struct(a, "n" + a)).otherwise(F.struct(F.col(b).alias(a), F.col("n" + b).alias("n" + a))) for a, b in (("u", "v"), ("v", "u")))
    pairs = pairs.select(one.alias("_u"), other.alias("_v"), "token").select("_u.*", "_v.*", "token")
    pairs = pairs.groupBy("u", "v", "nu", "nv").agg(F.count_distinct("token").alias("many"))
    # the prefix that ends first under the order has all common tokens up to there, and the rest
    # of its set cannot hold more
    rest = lambda n: F.greatest(F.ceil(F.col(n) * percent / 100) - MEETINGS, F.lit(0))
    least = F.ceil((F.col("nu") + F.col("nv")) * percent / (100 + percent)) - F.greatest(rest("nu"), rest("nv"))
    pairs = stored(pairs.where(F.col("many") >= least).select("u", "v"), "candidates")
    sets = sets.join(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "node", "left_semi")
    of = lambda name: sets.select(F.col("node").alias(name), F.col("members").alias(f"m{name}"), F.col("n").alias(f"n{name}"))
    both = pairs.join(of("u"), "u").join(of("v"), "v").withColumn("_both", F.size(F.array_intersect("mu", "mv")))
    return both.where(F.col("_both") * 100 >= (F.col("nu") + F.col("nv") - F.col("_both")) * percent).select("u", "v")


def linked(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80
) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row: the components of the join.

    Words are separated by ASCII blanks, A-Z in lower case; the set of a text is its
    distinct runs of ``size`` words, or all of its words as one if it has fewer.  Two
    documents link when 100 * |x & y| >= ``percent`` * |x | y|; ``component_id`` is the
    smallest id that links reach, its own included.  Shingles and sets are told apart
    by 64-bit hashes.

    A null, empty or blank text has no set, and links with nothing.  Repeated rows link
    with each other.  A row with a null id links as others do; a component of such
    rows alone has a null id.  Other columns are not looked at.
    """
    percent = int(percent)
    if not 31 <= percent <= 100:
        raise ValueError("percent must lie between 31 and 100")
    prepare(docs.sparkSession)
    text = F.col(text_col).cast("string")
    # rows without an id need one to be found again by
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text)).alias("doc"), text.alias("text"), F.col(id_col).cast("long").alias("given"))
    summary = stored(
        source.select("doc", "text").mapInArrow(_summaries(size), "doc long, n long, node long, shingle long, word long, count long"), "summary"
    )
    roots = components(_edges(source.select("doc", "text"), summary, size, percent))
    ids = summary.where("doc IS NOT NULL").select("doc", "n", "node")
    if docs.where(F.col(id_col).isNull()).isEmpty():
        ids = ids.withColumn("given", F.col("doc"))
    else:
        none = source.where("given IS NULL").select("doc").distinct().withColumn("_none", F.lit(True))
        ids = ids.join(none, "doc", "left").withColumn("given", F.when(F.col("_none").isNull(), F.col("doc"))).drop("_none")
    firsts = ids.where("n > 0").groupBy("node").agg(F.min("given").alias("first"))
    rooted = firsts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("first").alias("component_id"))
    named = stored(rooted.join(smallest, "root").select("node", "component_id"), "named")
    joined = ids.join(named, "node", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("given"))
    return joined.select(F.col("given").alias("doc_id"), F.col("n").alias("n_shingles"), own.alias("component_id"))


def representatives(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document, that of the smallest id, of each component.

    Repeated rows of that id stay; so does every row with a null id.
    """
    keep = linked(docs, id_col=id_col, text_col=text_col, size=size, percent=percent)
    keep = keep.where("doc_id = component_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(keep, id_col, "left_semi").unionByName(docs.where(F.col(id_col).isNull()))
