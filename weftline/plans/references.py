"""Table references of one statement, read off Spark's own parse tree."""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import SparkSession

from weftline.functions.names import quoted
from weftline.plans.lineage import table_refs

_CTAS = re.compile(
    r"^\s*create\s+(?P<replace>or\s+replace\s+)?table\s+(?P<guard>if\s+not\s+exists\s+)?"
    r"(?P<name>[\w.`\"]+)\s+(?:using\s+\w+\s+)?as\s+(?P<query>.+?);?\s*$",
    re.IGNORECASE | re.DOTALL,
)


def split_ctas(sql: str) -> tuple[str, str, str] | None:
    """(name, mode, query) of a CREATE TABLE ... AS, with mode a save mode."""
    found = _CTAS.match(sql)
    if not found:
        return None
    mode = "overwrite" if found["replace"] else "ignore" if found["guard"] else "error"
    return re.sub(r"[`\"]", "", found["name"]), mode, found["query"]


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


class Place(NamedTuple):
    """Where a statement names a table: code points start to stop, stop excluded."""

    name: str
    start: int
    stop: int
    renamable: bool  # an alias may follow, and none does


def _parser(spark: SparkSession):
    state = getattr(getattr(spark, "_jsparkSession", None), "sessionState", None)
    return state and state().sqlParser()


def _places(parser, sql: str) -> list[Place]:
    """Every table that ``sql`` names, first use first; WITH names excluded."""
    found = []
    walk = [(parser.parsePlan(sql), frozenset(), None)]
    while walk:
        node, hidden, above = walk.pop(0)
        kind = node.nodeName()
        if kind == "UnresolvedRelation":
            name = ".".join(_items(node.multipartIdentifier()))
            if name.lower() not in hidden:
                at = node.origin()
                plain = above not in (None, "SubqueryAlias", "InsertIntoStatement", "Sample")
                found.append(Place(name, at.startIndex().get(), at.stopIndex().get() + 1, plain))
            continue
        if kind == "UnresolvedWith":
            named = [(pair._1().lower(), pair._2()) for pair in _items(node.cteRelations())]
            for i, (name, body) in enumerate(named):
                # a name is visible to the bodies after it, and to its own if recursive
                before = {n for n, _ in named[: i + (1 if node.allowRecursion() else 0)]}
                walk.append((body, hidden | before, kind))
            walk.append((node.child(), hidden | {n for n, _ in named}, kind))
            continue
        if kind == "InsertIntoStatement":
            walk.append((node.table(), hidden, kind))
        walk += [(child, hidden, kind) for child in _items(node.children())]
        walk += [(sub, hidden, None) for sub in _items(node.subqueries())]
    return found


def references(spark: SparkSession, sql: str) -> list[str]:
    """Distinct tables ``sql`` names, in order of first use; WITH names excluded."""
    parser = _parser(spark)
    if parser is None:
        frame = spark.createDataFrame([(0, sql)], "id int, sql string")
        return [r["ref"] for r in table_refs(frame, "id", "sql").collect()]
    return list(dict.fromkeys(place.name for place in _places(parser, sql)))


def with_tables_renamed(spark: SparkSession, sql: str, names: Mapping[str, str]) -> str:
    """``sql`` reading other tables; nothing but table positions changes.

    Literals, comments, columns and aliases keep their text.  Where columns are
    written with the old table's name before them, the new table gets the old
    name as its alias.  A table written with its schema cannot lend that to
    columns: they must use the last part alone.  Without a parser in the session
    (a remote one) whole words outside literals are replaced instead.
    """
    new = {old.lower(): name for old, name in names.items()}
    parser = _parser(spark)
    if parser is None:
        return _words_renamed(sql, new)
    made = split_ctas(sql)
    if made:
        found = _CTAS.match(sql)
        body = with_tables_renamed(spark, found["query"], names)
        target = new.get(made[0].lower())
        head = sql[: found.start("name")] + (quoted(target) if target else found["name"])
        return head + sql[found.end("name") : found.start("query")] + body + sql[found.end("query") :]
    places = sorted((p for p in _places(parser, sql) if p.name.lower() in new), key=lambda p: -p.start)

    def rewritten(with_alias: bool) -> str:
        out = sql
        for place in places:
            last = place.name.rsplit(".", 1)[-1]
            named = new[place.name.lower()]
            text = quoted(named) if not re.fullmatch(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)*", named) else named
            qualifier = rf"(?i)(?<![\w`.])`?{re.escape(last)}`?\s*\."
            if with_alias and place.renamable and re.search(qualifier, sql):
                text += f" AS {quoted(last)}" if "." not in last else ""
            out = out[: place.start] + text + out[place.stop :]
        return out

    out = rewritten(True)
    try:
        parser.parsePlan(out)
    except Exception:  # noqa: BLE001 - an alias where the grammar takes none
        return rewritten(False)
    return out


def _words_renamed(sql: str, new: Mapping[str, str]) -> str:
    literal = r"'[^']*'|--[^\n]*|/\*.*?\*/"
    words = "|".join(re.escape(old) for old in sorted(new, key=len, reverse=True))
    either = re.compile(rf"(?is)({literal})|(?<![\w.])({words})(?!\w)")
    return either.sub(lambda found: found[1] or new[found[2].lower()], sql)
