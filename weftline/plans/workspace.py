"""Named results with recorded parents.

A workspace keeps one small record per node on the driver; every node's data
stays in Spark, as a temporary view (queries) or a saved table (imports and
materialised results).
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from weftline.functions.names import quoted
from weftline.operators.plotdata import plot_series
from weftline.plans.references import references, split_ctas, with_tables_renamed
from weftline.sources.readers import read
from weftline.sources.writers import export

EMPTY, UP_TO_DATE, DIRTY, ERROR = "Empty", "UpToDate", "Dirty", "Error"

NODE_SCHEMA = (
    "name string, kind string, parents array<string>, status string, rows bigint, "
    "seconds double, last_run_at timestamp, frozen boolean, command string, error string"
)

FORMAT = 1
MANIFEST_SCHEMA = "ord int, part string, body string"


@dataclass
class Node:
    name: str
    kind: str  # table, query or plot
    step: dict  # the verb and arguments that make it
    parents: list[str] = field(default_factory=list)
    status: str = EMPTY
    rows: int | None = None
    seconds: float | None = None
    last_run_at: datetime | None = None
    frozen: bool = False
    error: str | None = None


class Workspace:
    """``location``: where saved tables go; the session's warehouse if unset."""

    def __init__(self, spark: SparkSession, location: str | None = None):
        self.spark = spark
        self.location = location.rstrip("/") if location else None
        self._nodes: dict[str, Node] = {}
        self._templates: dict[str, tuple[str, tuple[str, ...]]] = {}
        self._steps: list[dict] = []

    # --- records -----------------------------------------------------------

    def __contains__(self, name: str) -> bool:
        return name in self._nodes

    def __getitem__(self, name: str) -> Node:
        if name not in self._nodes:
            raise KeyError(f"no node named {name!r}")
        return self._nodes[name]

    def _put(self, node: Node, record: bool = True) -> Node:
        """Add a node, replacing its namesake; what was built on that turns Dirty."""
        replaced = node.name in self._nodes
        self._nodes.pop(node.name, None)
        self._nodes[node.name] = node
        if record:
            self._steps.append(dict(node.step))
        if replaced:
            self._mark_below(node.name)
        return node

    def _known(self, refs: Sequence[str], own: str) -> list[str]:
        names = {n.lower(): n for n in self._nodes}
        return [names[r.lower()] for r in refs if r.lower() in names and names[r.lower()] != own]

    def _below(self, name: str) -> list[str]:
        """The node and its descendants, nearest first."""
        order = [name]
        for current in order:
            order += [n.name for n in self._nodes.values() if current in n.parents and n.name not in order]
        return order

    def _mark_below(self, name: str) -> list[str]:
        hit = [n for n in self._below(name)[1:] if self._nodes[n].status != EMPTY]
        for n in hit:
            self._nodes[n].status = DIRTY
        return hit

    # --- queries -----------------------------------------------------------

    def sql(self, query: str, name: str | None = None) -> DataFrame:
        """Run SQL.  A name makes a query node that later queries can select
        from; CREATE TABLE ... AS makes a table node."""
        made = split_ctas(query)
        if made:
            return self._create(*made, query)
        if name is None:
            view = re.match(r"(?is)^\s*create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?view\s+([\w`\"]+)\s+as\s+(.+)$", query)
            if view:
                return self.sql(view[2], name=re.sub(r"[`\"]", "", view[1]))
            target = re.match(r"(?is)^\s*insert\s+(?:into|overwrite)\s+(?:table\s+)?([\w.`]+)", query)
            out = self.spark.sql(query)
            if target and (into := target[1].replace("`", "")) in self._nodes:
                self._nodes[into].rows = None
                self._mark_below(into)
                self._steps.append({"verb": "sql", "query": query})
            return out
        parents = self._known(references(self.spark, query), name)
        self._view(name, query)
        self._put(Node(name, "query", {"verb": "sql", "name": name, "query": query}, parents, UP_TO_DATE))
        return self.table(name)

    def derive(self, name: str, query: str) -> DataFrame:
        """A query node that nothing has run yet; still selectable by name."""
        parents = self._known(references(self.spark, query), name)
        self._view(name, query)
        self._put(Node(name, "query", {"verb": "derive", "name": name, "query": query}, parents))
        return self.table(name)

    def _view(self, name: str, query: str) -> None:
        # a view over text is resolved again at each use, so it follows its parents
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {quoted(name)} AS {query.rstrip().rstrip(';')}")

    def _create(self, name: str, mode: str, query: str, text: str) -> DataFrame:
        parents = self._known(references(self.spark, query), name)
        started = time.monotonic()
        self._save(self.spark.sql(query), name, mode)
        node = self._put(Node(name, "table", {"verb": "sql", "query": text}, parents))
        self._ran(node, started)
        return self.table(name)

    def table(self, name: str) -> DataFrame:
        return self.spark.table(quoted(name))

    def preview(self, name: str, n: int = 1000) -> DataFrame:
        return self.table(name).limit(n)

    # --- import ------------------------------------------------------------

    def into(self, table: str, file: str | Sequence[str] | None = None, fmt: str | None = None, *, df=None, **options) -> int:
        """Import files (or save a DataFrame) as a table node; returns its rows."""
        started = time.monotonic()
        if df is None:
            if file is None:
                raise ValueError("into needs file= or df=")
            step = {"verb": "into", "table": table, "file": file, "fmt": fmt, **options}
            df = read(self.spark, file, fmt, **options)
        else:
            step = {"verb": "into", "table": table, "file": None}
        self._save(df, table, "overwrite")
        node = self._put(Node(table, "table", step))
        self._ran(node, started)
        return node.rows

    def into_many(self, prefix: str, tables: Mapping[str, DataFrame]) -> dict[str, int]:
        """Several tables from one step, named prefix + suffix."""
        return {prefix + suffix: self.into(prefix + suffix, df=df) for suffix, df in tables.items()}

    def _save(self, df: DataFrame, name: str, mode: str) -> None:
        if "." in name:
            self.spark.sql(f"CREATE SCHEMA IF NOT EXISTS {quoted(name.rsplit('.', 1)[0])}")
        writer = df.write.format("parquet").mode(mode)
        if self.location:
            writer = writer.option("path", f"{self.location}/{name}")
        writer.saveAsTable(quoted(name))

    def _ran(self, node: Node, started: float) -> None:
        node.rows = self.table(node.name).count()
        node.seconds = time.monotonic() - started
        node.last_run_at = datetime.now(timezone.utc)
        node.status, node.error = UP_TO_DATE, None

    # --- charts and export ---------------------------------------------------

    def plot(self, kind: str, source: str, x: str | None = None, *ys: str, limit: int | None = None, order: Sequence[str] = ()) -> DataFrame:
        """A chart node ``plot:<source>``; returns its series."""
        self[source]
        name = f"plot:{source}"
        step = {"verb": "plot", "kind": kind, "source": source, "x": x, "ys": list(ys), "limit": limit, "order": list(order)}
        series = plot_series(self.table(source), x, ys, limit, order)
        self._put(Node(name, "plot", step, [source], UP_TO_DATE))
        return series

    def export(self, name: str, path: str, fmt: str = "csv", **options) -> str:
        return export(self.table(name), path, fmt, **options)

    # --- recomputation -------------------------------------------------------

    def mark_dirty(self, name: str) -> list[str]:
        """All descendants of a changed node turn Dirty."""
        self[name]
        self._steps.append({"verb": "mark_dirty", "name": name})
        return self._mark_below(name)

    def run(self, name: str | None = None) -> list[str]:
        """Recompute what is stale, parents first; returns the nodes that ran.

        With a name, only that node and its stale ancestors.  A failure sets
        Error on the node and leaves everything below it Dirty.
        """
        wanted = set(self._nodes)
        if name is not None:
            chain = [self[name].name]
            for current in chain:
                chain += [p for p in self._nodes[current].parents if p in self._nodes and p not in chain]
            wanted = set(chain)
        done, failed = [], set()
        for node in self._in_order():
            if node.name not in wanted or node.frozen:
                continue
            if failed & set(self._below_of(node)):
                node.status = DIRTY
                continue
            if node.status == UP_TO_DATE:
                continue
            started = time.monotonic()
            try:
                self._remake(node, started)
                done.append(node.name)
            except Exception as problem:  # noqa: BLE001 - any failure belongs to the node
                node.status, node.error = ERROR, str(problem).splitlines()[0]
                failed.add(node.name)
        self._steps.append({"verb": "run", "name": name})
        return done

    def _below_of(self, node: Node) -> list[str]:
        """All ancestors of a node."""
        chain = list(node.parents)
        for current in chain:
            chain += [p for p in self._nodes[current].parents if p not in chain] if current in self._nodes else []
        return chain

    def _in_order(self) -> list[Node]:
        order: dict[str, Node] = {}
        pending = dict(self._nodes)
        while pending:
            ready = [n for n in pending.values() if not any(p in pending for p in n.parents)]
            if not ready:  # a cycle: take what is left as it stands
                ready = list(pending.values())
            for node in ready:
                order[node.name] = pending.pop(node.name)
        return list(order.values())

    def _remake(self, node: Node, started: float) -> None:
        step = node.step
        if node.kind == "plot":
            self.series(node.name)
            node.status, node.error = UP_TO_DATE, None
        elif step["verb"] == "into":
            if step["file"] is None:
                raise ValueError(f"{node.name} was saved from a DataFrame and cannot be read again")
            options = {k: v for k, v in step.items() if k not in ("verb", "table", "file", "fmt")}
            self._save(read(self.spark, step["file"], step["fmt"], **options), node.name, "overwrite")
            self._ran(node, started)
        elif node.kind == "table":
            _, _, query = split_ctas(step["query"])
            self._save(self.spark.sql(query), node.name, "overwrite")
            self._ran(node, started)
        else:
            self._view(node.name, step["query"])
            self._ran(node, started)

    def series(self, name: str) -> DataFrame:
        """The series of a chart node."""
        s = self[name].step
        return plot_series(self.table(s["source"]), s["x"], s["ys"], s["limit"], s["order"])

    def freeze(self, name: str) -> int:
        """Materialise a query and exempt it from ``run``; returns its rows."""
        node, started = self[name], time.monotonic()
        if node.kind == "query":
            kept = self._frozen_name(name)
            self._view(name, node.step["query"])
            self._save(self.table(name), kept, "overwrite")
            self._view(name, f"SELECT * FROM {quoted(kept)}")
        node.frozen = True
        self._ran(node, started)
        self._steps.append({"verb": "freeze", "name": name})
        return node.rows

    @staticmethod
    def _frozen_name(name: str) -> str:
        # letters that a table name may not tell apart are spelled out, so no two names meet
        return "frozen__" + re.sub(r"[^a-z0-9]", lambda c: f"_{ord(c[0]):x}_", name)

    def trim(self, name: str) -> None:
        """Drop a node's data and keep its definition."""
        node = self[name]
        self._drop(node)
        if node.kind == "query":
            self._view(name, node.step["query"])
        node.status, node.rows, node.frozen = EMPTY, None, False
        self._steps.append({"verb": "trim", "name": name})
        self._mark_below(name)

    def _drop(self, node: Node) -> None:
        if node.kind == "table":
            self.spark.sql(f"DROP TABLE IF EXISTS {quoted(node.name)}")
        elif node.kind == "query":
            self.spark.catalog.dropTempView(node.name)
            self.spark.sql(f"DROP TABLE IF EXISTS {quoted(self._frozen_name(node.name))}")

    # --- lineage -------------------------------------------------------------

    def remove(self, name: str) -> list[str]:
        """Drop a node and its descendants, with their views and tables."""
        self[name]
        gone = self._below(name)
        for n in reversed(gone):
            self._drop(self._nodes.pop(n))
        self._steps.append({"verb": "remove", "name": name})
        return gone

    def clone(self, name: str, suffix: str = "_copy") -> list[str]:
        """Copy a node and its descendants; copies are Empty until run and read
        each other instead of the originals."""
        self[name]
        names = self._below(name)
        rename = {n: n + suffix for n in names}
        for old in names:
            node = self._nodes[old]
            step = dict(node.step)
            for key in ("name", "table", "source"):
                if step.get(key) in rename:
                    step[key] = rename[step[key]]
            if "query" in step:
                step["query"] = with_tables_renamed(self.spark, step["query"], rename)
            new = f"plot:{step['source']}" if node.kind == "plot" else rename[old]
            rename[old] = new
            self._put(Node(new, node.kind, step, [rename.get(p, p) for p in node.parents]), record=False)
        self._steps.append({"verb": "clone", "name": name, "suffix": suffix})
        return [rename[n] for n in names]

    def edit(self, name: str, query: str, suffix: str | None = None) -> list[str]:
        """Give a node another query; returns the nodes that are now to be run.

        In place (no ``suffix``) the node is Empty and what stands on it Dirty.
        With one, the node and its descendants are cloned and the copy edited;
        the originals stay as they are.
        """
        if self[name].kind == "plot" or "query" not in self[name].step:
            raise ValueError(f"{name} is not made by a query")
        if suffix is not None:
            copies = self.clone(name, suffix)
            self.edit(copies[0], query)
            return copies
        node = self[name]
        parents = self._known(references(self.spark, query), name)
        if set(parents) & set(self._below(name)):
            raise ValueError(f"{name} would read what is made from it")
        if node.kind == "table":
            made = split_ctas(node.step["query"])
            text = f"CREATE {'OR REPLACE ' if made[1] == 'overwrite' else ''}TABLE {quoted(name)} AS {query}"
            node.step = {**node.step, "query": text}
        else:
            self._view(name, query)
            node.step = {**node.step, "query": query}
        node.parents, node.status, node.rows, node.frozen, node.error = parents, EMPTY, None, False, None
        self._steps.append({"verb": "edit", "name": name, "query": query})
        return [name, *self._mark_below(name)]

    def nodes(self) -> DataFrame:
        rows = [
            (n.name, n.kind, n.parents, n.status, n.rows, n.seconds, n.last_run_at, n.frozen, json.dumps(n.step), n.error)
            for n in self._nodes.values()
        ]
        return self.spark.createDataFrame(rows, NODE_SCHEMA)

    def edges(self) -> DataFrame:
        rows = [(n.name, p) for n in self._nodes.values() for p in n.parents]
        return self.spark.createDataFrame(rows, "child string, parent string")

    # --- catalog -------------------------------------------------------------

    def tables(self) -> DataFrame:
        return self.spark.sql("SHOW TABLES").selectExpr("tableName AS name", "isTemporary AS temporary")

    def columns(self, table: str) -> DataFrame:
        rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(self.table(table).schema)]
        return self.spark.createDataFrame(rows, "ordinal int, column_name string, column_type string, nullable boolean")

    # --- templates -------------------------------------------------------------

    def template(self, name: str, sql: str, params: Sequence[str]) -> None:
        """A parameterised query.  Write ``:p`` for values and
        ``IDENTIFIER(:p)`` for tables and columns; both are bound, not pasted."""
        self._templates[name] = (sql, tuple(params))
        self._steps.append({"verb": "template", "name": name, "sql": sql, "params": list(params)})

    def run_template(self, name: str, **args) -> DataFrame:
        sql, params = self._templates[name]
        if set(args) != set(params):
            raise ValueError(f"{name} takes {', '.join(params)}")
        return self.spark.sql(sql, args=args)

    # --- replay ------------------------------------------------------------------

    def steps(self) -> DataFrame:
        """(ord, step): what was done, in order, as JSON."""
        rows = [(i, json.dumps(s)) for i, s in enumerate(self._steps)]
        return self.spark.createDataFrame(rows, "ord int, step string")

    def replay(self, steps: DataFrame | Sequence[str | dict]) -> None:
        """Do recorded steps again, in order."""
        if isinstance(steps, DataFrame):
            steps = [r["step"] for r in steps.orderBy("ord").collect()]
        for item in steps:
            step = dict(json.loads(item) if isinstance(item, str) else item)
            verb = step.pop("verb")
            if verb == "plot":
                self.plot(step["kind"], step["source"], step["x"], *step["ys"], limit=step["limit"], order=step["order"])
            elif verb == "into" and step["file"] is None:
                if step["table"] not in self._nodes:
                    raise ValueError(f"{step['table']} was saved from a DataFrame; import it before the replay")
            else:
                getattr(self, verb)(**step)

    # --- saving --------------------------------------------------------------------

    def save(self, path: str) -> int:
        """Write nodes, templates and steps as a new version below ``path``; returns
        its number.  Data stays where it is: tables are named by their location.

        A version appears whole or not at all, and earlier ones stay.  Of two
        savers at once one gets an error.
        """
        version = (_versions(self.spark, path) or 0) + 1
        records = [("workspace", json.dumps({"format": FORMAT, "location": self.location}))]
        for node in self._nodes.values():
            body = {**vars(node), "last_run_at": node.last_run_at and node.last_run_at.isoformat()}
            records.append(("node", json.dumps({**body, "data": self._data_of(node)})))
        for name, (sql, params) in self._templates.items():
            records.append(("template", json.dumps({"name": name, "sql": sql, "params": params})))
        records += [("step", json.dumps(step)) for step in self._steps]
        rows = [(i, part, body) for i, (part, body) in enumerate(records)]
        manifest = self.spark.createDataFrame(rows, MANIFEST_SCHEMA).coalesce(1)
        manifest.write.mode("error").json(f"{path.rstrip('/')}/version={version}")
        return version

    def _data_of(self, node: Node) -> str | None:
        """Where a saved table's files are."""
        name = node.name if node.kind == "table" else self._frozen_name(node.name) if node.frozen else None
        if name is None or not self.spark.catalog.tableExists(quoted(name)):
            return None
        described = self.spark.sql(f"DESCRIBE TABLE EXTENDED {quoted(name)}").where("col_name = 'Location'")
        return described.head()["data_type"]

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> Workspace:
        """The workspace as it was saved, the newest version unless one is named.

        Tables that the session's catalog does not know are attached from their
        files.  A node whose files are gone is Empty, what stands on it Dirty.
        """
        version = version or _versions(spark, path)
        if version is None:
            raise FileNotFoundError(f"no workspace is saved in {path}")
        rows = spark.read.schema(MANIFEST_SCHEMA).json(f"{path.rstrip('/')}/version={version}").orderBy("ord").collect()
        parts: dict[str, list[dict]] = {"workspace": [], "node": [], "template": [], "step": []}
        for row in rows:
            parts[row["part"]].append(json.loads(row["body"]))
        about = parts["workspace"][0]
        if about["format"] != FORMAT:
            raise ValueError(f"saved in format {about['format']}, not {FORMAT}")
        ws = cls(spark, about["location"])
        ws._templates = {t["name"]: (t["sql"], tuple(t["params"])) for t in parts["template"]}
        ws._steps = parts["step"]
        where = {}
        for body in parts["node"]:
            where[body["name"]] = body.pop("data")
            ran = body.pop("last_run_at")
            ws._nodes[body["name"]] = Node(**body, last_run_at=ran and datetime.fromisoformat(ran))
        for node in ws._in_order():
            ws._attach(node, where[node.name])
        return ws

    def _attach(self, node: Node, data: str | None) -> None:
        """Make a loaded node selectable by its name again."""
        held = node.name if node.kind == "table" else self._frozen_name(node.name) if node.frozen else None
        if held and not (data and self._attached(held, data)) and node.status != EMPTY:
            node.status, node.rows, node.frozen = EMPTY, None, False
            self._mark_below(node.name)
            held = None
        if node.kind == "query":
            try:
                self._view(node.name, f"SELECT * FROM {quoted(held)}" if held else node.step["query"])
            except AnalysisException as problem:  # a parent's data is gone: run() makes both again
                node.error = str(problem).splitlines()[0]

    def _attached(self, name: str, data: str) -> bool:
        if not self.spark.catalog.tableExists(quoted(name)):
            if "." in name:
                self.spark.sql(f"CREATE SCHEMA IF NOT EXISTS {quoted(name.rsplit('.', 1)[0])}")
            try:
                schema = self.spark.read.parquet(data).schema
            except AnalysisException:
                return False
            self.spark.catalog.createTable(quoted(name), data, "parquet", schema)
        return True


def _versions(spark: SparkSession, path: str) -> int | None:
    """The newest saved version below ``path``."""
    try:
        saved = spark.read.schema(f"{MANIFEST_SCHEMA}, version int").json(path.rstrip("/"))
        return saved.agg({"version": "max"}).head()[0]
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
