"""The entry point: a property graph, Cypher over it, a fluent API, and changes."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import EdgeTable, GraphCatalog
from .operators.store import settle
from .plans import ast as A
from .plans.builder import Builder, Expressions, Kind, Scope, c
from .plans.parser import CypherError, parse
from .relation import NodeQuery, PathQuery, Relation


class Prepared:
    def __init__(self, graph: Graph, text: str):
        self.graph, self.query = graph, parse(text)
        self.names = sorted({x.name for part in self.query.parts for y in part for x in A.walk(y) if isinstance(x, A.Param)})

    def execute(self, params: dict[str, Any] | None = None) -> Relation:
        return self.graph.run(self.query, params)


class Graph:
    """A catalog of DataFrames; each change puts new DataFrames in place of old ones."""

    def __init__(self, spark: SparkSession, catalog: GraphCatalog | None = None):
        self.spark = spark
        self.catalog = catalog or GraphCatalog(spark)

    # -- queries
    def sql(self, text: str, params: dict[str, Any] | None = None) -> Relation:
        """A lazy relation of a Cypher query; parameters are bound as values, never as text."""
        return self.run(parse(text), params)

    def execute(self, text: str, params: dict[str, Any] | None = None) -> Relation:
        return self.run(parse(text), params)

    def executemany(self, text: str, many: Iterable[dict[str, Any]]) -> list[Relation]:
        q = parse(text)
        return [self.run(q, p) for p in many]

    def prepare(self, text: str) -> Prepared:
        return Prepared(self, text)

    def run(self, q: A.Query, params: dict[str, Any] | None = None) -> Relation:
        if any(isinstance(x, (A.Create, A.Merge, A.SetProps, A.Remove, A.Delete, A.Foreach)) for part in q.parts for x in part):
            done = 0
            for part in q.parts:
                done += Changes(self, params or {}).apply(part)
            return Relation(self, self.spark.createDataFrame([("ok", done)], "status string, changes int"))
        df = Builder(self.catalog, params).query(q)
        return Relation(self, df, (q, params))

    def explain(self, text: str, params: dict[str, Any] | None = None, mode: str = "formatted") -> str:
        df = Builder(self.catalog, params).query(parse(text))
        return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)

    # -- fluent
    def node(self, label: str | None = None) -> NodeQuery:
        return NodeQuery(self, label)

    def path(self, start: dict, end: dict, label: str, types: str | None = None, max_hops: int | None = None) -> PathQuery:
        return PathQuery(self, label, start, end, types, max_hops)

    # -- catalog
    def labels(self) -> list[str]:
        return self.catalog.labels()

    def relationship_types(self) -> list[str]:
        return self.catalog.relationship_types()

    def schema(self) -> dict:
        return self.catalog.schema()

    def analyze(self) -> dict[str, int]:
        """Row counts by label and type."""
        out = {n: v.df.count() for n, v in self.catalog.vertices.items()}
        return out | {f"{t.src}-[{n}]->{t.dst}": self.catalog.edge_frame(t).count() for n, own in self.catalog.edges.items() for t in own}

    # -- the rest of the connection's surface
    def begin(self) -> None:
        """Each statement is a transaction of its own; begin, commit and rollback do nothing."""

    commit = rollback = begin

    def cursor(self) -> Cursor:
        return Cursor(self)

    def clear_delta(self) -> None:
        """Nothing to clear: a change replaces tables, it leaves no delta."""

    def interrupt(self) -> None:
        self.spark.sparkContext.cancelAllJobs()

    def query_progress(self) -> list[int]:
        return list(self.spark.sparkContext.statusTracker().getActiveJobsIds())

    def set_max_threads(self, n: int) -> None:
        self.spark.conf.set("spark.sql.shuffle.partitions", n)

    def checkpoint(self, path: str | None = None) -> None:
        """Settles all tables: in a workspace at path, or in the shared folder."""
        if path:
            from .sources.workspace import save

            save(self, path)
            return
        for v in self.catalog.vertices.values():
            v.df = settle(v.df, v.name)
        for own in self.catalog.edges.values():
            for t in own:
                if t.df is not None:
                    t.df = settle(t.df, t.type)

    def register_function(self, name: str, f: Any, kind: str = "string") -> None:
        """A scalar of one's own: a Python function of Columns, or a pandas_udf."""
        from .functions.registry import SCALAR

        del kind
        SCALAR[name.lower()] = f


class Changes:
    """CREATE, MERGE, SET, REMOVE, DELETE and FOREACH as new DataFrames in the catalog.

    The rows that a statement matches are settled before anything changes."""

    def __init__(self, graph: Graph, params: dict[str, Any]):
        self.graph, self.catalog, self.params = graph, graph.catalog, params
        self.builder = Builder(self.catalog, params)

    def apply(self, part: list) -> int:
        spark = self.graph.spark
        self.builder.note_use(part)
        for x in part:
            for y in A.walk(x):
                if isinstance(y, (A.NodePattern, A.RelPattern)):
                    self.builder.wanted.add(y.var)
        scope = Scope(spark.range(1).select(F.lit(1).alias(" one")), {})
        changes = 0
        for clause in part:
            if isinstance(clause, A.Match):
                scope = self.builder.match_clause(scope, clause)
            elif isinstance(clause, A.Projection) and not clause.final:
                scope = self.builder.project(scope, clause)
            elif isinstance(clause, A.Projection):
                continue
            elif isinstance(clause, A.Unwind):
                scope, x = self.builder.value(scope, clause.expr)
                scope = Scope(scope.df.withColumn(clause.alias, F.explode(x)), scope.vars | {clause.alias: Kind("value")})
            else:
                scope = Scope(settle(scope.df, "rows"), scope.vars)
                changes += 1
                scope = getattr(self, type(clause).__name__.lower())(scope, clause)
        return changes

    def value(self, scope: Scope, x: Any) -> Column:
        return Expressions(self.builder, scope, {}, None).of(x)

    def next_id(self, label: str) -> int:
        v = self.catalog.vertices.get(label)
        if v is None:
            return 1
        got = v.df.agg(F.max("_id")).first()[0]
        if got is not None and not isinstance(got, int):
            raise CypherError(f"ids of {label} are no numbers: new vertices need theirs given")
        return (got or 0) + 1

    def numbered(self, df: DataFrame, first: int, name: str) -> DataFrame:
        """Rows with numbers from first on, without bringing them to one task: the driver sees one count a partition."""
        placed = settle(df.withColumn(" place", F.monotonically_increasing_id()), "numbered")
        part = F.shiftright(c(" place"), 33)
        counts = {r["p"]: r["count"] for r in placed.groupBy(part.alias("p")).count().collect()}
        starts, at = [], first
        for k in range(max(counts, default=-1) + 1):
            starts.append(at)
            at += counts.get(k, 0)
        start = F.get(F.lit(starts), part.cast("int")) if starts else F.lit(first)
        return placed.withColumn(name, (start + c(" place").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop(" place")

    def create(self, scope: Scope, clause: A.Create) -> Scope:
        for p in clause.paths:
            for n in p.nodes:
                if n.var not in scope.vars:
                    scope = self.create_node(scope, n)
            for k, r in enumerate(p.rels):
                a, b = (p.nodes[k], p.nodes[k + 1]) if r.direction != "in" else (p.nodes[k + 1], p.nodes[k])
                self.create_edge(scope, r, a.var, b.var)
        return scope

    def create_node(self, scope: Scope, n: A.NodePattern) -> Scope:
        if len(n.labels) != 1:
            raise CypherError("CREATE needs one label")
        label = n.labels[0]
        own = self.catalog.vertices.get(label)
        df = settle(self.numbered(scope.df, self.next_id(label), f"{n.var}@_id"), "created")
        props = {k: self.value(scope, x) for k, x in n.props}
        df = df.withColumns({f"{n.var}@{k}": x for k, x in props.items()} | {f"{n.var}@_label": F.lit(label)})
        new = df.select(c(f"{n.var}@_id").alias("_id"), *(c(f"{n.var}@{k}").alias(k) for k in props))
        if own is None:
            self.catalog.add_vertices(label, new)
        else:
            kinds = {f.name: f.dataType for f in own.df.schema}
            new = new.select(*(c(x).cast(kinds[x]).alias(x) if x in kinds else c(x) for x in new.columns))
            own.df = own.df.unionByName(new, allowMissingColumns=True)
        return Scope(df, scope.vars | {n.var: Kind("node", {}, (label,))})

    def create_edge(self, scope: Scope, r: A.RelPattern, a: str, b: str) -> None:
        if len(r.types) != 1:
            raise CypherError("CREATE needs one type")
        (src,), (dst,) = scope.vars[a].labels[:1], scope.vars[b].labels[:1]
        new = scope.df.select(c(f"{a}@_id").alias("_sid"), c(f"{b}@_id").alias("_tid"), *(self.value(scope, x).alias(k) for k, x in r.props))
        table = next((t for t in self.catalog.edges.get(r.types[0], []) if (t.src, t.dst) == (src, dst)), None)
        first = 1
        if table is not None and table.key:
            table.df, table.key = self.catalog.edge_frame(table), None
        if table is not None:
            first = (table.df.agg(F.max("_eid")).first()[0] or 0) + 1
        new = settle(self.numbered(new, first, "_eid"), "created")
        if table is None:
            self.catalog.edges.setdefault(r.types[0], []).append(EdgeTable(r.types[0], src, dst, new))
        else:
            table.df = table.df.unionByName(new, allowMissingColumns=True)

    def merge(self, scope: Scope, clause: A.Merge) -> Scope:
        """Row by row: vertices with the row's properties where there are any, else one new vertex for all rows of these properties."""
        n, label = clause.node, clause.node.labels[0]
        if n.var in scope.vars:
            raise CypherError(f"{n.var} is bound already")
        names = {k: self.builder.new("m") for k, _ in n.props}
        df = settle(scope.df.withColumns({names[k]: self.value(scope, x) for k, x in n.props}), "merge")
        known = self.catalog.vertices.get(label)
        wanted = df.select(*map(c, names.values())).distinct() if names else df.limit(1).select(F.lit(1).alias(" one"))
        same = lambda left, right, eq: reduce(lambda p, q: p & q, (eq(left(k), right(k)) for k in names), F.lit(True))
        if known is not None and set(names) <= set(known.df.columns):
            have = known.df.select(*(c(k).alias(f" have {k}") for k in names))
            wanted = wanted.join(have, same(lambda k: c(names[k]), lambda k: c(f" have {k}"), lambda p, q: p == q), "left_anti")
        pattern = replace(n, props=tuple((k, A.Var(v)) for k, v in names.items()))
        made = self.create_node(Scope(settle(wanted, "unmatched"), {v: Kind("value") for v in names.values()}), pattern)
        fresh = made.df.select(c(f"{n.var}@_id").alias(" new"))
        frame = self.builder.vertex_frame([label], True)
        frame = frame.select(*(c(x).alias(f"{n.var}@{x}") for x in frame.columns)).join(fresh, c(f"{n.var}@_id") == c(" new"), "left")
        bound = df.join(frame, same(lambda k: c(names[k]), lambda k: c(f"{n.var}@{k}"), lambda p, q: p.eqNullSafe(q))).drop(*names.values())
        out = Scope(settle(bound, "merged"), scope.vars | {n.var: Kind("node", {}, (label,))})
        for items, rows in ((clause.on_match, c(" new").isNull()), (clause.on_create, c(" new").isNotNull())):
            if items:
                self.setprops(replace(out, df=out.df.where(rows)), A.SetProps(items))
        return replace(out, df=out.df.drop(" new"))

    def setprops(self, scope: Scope, clause: A.SetProps) -> Scope:
        by: dict[str, dict[str, Any]] = {}
        for var, prop, x in clause.items:
            by.setdefault(var, {})[prop] = x
        for var, props in by.items():
            kind = scope.vars[var]
            key = "_id" if kind.what == "node" else "_eid"
            for own in kind.labels:
                at = "_label" if kind.what == "node" else "_type"
                rows = scope.df.where(c(f"{var}@{at}") == own)
                values = rows.select(c(f"{var}@{key}").alias(" k"), F.lit(True).alias(" hit"), *(self.value(scope, x).alias(f" {p}") for p, x in props.items())).dropDuplicates([" k"])
                holders = [self.catalog.vertices[own]] if kind.what == "node" else [t for t in self.catalog.edges[own] if t.df is not None]
                for h in holders:
                    h.df = self.updated(h.df, values, key, list(props))
        return scope

    def updated(self, df: DataFrame, values: DataFrame, key: str, props: list[str]) -> DataFrame:
        values = settle(values, "set")
        joined = df.join(values, c(key) == c(" k"), "left")
        kinds = {f.name: f.dataType for f in df.schema}
        new = {p: F.when(c(" hit"), c(f" {p}").cast(kinds[p]) if p in kinds else c(f" {p}")).otherwise(c(p) if p in kinds else F.lit(None)) for p in props}
        return joined.withColumns(new).drop(" k", " hit", *(f" {p}" for p in props))

    def remove(self, scope: Scope, clause: A.Remove) -> Scope:
        return self.setprops(scope, A.SetProps([(v, p, A.Lit(None)) for v, p in clause.items]))

    def delete(self, scope: Scope, clause: A.Delete) -> Scope:
        """Deleting a vertex takes its edges along, with DETACH or without."""
        for var in clause.names:
            kind = scope.vars[var]
            if kind.what == "rel":
                for t in (t for n in kind.labels for t in self.catalog.edges[n]):
                    gone = settle(scope.df.where((c(f"{var}@_type") == t.type) & (c(f"{var}@_slabel") == t.src)).select(c(f"{var}@_eid").alias("_eid")).distinct(), "deleted")
                    t.df, t.key = self.catalog.edge_frame(t).join(gone, "_eid", "left_anti"), None
                continue
            for label in kind.labels:
                gone = settle(scope.df.where(c(f"{var}@_label") == label).select(c(f"{var}@_id").alias("_id")).distinct(), "deleted")
                for t in (t for own in self.catalog.edges.values() for t in own):
                    for end, at in ((t.src, "_sid"), (t.dst, "_tid")):
                        if end == label and not (t.key and at == "_sid"):
                            t.df = self.catalog.edge_frame(t).join(gone.withColumnRenamed("_id", at), at, "left_anti")
                            t.key = None
                v = self.catalog.vertices[label]
                v.df = v.df.join(gone, "_id", "left_anti")
        return scope

    def foreach(self, scope: Scope, clause: A.Foreach) -> Scope:
        inner = Scope(scope.df.withColumn(clause.var, F.explode(self.value(scope, clause.source))), scope.vars | {clause.var: Kind("value")})
        for x in clause.body:
            inner = Scope(settle(inner.df, "rows"), inner.vars)
            inner = getattr(self, type(x).__name__.lower())(inner, x)
        return scope


class Cursor:
    """execute, then fetch: the surface of a database cursor."""

    def __init__(self, graph: Graph):
        self.graph, self.result = graph, None

    def execute(self, text: str, params: dict[str, Any] | None = None) -> Cursor:
        self.result = self.graph.execute(text, params).execute()
        return self

    @property
    def description(self) -> list[tuple]:
        return [] if self.result is None else list(zip(self.result.columns, self.result.types, strict=True))

    def fetchone(self) -> tuple | None:
        return self.result.fetchone()

    def fetchmany(self, n: int = 1) -> list[tuple]:
        return self.result.fetchmany(n)

    def fetchall(self) -> list[tuple]:
        out = []
        while (row := self.result.fetchone()) is not None:
            out.append(row)
        return out

    def close(self) -> None:
        self.result = None


def connect(spark: SparkSession, path: str | None = None) -> Graph:
    """The graph of a workspace, or an empty one."""
    if path is None:
        return Graph(spark)
    from .sources.workspace import load

    return load(spark, path)
