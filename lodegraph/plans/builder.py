"""Clauses to DataFrames.

A scope is a DataFrame and what its columns mean.  A node variable a has columns a@_id, a@_label and a@property;
a relationship r has r@_eid, r@_type, r@_sid, r@_tid, r@_slabel, r@_tlabel and r@property; a path p has p@nodes and p@rels; a value
has one column of its name.  Everything is declared; Catalyst prunes columns, pushes filters and orders joins.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import EdgeTable, GraphCatalog
from ..functions.registry import AGGREGATE, SCALAR, list_extract, list_slice
from ..operators.store import same_rows
from . import ast as A
from .parser import CypherError


def c(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass
class Kind:
    """What a variable is: node, rel, path, value, or rels (of a variable-length relationship)."""

    what: str
    props: dict[str, Any] = field(default_factory=dict)
    labels: tuple[str, ...] = ()  # leaf labels, or types


@dataclass
class Scope:
    df: DataFrame
    vars: dict[str, Kind]
    order: tuple[tuple[str, bool], ...] = ()  # columns that a WITH has sorted the rows by, and whether they ascend

    def columns_of(self, name: str) -> list[str]:
        if self.vars[name].what == "value":
            return [name]
        return [x for x in self.df.columns if x.startswith(name + "@")]


ID = {"node": "_id", "rel": "_eid"}
SIZES = ("size", "list_size", "array_length")


class Builder:
    def __init__(self, catalog: GraphCatalog, params: dict[str, Any] | None = None, max_hops: int = 30):
        self.catalog, self.params, self.max_hops = catalog, params or {}, max_hops
        self.fresh = 0
        self.wanted: set[str] = set()

    def new(self, stem: str = "x") -> str:
        self.fresh += 1
        return f" {stem}{self.fresh}"

    # -- whole queries
    def query(self, q: A.Query) -> DataFrame:
        frames = []
        for part in q.parts:
            self.note_use(part)
            frames.append(self.single(part))
        out = frames[0]
        for df, every in zip(frames[1:], q.all, strict=True):
            out = out.unionByName(df) if every else out.unionByName(df).distinct()
        return out

    def note_use(self, part: list) -> None:
        """Variables of which properties are read, or which are given out whole: only these need their vertices joined."""
        for clause in part:
            for x in A.walk(clause):
                if isinstance(x, A.Prop) and isinstance(x.of, A.Var):
                    self.wanted.add(x.of.name)
                elif isinstance(x, A.Call):
                    self.wanted.update(y.name for y in x.args if isinstance(y, A.Var) and x.name not in ("count", "id", "labels", "type", "elementid"))
                elif isinstance(x, (A.ListOf, A.MapOf, A.Case, A.Index, A.Comprehension, A.Unwind)):
                    self.wanted.update(y.name for y in A.children(x) if isinstance(y, A.Var))
                elif isinstance(x, A.NodePattern) and x.props:
                    self.wanted.add(x.var)
                elif isinstance(x, A.Projection):
                    self.wanted.update(i.expr.name for i in x.items if isinstance(i.expr, A.Var) and (x.final or i.alias != i.expr.name))
                    if x.star and x.final:
                        self.wanted.update(y.var for z in part for y in A.walk(z) if isinstance(y, (A.NodePattern, A.RelPattern)))

    def single(self, part: list) -> DataFrame:
        scope = Scope(self.catalog.spark.range(1).select(F.lit(1).alias(" one")), {})
        for clause in part:
            if isinstance(clause, A.Match):
                scope = self.match_clause(scope, clause)
            elif isinstance(clause, A.Projection):
                scope = self.project(scope, clause)
            elif isinstance(clause, A.Unwind):
                scope, x = self.value(scope, clause.expr)
                scope = Scope(scope.df.withColumn(clause.alias, F.explode(x)), scope.vars | {clause.alias: Kind("value")})
            else:
                raise CypherError(f"{type(clause).__name__} changes the graph: use Graph.execute")
        return self.output(scope, part[-1])

    def output(self, scope: Scope, last: Any) -> DataFrame:
        if not (isinstance(last, A.Projection) and last.final):
            raise CypherError("a query ends with RETURN")
        names = list(scope.vars)
        return scope.df.select(*(self.whole(scope, n).alias(n) for n in names))

    def whole(self, scope: Scope, name: str) -> Column:
        """A variable as one value."""
        kind = scope.vars[name]
        if kind.what == "value":
            return c(name)
        if kind.what in ("path", "rels"):
            return F.struct(c(f"{name}@nodes").alias("nodes"), c(f"{name}@rels").alias("rels")) if kind.what == "path" else c(f"{name}@rels")
        fields = [c(x).alias(x.split("@", 1)[1]) for x in scope.columns_of(name)]
        return F.when(c(f"{name}@{ID[kind.what]}").isNotNull(), F.struct(*fields))

    # -- MATCH
    def vertex_frame(self, labels: list[str], props: bool) -> DataFrame:
        frames = []
        mixed = len({self.catalog.vertices[n].df.schema["_id"].dataType.simpleString() for n in labels}) > 1
        for n in labels:
            df = self.catalog.vertices[n].df
            key = c("_id")
            if mixed:  # ids of several types meet as text
                key = F.to_json(key) if isinstance(df.schema["_id"].dataType, T.StructType) else key.cast("string")
            own = [key.alias("_id"), F.lit(n).alias("_label")] + [c(p) for p in self.catalog.vertices[n].props if props]
            frames.append(df.select(*own))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    def match_clause(self, scope: Scope, m: A.Match) -> Scope:
        if not m.optional:
            out = self.match(scope, m.paths, m.where)
            return self.filtered(out, m.where) if m.where is not None else out
        return self.optional(scope, m)

    def keys_for(self, scope: Scope, *parts: Any) -> list[str]:
        """Columns of the scope that the given patterns and expressions look at."""
        names = {x.name for p in parts for x in A.walk(p) if isinstance(x, A.Var)} | {x.var for p in parts for x in A.walk(p) if isinstance(x, (A.NodePattern, A.RelPattern))}
        read = {(x.of.name, x.name) for p in parts for x in A.walk(p) if isinstance(x, A.Prop) and isinstance(x.of, A.Var)}
        out = []
        for n in names & set(scope.vars):
            kind = scope.vars[n].what
            if kind in ID:
                fixed = ("_id", "_label") if kind == "node" else ("_eid", "_type", "_sid", "_tid", "_slabel", "_tlabel")
                keys = {self.expand_key(scope, n)} if kind == "node" else set()
                out += [x for x in scope.columns_of(n) if x.split("@", 1)[1] in fixed or (n, x.split("@", 1)[1]) in read or x in keys or any(x.endswith("@" + t.key) for t in self.catalog.tables(()) if t.key)]
            else:
                out += scope.columns_of(n)
        return list(dict.fromkeys(out))

    def expand_key(self, scope: Scope, name: str) -> str:
        return f"{name}@_id"

    def optional(self, scope: Scope, m: A.Match) -> Scope:
        keys = self.keys_for(scope, *m.paths, *([m.where] if m.where is not None else []))
        seed = Scope(scope.df.select(*map(c, keys)).distinct() if keys else self.catalog.spark.range(1).select(F.lit(1).alias(" one")), {n: k for n, k in scope.vars.items() if any(x == n or x.startswith(n + "@") for x in keys)})
        inner = self.match(seed, m.paths, m.where)
        if m.where is not None:
            inner = self.filtered(inner, m.where)
        new = {n: k for n, k in inner.vars.items() if n not in scope.vars}
        added = [x for n in new for x in inner.columns_of(n)]
        names = {k: self.new("k") for k in keys}
        right = inner.df.select(*(c(k).alias(v) for k, v in names.items()), *map(c, added), *([] if keys or added else [c(" one")]))
        cond = reduce(lambda a, b: a & b, (c(k).eqNullSafe(c(v)) for k, v in names.items()), F.lit(True))
        df = scope.df.join(right, cond, "left").drop(*names.values())
        return Scope(df, scope.vars | new)

    def match(self, scope: Scope, paths: list, where: Any = None) -> Scope:
        hops: list[tuple[str, list[EdgeTable]]] = []
        # paths with a bound variable come first, so that disconnected parts are joined as late as can be
        labels = {n.var: n.labels for p in paths for n in p.nodes if n.labels}
        todo = [replace(p, nodes=tuple(n if n.labels else replace(n, labels=labels.get(n.var, ())) for n in p.nodes)) for p in paths]
        while todo:
            bound = set(scope.vars)
            todo.sort(key=lambda p: (bool(p.shortest), not any(n.var in bound for n in p.nodes)))
            p = todo.pop(0)
            scope = self.shortest(scope, p, where) if p.shortest else self.path(scope, p, hops)
        for i, (r, one) in enumerate(hops):
            for q, two in hops[:i]:
                if any(a is b for a in one for b in two):
                    scope = replace(scope, df=scope.df.where(self.unlike(scope, (r, one), (q, two))))
        return scope

    def unlike(self, scope: Scope, r: tuple[str, list[EdgeTable]], q: tuple[str, list[EdgeTable]]) -> Column:
        """Relationships of one MATCH have no edge in common."""
        single = {x: scope.vars[x].what == "rel" for x, _ in (r, q)}
        if all(single.values()):
            (r, _), (q, _) = r, q
            return (c(f"{r}@_eid") != c(f"{q}@_eid")) | (c(f"{r}@_type") != c(f"{q}@_type")) | (c(f"{r}@_slabel") != c(f"{q}@_slabel"))

        def names(var: str, tables: list[EdgeTable]) -> Column:
            """The edges as text that tells tables apart, as in steps."""
            if single[var]:
                return F.array(F.concat_ws(":", c(f"{var}@_type"), c(f"{var}@_slabel"), c(f"{var}@_eid").cast("string")))
            if len(tables) > 1:
                return c(f"{var}@rels")
            t = tables[0]
            return F.transform(c(f"{var}@rels"), lambda e: F.concat_ws(":", F.lit(t.type), F.lit(t.src), e.cast("string")))

        return ~F.arrays_overlap(names(*r), names(*q))

    def path(self, scope: Scope, p: A.PathPattern, hops: list) -> Scope:
        nodes, rels = list(p.nodes), list(p.rels)
        start = next((k for k, n in enumerate(nodes) if n.var in scope.vars), None)
        if start is None:  # begin where the pattern says most
            start = max(range(len(nodes)), key=lambda k: (bool(nodes[k].props), bool(nodes[k].labels), -k))
        scope = self.node(scope, nodes[start], self.hints(nodes, rels, start))
        for k in range(start, len(rels)):
            scope = self.hop(scope, nodes[k], rels[k], nodes[k + 1], rels[k].direction, hops)
        for k in range(start - 1, -1, -1):
            turned = {"out": "in", "in": "out", "both": "both"}[rels[k].direction]
            scope = self.hop(scope, nodes[k + 1], rels[k], nodes[k], turned, hops)
        if p.var:
            parts_n, parts_r = [], []
            ids = F.array(c(f"{nodes[0].var}@_id"))
            for k, r in enumerate(rels):
                if scope.vars[r.var].what == "rels":
                    own = c(f"{r.var}@rels"), c(f"{r.var}@nodes")
                    if r.least is not None and k < start:
                        own = F.reverse(own[0]), F.reverse(own[1])
                    parts_r.append(own[0])
                    parts_n.append(F.slice(own[1], 2, F.greatest(F.size(own[1]) - 1, F.lit(0))))
                else:
                    parts_r.append(F.array(c(f"{r.var}@_eid")))
                    parts_n.append(F.array(c(f"{nodes[k + 1].var}@_id")))
            empty = F.slice(ids, 1, 0)
            df = scope.df.withColumn(f"{p.var}@nodes", F.concat(ids, *parts_n)).withColumn(f"{p.var}@rels", F.concat(*parts_r) if parts_r else empty)
            labels = tuple(x for n in nodes for x in scope.vars[n.var].labels)
            types = tuple(t for r in rels for t in r.types)
            scope = Scope(df, scope.vars | {p.var: Kind("path", {"types": types}, tuple(dict.fromkeys(labels)))})
        return scope

    def hints(self, nodes: list, rels: list, k: int) -> list[str] | None:
        """Labels that the neighbouring relationships leave to an unlabelled node."""
        if nodes[k].labels or not rels:
            return None
        allowed = None
        for r, out in ([(rels[k], rels[k].direction)] if k < len(rels) else []) + ([(rels[k - 1], {"out": "in", "in": "out", "both": "both"}[rels[k - 1].direction])] if k else []):
            own = {x for t in self.catalog.tables(r.types) for x in ((t.src,) if out == "out" else (t.dst,) if out == "in" else (t.src, t.dst))}
            allowed = own if allowed is None else allowed & own
        return sorted(allowed)

    def node(self, scope: Scope, n: A.NodePattern, hint: list[str] | None = None) -> Scope:
        if n.var in scope.vars:
            df = scope.df
            if n.labels:
                leaves = self.catalog.leaves(n.labels)
                if not set(scope.vars[n.var].labels) <= set(leaves):
                    df = df.where(c(f"{n.var}@_label").isin(*leaves))
            return self.with_props(Scope(df, scope.vars), n.var, n.props)
        leaves = hint if hint is not None and not n.labels else self.catalog.leaves(n.labels)
        if not leaves:
            raise CypherError(f"no label fits {n.var.strip() or 'a node'}")
        frame = self.vertex_frame(leaves, True)
        frame = frame.select(*(c(x).alias(f"{n.var}@{x}") for x in frame.columns))
        kind = Kind("node", {}, tuple(leaves))
        outer = tuple(x for x in n.props if any(isinstance(y, A.Var) and y.name in scope.vars for y in A.walk(x[1])))
        own = self.with_props(Scope(frame, {n.var: kind}), n.var, tuple(x for x in n.props if x not in outer))
        if not scope.vars:
            return own
        # with conditions on outer variables this becomes an equi-join
        return self.with_props(Scope(scope.df.crossJoin(own.df), scope.vars | {n.var: kind}), n.var, outer)

    def with_props(self, scope: Scope, var: str, props: tuple) -> Scope:
        for key, expr in props:
            if f"{var}@{key}" not in scope.df.columns:
                raise CypherError(f"no property {key}")
            scope, x = self.value(scope, expr)
            scope = replace(scope, df=scope.df.where(c(f"{var}@{key}") == x))
        return scope

    def hop(self, scope: Scope, a: A.NodePattern, r: A.RelPattern, b: A.NodePattern, direction: str, hops: list) -> Scope:
        if r.least is not None:
            hops.append((r.var, list({id(t): t for t in self.catalog.tables(r.types)}.values())))
            return self.varlen(scope, a, r, b, direction)
        bound = b.var in scope.vars
        start, ends = set(scope.vars[a.var].labels), set(scope.vars[b.var].labels if bound else self.catalog.leaves(b.labels))
        options: list[tuple[EdgeTable, bool]] = []
        for t in self.catalog.tables(r.types):
            if direction in ("out", "both") and t.src in start and t.dst in ends:
                options.append((t, True))
            if direction in ("in", "both") and t.dst in start and t.src in ends:
                options.append((t, False))
        if not options:
            raise CypherError(f"no edges of {'|'.join(r.types) or 'any type'} fit here")
        hops.append((r.var, [t for t, _ in options]))
        if len(options) == 1 and options[0][0].key and not r.props and direction != "both":
            return self.key_hop(scope, a, r, b, *options[0], bound)
        edges = self.rel_frame(r, options)
        labels = tuple(dict.fromkeys(t.dst if out else t.src for t, out in options))
        kind_r = Kind("rel", {}, tuple(dict.fromkeys(t.type for t, _ in options)))
        cond = c(f"{a.var}@_id") == c(" from")
        if len(start) > 1:
            cond &= c(f"{a.var}@_label") == c(" flabel")
        if bound:
            cond &= c(f"{b.var}@_id") == c(" to")
            if len(scope.vars[b.var].labels) > 1:
                cond &= c(f"{b.var}@_label") == c(" tlabel")
            df = scope.df.join(edges, cond).drop(" from", " to", " flabel", " tlabel")
            out = Scope(df, scope.vars | {r.var: kind_r})
            return self.with_props(self.node(out, b), r.var, r.props)
        df = scope.df.join(edges, cond)
        vars_ = scope.vars | {r.var: kind_r, b.var: Kind("node", {}, labels)}
        if b.var in self.wanted or b.props or len(labels) > 1 and b.var in self.wanted or self.has_key(labels):
            frame = self.vertex_frame(list(labels), True)
            frame = frame.select(*(c(x).alias(f"{b.var}@{x}") for x in frame.columns))
            cond = c(" to") == c(f"{b.var}@_id")
            if len(labels) > 1:
                cond &= c(" tlabel") == c(f"{b.var}@_label")
            df = df.join(frame, cond)
        else:
            df = df.withColumn(f"{b.var}@_id", c(" to")).withColumn(f"{b.var}@_label", c(" tlabel"))
        out = Scope(df.drop(" from", " to", " flabel", " tlabel"), vars_)
        return self.with_props(self.with_props(out, b.var, b.props), r.var, r.props)

    def has_key(self, labels: tuple[str, ...]) -> bool:
        return any(t.key and t.src in labels for t in self.catalog.tables(()))

    def key_hop(self, scope: Scope, a, r, b, t: EdgeTable, out: bool, bound: bool) -> Scope:
        """A hop over a foreign key: one join with the other side, or none."""
        src, dst = (a.var, b.var) if out else (b.var, a.var)
        df, vars_ = scope.df, dict(scope.vars)
        if bound:
            df = df.where(c(f"{src}@{t.key}") == c(f"{dst}@_id"))
        else:
            label = t.dst if out else t.src
            need = b.var in self.wanted or b.props or not out or self.has_key((label,))
            if need:
                frame = self.vertex_frame([label], True)
                frame = frame.select(*(c(x).alias(f"{b.var}@{x}") for x in frame.columns))
                df = df.join(frame, c(f"{src}@{t.key}") == c(f"{dst}@_id"))
            else:
                df = df.where(c(f"{src}@{t.key}").isNotNull()).withColumn(f"{b.var}@_id", c(f"{src}@{t.key}")).withColumn(f"{b.var}@_label", F.lit(label))
            vars_[b.var] = Kind("node", {}, (label,))
        one = {"_eid": c(f"{src}@_id"), "_type": F.lit(t.type), "_sid": c(f"{src}@_id"), "_tid": c(f"{dst}@_id"), "_slabel": F.lit(t.src), "_tlabel": F.lit(t.dst)}
        df = df.withColumns({f"{r.var}@{k}": v for k, v in one.items()})
        vars_[r.var] = Kind("rel", {}, (t.type,))
        scope = Scope(df, vars_)
        return self.node(scope, b) if bound else self.with_props(scope, b.var, b.props)

    def rel_frame(self, r: A.RelPattern, options: list[tuple[EdgeTable, bool]]) -> DataFrame:
        frames = []
        both = {id(t) for t, out in options if out} & {id(t) for t, out in options if not out}
        for t, out in options:
            df = self.catalog.edge_frame(t)
            if id(t) in both and not out:
                df = df.where("_sid <> _tid")  # a loop counts once
            ends = (c("_sid"), c("_tid"), F.lit(t.src), F.lit(t.dst))
            f, g, fl, gl = ends if out else (ends[1], ends[0], ends[3], ends[2])
            own = {"_eid": c("_eid"), "_type": F.lit(t.type), "_sid": c("_sid"), "_tid": c("_tid"), "_slabel": F.lit(t.src), "_tlabel": F.lit(t.dst)} | {p: c(p) for p in t.props}
            frames.append(df.select(f.alias(" from"), g.alias(" to"), fl.alias(" flabel"), gl.alias(" tlabel"), *(v.alias(f"{r.var}@{k}") for k, v in own.items())))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    # -- paths of variable length
    def steps(self, r: A.RelPattern, direction: str) -> tuple[DataFrame, list[EdgeTable]]:
        tables = self.catalog.tables(r.types)
        options = [(t, True) for t in tables if direction in ("out", "both")] + [(t, False) for t in tables if direction in ("in", "both")]
        edges = self.rel_frame(r, options)
        for key, expr in r.props:
            edges = edges.where(c(f"{r.var}@{key}") == self.constant(expr))
        one = c(f"{r.var}@_eid") if len(tables) == 1 else F.concat_ws(":", c(f"{r.var}@_type"), c(f"{r.var}@_slabel"), c(f"{r.var}@_eid").cast("string"))
        return edges.select(" from", " flabel", " to", " tlabel", one.alias(" eid")), tables

    def varlen(self, scope: Scope, a, r, b, direction: str) -> Scope:
        """Trails: no edge twice.  One row a path."""
        from ..operators.paths import trails

        edges, tables = self.steps(r, direction)
        bound = b.var in scope.vars
        seeds = scope.df.select(c(f"{a.var}@_id").alias(" s"), c(f"{a.var}@_label").alias(" sl")).distinct()
        found = trails(seeds, edges, r.least, r.most, self.max_hops)
        leaves = list(scope.vars[b.var].labels) if bound else self.catalog.leaves(b.labels)
        reach = {t.dst for t in tables if direction != "in"} | {t.src for t in tables if direction != "out"} | (set(scope.vars[a.var].labels) if r.least == 0 else set())
        leaves = [x for x in leaves if x in reach]
        if not leaves:
            raise CypherError("no end of this path fits its label")
        found = found.where(c(" el").isin(*leaves)).withColumnsRenamed({" s": " s2", " sl": " sl2"})
        df = scope.df.join(found, (c(f"{a.var}@_id") == c(" s2")) & (c(f"{a.var}@_label") == c(" sl2")))
        vars_ = scope.vars | {r.var: Kind("rels", {"types": r.types}, tuple(t.type for t in tables))}
        if bound:
            df = df.where((c(f"{b.var}@_id") == c(" e")) & (c(f"{b.var}@_label") == c(" el")))
        else:
            frame = self.vertex_frame(leaves, True)
            frame = frame.select(*(c(x).alias(f"{b.var}@{x}") for x in frame.columns))
            df = df.join(frame, (c(" e") == c(f"{b.var}@_id")) & (c(" el") == c(f"{b.var}@_label")))
            vars_[b.var] = Kind("node", {}, tuple(leaves))
        df = df.withColumnsRenamed({" rels": f"{r.var}@rels", " nodes": f"{r.var}@nodes"}).drop(" s2", " sl2", " e", " el")
        out = Scope(df, vars_)
        return self.node(out, b) if bound else self.with_props(out, b.var, b.props)

    def shortest(self, scope: Scope, p: A.PathPattern, where: Any = None) -> Scope:
        """where: its parts that look at the ends alone hold before paths are sought."""
        from ..operators.paths import shortest_paths

        a, b, r = p.nodes[0], p.nodes[-1], p.rels[0]
        scope = self.node(scope, a)
        scope = self.node(scope, b)
        for x in self.conjuncts(where) if where is not None else ():
            parts = list(A.walk(x))
            if not any(isinstance(y, (A.Exists, A.PatternList)) for y in parts) and {y.name for y in parts if isinstance(y, A.Var)} <= set(scope.vars):
                scope = self.filtered(scope, x)
        edges, tables = self.steps(r, r.direction)
        pairs = scope.df.select(*(c(x).alias(y) for x, y in ((f"{a.var}@_id", " s"), (f"{a.var}@_label", " sl"), (f"{b.var}@_id", " e"), (f"{b.var}@_label", " el")))).distinct()
        least, most = (1, 1) if r.least is None else (r.least, r.most)
        found = shortest_paths(pairs, edges, least, most, p.shortest == "all", self.max_hops)
        found = found.withColumnsRenamed({x: x + "2" for x in (" s", " sl", " e", " el")})
        cond = (c(f"{a.var}@_id") == c(" s2")) & (c(f"{a.var}@_label") == c(" sl2")) & (c(f"{b.var}@_id") == c(" e2")) & (c(f"{b.var}@_label") == c(" el2"))
        name = p.var or self.new("p")
        df = scope.df.join(found, cond).withColumnsRenamed({" nodes": f"{name}@nodes", " rels": f"{name}@rels"}).drop(" s2", " sl2", " e2", " el2")
        return Scope(df, scope.vars | {name: Kind("path", {"types": r.types}, tuple(dict.fromkeys(scope.vars[a.var].labels + scope.vars[b.var].labels)))})

    # -- filters and subqueries
    def filtered(self, scope: Scope, where: Any) -> Scope:
        for x in self.conjuncts(where):
            negative = isinstance(x, A.Op) and x.name == "not"
            sub = x.args[0] if negative else x
            if isinstance(sub, A.Exists):
                scope = self.semi(scope, sub, "left_anti" if negative else "left_semi")
            else:
                columns = scope.df.columns
                scope, cond = self.value(scope, x)
                scope = replace(scope, df=scope.df.where(cond).select(*map(c, columns)))
        return scope

    def conjuncts(self, x: Any) -> list:
        return [y for z in x.args for y in self.conjuncts(z)] if isinstance(x, A.Op) and x.name == "and" else [x]

    def inner(self, scope: Scope, paths: tuple, where: Any) -> tuple[Scope, list[str]]:
        """The subquery's matches over the distinct values of the outer columns that it looks at."""
        parts = [*paths, *([where] if where is not None else [])]
        keys = self.keys_for(scope, *parts)
        seed = Scope(scope.df.select(*map(c, keys)).distinct() if keys else self.catalog.spark.range(1).select(F.lit(1).alias(" one")), {n: k for n, k in scope.vars.items() if any(x == n or x.startswith(n + "@") for x in keys)})
        out = self.match(seed, list(paths), where)
        return (self.filtered(out, where) if where is not None else out), keys

    def semi(self, scope: Scope, x: A.Exists, how: str) -> Scope:
        found, keys = self.inner(scope, x.paths, x.where)
        names = {k: self.new("k") for k in keys}
        right = found.df.select(*(c(k).alias(v) for k, v in names.items())) if keys else found.df.select(F.lit(1).alias(self.new("k"))).limit(1)
        cond = reduce(lambda a, b: a & b, (c(k).eqNullSafe(c(v)) for k, v in names.items()), F.lit(True))
        return replace(scope, df=scope.df.join(right, cond, how))

    def attach(self, scope: Scope, found: Scope, keys: list[str], agg: Column, name: str) -> Scope:
        names = {k: self.new("k") for k in keys}
        right = found.df.groupBy(*(c(k).alias(v) for k, v in names.items())).agg(agg.alias(name))
        cond = reduce(lambda a, b: a & b, (c(k).eqNullSafe(c(v)) for k, v in names.items()), F.lit(True))
        return replace(scope, df=scope.df.join(right, cond, "left").drop(*names.values()))

    # -- expressions
    def value(self, scope: Scope, x: Any, agg: dict | None = None) -> tuple[Scope, Column]:
        """The Column of x; subqueries within are joined to the scope first."""
        subs: dict[int, Column] = {}
        for y in A.walk(x):
            if isinstance(y, A.Exists):
                found, keys = self.inner(scope, y.paths, y.where)
                name = self.new("e")
                scope = self.attach(scope, found, keys, F.max(F.lit(True)), name)
                subs[id(y)] = F.coalesce(c(name), F.lit(False))
            elif isinstance(y, A.PatternList):
                found, keys = self.inner(scope, (y.path,), y.where)
                keys = list(dict.fromkeys(keys + self.keys_for(scope, y.result)))
                if any(k not in found.df.columns for k in keys):
                    found, keys = self.inner(scope, (y.path,), A.Op("and", tuple(z for z in (y.where, A.Op("is not null", (A.Op("or", (A.Lit(True), A.Op("is null", (y.result,)))),))) if z is not None)))
                found, item = self.value(found, y.result)
                name = self.new("l")
                scope = self.attach(scope, found, keys, F.collect_list(item), name)
                subs[id(y)] = F.coalesce(c(name), F.array())
        return scope, Expressions(self, scope, subs, agg).of(x)

    def constant(self, x: Any) -> Column:
        return Expressions(self, Scope(self.catalog.spark.range(1), {}), {}, None).of(x)

    # -- WITH and RETURN
    def project(self, scope: Scope, p: A.Projection) -> Scope:
        items = [A.Item(A.Var(n), n) for n in scope.vars if n[0] != " "] if p.star else []
        items += p.items
        grouped = any(is_aggregate(i.expr) for i in items)
        out = self.grouped(scope, items) if grouped else self.plain(scope, items, [] if p.distinct else p.order, p)
        if p.distinct:
            out = replace(out, df=self.distinct(out))
        if p.order:
            names = {repr(i.expr): i.alias for i in items}
            keys, values = [], []
            for expr, ascending in p.order:
                expr = renamed(expr, names)
                self_scope, x = self.value(out, expr)
                out = self_scope
                values.append(x)
                keys.append(x.asc_nulls_last() if ascending else x.desc_nulls_first())
            if p.final:
                out = replace(out, df=out.df.orderBy(*keys))
            else:  # the sort keys go on with the rows: collect() puts its list in this order
                held = [(self.new("o"), ascending) for _, ascending in p.order]
                df = out.df.withColumns({n: x for (n, _), x in zip(held, values, strict=True)})
                out = replace(out, df=df.orderBy(*(c(n).asc_nulls_last() if up else c(n).desc_nulls_first() for n, up in held)), order=tuple(held))
        if p.skip is not None:
            out = replace(out, df=out.df.offset(self.number(p.skip)))
        if p.limit is not None:
            out = replace(out, df=out.df.limit(self.number(p.limit)))
        keep = [x for n in out.vars for x in out.columns_of(n)] + [n for n, _ in out.order]
        if [x for x in out.df.columns if x not in keep]:
            out = replace(out, df=out.df.select(*map(c, keep)))
        out = Scope(out.df, {n: out.vars[n] for n in [i.alias for i in items]}, out.order)
        return self.filtered(out, p.where) if p.where is not None else out

    def number(self, x: Any) -> int:
        v = self.params[x.name] if isinstance(x, A.Param) else getattr(x, "value", None)
        if not isinstance(v, int) or v < 0:
            raise CypherError("SKIP and LIMIT take a number from 0")
        return v

    def distinct(self, scope: Scope) -> DataFrame:
        """Entities are the same by identity, not by their properties."""
        names = [x for n in scope.vars for x in scope.columns_of(n)]
        identity = [x for n, k in scope.vars.items() for x in scope.columns_of(n) if k.what not in ID or x.split("@", 1)[1] in (ID[k.what], "_label", "_type")]
        return scope.df.dropDuplicates(identity) if len(identity) < len(names) else scope.df.select(*map(c, names)).distinct()

    def plain(self, scope: Scope, items: list, order: list, p: A.Projection) -> Scope:
        columns, vars_ = [], {}
        for i in items:
            if isinstance(i.expr, A.Var) and i.expr.name in scope.vars and scope.vars[i.expr.name].what != "value":
                own = i.expr.name
                columns += [c(x).alias(i.alias + x[len(own) :]) for x in scope.columns_of(own)]
                vars_[i.alias] = scope.vars[own]
            else:
                scope, x = self.value(scope, i.expr)
                columns.append(x.alias(i.alias))
                vars_[i.alias] = Kind("value")
        # what only ORDER BY looks at stays until the rows are sorted
        names = {repr(i.expr): i.alias for i in items}
        extra, more = [], {}
        for expr, _ in order:
            for v in {y.name for y in A.walk(renamed(expr, names)) if isinstance(y, A.Var)}:
                if v not in vars_ and v in scope.vars and v not in more:
                    extra += [c(x) for x in scope.columns_of(v)]
                    more[v] = scope.vars[v]
        return Scope(scope.df.select(*columns, *extra), vars_ | more)

    def grouped(self, scope: Scope, items: list) -> Scope:
        keys, carried, aggs, vars_ = [], [], [], {}
        after: list[tuple[str, Any]] = []
        for i in items:
            if is_aggregate(i.expr):
                continue
            if isinstance(i.expr, A.Var) and i.expr.name in scope.vars and scope.vars[i.expr.name].what in ID:
                kind = scope.vars[i.expr.name]
                for x in scope.columns_of(i.expr.name):
                    own, name = x.split("@", 1)[1], i.alias + x[len(i.expr.name) :]
                    if own in (ID[kind.what], "_label", "_type"):
                        keys.append(c(x).alias(name))
                    else:
                        carried.append(F.first(c(x)).alias(name))
                vars_[i.alias] = kind
            elif isinstance(i.expr, A.Var) and i.expr.name in scope.vars and scope.vars[i.expr.name].what != "value":
                keys += [c(x).alias(i.alias + x[len(i.expr.name) :]) for x in scope.columns_of(i.expr.name)]
                vars_[i.alias] = scope.vars[i.expr.name]
            else:
                scope, x = self.value(scope, i.expr)
                keys.append(x.alias(i.alias))
                vars_[i.alias] = Kind("value")
        agg: dict[str, Column] = {}
        for i in items:
            if is_aggregate(i.expr):
                by_name = {repr(j.expr): j.alias for j in items if not is_aggregate(j.expr)}
                scope, _ = self.value(scope, i.expr, agg)
                after.append((i.alias, renamed(i.expr, by_name, within_aggregates=False)))
                vars_[i.alias] = Kind("value")
        tables: dict[str, tuple[list[Column], dict[str, Callable[..., Column]]]] = {}
        for n, (text, args, made) in agg.pop(" values", {}).items():
            tables.setdefault(text, (args, {}))[1][n] = made
        rows, names = scope.df, scope.df.select(*keys).columns if keys else []
        if tables:  # each reads the rows once more and counts their values, so that no list of a group's rows is held
            held = {self.new("k"): x for x in keys} | {self.new("v"): x for args, _ in tables.values() for x in args}
            rows, left = same_rows(rows.withColumns(held)), list(held)
            keys = [c(left.pop(0)).alias(n) for n in names]
        aggs = [x.alias(n) for n, x in agg.items()]
        named = rows.groupBy(*keys) if keys else rows.groupBy()
        df = named.agg(*carried, *aggs) if carried or aggs else named.agg(F.count(F.lit(1)).alias(" n"))
        for args, makers in tables.values():
            own, n, at = [c(left.pop(0)) for _ in args], self.new("n"), self.new("at")
            found = rows.withColumn(at, F.monotonically_increasing_id()).groupBy(*keys, *own).agg(F.count(F.lit(1)).alias(n), F.min(c(at)).alias(at))
            fresh = {k: self.new("k") for k in names}
            found = found.groupBy(*(c(k).alias(v) for k, v in fresh.items())).agg(*(made(own, c(n), c(at)).alias(a) for a, made in makers.items()))
            cond = reduce(lambda a, b: a & b, (c(k).eqNullSafe(c(v)) for k, v in fresh.items()), F.lit(True))
            df = df.join(found, cond, "left").drop(*fresh.values())
        out = Scope(df, dict(vars_))
        done = Expressions(self, Scope(df, {k: v for k, v in vars_.items() if k not in dict(after)}), {}, None)
        done.ready = True
        df = df.withColumns({n: done.of(x) for n, x in after})
        return replace(out, df=df)


def is_aggregate(x: Any) -> bool:
    return any(isinstance(y, A.Call) and y.name in AGGREGATE and y.name not in SCALAR for y in A.walk(x) if not isinstance(y, (A.Exists,)))


def renamed(x: Any, names: dict[str, str], within_aggregates: bool = True) -> Any:
    """x with the parts that stand in names (by their text) as variables; an aggregate's arguments are of the rows before grouping."""
    if repr(x) in names:
        return A.Var(names[repr(x)])
    if isinstance(x, tuple):
        return tuple(renamed(y, names, within_aggregates) for y in x)
    if not within_aggregates and isinstance(x, A.Call) and x.name in AGGREGATE and x.name not in SCALAR:
        return x
    if hasattr(x, "__dataclass_fields__") and not isinstance(x, (A.PathPattern, A.NodePattern, A.RelPattern)):
        return replace(x, **{k: renamed(getattr(x, k), names, within_aggregates) for k in x.__dataclass_fields__ if isinstance(getattr(x, k), tuple) or hasattr(getattr(x, k), "__dataclass_fields__")})
    return x


class Expressions:
    """Expression trees to Columns.  agg: aggregates found are put there by name, for groupBy; ready: they are columns already."""

    def __init__(self, builder: Builder, scope: Scope, subs: dict[int, Column], agg: dict | None):
        self.b, self.scope, self.subs, self.agg = builder, scope, subs, agg
        self.local: dict[str, Column] = {}
        self.local_types: dict[str, T.DataType | None] = {}
        self.ready = False

    def of(self, x: Any) -> Column:
        if id(x) in self.subs:
            return self.subs[id(x)]
        return getattr(self, "_" + type(x).__name__.lower())(x)

    def _lit(self, x: A.Lit) -> Column:
        out = F.lit(x.value)
        out._literal = x.value
        return out

    def _param(self, x: A.Param) -> Column:
        if x.name not in self.b.params:
            raise CypherError(f"no value for ${x.name}")
        v = self.b.params[x.name]
        out = F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else F.lit(v)
        out._literal = v
        return out

    def _var(self, x: A.Var) -> Column:
        if x.name in self.local:
            return self.local[x.name]
        if x.name not in self.scope.vars:
            raise CypherError(f"no variable {x.name}")
        return self.b.whole(self.scope, x.name)

    def identity(self, x: Any) -> tuple[Column, Column | None] | None:
        """(id, label) of an entity; the label only where it can differ."""
        if isinstance(x, A.Var) and x.name not in self.local and x.name in self.scope.vars and self.scope.vars[x.name].what in ID:
            kind = self.scope.vars[x.name]
            return c(f"{x.name}@{ID[kind.what]}"), c(f"{x.name}@{'_label' if kind.what == 'node' else '_type'}")
        return None

    def _prop(self, x: A.Prop) -> Column:
        if isinstance(x.of, A.Var) and x.of.name not in self.local and x.of.name in self.scope.vars:
            kind = self.scope.vars[x.of.name]
            if kind.what in ID:
                name = f"{x.of.name}@{x.name}"
                if name in self.scope.df.columns:
                    return c(name)
                return F.lit(None)  # a property that no vertex of the label has
        base = self.of(x.of)
        low = x.name.lower()
        if low in ("year", "month", "day", "hour", "minute", "second", "quarter", "week", "epochmillis", "millisecond", "microsecond") and isinstance(self.kind_of(x.of), (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return SCALAR[low](base)
        return base.getField(x.name)

    def kind_of(self, x: Any) -> T.DataType | None:
        """The type of a tree; None where it can't be told (an aggregate within, a lambda's variable of unknown type)."""
        shadow = Expressions(self.b, self.scope, self.subs, None)
        if any(t is None for t in self.local_types.values()):
            return None
        shadow.local = {k: F.lit(None).cast(t) for k, t in self.local_types.items()}
        shadow.local_types, shadow.ready = self.local_types, self.ready
        try:
            return self.scope.df.select(shadow.of(x).alias("x")).schema[0].dataType
        except Exception:
            return None

    def _listof(self, x: A.ListOf) -> Column:
        return F.array(*map(self.of, x.items))

    def _mapof(self, x: A.MapOf) -> Column:
        return F.struct(*(self.of(v).alias(k) for k, v in x.items))

    def _index(self, x: A.Index) -> Column:
        at = self.of(x.at)
        if isinstance(x.at, A.Lit) and isinstance(x.at.value, str):
            return self.of(x.of).getField(x.at.value)
        return list_extract(self.of(x.of), at)

    def _slice(self, x: A.Slice) -> Column:
        return list_slice(self.of(x.of), None if x.begin is None else self.of(x.begin), None if x.end is None else self.of(x.end))

    def within(self, types: dict[str, T.DataType | None], **names: Column) -> Expressions:
        out = Expressions(self.b, self.scope, self.subs, self.agg)
        out.local, out.local_types, out.ready = self.local | names, self.local_types | types, self.ready
        return out

    def element(self, x: Any) -> T.DataType | None:
        return getattr(self.kind_of(x), "elementType", None)

    def _comprehension(self, x: A.Comprehension) -> Column:
        source, kind = self.of(x.source), {x.var: self.element(x.source)}
        if x.where is not None:
            source = F.filter(source, lambda v: F.coalesce(self.within(kind, **{x.var: v}).of(x.where), F.lit(False)))
        return source if x.result is None else F.transform(source, lambda v: self.within(kind, **{x.var: v}).of(x.result))

    def _reduce(self, x: A.Reduce) -> Column:
        kinds = {x.acc: self.kind_of(x.start), x.var: self.element(x.source)}
        start = self.of(x.start)
        inner = self.within(kinds)
        inner.local = self.local | {k: F.lit(None).cast(t) for k, t in kinds.items() if t is not None}
        grown = inner.kind_of(x.step)  # the accumulator takes the type of the step, as in 0 + 0.5
        if grown is not None and not isinstance(grown, T.NullType) and grown != kinds[x.acc]:
            kinds[x.acc], start = grown, start.cast(grown)
        out = grown or kinds[x.acc]

        def step(a: Column, v: Column) -> Column:
            got = self.within(kinds, **{x.acc: a, x.var: v}).of(x.step)
            return got.cast(out) if out is not None else got

        return F.aggregate(self.of(x.source), start, step)

    def _quantified(self, x: A.Quantified) -> Column:
        kind = {x.var: self.element(x.source)}
        test = lambda v: self.within(kind, **{x.var: v}).of(x.where)
        source = self.of(x.source)
        if x.kind == "all":
            return F.forall(source, test)
        if x.kind == "single":
            return F.size(F.filter(source, test)) == 1
        return F.exists(source, test) if x.kind == "any" else ~F.exists(source, test)

    def _case(self, x: A.Case) -> Column:
        out = None
        for when, then in x.branches:
            if x.subject is None:
                cond = self.of(when)
            elif isinstance(when, A.Lit) and when.value is None:
                cond = self.is_null(x.subject)
            else:
                cond = self.compare("=", x.subject, when)
            then = self.of(then)
            out = F.when(cond, then) if out is None else out.when(cond, then)
        return out.otherwise(self.of(x.otherwise)) if x.otherwise is not None else out

    def is_null(self, x: Any) -> Column:
        entity = self.identity(x)
        if entity:
            return entity[0].isNull()
        if isinstance(x, A.Var) and x.name in self.scope.vars and x.name not in self.local and self.scope.vars[x.name].what in ("path", "rels"):
            return c(f"{x.name}@rels").isNull()
        return self.of(x).isNull()

    def compare(self, op: str, a: Any, b: Any) -> Column:
        one, two = self.identity(a), self.identity(b)
        if one and two:
            same = (one[0] == two[0]) & (one[1] == two[1])
            return same if op == "=" else ~same
        x, y = self.of(a), self.of(b)
        return {"=": x.__eq__, "<>": x.__ne__, "<": x.__lt__, ">": x.__gt__, "<=": x.__le__, ">=": x.__ge__}[op](y)

    def _op(self, x: A.Op) -> Column:
        op, args = x.name, x.args
        if op in ("=", "<>", "<", ">", "<=", ">="):
            return self.compare(op, *args)
        if op == "in":
            entity = self.identity(args[0])
            if entity and isinstance(args[1], A.ListOf):
                return reduce(lambda a, b: a | b, (self.compare("=", args[0], y) for y in args[1].items), F.lit(False))
            source = self.of(args[1])
            if entity:
                return F.exists(source, lambda v: v.getField("_id") == entity[0])
            if isinstance(args[1], A.ListOf) and all(isinstance(y, A.Lit) for y in args[1].items):
                return self.of(args[0]).isin(*(y.value for y in args[1].items))
            return F.array_contains(source, self.of(args[0]))
        if op in ("is null", "is not null"):
            null = self.is_null(args[0])
            return null if op == "is null" else ~null
        xs = [self.of(y) for y in args]
        if op == "/":
            kinds = [self.kind_of(y) for y in args]
            if all(isinstance(k, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)) for k in kinds):
                return F.try_divide(xs[0] - F.try_mod(xs[0], xs[1]), xs[1]).cast("long")
            return F.try_divide(xs[0], xs[1])
        if op == "+":
            kinds = [self.kind_of(y) for y in args]
            if any(isinstance(k, T.StringType) for k in kinds):
                return F.concat(*(v.cast("string") for v in xs))
            if any(isinstance(k, T.ArrayType) for k in kinds):
                return F.concat(*(v if isinstance(k, T.ArrayType) else F.array(v) for v, k in zip(xs, kinds, strict=True)))
            return xs[0] + xs[1]
        table = {
            "or": lambda a, b: a | b, "and": lambda a, b: a & b, "xor": lambda a, b: (a.cast("boolean") != b.cast("boolean")), "not": lambda a: ~a,
            "-": lambda a, b: a - b, "*": lambda a, b: a * b, "%": F.try_mod, "^": F.pow, "neg": lambda a: -a, "~": F.bitwise_not,
            "|": lambda a, b: a.bitwiseOR(b), "&": lambda a, b: a.bitwiseAND(b), "<<": lambda a, b: F.call_function("shiftleft", a, b.cast("int")), ">>": lambda a, b: F.call_function("shiftright", a, b.cast("int")),
            "||": lambda a, b: F.concat(a, b), "starts with": F.startswith, "ends with": F.endswith, "contains": F.contains, "=~": SCALAR["regexp_full_match"], "like": lambda a, b: F.like(a, b), "ilike": lambda a, b: F.ilike(a, b),
            "is distinct": lambda a, b: ~a.eqNullSafe(b), "is not distinct": lambda a, b: a.eqNullSafe(b),
        }
        return table[op](*xs)

    def _call(self, x: A.Call) -> Column:
        name = x.name
        if name in AGGREGATE and name not in SCALAR:
            return self.aggregate(x)
        if name in SIZES and len(x.args) == 1 and isinstance(y := x.args[0], A.Call) and len(y.args) == 1 and (y.name in ("list", "array_agg") or y.name == "collect" and not y.distinct):
            return self.aggregate(x)
        var = x.args[0].name if x.args and isinstance(x.args[0], A.Var) and x.args[0].name not in self.local else None
        kind = self.scope.vars.get(var) if var else None
        if kind and kind.what in ID:
            found = self.entity_call(name, var, kind)
            if found is not None:
                return found
        if kind and kind.what in ("path", "rels"):
            if name in ("length", "path_length"):
                return F.size(c(f"{var}@rels")).cast("long")
            if name in ("nodes", "path_nodes"):
                return c(f"{var}@nodes")
            if name in ("relationships", "rels", "path_rels"):
                return c(f"{var}@rels")
            if name == "size":
                return F.size(c(f"{var}@rels")).cast("long")
        if name in ("nodes", "path_nodes", "relationships", "path_rels", "rels"):
            return self.of(x.args[0]).getField("nodes" if "node" in name else "rels")
        if name == "path_length":
            return F.size(self.of(x.args[0]).getField("rels")).cast("long")
        if name == "datetime" and x.args and isinstance(x.args[0], A.MapOf):
            return F.timestamp_millis(self.of(dict(x.args[0].items)["epochMillis"]).cast("long"))
        if name in ("length", "len", "size", "reverse") and name != "reverse" and x.args:
            kind_x = self.kind_of(x.args[0])
            return SCALAR["length" if isinstance(kind_x, T.StringType) or kind_x is None and name != "size" else "size"](self.of(x.args[0]))
        if name == "last":
            name = "list_last"
        if name not in SCALAR:
            raise CypherError(f"no function {name}")
        return SCALAR[name](*map(self.of, x.args))

    def entity_call(self, name: str, var: str, kind: Kind) -> Column | None:
        props = [p for p in (y.split("@", 1)[1] for y in self.scope.columns_of(var)) if p[0] != "_"]
        if name in ("id", "elementid"):
            return c(f"{var}@{ID[kind.what]}")
        if name == "type":
            return c(f"{var}@_type")
        if name == "labels":
            out = None
            for n in kind.labels:
                own = F.array(*map(F.lit, (n, *self.b.catalog.vertices[n].parents)))
                out = F.when(c(f"{var}@_label") == n, own) if out is None else out.when(c(f"{var}@_label") == n, own)
            return out
        if name == "keys":
            return F.filter(F.array(*(F.when(c(f"{var}@{p}").isNotNull(), F.lit(p)) for p in props)), lambda v: v.isNotNull()) if props else F.array().cast("array<string>")
        if name == "properties":
            return F.struct(*(c(f"{var}@{p}").alias(p) for p in props))
        if name in ("startnode", "endnode") and kind.what == "rel":
            s = name == "startnode"
            return F.struct(c(f"{var}@{'_sid' if s else '_tid'}").alias("_id"), c(f"{var}@{'_slabel' if s else '_tlabel'}").alias("_label"), c(f"{var}@{'_sid' if s else '_tid'}").alias("id"))
        return None

    def aggregate(self, x: A.Call) -> Column:
        name = " a " + repr(x)
        if self.ready:
            return c(name)
        if self.agg is None:
            raise CypherError(f"{x.name}() can't stand here")
        held, self.agg = self.agg, None
        sized, x = x.name in SIZES, x.args[0] if x.name in SIZES else x
        args = [self.counted(y) if x.name == "count" else self.of(y) for y in x.args]
        self.agg = held
        if x.star or not args:
            out = F.count(F.lit(1))
        elif sized and not x.distinct:  # no list is made for its size
            out = F.count(args[0]) if x.name == "collect" else F.count(F.lit(1))
        elif x.distinct and x.name in ("list", "array_agg"):
            made = (lambda own, n, at: F.count(F.lit(1))) if sized else (lambda own, n, at: F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), own[0].alias("x")))), lambda s: s["x"]))
            return self.by_value(name, repr(x.args), args, made)
        elif x.name == "histogram" and not x.distinct:
            made = lambda own, n, at: F.map_from_entries(F.collect_list(F.when(own[0].isNotNull(), F.struct(own[0], n))))
            return self.by_value(name, "text of " + repr(x.args), [args[0].cast("string")], made)
        elif x.distinct and x.name in ("count", "sum", "collect"):
            out = {"count": F.count_distinct, "sum": F.sum_distinct, "collect": F.collect_set}[x.name](*args)
        elif x.distinct and x.name not in ("min", "max"):
            fixed = [k for k, y in enumerate(x.args) if k and isinstance(y, A.Lit)]  # a separator, a share
            rest = [args[k] for k in fixed]

            def made(own: list[Column], n: Column, at: Column) -> Column:
                there = reduce(lambda a, b: a & b, (y.isNotNull() for y in own))
                return AGGREGATE[x.name](*(F.when(there, y) for y in own), *rest)

            return self.by_value(name, repr(tuple(y for k, y in enumerate(x.args) if k not in fixed)), [y for k, y in enumerate(args) if k not in fixed], made)
        elif x.name in ("collect", "list", "array_agg") and self.scope.order:
            out = self.in_order(args[0], x.name == "collect")
        else:
            out = AGGREGATE[x.name](*args)
        self.agg[name] = out
        return F.lit(None)

    def by_value(self, name: str, text: str, args: list[Column], made: Callable[..., Column]) -> Column:
        """An aggregate of the distinct values of args in a group: made gets their columns, how often each occurs and its first place."""
        self.agg.setdefault(" values", {})[name] = (text, args, made)
        return F.lit(None)

    def in_order(self, x: Column, skip_nulls: bool) -> Column:
        """A list in the order of the scope's sort keys, wherever its rows come from."""
        order = self.scope.order
        row = F.struct(*(c(n).alias(f"k{k}") for k, (n, _) in enumerate(order)), x.alias("x"))

        def compare(a: Column, b: Column) -> Column:
            out = None
            for k, (_, up) in enumerate(order):
                p, q = a[f"k{k}"], b[f"k{k}"]
                less, more = (F.lit(-1), F.lit(1)) if up else (F.lit(1), F.lit(-1))  # nulls are greatest
                for cond, value in ((p.isNull() & q.isNotNull(), more), (p.isNotNull() & q.isNull(), less), (p < q, less), (p > q, more)):
                    out = F.when(cond, value) if out is None else out.when(cond, value)
            return out.otherwise(F.lit(0))

        return F.transform(F.array_sort(F.collect_list(F.when(x.isNotNull(), row) if skip_nulls else row), compare), lambda s: s["x"])

    def counted(self, x: Any) -> Column:
        entity = self.identity(x)
        if entity:
            kind = self.scope.vars[x.name]
            return entity[0] if len(kind.labels) == 1 else F.when(entity[0].isNotNull(), F.struct(*entity))
        return self.of(x)
