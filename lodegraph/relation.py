"""The fluent API: lazy relations, and questions about nodes and paths."""

from __future__ import annotations

from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .plans import ast as A
from .plans.parser import Parser

if TYPE_CHECKING:
    from .graph import Graph


def _expression(text: str) -> Any:
    p = Parser(text)
    p.source = text
    return p.expression()


class Relation:
    """A lazy result.  Each method gives a new one; nothing runs before rows are fetched."""

    def __init__(self, graph: Graph, df: DataFrame, origin: tuple | None = None):
        self.graph, self.df, self.origin = graph, df, origin
        self._rows = None

    def _column(self, text: str | Column) -> Column:
        """An expression over the result's columns; a.b is a column of that name, or a field."""
        if isinstance(text, Column):
            return text
        from .plans.builder import Builder, Expressions, Kind, Scope

        scope = Scope(self.df, {n: Kind("value") for n in self.df.columns})
        tree = _expression(text)

        def named(x: Any) -> Any:
            if isinstance(x, A.Prop) and isinstance(x.of, A.Var) and f"{x.of.name}.{x.name}" in self.df.columns:
                return A.Var(f"{x.of.name}.{x.name}")
            if isinstance(x, A.Op):
                return A.Op(x.name, tuple(map(named, x.args)))
            if isinstance(x, A.Call):
                return A.Call(x.name, tuple(map(named, x.args)), x.distinct, x.star)
            return x

        return Expressions(Builder(self.graph.catalog), scope, {}, None).of(named(tree))

    def _new(self, df: DataFrame) -> Relation:
        return Relation(self.graph, df)

    def filter(self, condition: str | Column) -> Relation:
        return self._new(self.df.where(self._column(condition)))

    def project(self, *columns: str) -> Relation:
        out = []
        for x in columns:
            text, _, alias = x.partition(" AS ") if " AS " in x else x.partition(" as ")
            out.append(self._column(text).alias(alias or text))
        return self._new(self.df.select(*out))

    def order(self, *keys: str) -> Relation:
        out = []
        for k in keys:
            text, _, way = k.rpartition(" ")
            down = way.lower() in ("desc", "descending") and text
            own = self._column(text if text and way.lower() in ("desc", "descending", "asc", "ascending") else k)
            out.append(own.desc_nulls_first() if down else own.asc_nulls_last())
        return self._new(self.df.orderBy(*out))

    sort = order

    def limit(self, n: int, offset: int = 0) -> Relation:
        return self._new((self.df.offset(offset) if offset else self.df).limit(n))

    def skip(self, n: int) -> Relation:
        return self._new(self.df.offset(n))

    def distinct(self) -> Relation:
        return self._new(self.df.distinct())

    def union(self, other: Relation) -> Relation:
        return self._new(self.df.unionByName(other.df))

    def union_distinct(self, other: Relation) -> Relation:
        return self._new(self.df.unionByName(other.df).distinct())

    def aggregate(self, items: str, group_by: str = "") -> Relation:
        """items: aggregates with names, as in "count(*) AS n, sum(x) AS s".  They see the variables of the query, or else the result's columns."""
        from .plans.builder import Builder, Kind, Scope

        p = Parser(f"{items} ")
        p.source = items
        projection = p.projection()
        keys = [A.Item(_expression(k.strip()), k.strip()) for k in group_by.split(",") if k.strip()]
        projection.items = keys + projection.items
        if self.origin:
            q, params = self.origin
            last = q.parts[-1][-1]
            if len(q.parts) == 1 and not (last.skip or last.limit or last.distinct):
                builder = Builder(self.graph.catalog, params)
                final = A.Projection(projection.items, final=True)
                try:
                    return self._new(builder.query(A.Query([[*q.parts[0][:-1], final]], [])))
                except (ValueError, KeyError):
                    pass
        scope = Scope(self.df, {n: Kind("value") for n in self.df.columns})
        out = Builder(self.graph.catalog).project(scope, projection)
        return self._new(out.df)

    def count(self) -> Relation:
        """Rows whose first column isn't null, as count_star."""
        return self._new(self.df.agg(F.count(F.col("`" + self.df.columns[0] + "`")).alias("count_star")))

    def window(self, function: str, partition_by: list[str], order_by: list[str], alias: str) -> Relation:
        """A window function by its SQL text, such as "row_number()", beside the columns."""
        over = f"PARTITION BY {', '.join(f'`{x}`' for x in partition_by)} " * bool(partition_by) + "ORDER BY " + ", ".join(order_by)
        return self._new(self.df.selectExpr("*", f"{function} OVER ({over}) AS `{alias}`"))

    def execute(self) -> Relation:
        self._rows = self.df.toLocalIterator()
        return self

    def fetchone(self) -> tuple | None:
        if self._rows is None:
            self.execute()
        row = next(self._rows, None)
        return None if row is None else tuple(row)

    def fetchmany(self, n: int = 1) -> list[tuple]:
        out = []
        while len(out) < n and (row := self.fetchone()) is not None:
            out.append(row)
        return out

    def fetchall(self) -> list[tuple]:
        return [tuple(r) for r in self.df.collect()]

    def fetchdf(self):
        return self.df.toPandas()

    df_ = to_pandas = fetchdf

    def fetchnumpy(self) -> dict:
        got = self.df.toPandas()
        return {n: got[n].to_numpy() for n in got.columns}

    def fetch_df_chunk(self, n: int = 1024):
        import pandas as pd

        return pd.DataFrame(self.fetchmany(n), columns=self.columns)

    def show(self, n: int = 20) -> None:
        self.df.show(n, truncate=False)

    def render(self, form: str = "box", limit: int = 1000) -> str:
        from .sources.render import render

        return render(self.df, form, limit)

    def query(self, name: str, sql: str) -> Relation:
        self.df.createOrReplaceTempView(name)
        return self._new(self.graph.spark.sql(sql))

    def explain(self, mode: str = "formatted") -> None:
        self.df.explain(mode)

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    column_names = columns

    @property
    def types(self) -> list[str]:
        return [t for _, t in self.df.dtypes]

    @property
    def shape(self) -> tuple[int, int]:
        return self.df.count(), len(self.df.columns)

    def __len__(self) -> int:
        return self.df.count()


class NodeQuery:
    """Questions about the nodes of a label."""

    def __init__(self, graph: Graph, label: str | None, conditions: tuple[str, ...] = (), params: dict | None = None):
        self.graph, self.label, self.conditions, self.params = graph, label, conditions, params or {}

    def where(self, condition: str = "", **equal: Any) -> NodeQuery:
        """A condition over n, or properties by value."""
        more = [condition] if condition else []
        params = dict(self.params)
        for k, v in equal.items():
            name = f"p{len(params)}"
            params[name] = v
            more.append(f"n.`{k}` = ${name}")
        return NodeQuery(self.graph, self.label, (*self.conditions, *more), params)

    def _match(self, pattern: str) -> str:
        where = " WHERE " + " AND ".join(f"({x})" for x in self.conditions) if self.conditions else ""
        return f"MATCH {pattern}{where}"

    @property
    def _node(self) -> str:
        return f"(n:`{self.label}`)" if self.label else "(n)"

    def properties(self, *names: str) -> Relation:
        leaves = self.graph.catalog.leaves((self.label,) if self.label else ())
        names = names or tuple(dict.fromkeys(p for x in leaves for p in self.graph.catalog.vertices[x].props))
        return self.graph.sql(f"{self._match(self._node)} RETURN {', '.join(f'n.`{x}` AS `{x}`' for x in names)}", self.params)

    def count(self) -> int:
        return self.graph.sql(f"{self._match(self._node)} RETURN count(n) AS n", self.params).fetchall()[0][0]

    def _rel(self, types: str | None, direction: str, name: str = "r") -> str:
        left, right = {"out": ("-", "->"), "in": ("<-", "-"), "both": ("-", "-")}[direction]
        kinds = ":" + "|".join(f"`{t}`" for t in types.split("|")) if types else ""
        return f"{left}[{name}{kinds}]{right}"

    def neighbors(self, types: str | None = None, direction: str = "out") -> Relation:
        return self.graph.sql(f"{self._match(f'{self._node}{self._rel(types, direction)}(m)')} RETURN DISTINCT m", self.params)

    def edges(self, types: str | None = None, direction: str = "out") -> Relation:
        return self.graph.sql(f"{self._match(f'{self._node}{self._rel(types, direction)}(m)')} RETURN r", self.params)

    def degree(self, types: str | None = None, direction: str = "out") -> Relation:
        """Edges by node; nodes without any are absent."""
        return self.graph.sql(f"{self._match(f'{self._node}{self._rel(types, direction)}(m)')} RETURN id(n) AS id, count(r) AS degree", self.params)


class PathQuery:
    def __init__(self, graph: Graph, label: str, start: dict, end: dict, types: str | None, max_hops: int | None):
        self.graph, self.label, self.start, self.end, self.types, self.max_hops = graph, label, start, end, types, max_hops

    def _find(self, function: str) -> Relation:
        params = {f"s{k}": v for k, v in enumerate(self.start.values())} | {f"e{k}": v for k, v in enumerate(self.end.values())}
        one = ", ".join(f"`{k}`: $s{i}" for i, k in enumerate(self.start))
        two = ", ".join(f"`{k}`: $e{i}" for i, k in enumerate(self.end))
        kinds = ":" + "|".join(f"`{t}`" for t in self.types.split("|")) if self.types else ""
        hops = f"*..{self.max_hops}" if self.max_hops else "*"
        text = f"MATCH p = {function}((a:`{self.label}` {{{one}}})-[{kinds}{hops}]-(b:`{self.label}` {{{two}}})) RETURN nodes(p) AS nodes, relationships(p) AS rels, length(p) AS length"
        return self.graph.sql(text, params)

    def shortest_path(self) -> Relation:
        return self._find("shortestPath")

    def all_shortest_paths(self) -> Relation:
        return self._find("allShortestPaths")
