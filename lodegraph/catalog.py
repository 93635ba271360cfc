"""The catalog: vertex labels and edge types as DataFrames with typed columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.store import settle


@dataclass
class Label:
    """Vertices of one leaf label: column _id and properties."""

    name: str
    df: DataFrame
    parents: tuple[str, ...] = ()

    @property
    def props(self) -> list[str]:
        return [c for c in self.df.columns if c != "_id"]


@dataclass
class EdgeTable:
    """Edges of a type between two leaf labels: columns _eid, _sid, _tid and properties.

    key: the property of the source's vertices that holds the target's _id.  Such edges need no table of their own: a hop
    is one join with the other side's vertices."""

    type: str
    src: str
    dst: str
    df: DataFrame | None = None
    key: str | None = None

    @property
    def props(self) -> list[str]:
        return [] if self.df is None else [c for c in self.df.columns if c not in ("_eid", "_sid", "_tid")]


@dataclass
class GraphCatalog:
    spark: SparkSession
    vertices: dict[str, Label] = field(default_factory=dict)
    edges: dict[str, list[EdgeTable]] = field(default_factory=dict)

    def add_vertices(self, name: str, df: DataFrame, key: str | list[str] | None = None, parents: tuple[str, ...] = ()) -> Label:
        """key: the id column; with several, the id is a struct of them, so that keys never fall together."""
        if key is not None:
            df = df.withColumn("_id", F.col(key) if isinstance(key, str) else F.struct(*key))
        if "_id" not in df.columns:
            raise ValueError(f"vertices of {name} need an id")
        self.vertices[name] = Label(name, df, tuple(parents))
        return self.vertices[name]

    def add_edges(self, type_: str, src: str, dst: str, df: DataFrame, source: str = "_sid", target: str = "_tid", key: str | None = None) -> tuple[EdgeTable, int | None]:
        """Edges from a table; key: a column that numbers them, else they are numbered by their place.  Loose ends must be dropped before (see sources.drop_dangling)."""
        df = df.withColumnsRenamed({source: "_sid", target: "_tid"})
        if key:
            df = df.withColumn("_eid", F.col(key).cast("long"))
        elif "_eid" not in df.columns:
            df = settle(df.withColumn("_eid", F.monotonically_increasing_id()), "edges")  # an edge has one number in all uses
        table = EdgeTable(type_, src, dst, df)
        self.edges.setdefault(type_, []).append(table)
        return table, None

    def add_key_edges(self, type_: str, src: str, dst: str, key: str) -> EdgeTable:
        table = EdgeTable(type_, src, dst, None, key)
        self.edges.setdefault(type_, []).append(table)
        return table

    def edge_frame(self, table: EdgeTable) -> DataFrame:
        """The edges as a table, whatever they are kept as."""
        if table.df is not None:
            return table.df
        own = self.vertices[table.src].df.where(F.col(table.key).isNotNull())
        return own.select(F.col("_id").alias("_eid"), F.col("_id").alias("_sid"), F.col(table.key).alias("_tid"))

    def leaves(self, names: tuple[str, ...]) -> list[str]:
        """Leaf labels that a pattern's labels stand for; none: all."""
        if not names:
            return list(self.vertices)
        out: list[str] = []
        for n in names:
            found = [v.name for v in self.vertices.values() if v.name == n or n in v.parents]
            if not found:
                raise KeyError(f"no label {n}")
            out += [x for x in found if x not in out]
        return out

    def tables(self, types: tuple[str, ...]) -> list[EdgeTable]:
        if not types:
            return [t for own in self.edges.values() for t in own]
        out = []
        for t in types:
            if t not in self.edges:
                raise KeyError(f"no edge type {t}")
            out += self.edges[t]
        return out

    def labels(self) -> list[str]:
        return sorted(self.vertices)

    def relationship_types(self) -> list[str]:
        return sorted(self.edges)

    def schema(self) -> dict:
        return {
            "vertices": {v.name: {f.name: f.dataType.simpleString() for f in v.df.schema if f.name != "_id"} for v in self.vertices.values()},
            "edges": {t: [{"from": e.src, "to": e.dst, "properties": {f.name: f.dataType.simpleString() for f in self.edge_frame(e).schema if f.name in e.props}} for e in own] for t, own in self.edges.items()},
        }
