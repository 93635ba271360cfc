"""Typed-header CSV and JSON files of vertices and edges.

CSV: fields between |, a header of name:TYPE fields; :ID(Label) is the id, :ID_1(Label) and :ID_2(Label) two columns of a compound id,
:START_ID(Label) and :END_ID(Label) an edge's ends.  Empty fields are null.  JSON: {"vertices": [...]} or {"edges": [...]}.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators.store import settle

# Header types and Spark's.
TYPES = {
    "STRING": "string", "STRING[]": "string", "VARCHAR": "string", "INT": "int", "INTEGER": "int", "LONG": "bigint", "BIGINT": "bigint", "ULONG": "bigint", "UBIGINT": "bigint", "UINTEGER": "bigint",
    "FLOAT": "float", "DOUBLE": "double", "DATE": "date", "DATE_EPOCHMS": "bigint", "SMALLINT": "smallint", "TINYINT": "tinyint", "TIMESTAMP": "timestamp", "HUGEINT": "decimal(38,0)",
}


def parse_field(text: str) -> tuple[str, str, str | None]:
    """(name, role, label): role is id, id1, id2, start, end (also with _1, _2), or the Spark type."""
    name, _, kind = text.strip().partition(":")
    m = re.fullmatch(r"(ID|START_ID|END_ID)(?:_(\d))?(?:\((.*)\))?", kind.strip(), re.I)
    if m:
        role = {"ID": "id", "START_ID": "start", "END_ID": "end"}[m[1].upper()] + (m[2] or "")
        return name, role, m[3]
    upper = kind.strip().upper()
    d = re.fullmatch(r"DECIMAL\((\d+),\s*(\d+)\)", upper)
    if d:
        return name, f"decimal({d[1]},{d[2]})", None
    if upper not in TYPES:
        raise ValueError(f"no column type {kind}")
    return name, TYPES[upper], None


def read_header(spark: SparkSession, path: str) -> list[str]:
    """The first line, read by Spark, so that any store will do."""
    return spark.read.text(path).first()[0].split("|")


def read_csv(spark: SparkSession, path: str) -> tuple[DataFrame, list[tuple[str, str, str | None]]]:
    fields = [parse_field(x) for x in read_header(spark, path)]
    names = [f"c{k}" for k in range(len(fields))]
    schema = ", ".join(f"{n} string" for n in names)
    raw = spark.read.csv(path, sep="|", header=True, schema=schema, nullValue="", enforceSchema=True)
    return raw, fields


def _id(columns: list[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.struct(*(x.alias(f"id{k}") for k, x in enumerate(columns)))


def read_vertices(spark: SparkSession, path: str) -> DataFrame:
    raw, fields = read_csv(spark, path)
    ids, props = [], []
    for k, (name, role, _) in enumerate(fields):
        col = F.col(f"c{k}")
        if role.startswith("id"):
            ids.append(col.cast("bigint"))
            if name:
                props.append(col.cast("bigint").alias(name))
        else:
            props.append(col.cast(role).alias(name))
    return raw.select(_id(ids).alias("_id"), *props)


def read_edges(spark: SparkSession, path: str) -> tuple[DataFrame, str | None, str | None]:
    raw, fields = read_csv(spark, path)
    ends: dict[str, list[Column]] = {"start": [], "end": []}
    labels: dict[str, str | None] = {}
    props = []
    for k, (name, role, label) in enumerate(fields):
        col = F.col(f"c{k}")
        kind = role.rstrip("0123456789")
        if kind in ends:
            ends[kind].append(col.cast("bigint"))
            labels[kind] = label
        else:
            props.append(col.cast(role).alias(name))
    df = raw.select(_id(ends["start"]).alias("_sid"), _id(ends["end"]).alias("_tid"), *props)
    return df, labels.get("start"), labels.get("end")


def drop_dangling(edges: DataFrame, src: DataFrame, dst: DataFrame) -> DataFrame:
    """edges of which both ends are there."""
    out = edges.join(src.select(F.col("_id").alias("_sid")), "_sid", "left_semi")
    return out.join(dst.select(F.col("_id").alias("_tid")), "_tid", "left_semi")


def import_vertices(graph: Graph, label: str, paths: str | list[str], form: str = "csv") -> None:
    """label: a leaf label, or leaf:Parent:..."""
    name, *parents = label.split(":")
    frames = [(read_vertices if form == "csv" else read_json_vertices)(graph.spark, p) for p in ([paths] if isinstance(paths, str) else paths)]
    df = frames[0]
    for f in frames[1:]:
        df = df.unionByName(f, allowMissingColumns=True)
    if name in graph.catalog.vertices:
        df = graph.catalog.vertices[name].df.unionByName(df, allowMissingColumns=True)
    graph.catalog.add_vertices(name, df, parents=tuple(parents))


def import_edges(graph: Graph, type_: str, path: str, form: str = "csv", src: str | None = None, dst: str | None = None) -> int:
    """Adds edges of a type (also to those that are there); gives how many were dropped for want of an end."""
    df, start, end = read_edges(graph.spark, path) if form == "csv" else (*read_json_edges(graph.spark, path), None, None)
    src, dst = src or start, dst or end
    if src not in graph.catalog.vertices or dst not in graph.catalog.vertices:
        raise KeyError(f"vertices of {src} and {dst} come first")
    # settled, so that an edge has one number in all uses
    kept = settle(drop_dangling(df, graph.catalog.vertices[src].df, graph.catalog.vertices[dst].df), "imported")
    dropped = df.count() - kept.count()
    old = next((t for t in graph.catalog.edges.get(type_, []) if (t.src, t.dst) == (src, dst)), None)
    if old is None:
        graph.catalog.add_edges(type_, src, dst, kept)
    else:
        first = (old.df.agg(F.max("_eid")).first()[0] or 0) + 1
        old.df = old.df.unionByName(kept.withColumn("_eid", F.monotonically_increasing_id() + first), allowMissingColumns=True)
    return dropped


def _lenient(text: str) -> str:
    """Trailing commas go and Inf becomes the word that Spark reads; strings stay as they are."""
    return re.sub(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])|\bInf(?:inity)?\b', lambda m: m[1] or ("" if m[0] == "," else "Infinity"), text, flags=re.S)


def _json_rows(spark: SparkSession, path: str, key: str) -> DataFrame:
    whole = spark.read.text(path, wholetext=True)
    parsed = spark.read.option("allowNonNumericNumbers", True).json(whole.rdd.map(lambda r: _lenient(r[0])))
    return parsed.select(F.inline(key))


def read_json_vertices(spark: SparkSession, path: str) -> DataFrame:
    df = _json_rows(spark, path, "vertices")
    key = next(x for x in df.columns if x.lower() in ("_id", "id"))
    return df.withColumn("_id", F.col(key).cast("bigint"))


def read_json_edges(spark: SparkSession, path: str) -> tuple[DataFrame]:
    df = _json_rows(spark, path, "edges")
    names = {x.lower(): x for x in df.columns}
    start = next(names[x] for x in ("start_id", "src", "source", "_sid", "start") if x in names)
    end = next(names[x] for x in ("end_id", "dst", "target", "_tid", "end") if x in names)
    return (df.withColumnsRenamed({start: "_sid", end: "_tid"}).withColumns({"_sid": F.col("_sid").cast("bigint"), "_tid": F.col("_tid").cast("bigint")}),)
