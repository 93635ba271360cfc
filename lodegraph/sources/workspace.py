"""A workspace: a folder of Parquet tables and a catalog file, all written and read by Spark."""

from __future__ import annotations

import json
import uuid

from ..graph import Graph


def save(graph: Graph, path: str) -> None:
    """Writes every table into a new folder below path; the catalog comes last, so that a workspace is whole at any time.

    The graph may itself have come from path: the tables that it reads stay as they are."""
    turn = f"tables-{uuid.uuid4().hex[:12]}"
    meta: dict = {"vertices": [], "edges": []}
    for k, v in enumerate(graph.catalog.vertices.values()):
        v.df.write.parquet(f"{path}/{turn}/vertices/{k}")
        meta["vertices"].append({"name": v.name, "parents": list(v.parents), "table": f"{turn}/vertices/{k}"})
    k = 0
    for own in graph.catalog.edges.values():
        for t in own:
            entry = {"type": t.type, "src": t.src, "dst": t.dst, "key": t.key}
            if t.df is not None:
                t.df.write.parquet(f"{path}/{turn}/edges/{k}")
                entry["table"] = f"{turn}/edges/{k}"
                k += 1
            meta["edges"].append(entry)
    graph.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/catalog")


def load(spark, path: str) -> Graph:
    meta = json.loads(spark.read.text(f"{path}/catalog").first()[0])
    graph = Graph(spark)
    for v in meta["vertices"]:
        graph.catalog.add_vertices(v["name"], spark.read.parquet(f"{path}/{v['table']}"), parents=tuple(v["parents"]))
    for e in meta["edges"]:
        if e.get("table"):
            graph.catalog.add_edges(e["type"], e["src"], e["dst"], spark.read.parquet(f"{path}/{e['table']}"))
        else:
            graph.catalog.add_key_edges(e["type"], e["src"], e["dst"], e["key"])
    return graph
