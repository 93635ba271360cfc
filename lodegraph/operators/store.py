"""Settling intermediate results in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is unset: intermediate tables need a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lodegraph-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path there."""
    return f"{shared_dir(spark)}/lodegraph/{name.strip()}-{uuid.uuid4().hex[:12]}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes df there and rereads it: iterations keep a short lineage and survive lost executors."""
    path = scratch(df.sparkSession, name)
    names = [f"c{k}" for k in range(len(df.columns))]
    df.toDF(*names).write.parquet(path)
    return df.sparkSession.read.schema(df.toDF(*names).schema).parquet(path).toDF(*df.columns)


#: Plan nodes that give the same rows each time that they run over the same rows; sums of fractions, limits and the first of equals needn't.
STEADY = {"Project", "Filter", "Join", "Union", "Generate", "Sort", "Distinct", "SubqueryAlias", "View", "LogicalRelation", "Relation", "LocalRelation", "OneRowRelation", "Range"}


def same_rows(df: DataFrame) -> DataFrame:
    """df, or a copy of its rows if they could differ when df is read twice."""
    plan = df._jdf.queryExecution().analyzed()
    nodes, steady = [plan], plan.deterministic()
    while nodes and steady:
        node = nodes.pop()
        steady = node.nodeName().split(" ")[0] in STEADY
        inner = node.children()
        nodes += [inner.apply(k) for k in range(inner.size())]
    if steady:
        return df
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
