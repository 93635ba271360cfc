"""Path operators over an edge table: trails of bounded or open length, shortest and all shortest paths, path weights.

Edges have columns ` from`, ` flabel`, ` to`, ` tlabel`, ` eid`, one row for each way that they can be walked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import settle


def c(name: str):
    return F.col(f"`{name}`")


def _begin(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    kind = edges.schema[" eid"].dataType.simpleString()
    return seeds.select(" s", " sl", c(" s").alias(" e"), c(" sl").alias(" el"), F.array().cast(f"array<{kind}>").alias(" rels"), F.array(c(" s")).alias(" nodes"))


def _walk(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    joined = frontier.join(edges, (c(" e") == c(" from")) & (c(" el") == c(" flabel"))).where(~F.array_contains(c(" rels"), c(" eid")))
    return joined.select(c(" s"), c(" sl"), c(" to").alias(" e"), c(" tlabel").alias(" el"), F.concat(c(" rels"), F.array(c(" eid"))).alias(" rels"), F.concat(c(" nodes"), F.array(c(" to"))).alias(" nodes"))


def trails(seeds: DataFrame, edges: DataFrame, least: int, most: int | None, max_hops: int = 30) -> DataFrame:
    """All trails (no edge twice) of least to most edges from the seeds (` s`, ` sl`); one row a path, ends in ` e`, ` el`.

    Without an upper bound the walk goes on until nothing is left to walk, and fails beyond max_hops rather than stop short."""
    level, found = _begin(seeds, edges), []
    if least == 0:
        found.append(level)
    k = 0
    while most is None or k < most:
        level, k = _walk(level, edges), k + 1
        if most is None:
            level = settle(level, "trails")
            if level.isEmpty():
                break
            if k > max_hops:
                raise RuntimeError(f"trails go on beyond {max_hops} edges: give the path an upper bound")
        if k >= least:
            found.append(level)
    return reduce(DataFrame.unionAll, found) if found else level.where("false")


def shortest_paths(pairs: DataFrame, edges: DataFrame, least: int, most: int | None, every: bool, max_hops: int = 30) -> DataFrame:
    """For pairs (` s`, ` sl`, ` e`, ` el`) a shortest path, or all of them; pairs without a path give no row.

    Breadth first, all sources together: a level holds the vertices first reached in so many steps.  Of equally short
    paths the one with the least list of edges counts, where one is asked for."""
    wanted = settle(pairs, "pairs")
    level = _begin(wanted.select(" s", " sl").distinct(), edges)
    keys = [" s", " sl", " e", " el"]
    seen = [level.select(*keys)] if least == 0 else []  # a way back to the start is a path
    found = [level.join(wanted, keys, "left_semi")] if least == 0 else []
    k = 0
    while k < (most if most is not None else max_hops):
        level, k = _walk(level, edges), k + 1
        if not (k < least):
            level = level.join(reduce(DataFrame.unionAll, seen), keys, "left_anti") if least < 2 and seen else level
        if not every:
            first = Window.partitionBy(*map(c, keys)).orderBy(c(" rels"))
            level = level.withColumn(" n", F.row_number().over(first)).where("` n` = 1").drop(" n")
        level = settle(level, "level")
        if level.isEmpty():
            break
        hits = level.join(wanted, keys, "left_semi")
        found.append(hits)
        seen.append(level.select(*keys))  # settled already
        wanted = wanted.join(hits.select(*keys).distinct(), keys, "left_anti")
        if wanted.isEmpty():
            break
        wanted = settle(wanted, "pairs")
        level = level.join(wanted.select(" s", " sl").distinct(), [" s", " sl"], "left_semi")  # sources with nothing left to find stop
    else:
        if most is None and not wanted.isEmpty() and not level.isEmpty():
            raise RuntimeError(f"shortest paths are longer than {max_hops} edges")
    return reduce(DataFrame.unionAll, found) if found else level.where("false").select(*keys, " rels", " nodes")


def pair_weights(hops: list[DataFrame], weight: float = 1.0) -> DataFrame:
    """(a, b, w): weight times the number of matches of a chain of edge tables (` from`, ` to`) between a and b."""
    out = hops[0].select(c(" from").alias("a"), c(" to").alias("b"))
    for h in hops[1:]:
        out = out.join(h.select(c(" from").alias("b"), c(" to").alias("n")), "b").select("a", c("n").alias("b"))
    return out.groupBy("a", "b").agg((F.count(F.lit(1)) * weight).alias("w"))


def path_weight(paths: DataFrame, weights: DataFrame, nodes: str = "nodes") -> DataFrame:
    """paths with weight: the sum over neighbours on the path of the weights of their pair, in either order."""
    both = weights.union(weights.select("b", "a", "w")).groupBy("a", "b").agg(F.sum("w").alias("w"))
    numbered = paths.withColumn("_steps", F.transform(F.sequence(F.lit(0), F.size(nodes) - 2), lambda k: F.struct(F.get(c(nodes), k).alias("a"), F.get(c(nodes), k + 1).alias("b"))))
    numbered = numbered.withColumn("_steps", F.when(F.size(nodes) > 1, c("_steps")).otherwise(F.slice(c("_steps"), 1, 0)))
    steps = numbered.select(c(nodes).alias("n"), F.explode("_steps").alias("s")).distinct()
    summed = steps.join(both, (F.col("s.a") == F.col("a")) & (F.col("s.b") == F.col("b"))).groupBy("n").agg(F.sum("w").alias("weight"))
    return paths.join(summed, paths[nodes] == summed["n"], "left").drop("n").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
