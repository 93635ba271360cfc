"""The star-schema tables as a graph: labels are tables, edges are foreign keys, kept in the vertices' own columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import Graph


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    g = Graph(spark)
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    for name, key in (("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"), ("orders", "o_orderkey")):
        g.catalog.add_vertices(name.upper(), read(name), key)
    # lineitem has no key: a row's place in its file, and the file
    items = read("lineitem")
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    g.catalog.add_vertices("LINEITEM", items.withColumn("_id", place))
    for type_, src, dst, key in (
        ("IS_LOCATED_IN", "NATION", "REGION", "n_regionkey"),
        ("CUST_BELONG_TO", "CUSTOMER", "NATION", "c_nationkey"),
        ("SUPP_BELONG_TO", "SUPPLIER", "NATION", "s_nationkey"),
        ("MADE_BY", "ORDERS", "CUSTOMER", "o_custkey"),
        ("IS_PART_OF", "LINEITEM", "ORDERS", "l_orderkey"),
        ("SUPPLIED_BY", "LINEITEM", "SUPPLIER", "l_suppkey"),
        ("COMPOSED_BY", "LINEITEM", "PART", "l_partkey"),
    ):
        g.catalog.add_key_edges(type_, src, dst, key)
    return g


def with_partsupp(g: Graph) -> Graph:
    """PARTSUPP from the distinct pairs of part and supplier of the lines."""
    items = g.catalog.vertices["LINEITEM"].df
    pairs = items.select(F.col("l_partkey").alias("_sid"), F.col("l_suppkey").alias("_tid")).distinct()
    g.catalog.add_edges("PARTSUPP", "PART", "SUPPLIER", pairs.withColumn("_eid", F.xxhash64("_sid", "_tid")))
    return g


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NATION to NATION: for each customers' nation the two suppliers' nations with most lines."""
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    items, orders, customers, suppliers = read("lineitem"), read("orders"), read("customer"), read("supplier")
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    counted = joined.where("c_nationkey <> s_nationkey").groupBy("c_nationkey", "s_nationkey").agg(F.count(F.lit(1)).alias("lines"))
    ranked = counted.withColumn("n", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("lines"), "s_nationkey"))).where("n <= 2")
    return ranked.select(F.col("c_nationkey").alias("_sid"), F.col("s_nationkey").alias("_tid"), "lines", (F.col("c_nationkey") * 1000 + F.col("s_nationkey")).cast("long").alias("_eid"))


def trade_graph(spark: SparkSession, sf_dir: str) -> Graph:
    g = star_graph(spark, sf_dir)
    g.catalog.add_edges("TRADES", "NATION", "NATION", trades(spark, sf_dir))
    return g
