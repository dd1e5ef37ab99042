"""Connected components of an edge list by rounds of hooking each node to its smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import scratch_path


def _written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of random 64-bit node keys to ``(node, root)``, one row per node that has an edge.

    Each round maps every node to the smallest of itself and its neighbours and rewrites the edges to the
    mapped nodes; edges inside a node go. As the keys are random, a chain shrinks by a constant share in
    each round. Every round is written to the shared folder, so lineage stays short, and its edges are
    distinct and go down round by round. Nulls, loops and repeated edges are allowed. Minima are taken
    before the shuffle, so a node with very many edges is no hot key there.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left = _written(spark, both.where("a <> b").distinct(), "edges")
    mapped: DataFrame | None = None
    while not left.isEmpty():
        parent = _written(
            spark, left.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "parents"
        )
        if mapped is None:
            mapped = parent
        else:
            step = mapped.withColumnRenamed("root", "mid").join(parent.withColumnRenamed("node", "mid"), "mid", "left")
            mapped = _written(spark, step.select("node", F.coalesce("root", "mid").alias("root")), "mapped")
        a = parent.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = parent.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = _written(
            spark,
            left.join(a, "a").join(b, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(),
            "edges",
        )
    if mapped is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return mapped
