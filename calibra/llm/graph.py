"""Connected components of a distributed edge list."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.llm._common import cut, drop


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of edges (a long, b long): comp is the smallest node reachable, itself included.

    Each round points every node at its smallest neighbour and contracts the edges by that; edges within one node go.
    Nothing is collected; the rounds are few because stars collapse in two. Each round's tables are cut, and those of
    the round before deleted.
    """
    edges = cut(edges.filter("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = cut(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("comp", F.col("node")))
    old, edges = edges, cut(edges.filter("a <> b"))
    drop(old)
    while not edges.isEmpty():
        step = cut(edges.select(F.explode(F.array(F.struct(F.col("a").alias("comp"), F.col("a").alias("to")), F.struct(F.col("b").alias("comp"), F.col("a").alias("to")), F.struct(F.col("a").alias("comp"), F.col("b").alias("to")))).alias("s")).groupBy("s.comp").agg(F.min("s.to").alias("to")))
        old, labels = (labels, edges, step), cut(labels.join(step, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")))
        moved = edges.join(step.toDF("a", "a2"), "a").join(step.toDF("b", "b2"), "b").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
        edges = cut(moved.filter("a <> b").distinct())
        drop(*old)
    drop(edges)
    return labels
