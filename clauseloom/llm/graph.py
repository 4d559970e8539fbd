"""Connected components by contraction, as joins over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _edges(df: DataFrame) -> DataFrame:
    return df.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u < v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (u, v): the smallest node reachable.

    Each round hooks every node to its smallest neighbour, jumps pointers twice
    and contracts the edges, so a chain shrinks at least fourfold a round. Hot
    nodes only meet partial aggregates and joins that Spark can split.
    """
    e = written(_edges(edges), "cc-edges")
    labels = e.select(F.col("u").alias("node"), F.col("u").alias("comp")).limit(0)
    first = True
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("p")), "cc-parent")
        up = parent.select(F.col("x").alias("p"), F.col("p").alias("q"))
        twice = parent.join(up, "p").select("x", F.col("q").alias("p"))
        parent = written(twice.join(up, "p").select("x", F.col("q").alias("p")), "cc-jump")
        if first:
            labels = parent.select(F.col("x").alias("node"), F.col("p").alias("comp"))
        else:
            labels = labels.join(parent.withColumnRenamed("x", "comp"), "comp", "left").select("node", F.coalesce("p", "comp").alias("comp"))
            labels = written(labels, "cc-labels")
        first = False
        at = lambda c, to: parent.select(F.col("x").alias(c), F.col("p").alias(to))
        e = written(_edges(e.join(at("u", "a"), "u").join(at("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))), "cc-edges")
    return labels
