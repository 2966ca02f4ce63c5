"""Connected components of an edge table by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.sizes import store


def _to_least(edges: DataFrame) -> DataFrame:
    """Each edge ``u, v`` with ``least``: the smallest node among ``u`` and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    return edges.join(least, "u").withColumn("least", F.least("u", "least"))


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").groupBy("u", "v").agg(F.lit(1).alias("one")).drop("one")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node that an edge names; the root is the smallest node it can reach.

    ``edges``: ``u, v`` of one sortable type without NULLs. Rounds go on until nothing changes. Each round
    writes its edges to the shared folder, so the plan does not grow and a lost executor costs one
    round. A node with very many edges is one hot join key, which adaptive execution splits.
    """
    now = store(_distinct(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        down = _distinct(large)
        small = _to_least(down)
        small = small.select(F.col("u"), F.col("least").alias("v")).unionByName(small.where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v")))
        now = store(_distinct(small), "edges")
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen:
            break
        seen = mark
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").groupBy("node", "root").agg(F.lit(1).alias("one")).drop("one"))
