"""Bounded neighbourhoods: the nearest nodes of each seed, by hops and then by id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidgraph.plans.storage import discard, materialize

LIMIT = 500


def neighbours_within(edges: DataFrame, seeds: DataFrame, depth: int = 1, limit: int = LIMIT) -> DataFrame:
    """(seed, id, hops): the first ``limit`` nodes within ``depth`` hops of each seed (id), nearer ones and then smaller ids first.

    A node that has more neighbours is cut to its ``limit`` + 1 smallest before it is expanded: a
    seed that has reached r nodes takes at most ``limit`` - r more, and besides these only itself
    and the r nodes can stand before them in the list.  So no step makes more than ``limit`` times
    that many rows a seed, however large the hubs are.  Only edges at the nodes that a step expands are
    looked at.
    """
    if not 1 <= depth <= 4:
        raise ValueError("neighbours are looked up within 1 to 4 hops")
    spark = edges.sparkSession
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst")
    first = F.row_number().over(W.partitionBy("src").orderBy("dst"))
    reached = materialize(seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("hops")).distinct(), "reached")
    frontier = reached
    for hop in range(1, depth + 1):
        asked = materialize(frontier.select(F.col("id").alias("src")).distinct(), "asked")
        near = both.join(asked, "src", "left_semi").distinct()
        around = materialize(near.withColumn("place", first).where(F.col("place") <= limit + 1).select("src", "dst"), "around")
        step = frontier.join(around, F.col("id") == F.col("src")).select("seed", F.col("dst").alias("id")).distinct().join(reached.select("seed", "id"), ["seed", "id"], "left_anti")
        taken = reached.groupBy("seed").agg((F.count("*") - 1).alias("taken"))
        place = F.row_number().over(W.partitionBy("seed").orderBy("id"))  # limit * (limit + 1) rows at most
        room = step.withColumn("place", place).where(F.col("place") <= limit).join(taken, "seed").where(F.col("place") <= limit - F.col("taken"))
        frontier = materialize(room.select("seed", "id", F.lit(hop).alias("hops")), "frontier")
        more = materialize(reached.unionByName(frontier), "reached")
        discard(spark, reached, around)
        reached = more
    return reached.where("hops > 0")
