"""Connected components by alternating large-star and small-star (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidgraph.plans.storage import discard, materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges u > v.

    The minima are written first: both sides of the join then have an exchange of their own, and
    adaptive execution can split the rows of a node with very many neighbours.
    """
    spark = edges.sparkSession
    around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    minima = materialize(around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "minima")
    joined = around.join(minima, "u")
    if large:
        new = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        new = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(minima.select("u", F.col("m").alias("v")))
    out = materialize(new.where("u <> v").distinct(), "star")
    discard(spark, minima)
    return out


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node that has a link.

    ``links``: two long columns, in any order and repeated at will; null ends and self-links are
    left out.
    """
    one, two = links.columns
    edges = links.where(F.col(one) != F.col(two)).select(F.greatest(one, two).alias("u"), F.least(one, two).alias("v"))
    edges = materialize(edges.distinct(), "edges")
    before = _state(edges)
    while before[0]:
        middle = _star(edges, large=True)
        after = _star(middle, large=False)
        discard(links.sparkSession, middle)
        discard(links.sparkSession, edges)
        edges, state = after, _state(after)
        if state == before:
            break
        before = state
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
