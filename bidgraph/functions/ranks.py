"""Places and running sums in one order of all rows, without a window over all of them.

Rows are dealt to ranges of the order, and what stands before a range is added to the sums inside
it.  Rows that are equal in the order meet in one range, so values that repeat are to be grouped
first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidgraph.plans.storage import materialize

RANGES = 64  # least number of ranges; else as many as shuffles have


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], within: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with a running sum, its own row included, under each name of ``sums``; anew for each value of ``within``."""
    n = max(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    valued = df.withColumns({f"_{name}": value for name, value in sums.items()})
    ranged = materialize(valued.repartitionByRange(n, *within, *order).withColumn("_range", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy(*within, "_range").agg(*[F.sum(f"_{name}").alias(f"_{name}") for name in sums])
    earlier = W.partitionBy(*within).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # one row per range
    before = totals.select(*within, "_range", *[F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)).alias(f"_before_{name}") for name in sums])
    upto = W.partitionBy(*within, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = ranged.select(*df.columns, "_range", *[F.sum(f"_{name}").over(upto).alias(f"_{name}") for name in sums])
    joined = inside.join(F.broadcast(before) if not within else before, [*within, "_range"])
    return joined.select(*df.columns, *[(F.col(f"_{name}") + F.col(f"_before_{name}")).alias(name) for name in sums])


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with the place, from 1 on, of each row in an order that tells all rows apart."""
    return running(df, order, {name: F.lit(1).cast("long")})
