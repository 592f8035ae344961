"""Structured Streaming jobs whose state Spark keeps: ingest, running tender figures, rate limits.

Each takes a streaming DataFrame; with the ``availableNow`` trigger the result is that of the batch
job.  ``batches`` has the jobs that keep their results in stores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidgraph.sources.files import validate


def submissions(stream: DataFrame, time_col: str = "ts", delay: str = "1 day", keys: tuple[str, ...] = ("company_id", "tender_id")) -> tuple[DataFrame, DataFrame]:
    """(valid without repeats inside the watermark, rejects) of raw bids."""
    valid, rejects = validate(stream)
    return valid.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(list(keys)), rejects


def running_tenders(stream: DataFrame) -> DataFrame:
    """Best bid and approximate number of bidders per tender, for update mode."""
    return stream.groupBy("tender_id").agg(F.min("bid_amount").alias("best_bid"), F.approx_count_distinct("company_id").alias("bidders"), F.count("*").alias("bids"))


def over_limit(stream: DataFrame, key: str, time_col: str = "ts", window: str = "1 minute", limit: int = 10, delay: str = "10 minutes") -> DataFrame:
    """Attempts per key and tumbling window, and whether they exceed the limit."""
    counted = stream.withWatermark(time_col, delay).groupBy(F.window(time_col, window).alias("w"), key).agg(F.count("*").alias("attempts"))
    return counted.select(key, F.col("w.start").alias("start"), "attempts", (F.col("attempts") > limit).alias("limited"))
