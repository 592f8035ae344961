"""Streams of many micro-batches whose results are kept in stores.

Every job reads only what a batch touches, holds no row of earlier batches in memory beyond a
watermark, and gives the same result when a batch is delivered again.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from bidgraph.plans.storage import discard, materialize, new_path
from bidgraph.sources.files import validate
from bidgraph.sources.store import Folder, Store, first_rows, newest_rows


def arriving(spark: SparkSession, rows: DataFrame, order: str, files: int = 6) -> DataFrame:
    """``rows`` as a stream of files in ascending ranges of ``order``, a file per micro-batch."""
    path = new_path(spark, "arriving")
    rows.repartitionByRange(files, order).sortWithinPartitions(order).write.parquet(path)
    folder = Folder(spark, path)
    for k, name in enumerate(n for n in folder.names() if n.startswith("part-")):
        folder.set_time(name, 1_600_000_000_000 + 1000 * k)  # files are taken by their times
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("maxFileAge", "36500d").parquet(path)


def run(stream: DataFrame, sink) -> int:
    """Hand all that is there to ``sink`` batch by batch; the number of batches."""
    writer = stream.writeStream.option("checkpointLocation", new_path(stream.sparkSession, "stream-state")).trigger(availableNow=True)
    query = writer.foreachBatch(sink).start()
    query.awaitTermination()
    return len({p["batchId"] for p in query.recentProgress})


def ingest_sink(bids: Store, rejects_path: str, source: str = "bids"):
    """Valid bids go to ``bids`` once per key over all batches, rejects to a folder per batch, which a repeated batch overwrites."""

    def write(batch: DataFrame, number: int) -> None:
        raw = materialize(batch, "batch")
        valid, rejects = validate(raw)
        rejects.write.mode("overwrite").parquet(f"{rejects_path}/batch={number}")
        rows = materialize(valid, "valid")
        bids.commit(rows, first_rows(bids.keys), (source, number))
        bids.tidy()
        discard(batch.sparkSession, raw, rows)

    return write


def upsert_sink(table: Store, version: str, source: str = "rows"):
    """The row of the highest version of each key."""

    def write(batch: DataFrame, number: int) -> None:
        rows = materialize(batch, "batch")
        table.commit(rows, newest_rows(table.keys, version), (source, number))
        table.tidy()
        discard(batch.sparkSession, rows)

    return write


def status_sink(status: Store, audit_path: str, initial: str = "Needs Review", source: str = "actions"):
    """(bid_id, action_seq, new_status): a status per bid, and audit rows with the status that each action found.

    Audit rows are written before the status is committed: a batch that failed in between finds the
    old status again and overwrites its own audit rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        if status.seen((source, number)):
            return
        rows = materialize(batch.select("bid_id", "action_seq", "new_status"), "actions")
        held = status.read(_STATUS, status.touched(rows)).select("bid_id", F.col("status").alias("left_status"))
        before = F.lag("new_status").over(W.partitionBy("bid_id").orderBy("action_seq"))
        audit = rows.withColumn("before", before).join(held, "bid_id", "left")
        audit.select("bid_id", "action_seq", "new_status", F.coalesce("before", "left_status", F.lit(initial)).alias("previous_status")).write.mode("overwrite").parquet(f"{audit_path}/batch={number}")
        last = rows.groupBy("bid_id").agg(F.max_by("new_status", "action_seq").alias("status"), F.max("action_seq").alias("action_seq"), F.count("*").alias("actions"))

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            both = old.unionByName(new)
            return both.groupBy("bid_id").agg(F.max_by("status", "action_seq").alias("status"), F.max("action_seq").alias("action_seq"), F.sum("actions").alias("actions"))

        status.commit(materialize(last, "status"), merge, (source, number))
        status.tidy()

    return write


_STATUS = "bid_id string, status string, action_seq long, actions long"


def figures_sink(figures: Store, source: str = "bids"):
    """(tender_id, company_id, best_bid, bids) of each tender and bidder, summed up over batches; ``tender_figures`` reads them."""

    def write(batch: DataFrame, number: int) -> None:
        per = batch.groupBy("tender_id", "company_id").agg(F.min("bid_amount").alias("best_bid"), F.count("*").alias("bids"))
        rows = materialize(per, "figures")
        figures.commit(rows, lambda old, new: old.unionByName(new).groupBy("tender_id", "company_id").agg(F.min("best_bid").alias("best_bid"), F.sum("bids").alias("bids")), (source, number))
        figures.tidy()
        discard(batch.sparkSession, rows)

    return write


def tender_figures(figures: DataFrame) -> DataFrame:
    """Lowest bid, number of bids and exact number of bidders per tender."""
    return figures.groupBy("tender_id").agg(F.min("best_bid").alias("best_bid"), F.sum("bids").alias("bids"), F.count("company_id").alias("bidders"))


def limited_attempts(stream: DataFrame, key: str, id_col: str, time_col: str = "ts", seconds: int = 60, limit: int = 10, delay: str = "10 minutes") -> DataFrame:
    """(key, id, opened, attempt, limited) of each attempt, in windows that open at a key's first attempt and close ``seconds`` later.

    The state of a key is its open window.  It goes when the watermark has passed the window's end,
    so as many keys are held as tried within the delay.  A micro-batch that brings a key's attempts
    hands them over in order; the stream itself has to bring them in order.
    """
    held = "opened long, attempt long"
    out = f"{key} string, {id_col} long, opened timestamp, attempt long, limited boolean"
    width = seconds * 1_000_000

    def fold(group, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        opened, attempt = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["at", id_col])
        found = []
        for at, which in zip(rows["at"].tolist(), rows[id_col].tolist()):
            if opened is None or at >= opened + width:
                opened, attempt = at, 0
            attempt += 1
            found.append((group[0], which, pd.Timestamp(opened, unit="us"), attempt, attempt > limit))
        state.update((opened, attempt))
        state.setTimeoutTimestamp(max((opened + width) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(found, columns=[key, id_col, "opened", "attempt", "limited"])

    rows = stream.select(F.col(key).cast("string").alias(key), F.col(id_col).cast("long").alias(id_col), F.col(time_col), F.unix_micros(time_col).alias("at")).withWatermark(time_col, delay)
    return rows.groupBy(key).applyInPandasWithState(fold, out, held, "append", GroupStateTimeout.EventTimeTimeout)
