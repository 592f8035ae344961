"""The streaming jobs over the events, which arrive in several files, one per micro-batch."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidgraph.plans.portfolio_queries import actions_of
from bidgraph.plans.storage import new_path
from bidgraph.plans.tables import table
from bidgraph.sources.store import Store
from bidgraph.streaming import batches, jobs

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
FILES = 6


def _events(spark, folder):
    """The events in their order as a stream of FILES files."""
    rows = table(spark, folder, "events")
    return batches.arriving(spark, rows.withColumn("ts", F.col("ts").cast("timestamp")), "event_id", FILES)


def stream_rate_limit(spark, folder):
    """Attempts per user and hour, over 10 flagged.

    Every update of a window is written and the last one counts, so the windows that are still open
    are there too, as of now.
    """
    counted = jobs.over_limit(_events(spark, folder), "user_id", window="1 hour", delay="10 minutes")
    out = new_path(spark, "stream")
    writer = counted.writeStream.outputMode("update").option("checkpointLocation", new_path(spark, "stream-state")).trigger(availableNow=True)
    writer.foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")).start().awaitTermination()
    updates = spark.read.schema(T.StructType([*counted.schema.fields, T.StructField("epoch", T.IntegerType())])).parquet(out)
    return updates.groupBy("user_id", "start").agg(F.max_by(F.struct("attempts", "limited"), "epoch").alias("last")).select("user_id", "start", "last.attempts", "last.limited")


def _bids(spark, folder):
    """Raw bids out of events; errors lack a tender."""
    return _events(spark, folder).select(F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("company_id"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("tender_id"), F.col("value").cast("string").alias("bid_amount"), "event_id")


def _ingested(spark, folder):
    bids, rejects = Store(spark, new_path(spark, "bids"), ["company_id", "tender_id"]), new_path(spark, "rejects")
    batches.run(_bids(spark, folder), batches.ingest_sink(bids, rejects))
    return bids, spark.read.schema("company_id string, tender_id string, bid_amount string, event_id long, errors array<string>").parquet(rejects)


def stream_ingest(spark, folder):
    """Bids read as a stream, validated, without repeats of earlier batches."""
    return _ingested(spark, folder)[0].read().select("company_id", "tender_id")


def stream_rejects(spark, folder):
    """What the stream's validation refuses, with the reasons."""
    return _ingested(spark, folder)[1].select("event_id", "company_id", "errors")


def stream_upsert(spark, folder):
    """The newest event of each user, kept by an upsert per micro-batch."""
    users = Store(spark, new_path(spark, "upsert"), ["user_id"])
    batches.run(_events(spark, folder).select("user_id", "event_id", "event_type"), batches.upsert_sink(users, "event_id"))
    return users.read()


def _acted(spark, folder):
    status, audit = Store(spark, new_path(spark, "status"), ["bid_id"]), new_path(spark, "audit")
    batches.run(actions_of(_events(spark, folder)), batches.status_sink(status, audit))
    return status, spark.read.schema("bid_id string, action_seq long, new_status string, previous_status string").parquet(audit)


def stream_status(spark, folder):
    """The status that verification actions leave, read as a stream."""
    return _acted(spark, folder)[0].read().select("bid_id", "status")


def stream_audit(spark, folder):
    """The audit rows of the same stream: each action with the status that it found, over all micro-batches."""
    return _acted(spark, folder)[1].select("bid_id", "action_seq", "new_status", "previous_status")


def stream_running_best(spark, folder):
    """Lowest value, number of rows and of bidders per user, as of a tender's bids."""
    bids = _events(spark, folder).select(F.col("user_id").alias("tender_id"), F.col("value").alias("bid_amount"), F.col("event_type").alias("company_id"))
    figures = Store(spark, new_path(spark, "figures"), ["tender_id", "company_id"])
    batches.run(bids, batches.figures_sink(figures))
    return batches.tender_figures(figures.read())


def stream_limited_attempts(spark, folder):
    """Each attempt of a route (event type) in windows of six hours that open at the first attempt; over 3 are limited."""
    out = new_path(spark, "attempts")
    attempts = batches.limited_attempts(_events(spark, folder), "event_type", "event_id", seconds=6 * 3600, limit=3)
    writer = attempts.writeStream.outputMode("append").option("checkpointLocation", new_path(spark, "stream-state")).trigger(availableNow=True)
    writer.format("parquet").option("path", out).start().awaitTermination()
    return spark.read.schema(attempts.schema).parquet(out)


QUERIES |= {f.__name__: f for f in (stream_rate_limit, stream_running_best, stream_ingest, stream_rejects, stream_upsert, stream_status, stream_audit, stream_limited_attempts)}
ORACLE_SQL["stream_rate_limit"] = "SELECT user_id, date_trunc('hour', CAST(ts AS TIMESTAMP)) AS start, count(*) AS attempts, count(*) > 10 AS limited FROM events GROUP BY 1, 2"
ORACLE_SQL["stream_ingest"] = "SELECT DISTINCT 'S' || user_id AS company_id, event_type AS tender_id FROM events WHERE event_type <> 'error' AND (value IS NULL OR value > 0)"
ORACLE_SQL["stream_upsert"] = "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id"
ORACLE_SQL["stream_status"] = "SELECT bid_id, arg_max(new_status, action_seq) AS status FROM (SELECT 'BID-' || (user_id % 500) AS bid_id, event_id AS action_seq, CASE event_type WHEN 'purchase' THEN 'Verified' WHEN 'error' THEN 'Flagged' ELSE 'Needs Review' END AS new_status FROM events) GROUP BY bid_id"
ORACLE_SQL["stream_running_best"] = "SELECT user_id AS tender_id, min(value) AS best_bid, count(*) AS bids, count(DISTINCT event_type) AS bidders FROM events GROUP BY user_id"
ORACLE_SQL["stream_rejects"] = "SELECT event_id, 'S' || user_id AS company_id, list_filter([CASE WHEN event_type = 'error' THEN 'tender_id: missing' END, CASE WHEN value <= 0 THEN 'bid_amount: not a positive amount' END], lambda e: e IS NOT NULL) AS errors FROM events WHERE event_type = 'error' OR value <= 0"
ORACLE_SQL["stream_audit"] = "WITH a AS (SELECT 'BID-' || (user_id % 500) AS bid_id, event_id AS action_seq, CASE event_type WHEN 'purchase' THEN 'Verified' WHEN 'error' THEN 'Flagged' ELSE 'Needs Review' END AS new_status FROM events) SELECT *, lag(new_status, 1, 'Needs Review') OVER (PARTITION BY bid_id ORDER BY action_seq) AS previous_status FROM a"
ORACLE_SQL["stream_limited_attempts"] = """WITH RECURSIVE e AS (SELECT event_type, event_id, CAST(ts AS TIMESTAMP) AS ts FROM events),
  next AS (SELECT DISTINCT event_type, ts, min(ts) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM e),
  w AS (SELECT event_type, min(ts) AS opened FROM e GROUP BY event_type UNION ALL SELECT w.event_type, after FROM w JOIN next ON w.event_type = next.event_type AND w.opened = next.ts WHERE after IS NOT NULL),
  a AS (SELECT e.event_type, event_id, opened, row_number() OVER (PARTITION BY e.event_type, opened ORDER BY e.ts, event_id) AS attempt FROM e ASOF JOIN w ON e.event_type = w.event_type AND e.ts >= w.opened)
SELECT *, attempt > 3 AS limited FROM a"""
