"""Queries of bid history, verification requests and appended bids, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidgraph.operators import records
from bidgraph.operators.portfolio import lowest_bids
from bidgraph.plans.portfolio_queries import CTE, with_tables
from bidgraph.plans.storage import materialize
from bidgraph.plans.tables import table
from bidgraph.sources import market

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

CTE |= {
    "requests": """
      SELECT l.bid_id, event_id AS action_seq, CASE event_type WHEN 'error' THEN 'Rejected' WHEN 'view' THEN 'Needs Review' WHEN 'signup' THEN 'Approved' ELSE 'Verified' END AS new_status,
        repeat('note ', CAST(floor("value" * 2) AS INTEGER)) AS comment FROM events LEFT JOIN lowest l ON l.tender_id = 'T' || (user_id * 200)""",
    "asked": """
      SELECT c_custkey AS seq, CASE WHEN c_custkey % 3 = 0 THEN '  SUPPLIER#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') ELSE c_name END AS company_name, c_mktsegment AS category FROM customer""",
}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, with_tables(sql)
        return f

    return register


@query("""SELECT s.bid_id, s.bidder_id, s.tender_id, submission_date, coalesce(title, s.tender_id) AS tender_title, coalesce(status, 'Unknown') AS tender_status, deadline AS tender_deadline,
    CASE WHEN status = 'Awarded' THEN w.company_name END AS winner_name, row_number() OVER (PARTITION BY s.bidder_id ORDER BY submission_date DESC NULLS LAST, s.bid_id) AS place
  FROM submissions s LEFT JOIN tenders t ON s.tender_id = t.tender_id LEFT JOIN lowest l ON s.tender_id = l.tender_id LEFT JOIN bidders w ON l.bidder_id = w.bidder_id""")
def bid_history(spark, folder):
    return records.bid_history(market.submissions(spark, folder), market.tenders(spark, folder), market.bidders(spark, folder))


def requests(spark, folder):
    """Events as requests about the lowest bid of a tender; about half of them name none."""
    kind = F.col("event_type")
    status = F.when(kind == "error", "Rejected").when(kind == "view", "Needs Review").when(kind == "signup", "Approved").otherwise("Verified")
    events = table(spark, folder, "events").select(
        F.concat(F.lit("T"), (F.col("user_id") * 200).cast("string")).alias("tender_id"), F.col("event_id").alias("action_seq"), status.alias("new_status"),
        F.expr("repeat('note ', cast(floor(value * 2) AS int))").alias("comment"),
    )
    lowest = lowest_bids(market.submissions(spark, folder)).select("tender_id", "bid_id")
    return events.join(lowest, "tender_id", "left").drop("tender_id")


@query("""WITH checked AS (SELECT r.*, verification_status AS own, CASE WHEN new_status NOT IN ('Verified', 'Needs Review', 'Rejected') THEN 'invalid status' WHEN length(comment) > 1000 THEN 'comment too long'
      WHEN s.bid_id IS NULL THEN 'bid not found' END AS refusal FROM requests r LEFT JOIN submissions s ON r.bid_id = s.bid_id)
  SELECT bid_id, action_seq, new_status, length(comment) AS comment_chars, refusal, CASE WHEN refusal IS NULL THEN lag(new_status, 1, own) OVER (PARTITION BY bid_id, refusal IS NULL ORDER BY action_seq) END AS previous_status FROM checked""")
def verification_log(spark, folder):
    log = records.verification_log(requests(spark, folder), market.submissions(spark, folder))
    return log.select("bid_id", "action_seq", "new_status", F.length("comment").alias("comment_chars"), "refusal", "previous_status")


@query(r"""WITH known AS (SELECT lower(trim(company_name)) AS key, min(bidder_id) AS bidder_id FROM bidders GROUP BY 1), largest AS (SELECT max(CAST(regexp_extract(bidder_id, '(\d+)$', 1) AS BIGINT)) AS n FROM bidders),
    firsts AS (SELECT lower(trim(company_name)) AS key, min((seq % 2, seq)) AS f FROM asked GROUP BY 1), made AS (SELECT key, 'B-' || (n + row_number() OVER (ORDER BY f, key)) AS bidder_id FROM firsts, largest WHERE key NOT IN (SELECT key FROM known))
  SELECT bid_id, bidder_id, category FROM submissions UNION ALL
  SELECT printf('DEMO/BID/2026/%04d', row_number() OVER (ORDER BY seq % 2, seq)), bidder_id, category FROM asked JOIN (SELECT * FROM known UNION ALL SELECT * FROM made) ids ON lower(trim(company_name)) = key""")
def appended_bids(spark, folder):
    """Customers submit a bid each in two loads, those of even numbers first; the second goes on from what the first left."""
    c = table(spark, folder, "customer")
    named = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("  SUPPLIER#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))).otherwise(F.col("c_name"))
    new = c.select(named.alias("company_name"), F.col("c_custkey").alias("seq"), F.col("c_mktsegment").alias("category"))
    bidders = market.bidders(spark, folder).select("bidder_id", "company_name")
    bids = market.submissions(spark, folder).join(bidders, "bidder_id", "left").select("bid_id", "bidder_id", "company_name", "category")
    for load in (0, 1):
        bids, bidders = records.append_submissions(new.where(F.col("seq") % 2 == load), bids, bidders)
        bids, bidders = materialize(bids, "bids"), materialize(bidders, "bidders")
    return bids.select("bid_id", "bidder_id", "category")
