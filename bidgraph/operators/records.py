"""Rows that the case workflow leaves: a bidder's bids with their tenders, verification requests, bids that are appended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidgraph.functions.ranks import numbered, running
from bidgraph.operators.portfolio import lowest_bids, number_submissions
from bidgraph.plans.storage import materialize

# Fixed values.
REQUESTED_STATUSES = ("Verified", "Needs Review", "Rejected")
MAX_COMMENT = 1000
BID_PREFIX, YEAR = "DEMO/BID/", "2026"


def bid_history(bids: DataFrame, tenders: DataFrame, bidders: DataFrame) -> DataFrame:
    """A row per bid with its tender's title, status and deadline, the winner of an awarded tender, and its place among the bidder's bids.

    The newest bid of a bidder has place 1, equal dates go by bid id.  A bid of an unknown tender
    has the tender's id for a title and the status Unknown.  A bidder with very many bids is spread
    over ranges.
    """
    winner = lowest_bids(bids).select("tender_id", F.col("bidder_id").alias("winner_id"))
    names = bidders.select(F.col("bidder_id").alias("winner_id"), F.col("company_name").alias("winner"))
    known = tenders.select("tender_id", "title", "status", "deadline").join(winner, "tender_id", "left").join(names, "winner_id", "left")
    rows = bids.select("bid_id", "bidder_id", "tender_id", "submission_date").join(known, "tender_id", "left")
    rows = rows.select(
        "bid_id", "bidder_id", "tender_id", "submission_date", F.coalesce("title", "tender_id").alias("tender_title"), F.coalesce("status", F.lit("Unknown")).alias("tender_status"),
        F.col("deadline").alias("tender_deadline"), F.when(F.col("status") == "Awarded", F.col("winner")).alias("winner_name"),
    )
    return running(rows, [F.desc_nulls_last("submission_date"), F.col("bid_id")], {"place": F.lit(1).cast("long")}, within=("bidder_id",))


def refusal(status: Column, comment: Column, known: Column) -> Column:
    """Why a request is refused, checked in this order; null for one that takes effect."""
    return (
        F.when(~F.coalesce(status.isin(*REQUESTED_STATUSES), F.lit(False)), "invalid status")
        .when(F.length(comment) > MAX_COMMENT, "comment too long")
        .when(~F.coalesce(known, F.lit(False)), "bid not found")
    )


def verification_log(requests: DataFrame, bids: DataFrame) -> DataFrame:
    """Requests (bid_id, action_seq, new_status, comment) with ``refusal`` and the status before each that takes effect.

    Before a bid's first request it has the status of its row; refused requests change nothing and
    have no previous status.  ``action_seq`` tells requests apart.  The turn of a request among its
    bid's is counted over ranges and looked up by number, so a bid with very many requests is many
    tasks.  A null comment counts as empty, a null bid id as unknown.
    """
    own = bids.groupBy("bid_id").agg(F.max("verification_status").alias("own"), F.lit(True).alias("known"))
    rows = requests.select("bid_id", "action_seq", "new_status", F.coalesce("comment", F.lit("")).alias("comment")).join(own, "bid_id", "left")
    checked = materialize(rows.withColumn("refusal", refusal(F.col("new_status"), F.col("comment"), F.col("known"))), "requests")
    done = materialize(running(checked.where("refusal IS NULL").select("bid_id", "action_seq", "new_status", "own"), [F.col("action_seq")], {"turn": F.lit(1).cast("long")}, within=("bid_id",)), "turns")
    earlier = done.select("bid_id", (F.col("turn") + 1).alias("turn"), F.col("new_status").alias("before"))
    before = done.join(earlier, ["bid_id", "turn"], "left").select("action_seq", F.coalesce("before", "own").alias("previous_status"))
    return checked.join(before, "action_seq", "left").select("bid_id", "action_seq", "new_status", "comment", "refusal", "previous_status")


def append_submissions(new: DataFrame, bids: DataFrame, bidders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bids, bidders) with the submissions (company_name, seq, category) appended.

    ``bids``: (bid_id, bidder_id, company_name, category), ``bidders``: (bidder_id, company_name).
    Bid numbers go on from the largest that stands behind the prefix, in the order of ``seq``, which
    tells submissions apart; numbers below 10,000 have four digits.  Known companies keep their id.
    """
    placed = materialize(number_submissions(new, bidders), "submissions")
    number = F.regexp_extract("bid_id", r"/([0-9]+)$", 1)
    top = bids.where(F.col("bid_id").startswith(BID_PREFIX) & (number != "")).agg(F.coalesce(F.max(number.cast("long")), F.lit(0)).alias("top")).first()["top"]
    made = numbered(placed, [F.col("seq")], "place")
    made = made.select(F.format_string(f"{BID_PREFIX}{YEAR}/%04d", F.col("place") + F.lit(top)).alias("bid_id"), "bidder_id", "company_name", "category")
    names = placed.join(bidders.select("bidder_id"), "bidder_id", "left_anti").groupBy("bidder_id").agg(F.min_by(F.trim("company_name"), "seq").alias("company_name"))
    return bids.unionByName(made), bidders.unionByName(names)
