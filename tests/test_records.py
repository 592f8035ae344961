"""Bid history, verification requests and appended bids: against SQL, and against plain rewritings on odd rows."""

import random

import pytest
from compare import assert_same

from bidgraph.operators import records
from bidgraph.plans import registry


@pytest.mark.parametrize("name", ["bid_history", "verification_log", "appended_bids"])
def test_query_equals_sql(spark, sf, name):
    assert_same(registry.QUERIES[name](spark, sf), registry.ORACLE_SQL[name], sf)


def test_every_refusal_occurs(spark, sf):
    log = registry.QUERIES["verification_log"](spark, sf).groupBy("refusal").count().collect()
    assert {r.refusal for r in log} == {None, "invalid status", "comment too long", "bid not found"}


def test_log_equals_replay(spark):
    """One bid has a third of the requests; nulls, a limit that is just met and one that is just passed."""
    rng = random.Random(4)
    status = {f"B{k}": rng.choice(["Verified", "Flagged"]) for k in range(9)}
    rows = []
    for seq in range(600):
        bid = "B0" if seq % 3 == 0 else rng.choice([*status, "B99", None])
        rows.append((bid, seq, rng.choice(["Verified", "Needs Review", "Rejected", "Flagged", None]), rng.choice([None, "", "x" * 1000, "x" * 1001])))
    asked = spark.createDataFrame(rows, "bid_id string, action_seq long, new_status string, comment string")
    got = {r.action_seq: (r.refusal, r.previous_status) for r in records.verification_log(asked, spark.createDataFrame(list(status.items()), "bid_id string, verification_status string")).collect()}
    now, want = dict(status), {}
    for bid, seq, new, comment in rows:
        why = "invalid status" if new not in records.REQUESTED_STATUSES else "comment too long" if len(comment or "") > 1000 else "bid not found" if bid not in status else None
        want[seq] = (why, None if why else now[bid])
        if not why:
            now[bid] = new
    assert got == want


def test_numbers_go_on(spark):
    bids = spark.createDataFrame([("DEMO/BID/2025/9998", "B-1", "A", "x"), ("BID-77777", "B-1", "A", "x"), ("DEMO/BID/odd", "B-1", "A", "x")], "bid_id string, bidder_id string, company_name string, category string")
    bidders = spark.createDataFrame([("B-1", "A")], "bidder_id string, company_name string")
    new = spark.createDataFrame([(" a ", 1, "y"), ("New", 2, "y"), ("new", 3, "z")], "company_name string, seq long, category string")
    more, names = records.append_submissions(new, bids, bidders)
    assert sorted((r.bid_id, r.bidder_id) for r in more.subtract(bids).collect()) == [("DEMO/BID/2026/10000", "B-2"), ("DEMO/BID/2026/10001", "B-2"), ("DEMO/BID/2026/9999", "B-1")]
    assert sorted(map(tuple, names.collect())) == [("B-1", "A"), ("B-2", "New")]
    same, none = records.append_submissions(new.limit(0), bids, bidders)
    assert same.count() == 3 and none.count() == 1
