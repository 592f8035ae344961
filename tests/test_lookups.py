"""Lookups and figures against their SQL and plain rewritings."""

import json
import random
import re

import pytest
from compare import assert_same
from pyspark.sql import functions as F

from bidgraph.functions.settings import PROHIBITED_TERMS
from bidgraph.operators import features, model, pairs, portfolio
from bidgraph.operators.neighbourhood import neighbours_within
from bidgraph.plans import analysis_queries, registry

NAMES = "neighbours_within_1 neighbours_within_2 neighbours_within_3 pair_tenders degree_centrality_cutoff exact_split award_lifecycle signal_trend company_details tender_profiles resolve_tender_lookup document_signatures pagerank_rounds eigenvector_rounds node_aliases encoded_directions encoded_blocks".split()


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, name):
    assert_same(registry.QUERIES[name](spark, sf), registry.ORACLE_SQL[name], sf)


def test_the_report_has_all_sections_of_one_analysis(spark, sf):
    rows = registry.QUERIES["analysis_report"](spark, sf).collect()
    sections = {r.section for r in rows}
    assert sections == {"headline", "company", "tender", "relationship", "community", "rollup", "alert"} or sections == {"headline", "company", "tender", "relationship", "community", "rollup"}
    head = json.loads(next(r.body for r in rows if r.section == "headline"))
    assert head["risk_score"] == max(r.score for r in rows if r.section == "company") and head["mode"] in ("model", "anomaly") and head["text"].startswith("Looked at 10 companies")
    assert not re.search(r"\b(" + "|".join(PROHIBITED_TERMS) + r")\b", head["text"].lower())


def test_signals_of_a_market_with_rings_fire_on_some(spark):
    """Over the larger table, where all rings are there."""
    larger = "/root/testdata/sf0.01"
    found = registry.QUERIES["ringed_signals"](spark, larger)
    assert_same(found, registry.ORACLE_SQL["ringed_signals"], larger)
    fired = {}
    for r in found.collect():
        fired.setdefault(r.code, set()).add(r.company)
    for code in ("REPEATED_CO_BIDDING", "WINNER_ROTATION", "MARKET_CONCENTRATION", "DENSE_SUBGROUP"):
        assert 0 < len(fired[code]) < 100, code


@pytest.mark.parametrize("limit", [3, 7, 500])
def test_neighbours_are_the_nearest_then_the_smallest(spark, limit):
    rng = random.Random(limit)
    edges = {(f"n{rng.randrange(40):02}", f"n{rng.randrange(40):02}") for _ in range(60)} | {("n00", f"n{i:02}") for i in range(1, 30)}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    df, seeds = spark.createDataFrame(list(edges), "src string, dst string"), ["n00", "n31", "n35", "alone"]
    for depth in (1, 4):
        want = set()
        for s in seeds:
            hops, front = {s: 0}, {s}
            for hop in range(1, depth + 1):
                front = {v for u in front for v in near.get(u, ())} - set(hops)
                hops |= dict.fromkeys(front, hop)
            want |= {(s, v, h) for h, v in sorted((h, v) for v, h in hops.items() if v != s)[:limit]}
        got = neighbours_within(df, spark.createDataFrame([(s,) for s in seeds], "id string"), depth, limit)
        assert {tuple(r) for r in got.collect()} == want


def test_a_pair_with_very_many_tenders_is_listed_in_parts(spark):
    n = 100_000
    tenders = spark.range(n).select(F.concat(F.lit("T"), "id").alias("tender"), (n - F.col("id")).alias("tender_seq"))
    facts = tenders.select("tender", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("company"))
    rows = pairs.tender_lists(facts, tenders, length=5000).orderBy("part").collect()
    assert [len(r.tenders) for r in rows] == [5000] * 20 and rows[0].tenders[0] == f"T{n - 1}" and rows[-1].tenders[-1] == "T0"


def test_quantiles_without_a_task_that_sees_all_values(spark):
    rng = random.Random(2)
    values = [rng.choice([1.0, 2.0, 2.5, rng.random()]) for _ in range(301)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    for p in (0.0, 0.3, 0.5, 0.95, 1.0):
        at = p * (len(values) - 1)
        low, ordered = int(at), sorted(values)
        want = ordered[low] + (ordered[min(low + 1, len(values) - 1)] - ordered[low]) * (at - low)
        assert abs(features.percentile_threshold(df, "v", p).first().cutoff - want) < 1e-12
    assert features.percentile_threshold(df.limit(0), "v", 0.5).first().cutoff == 0.0
    plan = features.percentile_threshold(df, "v", 0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan


def test_a_split_that_shares_keys_fails(spark):
    rows = [(k, k % 2) for k in range(40)]
    df = spark.createDataFrame(rows, "company long, label int")
    sizes = {(r.label, r.part): r["count"] for r in model.exact_split(df).groupBy("label", "part").count().collect()}
    assert sizes == {(label, part): n for label in (0, 1) for part, n in (("test", 5), ("validation", 3), ("train", 12))}
    both = spark.createDataFrame([(k, label) for k in range(40) for label in (0, 1)], "company long, label int")
    skewed = both.where("label = 0 OR company < 10")
    with pytest.raises(ValueError, match="share keys"):
        model.exact_split(skewed)


def test_lifecycle_in_chunks_equals_a_plain_replay(spark):
    rng = random.Random(8)
    bids = [(f"T{t}", f"B{t}-{i}") for t in range(12) for i in range(3)]
    actions = [(f"T{rng.randrange(12)}", seq, rng.choice(["publish", "publish", "award", "award", "close", "withdraw", "remove", "other"]), rng.choice([f"B{rng.randrange(12)}-1", None, "own"])) for seq in range(200)]
    actions = [(t, seq, a, f"B{t[1:]}-2" if b == "own" else b) for t, seq, a, b in actions]
    want = {}
    for tender, _, action, bid in actions:
        status, awarded, refused, n = want.get(tender, ("Draft", None, 0, 0))
        if action == "award" and (tender, bid) not in bids:
            refused += 1
        else:
            new = portfolio.LIFECYCLE[status].get(action, status)
            awarded, status = (bid if new == "Awarded" != status else awarded), new
        want[tender] = (status, awarded, refused, n + 1)
    frame = spark.createDataFrame(actions, "tender_id string, seq long, action string, bid_id string")
    for chunk in (1, 7, 4096):
        got = portfolio.award_lifecycle(frame, spark.createDataFrame(bids, "tender_id string, bid_id string"), chunk)
        assert {r.tender_id: tuple(r)[1:] for r in got.collect()} == want
    assert any(v[1] for v in want.values()) and any(v[2] for v in want.values())


def test_the_analysis_joins_bidders_once(spark, sf, monkeypatch):
    calls = []
    rows = pairs.pair_rows
    monkeypatch.setattr(pairs, "pair_rows", lambda facts: calls.append(1) or rows(facts))
    analysis_queries.of_partition(spark, sf)
    assert len(calls) == 1
