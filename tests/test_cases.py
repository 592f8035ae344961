"""Case views, ingestion and analysis: queries against their SQL, and parts against plain rewritings."""

import random
import re

import numpy as np
import pytest
from compare import assert_same
from pyspark.sql import functions as F

from bidgraph.functions import clean
from bidgraph.functions.ranks import numbered, running
from bidgraph.functions.settings import Settings
from bidgraph.operators import features, graph, model, networks, pairs, signals
from bidgraph.plans import registry, risk_queries, storage
from bidgraph.sources import files

QUICK = "decorated_bids review_alerts investigation_summary registry_checks merged_edges encoded_edges ingest_csv ingest_rejects ingest_report stream_rate_limit stream_ingest stream_upsert tender_lifecycle new_submissions tender_titles evidence_match score_threshold partition_signals tender_scores".split()


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, sf, name):
    assert_same(registry.QUERIES[name](spark, sf), registry.ORACLE_SQL[name], sf)


def test_tender_scores_equal_sql_where_halves_stand(spark):
    """Scores such as 13.725 stand among the rows of the larger table alone."""
    larger = "/root/testdata/sf0.01"
    assert_same(registry.QUERIES["tender_scores"](spark, larger), registry.ORACLE_SQL["tender_scores"], larger)


def test_pairs_take_one_join_of_bidders(spark, sf):
    rows, facts, dim = risk_queries.core(spark, sf)
    plan = pairs.pair_features(rows, facts, dim)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"company_a#\d+ < company_b#\d+", plan)) == 1


def test_pairs_equal_brute_force(spark):
    rng = random.Random(1)
    bids = {(f"T{t}", f"C{c}"): rng.choice([None, 100.0, 101.0, 150.0]) for t in range(30) for c in rng.sample(range(6), rng.randint(1, 5))}
    winner = {t: rng.choice([c for u, c in bids if u == t] + [None]) for t in {t for t, _ in bids}}
    order = {t: int(t[1:]) for t in winner}
    facts = spark.createDataFrame([(t, c, a) for (t, c), a in bids.items()], "tender string, company string, bid_amount double")
    dim = spark.createDataFrame([(t, w, order[t]) for t, w in winner.items()], "tender string, winner string, tender_seq int")
    met = {(r.company_a, r.company_b): (r.shared_tenders, r.mean_price_gap) for r in pairs.cobid_pairs(pairs.pair_rows(facts)).collect()}
    turns = {(r.company_a, r.company_b): r.alternating_wins for r in pairs.alternating_wins(facts, dim).collect()}
    for a in range(6):
        for b in range(a + 1, 6):
            x, y = f"C{a}", f"C{b}"
            both = sorted((t for t in winner if (t, x) in bids and (t, y) in bids), key=order.get)
            gaps = [abs(bids[t, x] - bids[t, y]) / max(bids[t, x], bids[t, y]) for t in both if bids[t, x] and bids[t, y]]
            wins = [winner[t] for t in both if winner[t] in (x, y)]
            if both:
                assert met[x, y] == (len(both), pytest.approx(np.mean(gaps)) if gaps else None)
            assert turns.get((x, y), 0) == sum(p != q for p, q in zip(wins, wins[1:]))


def test_ranks(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, kind string, n int")
    got = {r.id: r.place for r in numbered(df, [F.desc("n"), F.col("id")], "place").collect()}
    assert got == {r[0]: k for k, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])), 1)}
    sums = {r.id: r.s for r in running(df, [F.col("id")], {"s": F.col("n")}, within=("kind",)).collect()}
    for i, kind, _ in rows:
        assert sums[i] == sum(n for j, k, n in rows if k == kind and j <= i)
    ranked = {r.id: r.percentile for r in model.rank_percentiles(df, "id", ["n"]).collect()}
    assert all(ranked[i] == pytest.approx(sum(m < n for _, _, m in rows) / 499) for i, _, n in rows)


def test_centralities_equal_numpy(spark):
    rng = random.Random(3)
    edges = {(a, b): rng.randint(1, 4) for a in range(12) for b in range(a + 1, 12) if rng.random() < 0.45}
    df = spark.createDataFrame([(f"n{a:02}", f"n{b:02}", float(w)) for (a, b), w in edges.items()], "a string, b string, weight double")
    m = np.zeros((12, 12))
    for (a, b), w in edges.items():
        m[a, b] = m[b, a] = w
    names = [f"n{k:02}" for k in range(12) if m[k].any()]
    m = m[m.any(axis=1)][:, m.any(axis=1)]
    rank = np.full(len(m), 1 / len(m))
    for _ in range(500):
        rank = 0.15 / len(m) + 0.85 * (m / m.sum(axis=1, keepdims=True)).T @ rank
    vector = abs(np.linalg.eigh(m)[1][:, -1])
    near = m > 0
    closed = np.diag(near.astype(int) @ near.astype(int) @ near.astype(int))
    d = near.sum(axis=1)
    found = {r.id: r.pagerank for r in networks.pagerank(df).collect()}
    assert [found[n] for n in names] == pytest.approx(rank, abs=1e-5)
    found = {r.id: r.eigenvector_centrality for r in networks.eigenvector(df).collect()}
    assert [found[n] for n in names] == pytest.approx(vector, abs=1e-3)
    found = {r.id: r.clustering_coefficient for r in networks.clustering(df).collect()}
    assert [found[n] for n in names] == pytest.approx([c / (k * (k - 1)) if k > 1 else 0 for c, k in zip(closed, d)])


def test_rotation_counts_only_in_a_community(spark):
    row = {c: 0.0 for c in features.FEATURES} | {"n_tenders": 5.0, "shared_director_peers": 4.0, "min_pair_price_gap": 1.0, "solo_wins": 0.0, "document_peers": 0.0, "cluster_tenders": 0.0}
    names = ["company", *row]
    df = spark.createDataFrame([("alone", *row.values()), ("placed", *(row | {"community_size": 20.0}).values())], names)
    found = {r.company: r.rule_score for r in signals.company_signals(df, Settings(), clustered=True).collect()}
    assert found == {"alone": pytest.approx(1 / 8.15), "placed": pytest.approx(1 / 9.15)}


def test_shared_folder_is_needed_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        storage.shared_dir(Session)


def test_names_of_titles_and_inputs(spark, tmp_path):
    df = spark.createDataFrame([("Dr.",), ("Mr Dr",), ("Dr. B A",)], "n string")
    assert [r[0] for r in df.select(clean.person_key(clean.base_clean(F.col("n")))).collect()] == ["dr", "mr dr", "a b"]
    (tmp_path / "b.csv").write_text("company_id,tender_id\n,T1\n ,T2\n")
    with pytest.raises(ValueError, match="no valid bid"):
        files.load(spark, str(tmp_path / "b.csv"))
    assert files.one_source(path="x") == "path"
    for given in ({}, {"path": "x", "rows": df}):
        with pytest.raises(ValueError):
            files.one_source(**given)


def test_exports_with_a_cap(spark):
    nodes = spark.createDataFrame([("a", "Company", "A"), ("b", "Company", "B"), ("c", "Company", "C")], "id string, node_type string, display string")
    edges = spark.createDataFrame([("a", "b", "CO_BID", 2.0), ("b", "c", "CO_BID", 1.0)], "src string, dst string, edge_type string, weight double")
    assert [r.id for r in graph.node_export(nodes, edges, 1).collect()] == ["b"] and [r.dst for r in graph.edge_export(edges, 1).collect()] == ["b"]


def test_communities_are_joined_after_local_moves(spark):
    rows = [(f"n{i:02}", f"n{i + 1:02}", 1.0) for i in range(31)]
    df = spark.createDataFrame(rows, "a string, b string, weight double")
    moved, joined = networks.local_moves(df), networks.communities(df)
    value = lambda m: networks.modularity(m, df).first().modularity
    assert value(joined) > value(moved) + 0.1 and value(joined) > 0.6
    place = {r.id: r.community for r in joined.collect()}
    assert len(place) == 32 and sum(place[a] != place[b] for a, b, _ in rows) == len(set(place.values())) - 1
