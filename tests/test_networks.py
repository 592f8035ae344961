"""Networks on literal rows: whole results against small graphs worked out by hand or brute force."""

import itertools

from test_bids import S, bids

from bidgraph.operators import features, graph, identity, networks, pairs, signals
from bidgraph.plans.storage import materialize


def linked(spark, edges):
    return materialize(spark.createDataFrame([(*sorted(e), w) for e, w in edges.items()], "a string, b string, weight double"))


def test_dense_groups_equal_brute_force(spark):
    names = [f"c{i}" for i in range(9)]
    edges = {(a, b): 1.0 + (i * 7 + i // 3) % 5 for i, (a, b) in enumerate(itertools.combinations(names, 2)) if i % 9 != 4}
    strong = {frozenset(e) for e, w in edges.items() if w >= 3}
    whole = [set(c) for n in range(1, 10) for c in itertools.combinations(names, n) if all(frozenset(e) in strong for e in itertools.combinations(c, 2))]
    want = sorted(sorted(c) for c in whole if len(c) >= 3 and not any(c < d for d in whole))
    got = networks.dense_groups(linked(spark, edges)).collect()
    assert sorted(r.members for r in got) == want and len(want) > 3
    for r in got:
        inside = [edges[e] for e in itertools.combinations(r.members, 2)]
        assert abs(r.mean_weight - sum(inside) / len(inside)) < 1e-9


def test_communities_and_groups_use_every_bid(spark, sf):
    """Each company of the feed is placed, and each pair that is linked in the full projection can be in a group."""
    from bidgraph.plans import network_queries as N

    parts = N.core(spark, sf)
    want = {r.id for r in N.companies(parts[1]).collect()}
    assert {r.id for r in N.QUERIES["communities"](spark, sf).collect()} == want
    strong = {frozenset((r.a, r.b)) for r in N.projection(spark, sf, parts).where("weight >= 3").collect()}
    groups = [r.members for r in N.QUERIES["dense_groups"](spark, sf).collect()]
    assert {frozenset(e) for g in groups for e in itertools.combinations(g, 2)} <= strong and sum(len(g) for g in groups) > 0
    three = {frozenset(t) for t in itertools.combinations(sorted(want), 3) if all(frozenset(e) in strong for e in itertools.combinations(t, 2))}
    assert three == {frozenset(t) for g in groups for t in itertools.combinations(g, 3)}


def ring(spark):
    """Three companies in turn win the tenders that they alone enter; two others bid once together."""
    rows = [(f"C{i}", f"T{t}", 100.0 + (i + t) % 3, "won" if i == t % 3 else "lost", None) for t in range(6) for i in range(3)]
    rows += [("C8", "T9", 7.0, "won", None), ("C9", "T9", 9.0, "lost", None), ("C7", "T8", 9.0, "won", None)]
    found = identity.resolve(bids(spark, rows))
    return tuple(materialize(df) for df in (found, graph.bid_facts(found), graph.tender_dim(found)))


def test_network_features_fire_their_signals(spark):
    rows, facts, dim = ring(spark)
    met = pairs.cobid_pairs(pairs.pair_rows(facts))
    people, places = (pairs.attribute_pairs(graph.memberships(rows, k)) for k in ("person", "address"))
    edges, everyone = materialize(graph.company_projection(met, people, places)), facts.selectExpr("company AS id").distinct()
    member = networks.memberships(everyone, edges)
    central = networks.company_centrality(materialize(graph.undirected(graph.edges(rows, met))), everyone)
    matrix = features.company_features(rows, facts, dim, pairs.pair_features(rows, facts, dim), S, central, networks.company_communities(member, edges, facts, dim))
    got = {r.company: r for r in matrix.collect()}
    assert len(got) == 6 and got["C_C7"].community_size == 1
    one = got["C_C0"]
    assert (one.community_size, one.community_density, one.cluster_tenders, one.cluster_capture_rate) == (3, 1.0, 6, 1.0)
    assert abs(one.cluster_rotation_entropy - 1) < 1e-9 and abs(one.cluster_win_concentration - 1 / 3) < 1e-9
    assert min(one.degree_centrality, one.weighted_degree, one.pagerank, one.eigenvector_centrality, one.betweenness, one.clustering_coefficient) > 0
    cutoff = features.percentile_threshold(matrix, "degree_centrality", S.high_degree_percentile).first()["cutoff"]
    fired = {r.company: {s["code"] for s in r.signals} for r in signals.company_signals(matrix, S, degree_cutoff=cutoff).collect()}
    assert {"WINNER_ROTATION", "HIGH_CENTRALITY", "DENSE_SUBGROUP"} <= fired["C_C0"] and "DENSE_SUBGROUP" not in fired["C_C8"]


def test_centrality_covers_all_nodes(spark, sf, monkeypatch):
    from bidgraph.plans import network_queries as N

    small = linked(spark, {("C_1", "T_1"): 1.0, ("C_2", "T_1"): 2.0, ("C_1", "C_2"): 1.0, ("P_1", "C_1"): 2.0, ("D_1", "T_1"): 1.0, ("A_1", "C_2"): 1.0})
    monkeypatch.setattr(N, "undirected", lambda *_: small)
    for name in ("eigenvector_centrality", "betweenness", "network_clustering"):
        got = {r[0]: r[1] for r in N.QUERIES[name](spark, sf).collect()}
        assert set(got) == {"C_1", "C_2", "T_1", "P_1", "D_1", "A_1"}
        if name == "network_clustering":
            assert abs(got["T_1"] - 1 / 3) < 1e-9 and got["P_1"] == 0


def test_networks_of_the_feed(spark, sf, monkeypatch):
    """Detected communities join pairs and behaviour; clusters hold every linkable pair; egos have all types and their edges."""
    from bidgraph.plans import network_queries as N
    from bidgraph.plans import view_queries as V

    parts = tuple(materialize(df) for df in N.core(spark, sf))
    member = N.detected(spark, sf, parts)
    at = {r.id: r.community for r in member[0].collect()}
    for module in (N, V):
        monkeypatch.setattr(module, "core", lambda *_: parts)
    monkeypatch.setattr(N, "detected", lambda *_: member)
    for r in N.QUERIES["network_pair_features"](spark, sf).collect():
        assert r.same_community == (at[r.company_a] == at[r.company_b])
    tenders = {}
    for r in parts[1].where("company IS NOT NULL").collect():
        tenders.setdefault((at[r.company], r.tender), []).append(r.company)
    want = {}
    for (community, _), found in tenders.items():
        want[community] = want.get(community, 0) + (len(found) > 1)
    assert {r.community: r.cluster_tenders for r in N.QUERIES["network_cluster_behaviour"](spark, sf).collect()} == {c: n for c, n in want.items() if n}
    sizes = {r.community: r["size"] for r in N.QUERIES["network_community_density"](spark, sf).collect()}
    assert sizes == {c: list(at.values()).count(c) for c in at.values()}
    m2, inside, total = 0.0, 0.0, {}
    for r in member[1].collect():
        m2 += 2 * r.weight
        inside += 2 * r.weight * (at[r.a] == at[r.b])
        for end in (r.a, r.b):
            total[at[end]] = total.get(at[end], 0.0) + r.weight
    assert abs(N.QUERIES["network_modularity"](spark, sf).first().modularity - (inside / m2 - sum(t * t for t in total.values()) / m2**2)) < 1e-9

    hops, edges = N.egos(spark, sf)
    hops = hops.collect()
    assert {r.seed[0] for r in hops} == set("CPTAD") and {r.id[0] for r in hops} == set("CPTAD")
    near = {(r.seed, r.id) for r in hops}
    assert all((r.seed, r.src) in near and (r.seed, r.dst) in near for r in edges.limit(500).collect())
    assert edges.where("edge_type = 'ISSUED_BY'").count() > 0


def test_clusters_by_any_evidence(spark, sf, monkeypatch):
    """One kind of link is enough, and registry edges count between companies."""
    from bidgraph.plans import view_queries as V

    columns = "a string, b string, evidence array<string>, score int, linkable boolean"
    some = [("C_1", "C_2", ["sharedDirector"], 35, True), ("C_2", "C_3", ["duplicateBidDocuments"], 45, True), ("C_4", "C_5", ["repeatedCoBidding"], 20, False)]
    monkeypatch.setattr(V, "relations_of", lambda *_: spark.createDataFrame(some, columns))
    monkeypatch.setattr(V, "core", lambda *_: (spark.createDataFrame([(f"C_{i}", i) for i in range(1, 7)], "company string, supplier long"), None, None))
    monkeypatch.setattr(V.P, "registry_edges", lambda *_: spark.createDataFrame([("B-3", "B-4", ["sharedPhone"])], "a string, b string, evidence array<string>"))
    monkeypatch.setattr(V, "whole_scores", lambda *_: spark.createDataFrame([(f"C_{i}", [("SHARED_DIRECTORS", 0.1 * i, 1.0)]) for i in range(1, 7)], "company string, signals array<struct<code string, severity double, weight double>>"))
    found = V.QUERIES["clusters"](spark, sf).collect()
    assert [(r.members, r.evidence) for r in found] == [(4, ["duplicateBidDocuments", "sharedDirector", "sharedPhone"])]
    assert [(r.root, r.company) for r in V.QUERIES["cluster_signals"](spark, sf).collect()] == [("C_1", "C_4")]
