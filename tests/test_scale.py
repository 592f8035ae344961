"""Jobs that hold no more disk than they need: what is written, shuffled and paired, on small tables."""

import glob
import random
import re

from pyspark.sql import functions as F

from bidgraph.operators import features, graph, identity, networks, pairs
from bidgraph.plans import risk_queries
from bidgraph.plans.storage import materialize
from bidgraph.sources import market


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_written_table_leaves_no_shuffle_files(spark):
    files = lambda: set(glob.glob(f"{spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath()}/**/shuffle_*", recursive=True))
    before = files()
    materialize(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count())
    for _ in range(50):
        if not files() - before:
            break
        spark.range(1).count()
    assert not files() - before


def test_keys_are_computed_on_spellings_alone(spark, sf):
    """No regular expression of a key stands below the grouping of the bids."""
    feed = materialize(market.bid_feed(spark, sf))
    assert "Aggregate" in plan(identity.raw_to_canonical(feed, "company")) and "row_seq" not in plan(identity.raw_to_canonical(feed, "company"))


def test_orders_are_dealt_out_once_for_join_and_places(spark, sf):
    assert set(risk_queries.RESOLVED) <= set(risk_queries.core(spark, sf)[0].columns)
    windows = [line for line in plan(market.bid_feed(spark, sf)).splitlines() if "Window [row_number" in line]
    assert len(windows) == 2 and all("[l_orderkey#" in line for line in windows)


def market_of(spark, seed=5, companies=14):
    """(members of persons, members of addresses, facts, dim, rows) of companies that share both in several ways."""
    rng = random.Random(seed)
    rows = [(f"C_{c:02}", f"P_{p}", f"A_{a}", f"D_{c % 2}", f"T_{t}", "won" if rng.random() < 0.3 else "lost", float(rng.randint(1, 9)), k) for k, (c, p, a, t) in enumerate((rng.randrange(companies), rng.randrange(5), rng.randrange(6), rng.randrange(9)) for _ in range(60))]
    rows = spark.createDataFrame(rows, "company string, person string, address string, department string, tender string, result string, bid_amount double, row_seq long").withColumns({"bid_date": F.lit(None).cast("date"), "tender_value": F.lit(9.0)})
    return materialize(rows)


def test_peers_equal_pairs_of_companies(spark):
    rows = market_of(spark).where("row_seq < 25")
    for kind in ("person", "address"):
        want = {}
        for r in pairs.attribute_pairs(graph.memberships(rows, kind)).collect():
            for x in (r.a, r.b):
                n, most = want.get(x, (0, 0))
                want[x] = n + 1, max(most, r.shared)
        found = features.peers(rows, kind)
        assert {r.company: (r.peers, r.max_shared) for r in found.collect()} == want and want
    alike = spark.createDataFrame([(f"C_{i}", ["P_1"]) for i in range(300)], "company string, attrs array<string>")
    assert {(r.peers, r.max_shared) for r in pairs.attribute_peers(alike).collect()} == {(299, 1)}


def test_pair_features_pair_no_companies_for_an_attribute(spark):
    rows = market_of(spark)
    facts, dim = materialize(graph.bid_facts(rows)), materialize(graph.tender_dim(rows))
    found = pairs.pair_features(rows, facts, dim)
    assert not re.findall(r"\(attr#\d+ = attr_b#\d+\)", plan(found))
    shared = {k: {(r.a, r.b): r.shared for r in pairs.attribute_pairs(graph.memberships(rows, k)).collect()} for k in ("person", "address")}
    got = found.collect()
    assert all((r.shared_directors, r.shared_addresses) == tuple(shared[k].get((r.company_a, r.company_b), 0) for k in ("person", "address")) for r in got) and len(got) > 20


def test_projection_is_measured_without_its_pairs(spark):
    rows = market_of(spark)
    facts, dim = materialize(graph.bid_facts(rows)), materialize(graph.tender_dim(rows))
    few = facts.where("tender IN ('T_1', 'T_2')")
    met = pairs.cobid_pairs(pairs.pair_rows(few))
    people, places = (graph.memberships(rows.where("row_seq < 30"), k) for k in ("person", "address"))
    edges = materialize(graph.company_projection(met, pairs.attribute_pairs(people), pairs.attribute_pairs(places)))
    member = rows.select(F.col("company").alias("id"), (F.substring("company", 3, 2).cast("int") % 3).alias("community")).distinct()
    want = networks.modularity(member, edges).first().modularity
    assert abs(networks.projection_modularity(member, met, people, places).first().modularity - want) < 1e-12
    ends = pairs.about(rows.where("row_seq < 30"), facts, member.withColumnRenamed("id", "company"))
    pair = pairs.pair_features(rows, few, dim, ends=ends)
    plain = {tuple(r) for r in networks.community_stats(member, edges).collect()}
    assert {tuple(r) for r in networks.densities(member, networks.linked_inside(ends, pair)).collect()} == plain and len(plain) == 3
    stars = [networks.attribute_stars(x) for x in (few.select(F.col("tender").alias("attr"), "company"), people, places)]
    roots = lambda links: {tuple(r) for r in networks.components(links).collect()}
    assert roots(stars[0].unionByName(stars[1]).unionByName(stars[2])) == roots(edges)


def test_undirected_edges_of_the_tables_are_those_of_the_edges(spark):
    rows = market_of(spark)
    facts = materialize(graph.bid_facts(rows))
    met = pairs.cobid_pairs(pairs.pair_rows(facts))
    got = [sorted(tuple(r) for r in df.collect()) for df in (graph.undirected_of(rows, facts, met), graph.undirected(graph.edges(rows, met)), graph.undirected(graph.edges(rows, met, facts)))]
    assert got[0] == got[1] == got[2] and len(got[0]) > 60


def test_documents_are_paired_where_two_filed_them(spark):
    filed = spark.createDataFrame([("T1", "C1", "x"), ("T1", "C2", "x"), ("T1", "C2", "x"), ("T1", "C3", "y"), ("T2", "C1", "x"), ("T2", "C2", "x"), ("T2", "C1", "z"), ("T2", "C2", "z"), ("T3", "C1", "y"), ("T3", None, "y")], "tender string, company string, hash string")
    assert [tuple(r) for r in pairs.document_pairs(filed).collect()] == [("C1", "C2", 2)]


def test_pairs_are_counted_by_numbers(spark, monkeypatch):
    rows = market_of(spark)
    facts = materialize(graph.bid_facts(rows).unionByName(graph.bid_facts(rows.where("company = 'C_01'")).withColumn("company", F.lit(None).cast("string"))))
    kinds, made = [], pairs.pair_rows
    want = sorted(map(tuple, pairs.cobid_pairs(made(facts)).collect()))
    monkeypatch.setattr(pairs, "pair_rows", lambda f: kinds.append(dict(f.dtypes)["company"]) or made(f))
    got = sorted(map(tuple, risk_queries.counted(facts).collect()))
    assert [r[:3] for r in got] == [r[:3] for r in want] and all(abs(a[3] - b[3]) < 1e-12 for a, b in zip(got, want)) and kinds == ["bigint"]
