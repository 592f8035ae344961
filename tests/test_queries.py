import pytest
from compare import assert_same

from bidgraph.plans import registry

QUICK = (
    "typed_bids name_keys bidder_formats identity_index dataset_summary bid_facts tender_dimension graph_edges pair_features relationship_risk tender_features company_scores tender_signals "
    "lowest_bids analysis_records registry_edges tender_list dashboard document_checks bid_ranking compliance_checklist audit_rows requirements required_documents document_validation score_metrics rank_percentile "
    "degree_centrality cluster_behaviour registry_components company_profiles stream_running_best"
).split()


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, sf, name):
    assert_same(registry.QUERIES[name](spark, sf), registry.ORACLE_SQL[name], sf)


def test_names():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES) and len(registry.QUERIES) > 90


def test_order_of_the_feed_files_does_not_matter(spark, sf):
    from bidgraph.operators import graph, identity
    from bidgraph.sources import market

    feed = market.bid_feed(spark, sf)
    rows = lambda df: sorted(map(str, graph.bid_facts(identity.resolve(df)).collect()))
    assert rows(feed) == rows(feed.orderBy("bid_amount").repartition(7))
