"""Queries of rankings, alerts, profiles, clusters and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidgraph.operators import documents, features, networks, pairs, portfolio, signals, views
from bidgraph.plans import document_queries as D
from bidgraph.plans import portfolio_queries as P
from bidgraph.plans.document_queries import filed
from bidgraph.plans.network_queries import whole_scores
from bidgraph.plans.risk_queries import SETTINGS, all_pairs, core, r4, scored
from bidgraph.plans.sql import CTE, with_tables
from bidgraph.plans.storage import materialize
from bidgraph.sources import market

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
CTE |= {
    "relation_edges": """SELECT company_a AS a, company_b AS b, CAST(floor(round(risk::DOUBLE, 3) * 100 + 0.5) AS INTEGER) AS score, shared_directors > 0 OR shared_addresses > 0 OR shared_document_hashes > 0 AS linkable,
      list_filter([CASE WHEN shared_directors > 0 THEN 'sharedDirector' END, CASE WHEN shared_addresses > 0 THEN 'sharedAddress' END, CASE WHEN shared_tenders >= 3 THEN 'repeatedCoBidding' END,
        CASE WHEN alternating_wins >= 3 THEN 'winnerRotation' END, CASE WHEN shared_document_hashes > 0 THEN 'duplicateBidDocuments' END], lambda x: x IS NOT NULL) AS evidence FROM relations WHERE reasoned""",
    "registry_around": "SELECT a AS x, b AS y FROM registry_edges UNION ALL SELECT b, a FROM registry_edges",
}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_tables(sql)
        return f

    return register


@query("SELECT company, risk_score::DOUBLE AS risk_score, risk_score >= 50 AS suspicious FROM scores ORDER BY risk_score DESC, company LIMIT 50")
def entity_ranking(spark, folder):
    return views.ranking(scored(spark, folder), SETTINGS).select("company", "risk_score", "suspicious")


@query("SELECT max(risk_score)::DOUBLE AS risk_score, CAST(NULL AS DOUBLE) AS model_probability FROM scores")
def headline(spark, folder):
    return views.headline(scored(spark, folder))


@query()
def alerts(spark, folder):
    parts = core(spark, folder)
    companies = materialize(whole_scores(spark, folder, parts), "scores")
    tenders = signals.score_tenders(signals.tender_signals(features.tender_features(parts[1], parts[2]), SETTINGS), parts[1], companies)
    return views.alerts(companies, tenders, min_score=SETTINGS.alert_threshold)


@query("""SELECT s.company, risk_score::DOUBLE AS risk_score, CASE WHEN risk_score < 25 THEN 'LOW' WHEN risk_score < 50 THEN 'MEDIUM' WHEN risk_score < 75 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level, entered, won, tenders, round(won / entered, 3) AS win_rate
  FROM scores s JOIN (SELECT company, count(*) AS entered, count(*) FILTER (WHERE winner = company) AS won, list_slice(list(tender ORDER BY tender), 1, 50) AS tenders FROM facts JOIN dim USING (tender) GROUP BY company) f ON s.company = f.company""")
def company_profiles(spark, folder):
    parts = core(spark, folder)
    return views.company_profiles(parts[1], parts[2], scored(spark, folder, parts))


@query("SELECT tender, company, round(bid_amount, 4) AS bid_amount, coalesce(winner = company, false) AS winner, risk_score::DOUBLE AS risk_score FROM facts JOIN dim USING (tender) LEFT JOIN scores USING (company)")
def tender_bidders(spark, folder):
    parts = core(spark, folder)
    return views.tender_bidders(parts[1], parts[2], scored(spark, folder, parts)).withColumn("bid_amount", F.round("bid_amount", 4))


@query("SELECT a, b, list_sort(evidence) AS evidence, score, linkable FROM relation_edges")
def relationship_edges(spark, folder):
    edges = portfolio.relationship_edges(pairs.relationship_risk(all_pairs(spark, folder), SETTINGS))
    return edges.withColumn("evidence", F.array_sort("evidence"))


@query("""WITH RECURSIVE reach(node, other) AS (SELECT DISTINCT x, x FROM (SELECT a AS x, b AS y FROM re UNION ALL SELECT b, a FROM re) UNION SELECT r.node, n.y FROM reach r JOIN (SELECT a AS x, b AS y FROM re UNION ALL SELECT b, a FROM re) n ON r.other = n.x)
  SELECT node, min(other) AS root FROM reach GROUP BY node""".replace("WITH RECURSIVE reach", "WITH RECURSIVE re AS (SELECT a, b FROM registry_edges), reach"))
def registry_components(spark, folder):
    return networks.components(P.registry_edges(spark, folder).select("a", "b"))


def owners(rows):
    """(bidder, company): the registry's bidder ids of the companies."""
    return rows.where("company IS NOT NULL").select(F.concat(F.lit("B-"), F.col("supplier").cast("string")).alias("bidder"), "company").distinct()


def relations_of(spark, folder, parts):
    return materialize(portfolio.relationship_edges(pairs.relationship_risk(all_pairs(spark, folder, parts), SETTINGS)), "relations")


@query()
def clusters(spark, folder):
    """Clusters of bidders by shared directors, addresses, documents, phones and accounts, numbered by score."""
    parts = core(spark, folder)
    known = owners(parts[0]).withColumnsRenamed({"company": "id", "bidder": "node"})
    relations = portfolio.renamed(relations_of(spark, folder, parts), known)
    edges = materialize(portfolio.merge_edges(relations, P.registry_edges(spark, folder)), "edges").where("linkable")
    found = portfolio.clusters(edges, networks.components(edges.select("a", "b")), P.bidder_scores(spark, folder))
    return views.number_clusters(found)


@query()
def cluster_signals(spark, folder):
    parts = core(spark, folder)
    known = owners(parts[0]).withColumnsRenamed({"bidder": "id", "company": "node"})
    registry = portfolio.renamed(P.registry_edges(spark, folder), known).select("a", "b", "evidence")
    edges = portfolio.merge_edges(relations_of(spark, folder, parts), registry)
    linked = networks.components(edges.where("linkable").select("a", "b"))
    rows = whole_scores(spark, folder, parts).select("company", F.explode("signals").alias("s")).select("company", "s.*")
    return views.cluster_signals(linked, rows)


@query("SELECT a, b, a || ' and ' || b || ' are linked by ' || array_to_string(evidence, ', ') AS text FROM registry_edges")
def pair_narratives(spark, folder):
    return views.narrative(P.registry_edges(spark, folder))


@query("SELECT CASE WHEN score > 75 THEN 'Critical' WHEN score > 50 THEN 'High' WHEN score > 25 THEN 'Medium' ELSE 'Low' END AS band, count(*) AS bidders, round(avg(score), 4) AS mean_score, round(count(*) / (SELECT count(*) FROM bidder_scores), 4) AS share FROM bidder_scores GROUP BY 1")
def risk_report(spark, folder):
    return views.risk_report(P.bidder_scores(spark, folder)).select("band", "bidders", r4("mean_score"), r4("share"))


_LISTED = "list_filter([" + ", ".join(f"CASE WHEN contains(low, '{n}') THEN '{label}' END" for n, label in documents.REQUIRED_DOCUMENTS) + "], lambda x: x IS NOT NULL)"
_SEEN = "list_filter([" + ", ".join(f"CASE WHEN {D._any('low', words)} > 0 THEN '{label}' END" for label, words in documents.DETECTED_DOCUMENTS.items()) + "], lambda x: x IS NOT NULL)"


@query(f"""WITH wanted AS (SELECT doc_id // 4 AS key, unnest({_LISTED}) AS requirement FROM (SELECT doc_id, lower({D._STRAY}) AS low FROM filed)),
  seen AS (SELECT DISTINCT doc_id // 4 AS key, unnest({_SEEN}) AS requirement FROM (SELECT doc_id, lower(text) AS low, {D._NORMAL} AS normal, length(regexp_replace(text, '\\s+', '', 'g')) AS n FROM filed) WHERE n >= 40 AND {D._any('normal', documents.RELEVANCE_TERMS)} > 0)
  SELECT w.key, w.requirement, s.key IS NOT NULL AS matched FROM wanted w LEFT JOIN seen s ON w.key = s.key AND w.requirement = s.requirement""")
def evidence_match(spark, folder):
    """Required documents of every fourth document's group against what its documents were detected as."""
    key = F.floor(F.col("doc_id") / 4).alias("key")
    docs = filed(spark, folder)
    wanted = docs.select(key, documents.required_documents(F.col("text")).alias("documents"))
    seen = docs.select(key, documents.document_status(F.col("text")).alias("status"), documents.detected_documents(F.col("text")).alias("documents"))
    return views.evidence_match(wanted, seen)
