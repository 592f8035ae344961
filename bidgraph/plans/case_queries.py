"""Queries of case work: decorated bids, details, alerts, reports, registries, stored graphs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidgraph.operators import casework, graph, identity, networks, portfolio, views
from bidgraph.plans import portfolio_queries as P
from bidgraph.plans.risk_queries import _edges, core, core_and_nodes, scored
from bidgraph.plans.sql import CTE, with_tables
from bidgraph.plans.storage import materialize
from bidgraph.sources import market

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_BAND = P._BAND
_SOURCES = {"gst": (2, 5), "company": (3, 4), "msme": (4, 3), "establishment": (5, 2), "documents": (7, 6), "blacklist": (6, 7)}
_LABELS = {"sharedPhone": "Shared Phone Number", "sharedBank": "Shared Bank Account"}
_SEVERITY = "CASE WHEN {0} > 75 THEN 'red' WHEN {0} > 50 THEN 'orange' ELSE 'yellow' END"

CTE |= {
    "registry_reach": "SELECT DISTINCT x AS node, x AS other FROM registry_around UNION SELECT r.node, n.y AS other FROM registry_reach r JOIN registry_around n ON r.other = n.x",
    "registry_root": "SELECT node, min(other) AS root FROM registry_reach GROUP BY node",
    "registry_cluster": "SELECT root, count(*) AS members, max(score) AS score FROM registry_root JOIN bidder_scores ON node = bidder_id GROUP BY root",
    "registry_numbered": "SELECT *, 'CLU-' || CASE WHEN row_number() OVER (ORDER BY score DESC, root) < 10 THEN '0' ELSE '' END || row_number() OVER (ORDER BY score DESC, root) AS cluster_id FROM registry_cluster",
    "registry_placed": "SELECT node AS bidder_id, cluster_id FROM registry_root JOIN registry_numbered USING (root)",
    "registry_codes": "SELECT root, code, row_number() OVER (PARTITION BY root ORDER BY count(*) DESC, code) AS place FROM registry_pairs JOIN registry_root ON node = a GROUP BY root, code",
    "registry_said": "SELECT root, list_sort(list(DISTINCT code)) AS evidence FROM registry_pairs JOIN registry_root ON node = a GROUP BY root",
    "decorated": f"""
      SELECT s.bid_id, s.tender_id, s.bidder_id, s.bid_amount, verification_status, submission_date, coalesce(company_name, 'Unknown') AS bidder_name, coalesce(msme_status, 'Unknown') AS msme_status,
        coalesce(score, 0) AS risk_score, {_BAND.format('coalesce(score, 0)')} AS risk_category, cluster_id, len(submitted_documents) AS file_count, len(pdf) > 0 AS has_pdf,
        pdf[1] AS first_pdf_name, coalesce(list_position(submitted_documents, pdf[1]), 0) - 1 AS first_pdf_index
      FROM (SELECT *, list_filter(submitted_documents, lambda f: ends_with(lower(f), '.pdf')) AS pdf FROM submissions) s LEFT JOIN bidders b ON s.bidder_id = b.bidder_id LEFT JOIN bidder_scores r ON s.bidder_id = r.bidder_id LEFT JOIN registry_placed p ON s.bidder_id = p.bidder_id""",
    "registry_records": " UNION ALL ".join(
        f"SELECT '{s}' AS source, upper(trim({casework.REGISTRIES[s][0]})) AS key, bool_or(CAST(substr(bidder_id, 3) AS BIGINT) % {bad} <> 0) AS good FROM bidders WHERE CAST(substr(bidder_id, 3) AS BIGINT) % {absent} <> 0 GROUP BY 2" for s, (absent, bad) in _SOURCES.items()
    ),
}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_tables(sql)
        return f

    return register


def registry_clusters(spark, folder):
    """(edges, components, numbered clusters, bidder places) of the registry's links."""
    edges = materialize(P.registry_edges(spark, folder).select("a", "b", "evidence", F.lit(0).alias("score"), F.lit(True).alias("linkable")), "registry")
    linked = networks.components(edges.select("a", "b"))
    found = materialize(views.number_clusters(portfolio.clusters(edges, linked, P.bidder_scores(spark, folder))), "clusters")
    return edges, linked, found, casework.cluster_of(linked, found)


def decorated(spark, folder, placed=None):
    placed = registry_clusters(spark, folder)[3] if placed is None else placed
    return casework.decorated_bids(market.submissions(spark, folder), market.bidders(spark, folder), P.bidder_scores(spark, folder), placed)


@query("SELECT * FROM decorated")
def decorated_bids(spark, folder):
    return decorated(spark, folder)


@query("""SELECT d.bid_id, d.tender_id, t.title AS tender_title, t.status AS tender_status, d.bidder_id, bidder_name, director_name,
  CASE WHEN length(phone) <= 4 THEN phone ELSE left(phone, 2) || 'XXXXXX' || right(phone, 2) END AS phone, CASE WHEN length(bank_account) <= 4 THEN bank_account ELSE 'XXXX XXXX ' || right(bank_account, 4) END AS bank_account,
  risk_score, risk_category, cluster_id, matched, missing, total, CASE WHEN missing > 0 THEN 'Requirements missing' WHEN matched = total THEN 'Checklist matched' WHEN total > 0 THEN 'Evidence required' END AS comparison,
  coalesce(list_sort(codes), []) AS evidence, coalesce(n, 0) AS related_bidders
  FROM decorated d LEFT JOIN bidders b ON d.bidder_id = b.bidder_id LEFT JOIN tenders t ON d.tender_id = t.tender_id LEFT JOIN compared c ON d.bid_id = c.bid_id LEFT JOIN evidence_of e ON d.bidder_id = e.bidder_id
    LEFT JOIN (SELECT x, count(*) AS n FROM registry_around GROUP BY x) r ON d.bidder_id = x""")
def bid_details(spark, folder):
    edges, _, _, placed = registry_clusters(spark, folder)
    return casework.bid_details(decorated(spark, folder, placed), market.bidders(spark, folder), market.tenders(spark, folder), P.tender_comparison(spark, folder), portfolio.evidence_per_bidder(edges), edges)


@query("SELECT x AS bidder_id, y AS other_id, company_name, 0 AS score, evidence, true AS linkable FROM (SELECT a AS x, b AS y, evidence FROM registry_edges UNION ALL SELECT b, a, evidence FROM registry_edges) JOIN bidders ON y = bidder_id")
def related_bidders(spark, folder):
    return casework.related_bidders(registry_clusters(spark, folder)[0], market.bidders(spark, folder))


@query(f"""SELECT b.bidder_id, company_name, CASE WHEN length(phone) <= 4 THEN phone ELSE left(phone, 2) || 'XXXXXX' || right(phone, 2) END AS phone,
  CASE WHEN length(bank_account) <= 4 THEN bank_account ELSE 'XXXX XXXX ' || right(bank_account, 4) END AS bank_account, score AS risk_score, {_BAND.format('score')} AS risk_category, cluster_id
  FROM bidders b JOIN bidder_scores s ON b.bidder_id = s.bidder_id LEFT JOIN registry_placed p ON b.bidder_id = p.bidder_id""")
def bidder_network(spark, folder):
    return casework.network_nodes(market.bidders(spark, folder), P.bidder_scores(spark, folder), registry_clusters(spark, folder)[3])


@query(f"""SELECT 'AL-' || cluster_id || '-' || code AS alert_id, {_SEVERITY.format('score')} AS severity, label AS title, label || ' detected across ' || members || ' bidders. This is a review priority, not a finding of wrongdoing.' AS description,
    cluster_id, code AS signal_code, score AS risk_score, NULL AS bid_id, NULL AS date
  FROM registry_codes JOIN registry_numbered USING (root) JOIN (VALUES {', '.join(f"('{k}', '{v}')" for k, v in _LABELS.items())}) l(code, label) USING (code) WHERE place <= 4
  UNION ALL SELECT 'AL-' || s.bidder_id, {_SEVERITY.format('score')}, 'Elevated relationship risk: ' || company_name, 'Scored ' || score || '/100; manual verification required.', cluster_id, NULL, score, bid_id, submission_date
  FROM bidder_scores s JOIN bidders b ON s.bidder_id = b.bidder_id LEFT JOIN registry_placed p ON s.bidder_id = p.bidder_id
    LEFT JOIN (SELECT bidder_id, arg_min(bid_id, (submission_date, bid_id)) AS bid_id, min(submission_date) AS submission_date FROM submissions GROUP BY bidder_id) f ON s.bidder_id = f.bidder_id WHERE score >= 50""")
def review_alerts(spark, folder):
    edges, linked, found, placed = registry_clusters(spark, folder)
    return casework.review_alerts(found, casework.code_places(edges, linked), P.bidder_scores(spark, folder), market.submissions(spark, folder), market.bidders(spark, folder), placed)


@query("SELECT bid_id, bidder_name, verification_status AS status, risk_score, count(*) OVER (PARTITION BY verification_status) AS of_status FROM decorated")
def bid_verification_report(spark, folder):
    return casework.verification_report(materialize(decorated(spark, folder), "decorated"))


@query("SELECT risk_category, count(*) AS bids, round(avg(risk_score), 4) AS mean_risk FROM decorated GROUP BY 1")
def risk_distribution(spark, folder):
    return casework.bid_distribution(decorated(spark, folder)).withColumn("mean_risk", F.round("mean_risk", 4))


@query("SELECT bid_id, bidder_name, risk_score FROM decorated ORDER BY risk_score DESC, bid_id LIMIT 10")
def top_risk_bids(spark, folder):
    return casework.top_risk_bids(decorated(spark, folder))


@query(f"SELECT cluster_id, score AS risk_score, {_BAND.format('score')} AS risk_category, evidence, company_name AS member FROM registry_numbered JOIN registry_said USING (root) JOIN registry_root USING (root) JOIN bidders ON node = bidder_id")
def bidder_network_report(spark, folder):
    _, linked, found, _ = registry_clusters(spark, folder)
    return casework.cluster_report(found, linked, market.bidders(spark, folder))


@query("""SELECT 'cluster' AS kind, cluster_id AS id, array_to_string(evidence, ', ') AS text, score::BIGINT AS score FROM registry_numbered JOIN registry_said USING (root)
  UNION ALL (SELECT 'audit', bid_id, new_status, action_seq FROM actions ORDER BY action_seq DESC LIMIT 15)""")
def investigation_summary(spark, folder):
    return casework.investigation_summary(registry_clusters(spark, folder)[2], P.actions(spark, folder))


def registry_records(spark, folder):
    """(source, key, good): six registries that hold some of the bidders, some of them not in order."""
    b, out = market.bidders(spark, folder), None
    k = F.substring("bidder_id", 3, 20).cast("long")
    for source, (absent, bad) in _SOURCES.items():
        part = b.where(k % absent != 0).select(F.lit(source).alias("source"), F.col(casework.REGISTRIES[source][0]).alias("key"), (k % bad != 0).alias("good"))
        out = part if out is None else out.unionByName(part)
    return out


@query(" UNION ALL ".join(
    f"SELECT bidder_id, '{s}' AS source, CASE WHEN good IS NULL THEN '{no}' WHEN good THEN '{yes}' ELSE '{other}' END AS status FROM bidders b LEFT JOIN registry_records r ON r.source = '{s}' AND r.key = upper(trim({column}))" for s, (column, yes, other, no) in casework.REGISTRIES.items()
))
def registry_checks(spark, folder):
    return casework.registry_checks(market.bidders(spark, folder), registry_records(spark, folder))


@query("SELECT src AS id, dst AS neighbour, edge_type, weight FROM edges UNION ALL SELECT dst, src, edge_type, weight FROM edges")
def graph_neighbours(spark, folder):
    return casework.neighbours(materialize(_edges(core(spark, folder)), "edges"))


def _stored(rows, key: str):
    """(earlier, later): two overlapping parts of a table by a key's last character, the earlier with another value."""
    last = F.substring(key, -1, 1)
    return rows.where(last <= "7"), rows.where(last >= "4")


@query("SELECT id, node_type, CASE WHEN right(id, 1) < '4' THEN 'was ' || display ELSE display END AS display FROM nodes")
def merged_nodes(spark, folder):
    """A stored graph's nodes after a later graph is merged into it."""
    earlier, later = _stored(core_and_nodes(spark, folder)[1], "id")
    return casework.merged(earlier.withColumn("display", F.concat(F.lit("was "), "display")), later, ["id"])


@query("SELECT src, dst, edge_type, CASE WHEN right(src, 1) < '4' THEN weight + 1 ELSE weight END AS weight FROM edges")
def merged_edges(spark, folder):
    earlier, later = _stored(materialize(_edges(core(spark, folder)), "edges"), "src")
    return casework.merged(earlier.withColumn("weight", F.col("weight") + 1), later, ["src", "dst", "edge_type"])


_KINDS = ("Company", "Person", "Tender", "Address", "Department")


@query(f"""SELECT id, row_number() OVER (ORDER BY id, node_type) - 1 AS node, list_position({list(_KINDS)}, node_type) - 1 AS type_code, list_transform({list(_KINDS)}, lambda k: CAST(k = node_type AS INTEGER)) AS one_hot FROM nodes""")
def encoded_nodes(spark, folder):
    return casework.encoded_nodes(core_and_nodes(spark, folder)[1], _KINDS)


@query(f"""SELECT s.node AS src_node, d.node AS dst_node, list_position({list(graph.EDGE_SCHEMA)}, edge_type) - 1 AS type_code, weight FROM edges
  JOIN (SELECT id, row_number() OVER (ORDER BY id, node_type) - 1 AS node FROM nodes) s ON src = s.id JOIN (SELECT id, row_number() OVER (ORDER BY id, node_type) - 1 AS node FROM nodes) d ON dst = d.id""")
def encoded_edges(spark, folder):
    parts, nodes = core_and_nodes(spark, folder)
    nodes = materialize(casework.encoded_nodes(nodes, _KINDS).select("id", "node"), "encoded")
    return casework.encoded_edges(_edges(parts), nodes, tuple(graph.EDGE_SCHEMA))


@query("SELECT bid_id, tender_id, submission_date, verification_status, submitted_documents FROM submissions")
def stored_documents(spark, folder):
    """Bids kept as JSON texts and read back, newest first."""
    rows = market.submissions(spark, folder).select("bid_id", "tender_id", "submission_date", "verification_status", "submitted_documents")
    return casework.newest_first(materialize(casework.json_documents(rows, "bid_id"), "json"), rows.schema, "submission_date")


@query("SELECT t.tender_id, l.bid_id, l.bid_id IS NOT NULL AS allowed FROM tenders t LEFT JOIN lowest l ON t.tender_id = l.tender_id")
def award_checks(spark, folder):
    return casework.award_check(market.tenders(spark, folder), market.submissions(spark, folder))


@query("SELECT cluster_id, cluster_id || ' links ' || members || ' bidders by ' || array_to_string(evidence, ', ') || '; its highest score is ' || score || '.' AS text FROM registry_numbered JOIN registry_said USING (root)")
def cluster_narratives(spark, folder):
    return casework.cluster_narratives(registry_clusters(spark, folder)[2])


@query("""SELECT 'tenders' AS name, count(*) AS n FROM tenders UNION ALL SELECT 'bids', count(*) FROM submissions UNION ALL SELECT 'bidders', count(*) FROM bidder_scores UNION ALL SELECT 'flagged', count(*) FROM bidder_scores WHERE score >= 50
  UNION ALL SELECT 'clusters', count(*) FROM registry_cluster UNION ALL SELECT 'clustered', coalesce(sum(members), 0)::BIGINT FROM registry_cluster""")
def portfolio_totals(spark, folder):
    return casework.portfolio_totals(market.tenders(spark, folder), market.submissions(spark, folder), P.bidder_scores(spark, folder), registry_clusters(spark, folder)[2])


@query("SELECT tender_id, title, department, status FROM tenders WHERE lower(status) = 'open' AND (contains(lower(tender_id), 'build') OR contains(lower(title), 'build') OR contains(lower(department), 'build') OR contains(lower(category), 'build'))")
def tender_search(spark, folder):
    return casework.search_tenders(market.tenders(spark, folder), "BUILD", "Open").select("tender_id", "title", "department", "status")


@query("SELECT bid_id, risk_score, count(*) OVER () AS total FROM decorated WHERE risk_category = 'Low' ORDER BY risk_score DESC, bid_amount DESC, bid_id LIMIT 20 OFFSET 40")
def risk_page(spark, folder):
    rows = decorated(spark, folder).where("risk_category = 'Low'")
    return casework.counted_page(rows, [F.desc("risk_score"), F.desc("bid_amount"), F.col("bid_id")], number=3).select("bid_id", "risk_score", "total")


@query(f"SELECT m.raw AS bidder_id, CAST(round(coalesce(risk_score, 0)::DOUBLE) AS INTEGER) AS score, {_BAND.format('round(coalesce(risk_score, 0)::DOUBLE)')} AS band, coalesce(codes, []) AS codes FROM company_map m LEFT JOIN scores s ON canonical = s.company")
def raw_bidder_scores(spark, folder):
    """Scores of companies spread to every raw bidder id that they are known by."""
    parts = core(spark, folder)
    feed = market.bid_feed(spark, folder)
    codes = F.array_sort(F.transform("signals", lambda s: s["code"])).alias("codes")
    known = identity.entities(feed, "company").select(F.col("canonical").alias("company"), "aliases")
    entities = known.join(scored(spark, folder, parts).select("company", "risk_score", codes), "company")
    return portfolio.scores_to_raw(entities, feed.select(F.col("company_id").alias("bidder_id")).distinct())
