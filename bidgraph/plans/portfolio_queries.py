"""Queries of the portfolio views, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidgraph.operators import portfolio
from bidgraph.plans.sql import CTE, with_tables
from bidgraph.plans.tables import table
from bidgraph.sources import market

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

CTE |= {
    "lowest": "SELECT tender_id, arg_min(bid_id, (bid_amount, bid_id)) AS bid_id, arg_min(bidder_id, (bid_amount, bid_id)) AS bidder_id, min(bid_amount) AS bid_amount FROM submissions WHERE bid_amount > 0 GROUP BY tender_id",
    "registry_pairs": """
      SELECT a.bidder_id AS a, b.bidder_id AS b, 'sharedPhone' AS code FROM bidders a JOIN bidders b ON trim(a.phone) = trim(b.phone) AND trim(a.phone) <> '' AND a.bidder_id < b.bidder_id
      UNION ALL SELECT a.bidder_id, b.bidder_id, 'sharedBank' FROM bidders a JOIN bidders b ON trim(a.bank_account) = trim(b.bank_account) AND trim(a.bank_account) <> '' AND a.bidder_id < b.bidder_id""",
    "registry_edges": "SELECT a, b, list_sort(list(DISTINCT code)) AS evidence FROM registry_pairs GROUP BY a, b",
    "bidder_scores": "SELECT bidder_id, CAST(round(greatest(0, least(100, balance / 100))) AS INTEGER) AS score FROM bidders",
    "required": "SELECT tender_id, unnest(required_documents) AS requirement FROM tenders",
    "aliases_of": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {list(v)})" for k, v in portfolio.DOCUMENT_ALIASES.items()) + ") t(requirement, needles)",
    "doc_checks": """
      SELECT bid_id, s.tender_id, s.bidder_id, r.requirement, CASE
        WHEN len(list_filter(submitted_documents, lambda d: len(list_filter(needles, lambda w: contains(lower(d), w))) > 0)) > 0 THEN 'matched'
        WHEN (r.requirement = 'GST certificate' AND gst_number <> '') OR (r.requirement = 'PAN card' AND pan_number <> '') OR (r.requirement = 'Udyam/MSME certificate' AND msme_status = 'Yes') THEN 'matched'
        WHEN len(submitted_documents) > 0 THEN 'missing' ELSE 'evidence_required' END AS status
      FROM submissions s JOIN required r ON s.tender_id = r.tender_id JOIN aliases_of a ON r.requirement = a.requirement LEFT JOIN bidders b ON s.bidder_id = b.bidder_id""",
    "compared": """
      SELECT bid_id, count(*) FILTER (WHERE status = 'matched') AS matched, count(*) FILTER (WHERE status = 'missing') AS missing, count(*) AS total FROM doc_checks GROUP BY bid_id""",
    "points": """
      SELECT s.bid_id, s.tender_id, s.bidder_id, bid_amount, CAST(floor(0.5::DOUBLE * coalesce(floor(100 * matched / total + 0.5), 0) + 0.3::DOUBLE * least(100, min(bid_amount) OVER (PARTITION BY s.tender_id) / bid_amount * 100)
        + 0.2::DOUBLE * greatest(0, 100 - coalesce(b.score, 0)) + 0.5) AS INTEGER) AS points
      FROM submissions s LEFT JOIN compared c ON s.bid_id = c.bid_id LEFT JOIN bidder_scores b ON s.bidder_id = b.bidder_id""",
    "actions": """
      SELECT 'BID-' || (user_id % 500) AS bid_id, event_id AS action_seq, CASE event_type WHEN 'purchase' THEN 'Verified' WHEN 'error' THEN 'Flagged' ELSE 'Needs Review' END AS new_status FROM events""",
    "evidence_of": "SELECT bidder_id, list(DISTINCT code) AS codes FROM (SELECT a AS bidder_id, code FROM registry_pairs UNION ALL SELECT b, code FROM registry_pairs) GROUP BY bidder_id",
}
_BAND = "CASE WHEN {0} > 75 THEN 'Critical' WHEN {0} > 50 THEN 'High' WHEN {0} > 25 THEN 'Medium' ELSE 'Low' END"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_tables(sql)
        return f

    return register


def bidder_scores(spark, folder):
    b = market.bidders(spark, folder)
    return b.select("bidder_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("balance") / 100))).cast("int").alias("score")).withColumn("band", portfolio.portfolio_band(F.col("score")))


def actions(spark, folder):
    return actions_of(table(spark, folder, "events"))


def actions_of(events):
    """(bid_id, action_seq, new_status) of events, as a table or a stream."""
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "Verified").when(kind == "error", "Flagged").otherwise("Needs Review")
    return events.select(F.concat(F.lit("BID-"), (F.col("user_id") % 500).cast("string")).alias("bid_id"), F.col("event_id").alias("action_seq"), status.alias("new_status"))


@query("SELECT tender_id, bid_id, bidder_id, bid_amount FROM lowest")
def lowest_bids(spark, folder):
    return portfolio.lowest_bids(market.submissions(spark, folder))


@query("""SELECT s.bidder_id AS company_id, company_name, 'PER-' || trim(regexp_replace(lower(trim(director_name)), '[^a-z0-9]+', '-', 'g'), '-') AS person_id, director_name AS person_name, s.tender_id,
  category AS department_id, address, s.bid_amount, submission_date AS bid_date, CASE WHEN l.bid_id IS NULL THEN 'lost' ELSE 'won' END AS result
  FROM submissions s JOIN bidders b ON s.bidder_id = b.bidder_id LEFT JOIN lowest l ON s.bid_id = l.bid_id""")
def analysis_records(spark, folder):
    return portfolio.analysis_records(market.bidders(spark, folder), market.submissions(spark, folder))


@query(f"SELECT bidder_id, score, {_BAND.format('score')} AS band FROM bidder_scores")
def portfolio_bands(spark, folder):
    return bidder_scores(spark, folder)


@query("SELECT a, b, evidence FROM registry_edges")
def registry_edges(spark, folder):
    return portfolio.registry_edges(market.bidders(spark, folder))


@query("SELECT bidder_id, list_sort(codes) AS codes FROM evidence_of")
def registry_evidence(spark, folder):
    return portfolio.evidence_per_bidder(portfolio.registry_edges(market.bidders(spark, folder)))


@query("""SELECT t.tender_id, title, department, category, status, coalesce(n, 0) AS bid_count, CASE WHEN status = 'Awarded' THEN l.bid_id END AS winner_bid_id,
  CASE WHEN status = 'Awarded' THEN b.company_name END AS winner_name, CASE WHEN status = 'Awarded' THEN l.bid_amount END AS award_amount
  FROM tenders t LEFT JOIN (SELECT tender_id, count(*) AS n FROM submissions GROUP BY tender_id) c ON t.tender_id = c.tender_id LEFT JOIN lowest l ON t.tender_id = l.tender_id LEFT JOIN bidders b ON l.bidder_id = b.bidder_id""")
def tender_list(spark, folder):
    return portfolio.tender_list(market.tenders(spark, folder), market.submissions(spark, folder), market.bidders(spark, folder))


@query("SELECT lower(status) AS status, count(*) AS tenders, count(DISTINCT category) AS categories FROM tenders GROUP BY 1")
def tender_counts(spark, folder):
    return market.tenders(spark, folder).groupBy(F.lower("status").alias("status")).agg(F.count("*").alias("tenders"), F.count_distinct("category").alias("categories"))


@query("""SELECT total_bids, verified, needs_review, flagged, low, medium, high, critical FROM
  (SELECT count(*) AS total_bids, count(*) FILTER (WHERE verification_status = 'Verified') AS verified, count(*) FILTER (WHERE verification_status = 'Needs Review') AS needs_review, count(*) FILTER (WHERE verification_status = 'Flagged') AS flagged FROM submissions),
  (SELECT count(*) FILTER (WHERE score <= 25) AS low, count(*) FILTER (WHERE score > 25 AND score <= 50) AS medium, count(*) FILTER (WHERE score > 50 AND score <= 75) AS high, count(*) FILTER (WHERE score > 75) AS critical FROM bidder_scores)""")
def dashboard(spark, folder):
    return portfolio.dashboard(market.submissions(spark, folder), bidder_scores(spark, folder))


@query("SELECT bid_id, tender_id, bidder_id, requirement, status FROM doc_checks")
def document_checks(spark, folder):
    return portfolio.document_checks(market.tenders(spark, folder), market.submissions(spark, folder), market.bidders(spark, folder))


@query("""SELECT bid_id, matched, missing, total, CAST(floor(100 * matched / total + 0.5) AS INTEGER) AS score,
  CASE WHEN missing > 0 THEN 'Requirements missing' WHEN matched = total THEN 'Checklist matched' ELSE 'Evidence required' END AS status FROM compared""")
def tender_comparison(spark, folder):
    return portfolio.comparison(market.tenders(spark, folder), market.submissions(spark, folder), market.bidders(spark, folder))


@query("SELECT bid_id, tender_id, bidder_id, points, row_number() OVER (PARTITION BY tender_id ORDER BY points DESC, bid_amount, bid_id) AS place FROM points")
def bid_ranking(spark, folder):
    return portfolio.bid_ranking(market.submissions(spark, folder), tender_comparison(spark, folder), bidder_scores(spark, folder))


@query("""SELECT bid_id, s.bidder_id, company_name, submission_date FROM submissions s LEFT JOIN bidders b ON s.bidder_id = b.bidder_id
  WHERE contains(lower(address), 'nation_1') AND verification_status = 'Verified' AND submission_date >= '1996-01-01'""")
def bid_search(spark, folder):
    found = portfolio.search_bids(market.submissions(spark, folder), market.bidders(spark, folder), "NATION_1", "Verified", since="1996-01-01")
    return found.select("bid_id", "bidder_id", "company_name", "submission_date")


@query("SELECT bid_id, submission_date, bid_amount FROM submissions ORDER BY submission_date DESC, bid_id LIMIT 20 OFFSET 20")
def bid_page(spark, folder):
    bids = market.submissions(spark, folder).select("bid_id", "submission_date", "bid_amount")
    return portfolio.page(bids, [F.desc("submission_date"), F.col("bid_id")], number=2)


@query(f"""SELECT bidder_id, company_name, director_name, CASE WHEN length(phone) <= 4 THEN phone ELSE left(phone, 2) || 'XXXXXX' || right(phone, 2) END AS phone,
  CASE WHEN length(bank_account) <= 4 THEN bank_account ELSE 'XXXX XXXX ' || right(bank_account, 4) END AS bank_account, score, {_BAND.format('score')} AS band FROM bidders JOIN bidder_scores USING (bidder_id)""")
def masked_bidders(spark, folder):
    return portfolio.masked_bidders(market.bidders(spark, folder), bidder_scores(spark, folder))


@query("""SELECT s.bidder_id, count(*) AS bids, count(*) FILTER (WHERE verification_status = 'Verified') AS verified, count(*) FILTER (WHERE t.status = 'Awarded' AND l.bid_id IS NOT NULL) AS awarded, max(submission_date) AS latest
  FROM submissions s LEFT JOIN tenders t ON s.tender_id = t.tender_id LEFT JOIN lowest l ON s.bid_id = l.bid_id GROUP BY s.bidder_id""")
def bidder_history(spark, folder):
    return portfolio.bidder_history(market.submissions(spark, folder), market.tenders(spark, folder))


@query(r"""SELECT bidder_id, unnest(['gst', 'pan', 'msme', 'bank', 'registration', 'director', 'address', 'documents']) AS key,
  unnest([CASE WHEN g THEN 'verified' ELSE 'failed' END, CASE WHEN p THEN 'verified' ELSE 'failed' END, 'verified', CASE WHEN bank THEN 'warning' ELSE 'verified' END, 'verified', 'verified', 'verified', 'verified']) AS status,
  unnest([CASE WHEN g THEN 98 ELSE 40 END, CASE WHEN p THEN 97 ELSE 35 END, 95, CASE WHEN bank THEN 62 ELSE 96 END, 99, 97, 96, 100]) AS confidence
  FROM (SELECT b.bidder_id, regexp_matches(gst_number, '^\d{2}[A-Z]{5}\d{4}[A-Z][A-Z\d]Z[A-Z\d]$') AS g, regexp_matches(pan_number, '^[A-Z]{5}\d{4}[A-Z]$') AS p, coalesce(list_contains(codes, 'sharedBank'), false) AS bank
    FROM bidders b LEFT JOIN evidence_of e ON b.bidder_id = e.bidder_id)""")
def compliance_checklist(spark, folder):
    return portfolio.checklist(market.bidders(spark, folder), registry_evidence(spark, folder))


@query("SELECT bid_id, action_seq, new_status, lag(new_status, 1, 'Needs Review') OVER (PARTITION BY bid_id ORDER BY action_seq) AS previous_status FROM actions")
def audit_rows(spark, folder):
    return portfolio.audit_rows(actions(spark, folder))


@query("SELECT bid_id, arg_max(new_status, action_seq) AS status, count(*) AS actions FROM actions GROUP BY bid_id")
def bid_status(spark, folder):
    return portfolio.bid_status(actions(spark, folder))


@query("SELECT action_seq, bid_id, new_status FROM actions ORDER BY action_seq DESC LIMIT 15")
def latest_audit(spark, folder):
    return actions(spark, folder).orderBy(F.desc("action_seq")).limit(15)


@query("""SELECT tender_id, list_reduce(list_prepend('Draft', list(action ORDER BY seq)), lambda status, action: CASE
    WHEN action = 'publish' AND status = 'Draft' THEN 'Open' WHEN action = 'close' AND status = 'Open' THEN 'Closed' WHEN action = 'withdraw' AND status NOT IN ('Awarded', 'Closed') THEN 'Withdrawn'
    WHEN action = 'award' AND status IN ('Open', 'Closed') THEN 'Awarded' WHEN action = 'remove' AND status IN ('Draft', 'Withdrawn') THEN 'Removed' ELSE status END) AS status, count(*) AS actions
  FROM (SELECT 'T' || user_id AS tender_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'publish' WHEN 'view' THEN 'close' WHEN 'error' THEN 'withdraw' WHEN 'purchase' THEN 'award' ELSE 'remove' END AS action FROM events) GROUP BY tender_id""")
def tender_lifecycle(spark, folder):
    kind = F.col("event_type")
    action = F.when(kind == "signup", "publish").when(kind == "view", "close").when(kind == "error", "withdraw").when(kind == "purchase", "award").otherwise("remove")
    steps = table(spark, folder, "events").select(F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("tender_id"), F.col("event_id").alias("seq"), action.alias("action"))
    return portfolio.replay_tenders(steps)


@query("""SELECT bidder_id, CASE WHEN k IS NULL THEN 'Not Found' WHEN good THEN 'Verified' ELSE 'Needs Review' END AS status FROM bidders
  LEFT JOIN (SELECT upper(trim(s_name)) AS k, bool_or(s_acctbal > 0) AS good FROM supplier WHERE s_suppkey % 3 <> 0 GROUP BY 1) r ON upper(trim(company_name)) = k""")
def registry_verification(spark, folder):
    companies = table(spark, folder, "supplier").where("s_suppkey % 3 <> 0")
    return portfolio.registry_check(market.bidders(spark, folder), companies, "company_name", "s_name", F.col("s_acctbal") > 0, ("Verified", "Needs Review", "Not Found"))


@query(r"""WITH asked AS (SELECT c_custkey AS seq, CASE WHEN c_custkey % 3 = 0 THEN '  SUPPLIER#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') ELSE c_name END AS company_name FROM customer),
  known AS (SELECT lower(trim(company_name)) AS key, min(bidder_id) AS bidder_id FROM bidders GROUP BY 1), firsts AS (SELECT lower(trim(company_name)) AS key, min(seq) AS first_seq FROM asked GROUP BY 1),
  made AS (SELECT key, 'B-' || ((SELECT max(CAST(regexp_extract(bidder_id, '(\d+)$', 1) AS BIGINT)) FROM bidders) + row_number() OVER (ORDER BY first_seq, key)) AS bidder_id FROM firsts WHERE key NOT IN (SELECT key FROM known))
  SELECT company_name, seq, bidder_id, 'Needs Review' AS status FROM asked JOIN (SELECT * FROM known UNION ALL SELECT * FROM made) ids ON lower(trim(company_name)) = key""")
def new_submissions(spark, folder):
    """Customers submit bids under their own and under suppliers' names."""
    c = table(spark, folder, "customer")
    named = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("  SUPPLIER#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))).otherwise(F.col("c_name"))
    return portfolio.number_submissions(c.select(named.alias("company_name"), F.col("c_custkey").alias("seq")), market.bidders(spark, folder))
