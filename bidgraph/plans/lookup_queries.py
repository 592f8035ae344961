"""Queries of lookups and figures: neighbours within some hops, tenders of a pair, quantiles, exact splits, lifecycles, trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidgraph.operators import features, graph, model, networks, pairs, portfolio
from bidgraph.operators.neighbourhood import neighbours_within
from bidgraph.plans import network_queries
from bidgraph.plans.portfolio_queries import bidder_scores
from bidgraph.plans.risk_queries import SETTINGS, core, counted
from bidgraph.plans.sql import with_tables
from bidgraph.plans.storage import materialize
from bidgraph.plans.tables import table
from bidgraph.sources import market

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_tables(sql)
        return f

    return register


def _neighbours(depth: int):
    """Of the tenders whose number is divisible by 100, in the graph of all nodes."""
    steps = "n0 AS (SELECT DISTINCT tender AS seed, tender AS id, 0 AS hops FROM facts WHERE tender LIKE 'T\\_T%00' ESCAPE '\\')"
    for hop in range(1, depth + 1):
        steps += f", s{hop} AS (SELECT DISTINCT seed, dst AS id FROM n{hop - 1} JOIN ends ON id = src WHERE hops = {hop - 1}), n{hop} AS (SELECT * FROM n{hop - 1} UNION ALL SELECT seed, id, {hop} FROM s{hop} ANTI JOIN n{hop - 1} USING (seed, id))"
    sql = f"""SELECT seed, id, hops FROM (WITH ends AS MATERIALIZED (SELECT DISTINCT src, dst FROM u_ends WHERE src <> dst), {steps}
      SELECT *, row_number() OVER (PARTITION BY seed ORDER BY hops, id) AS place FROM n{depth} WHERE hops > 0) WHERE place <= 500"""

    def neighbours(spark, folder):
        rows, facts, _ = core(spark, folder)
        edges = graph.edges(rows, counted(facts), facts).select("src", "dst")
        edges = edges if depth == 1 else materialize(edges, "edges")
        seeds = facts.where(F.col("tender").rlike("^T_T.*00$")).select(F.col("tender").alias("id"))
        return neighbours_within(edges, seeds, depth)

    neighbours.__name__ = f"neighbours_within_{depth}"
    return query(sql)(neighbours)


for _depth in (1, 2, 3):
    _neighbours(_depth)


@query("""SELECT company_a, company_b, (place - 1) // 100 AS part, list(tender ORDER BY place) AS tenders FROM (SELECT company_a, company_b, tender, row_number() OVER (PARTITION BY company_a, company_b ORDER BY tender_seq, tender) AS place FROM pair_rows) GROUP BY 1, 2, 3""")
def pair_tenders(spark, folder):
    """The tenders of each pair as first seen, 100 to a row."""
    _, facts, dim = core(spark, folder)
    return pairs.tender_lists(facts.where("company IS NOT NULL"), dim, length=100)


@query("SELECT round(quantile_cont(neighbours / ((SELECT count(*) FROM u_degree) - 1), 0.95), 6)::DOUBLE AS cutoff FROM u_degree WHERE id IN (SELECT company FROM facts)")
def degree_centrality_cutoff(spark, folder):
    """The cutoff of high centrality, over the degree centrality of companies in the graph of all nodes."""
    parts = core(spark, folder)
    degrees = networks.degrees(network_queries.links(spark, folder, parts)).join(network_queries.companies(parts[1]), "id")
    return features.percentile_threshold(degrees, "degree_centrality", SETTINGS.high_degree_percentile).select(F.round("cutoff", 6).alias("cutoff"))


_SPLIT = """SELECT doc_id, label, seed, CASE WHEN place <= floor(0.25 * size + 0.5) THEN 'test' WHEN place <= floor(0.4 * size + 0.5) THEN 'validation' ELSE 'train' END AS part FROM
  (SELECT *, row_number() OVER (PARTITION BY seed, label ORDER BY md5(doc_id || ':' || seed), doc_id) AS place, count(*) OVER (PARTITION BY seed, label) AS size FROM (SELECT DISTINCT doc_id, toxic AS label FROM labels), (SELECT unnest([7, 42]) AS seed))"""


@query(_SPLIT)
def exact_split(spark, folder):
    """Labelled documents split by label, with exact shares, for two seeds."""
    rows = table(spark, folder, "labels").select("doc_id", F.col("toxic").alias("label")).distinct()
    one, two = (model.exact_split(rows, "doc_id", seed).withColumn("seed", F.lit(seed)) for seed in (7, 42))
    return one.unionByName(two).select("doc_id", "label", "seed", "part")


@query("""SELECT tender_id, split_part(folded, ':', 1) AS status, CASE WHEN folded LIKE 'Awarded:%' THEN split_part(folded, ':', 2) END AS awarded_bid, refused, actions FROM (
  SELECT tender_id, list_reduce(list_prepend('Draft', list(action ORDER BY seq)), lambda s, a: CASE WHEN a = 'publish' AND s = 'Draft' THEN 'Open' WHEN a = 'close' AND s = 'Open' THEN 'Closed'
      WHEN a = 'withdraw' AND s NOT LIKE 'Awarded%' AND s <> 'Closed' THEN 'Withdrawn' WHEN a LIKE 'award:%' AND s IN ('Open', 'Closed') THEN 'Awarded:' || substr(a, 7) WHEN a = 'remove' AND s IN ('Draft', 'Withdrawn') THEN 'Removed' ELSE s END) AS folded,
    count(*) FILTER (WHERE action = 'refused') AS refused, count(*) AS actions FROM (
    SELECT a.tender_id, seq, CASE WHEN action <> 'award' THEN action WHEN s.bid_id IS NULL THEN 'refused' ELSE 'award:' || a.bid_id END AS action FROM (
      SELECT 'T' || (l_orderkey + l_partkey % 2) AS tender_id, l_linenumber::BIGINT * 1000000000 + l_partkey * 10000 + l_suppkey AS seq, ['publish', 'award', 'close', 'award', 'withdraw', 'award', 'remove'][CAST((l_linenumber - 1) % 7 + 1 AS INTEGER)] AS action,
        'BID-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS bid_id FROM lineitem) a LEFT JOIN (SELECT DISTINCT tender_id, bid_id FROM submissions) s ON a.tender_id = s.tender_id AND a.bid_id = s.bid_id) GROUP BY tender_id)""")
def award_lifecycle(spark, folder):
    """Tender histories with awards; every second bid is named in an award of the next tender, which is refused."""
    line = table(spark, folder, "lineitem")
    names = F.array(*[F.lit(a) for a in ("publish", "award", "close", "award", "withdraw", "award", "remove")])
    actions = line.select(
        F.concat(F.lit("T"), (F.col("l_orderkey") + F.col("l_partkey") % 2).cast("string")).alias("tender_id"), (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).alias("seq"),
        F.element_at(names, ((F.col("l_linenumber") - 1) % 7 + 1).cast("int")).alias("action"), F.concat_ws("-", F.lit("BID"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("bid_id"),
    )
    return portfolio.award_lifecycle(actions, market.submissions(spark, folder), chunk=2_000_000_000)


@query("""WITH b AS (SELECT date_trunc('month', CAST(submission_date AS DATE))::DATE AS period, coalesce(score, 0) AS score FROM submissions LEFT JOIN bidder_scores USING (bidder_id)),
  every AS (SELECT unnest(range((SELECT min(period) FROM b)::TIMESTAMP, (SELECT max(period) FROM b)::TIMESTAMP + INTERVAL 1 MONTH, INTERVAL 1 MONTH))::DATE AS period)
  SELECT period, count(*) FILTER (WHERE score <= 25) AS low, count(*) FILTER (WHERE score > 25 AND score <= 50) AS medium, count(*) FILTER (WHERE score > 50 AND score <= 75) AS high, count(*) FILTER (WHERE score > 75) AS critical FROM every LEFT JOIN b USING (period) GROUP BY period""")
def signal_trend(spark, folder):
    """Bids per month and band, without gaps in the months."""
    return portfolio.signal_trend(market.submissions(spark, folder), bidder_scores(spark, folder))
