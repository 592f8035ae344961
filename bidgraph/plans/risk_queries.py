"""Queries of ingestion, identity, graph, features, signals and scores, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidgraph.functions import clean
from bidgraph.functions.ranks import numbered
from bidgraph.functions.settings import Settings
from bidgraph.operators import features, graph, identity, pairs, signals
from bidgraph.plans.sql import CLEAN, address_key, company_key, person_key, with_tables
from bidgraph.plans.storage import discard, materialize
from bidgraph.plans.tables import table
from bidgraph.sources import market

SETTINGS = Settings()
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, folder) -> DataFrame, with its SQL if there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_tables(sql)
        return f

    return register


def r4(name: str):
    return F.round(F.col(name), 4).alias(name)


def resolved(spark: SparkSession, folder: str) -> DataFrame:
    """Resolved bids.  The feed is read by the four identity indexes and the bids, so it is written once."""
    return identity.resolve(materialize(market.bid_feed(spark, folder), "feed"))


#: What queries read of the resolved bids; names and raw ids stay in the feed.
RESOLVED = ("company", "person", "department", "address", "tender", "tender_id", "bid_amount", "tender_value", "bid_date", "label", "result", "row_seq", "supplier", "l_orderkey")


def _facts_and_tenders(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return rows, materialize(graph.bid_facts(rows), "facts"), materialize(graph.tender_dim(rows), "tenders")


def core(spark: SparkSession, folder: str, feed: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Resolved bids, bid facts and tenders, each written once for the many joins over them; of ``feed``, if it is given."""
    written = materialize(market.bid_feed(spark, folder) if feed is None else feed, "feed")
    rows = materialize(identity.resolve(written).select(*RESOLVED), "resolved")
    discard(spark, written)
    return _facts_and_tenders(rows)


def core_and_nodes(spark: SparkSession, folder: str) -> tuple[tuple[DataFrame, DataFrame, DataFrame], DataFrame]:
    """``core`` and the nodes of the graph, out of one feed."""
    feed = materialize(market.bid_feed(spark, folder), "feed")
    rows = materialize(identity.resolve(feed).select(*RESOLVED), "resolved")
    nodes = materialize(graph.nodes(feed, rows), "nodes")
    discard(spark, feed)
    return _facts_and_tenders(rows), nodes


def communities(rows: DataFrame) -> DataFrame:
    """A given partition of the companies, by supplier number."""
    return rows.groupBy("company").agg(F.min_by(F.col("supplier") % 25, "row_seq").alias("community"))


def filed_documents(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    """Each bid files one of the documents, by order and supplier number."""
    docs = table(spark, folder, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    return graph.submitted_documents(_filing(docs, rows))


def _filing(docs: DataFrame, rows: DataFrame) -> DataFrame:
    n = docs.agg(F.count("*").alias("n")).first()["n"]
    spread = rows.withColumn("doc_id", (F.col("l_orderkey") * 31 + F.col("supplier")) % max(1, n))
    return spread.join(docs, "doc_id").withColumn("document_hashes", F.array("hash"))


def numbered_documents(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    """(company, tender, hash) of ``filed_documents`` with the smallest number of an equal document for its hash, which pairs need no more of."""
    docs = table(spark, folder, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    named = docs.groupBy("hash").agg(F.min("doc_id").cast("string").alias("name"))
    return graph.filed(_filing(materialize(docs.join(named, "hash").select("doc_id", F.col("name").alias("hash")), "documents"), rows))


def counted(facts: DataFrame) -> DataFrame:
    """Co-bid pairs, written once: the join of bidders on their tenders is the largest shuffle.

    It is made by numbers of the companies, in the order of their ids, which are a third as wide.
    """
    known = facts.where("company IS NOT NULL")
    names = materialize(numbered(known.select("company").distinct(), [F.col("company")], "n"), "names")
    bids = known.select("tender", "company", "bid_amount").join(names, "company").select("tender", F.col("n").alias("company"), "bid_amount")
    found = by_number = materialize(pairs.cobid_pairs(pairs.pair_rows(bids)), "pairs-by-number")
    for side in ("company_a", "company_b"):
        found = found.join(names.select(F.col("n").alias(side), F.col("company").alias(f"{side}_id")), side)
    found = found.select(F.col("company_a_id").alias("company_a"), F.col("company_b_id").alias("company_b"), "shared_tenders", "mean_price_gap")
    found = materialize(found, "counted")
    discard(facts.sparkSession, by_number)
    return found


def all_pairs(spark: SparkSession, folder: str, parts=None, membership: DataFrame | None = None, met: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    """Pair features; ``membership``: (company, community), the given partition if there is none; ``met``: pairs that are counted already; ``ends``: ``pairs.about``."""
    rows, facts, dim = parts or core(spark, folder)
    own = counted(facts) if met is None else met
    member = communities(rows) if membership is None else membership
    found = materialize(pairs.pair_features(rows, facts, dim, numbered_documents(spark, folder, rows), member, own, ends), "pairs")
    if met is None:
        discard(spark, own)
    return found


def all_features(spark: SparkSession, folder: str, parts=None) -> DataFrame:
    """The features that the SQL has; ``network_queries.whole_features`` has all."""
    parts = parts or core(spark, folder)
    return materialize(features.company_features(*parts, all_pairs(spark, folder, parts), SETTINGS), "features")


def scored(spark: SparkSession, folder: str, parts=None) -> DataFrame:
    return signals.score_companies(signals.company_signals(all_features(spark, folder, parts), SETTINGS), SETTINGS)


@query("""SELECT company_id, tender_id, bid_amount, bid_date, result = 'Awarded' AS is_winner, result = 'Rejected' AS is_known_loser, label FROM bids""")
def typed_bids(spark, folder):
    bids = market.bid_feed(spark, folder)
    return bids.select("company_id", "tender_id", "bid_amount", "bid_date", clean.is_winner(F.col("result")).alias("is_winner"), clean.is_known_loser(F.col("result")).alias("is_known_loser"), "label")


@query(f"""
  SELECT s_suppkey, {company_key(CLEAN.format("company_name"))} AS company_key, {address_key(CLEAN.format("address"))} AS address_key, {person_key(CLEAN.format("director_name"))} AS person_key,
    'C_' || substr(sha1({company_key(CLEAN.format("company_name"))}), 1, 12) AS company
  FROM (SELECT CAST(substr(bidder_id, 3) AS BIGINT) AS s_suppkey, company_name || ' Pvt. Ltd.' AS company_name, address, 'Dr. ' || director_name AS director_name FROM bidders)""")
def name_keys(spark, folder):
    b = market.bidders(spark, folder)
    cleaned = lambda c: clean.base_clean(clean.fold_accents(c))
    company = clean.company_key(cleaned(F.concat("company_name", F.lit(" Pvt. Ltd."))))
    return b.select(F.substring("bidder_id", 3, 20).cast("long").alias("s_suppkey"), company.alias("company_key"), clean.address_key(cleaned(F.col("address"))).alias("address_key"), clean.person_key(cleaned(F.concat(F.lit("Dr. "), "director_name"))).alias("person_key"), clean.stable_id("C", company).alias("company"))


@query(r"""SELECT bidder_id, regexp_matches(gst_number, '^\d{2}[A-Z]{5}\d{4}[A-Z][A-Z\d]Z[A-Z\d]$') AS gst_ok, regexp_matches(pan_number, '^[A-Z]{5}\d{4}[A-Z]$') AS pan_ok,
  CASE WHEN length(bank_account) <= 4 THEN bank_account ELSE 'XXXX XXXX ' || right(bank_account, 4) END AS account,
  CASE WHEN length(phone) <= 4 THEN phone ELSE left(phone, 2) || 'XXXXXX' || right(phone, 2) END AS phone,
  'PER-' || trim(regexp_replace(lower(trim(director_name)), '[^a-z0-9]+', '-', 'g'), '-') AS person_id FROM bidders""")
def bidder_formats(spark, folder):
    b = market.bidders(spark, folder)
    return b.select("bidder_id", clean.is_gst(F.col("gst_number")).alias("gst_ok"), clean.is_pan(F.col("pan_number")).alias("pan_ok"), clean.mask_account(F.col("bank_account")).alias("account"), clean.mask_phone(F.col("phone")).alias("phone"), clean.person_slug(F.col("director_name")).alias("person_id"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS fingerprint FROM documents")
def document_fingerprints(spark, folder):
    docs = table(spark, folder, "documents")
    encoded = F.concat(F.lit("data:text/plain;base64,"), F.regexp_replace(F.base64(F.encode(F.coalesce("text", F.lit("")), "UTF-8")), r"\s", ""))
    return docs.select("doc_id", clean.document_fingerprint(encoded).alias("fingerprint"))


@query("SELECT raw, canonical FROM company_map")
def company_aliases(spark, folder):
    return identity.raw_to_canonical(market.bid_feed(spark, folder), "company")


@query(" UNION ALL ".join(f"SELECT '{k}' AS kind, canonical, display, aliases FROM {k}_entity" for k in identity.KINDS))
def identity_index(spark, folder):
    return identity.identity_index(market.bid_feed(spark, folder))


@query("SELECT canonical, display, aliases FROM company_entity WHERE len(aliases) > 1")
def merged_identities(spark, folder):
    return identity.merged_groups(market.bid_feed(spark, folder), "company")


@query("""SELECT (SELECT count(*) FROM bids) AS records, (SELECT count(DISTINCT tender_id) FROM bids) AS tenders, (SELECT count(label) FROM bids) AS labelled_rows,
  (SELECT count(*) FROM company_entity) AS companies, (SELECT count(*) FROM person_entity) AS persons, (SELECT count(*) FROM address_entity) AS addresses,
  (SELECT count(*) FROM department_entity) AS departments, (SELECT count(*) FROM company_entity WHERE len(aliases) > 1) AS merged_identities,
  (SELECT count(*) FROM address_entity WHERE len(aliases) > 1) AS address_spelling_clusters""")
def dataset_summary(spark, folder):
    return identity.summary(market.bid_feed(spark, folder))


@query("""SELECT s_name || ' llp' AS key, canonical FROM supplier LEFT JOIN (SELECT lower(display) AS d, min(canonical) AS canonical FROM company_entity GROUP BY 1) ON lower(s_name || ' LLP') = d""")
def resolve_lookup(spark, folder):
    keys = table(spark, folder, "supplier").select(F.concat("s_name", F.lit(" llp")).alias("key"))
    return identity.resolve_keys(keys, market.bid_feed(spark, folder))


@query("SELECT company, tender, round(bid_amount, 4) AS bid_amount, is_winner, tender_value, bid_date, result FROM facts")
def bid_facts(spark, folder):
    return graph.bid_facts(resolved(spark, folder)).select("company", "tender", r4("bid_amount"), "is_winner", "tender_value", "bid_date", "result")


@query("SELECT tender, winner, department, tender_value FROM dim")
def tender_dimension(spark, folder):
    return graph.tender_dim(resolved(spark, folder)).drop("tender_seq")


@query("SELECT company, arg_max(label, row_seq) AS label FROM resolved WHERE label IS NOT NULL GROUP BY company")
def company_labels(spark, folder):
    return graph.company_labels(resolved(spark, folder))


@query("SELECT company, tender, hash FROM documents_of")
def submitted_documents(spark, folder):
    return filed_documents(spark, folder, resolved(spark, folder))


@query("SELECT id, node_type, display FROM nodes")
def graph_nodes(spark, folder):
    return core_and_nodes(spark, folder)[1]


def _edges(parts) -> DataFrame:
    rows, facts, dim = parts
    return graph.edges(rows, counted(facts), facts)


@query("SELECT src, dst, edge_type, weight FROM edges")
def graph_edges(spark, folder):
    return _edges(core(spark, folder))


@query("SELECT attr AS person, company FROM person_of WHERE attr IN (SELECT attr FROM person_of GROUP BY attr HAVING count(*) > 1)")
def ownership(spark, folder):
    return graph.ownership(resolved(spark, folder))


@query("SELECT attr, list(company ORDER BY company) AS companies FROM address_of GROUP BY attr HAVING count(*) > 1")
def shared_addresses(spark, folder):
    return graph.shared_groups(resolved(spark, folder), "address")


@query("SELECT a, b, weight FROM undirected")
def undirected_projection(spark, folder):
    rows, facts, _ = core(spark, folder)
    return graph.undirected_of(rows, facts, counted(facts))


@query("SELECT a, b, weight::DOUBLE AS weight FROM projection")
def company_projection(spark, folder):
    rows, facts, dim = core(spark, folder)
    return graph.company_projection(counted(facts), pairs.attribute_pairs(graph.memberships(rows, "person")), pairs.attribute_pairs(graph.memberships(rows, "address")))


@query("""SELECT node_type AS name, count(*) AS n FROM nodes GROUP BY 1 UNION ALL SELECT edge_type, count(*) FROM edges GROUP BY 1
  UNION ALL SELECT 'nodes', count(*) FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges""")
def graph_stats(spark, folder):
    parts, nodes = core_and_nodes(spark, folder)
    return graph.stats(nodes, _edges(parts))


@query("""SELECT src, dst, edge_type FROM edges LEFT JOIN nodes s ON src = s.id LEFT JOIN nodes d ON dst = d.id
  WHERE (edge_type, coalesce(s.node_type, ''), coalesce(d.node_type, '')) NOT IN (('DIRECTOR_OF','Person','Company'),('OWNS','Person','Company'),('BIDS_IN','Company','Tender'),('WINS','Company','Tender'),('REGISTERED_AT','Company','Address'),('ISSUED_BY','Tender','Department'),('CO_BID','Company','Company'))""")
def edge_schema_violations(spark, folder):
    parts, nodes = core_and_nodes(spark, folder)
    return graph.schema_violations(_edges(parts), nodes).select("src", "dst", "edge_type")


@query("""SELECT id, node_type AS type, display AS label, coalesce(n, 0) AS degree FROM nodes LEFT JOIN (SELECT v, count(*) AS n FROM (SELECT src AS v FROM edges UNION ALL SELECT dst FROM edges) GROUP BY v) ON id = v""")
def node_export(spark, folder):
    parts, nodes = core_and_nodes(spark, folder)
    return graph.node_export(nodes, _edges(parts))


_PAIR_COLUMNS = "company_a, company_b, shared_tenders, round(cobid_ratio, 4) AS cobid_ratio, round(mean_price_gap, 4) AS mean_price_gap, alternating_wins, shared_directors, shared_addresses, shared_document_hashes, same_community"


@query(f"SELECT {_PAIR_COLUMNS} FROM pairs")
def pair_features(spark, folder):
    return all_pairs(spark, folder).withColumns({c: F.round(c, 4) for c in ("cobid_ratio", "mean_price_gap")})


@query("SELECT tender, count(*) AS bidders FROM facts GROUP BY tender HAVING count(*) > 8")
def oversized_tenders(spark, folder):
    return pairs.oversized_tenders(graph.bid_facts(resolved(spark, folder)), limit=8)


@query("SELECT company_a, company_b, shared_tenders, shared_directors, shared_addresses, shared_document_hashes, alternating_wins, round(risk::DOUBLE, 3) AS risk FROM relations WHERE reasoned")
def relationship_risk(spark, folder):
    return pairs.relationship_risk(all_pairs(spark, folder), SETTINGS).select("company_a", "company_b", "shared_tenders", "shared_directors", "shared_addresses", "shared_document_hashes", "alternating_wins", "risk")


_TENDER_NUMBERS = ("bid_spread", "min_bid", "max_bid", "winning_bid", "tender_value", "winning_margin_vs_estimate", "mean_losing_margin", "losing_margin_std")


@query(f"SELECT tender, n_bidders, {', '.join(f'round({c}, 4) AS {c}' for c in _TENDER_NUMBERS)}, single_bidder, department, winner FROM tender_features")
def tender_features(spark, folder):
    _, facts, dim = core(spark, folder)
    return features.tender_features(facts, dim).withColumns({c: F.round(c, 4) for c in _TENDER_NUMBERS})


_COMPANY_NUMBERS = (
    "n_tenders", "n_wins", "win_rate", "shared_director_peers", "max_shared_directors", "shared_address_peers", "cobid_partners", "max_cobid_count", "top_partner_ratio",
    "mean_cobid_weight", "min_pair_price_gap", "mean_pair_price_gap", "complementary_bid_ratio", "bid_to_estimate_ratio", "bid_ratio_std", "department_concentration",
)


@query(f"SELECT company, {', '.join(f'round({c}::DOUBLE, 4) AS {c}' for c in _COMPANY_NUMBERS)}, solo_wins, document_peers FROM features")
def company_features(spark, folder):
    return all_features(spark, folder).select("company", *[r4(c) for c in _COMPANY_NUMBERS], "solo_wins", "document_peers")


@query("SELECT round(quantile_cont(cobid_partners, 0.95), 4)::DOUBLE AS cutoff FROM features")
def degree_cutoff(spark, folder):
    return features.percentile_threshold(all_features(spark, folder), "cobid_partners", SETTINGS.high_degree_percentile).select(r4("cutoff"))


@query("SELECT company, code, round(severity, 4)::DOUBLE AS severity, weight::DOUBLE AS weight FROM company_fired")
def company_signals(spark, folder):
    rows = signals.company_signals(all_features(spark, folder), SETTINGS)
    return rows.select("company", F.explode("signals").alias("s")).select("company", "s.code", F.round("s.severity", 4).alias("severity"), "s.weight")


@query("SELECT true AS has_persons, true AS has_addresses, true AS has_amounts, true AS has_winners FROM bids LIMIT 1")
def data_availability(spark, folder):
    return signals.availability(resolved(spark, folder))


@query("""SELECT company, round(rule_score, 4)::DOUBLE AS rule_score, round(risk_score, 2)::DOUBLE AS risk_score,
  CASE WHEN risk_score < 25 THEN 'LOW' WHEN risk_score < 50 THEN 'MEDIUM' WHEN risk_score < 75 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level, codes FROM scores""")
def company_scores(spark, folder):
    codes = F.array_sort(F.transform("signals", lambda s: s["code"])).alias("codes")
    return scored(spark, folder).select("company", r4("rule_score"), "risk_score", "risk_level", codes)


@query("SELECT code, count(DISTINCT company) AS companies, round(avg(severity), 3)::DOUBLE AS mean_severity FROM company_fired GROUP BY code")
def signal_rollup(spark, folder):
    return signals.signal_rollup(signals.company_signals(all_features(spark, folder), SETTINGS))


@query("SELECT tender, code, round(severity, 4)::DOUBLE AS severity FROM tender_fired")
def tender_signals(spark, folder):
    _, facts, dim = core(spark, folder)
    rows = signals.tender_signals(features.tender_features(facts, dim), SETTINGS)
    return rows.select("tender", F.explode("signals").alias("s")).select("tender", "s.code", F.round("s.severity", 4).alias("severity"))


@query("""SELECT t.tender, round(least(1, 0.55 * coalesce(own, 0) + 0.45 * coalesce(worst, 0) / 100) * 100, 2)::DOUBLE AS risk_score FROM tender_features t
  LEFT JOIN (SELECT tender, avg(severity) AS own FROM tender_fired GROUP BY tender) o ON t.tender = o.tender
  LEFT JOIN (SELECT tender, max(risk_score) AS worst FROM facts JOIN scores USING (company) GROUP BY tender) w ON t.tender = w.tender""")
def tender_scores(spark, folder):
    parts = core(spark, folder)
    rows = signals.tender_signals(features.tender_features(parts[1], parts[2]), SETTINGS)
    return signals.score_tenders(rows, parts[1], scored(spark, folder, parts)).select("tender", "risk_score")


@query()
def explanations(spark, folder):
    """Explanation texts and actions of every company; a verdict word in one fails the job."""
    from bidgraph.plans.network_queries import whole_scores

    s = whole_scores(spark, folder)
    text = signals.explanation(F.col("company"), F.col("risk_score"), F.col("risk_level"), F.col("signals"))
    bad = F.lower("explanation").rlike(r"\b(" + "|".join(signals.PROHIBITED_TERMS) + r")\b")
    rows = s.select("company", text.alias("explanation"), "actions")
    return rows.withColumn("explanation", F.when(bad, F.raise_error(F.lit("prohibited wording"))).otherwise(F.col("explanation")))
