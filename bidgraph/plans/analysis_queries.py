"""The full analysis in one job, and features, signals and scores of a given partition, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidgraph.functions import clean
from bidgraph.operators import casework, features, graph, identity, model, networks, pairs, signals, views
from bidgraph.plans import network_queries as N
from bidgraph.plans.risk_queries import SETTINGS, all_pairs, core, core_and_nodes, r4
from bidgraph.plans.risk_queries import communities as given_communities
from bidgraph.plans.sql import CTE, with_tables
from bidgraph.plans.storage import discard, materialize
from bidgraph.plans.tables import table
from bidgraph.sources import market

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Features that need no iteration, so that SQL has them too.
PARTITIONED = tuple(c for c in features.FEATURES if c not in ("pagerank", "eigenvector_centrality", "betweenness", "clustering_coefficient"))

CTE |= {
    "part_density": """
      SELECT c.community, c.size, CASE WHEN c.size > 1 THEN 2 * coalesce(m, 0) / (c.size * (c.size - 1)) ELSE 0 END AS density FROM (SELECT community, count(*) AS size FROM community GROUP BY 1) c
        LEFT JOIN (SELECT x.community, count(*) AS m FROM projection JOIN community x ON x.company = a JOIN community y ON y.company = b AND x.community = y.community GROUP BY 1) i ON c.community = i.community""",
    "part_met": "SELECT community, count(*) AS met FROM cluster_met GROUP BY 1",
    "part_won": "SELECT community, sum(wins) AS captured, max(wins) / sum(wins) AS concentration, sum(-(wins / total) * ln(wins / total)) AS h, count(*) AS winners FROM cluster_share GROUP BY 1",
    "part_features": """
      SELECT f.*, coalesce(CASE WHEN winners > 1 THEN h / ln(winners) ELSE 0 END, 0) AS cluster_rotation_entropy, coalesce(captured / met, 0) AS cluster_capture_rate, coalesce(concentration, 0) AS cluster_win_concentration,
        size AS community_size, density AS community_density, neighbours / ((SELECT count(*) FROM u_degree) - 1) AS degree_centrality, weighted_degree, coalesce(met, 0) AS cluster_tenders
      FROM features f JOIN community c USING (company) JOIN part_density d USING (community) LEFT JOIN part_met m USING (community) LEFT JOIN part_won w USING (community) JOIN u_degree u ON u.id = f.company""",
    "part_fired": """
      SELECT company, code, severity, weight FROM company_fired WHERE code <> 'MARKET_CONCENTRATION'
      UNION ALL SELECT company, 'MARKET_CONCENTRATION', least(1, greatest(cluster_win_concentration, department_concentration)), 0.6 FROM part_features WHERE n_tenders >= 3 AND (cluster_win_concentration >= 0.85 OR department_concentration >= 0.9)
      UNION ALL SELECT company, 'WINNER_ROTATION', least(1, 0.5 * cluster_rotation_entropy + 0.5 * cluster_capture_rate), 1.0 FROM part_features
        WHERE cluster_tenders >= 4 AND cluster_rotation_entropy >= 0.7 AND cluster_capture_rate >= 0.85 AND community_size <= 10
      UNION ALL SELECT company, 'HIGH_CENTRALITY', 0.5, 0.4 FROM part_features WHERE degree_centrality >= (SELECT quantile_cont(degree_centrality, 0.95) FROM part_features)
      UNION ALL SELECT company, 'DENSE_SUBGROUP', least(1, community_density), 0.7 FROM part_features WHERE community_size BETWEEN 3 AND 12 AND community_density >= 0.75""",
    "part_scores": """
      SELECT company, coalesce(rule_score, 0) AS rule_score, round(least(1, coalesce(rule_score, 0)) * 100, 2) AS risk_score, coalesce(codes, []) AS codes FROM part_features
        LEFT JOIN (SELECT company, sum(severity * weight) / 9.15 AS rule_score, list(code ORDER BY code) AS codes FROM part_fired GROUP BY company) USING (company)""",
}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_tables(sql)
        return f

    return register


def of_partition(spark, folder, parts=None, member=None, counted=None):
    """Features with the communities of a given partition (company, community) and the centrality that needs no iteration."""
    rows, facts, dim = parts or core(spark, folder)
    member, own = materialize(given_communities(rows) if member is None else member, "members"), N.counted(facts) if counted is None else counted
    ends = pairs.about(rows, facts, member)
    met = all_pairs(spark, folder, (rows, facts, dim), member, own, ends)
    ids = member.withColumnRenamed("company", "id")
    community = networks.company_communities(ids, None, facts, dim, networks.densities(ids, networks.linked_inside(ends, met)))
    centrality = networks.company_centrality(N.links(spark, folder, (rows, facts, dim), own), N.companies(facts), measures=())
    if counted is None:
        discard(spark, own)
    return materialize(features.company_features(rows, facts, dim, met, SETTINGS, centrality, community), "features")


@query("SELECT company, " + ", ".join(f"round({c}::DOUBLE, 4) AS {c}" for c in PARTITIONED) + ", cluster_tenders FROM part_features")
def partition_features(spark, folder):
    """23 of the 27 features, by a given partition; ``network_features`` has all, by detected communities."""
    return of_partition(spark, folder).select("company", *[r4(c) for c in PARTITIONED], "cluster_tenders")


@query("SELECT company, code, round(severity, 4)::DOUBLE AS severity, weight::DOUBLE AS weight FROM part_fired")
def partition_signals(spark, folder):
    rows = N.whole_signals(of_partition(spark, folder)).select("company", F.explode("signals").alias("s"))
    return rows.select("company", "s.code", F.round("s.severity", 4).alias("severity"), "s.weight")


@query()
def ringed_signals(spark, folder):
    """The signals of a market with bidding rings, each a community: rotation, repeated co-bidding, concentration and density fire on some companies."""
    parts = core(spark, folder, market.bid_feed(spark, folder, market.ringed(table(spark, folder, "lineitem"))))
    ring = F.when(F.col("supplier") < 80, F.floor(F.col("supplier") / 4)).otherwise(20)
    member = parts[0].groupBy("company").agg(F.min_by(ring, "row_seq").alias("community"))
    rows = N.whole_signals(of_partition(spark, folder, parts, member)).select("company", F.explode("signals").alias("s"))
    return rows.select("company", "s.code", F.round("s.severity", 4).alias("severity"), "s.weight")


ORACLE_SQL["ringed_signals"] = ORACLE_SQL["partition_signals"].replace("FROM lineitem JOIN supplier", f"FROM {market.RINGED} lineitem JOIN supplier").replace("arg_min(supplier % 25, row_seq)", "arg_min(CASE WHEN supplier < 80 THEN supplier // 4 ELSE 20 END, row_seq)")


@query("SELECT company, round(rule_score, 4)::DOUBLE AS rule_score, round(risk_score, 2)::DOUBLE AS risk_score, codes FROM part_scores")
def partition_scores(spark, folder):
    scored = signals.score_companies(N.whole_signals(of_partition(spark, folder)), SETTINGS)
    return scored.select("company", r4("rule_score"), "risk_score", F.array_sort(F.transform("signals", lambda s: s["code"])).alias("codes"))


def analyse(spark, folder) -> dict:
    """All tables of one analysis: each stage is written once and read by those after it.

    Identity, graph, communities and centrality give the features; flags of what the data can tell
    and the cutoff of high centrality go into the signals; the learnt probability, where there are
    labels, or else the anomaly score is blended in; tenders take the risk of their riskiest bidder.
    """
    parts = core(spark, folder)
    rows, facts, dim = parts
    counted = N.counted(facts)
    member, projection = N.detected(spark, folder, parts, counted)
    community = networks.company_communities(member, projection, facts, dim)
    centrality = networks.company_centrality(N.undirected(spark, folder, parts, counted), N.companies(facts))
    met = all_pairs(spark, folder, parts, member.withColumnRenamed("id", "company"), counted)
    found = materialize(features.company_features(rows, facts, dim, met, SETTINGS, centrality, community), "features")
    flags = signals.availability(rows).first().asDict()
    fired = materialize(N.whole_signals(found, flags), "signals")
    learnt = model.probabilities(found, graph.company_labels(rows), projection)
    mode = "model" if learnt is not None else "anomaly"
    probability = learnt if learnt is not None else model.anomaly_scores(found).withColumnRenamed("anomaly", "model_probability")
    companies = materialize(signals.score_companies(fired, SETTINGS, probability), "scores")
    tenders = signals.score_tenders(signals.tender_signals(features.tender_features(facts, dim), SETTINGS), facts, companies)
    return {
        "mode": mode, "features": found, "companies": companies, "tenders": tenders, "communities": member, "projection": projection, "relationships": pairs.relationship_risk(met, SETTINGS),
        "facts": facts, "dim": dim, "rollup": signals.signal_rollup(fired), "headline": views.headline(companies), "alerts": views.alerts(companies, tenders, SETTINGS.alert_threshold),
    }


@query()
def full_analysis(spark, folder):
    """Every company and tender with score, band, codes, explanation and actions, out of one analysis."""
    done = analyse(spark, folder)
    codes = F.transform("signals", lambda s: s["code"]).alias("codes")
    text = signals.explanation(F.col("company"), F.col("risk_score"), F.col("risk_level"), F.col("signals"))
    companies = done["companies"].select(F.lit("company").alias("entity_type"), F.col("company").alias("entity_id"), "risk_score", "risk_level", "model_probability", codes, text.alias("explanation"), "actions")
    nothing = F.lit(None).cast("string").alias("explanation")
    actions = signals.recommended_actions(F.col("signals"), F.col("risk_score"), SETTINGS).alias("actions")
    tenders = done["tenders"].select(F.lit("tender").alias("entity_type"), F.col("tender").alias("entity_id"), "risk_score", "risk_level", F.lit(None).cast("double").alias("model_probability"), codes, nothing, actions)
    return companies.unionByName(tenders)


def _section(name: str, rows, key, score) -> object:
    """(section, id, score, body): rows of one table of the analysis, with all their columns as JSON."""
    return rows.select(F.lit(name).alias("section"), key.cast("string").alias("id"), score.cast("double").alias("score"), F.to_json(F.struct(*rows.columns)).alias("body"))


@query()
def analysis_report(spark, folder):
    """What one analysis gives, in sections: headline, companies, tenders, relationships, communities, rollup and alerts."""
    done = analyse(spark, folder)
    counts = done["facts"].agg(F.count_distinct("company").alias("companies"), F.count_distinct("tender").alias("tenders"))
    head = done["headline"].withColumns({"risk_level": signals.risk_level(F.col("risk_score")), "mode": F.lit(done["mode"]), "one": F.lit(1)})
    text = views.overall_text(done["companies"], counts, done["mode"], SETTINGS).withColumn("one", F.lit(1))
    pair = F.concat_ws("|", "company_a", "company_b")
    sizes = done["communities"].groupBy("community").agg(F.count("*").alias("size"))
    parts = [
        _section("headline", head.join(text, "one").drop("one"), F.lit("analysis"), F.col("risk_score")), _section("company", done["companies"], F.col("company"), F.col("risk_score")), _section("tender", done["tenders"], F.col("tender"), F.col("risk_score")),
        _section("relationship", done["relationships"], pair, F.col("risk") * 100), _section("community", done["communities"].join(sizes, "community"), F.col("id"), F.col("size")), _section("rollup", done["rollup"], F.col("code"), F.col("companies")),
        _section("alert", done["alerts"], F.col("entity_id"), F.col("risk_score")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("""SELECT s.company, round(risk_score, 2)::DOUBLE AS risk_score, coalesce(directors, []) AS directors, coalesce(addresses, []) AS addresses, round(degree_centrality::DOUBLE, 4) AS degree_centrality FROM part_scores s JOIN part_features USING (company)
  LEFT JOIN (SELECT company, list_slice(list(display ORDER BY person), 1, 50) AS directors FROM (SELECT DISTINCT company, person FROM resolved WHERE person IS NOT NULL) JOIN person_entity ON person = canonical GROUP BY 1) USING (company)
  LEFT JOIN (SELECT company, list_slice(list(display ORDER BY addr), 1, 50) AS addresses FROM (SELECT DISTINCT company, addr FROM resolved WHERE addr IS NOT NULL) JOIN address_entity ON addr = canonical GROUP BY 1) USING (company)""")
def company_details(spark, folder):
    """Directors, addresses, score and features of each company, with the communities of the given partition."""
    parts, nodes = core_and_nodes(spark, folder)
    found = of_partition(spark, folder, parts)
    scores = signals.score_companies(N.whole_signals(found), SETTINGS)
    return views.company_details(parts[0], nodes, found, scores).select("company", "risk_score", "directors", "addresses", F.col("features.degree_centrality").alias("degree_centrality"))


@query("""SELECT t.tender, d.display AS department_name, w.display AS winner_name, n_bidders, round(bid_spread, 4) AS bid_spread, single_bidder, coalesce(codes, []) AS codes, floor(least(1, 0.55 * coalesce(own, 0) + 0.45 * coalesce(worst, 0) / 100) * 100 * 100 + 0.5) / 100 AS risk_score
  FROM tender_features t LEFT JOIN department_entity d ON d.canonical = t.department LEFT JOIN company_entity w ON w.canonical = t.winner
  LEFT JOIN (SELECT tender, avg(severity) AS own, list(code ORDER BY code) AS codes FROM tender_fired GROUP BY tender) o ON t.tender = o.tender
  LEFT JOIN (SELECT tender, max(risk_score) AS worst FROM facts JOIN part_scores USING (company) GROUP BY tender) r ON t.tender = r.tender""")
def tender_profiles(spark, folder):
    """Metrics, signals and score of each tender, by companies' scores with the communities of the given partition."""
    parts, nodes = core_and_nodes(spark, folder)
    scores = materialize(signals.score_companies(N.whole_signals(of_partition(spark, folder, parts)), SETTINGS), "scores")
    fired = materialize(signals.tender_signals(features.tender_features(parts[1], parts[2]), SETTINGS), "tender-signals")
    named = materialize(nodes.where("node_type IN ('Company', 'Department')"), "named")
    out = views.tender_profiles(fired, materialize(signals.score_tenders(fired, parts[1], scores).select("tender", "risk_score"), "tender-scores"), named, SETTINGS)
    return out.select("tender", "department_name", "winner_name", "n_bidders", r4("bid_spread"), "single_bidder", F.array_sort("codes").alias("codes"), "risk_score")


@query("SELECT key, CASE WHEN key IN (SELECT tender FROM facts) THEN key WHEN 'T_' || key IN (SELECT tender FROM facts) THEN 'T_' || key END AS tender FROM (SELECT (CASE o_orderkey % 3 WHEN 0 THEN 'T_T' WHEN 1 THEN 'T' ELSE 'X' END) || o_orderkey AS key FROM orders)")
def resolve_tender_lookup(spark, folder):
    """Tenders by node id, by the feed's id, and unknown ones."""
    o = F.col("o_orderkey")
    keys = table(spark, folder, "orders").select(F.concat(F.when(o % 3 == 0, "T_T").when(o % 3 == 1, "T").otherwise("X"), o.cast("string")).alias("key"))
    tenders = market.bid_feed(spark, folder).select(F.concat(F.lit("T_"), "tender_id").alias("tender")).distinct()
    return identity.resolve_tenders(keys, materialize(tenders, "tenders"))


@query("""SELECT doc_id, doc_id % 4 = 0 OR doc_id % 4 = 1 AS fits FROM documents""")
def document_signatures(spark, folder):
    """Whether the first bytes of an upload fit its extension: texts under three kinds of names, half of them behind the bytes of their kind."""
    docs, kind = table(spark, folder, "documents"), F.col("doc_id") % 4
    name = F.concat(F.lit("upload."), F.when(kind.isin(0, 2), "pdf").otherwise("docx"))
    head = F.when(kind == 0, "%PDF-").when(kind == 1, "PK").otherwise("text ")
    content = F.base64(F.encode(F.concat(head, F.coalesce("text", F.lit(""))), "UTF-8"))
    return docs.select("doc_id", clean.has_document_signature(name, F.regexp_replace(content, r"\s", "")).alias("fits"))


@query("SELECT tender AS id, 'Tender' AS node_type, [tender_id] AS aliases FROM (SELECT DISTINCT tender, tender_id FROM resolved)" + "".join(f" UNION ALL SELECT canonical, '{name}', aliases FROM {kind}_entity WHERE canonical IN (SELECT {column} FROM resolved)" for kind, name, column in (("company", "Company", "company"), ("person", "Person", "person"), ("department", "Department", "department"), ("address", "Address", "addr"))))
def node_aliases(spark, folder):
    return graph.node_aliases(market.bid_feed(spark, folder), core(spark, folder)[0])


_NUMBERED = "(SELECT id, node_type, row_number() OVER (ORDER BY id, node_type) - 1 AS node FROM nodes)"
_TYPES = f"list_position({list(graph.EDGE_SCHEMA)}, edge_type) - 1 AS type_code"


@query(f"""SELECT s.node AS src_node, d.node AS dst_node, {_TYPES}, weight FROM (SELECT src, dst, edge_type, weight FROM edges UNION ALL SELECT dst, src, edge_type, weight FROM edges) JOIN {_NUMBERED} s ON src = s.id JOIN {_NUMBERED} d ON dst = d.id""")
def encoded_directions(spark, folder):
    """Every edge by the numbers of its ends, in both directions."""
    (rows, facts, _), nodes = core_and_nodes(spark, folder)
    nodes = materialize(casework.encoded_nodes(nodes).select("id", "node"), "encoded")
    return casework.both_directions(materialize(casework.encoded_edges(graph.edges(rows, N.counted(facts), facts), nodes, tuple(graph.EDGE_SCHEMA)), "encoded-edges"))


_KINDS = ("Company", "Person", "Tender", "Address", "Department")


@query(f"""WITH degree AS (SELECT id, count(*) AS d FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id)
  SELECT n.id, node, list_concat(list_transform({list(_KINDS)}, lambda k: CAST(k = node_type AS INTEGER)::DOUBLE), CASE WHEN company IS NOT NULL THEN [{", ".join(f"round({c}::DOUBLE, 4)" for c in PARTITIONED)}]
    ELSE list_concat([round(coalesce(d, 0) / (SELECT max(d) FROM degree), 4)::DOUBLE], [{", ".join(["0.0::DOUBLE"] * (len(PARTITIONED) - 1))}]) END) AS x
  FROM {_NUMBERED} n LEFT JOIN degree g ON n.id = g.id LEFT JOIN part_features f ON f.company = n.id""")
def encoded_blocks(spark, folder):
    """Each node's type and block of features, by the features that SQL has too."""
    parts, nodes = core_and_nodes(spark, folder)
    nodes = materialize(casework.encoded_nodes(nodes), "encoded")
    counted = N.counted(parts[1])
    blocks = casework.node_blocks(nodes, graph.edges(parts[0], counted, parts[1]), of_partition(spark, folder, parts, counted=counted), PARTITIONED)
    return blocks.select("id", "node", F.transform("x", lambda v: F.round(v, 4)).alias("x"))
