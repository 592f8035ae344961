"""Queries of centrality, communities and groups, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidgraph.operators import features, graph, networks, pairs, signals, views
from bidgraph.plans.risk_queries import SETTINGS, all_pairs, core, counted, r4
from bidgraph.plans.risk_queries import communities as given_communities
from bidgraph.plans.sql import CTE, with_tables
from bidgraph.plans.storage import materialize

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

CTE |= {
    "u_ends": "SELECT a AS src, b AS dst, weight FROM undirected UNION ALL SELECT b, a, weight FROM undirected",
    "u_degree": "SELECT src AS id, count(*) AS neighbours, sum(weight) AS weighted_degree FROM u_ends GROUP BY src",
    "p_ends": "SELECT a AS src, b AS dst, weight FROM projection UNION ALL SELECT b, a, weight FROM projection",
    "cluster_met": "SELECT community, tender FROM facts JOIN community USING (company) GROUP BY community, tender HAVING count(*) > 1",
    "cluster_wins": "SELECT m.community, winner, count(*) AS wins FROM cluster_met m JOIN dim USING (tender) JOIN community w ON w.company = winner AND w.community = m.community GROUP BY 1, 2",
    "cluster_share": "SELECT *, sum(wins) OVER (PARTITION BY community) AS total FROM cluster_wins",
}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_tables(sql)
        return f

    return register


def links(spark, folder, parts=None, met=None):
    """The undirected graph of all nodes, not written."""
    rows, facts, dim = parts or core(spark, folder)
    return graph.undirected_of(rows, facts, counted(facts) if met is None else met)


def undirected(spark, folder, parts=None, met=None):
    return materialize(links(spark, folder, parts, met), "undirected")


def projection(spark, folder, parts=None, met=None):
    rows, facts, dim = parts or core(spark, folder)
    found = counted(facts) if met is None else met
    people, places = (pairs.attribute_pairs(graph.memberships(rows, k)) for k in ("person", "address"))
    return materialize(graph.company_projection(found, people, places), "projection")


def companies(facts):
    return facts.where("company IS NOT NULL").select(F.col("company").alias("id")).distinct()


def detected(spark, folder, parts, met=None):
    """(id, community) of all companies and the full company projection they were found in."""
    edges = projection(spark, folder, parts, met)
    return networks.memberships(companies(parts[1]), edges), edges


def whole_features(spark, folder, parts=None, measures=("pagerank", "eigenvector", "betweenness", "clustering")):
    """All features, with communities of the company projection and centrality in the graph of all nodes."""
    parts = parts or core(spark, folder)
    rows, facts, dim = parts
    met = counted(facts)
    member, edges = detected(spark, folder, parts, met)
    community = networks.company_communities(member, edges, facts, dim)
    centrality = networks.company_centrality(undirected(spark, folder, parts, met), companies(facts), measures)
    met = all_pairs(spark, folder, parts, member.withColumnRenamed("id", "company"), met)
    return materialize(features.company_features(rows, facts, dim, met, SETTINGS, centrality, community), "features")


def whole_signals(found, flags=None):
    """Signals of all features, with the cutoff of high centrality and what the data can tell."""
    cutoff = features.percentile_threshold(found, "degree_centrality", SETTINGS.high_degree_percentile).first()["cutoff"]
    return signals.company_signals(found, SETTINGS, flags, degree_cutoff=cutoff, clustered=True)


def whole_scores(spark, folder, parts=None):
    """Rule scores of all features; the signals read no other centrality than the degree."""
    return signals.score_companies(whole_signals(whole_features(spark, folder, parts, measures=())), SETTINGS)


def ego_seeds(rows):
    """(id): the companies whose id ends in 00, and of each node type the one with the smallest hash."""
    kinds = ("company", "person", "tender", "address", "department")
    nodes = [rows.select(F.lit(k).alias("kind"), F.col(k).alias("id")).where("id IS NOT NULL") for k in kinds]
    ids = nodes[0]
    for more in nodes[1:]:
        ids = ids.unionByName(more)
    one = ids.groupBy("kind").agg(F.min(F.struct(F.xxhash64("id").alias("h"), "id")).alias("m")).select("m.id")
    return ids.where("kind = 'company' AND id LIKE '%00'").select("id").unionByName(one).distinct()


def egos(spark, folder):
    rows, facts, dim = core(spark, folder)
    edges = materialize(graph.edges(rows, counted(facts), facts), "edges")
    return graph.ego_network(edges, materialize(ego_seeds(rows), "seeds"), depth=2)


def by_id(rows):
    return given_communities(rows).select(F.col("company").alias("id"), "community")


@query("SELECT id, neighbours, round(neighbours / ((SELECT count(*) FROM u_degree) - 1), 4) AS degree_centrality, round(weighted_degree, 4) AS weighted_degree FROM u_degree")
def degree_centrality(spark, folder):
    return networks.degrees(links(spark, folder)).select("id", "neighbours", r4("degree_centrality"), r4("weighted_degree"))


@query("""SELECT d.id, round(CASE WHEN d.n > 1 THEN 2 * coalesce(t, 0) / (d.n * (d.n - 1)) ELSE 0 END, 4)::DOUBLE AS clustering_coefficient
  FROM (SELECT src AS id, count(*) AS n FROM p_ends GROUP BY src) d LEFT JOIN (SELECT x.src AS id, count(*) AS t FROM p_ends x JOIN p_ends y ON x.src = y.src AND x.dst < y.dst JOIN projection e ON e.a = x.dst AND e.b = y.dst GROUP BY x.src) c ON d.id = c.id""")
def clustering_coefficient(spark, folder):
    return networks.clustering(projection(spark, folder)).select("id", r4("clustering_coefficient"))


@query()
def pagerank(spark, folder):
    return networks.pagerank(undirected(spark, folder))


def _chain(start: str, step: str, rounds: int) -> str:
    """Parts r0, r1, ... of a WITH clause; ``step`` makes one from the last, {0}."""
    return ", ".join([f"r0 AS ({start})"] + [f"r{k} AS ({step.format(f'r{k - 1}')})" for k in range(1, rounds + 1)])


ROUNDS = 5
_N = "(SELECT count(*) FROM u_degree)"


@query("WITH share AS MATERIALIZED (SELECT u.src, dst, weight / weighted_degree AS share FROM u_ends u JOIN u_degree d ON u.src = d.id), " + _chain(
    f"SELECT id, 1.0::DOUBLE / {_N} AS p FROM u_degree", f"SELECT d.id, 0.15 / {_N} + 0.85 * coalesce(got, 0) AS p FROM u_degree d LEFT JOIN (SELECT dst AS id, sum(p * share) AS got FROM {{0}} r JOIN share s ON r.id = s.src GROUP BY dst) g ON d.id = g.id", ROUNDS
) + f" SELECT id, round(p * 1000, 6) AS pagerank FROM r{ROUNDS}")
def pagerank_rounds(spark, folder):
    """Five rounds of PageRank, in thousandths."""
    return networks.pagerank(undirected(spark, folder), rounds=ROUNDS, tolerance=0.0).select("id", F.round(F.col("pagerank") * 1000, 6).alias("pagerank"))


@query("WITH ends AS MATERIALIZED (SELECT src, dst, weight FROM u_ends), " + _chain(
    f"SELECT id, 1.0::DOUBLE / {_N} AS v FROM u_degree", "SELECT id, raw / sqrt(sum(raw * raw) OVER ()) AS v FROM (SELECT r.id, r.v + coalesce(got, 0) AS raw FROM {0} r LEFT JOIN (SELECT dst AS id, sum(v * weight) AS got FROM {0} q JOIN ends e ON q.id = e.src GROUP BY dst) g ON r.id = g.id)", ROUNDS
) + f" SELECT id, round(abs(v) * 1000, 6) AS eigenvector_centrality FROM r{ROUNDS}")
def eigenvector_rounds(spark, folder):
    """Five rounds of the power iteration, in thousandths."""
    return networks.eigenvector(undirected(spark, folder), rounds=ROUNDS, tolerance=0.0).select("id", F.round(F.col("eigenvector_centrality") * 1000, 6).alias("eigenvector_centrality"))


@query()
def eigenvector_centrality(spark, folder):
    return networks.eigenvector(undirected(spark, folder))


@query()
def betweenness(spark, folder):
    return networks.betweenness(undirected(spark, folder))


@query()
def network_clustering(spark, folder):
    """Over the graph of all nodes; ``clustering_coefficient`` is over companies, as its SQL."""
    return networks.clustering(undirected(spark, folder))


@query("""SELECT x.id AS node, min(y.id) AS root FROM (SELECT src AS id, min(dst) AS m FROM p_ends GROUP BY src) x, (SELECT src AS id FROM p_ends) y GROUP BY x.id""")
def connected_components(spark, folder):
    """Of the company projection.  Companies that met, or share a person or address, hang together by the smallest of them, so their pairs are not made."""
    rows, facts, _ = core(spark, folder)
    bids = facts.where("company IS NOT NULL").select(F.col("tender").alias("attr"), "company")
    stars = [materialize(networks.attribute_stars(held), "stars") for held in (bids, graph.memberships(rows, "person"), graph.memberships(rows, "address"))]
    return networks.components(stars[0].unionByName(stars[1]).unionByName(stars[2]).distinct())


@query()
def communities(spark, folder):
    return detected(spark, folder, core(spark, folder))[0]


@query()
def dense_groups(spark, folder):
    return networks.dense_groups(projection(spark, folder))


@query("""SELECT c.community, c.size, round(CASE WHEN c.size > 1 THEN 2 * coalesce(m, 0) / (c.size * (c.size - 1)) ELSE 0 END, 4)::DOUBLE AS density FROM (SELECT community, count(*) AS size FROM community GROUP BY 1) c
  LEFT JOIN (SELECT x.community, count(*) AS m FROM projection JOIN community x ON x.company = a JOIN community y ON y.company = b AND x.community = y.community GROUP BY 1) i ON c.community = i.community""")
def community_density(spark, folder):
    parts = core(spark, folder)
    return networks.community_stats(by_id(parts[0]), projection(spark, folder, parts)).select("community", "size", r4("density"))


@query("""SELECT round(sum(inside) / sum(total) - sum(total * total) / (sum(total) * sum(total)), 4)::DOUBLE AS modularity FROM
  (SELECT x.community, sum(weight) AS total, sum(CASE WHEN x.community = y.community THEN weight ELSE 0 END) AS inside FROM p_ends JOIN community x ON x.company = src JOIN community y ON y.company = dst GROUP BY 1)""")
def modularity(spark, folder):
    parts = core(spark, folder)
    people, places = (graph.memberships(parts[0], k) for k in ("person", "address"))
    return networks.projection_modularity(materialize(by_id(parts[0]), "members"), counted(parts[1]), people, places).select(r4("modularity"))


@query("""SELECT t.community, t.n AS cluster_tenders, coalesce(captured, 0)::BIGINT AS captured, round(coalesce(captured / t.n, 0), 4)::DOUBLE AS capture, round(coalesce(concentration, 0), 4)::DOUBLE AS concentration,
  round(CASE WHEN winners > 1 THEN h / ln(winners) ELSE 0 END, 4)::DOUBLE AS entropy FROM (SELECT community, count(*) AS n FROM cluster_met GROUP BY 1) t
  LEFT JOIN (SELECT community, sum(wins) AS captured, max(wins) / sum(wins) AS concentration, sum(-(wins / total) * ln(wins / total)) AS h, count(*) AS winners FROM cluster_share GROUP BY 1) s ON t.community = s.community""")
def cluster_behaviour(spark, folder):
    rows, facts, dim = core(spark, folder)
    out = networks.cluster_behaviour(given_communities(rows), facts, dim)
    return out.select("community", "cluster_tenders", "captured", r4("capture"), r4("concentration"), r4("entropy"))


@query()
def ego_network(spark, folder):
    """Two hops, over all edge types, around the seeds of ``ego_seeds``."""
    return egos(spark, folder)[0]


@query()
def ego_edges(spark, folder):
    """The edges among the nodes of each ego network."""
    return egos(spark, folder)[1]


@query()
def network_features(spark, folder):
    """All 27 features; ``company_features`` has those of its SQL."""
    return whole_features(spark, folder)


@query()
def network_signals(spark, folder):
    rows = whole_signals(whole_features(spark, folder, measures=()))
    return rows.select("company", F.explode("signals").alias("s")).select("company", "s.*")


@query()
def network_scores(spark, folder):
    return whole_scores(spark, folder)


@query()
def network_signal_rollup(spark, folder):
    return signals.signal_rollup(whole_signals(whole_features(spark, folder, measures=())))


@query()
def network_ranking(spark, folder):
    return views.ranking(whole_scores(spark, folder), SETTINGS)


@query()
def network_profiles(spark, folder):
    parts = core(spark, folder)
    return views.company_profiles(parts[1], parts[2], whole_scores(spark, folder, parts))


@query()
def network_tender_scores(spark, folder):
    parts = core(spark, folder)
    rows = signals.tender_signals(features.tender_features(parts[1], parts[2]), SETTINGS)
    return signals.score_tenders(rows, parts[1], whole_scores(spark, folder, parts))


@query()
def network_pair_features(spark, folder):
    """Pair features with the communities of the company projection."""
    parts = core(spark, folder)
    return all_pairs(spark, folder, parts, detected(spark, folder, parts)[0].withColumnRenamed("id", "company"))


@query()
def network_community_density(spark, folder):
    return networks.community_stats(*detected(spark, folder, core(spark, folder)))


@query()
def network_modularity(spark, folder):
    return networks.modularity(*detected(spark, folder, core(spark, folder)))


@query()
def network_cluster_behaviour(spark, folder):
    parts = core(spark, folder)
    return networks.cluster_behaviour(detected(spark, folder, parts)[0].withColumnRenamed("id", "company"), parts[1], parts[2])
