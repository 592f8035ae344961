"""Queries over stores that several loads leave: a persisted graph, pairs kept up to date, fingerprints of buckets."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidgraph.operators import graph, incremental
from bidgraph.plans.risk_queries import core, core_and_nodes, counted, r4
from bidgraph.plans.sql import with_tables
from bidgraph.plans.storage import discard, materialize, new_path
from bidgraph.sources.store import Store, merged_attributes

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_tables(sql)
        return f

    return register


def persisted(spark, keys: list[str], loads):
    """The table that loads leave in a store; the last one comes twice."""
    store = Store(spark, new_path(spark, "graph"), keys)
    for number, rows in enumerate([*loads, loads[-1]]):
        load = materialize(rows, "load")
        store.commit(load, merged_attributes(keys), ("loads", min(number, len(loads) - 1)))
        store.tidy()
        discard(spark, load)
    return store.read()


@query("""SELECT id, node_type, CASE WHEN right(id, 1) < '4' OR node_type = 'Address' AND right(id, 1) <= '7' THEN 'was ' || display ELSE display END AS display, CASE WHEN right(id, 1) <= '7' THEN 1 END AS load FROM nodes""")
def persisted_nodes(spark, folder):
    """Nodes of two overlapping graphs: given attributes replace stored ones, absent ones stay; the later graph lacks the names of addresses."""
    nodes = core_and_nodes(spark, folder)[1]
    last = F.substring("id", -1, 1)
    earlier = nodes.where(last <= "7").withColumns({"display": F.concat(F.lit("was "), "display"), "load": F.lit(1)})
    later = nodes.where(last >= "4")
    unnamed = (F.col("node_type") == "Address") & (last <= "7")
    return persisted(spark, ["id"], [earlier, later.withColumn("display", F.when(~unnamed, F.col("display")))])


@query("SELECT src, dst, edge_type, CASE WHEN right(src, 1) < '4' THEN weight + 1 ELSE weight END AS weight FROM edges")
def persisted_edges(spark, folder):
    rows, facts, _ = core(spark, folder)
    edges = materialize(graph.edges(rows, counted(facts), facts), "edges")
    last = F.substring("src", -1, 1)
    return persisted(spark, ["src", "dst", "edge_type"], [edges.where(last <= "7").withColumn("weight", F.col("weight") + 1), edges.where(last >= "4")])


@query("SELECT company_a, company_b, shared_tenders, round(mean_price_gap, 4)::DOUBLE AS mean_price_gap FROM cobid")
def incremental_pairs(spark, folder):
    """Co-bid pairs after a first half of the bids, some with other amounts, is stored and the whole feed is applied to it."""
    facts = core(spark, folder)[1].select(*incremental.FACT)
    half = F.pmod(F.xxhash64("company", "tender"), F.lit(14))
    first = facts.where(half % 2 == 0).withColumn("bid_amount", F.when(half == 0, 2 * F.col("bid_amount")).otherwise(F.col("bid_amount")))
    held, counted = Store(spark, new_path(spark, "facts"), ["tender"]), Store(spark, new_path(spark, "pair-counts"), ["company_a", "company_b"])
    incremental.apply_feed(held, counted, first)
    incremental.apply_feed(held, counted, facts)
    return incremental.stored_pairs(counted).select("company_a", "company_b", "shared_tenders", r4("mean_price_gap"))


@query("""SELECT substr(md5(tender), 1, 2) AS bucket, count(*) AS rows, (sum(CAST('0x' || substr(md5(company || '|' || tender || '|' || coalesce(CAST(CAST(floor(bid_amount * 100 + 0.5) AS BIGINT) AS VARCHAR), '')), 1, 15) AS BIGINT)) % 1000000007)::BIGINT AS digest FROM facts GROUP BY 1""")
def bucket_fingerprints(spark, folder):
    """The fingerprint of each bucket of tenders, by which an unchanged bucket is known."""
    found = incremental.fingerprints(core(spark, folder)[1], F.substring(F.md5("tender"), 1, 2))
    return found.select("bucket", "rows", (F.col("digest") % 1_000_000_007).cast("long").alias("digest"))
