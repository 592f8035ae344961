"""Graph tables from resolved bids: facts, tenders, nodes, edges, projections and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidgraph.functions.clean import is_winner
from bidgraph.operators.identity import entities
from bidgraph.plans.storage import materialize

#: Allowed end types of each edge type.
EDGE_SCHEMA = {
    "DIRECTOR_OF": ("Person", "Company"),
    "OWNS": ("Person", "Company"),
    "BIDS_IN": ("Company", "Tender"),
    "WINS": ("Company", "Tender"),
    "REGISTERED_AT": ("Company", "Address"),
    "ISSUED_BY": ("Tender", "Department"),
    "CO_BID": ("Company", "Company"),
}


def bid_facts(resolved: DataFrame) -> DataFrame:
    """One row per company and tender: lowest amount, any win, other fields of the first row."""
    won = is_winner(F.col("result"))
    return resolved.groupBy("company", "tender").agg(
        F.min("bid_amount").alias("bid_amount"),
        F.bool_or(won).alias("is_winner"),
        F.min_by("tender_value", "row_seq").alias("tender_value"),
        F.min_by("bid_date", "row_seq").alias("bid_date"),
        F.min_by("result", "row_seq").alias("result"),
        F.min("row_seq").alias("first_seq"),
    )


def tender_dim(resolved: DataFrame) -> DataFrame:
    """Winner and department of the last row that has one, last value, first sight."""
    won, seq = is_winner(F.col("result")), F.col("row_seq")
    last = lambda c, when: F.max_by(c, F.when(when, seq))  # noqa: E731  null orders are left out
    return resolved.groupBy("tender").agg(
        last("company", won & F.col("company").isNotNull()).alias("winner"),
        last("department", F.col("department").isNotNull()).alias("department"),
        last("tender_value", F.col("tender_value").isNotNull()).alias("tender_value"),
        F.min("row_seq").alias("tender_seq"),
    )


def company_labels(resolved: DataFrame) -> DataFrame:
    return resolved.where("label IS NOT NULL").groupBy("company").agg(F.max_by("label", "row_seq").alias("label"))


def filed(resolved: DataFrame, column: str = "document_hashes") -> DataFrame:
    """(company, tender, hash) of the filed documents, trimmed and in lower case; a row per bid."""
    hashes = resolved.select("company", "tender", F.explode(column).alias("h")).select("company", "tender", F.lower(F.trim("h")).alias("hash"))
    return hashes.where("hash <> ''")


def submitted_documents(resolved: DataFrame, column: str = "document_hashes") -> DataFrame:
    """Distinct (company, tender, hash) of the filed documents."""
    return filed(resolved, column).distinct()


def memberships(resolved: DataFrame, kind: str) -> DataFrame:
    """Distinct (attr, company) for kind person or address."""
    return resolved.where(F.col(kind).isNotNull() & F.col("company").isNotNull()).select(F.col(kind).alias("attr"), "company").distinct()


def shared_groups(resolved: DataFrame, kind: str) -> DataFrame:
    """(attr, companies) that two or more companies share."""
    grouped = memberships(resolved, kind).groupBy("attr").agg(F.array_sort(F.collect_set("company")).alias("companies"))
    return grouped.where(F.size("companies") > 1)


def nodes(bids: DataFrame, resolved: DataFrame) -> DataFrame:
    """(id, node_type, display) of the five types."""
    out = resolved.select(F.col("tender").alias("id"), F.lit("Tender").alias("node_type"), F.col("tender_id").alias("display")).distinct()
    for kind, name in (("company", "Company"), ("person", "Person"), ("department", "Department"), ("address", "Address")):
        used = resolved.where(F.col(kind).isNotNull()).select(F.col(kind).alias("id")).distinct()
        named = entities(bids, kind).select(F.col("canonical").alias("id"), "display")
        out = out.unionByName(used.join(named, "id", "left").select("id", F.lit(name).alias("node_type"), "display"))
    return out


def node_aliases(bids: DataFrame, resolved: DataFrame) -> DataFrame:
    """(id, node_type, aliases): the feed's ids and spellings of each node, in the order in which they were first seen."""
    out = resolved.select(F.col("tender").alias("id"), F.lit("Tender").alias("node_type"), F.array("tender_id").alias("aliases")).distinct()
    for kind, name in (("company", "Company"), ("person", "Person"), ("department", "Department"), ("address", "Address")):
        used = resolved.where(F.col(kind).isNotNull()).select(F.col(kind).alias("id")).distinct()
        out = out.unionByName(used.join(entities(bids, kind).select(F.col("canonical").alias("id"), "aliases"), "id").select("id", F.lit(name).alias("node_type"), "aliases"))
    return out


def ownership(resolved: DataFrame) -> DataFrame:
    """(person, company) of persons tied to two or more companies."""
    held = memberships(resolved, "person")
    many = held.groupBy("attr").agg(F.count("*").alias("n")).where("n > 1").select("attr")
    return held.join(many, "attr").select(F.col("attr").alias("person"), "company")


def edges(resolved: DataFrame, pairs: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(src, dst, edge_type, weight); CO_BID edges carry the number of shared tenders.

    ``facts`` are the bid facts of ``resolved``: they have a row per company and tender, so bids and
    wins are read off them and not made distinct again.
    """

    def plain(df: DataFrame, src: str, dst: str, kind: str, once: bool = False) -> DataFrame:
        some = df.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(src).alias("src"), F.col(dst).alias("dst"))
        return (some if once else some.distinct()).select("src", "dst", F.lit(kind).alias("edge_type"), F.lit(1.0).alias("weight"))

    own = (resolved, resolved.where(is_winner(F.col("result")))) if facts is None else (facts, facts.where("is_winner"))
    parts = [
        *[plain(bids, "company", "tender", kind, facts is not None) for bids, kind in zip(own, ("BIDS_IN", "WINS"))],
        plain(resolved, "person", "company", "DIRECTOR_OF"),
        plain(ownership(resolved), "person", "company", "OWNS"),
        plain(resolved, "company", "address", "REGISTERED_AT"),
        plain(resolved, "tender", "department", "ISSUED_BY"),
        pairs.select(F.col("company_a").alias("src"), F.col("company_b").alias("dst"), F.lit("CO_BID").alias("edge_type"), F.col("shared_tenders").cast("double").alias("weight")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def schema_violations(edge_table: DataFrame, node_table: DataFrame) -> DataFrame:
    """Edges whose ends have no node or another type than the schema allows."""
    kinds = node_table.select("id", "node_type")
    typed = edge_table.join(kinds.select(F.col("id").alias("src"), F.col("node_type").alias("src_type")), "src", "left")
    typed = typed.join(kinds.select(F.col("id").alias("dst"), F.col("node_type").alias("dst_type")), "dst", "left")
    fine = F.lit(False)
    for kind, (a, b) in EDGE_SCHEMA.items():
        fine = fine | ((F.col("edge_type") == kind) & F.coalesce((F.col("src_type") == a) & (F.col("dst_type") == b), F.lit(False)))
    return typed.where(~fine)


def undirected(edge_table: DataFrame) -> DataFrame:
    """(a, b, weight): parallel edges of a node pair summed."""
    return edge_table.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("weight").alias("weight"))


def undirected_of(resolved: DataFrame, facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """What ``undirected`` makes of ``edges``, from the tables themselves.

    Only a bid that won and a person that owns have a parallel edge, and both are known where their
    edge is, so bids and pairs, nearly all of the edges, are not shuffled to be summed.
    """
    held = memberships(resolved, "person")
    owns = held.groupBy("attr").agg((F.count("*") > 1).alias("owns"))
    bids = facts.where("company IS NOT NULL AND tender IS NOT NULL")
    parts = [
        bids.select(F.col("company").alias("src"), F.col("tender").alias("dst"), F.when(F.col("is_winner"), 2.0).otherwise(1.0).alias("weight")),
        held.join(owns, "attr").select(F.col("attr").alias("src"), F.col("company").alias("dst"), F.when(F.col("owns"), 2.0).otherwise(1.0).alias("weight")),
        memberships(resolved, "address").select(F.col("company").alias("src"), F.col("attr").alias("dst"), F.lit(1.0).alias("weight")),
        resolved.where("tender IS NOT NULL AND department IS NOT NULL").select(F.col("tender").alias("src"), F.col("department").alias("dst")).distinct().withColumn("weight", F.lit(1.0)),
        pairs.select(F.col("company_a").alias("src"), F.col("company_b").alias("dst"), F.col("shared_tenders").cast("double").alias("weight")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "weight")


def company_projection(pairs: DataFrame, person_pairs: DataFrame, address_pairs: DataFrame) -> DataFrame:
    """(a, b, weight): shared tenders, 2 per shared person, 1.5 per shared address."""
    parts = pairs.select(F.col("company_a").alias("a"), F.col("company_b").alias("b"), F.col("shared_tenders").cast("double").alias("w"))
    parts = parts.unionByName(person_pairs.select("a", "b", (F.col("shared") * 2.0).alias("w"))).unionByName(address_pairs.select("a", "b", (F.col("shared") * 1.5).alias("w")))
    return parts.groupBy("a", "b").agg(F.sum("w").alias("weight"))


def stats(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """(name, n): totals and counts per type."""
    n = node_table.groupBy(F.col("node_type").alias("name")).count().unionByName(edge_table.groupBy(F.col("edge_type").alias("name")).count())
    totals = node_table.agg(F.lit("nodes").alias("name"), F.count("*").alias("count")).unionByName(edge_table.agg(F.lit("edges").alias("name"), F.count("*").alias("count")))
    return n.unionByName(totals).withColumnRenamed("count", "n")


def ego_network(edge_table: DataFrame, seeds: DataFrame, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """(seed, id, hops) within ``depth`` of each seed, and the induced edges (seed, src, dst, edge_type, weight)."""
    around = edge_table.select("src", "dst").unionByName(edge_table.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    reached = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("hops")).distinct()
    frontier = reached
    for hop in range(1, depth + 1):
        step = frontier.join(around, F.col("id") == F.col("src")).select("seed", F.col("dst").alias("id")).distinct()
        frontier = materialize(step.join(reached.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("hops", F.lit(hop)), "frontier")
        reached = reached.unionByName(frontier)
    inside = reached.select("seed", F.col("id").alias("src"))
    induced = edge_table.join(inside, "src").join(reached.select("seed", F.col("id").alias("dst")), ["seed", "dst"])
    return reached, induced.select("seed", "src", "dst", "edge_type", "weight")


def node_export(node_table: DataFrame, edge_table: DataFrame, limit: int | None = None) -> DataFrame:
    """(id, type, label, degree), parallel edges counted; of more than ``limit`` nodes those of the largest degree."""
    ends = edge_table.select(F.col("src").alias("id")).unionByName(edge_table.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count("*").alias("degree"))
    out = node_table.join(ends, "id", "left").select("id", F.col("node_type").alias("type"), F.col("display").alias("label"), F.coalesce("degree", F.lit(0)).alias("degree"))
    return out if limit is None else out.orderBy(F.desc("degree"), "id").limit(limit)


def edge_export(edge_table: DataFrame, limit: int | None = None) -> DataFrame:
    """(src, dst, edge_type, weight); of more than ``limit`` edges those of the largest weight."""
    return edge_table if limit is None else edge_table.orderBy(F.desc("weight"), "src", "dst", "edge_type").limit(limit)
