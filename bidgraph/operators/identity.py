"""Entity resolution: spellings of companies, persons, addresses and departments to stable ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidgraph.functions.clean import address_key, base_clean, company_key, fold_accents, person_key, stable_id
from bidgraph.plans.storage import materialize

#: kind: raw id column, raw name column, id prefix, key function.
KINDS = {
    "company": ("company_id", "company_name", "C", company_key),
    "person": ("person_id", "person_name", "P", person_key),
    "department": ("department_id", "department_name", "D", company_key),
    "address": ("address", "address", "A", address_key),
}


def canonical(raw_id: Column, raw_name: Column, prefix: str, key: Column) -> tuple[Column, Column]:
    """(id, display): by name key if there is one, else by the raw id."""
    named = F.coalesce(key != "", F.lit(False))
    given = F.coalesce(F.trim(raw_id) != "", F.lit(False))
    ident = F.when(named, stable_id(prefix, key)).when(given, F.concat(F.lit(f"{prefix}_"), raw_id))
    return ident, F.when(named, F.trim(raw_name)).when(given, raw_id)


def observations(bids: DataFrame, kind: str) -> DataFrame:
    """(raw, canonical, display, first_seq, last_seq) per distinct raw id and name.

    Keys are computed on distinct spellings, not on every bid.  The spellings are written, as the
    planner would else move the condition on the ids, and the keys with it, below the grouping.
    """
    raw, name, prefix, key = KINDS[kind]
    spelt = materialize(bids.groupBy(F.col(raw).alias("raw"), F.col(name).alias("name")).agg(F.min("row_seq").alias("first_seq"), F.max("row_seq").alias("last_seq")), "spellings")
    keyed = spelt.withColumn("key", key(base_clean(fold_accents(F.col("name")))))
    ident, display = canonical(F.col("raw"), F.col("name"), prefix, F.col("key"))
    out = keyed.select("raw", ident.alias("canonical"), display.alias("display"), "first_seq", "last_seq")
    return out.where("canonical IS NOT NULL AND raw IS NOT NULL")


def raw_to_canonical(bids: DataFrame, kind: str) -> DataFrame:
    """(raw, canonical): the last row of a raw id decides."""
    return observations(bids, kind).groupBy("raw").agg(F.max_by("canonical", "last_seq").alias("canonical"))


def entities(bids: DataFrame, kind: str) -> DataFrame:
    """(canonical, display, aliases): first display, raw ids in first-seen order."""
    seen = observations(bids, kind)
    firsts = seen.groupBy("canonical", "raw").agg(F.min("first_seq").alias("seq"), F.min_by("display", "first_seq").alias("display"))
    grouped = firsts.groupBy("canonical").agg(F.min_by("display", "seq").alias("display"), F.array_sort(F.collect_list(F.struct("seq", "raw"))).alias("seen"))
    return grouped.select("canonical", "display", F.transform("seen", lambda s: s["raw"]).alias("aliases"))


def merged_groups(bids: DataFrame, kind: str) -> DataFrame:
    return entities(bids, kind).where(F.size("aliases") > 1)


def identity_index(bids: DataFrame) -> DataFrame:
    """(kind, canonical, display, aliases) of all kinds."""
    out = None
    for kind in KINDS:
        part = entities(bids, kind).select(F.lit(kind).alias("kind"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def resolve(bids: DataFrame) -> DataFrame:
    """Bids with company, person, department and address nodes, and the tender node.

    The ids of a kind are written, so that the planner knows how few they are: bids that share one of
    a handful of departments are not dealt out by it.
    """
    out = bids
    for kind, (raw, *_rest) in KINDS.items():
        found = materialize(raw_to_canonical(bids, kind).select(F.col("raw").alias(f"{kind}_raw"), F.col("canonical").alias(f"{kind}_node")), f"{kind}-ids")
        out = out.join(found, F.col(raw) == F.col(f"{kind}_raw"), "left").drop(f"{kind}_raw")
    kept = [c for c in bids.columns if c not in KINDS]
    return out.select(*kept, *[F.col(f"{kind}_node").alias(kind) for kind in KINDS], F.concat(F.lit("T_"), "tender_id").alias("tender"))


def resolve_keys(keys: DataFrame, bids: DataFrame) -> DataFrame:
    """(key, canonical) of company lookups: exact node id, then alias, then display in any case."""
    nodes = entities(bids, "company")
    by_id = nodes.select(F.col("canonical").alias("id_key"), F.col("canonical").alias("by_id"))
    by_alias = raw_to_canonical(bids, "company").select(F.col("raw").alias("alias_key"), F.col("canonical").alias("by_alias"))
    by_name = nodes.groupBy(F.lower("display").alias("name_key")).agg(F.min("canonical").alias("by_name"))
    joined = keys.join(by_id, F.col("key") == F.col("id_key"), "left").join(by_alias, F.col("key") == F.col("alias_key"), "left").join(by_name, F.lower("key") == F.col("name_key"), "left")
    return joined.select("key", F.coalesce("by_id", "by_alias", "by_name").alias("canonical"))


def resolve_tenders(keys: DataFrame, tenders: DataFrame) -> DataFrame:
    """(key, tender) of tender lookups: a node id of ``tenders`` (tender), or what is one after ``T_``."""
    known = tenders.select("tender").distinct()
    rows = keys.select("key").join(known.select(F.col("tender").alias("as_given")), F.col("key") == F.col("as_given"), "left")
    rows = rows.join(known.select(F.col("tender").alias("as_id")), F.concat(F.lit("T_"), "key") == F.col("as_id"), "left")
    return rows.select("key", F.coalesce("as_given", "as_id").alias("tender"))


def summary(bids: DataFrame) -> DataFrame:
    """Counts of records, canonical entities, merged identities and address spellings."""
    per = identity_index(bids).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.size("aliases") > 1).alias("merged"))
    counts = per.agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(n) for k, n in (("company", "companies"), ("person", "persons"), ("address", "addresses"), ("department", "departments"))], F.coalesce(F.sum(F.when(F.col("kind") == "company", F.col("merged"))), F.lit(0)).alias("merged_identities"), F.coalesce(F.sum(F.when(F.col("kind") == "address", F.col("merged"))), F.lit(0)).alias("address_spelling_clusters"))
    totals = bids.agg(F.count("*").alias("records"), F.count_distinct("tender_id").alias("tenders"), F.count("label").alias("labelled_rows"))
    one = F.lit(1).alias("one")
    return totals.select(one, "*").join(counts.select(one, "*"), "one").drop("one")
