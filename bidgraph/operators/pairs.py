"""Company pairs: shared tenders, prices, wins, officers, addresses and documents.

The self-join on the tender is the largest shuffle of the library and is done once.  It carries the
amounts alone and its rows are summed before the exchange by pair.  The order of wins needs no pairs
of bidders: a tender's winner meets each of its other bidders, which is a row per lost bid.  Adaptive
execution splits tenders with very many bidders; ``oversized_tenders`` reports them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidgraph.operators.graph import memberships
from bidgraph.plans.storage import materialize


def pair_rows(facts: DataFrame) -> DataFrame:
    """One row per tender and unordered company pair in it, with the price gap."""
    a = facts.select("tender", F.col("company").alias("company_a"), F.col("bid_amount").alias("amount_a"))
    b = facts.select("tender", F.col("company").alias("company_b"), F.col("bid_amount").alias("amount_b"))
    rows = a.join(b, (a.tender == b.tender) & (a.company_a < b.company_b)).drop(b.tender)
    base = F.greatest(F.abs("amount_a"), F.abs("amount_b"))
    known = F.col("amount_a").isNotNull() & F.col("amount_b").isNotNull() & (base != 0)
    return rows.select("tender", "company_a", "company_b", F.when(known, F.abs(F.col("amount_a") - F.col("amount_b")) / base).alias("gap"))


def oversized_tenders(facts: DataFrame, limit: int = 3000) -> DataFrame:
    """(tender, bidders) of tenders with more than ``limit`` bidders; they are not left out of pairs."""
    return facts.groupBy("tender").agg(F.count("*").alias("bidders")).where(F.col("bidders") > limit)


def cobid_pairs(rows: DataFrame) -> DataFrame:
    """(company_a, company_b, shared_tenders, mean_price_gap)."""
    return rows.groupBy("company_a", "company_b").agg(F.count("*").alias("shared_tenders"), F.avg("gap").alias("mean_price_gap"))


def tender_lists(facts: DataFrame, dim: DataFrame, length: int = 1000) -> DataFrame:
    """(company_a, company_b, part, tenders): the tenders of a pair in the order in which they were first seen, ``length`` to a part.

    Rows of a pair are ordered inside its exchange, where they spill, and no list is longer than a part.
    """
    seen = facts.select("tender", "company").join(dim.select("tender", "tender_seq"), "tender")
    a, b = seen.withColumnRenamed("company", "company_a"), seen.select(F.col("tender").alias("tender_b"), F.col("company").alias("company_b"))
    rows = a.join(b, (F.col("tender") == F.col("tender_b")) & (F.col("company_a") < F.col("company_b"))).select("company_a", "company_b", "tender_seq", "tender")
    place = F.row_number().over(W.partitionBy("company_a", "company_b").orderBy("tender_seq", "tender")) - 1
    placed = rows.select("company_a", "company_b", "tender", place.alias("place")).withColumn("part", F.floor(F.col("place") / length))
    return placed.groupBy("company_a", "company_b", "part").agg(F.array_sort(F.collect_list(F.struct("place", "tender"))).alias("list")).select("company_a", "company_b", "part", F.col("list.tender").alias("tenders"))


def alternating_wins(facts: DataFrame, dim: DataFrame) -> DataFrame:
    """(company_a, company_b, alternating_wins): changes of winner, in feed order, over tenders won by either."""
    lost = facts.select("tender", "company").join(dim.where("winner IS NOT NULL").select("tender", "winner", "tender_seq"), "tender").where("company <> winner")
    won = lost.select(F.least("company", "winner").alias("company_a"), F.greatest("company", "winner").alias("company_b"), "winner", "tender_seq")
    before = F.lag("winner").over(W.partitionBy("company_a", "company_b").orderBy("tender_seq"))
    return won.withColumn("before", before).groupBy("company_a", "company_b").agg(F.count_if(F.col("before") != F.col("winner")).alias("alternating_wins"))


def attribute_pairs(members: DataFrame) -> DataFrame:
    """(a, b, shared): companies with common attributes, from (attr, company)."""
    a = members.select("attr", F.col("company").alias("a"))
    b = members.select(F.col("attr").alias("attr_b"), F.col("company").alias("b"))
    return a.join(b, (F.col("attr") == F.col("attr_b")) & (F.col("a") < F.col("b"))).groupBy("a", "b").agg(F.count("*").alias("shared"))


def shared_sets(resolved: DataFrame, kind: str) -> DataFrame:
    """(company, attrs): the sorted persons or addresses of a company that another company has too."""
    held = memberships(resolved, kind)
    many = held.groupBy("attr").agg(F.count("*").alias("n")).where("n > 1").select("attr")
    return held.join(many, "attr").groupBy("company").agg(F.array_sort(F.collect_set("attr")).alias("attrs"))


def attribute_peers(sets: DataFrame) -> DataFrame:
    """(company, peers, max_shared) of (company, attrs): other companies with a common attribute, and the most shared with one.

    Companies of equal sets are one class, and classes are paired, so an attribute that very many
    companies have costs a row per class.
    """
    classes = materialize(sets.groupBy("attrs").agg(F.min("company").alias("class"), F.count("*").alias("size")), "classes")
    held = classes.select("class", "size", F.explode("attrs").alias("attr"))
    met = held.join(held.select(F.col("class").alias("other"), F.col("size").alias("others"), F.col("attr").alias("b")), (F.col("attr") == F.col("b")) & (F.col("class") != F.col("other")))
    per = met.groupBy("class", "other").agg(F.first("others").alias("others"), F.count("*").alias("shared")).groupBy("class").agg(F.sum("others").alias("others"), F.max("shared").alias("shared"))
    own = F.when(F.col("size") > 1, F.size("attrs")).otherwise(0)
    found = classes.join(per, "class", "left").select("attrs", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("peers"), F.greatest(F.coalesce("shared", F.lit(0)), own).cast("long").alias("max_shared"))
    return sets.join(materialize(found, "class-peers"), "attrs").select("company", "peers", "max_shared")


def document_pairs(documents: DataFrame) -> DataFrame:
    """(a, b, shared): distinct hashes that both filed in the same tender; only what two companies filed there is paired."""
    twice = documents.groupBy("tender", "hash").agg(F.min("company").alias("lo"), F.max("company").alias("hi")).where("lo < hi").select("tender", "hash")
    held = materialize(documents.join(materialize(twice, "filed-twice"), ["tender", "hash"]).select("tender", "hash", "company").distinct(), "filed")
    a = held.select("tender", "hash", F.col("company").alias("a"))
    b = held.select(F.col("tender").alias("tender_b"), F.col("hash").alias("hash_b"), F.col("company").alias("b"))
    both = a.join(b, (F.col("tender") == F.col("tender_b")) & (F.col("hash") == F.col("hash_b")) & (F.col("a") < F.col("b")))
    return both.groupBy("a", "b").agg(F.count_distinct("hash").alias("shared"))


def about(resolved: DataFrame, facts: DataFrame, membership: DataFrame | None = None) -> DataFrame:
    """(company, n, persons, addresses, community): a row per company with all that a pair looks up about its ends."""
    out = facts.where("company IS NOT NULL").groupBy("company").agg(F.count("*").alias("n"))
    for kind, name in (("person", "persons"), ("address", "addresses")):
        sets = shared_sets(resolved, kind).withColumnRenamed("attrs", name)
        out = out.join(sets, "company", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    if membership is None:
        return materialize(out.withColumn("community", F.lit(None).cast("string")), "about")
    return materialize(out.join(membership.select("company", "community"), "company", "left"), "about")


def pair_features(resolved: DataFrame, facts: DataFrame, dim: DataFrame, documents: DataFrame | None = None, membership: DataFrame | None = None, met: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    """The ten pair features of every pair that met in a tender.

    ``met`` are their ``cobid_pairs`` and ``ends`` the companies' ``about``, if they are there
    already.  What two companies share is looked up for pairs that met, so companies that share an
    attribute are never paired with each other for it.
    """
    met = cobid_pairs(pair_rows(facts)) if met is None else met
    ends = about(resolved, facts, membership) if ends is None else ends
    turns = materialize(alternating_wins(facts, dim).where("alternating_wins > 0"), "turns")
    out = met.join(turns, ["company_a", "company_b"], "left")
    if documents is not None:
        filed = document_pairs(documents).select(F.col("a").alias("company_a"), F.col("b").alias("company_b"), F.col("shared").alias("shared_document_hashes"))
        out = out.join(materialize(filed, "filed-pairs"), ["company_a", "company_b"], "left")
    else:
        out = out.withColumn("shared_document_hashes", F.lit(0).cast("long"))
    for side in ("a", "b"):
        out = out.join(ends.select(F.col("company").alias(f"company_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in ("n", "persons", "addresses", "community")]), f"company_{side}")
    both = lambda name: F.size(F.array_intersect(f"{name}_a", f"{name}_b")).cast("long")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        "company_a", "company_b", "shared_tenders", (F.col("shared_tenders") / F.greatest(F.least("n_a", "n_b"), F.lit(1))).alias("cobid_ratio"), "mean_price_gap",
        zero("alternating_wins"), both("persons").alias("shared_directors"), both("addresses").alias("shared_addresses"), zero("shared_document_hashes"), F.coalesce(F.col("community_a") == F.col("community_b"), F.lit(False)).alias("same_community"),
    )


def relationship_risk(pairs: DataFrame, settings) -> DataFrame:
    """Pairs with a reason to look at them: risk 0 to 1 and the reasons."""
    c, s = F.col, settings
    close = (c("mean_price_gap") <= s.bid_similarity_pct) & (c("shared_tenders") >= s.min_cobid_events)
    terms = [
        (c("shared_directors") > 0, F.lit(0.35), F.concat_ws(" ", "shared_directors", F.lit("shared director(s)"))),
        (c("shared_addresses") > 0, F.lit(0.25), F.concat_ws(" ", "shared_addresses", F.lit("shared address(es)"))),
        (c("shared_tenders") >= s.min_cobid_events, 0.2 + F.least(F.lit(0.15), 0.02 * c("shared_tenders")), F.concat(F.lit("co-bid in "), "shared_tenders", F.lit(" tenders"))),
        (F.coalesce(close, F.lit(False)), F.lit(0.3), F.lit("close bid prices")),
        (c("shared_document_hashes") > 0, F.lit(0.45), F.lit("identical bid documents")),
        (c("alternating_wins") >= 3, F.lit(0.2), F.concat(F.lit("alternating wins x"), "alternating_wins")),
    ]
    total = F.lit(0.0)
    for held, points, _ in terms:
        total = total + F.when(held, points).otherwise(0.0)
    reasons = F.array_compact(F.array(*[F.when(held, text) for held, _, text in terms]))
    out = pairs.withColumn("risk", F.round(F.least(F.lit(1.0), total), 3)).withColumn("reasons", reasons)
    return out.where(F.size("reasons") > 0)
