"""Tender and company features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidgraph.functions.ranks import running
from bidgraph.plans.storage import materialize

#: The feature matrix, in order.
FEATURES = (
    "n_tenders", "n_wins", "win_rate", "shared_director_peers", "max_shared_directors", "shared_address_peers",
    "cobid_partners", "max_cobid_count", "top_partner_ratio", "mean_cobid_weight", "min_pair_price_gap", "mean_pair_price_gap",
    "complementary_bid_ratio", "bid_to_estimate_ratio", "bid_ratio_std", "cluster_rotation_entropy", "cluster_capture_rate",
    "cluster_win_concentration", "community_size", "community_density", "department_concentration", "degree_centrality",
    "weighted_degree", "pagerank", "eigenvector_centrality", "betweenness", "clustering_coefficient",
)


def tender_features(facts: DataFrame, dim: DataFrame) -> DataFrame:
    """Bidders, spread, margins; one row per tender."""
    joined = facts.join(dim.select("tender", "winner", "department", F.col("tender_value").alias("estimate")), "tender")
    own = F.col("company") == F.col("winner")
    with_win = joined.groupBy("tender").agg(
        F.count("company").alias("n_bidders"), F.min("bid_amount").alias("min_bid"), F.max("bid_amount").alias("max_bid"), F.count("bid_amount").alias("n_amounts"),
        F.max(F.when(own, F.col("bid_amount"))).alias("winning_bid"), F.first("estimate").alias("tender_value"), F.first("winner").alias("winner"), F.first("department").alias("department"),
    )
    losers = facts.select("tender", F.col("bid_amount").alias("amount")).join(with_win.select("tender", "winning_bid"), "tender").where("winning_bid > 0 AND amount > winning_bid")
    margin = (F.col("amount") - F.col("winning_bid")) / F.col("winning_bid")
    margins = losers.groupBy("tender").agg(F.avg(margin).alias("mean_losing_margin"), F.stddev_pop(margin).alias("losing_margin_std"))
    spread = F.when((F.col("n_amounts") >= 2) & (F.col("max_bid") > 0), (F.col("max_bid") - F.col("min_bid")) / F.col("max_bid"))
    against = F.when(F.col("tender_value") != 0, (F.col("winning_bid") - F.col("tender_value")) / F.col("tender_value"))
    return with_win.join(margins, "tender", "left").select(
        "tender", "n_bidders", spread.alias("bid_spread"), "min_bid", "max_bid", "winning_bid", "tender_value", against.alias("winning_margin_vs_estimate"),
        "mean_losing_margin", "losing_margin_std", (F.col("n_bidders") <= 1).alias("single_bidder"), "department", "winner",
    )


def bid_features(facts: DataFrame, dim: DataFrame, settings) -> DataFrame:
    """Per company: tenders, wins, cover bids, bid to estimate, uncontested wins."""
    placed = facts.select("tender", "company", "bid_amount").join(dim.select("tender", "winner", F.col("tender_value").alias("estimate")), "tender")
    # A tender has a bid of its winner at most, as facts are by company and tender.
    wins = placed.groupBy("tender").agg(F.count("company").alias("n_bidders"), F.max(F.when(F.col("winner") == F.col("company"), F.col("bid_amount"))).alias("winning_bid"))
    rows = placed.join(wins, "tender")
    won = F.coalesce(F.col("winner") == F.col("company"), F.lit(False))
    lost = F.col("winner").isNotNull() & ~won
    margin = (F.col("bid_amount") - F.col("winning_bid")) / F.col("winning_bid")
    cover = lost & (F.col("winning_bid") > 0) & margin.between(settings.cover_low, settings.cover_high)
    ratio = F.when(F.col("estimate") != 0, F.col("bid_amount") / F.col("estimate"))
    per = rows.groupBy("company").agg(
        F.count("*").alias("n_tenders"), F.count_if(won).alias("n_wins"), F.count_if(lost).alias("n_lost"), F.count_if(F.coalesce(cover, F.lit(False))).alias("n_cover"),
        F.count_if(won & (F.col("n_bidders") <= 1)).alias("solo_wins"), F.avg(ratio).alias("bid_to_estimate_ratio"), F.stddev_pop(ratio).alias("bid_ratio_std"),
    )
    return per.select(
        "company", "n_tenders", "n_wins", (F.col("n_wins") / F.col("n_tenders")).alias("win_rate"), F.when(F.col("n_lost") > 0, F.col("n_cover") / F.col("n_lost")).otherwise(0.0).alias("complementary_bid_ratio"),
        F.coalesce("bid_to_estimate_ratio", F.lit(0.0)).alias("bid_to_estimate_ratio"), F.coalesce("bid_ratio_std", F.lit(0.0)).alias("bid_ratio_std"), "solo_wins",
    )


def both_ways(pairs: DataFrame) -> DataFrame:
    """Pairs seen from either company, as ``company`` and ``peer``."""
    a = pairs.withColumnsRenamed({"company_a": "company", "company_b": "peer"})
    b = pairs.withColumnsRenamed({"company_b": "company", "company_a": "peer"})
    return a.unionByName(b)


def pair_summary(pairs: DataFrame, settings) -> DataFrame:
    """Per company over its pairs: partners, counts and price gaps of repeat partners."""
    repeat = F.when(F.col("shared_tenders") >= settings.min_cobid_events, F.col("mean_price_gap"))
    return both_ways(pairs).groupBy("company").agg(
        F.count("*").alias("cobid_partners"), F.max("shared_tenders").alias("max_cobid_count"), F.avg("shared_tenders").alias("mean_cobid_weight"),
        F.min(repeat).alias("min_gap"), F.avg(repeat).alias("mean_gap"), F.count_if(F.col("shared_document_hashes") > 0).alias("document_peers"),
    )


def peers(resolved: DataFrame, kind: str) -> DataFrame:
    """(company, peers, max_shared): other companies with a common attribute, and the most shared with one."""
    from bidgraph.operators.pairs import attribute_peers, shared_sets

    return attribute_peers(materialize(shared_sets(resolved, kind), "sets"))


def department_concentration(facts: DataFrame, dim: DataFrame) -> DataFrame:
    per = facts.join(dim.where("department IS NOT NULL").select("tender", "department"), "tender").groupBy("company", "department").agg(F.count("*").alias("n"))
    return per.groupBy("company").agg((F.max("n") / F.sum("n")).alias("department_concentration"))


def company_features(resolved: DataFrame, facts: DataFrame, dim: DataFrame, pairs: DataFrame, settings, centrality: DataFrame | None = None, community: DataFrame | None = None) -> DataFrame:
    """The 27 features, nulls as 0, with ``solo_wins`` and ``document_peers`` beside them.

    ``centrality``: (company, degree_centrality, ...); ``community``: (company, community_size, ...), whose
    ``cluster_tenders`` is kept for the rotation signal.
    """
    facts = facts.where("company IS NOT NULL")
    # Rows per company are written part by part: each part shuffles bids or pairs, and these shuffles end with it.
    own, met, shares = (materialize(part, name) for part, name in ((bid_features(facts, dim, settings), "bids-of"), (pair_summary(pairs, settings), "pairs-of"), (department_concentration(facts, dim), "shares-of")))
    persons, places = peers(resolved, "person"), peers(resolved, "address")
    out = own.join(met, "company", "left")
    out = out.join(persons.select("company", F.col("peers").alias("shared_director_peers"), F.col("max_shared").alias("max_shared_directors")), "company", "left")
    out = out.join(places.select("company", F.col("peers").alias("shared_address_peers")), "company", "left").join(shares, "company", "left")
    for part in (centrality, community):
        if part is not None:
            out = out.join(part, "company", "left")
    out = out.withColumn("top_partner_ratio", F.coalesce(F.col("max_cobid_count") / F.col("n_tenders"), F.lit(0.0)))
    out = out.withColumn("min_pair_price_gap", F.coalesce("min_gap", F.lit(1.0))).withColumn("mean_pair_price_gap", F.coalesce("mean_gap", F.lit(1.0)))
    have = set(out.columns)
    cols = [(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)).alias(c) for c in FEATURES]
    more = [F.coalesce(c, F.lit(0)).alias(c) for c in ("solo_wins", "document_peers", "cluster_tenders") if c in have]
    return out.select("company", *cols, *more)


def percentile_threshold(df: DataFrame, column: str, p: float) -> DataFrame:
    """One row: the linearly interpolated quantile, 0 for no rows.

    Values are counted, and the counts added up over ranges of the values, so no task sees them all;
    the two values between which the quantile lies are those whose counts reach its place.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("value")).agg(F.count("*").alias("n"))
    upto = running(counts, [F.col("value")], {"upto": F.col("n")})
    total = upto.agg(F.max("upto").alias("n")).first()["n"]
    if total is None:
        return upto.agg(F.lit(0.0).alias("cutoff"))
    at = p * (total - 1)
    low = int(at)
    reach = lambda place: F.min(F.when(F.col("upto") > place, F.col("value")))
    found = upto.agg(reach(low).alias("low"), reach(min(low + 1, total - 1)).alias("high"))
    return found.select((F.col("low") + (F.col("high") - F.col("low")) * (at - low)).alias("cutoff"))
