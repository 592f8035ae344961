"""Risk signals of companies and tenders, rule score and blend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidgraph.functions.settings import PROHIBITED_TERMS, RECOMMENDED_ACTIONS, RISK_LANGUAGE


def ratio(value: Column, threshold: float, ceiling: float) -> Column:
    """0.4 at the threshold, 1 at the ceiling."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - threshold) / (ceiling - threshold))) * 0.6 + 0.4


def availability(resolved: DataFrame) -> DataFrame:
    """One row of flags: any person, address, amount, winner in the data."""
    from bidgraph.functions.clean import is_winner

    seen = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return resolved.agg(seen(F.col("person").isNotNull()).alias("has_persons"), seen(F.col("address").isNotNull()).alias("has_addresses"), seen(F.col("bid_amount").isNotNull()).alias("has_amounts"), seen(is_winner(F.col("result"))).alias("has_winners"))


def company_signals(features: DataFrame, settings, flags: dict | None = None, degree_cutoff: float = 0.0, clustered: bool = False) -> DataFrame:
    """Features with ``signals``: array of (code, severity, weight), and ``rule_score`` of the evaluable ones.

    ``flags`` and ``degree_cutoff`` are one-row results, passed as values.  ``clustered``: the features
    have communities, so rotation counts for the companies that are in one.
    """
    c, s = F.col, settings
    flags = flags or {"has_persons": True, "has_addresses": True, "has_amounts": True, "has_winners": True}
    rotation = (c("community_size") > 0) & (c("cluster_tenders") >= s.min_rotation_tenders) & (c("cluster_rotation_entropy") >= s.rotation_entropy_min)
    rotation = rotation & (c("cluster_capture_rate") >= s.max_cluster_win_concentration) & (c("community_size") <= 10)
    dense = c("community_size").between(s.min_community_size, 12) & (c("community_density") >= 0.75)
    gap = c("min_pair_price_gap")
    top = F.greatest("cluster_win_concentration", "department_concentration")
    concentrated = (c("n_tenders") >= s.min_cobid_events) & ((c("cluster_win_concentration") >= s.max_cluster_win_concentration) | (c("department_concentration") >= 0.9))
    one = F.lit(1.0)
    rules = [
        ("SHARED_DIRECTORS", flags["has_persons"], c("shared_director_peers") >= s.min_shared_directors, ratio(c("shared_director_peers"), s.min_shared_directors, 4)),
        ("SHARED_ADDRESS", flags["has_addresses"], c("shared_address_peers") >= s.min_shared_address_peers, ratio(c("shared_address_peers"), s.min_shared_address_peers, 4)),
        ("REPEATED_CO_BIDDING", True, (c("max_cobid_count") >= s.min_cobid_events) & (c("top_partner_ratio") >= s.high_cobid_ratio), ratio(c("top_partner_ratio"), s.high_cobid_ratio, 1.0)),
        ("BID_PRICE_SIMILARITY", flags["has_amounts"], gap <= s.bid_similarity_pct, F.least(one, F.greatest(F.lit(0.4), 1 - gap / s.bid_similarity_pct * 0.6))),
        ("DUPLICATE_BID_DOCUMENTS", True, c("document_peers") > 0, one),
        ("COVER_BID_PATTERN", flags["has_amounts"], (c("complementary_bid_ratio") >= 0.6) & (c("n_tenders") >= 3), ratio(c("complementary_bid_ratio"), 0.6, 1.0)),
        ("WINNER_ROTATION", flags["has_winners"], rotation, F.least(one, 0.5 * c("cluster_rotation_entropy") + 0.5 * c("cluster_capture_rate"))),
        ("MARKET_CONCENTRATION", True, concentrated, F.least(one, top)),
        ("HIGH_CENTRALITY", True, F.lit(degree_cutoff > 0) & (c("degree_centrality") >= degree_cutoff), F.lit(0.5)),
        ("DENSE_SUBGROUP", True, dense, F.least(one, c("community_density"))),
        ("UNCONTESTED_AWARDS", flags["has_winners"], c("solo_wins") >= 2, F.least(one, 0.4 + c("solo_wins") / c("n_tenders"))),
    ]
    if "cluster_tenders" not in features.columns:
        features = features.withColumn("cluster_tenders", F.lit(0))
    if clustered:  # a company without a community can't be judged for rotation
        rules = [(code, F.col("community_size") > 0 if code == "WINNER_ROTATION" and known else known, *more) for code, known, *more in rules]
    return _with_signals(features, [r for r in rules if r[1] is not False], s.weights)


def _with_signals(rows: DataFrame, rules: list, weights: dict) -> DataFrame:
    fired = [F.when(F.coalesce(held, F.lit(False)), F.struct(F.lit(code).alias("code"), severity.cast("double").alias("severity"), F.lit(float(weights[code])).alias("weight"))) for code, _, held, severity in rules]
    rows = rows.withColumn("signals", F.array_compact(F.array(*fired)))
    # A rule counts in the denominator where it can be told, which may be known per row.
    always = sum(weights[code] for code, known, *_ in rules if known is True)
    total = F.lit(float(always))
    for code, known, *_ in rules:
        if known is not True:
            total = total + F.when(known, float(weights[code])).otherwise(0.0)
    score = F.aggregate("signals", F.lit(0.0), lambda acc, x: acc + x["severity"] * x["weight"])
    return rows.withColumn("rule_score", F.when(total > 0, F.least(F.lit(1.0), score / total)).otherwise(0.0))


def tender_signals(features: DataFrame, settings) -> DataFrame:
    """Tender features with ``signals``, by falling severity, and ``own``: their mean."""
    c, s = F.col, settings
    limit = s.bid_similarity_pct * 2
    uniform = c("mean_losing_margin").between(s.cover_low, s.cover_high) & (c("losing_margin_std") < 0.03)
    rules = [
        ("TIGHT_BID_CLUSTER", True, (c("n_bidders") > 1) & (c("bid_spread") <= limit), F.least(F.lit(1.0), 1 - c("bid_spread") / limit)),
        ("UNIFORM_LOSING_MARGINS", True, uniform, F.lit(0.8)),
        ("SINGLE_BIDDER", True, c("single_bidder"), F.lit(0.6)),
        ("NO_PRICE_PRESSURE", True, c("winning_margin_vs_estimate") > -0.02, F.lit(0.5)),
    ]
    out = _with_signals(features, rules, {r[0]: 1.0 for r in rules}).drop("rule_score")
    by_weight = F.array_sort("signals", lambda x, y: F.when(x["severity"] > y["severity"], -1).when(x["severity"] < y["severity"], 1).otherwise(0))
    mean = F.aggregate("signals", F.lit(0.0), lambda acc, x: acc + x["severity"]) / F.size("signals")
    return out.withColumn("own", F.when(F.size("signals") > 0, mean).otherwise(0.0)).withColumn("signals", by_weight)


def signal_rollup(scored: DataFrame) -> DataFrame:
    """(code, companies, mean_severity) by falling count."""
    rows = scored.select("company", F.explode("signals").alias("s")).select("company", "s.*")
    return rows.groupBy("code").agg(F.count_distinct("company").alias("companies"), F.round(F.avg("severity"), 3).alias("mean_severity")).orderBy(F.desc("companies"), "code")


def blended(rule: Column, model: Column, settings) -> Column:
    wr, wm = settings.rule_weight, settings.model_weight
    mixed = F.when(model.isNull(), rule).otherwise((wr * rule + wm * model) / (wr + wm))
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), mixed)) * 100, 2)


def risk_level(score: Column) -> Column:
    return F.when(score < 25, "LOW").when(score < 50, "MEDIUM").when(score < 75, "HIGH").otherwise("CRITICAL")


def recommended_actions(signals: Column, score: Column, settings) -> Column:
    table = F.create_map(*[F.lit(x) for kv in RECOMMENDED_ACTIONS.items() for x in kv])
    by_code = F.array_distinct(F.array_compact(F.transform(signals, lambda s: F.try_element_at(table, s["code"]))))
    more = F.when(score >= settings.alert_threshold, F.array(F.lit("Escalate to a human investigator; do not act on this score alone."))).otherwise(F.array().cast("array<string>"))
    return F.concat(by_code, more)


def explanation(name: Column, score: Column, level: Column, signals: Column) -> Column:
    """Name, score, wording of the band, number of indicators and the four strongest."""
    words = F.create_map(*[F.lit(x) for kv in RISK_LANGUAGE.items() for x in kv])
    strongest = F.array_sort(signals, lambda x, y: F.when(x["severity"] * x["weight"] > y["severity"] * y["weight"], -1).when(x["severity"] * x["weight"] < y["severity"] * y["weight"], 1).otherwise(0))
    top = F.array_join(F.transform(F.slice(strongest, 1, 4), lambda s: F.replace(F.lower(s["code"]), F.lit("_"), F.lit(" "))), "; ")
    head = F.concat(name, F.lit(" has a review priority of "), F.format_number(score, 2), F.lit(" ("), F.element_at(words, level), F.lit(")"))
    return F.when(F.size(signals) == 0, F.concat(head, F.lit("; no indicator was found."))).otherwise(F.concat(head, F.lit(" from "), F.size(signals).cast("string"), F.lit(" indicator(s): "), top, F.lit(".")))


def wording_violations(texts: DataFrame, column: str) -> DataFrame:
    """Rows whose text states a verdict; must be empty."""
    return texts.where(F.lower(column).rlike(r"\b(" + "|".join(PROHIBITED_TERMS) + r")\b"))


def score_companies(signalled: DataFrame, settings, model: DataFrame | None = None) -> DataFrame:
    """(company, rule_score, model_probability, risk_score, risk_level, signals, actions)."""
    rows = signalled.select("company", "rule_score", "signals")
    rows = rows.join(model, "company", "left") if model is not None else rows.withColumn("model_probability", F.lit(None).cast("double"))
    rows = rows.withColumn("risk_score", blended(F.col("rule_score"), F.col("model_probability"), settings))
    rows = rows.withColumn("risk_level", risk_level(F.col("risk_score")))
    return rows.withColumn("actions", recommended_actions(F.col("signals"), F.col("risk_score"), settings))


def score_tenders(signalled: DataFrame, facts: DataFrame, scores: DataFrame) -> DataFrame:
    """(tender, risk_score, risk_level): own signals and the riskiest bidder."""
    worst = facts.join(scores.select("company", "risk_score"), "company").groupBy("tender").agg(F.max("risk_score").alias("worst"))
    joined = signalled.join(worst, "tender", "left")
    score = F.least(F.lit(1.0), 0.55 * F.col("own") + 0.45 * F.coalesce("worst", F.lit(0.0)) / 100) * 100
    score = F.floor(score * 100 + 0.5) / 100  # the double itself is rounded; F.round rounds its shortest decimal form
    return joined.select("tender", "signals", score.alias("risk_score"), risk_level(score).alias("risk_level"))
