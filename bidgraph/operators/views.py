"""Rankings, alerts, profiles and reports over scores, clusters and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidgraph.functions.ranks import numbered
from bidgraph.operators.portfolio import display_code, portfolio_band


def ranking(scores: DataFrame, settings) -> DataFrame:
    """Companies by falling score, at most ``max_entities``; suspicious from the alert threshold on."""
    return scores.withColumn("suspicious", F.col("risk_score") >= settings.alert_threshold).orderBy(F.desc("risk_score"), "company").limit(settings.max_entities)


def headline(scores: DataFrame) -> DataFrame:
    """One row: the top score and the mean model probability of the ten riskiest."""
    top = scores.orderBy(F.desc("risk_score"), "company").limit(10)
    return top.agg(F.max("risk_score").alias("risk_score"), F.avg("model_probability").alias("model_probability"))


def _top_codes(signals, n: int = 4):
    by_weight = F.array_sort(signals, lambda x, y: F.when(x["severity"] > y["severity"], -1).when(x["severity"] < y["severity"], 1).when(x["code"] < y["code"], -1).otherwise(1))
    return F.transform(F.slice(by_weight, 1, n), lambda s: s["code"])


def alerts(companies: DataFrame, tenders: DataFrame, min_score: float, limit: int = 50) -> DataFrame:
    """Companies and tenders from ``min_score`` on with their top codes; ``total`` is counted before the limit."""
    parts = [d.where(F.col("risk_score") >= min_score).select(F.lit(kind).alias("entity_type"), F.col(key).alias("entity_id"), "risk_score", _top_codes(F.col("signals")).alias("codes")) for d, kind, key in ((companies, "company", "company"), (tenders, "tender", "tender"))]
    rows = parts[0].unionByName(parts[1])
    total = rows.agg(F.count("*").alias("total")).withColumn("one", F.lit(1))
    first = rows.orderBy(F.desc("risk_score"), "entity_id").limit(limit).withColumn("one", F.lit(1))
    return first.join(total, "one").drop("one")


def company_profiles(facts: DataFrame, dim: DataFrame, scores: DataFrame) -> DataFrame:
    """Per company: score, tenders entered and won, win rate and its first 50 tender ids.

    Tender ids are ranked per company before they are gathered, so a list never exceeds 50.
    """
    rows = facts.join(dim.select("tender", "winner"), "tender", "left")
    won = F.coalesce(F.col("winner") == F.col("company"), F.lit(False))
    counts = rows.groupBy("company").agg(F.count("*").alias("entered"), F.count_if(won).alias("won"))
    first = facts.select("company", "tender", F.row_number().over(W.partitionBy("company").orderBy("tender")).alias("place")).where("place <= 50")
    ids = first.groupBy("company").agg(F.array_sort(F.collect_list("tender")).alias("tenders"))
    return scores.select("company", "risk_score", "risk_level").join(counts, "company").join(ids, "company").withColumn("win_rate", F.round(F.col("won") / F.col("entered"), 3))


def tender_bidders(facts: DataFrame, dim: DataFrame, scores: DataFrame) -> DataFrame:
    """Bidders of each tender with amount, winner flag and score, one row each."""
    rows = facts.join(dim.select("tender", "winner"), "tender", "left").join(scores.select("company", "risk_score"), "company", "left")
    return rows.select("tender", "company", "bid_amount", F.coalesce(F.col("winner") == F.col("company"), F.lit(False)).alias("winner"), "risk_score")


LISTED = 50  # ids that a profile lists


def first_names(members: DataFrame, names: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): the displays of the first LISTED ids, in order of the ids, of distinct (key, id); ``names``: (id, display)."""
    place = F.row_number().over(W.partitionBy(key).orderBy("id"))
    first = members.withColumn("place", place).where(F.col("place") <= LISTED).join(names, "id", "left")
    return first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("display", "id").alias("display")))).alias("list")).select(key, F.col("list.display").alias(name))


def company_details(resolved: DataFrame, nodes: DataFrame, features: DataFrame, scores: DataFrame) -> DataFrame:
    """Each company with its score and band, the names of its directors and addresses, and its features as a map."""
    from bidgraph.operators.features import FEATURES
    from bidgraph.operators.graph import memberships

    names = nodes.select("id", "display")
    out = scores.select("company", "risk_score", "risk_level")
    for kind, name in (("person", "directors"), ("address", "addresses")):
        listed = first_names(memberships(resolved, kind).select("company", F.col("attr").alias("id")), names, "company", name)
        out = out.join(listed, "company", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    matrix = F.create_map(*[x for c in FEATURES for x in (F.lit(c), F.round(c, 4))]).alias("features")
    return out.join(features.select("company", matrix), "company", "left")


def tender_profiles(signalled: DataFrame, scores: DataFrame, nodes: DataFrame, settings) -> DataFrame:
    """Each tender with its department's and winner's names, metrics, signals, score, and whether a person has to look at it."""
    from bidgraph.operators.signals import risk_level

    out = signalled.join(scores.select("tender", "risk_score"), "tender", "left")
    for c in ("department", "winner"):
        out = out.join(nodes.select(F.col("id").alias(c), F.col("display").alias(f"{c}_name")), c, "left")
    score = F.coalesce("risk_score", F.lit(0.0))
    metrics = ("n_bidders", "bid_spread", "min_bid", "max_bid", "winning_bid", "tender_value", "winning_margin_vs_estimate", "mean_losing_margin", "losing_margin_std", "single_bidder")
    return out.select("tender", "department_name", "winner_name", *metrics, F.transform("signals", lambda x: x["code"]).alias("codes"), score.alias("risk_score"), risk_level(score).alias("risk_level"), (score >= settings.alert_threshold).alias("to_investigate"))


def overall_text(companies: DataFrame, counts: DataFrame, mode: str, settings) -> DataFrame:
    """One row (text): how much was analysed and how, how many companies reached the alert threshold, and the three riskiest."""
    how = {"model": "a learnt score blended with graph rules", "anomaly": "anomaly detection blended with graph rules"}.get(mode, "graph rules alone")
    flagged = companies.agg(F.count_if(F.col("risk_score") >= settings.alert_threshold).alias("flagged"))
    three = companies.orderBy(F.desc("risk_score"), "company").limit(3)
    top = three.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("risk_score")).alias("s"), "company"))), lambda x: F.concat(x["company"], F.lit(" ("), F.format_number(-x["s"], 0), F.lit(")"))), ", ").alias("top"))
    one = F.lit(1).alias("one")
    row = counts.select(one, "companies", "tenders").join(flagged.select(one, "flagged"), "one").join(top.select(one, "top"), "one")
    text = F.concat(
        F.lit("Looked at "), F.col("companies").cast("string"), F.lit(" companies in "), F.col("tenders").cast("string"), F.lit(f" tenders with {how}. "), F.col("flagged").cast("string"), F.lit(f" reached the alert threshold of {settings.alert_threshold:.0f}; the highest are "),
        F.when(F.col("top") != "", F.col("top")).otherwise("none"), F.lit(". Scores are priorities for people to check and say nothing about wrongdoing."),
    )
    return row.select(text.alias("text"))


def cluster_signals(components: DataFrame, signals: DataFrame) -> DataFrame:
    """(root, code, company, contribution): per cluster and display code the member with the strongest signal."""
    rows = signals.join(components.select(F.col("node").alias("company"), "root"), "company")
    strength = F.col("severity") * F.col("weight")
    best = rows.groupBy("root", display_code(F.col("code")).alias("code")).agg(F.max(F.struct(strength.alias("s"), "company")).alias("b"))
    return best.select("root", "code", "b.company", F.col("b.s").alias("contribution"))


def number_clusters(clusters: DataFrame) -> DataFrame:
    """Ids CLU-01, CLU-02, ... by falling score, ties by root."""
    text = F.col("place").cast("string")
    padded = F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)
    rows = numbered(clusters, [F.desc("score"), F.col("root")], "place")
    return rows.withColumn("cluster_id", F.concat(F.lit("CLU-"), padded)).drop("place")


def narrative(edges: DataFrame) -> DataFrame:
    """A sentence per linked pair from its evidence."""
    return edges.select("a", "b", F.concat_ws(" ", "a", F.lit("and"), "b", F.lit("are linked by"), F.array_join("evidence", ", ")).alias("text"))


def risk_report(scores: DataFrame) -> DataFrame:
    """(band, bidders, share, mean_score) of (bidder_id, score)."""
    per = scores.groupBy(portfolio_band(F.col("score")).alias("band")).agg(F.count("*").alias("bidders"), F.avg("score").alias("mean_score"))
    return per.withColumn("share", F.col("bidders") / F.sum("bidders").over(W.partitionBy(F.lit(1))))


def evidence_match(requirements: DataFrame, documents: DataFrame) -> DataFrame:
    """(key, requirement, matched): a requirement is matched if a valid document of its key was detected as it."""
    detected = documents.where("status = 'valid'").select("key", F.explode("documents").alias("requirement")).distinct().withColumn("hit", F.lit(True))
    rows = requirements.select("key", F.explode("documents").alias("requirement"))
    return rows.join(detected, ["key", "requirement"], "left").select("key", "requirement", F.coalesce("hit", F.lit(False)).alias("matched"))
