"""Portfolio views: bids, bidders, tenders and scores joined for lists, rankings and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidgraph.functions.clean import is_gst, is_pan, mask_account, mask_phone, person_slug
from bidgraph.functions.ranks import numbered
from bidgraph.functions.settings import SIGNAL_META

#: Words in file names that stand for a required document.
DOCUMENT_ALIASES = {
    "GST certificate": ("gst", "gstin", "goods", "tax"),
    "PAN card": ("pan", "permanent"),
    "Udyam/MSME certificate": ("udyam", "msme"),
    "Experience certificate": ("experience", "work experience"),
    "Work order": ("work order",),
    "Financial statement": ("financial", "turnover", "balance"),
    "Balance sheet": ("balance", "financial"),
    "Certificate of incorporation": ("incorporation", "company registration"),
    "EMD / Bid Security proof": ("emd", "bid security", "earnest"),
    "ISO 9001": ("iso", "9001"),
    "OEM authorization": ("oem", "authorization", "manufacturer"),
    "Turnover proof": ("turnover", "financial"),
    "Quality certificate": ("quality", "certificate"),
}
STATUSES = ("Verified", "Needs Review", "Flagged")


def portfolio_band(score: Column) -> Column:
    return F.when(score > 75, "Critical").when(score > 50, "High").when(score > 25, "Medium").otherwise("Low")


def display_code(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for k, (ui, _) in SIGNAL_META.items() for x in (k, ui)])
    return F.coalesce(F.try_element_at(table, code), code)


def signal_label(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for k, (_, label) in SIGNAL_META.items() for x in (k, label)])
    return F.coalesce(F.try_element_at(table, code), code)


def lowest_bids(bids: DataFrame) -> DataFrame:
    """(tender_id, bid_id, bidder_id, bid_amount): the lowest positive bid of each tender, ties by bid id."""
    some = bids.where("bid_amount > 0")
    best = some.groupBy("tender_id").agg(F.min(F.struct("bid_amount", "bid_id", "bidder_id")).alias("b"))
    return best.select("tender_id", "b.bid_id", "b.bidder_id", "b.bid_amount")


def analysis_records(bidders: DataFrame, bids: DataFrame) -> DataFrame:
    """Bids of known bidders as analysis records, winners inferred."""
    won = lowest_bids(bids).select(F.col("bid_id").alias("winning_bid"))
    rows = bids.join(bidders, "bidder_id").join(won, F.col("bid_id") == F.col("winning_bid"), "left")
    return rows.select(
        F.col("bidder_id").alias("company_id"), "company_name", person_slug(F.col("director_name")).alias("person_id"), F.col("director_name").alias("person_name"), "tender_id",
        F.col("category").alias("department_id"), "address", "bid_amount", F.col("submission_date").alias("bid_date"), F.when(F.col("winning_bid").isNotNull(), "won").otherwise("lost").alias("result"),
    )


def scores_to_raw(entities: DataFrame, bidders: DataFrame) -> DataFrame:
    """Scores of entities (aliases, risk_score, codes) spread to every raw bidder; none is 0 and Low."""
    spread = entities.select(F.explode("aliases").alias("bidder_id"), F.round("risk_score").cast("int").alias("score"), "codes")
    rows = bidders.select("bidder_id").join(spread, "bidder_id", "left")
    score = F.coalesce("score", F.lit(0))
    return rows.select("bidder_id", score.alias("score"), portfolio_band(score).alias("band"), F.coalesce("codes", F.array().cast("array<string>")).alias("codes"))


def registry_edges(bidders: DataFrame) -> DataFrame:
    """(a, b, evidence): bidders with an equal trimmed phone or bank account."""
    out = None
    for column, code in (("phone", "sharedPhone"), ("bank_account", "sharedBank")):
        held = bidders.select(F.trim(column).alias("value"), F.col("bidder_id").alias("a")).where("value <> ''")
        pair = held.join(held.select(F.col("value").alias("v"), F.col("a").alias("b")), (F.col("value") == F.col("v")) & (F.col("a") < F.col("b")))
        part = pair.select("a", "b", F.lit(code).alias("code"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("a", "b").agg(F.array_sort(F.collect_set("code")).alias("evidence"))


def relationship_edges(relations: DataFrame) -> DataFrame:
    """(a, b, evidence, score, linkable) of risky company pairs."""
    c = F.col
    evidence = F.array_compact(F.array(
        F.when(c("shared_directors") > 0, F.lit("sharedDirector")), F.when(c("shared_addresses") > 0, F.lit("sharedAddress")), F.when(c("shared_tenders") >= 3, F.lit("repeatedCoBidding")),
        F.when(c("alternating_wins") >= 3, F.lit("winnerRotation")), F.when(c("shared_document_hashes") > 0, F.lit("duplicateBidDocuments")),
    ))
    linkable = (c("shared_directors") > 0) | (c("shared_addresses") > 0) | (c("shared_document_hashes") > 0)
    return relations.where("company_a <> company_b").select(c("company_a").alias("a"), c("company_b").alias("b"), evidence.alias("evidence"), F.round(c("risk") * 100).cast("int").alias("score"), linkable.alias("linkable"))


def renamed(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Edges between other ids, by (id, node); an end without one keeps its id, edges that meet are united, loops are dropped."""
    rows = edges
    for end in ("a", "b"):
        rows = rows.join(known.select(F.col("id").alias(end), F.col("node").alias(f"{end}_node")), end, "left")
    a, b = F.coalesce("a_node", "a"), F.coalesce("b_node", "b")
    rows = rows.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y"), *[c for c in edges.columns if c not in ("a", "b")]).where("x <> y")
    how = {"evidence": F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))), "score": F.max("score"), "linkable": F.bool_or("linkable")}
    return rows.groupBy("x", "y").agg(*[c.alias(name) for name, c in how.items() if name in edges.columns]).withColumnsRenamed({"x": "a", "y": "b"})


def merge_edges(relations: DataFrame, registry: DataFrame) -> DataFrame:
    """Both edge sets by unordered pair: evidence united; a registry edge makes a pair linkable."""
    left = relations.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("evidence").alias("e1"), "score", "linkable")
    right = registry.select("a", "b", F.col("evidence").alias("e2"))
    none = F.array().cast("array<string>")
    both = left.join(right, ["a", "b"], "full_outer")
    return both.select("a", "b", F.array_sort(F.array_union(F.coalesce("e1", none), F.coalesce("e2", none))).alias("evidence"), F.coalesce("score", F.lit(0)).alias("score"), (F.coalesce("linkable", F.lit(False)) | F.col("e2").isNotNull()).alias("linkable"))


def clusters(edges: DataFrame, components: DataFrame, scores: DataFrame) -> DataFrame:
    """Clusters over linkable edges from (node, root): members, top score, evidence, ids by score."""
    sized = components.join(scores.select(F.col("bidder_id").alias("node"), "score"), "node", "left")
    grouped = sized.groupBy("root").agg(F.count("*").alias("members"), F.max(F.coalesce("score", F.lit(0))).alias("score"))
    inside = edges.where("linkable").join(components.select(F.col("node").alias("a"), "root"), "a").select("root", F.explode("evidence").alias("code"))
    evidence = inside.groupBy("root").agg(F.array_sort(F.collect_set("code")).alias("evidence"))
    out = grouped.where("members > 1").join(evidence, "root", "left")
    return out.withColumn("band", portfolio_band(F.col("score")))


def tender_list(tenders: DataFrame, bids: DataFrame, bidders: DataFrame) -> DataFrame:
    """Tenders with their number of bids and, if awarded, the cheapest bid and its bidder."""
    n = bids.groupBy("tender_id").agg(F.count("*").alias("bid_count"))
    best = lowest_bids(bids).join(bidders.select("bidder_id", "company_name"), "bidder_id")
    best = best.select("tender_id", F.col("bid_id").alias("winner_bid_id"), F.col("company_name").alias("winner_name"), F.col("bid_amount").alias("award_amount"))
    out = tenders.join(n, "tender_id", "left").join(best, "tender_id", "left")
    awarded = F.col("status") == "Awarded"
    return out.select("tender_id", "title", "department", "category", "status", F.coalesce("bid_count", F.lit(0)).alias("bid_count"), *[F.when(awarded, F.col(c)).alias(c) for c in ("winner_bid_id", "winner_name", "award_amount")])


def dashboard(bids: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: bids per status and bidders per band."""
    status = bids.agg(F.count("*").alias("total_bids"), *[F.count_if(F.col("verification_status") == s).alias(s.lower().replace(" ", "_")) for s in STATUSES])
    s = F.col("score")
    bands = scores.agg(F.count_if(s <= 25).alias("low"), F.count_if((s > 25) & (s <= 50)).alias("medium"), F.count_if((s > 50) & (s <= 75)).alias("high"), F.count_if(s > 75).alias("critical"))
    one = F.lit(1).alias("one")
    return status.select(one, "*").join(bands.select(one, "*"), "one").drop("one")


def _checked(tenders: DataFrame, bids: DataFrame, bidders: DataFrame) -> DataFrame:
    """Bids with ``checks``: (requirement, status) of each document that their tender requires."""
    rows = bids.select("bid_id", "tender_id", "bidder_id", F.transform(F.coalesce("submitted_documents", F.array().cast("array<string>")), F.lower).alias("names"))
    rows = rows.join(tenders.select("tender_id", "required_documents"), "tender_id").join(bidders.select("bidder_id", "gst_number", "pan_number", "msme_status"), "bidder_id", "left")
    table = F.create_map(*[x for k, v in DOCUMENT_ALIASES.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))])
    given = lambda c: F.coalesce(F.col(c) != "", F.lit(False))

    def check(requirement: Column) -> Column:
        needles = F.coalesce(F.try_element_at(table, requirement), F.array(F.lower(requirement)))
        by_file = F.exists("names", lambda n: F.exists(needles, lambda w: F.contains(n, w)))
        by_profile = F.when(requirement == "GST certificate", given("gst_number")).when(requirement == "PAN card", given("pan_number")).when(requirement == "Udyam/MSME certificate", F.coalesce(F.col("msme_status") == "Yes", F.lit(False))).otherwise(False)
        status = F.when(by_file | by_profile, "matched").when(F.size("names") > 0, "missing").otherwise("evidence_required")
        return F.struct(requirement.alias("requirement"), status.alias("status"))

    return rows.select("bid_id", "tender_id", "bidder_id", F.transform("required_documents", check).alias("checks"))


def document_checks(tenders: DataFrame, bids: DataFrame, bidders: DataFrame) -> DataFrame:
    """(bid_id, requirement, status): each required document against file names and the profile."""
    return _checked(tenders, bids, bidders).select("bid_id", "tender_id", "bidder_id", F.explode("checks").alias("c")).select("bid_id", "tender_id", "bidder_id", "c.*")


def comparison(tenders: DataFrame, bids: DataFrame, bidders: DataFrame) -> DataFrame:
    """(bid_id, matched, missing, total, score, status) of the document checks, counted inside each bid's row."""
    rows = _checked(tenders, bids, bidders).where(F.size("checks") > 0)
    count = lambda status: F.sum(F.size(F.filter("checks", lambda c: c["status"] == status)))
    n = rows.groupBy("bid_id").agg(count("matched").alias("matched"), count("missing").alias("missing"), F.sum(F.size("checks")).alias("total"))
    status = F.when(F.col("missing") > 0, "Requirements missing").when(F.col("matched") == F.col("total"), "Checklist matched").otherwise("Evidence required")
    return n.select("*", F.floor(100 * F.col("matched") / F.col("total") + 0.5).cast("int").alias("score"), status.alias("status"))


def bid_ranking(bids: DataFrame, compliance: DataFrame, scores: DataFrame) -> DataFrame:
    """Rank of each bid in its tender: half compliance, 0.3 price, 0.2 low risk."""
    rows = bids.select("bid_id", "tender_id", "bidder_id", "bid_amount").join(compliance.select("bid_id", F.col("score").alias("compliance")), "bid_id", "left").join(scores.select("bidder_id", F.col("score").alias("risk")), "bidder_id", "left")
    lowest = F.min("bid_amount").over(W.partitionBy("tender_id"))
    price = F.least(F.lit(100.0), F.coalesce(lowest / F.col("bid_amount") * 100, F.lit(0.0)))
    total = 0.5 * F.coalesce("compliance", F.lit(0)) + 0.3 * price + 0.2 * F.greatest(F.lit(0), 100 - F.coalesce("risk", F.lit(0)))
    rows = rows.withColumn("points", F.floor(total + 0.5).cast("int"))
    return rows.withColumn("place", F.row_number().over(W.partitionBy("tender_id").orderBy(F.desc("points"), "bid_amount", "bid_id"))).select("bid_id", "tender_id", "bidder_id", "points", "place")


def search_bids(bids: DataFrame, bidders: DataFrame, text: str | None = None, status: str | None = None, category: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    rows = bids.join(bidders.drop("balance"), "bidder_id", "left")
    if text:
        wanted, hit = text.lower(), F.lit(False)
        for c in ("bid_id", "tender_id", "company_name", "director_name", "gst_number", "pan_number", "address"):
            hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(wanted)), F.lit(False))
        rows = rows.where(hit)
    for column, value in (("verification_status", status), ("category", category)):
        if value:
            rows = rows.where(F.col(column) == value)
    if since:
        rows = rows.where(F.col("submission_date") >= since)
    if until:
        rows = rows.where(F.col("submission_date") <= until)
    return rows


def page(rows: DataFrame, order: list[Column], number: int, size: int = 20) -> DataFrame:
    """One page of a sorted list; the size is held within 1 and 200."""
    size = min(200, max(1, size))
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def masked_bidders(bidders: DataFrame, scores: DataFrame) -> DataFrame:
    rows = bidders.join(scores.select("bidder_id", "score", "band"), "bidder_id", "left")
    return rows.select("bidder_id", "company_name", "director_name", mask_phone(F.col("phone")).alias("phone"), mask_account(F.col("bank_account")).alias("bank_account"), F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("band", F.lit("Low")).alias("band"))


def bidder_history(bids: DataFrame, tenders: DataFrame) -> DataFrame:
    """(bidder_id, bids, verified, awarded): counts over each bidder's bids."""
    won = lowest_bids(bids).select(F.col("bid_id").alias("w"))
    rows = bids.join(tenders.select("tender_id", "status"), "tender_id", "left").join(won, F.col("bid_id") == F.col("w"), "left")
    return rows.groupBy("bidder_id").agg(F.count("*").alias("bids"), F.count_if(F.col("verification_status") == "Verified").alias("verified"), F.count_if((F.col("status") == "Awarded") & F.col("w").isNotNull()).alias("awarded"), F.max("submission_date").alias("latest"))


def checklist(bidders: DataFrame, evidence: DataFrame) -> DataFrame:
    """(bidder_id, key, status, confidence): eight checks per bidder; ``evidence``: (bidder_id, codes)."""
    rows = bidders.join(evidence, "bidder_id", "left")
    has = lambda code: F.coalesce(F.array_contains("codes", code), F.lit(False))
    either = lambda cond, a, b: F.when(cond, F.lit(a)).otherwise(F.lit(b))
    gst, pan = is_gst(F.col("gst_number")), is_pan(F.col("pan_number"))
    items = [
        ("gst", either(gst, "verified", "failed"), either(gst, 98, 40)),
        ("pan", either(pan, "verified", "failed"), either(pan, 97, 35)),
        ("msme", F.lit("verified"), F.lit(95)),
        ("bank", either(has("sharedBank"), "warning", "verified"), either(has("sharedBank"), 62, 96)),
        ("registration", F.lit("verified"), F.lit(99)),
        ("director", either(has("sharedDirector"), "warning", "verified"), either(has("sharedDirector"), 91, 97)),
        ("address", either(has("sharedAddress"), "warning", "verified"), either(has("sharedAddress"), 94, 96)),
        ("documents", F.lit("verified"), F.lit(100)),
    ]
    built = F.array(*[F.struct(F.lit(k).alias("key"), s.alias("status"), n.alias("confidence")) for k, s, n in items])
    return rows.select("bidder_id", F.explode(built).alias("i")).select("bidder_id", "i.*")


def evidence_per_bidder(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("a").alias("bidder_id"), "evidence").unionByName(edges.select(F.col("b").alias("bidder_id"), "evidence"))
    return ends.select("bidder_id", F.explode("evidence").alias("code")).groupBy("bidder_id").agg(F.array_sort(F.collect_set("code")).alias("codes"))


def audit_rows(actions: DataFrame, initial: str = "Needs Review") -> DataFrame:
    """Verification actions (bid_id, action_seq, new_status) with the status before each."""
    before = F.lag("new_status", 1, initial).over(W.partitionBy("bid_id").orderBy("action_seq"))
    return actions.withColumn("previous_status", before)


def bid_status(actions: DataFrame) -> DataFrame:
    return actions.groupBy("bid_id").agg(F.max_by("new_status", "action_seq").alias("status"), F.count("*").alias("actions"))


def replay_tenders(actions: DataFrame) -> DataFrame:
    """Status after (tender_id, seq, action) in order; actions a status forbids change nothing."""
    steps = actions.groupBy("tender_id").agg(F.array_sort(F.collect_list(F.struct("seq", "action"))).alias("steps"))

    def step(status: Column, s: Column) -> Column:
        a = s["action"]
        done = status.isin("Awarded", "Closed")
        return (
            F.when((a == "publish") & (status == "Draft"), "Open")
            .when((a == "close") & (status == "Open"), "Closed")
            .when((a == "withdraw") & ~done, "Withdrawn")
            .when((a == "award") & status.isin("Open", "Closed"), "Awarded")
            .when((a == "remove") & status.isin("Draft", "Withdrawn"), "Removed")
            .otherwise(status)
        )

    return steps.select("tender_id", F.aggregate("steps", F.lit("Draft"), step).alias("status"), F.size("steps").alias("actions"))


#: Status by status and action; what is not named changes nothing.
LIFECYCLE = {
    "Draft": {"publish": "Open", "withdraw": "Withdrawn", "remove": "Removed"},
    "Open": {"close": "Closed", "withdraw": "Withdrawn", "award": "Awarded"},
    "Closed": {"award": "Awarded"},
    "Withdrawn": {"withdraw": "Withdrawn", "remove": "Removed"},
    "Awarded": {},
    "Removed": {"withdraw": "Withdrawn"},
}


def award_lifecycle(actions: DataFrame, bids: DataFrame, chunk: int = 4096) -> DataFrame:
    """(tender_id, status, awarded_bid, refused, actions) after (tender_id, seq, action, bid_id) in order; an award has to name a bid of its tender.

    Which awards do is known from a join before the fold.  A tender's actions are folded by chunks,
    ``chunk`` of their numbers wide, each for every status in which it may begin, so a tender with
    very many actions is many groups; of each chunk a list of six ends is left, and these are put in
    a row.
    """
    own = bids.select("tender_id", "bid_id", F.lit(True).alias("own")).distinct()
    checked = actions.join(own, ["tender_id", "bid_id"], "left")
    foreign = (F.col("action") == "award") & F.col("own").isNull()
    steps = checked.select("tender_id", "seq", F.when(foreign, "refused").otherwise(F.col("action")).alias("action"), F.when(F.col("action") == "award", F.col("bid_id")).alias("bid"), foreign.alias("foreign"))
    table = F.create_map(*[F.lit(x) for status, by in LIFECYCLE.items() for action, to in by.items() for x in (f"{status}:{action}", to)])
    after = lambda s, a: F.coalesce(F.try_element_at(table, F.concat_ws(":", s["status"], a["action"])), s["status"])

    def step(s: Column, a: Column) -> Column:
        to = after(s, a)
        won = (to == "Awarded") & (s["status"] != "Awarded")
        return F.struct(to.alias("status"), F.when(won, a["bid"]).otherwise(s["bid"]).alias("bid"))

    none = F.lit(None).cast("string")
    begin = lambda s: F.struct(s.alias("status"), none.alias("bid"))
    chunks = steps.groupBy("tender_id", F.floor(F.col("seq") / chunk).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("seq", "action", "bid"))).alias("steps"), F.count_if("foreign").alias("refused"), F.count("*").alias("actions"))
    ends = F.array(*[F.struct(F.lit(s).alias("from"), F.aggregate("steps", begin(F.lit(s)), step).alias("to")) for s in LIFECYCLE])
    chunks = chunks.select("tender_id", "chunk", ends.alias("ends"), "refused", "actions")
    rows = chunks.groupBy("tender_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "ends"))).alias("chunks"), F.sum("refused").alias("refused"), F.sum("actions").alias("actions"))

    def across(s: Column, c: Column) -> Column:
        to = F.element_at(F.filter(c["ends"], lambda e: e["from"] == s["status"]), 1)["to"]
        return F.struct(to["status"].alias("status"), F.coalesce(s["bid"], to["bid"]).alias("bid"))

    return rows.select("tender_id", F.aggregate("chunks", begin(F.lit("Draft")), across).alias("end"), "refused", "actions").select("tender_id", "end.status", F.col("end.bid").alias("awarded_bid"), "refused", "actions")


def signal_trend(bids: DataFrame, scores: DataFrame, date_col: str = "submission_date", unit: str = "month") -> DataFrame:
    """(period, low, medium, high, critical): bids per period by their bidder's band; periods without bids are there with zeros."""
    banded = bids.join(scores.select("bidder_id", "score"), "bidder_id", "left").select(F.trunc(F.to_date(date_col), unit).alias("period"), F.lower(portfolio_band(F.coalesce("score", F.lit(0)))).alias("band"))
    bands = ("low", "medium", "high", "critical")
    counts = banded.where("period IS NOT NULL").groupBy("period").pivot("band", list(bands)).count()
    ends = counts.agg(F.min("period").alias("a"), F.max("period").alias("b")).where("a IS NOT NULL")
    every = ends.select(F.explode(F.sequence("a", "b", F.expr(f"INTERVAL 1 {unit}"))).alias("period"))
    return every.join(counts, "period", "left").select("period", *[F.coalesce(b, F.lit(0)).cast("long").alias(b) for b in bands])


def registry_check(bidders: DataFrame, registry: DataFrame, left_on: str, right_on: str, good: Column, labels: tuple[str, str, str]) -> DataFrame:
    """(bidder_id, status): look up an upper-cased key; ``labels``: good, found but not good, absent."""
    one = registry.groupBy(F.upper(F.trim(right_on)).alias("key")).agg(F.bool_or(good).alias("good"))
    rows = bidders.join(one, F.upper(F.trim(left_on)) == F.col("key"), "left")
    return rows.select("bidder_id", F.when(F.col("key").isNull(), labels[2]).when(F.col("good"), labels[0]).otherwise(labels[1]).alias("status"))


def number_submissions(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Bidder ids of new submissions (company_name, seq): known names keep theirs, others count on.

    Names are compared in lower case without outer spaces; new ids follow the order in which the
    names were first submitted.
    """
    key = F.lower(F.trim("company_name"))
    known = existing.groupBy(key.alias("key")).agg(F.min("bidder_id").alias("bidder_id"))
    firsts = new.groupBy(key.alias("key")).agg(F.min("seq").alias("first_seq"))
    fresh = numbered(firsts.join(known, "key", "left_anti"), [F.col("first_seq"), F.col("key")], "place")
    top = existing.agg(F.coalesce(F.max(F.regexp_extract("bidder_id", r"(\d+)$", 1).cast("long")), F.lit(0)).alias("top")).first()["top"]
    made = fresh.select("key", F.concat(F.lit("B-"), (F.lit(top) + F.col("place")).cast("string")).alias("bidder_id"))
    ids = known.unionByName(made)
    return new.withColumn("key", key).join(ids, "key").drop("key").withColumn("status", F.lit("Needs Review"))
