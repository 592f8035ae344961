"""Views for case work: decorated bids, bid details, alerts, reports, registry checks, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidgraph.functions.clean import mask_account, mask_phone
from bidgraph.operators.portfolio import lowest_bids, portfolio_band, signal_label
from bidgraph.plans.storage import materialize

TOP_CODES = 4


def cluster_of(components: DataFrame, clusters: DataFrame) -> DataFrame:
    """(bidder_id, cluster_id) of (node, root) and (root, cluster_id)."""
    return components.join(clusters.select("root", "cluster_id"), "root").select(F.col("node").alias("bidder_id"), "cluster_id")


def decorated_bids(bids: DataFrame, bidders: DataFrame, scores: DataFrame, placed: DataFrame) -> DataFrame:
    """Bids with their bidder's name, score, band and cluster, and what is known of their files.

    A bid has the risk of its bidder; an unknown bidder is Unknown, 0 and Low.
    """
    known = bidders.select("bidder_id", F.col("company_name").alias("bidder_name"), "msme_status")
    rows = bids.join(known, "bidder_id", "left").join(scores.select("bidder_id", F.col("score").alias("risk_score")), "bidder_id", "left").join(placed, "bidder_id", "left")
    files = F.coalesce("submitted_documents", F.array().cast("array<string>"))
    pdf = F.transform(files, lambda f: F.lower(f).endswith(".pdf"))
    score = F.coalesce("risk_score", F.lit(0))
    return rows.select(
        "bid_id", "tender_id", "bidder_id", "bid_amount", "verification_status", "submission_date", F.coalesce("bidder_name", F.lit("Unknown")).alias("bidder_name"), F.coalesce("msme_status", F.lit("Unknown")).alias("msme_status"),
        score.alias("risk_score"), portfolio_band(score).alias("risk_category"), "cluster_id", F.size(files).alias("file_count"), F.exists(pdf, lambda x: x).alias("has_pdf"),
        F.try_element_at(F.filter(files, lambda f: F.lower(f).endswith(".pdf")), F.lit(1)).alias("first_pdf_name"), (F.array_position(pdf, True) - 1).cast("int").alias("first_pdf_index"),
    )


def bid_details(decorated: DataFrame, bidders: DataFrame, tenders: DataFrame, compared: DataFrame, evidence: DataFrame, edges: DataFrame) -> DataFrame:
    """Each bid with its masked bidder, tender, comparison with the requirements, evidence and number of related bidders."""
    contact = bidders.select("bidder_id", "director_name", mask_phone(F.col("phone")).alias("phone"), mask_account(F.col("bank_account")).alias("bank_account"))
    ends = edges.select(F.col("a").alias("bidder_id")).unionByName(edges.select(F.col("b").alias("bidder_id"))).groupBy("bidder_id").agg(F.count("*").alias("related_bidders"))
    rows = decorated.join(contact, "bidder_id", "left").join(tenders.select("tender_id", F.col("title").alias("tender_title"), F.col("status").alias("tender_status")), "tender_id", "left")
    rows = rows.join(compared.select("bid_id", "matched", "missing", "total", F.col("status").alias("comparison")), "bid_id", "left").join(evidence, "bidder_id", "left").join(ends, "bidder_id", "left")
    return rows.select(
        "bid_id", "tender_id", "tender_title", "tender_status", "bidder_id", "bidder_name", "director_name", "phone", "bank_account", "risk_score", "risk_category", "cluster_id",
        "matched", "missing", "total", "comparison", F.coalesce("codes", F.array().cast("array<string>")).alias("evidence"), F.coalesce("related_bidders", F.lit(0)).alias("related_bidders"),
    )


def related_bidders(edges: DataFrame, bidders: DataFrame) -> DataFrame:
    """(bidder_id, other_id, company_name, score, evidence, linkable): every edge from either end."""
    ways = edges.select(F.col("a").alias("bidder_id"), F.col("b").alias("other_id"), "score", "evidence", "linkable").unionByName(edges.select(F.col("b").alias("bidder_id"), F.col("a").alias("other_id"), "score", "evidence", "linkable"))
    names = bidders.select(F.col("bidder_id").alias("other_id"), "company_name")
    return ways.join(names, "other_id", "left").select("bidder_id", "other_id", F.coalesce("company_name", "other_id").alias("company_name"), "score", "evidence", "linkable")


def network_nodes(bidders: DataFrame, scores: DataFrame, placed: DataFrame) -> DataFrame:
    """Masked bidders with score, band and cluster."""
    rows = bidders.join(scores.select("bidder_id", "score"), "bidder_id", "left").join(placed, "bidder_id", "left")
    score = F.coalesce("score", F.lit(0))
    return rows.select("bidder_id", "company_name", mask_phone(F.col("phone")).alias("phone"), mask_account(F.col("bank_account")).alias("bank_account"), score.alias("risk_score"), portfolio_band(score).alias("risk_category"), "cluster_id")


def severity(score: Column) -> Column:
    return F.when(portfolio_band(score) == "Critical", "red").when(portfolio_band(score) == "High", "orange").otherwise("yellow")


def review_alerts(clusters: DataFrame, breakdown: DataFrame, scores: DataFrame, bids: DataFrame, bidders: DataFrame, placed: DataFrame, min_score: int = 50) -> DataFrame:
    """An alert per cluster and each of its first TOP_CODES codes, and one per bidder from ``min_score`` on.

    ``breakdown``: (root, code, place) of the codes of a cluster, strongest first.  A bidder's alert
    names the first bid by date and id.
    """
    codes = breakdown.where(F.col("place") <= TOP_CODES).join(clusters.select("root", "cluster_id", "members", "score"), "root")
    label = signal_label(F.col("code"))
    none = F.lit(None).cast("string")
    of_clusters = codes.select(
        F.concat_ws("-", F.lit("AL"), "cluster_id", "code").alias("alert_id"), severity(F.col("score")).alias("severity"), label.alias("title"),
        F.concat(label, F.lit(" detected across "), F.col("members").cast("string"), F.lit(" bidders. This is a review priority, not a finding of wrongdoing.")).alias("description"),
        "cluster_id", F.col("code").alias("signal_code"), F.col("score").alias("risk_score"), none.alias("bid_id"), none.alias("date"),
    )
    first = bids.groupBy("bidder_id").agg(F.min(F.struct("submission_date", "bid_id")).alias("first"))
    risky = scores.where(F.col("score") >= min_score).join(bidders.select("bidder_id", "company_name"), "bidder_id").join(first, "bidder_id", "left").join(placed, "bidder_id", "left")
    of_bidders = risky.select(
        F.concat(F.lit("AL-"), "bidder_id").alias("alert_id"), severity(F.col("score")).alias("severity"), F.concat(F.lit("Elevated relationship risk: "), "company_name").alias("title"),
        F.concat(F.lit("Scored "), F.col("score").cast("string"), F.lit("/100; manual verification required.")).alias("description"),
        "cluster_id", none.alias("signal_code"), F.col("score").alias("risk_score"), F.col("first.bid_id").alias("bid_id"), F.col("first.submission_date").alias("date"),
    )
    return of_clusters.unionByName(of_bidders)


def code_places(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(root, code, edges, place): the codes of a cluster's linkable edges by falling number of edges."""
    inside = edges.where("linkable").join(components.select(F.col("node").alias("a"), "root"), "a").select("root", F.explode("evidence").alias("code"))
    counted = inside.groupBy("root", "code").agg(F.count("*").alias("edges"))
    return counted.withColumn("place", F.row_number().over(W.partitionBy("root").orderBy(F.desc("edges"), "code")))  # at most a row per code in a cluster


def bid_distribution(decorated: DataFrame) -> DataFrame:
    """(risk_category, bids, mean_risk) of decorated bids."""
    return decorated.groupBy("risk_category").agg(F.count("*").alias("bids"), F.avg("risk_score").alias("mean_risk"))


def top_risk_bids(decorated: DataFrame, limit: int = 10) -> DataFrame:
    return decorated.orderBy(F.desc("risk_score"), "bid_id").limit(limit).select("bid_id", "bidder_name", "risk_score")


def verification_report(decorated: DataFrame) -> DataFrame:
    """(bid_id, bidder_name, status, risk_score, of_status): rows of the report with the number of bids of their status."""
    per = decorated.groupBy("verification_status").agg(F.count("*").alias("of_status"))
    return decorated.join(per, "verification_status").select("bid_id", "bidder_name", F.col("verification_status").alias("status"), "risk_score", "of_status")


def cluster_report(clusters: DataFrame, components: DataFrame, bidders: DataFrame) -> DataFrame:
    """A row per cluster and member, with the cluster's score, band and evidence."""
    members = components.join(bidders.select(F.col("bidder_id").alias("node"), "company_name"), "node", "left")
    return clusters.join(members, "root").select("cluster_id", F.col("score").alias("risk_score"), F.col("band").alias("risk_category"), "evidence", F.coalesce("company_name", "node").alias("member"))


def investigation_summary(clusters: DataFrame, actions: DataFrame, recent: int = 15) -> DataFrame:
    """Clusters, and the latest audit actions: (kind, id, text, score)."""
    found = clusters.select(F.lit("cluster").alias("kind"), F.col("cluster_id").alias("id"), F.array_join("evidence", ", ").alias("text"), F.col("score").cast("long").alias("score"))
    latest = actions.orderBy(F.desc("action_seq")).limit(recent)
    return found.unionByName(latest.select(F.lit("audit").alias("kind"), F.col("bid_id").alias("id"), F.col("new_status").alias("text"), F.col("action_seq").alias("score")))


def cluster_narratives(clusters: DataFrame) -> DataFrame:
    """(cluster_id, text): a sentence per cluster from its size, evidence and score."""
    text = F.concat("cluster_id", F.lit(" links "), F.col("members").cast("string"), F.lit(" bidders by "), F.array_join("evidence", ", "), F.lit("; its highest score is "), F.col("score").cast("string"), F.lit("."))
    return clusters.select("cluster_id", text.alias("text"))


def portfolio_totals(tenders: DataFrame, bids: DataFrame, scores: DataFrame, clusters: DataFrame, flagged_from: int = 50) -> DataFrame:
    """(name, n): tenders, bids, bidders, flagged bidders, clusters and the bidders in them."""
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    out = count(tenders, "tenders").unionByName(count(bids, "bids")).unionByName(count(scores, "bidders")).unionByName(count(scores.where(F.col("score") >= flagged_from), "flagged"))
    inside = clusters.agg(F.coalesce(F.sum("members"), F.lit(0)).alias("n")).select(F.lit("clustered").alias("name"), "n")
    return out.unionByName(count(clusters, "clusters")).unionByName(inside)


def search_tenders(tenders: DataFrame, text: str | None = None, status: str | None = None, category: str | None = None) -> DataFrame:
    """Tenders of a status and category with a text in id, title, department or category, in any case."""
    rows = tenders
    if text:
        hit = F.lit(False)
        for c in ("tender_id", "title", "department", "category"):
            hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False))
        rows = rows.where(hit)
    for column, value in (("status", status), ("category", category)):
        if value:
            rows = rows.where(F.lower(column) == value.lower())
    return rows


def counted_page(rows: DataFrame, order: list[Column], number: int, size: int = 20) -> DataFrame:
    """One page of a sorted list with the ``total`` number of its rows."""
    from bidgraph.operators.portfolio import page

    total = rows.agg(F.count("*").alias("total"))
    one = F.lit(1).alias("one")
    return page(rows, order, number, size).select(one, "*").join(total.select(one, "*"), "one").drop("one")


#: source: (column of the bidder, status of a good record, of another, of none).
REGISTRIES = {
    "gst": ("gst_number", "Verified", "Needs Review", "Not Found"),
    "company": ("company_name", "Verified", "Needs Review", "Not Found"),
    "msme": ("company_name", "Verified", "Not Registered", "Not Found"),
    "establishment": ("company_name", "Verified", "Needs Review", "Not Found"),
    "documents": ("company_name", "Verified", "Needs Review", "Not Found"),
    "blacklist": ("gst_number", "Clear", "Needs Review", "No Record"),
}


def registry_checks(bidders: DataFrame, records: DataFrame) -> DataFrame:
    """(bidder_id, source, status): all six lookups of each bidder in ``records`` (source, key, good), by upper-cased keys."""
    one = records.groupBy("source", F.upper(F.trim("key")).alias("key")).agg(F.bool_or("good").alias("good"))
    asked = F.array(*[F.struct(F.lit(s).alias("source"), F.upper(F.trim(c)).alias("key"), F.lit(yes).alias("yes"), F.lit(other).alias("other"), F.lit(no).alias("no")) for s, (c, yes, other, no) in REGISTRIES.items()])
    rows = bidders.select("bidder_id", F.explode(asked).alias("q")).select("bidder_id", "q.*")
    found = rows.join(one, ["source", "key"], "left")
    return found.select("bidder_id", "source", F.when(F.col("good").isNull(), F.col("no")).when(F.col("good"), F.col("yes")).otherwise(F.col("other")).alias("status"))


def award_check(tenders: DataFrame, bids: DataFrame) -> DataFrame:
    """(tender_id, bid_id, allowed): whether the bid that an award names is one of the tender's."""
    best = lowest_bids(bids).select("tender_id", "bid_id")
    return tenders.select("tender_id").join(best, "tender_id", "left").select("tender_id", "bid_id", F.col("bid_id").isNotNull().alias("allowed"))


def neighbours(edges: DataFrame) -> DataFrame:
    """(id, neighbour, edge_type, weight): every edge from either end."""
    out = edges.select(F.col("src").alias("id"), F.col("dst").alias("neighbour"), "edge_type", "weight")
    return out.unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("neighbour"), "edge_type", "weight"))


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both by key; the new row replaces an old one of its key, and old rows without one stay.

    Both tables have one row per key, as nodes have by id and edges by ends and type.
    """
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"))


def encoded_nodes(nodes: DataFrame, kinds: tuple[str, ...] = ("Company", "Person", "Tender", "Address", "Department")) -> DataFrame:
    """(id, node, type_code, one_hot): a dense number from 0 by id, and the type as a code and a 0/1 array."""
    from bidgraph.functions.ranks import numbered

    rows = numbered(nodes.select("id", "node_type"), [F.col("id"), F.col("node_type")], "place")
    code = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("node_type")) - 1
    hot = F.array(*[(F.col("node_type") == k).cast("int") for k in kinds])
    return rows.select("id", (F.col("place") - 1).alias("node"), code.cast("int").alias("type_code"), hot.alias("one_hot"))


def encoded_edges(edges: DataFrame, nodes: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(src_node, dst_node, type_code, weight) by the numbers of ``encoded_nodes``."""
    at = nodes.select("id", "node")
    rows = materialize(edges.join(at.withColumnsRenamed({"id": "src", "node": "src_node"}), "src").drop("src"), "encoded-sources")
    rows = rows.join(at.withColumnsRenamed({"id": "dst", "node": "dst_node"}), "dst")
    code = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("edge_type")) - 1
    return rows.select("src_node", "dst_node", code.cast("int").alias("type_code"), "weight")


def both_directions(encoded: DataFrame) -> DataFrame:
    """Encoded edges and their reverses, with the relation's number in either direction."""
    return encoded.unionByName(encoded.select(F.col("dst_node").alias("src_node"), F.col("src_node").alias("dst_node"), "type_code", "weight"))


def node_blocks(encoded: DataFrame, edges: DataFrame, features: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(id, node, x): the 0/1 type and a block of as many numbers as there are features.

    A company's block are its features (company, ...); another node has its degree, parallel edges
    counted, as a share of the largest in the first place and zeros behind it.
    """
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count("*").alias("degree"))
    ends = materialize(ends, "degrees")
    most = ends.agg(F.greatest(F.coalesce(F.max("degree"), F.lit(1)), F.lit(1)).alias("most")).withColumn("one", F.lit(1))
    block = F.array(*[F.col(c).cast("double") for c in columns])
    rows = encoded.join(ends, "id", "left").join(features.select(F.col("company").alias("id"), block.alias("block")), "id", "left").withColumn("one", F.lit(1)).join(most, "one")
    other = F.concat(F.array(F.coalesce("degree", F.lit(0)) / F.col("most")), F.array_repeat(F.lit(0.0), len(columns) - 1))
    return rows.select("id", "node", F.concat(F.col("one_hot").cast("array<double>"), F.coalesce("block", other)).alias("x"))


def json_documents(rows: DataFrame, key: str) -> DataFrame:
    """(id, data): rows as JSON texts."""
    return rows.select(F.col(key).alias("id"), F.to_json(F.struct(*rows.columns)).alias("data"))


def newest_first(documents: DataFrame, schema, newest: str, limit: int | None = None) -> DataFrame:
    """The fields of JSON documents, newest first, ties by id."""
    rows = documents.select("id", F.from_json("data", schema).alias("d")).select("d.*", "id").orderBy(F.desc(newest), "id").drop("id")
    return rows if limit is None else rows.limit(limit)
