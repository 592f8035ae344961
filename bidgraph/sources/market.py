"""Bids, tenders, bidders and actions derived from the order tables.

A line of an order is a bid, its supplier the bidder, the order the tender.  Names and addresses
come in several spellings and a fifth of the lines uses a second raw company id, so that entity
resolution has work to do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidgraph.plans.tables import table

NAME_ENDS = (" Pvt. Ltd.", " PRIVATE LIMITED", " LLP", "")


#: Of ringed lines in SQL: every second order is bid for by one of 20 rings of four suppliers, the others by 20 suppliers outside of them.
_RING, _LED = "(l_orderkey // 2) % 20", "(l_orderkey // 2) % 20 % 5 = 0"
RINGED = f"""(SELECT * REPLACE (
  CASE WHEN l_orderkey % 2 = 1 THEN 80 + l_suppkey % 20 WHEN NOT {_LED} THEN {_RING} * 4 + l_linenumber % 4 WHEN l_linenumber % 2 = 1 THEN {_RING} * 4 ELSE {_RING} * 4 + 1 + (l_linenumber // 2) % 3 END AS l_suppkey,
  CASE WHEN l_orderkey % 2 = 0 AND {_LED} AND l_linenumber % 2 = 1 THEN 0.8 ELSE l_discount END AS l_discount) FROM lineitem)"""


def ringed(lines: DataFrame) -> DataFrame:
    """Lines of a market with bidding rings; in every fifth ring one member has the lowest price by far."""
    order, line = F.col("l_orderkey"), F.col("l_linenumber")
    ring = F.floor(order / 2) % 20
    led, inside = ring % 5 == 0, order % 2 == 0
    leads = led & (line % 2 == 1)
    member = F.when(~led, line % 4).when(leads, 0).otherwise(1 + F.floor(line / 2) % 3)
    return lines.withColumns({"l_suppkey": F.when(inside, ring * 4 + member).otherwise(80 + F.col("l_suppkey") % 20).cast("long"), "l_discount": F.when(inside & leads, 0.8).otherwise(F.col("l_discount"))})


def bid_feed(spark: SparkSession, folder: str, lines: DataFrame | None = None) -> DataFrame:
    """Typed bid records with ``row_seq``, the order of the feed: a number, so that first and last rows need no sort.

    It is made of the order and the place of the line in it, for up to 2^24 lines an order.
    ``lines`` stand in for the order lines.
    """
    t = lambda name: table(spark, folder, name)
    lines = (t("lineitem") if lines is None else lines).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    lines = lines.join(t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")), F.col("l_suppkey") == F.col("s_suppkey"))
    lines = lines.withColumns({"bid_amount": F.col("p_retailprice") * (1 - F.col("l_discount")), "label": F.when(F.col("s_acctbal") >= 8000, 1).when(F.col("s_acctbal") < 6000, 0)})
    # The orders come last and places are counted by order, so the rows are dealt out once for both, before any text is made.
    lines = lines.join(t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
    of_tender = W.partitionBy("l_orderkey")
    place = F.row_number().over(of_tender.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"))
    lines = lines.withColumn("row_seq", F.shiftleft(F.col("l_orderkey").cast("long"), 24) + place)
    lines = lines.withColumn("cheapest", F.row_number().over(of_tender.orderBy("bid_amount", "row_seq")) == 1)
    k = F.col("l_suppkey")
    end = F.element_at(F.array(*[F.lit(e) for e in NAME_ENDS]), (k % 4 + 1).cast("int"))
    return lines.select(
        F.concat(F.lit("S"), k.cast("string"), F.when(F.col("l_linenumber") % 5 == 4, "-B").otherwise("")).alias("company_id"),
        F.concat("s_name", end).alias("company_name"),
        F.concat(F.lit("P"), (k % 40).cast("string")).alias("person_id"),
        F.concat(F.lit("Dr. Officer "), (k % 40).cast("string")).alias("person_name"),
        F.concat(F.lit("T"), F.col("l_orderkey").cast("string")).alias("tender_id"),
        F.concat(F.lit("D-"), "c_mktsegment").alias("department_id"),
        F.col("c_mktsegment").alias("department_name"),
        F.concat(F.col("s_nationkey").cast("string"), F.when(k % 2 == 0, " M.G. Rd., ").otherwise(" MG Road "), "n_name").alias("address"),
        "bid_amount",
        F.col("p_retailprice").alias("tender_value"),
        F.col("l_shipdate").cast("date").alias("bid_date"),
        "label",
        "l_orderkey",
        k.alias("supplier"),
        F.col("l_quantity").alias("quantity"),
        "row_seq",
        F.when(F.col("cheapest"), "Awarded").otherwise("Rejected").alias("result"),
    )


def bidders(spark: SparkSession, folder: str) -> DataFrame:
    """One row per supplier, with contact fields that some of them share."""
    k = F.col("s_suppkey")
    s = table(spark, folder, "supplier").join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(
        F.concat(F.lit("B-"), k.cast("string")).alias("bidder_id"),
        F.col("s_name").alias("company_name"),
        F.concat(F.lit("Officer "), (k % 40).cast("string")).alias("director_name"),
        F.concat(F.col("s_nationkey").cast("string"), F.lit(" MG Road "), "n_name").alias("address"),
        F.when(k % 7 == 0, F.concat(F.lit("98000"), F.lpad((k % 21).cast("string"), 5, "0"))).when(k % 7 == 1, "  ").otherwise(F.concat(F.lit("97000"), F.lpad(k.cast("string"), 5, "0"))).alias("phone"),
        F.when(k % 11 == 0, F.concat(F.lit("0011"), F.lpad((k % 33).cast("string"), 8, "0"))).otherwise(F.concat(F.lit("0022"), F.lpad(k.cast("string"), 8, "0"))).alias("bank_account"),
        F.when(k % 5 == 4, "not-a-gst").otherwise(F.concat(F.lpad((k % 30).cast("string"), 2, "0"), F.lit("ABCDE"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("F1Z5"))).alias("gst_number"),
        F.when(k % 6 == 5, "bad").otherwise(F.concat(F.lit("ABCDE"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("F"))).alias("pan_number"),
        F.when(k % 3 == 0, "Yes").otherwise("No").alias("msme_status"),
        F.col("s_acctbal").alias("balance"),
    )


def submissions(spark: SparkSession, folder: str) -> DataFrame:
    """One bid row per order line, in the shape of the bid collection."""
    lines = table(spark, folder, "lineitem").join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    n = F.col("l_linenumber")
    files = F.array(F.lit("gst_registration.pdf"), F.lit("pan_copy.pdf"), F.lit("work order.docx"), F.lit("balance_sheet.pdf"), F.lit("emd.pdf"))
    return lines.select(
        F.concat_ws("-", F.lit("BID"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("bid_id"),
        F.concat(F.lit("T"), F.col("l_orderkey").cast("string")).alias("tender_id"),
        F.concat(F.lit("B-"), F.col("l_suppkey").cast("string")).alias("bidder_id"),
        F.col("p_brand").alias("category"),
        (F.col("p_retailprice") * (1 - F.col("l_discount"))).alias("bid_amount"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("submission_date"),
        F.when(F.col("l_returnflag") == "A", "Verified").when(F.col("l_returnflag") == "R", "Needs Review").otherwise("Flagged").alias("verification_status"),
        F.when(n % 4 == 0, F.array().cast("array<string>")).otherwise(F.slice(files, 1, n % 5 + 1)).alias("submitted_documents"),
    )


def tenders(spark: SparkSession, folder: str) -> DataFrame:
    """One tender per order."""
    orders = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = F.col("o_orderkey")
    wanted = F.array(F.lit("GST certificate"), F.lit("PAN card"), F.lit("Work order"), F.lit("Udyam/MSME certificate"), F.lit("EMD / Bid Security proof"))
    return orders.select(
        F.concat(F.lit("T"), o.cast("string")).alias("tender_id"),
        F.concat(F.lit("Supply "), "o_orderpriority").alias("title"),
        F.col("c_mktsegment").alias("department"),
        F.col("o_orderpriority").alias("category"),
        F.when(F.col("o_orderstatus") == "O", "Open").when(F.col("o_orderstatus") == "F", "Closed").otherwise("Awarded").alias("status"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("deadline"),
        F.col("o_totalprice").alias("estimated_value"),
        F.slice(wanted, 1, (o % 5 + 1).cast("int")).alias("required_documents"),
    )


#: The same derivations in SQL, as named parts of a WITH clause.
CTE: dict[str, str] = {
    "feed": """
      SELECT 'S' || l_suppkey || CASE WHEN l_linenumber % 5 = 4 THEN '-B' ELSE '' END AS company_id,
        s_name || CASE l_suppkey % 4 WHEN 0 THEN ' Pvt. Ltd.' WHEN 1 THEN ' PRIVATE LIMITED' WHEN 2 THEN ' LLP' ELSE '' END AS company_name,
        'P' || (l_suppkey % 40) AS person_id, 'Dr. Officer ' || (l_suppkey % 40) AS person_name, 'T' || l_orderkey AS tender_id,
        'D-' || c_mktsegment AS department_id, c_mktsegment AS department_name,
        s_nationkey || CASE WHEN l_suppkey % 2 = 0 THEN ' M.G. Rd., ' ELSE ' MG Road ' END || n_name AS address,
        p_retailprice * (1 - l_discount) AS bid_amount, p_retailprice AS tender_value, CAST(l_shipdate AS DATE) AS bid_date,
        CASE WHEN s_acctbal >= 8000 THEN 1 WHEN s_acctbal < 6000 THEN 0 END AS label,
        {'l_orderkey': l_orderkey, 'l_linenumber': l_linenumber, 'l_partkey': l_partkey, 'l_suppkey': l_suppkey, 'l_extendedprice': l_extendedprice, 'l_shipdate': l_shipdate} AS row_seq, l_suppkey AS supplier, l_quantity AS quantity
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey JOIN nation ON s_nationkey = n_nationkey
        JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""",
    "bids": """
      SELECT *, CASE WHEN row_number() OVER (PARTITION BY tender_id ORDER BY bid_amount, row_seq) = 1 THEN 'Awarded' ELSE 'Rejected' END AS result FROM feed""",
    "bidders": """
      SELECT 'B-' || s_suppkey AS bidder_id, s_name AS company_name, 'Officer ' || (s_suppkey % 40) AS director_name,
        s_nationkey || ' MG Road ' || n_name AS address,
        CASE WHEN s_suppkey % 7 = 0 THEN '98000' || lpad(CAST(s_suppkey % 21 AS VARCHAR), 5, '0') WHEN s_suppkey % 7 = 1 THEN '  ' ELSE '97000' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') END AS phone,
        CASE WHEN s_suppkey % 11 = 0 THEN '0011' || lpad(CAST(s_suppkey % 33 AS VARCHAR), 8, '0') ELSE '0022' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') END AS bank_account,
        CASE WHEN s_suppkey % 5 = 4 THEN 'not-a-gst' ELSE lpad(CAST(s_suppkey % 30 AS VARCHAR), 2, '0') || 'ABCDE' || lpad(CAST(s_suppkey % 10000 AS VARCHAR), 4, '0') || 'F1Z5' END AS gst_number,
        CASE WHEN s_suppkey % 6 = 5 THEN 'bad' ELSE 'ABCDE' || lpad(CAST(s_suppkey % 10000 AS VARCHAR), 4, '0') || 'F' END AS pan_number,
        CASE WHEN s_suppkey % 3 = 0 THEN 'Yes' ELSE 'No' END AS msme_status, s_acctbal AS balance
      FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "submissions": """
      SELECT 'BID-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS bid_id, 'T' || l_orderkey AS tender_id, 'B-' || l_suppkey AS bidder_id,
        p_brand AS category, p_retailprice * (1 - l_discount) AS bid_amount, strftime(l_shipdate, '%Y-%m-%d') AS submission_date,
        CASE l_returnflag WHEN 'A' THEN 'Verified' WHEN 'R' THEN 'Needs Review' ELSE 'Flagged' END AS verification_status,
        CASE WHEN l_linenumber % 4 = 0 THEN [] ELSE list_slice(['gst_registration.pdf', 'pan_copy.pdf', 'work order.docx', 'balance_sheet.pdf', 'emd.pdf'], 1, l_linenumber % 5 + 1) END AS submitted_documents
      FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "tenders": """
      SELECT 'T' || o_orderkey AS tender_id, 'Supply ' || o_orderpriority AS title, c_mktsegment AS department, o_orderpriority AS category,
        CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Closed' ELSE 'Awarded' END AS status, strftime(o_orderdate, '%Y-%m-%d') AS deadline,
        o_totalprice AS estimated_value,
        list_slice(['GST certificate', 'PAN card', 'Work order', 'Udyam/MSME certificate', 'EMD / Bid Security proof'], 1, CAST(o_orderkey % 5 + 1 AS INTEGER)) AS required_documents
      FROM orders JOIN customer ON o_custkey = c_custkey""",
}
