"""Queries of the document jobs.

The documents are invented prose, so each gets a line of tender wording derived from its id.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from bidgraph.operators import documents as D
from bidgraph.plans.sql import CTE, with_tables
from bidgraph.plans.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

LINES = (
    "TENDER RFP for supply\nMinimum 3 years experience. Valid GST registration. PAN card required.",
    "Average annual turnover of Rs. 2.5 crore is mandatory. Udyam certificate. Closing 15/03/2024",
    "Delivery within 45 days. Bid validity of 90 days. EMD of Rs. 50,000. ISO 9001:2015. Opening 3 March 2024.",
    "Request for proposal 17\nOEM authorization shall be given. Work order and balance sheet.",
    "",
)


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _any(column: str, words) -> str:
    return " + ".join(f"CAST(contains({column}, '{w}') AS INTEGER)" for w in words)


CTE |= {
    "filed": "SELECT doc_id, CASE doc_id % 5 " + " ".join(f"WHEN {k} THEN {_lit(s)}" for k, s in enumerate(LINES)) + " END || chr(10) || coalesce(text, '') AS text FROM documents",
}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_tables(sql)
        return f

    return register


def filed(spark, folder):
    lead = F.element_at(F.array(*[F.lit(s) for s in LINES]), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, folder, "documents").select("doc_id", F.concat(lead, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"))


_NORMAL = r"lower(trim(regexp_replace(text, '\s+', ' ', 'g')))"


@query(f"SELECT doc_id, CASE WHEN text = '' THEN 'empty' WHEN {_any('low', D.PROCUREMENT_TERMS)} = 0 THEN 'wrong_document' ELSE 'success' END AS status FROM (SELECT doc_id, text, {_NORMAL} AS low FROM filed)")
def document_relevance(spark, folder):
    return filed(spark, folder).select("doc_id", D.relevance(F.col("text")).alias("status"))


def _kinds(column: str, kinds: dict[str, str]) -> str:
    listed = ", ".join(f"CASE WHEN regexp_matches({column}, '{p}') THEN '{k}' END" for k, p in kinds.items())
    return f"list_filter([{listed}], lambda x: x IS NOT NULL)"


_STRAY = "regexp_replace(text, '(^|[^A-Za-z])I([0-9])', '\\1\\2', 'g')"
_ELIGIBLE = {"experience": D.EXPERIENCE, "turnover": D.TURNOVER, "tax": D.TAX, "msme": D.MSME, "identity": D.IDENTITY}
_TECHNICAL = {"delivery": D.DELIVERY, "bid_validity": D.VALIDITY, "emd": D.EMD, "certification": D.ISO, "oem": D.OEM}


@query(f"SELECT doc_id, {_kinds('t', _ELIGIBLE)} AS eligibility, {_kinds('t', _TECHNICAL)} AS technical, regexp_extract(t, '{D.TURNOVER}', 1) AS turnover, regexp_matches(lower(t), 'mandatory|shall|must') AS mandatory FROM (SELECT doc_id, {_STRAY} AS t FROM filed)")
def requirements(spark, folder):
    kinds = lambda c: F.transform(c, lambda r: r["type"]).alias(c)
    found = filed(spark, folder).select("doc_id", D.clauses(F.col("text")).alias("c"))
    rows = found.select("doc_id", D.requirements_of(F.col("c")).alias("r"), F.regexp_extract("c.turnover", D.TURNOVER, 1).alias("turnover"), "c.mandatory")
    return rows.select("doc_id", "r.eligibility", "r.technical", "turnover", "mandatory").select("doc_id", kinds("eligibility"), kinds("technical"), "turnover", "mandatory")


@query("SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN contains(low, '{n}') THEN '{label}' END" for n, label in D.REQUIRED_DOCUMENTS) + f"], lambda x: x IS NOT NULL) AS documents FROM (SELECT doc_id, lower({_STRAY}) AS low FROM filed)")
def required_documents(spark, folder):
    return filed(spark, folder).select("doc_id", D.required_documents(F.col("text")).alias("documents"))


@query(f"SELECT doc_id, list_slice(regexp_extract_all({_STRAY}, '{D.DATES}', 1), 1, 20) AS dates FROM filed")
def important_dates(spark, folder):
    return filed(spark, folder).select("doc_id", D.important_dates(F.col("text")).alias("dates"))


_TITLED = r"list_filter(list_transform(string_split_regex(t, '\r\n|\n|\r'), lambda x: trim(x)), lambda x: length(x) BETWEEN 5 AND 140 AND regexp_matches(lower(x), 'tender|request for proposal|rfp'))[1]"


@query(f"SELECT doc_id, coalesce({_TITLED}, '{D.DEFAULT_TITLE}') AS title FROM (SELECT doc_id, {_STRAY} AS t FROM filed)")
def tender_titles(spark, folder):
    return filed(spark, folder).select("doc_id", D.tender_title(F.col("text")).alias("title"))


@query("SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN {_any('low', n)} > 0 THEN '{label}' END" for label, n in D.DETECTED_DOCUMENTS.items()) + f"], lambda x: x IS NOT NULL) AS documents, CASE WHEN n < 40 OR {_any('normal', D.RELEVANCE_TERMS)} = 0 THEN 'wrong_document' ELSE 'valid' END AS status FROM (SELECT doc_id, lower(text) AS low, {_NORMAL} AS normal, length(regexp_replace(text, '\\s+', '', 'g')) AS n FROM filed)")
def document_validation(spark, folder):
    t = F.col("text")
    return filed(spark, folder).select("doc_id", D.detected_documents(t).alias("documents"), D.document_status(t).alias("status"))


@query()
def combined_requirements(spark, folder):
    docs = filed(spark, folder)
    keys = docs.select("doc_id", F.concat(F.lit("T"), F.floor(F.col("doc_id") / 4).cast("string")).alias("tender_id"))
    return D.combine(D.extract(docs), keys)


@query()
def eligibility(spark, folder):
    """Every document's requirements against a bidder made from the document's id."""
    docs = D.extract(filed(spark, folder))
    k = F.col("doc_id")
    tenders = docs.select(k.cast("string").alias("tender_id"), F.col("eligibility").alias("requirements"), "documents")
    bidder = docs.select(
        k.cast("string").alias("tender_id"), F.concat(F.lit("B-"), k.cast("string")).alias("bidder_id"), F.when(k % 3 > 0, (k % 9).cast("double")).alias("years_experience"), F.when(k % 4 > 0, k.cast("double")).alias("turnover"),
        F.when(k % 2 == 0, "27ABCDE1234F1Z5").alias("gstin"), F.when(k % 3 == 0, "ABCDE1234F").alias("pan"), F.lit(None).cast("string").alias("udyam"), F.slice("documents", 1, (k % 3).cast("int")).alias("documents"),
    )
    return D.eligibility(tenders, bidder).drop("checks")
