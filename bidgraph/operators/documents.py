"""Text jobs on tender and bidder documents: classes, requirements, checks.

All are column expressions over whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidgraph.functions.clean import once

# Terms, needles and labels.
PROCUREMENT_TERMS = (
    "tender", "request for proposal", "rfp", "bid", "bidder", "procurement", "government", "quotation", "eligibility", "gst", "pan",
    "udyam", "msme", "emd", "experience", "turnover", "work order", "certificate", "contract", "purchase order", "delivery", "technical specification",
)
RELEVANCE_TERMS = (
    "gst", "pan", "udyam", "msme", "certificate", "registration", "turnover", "experience", "work order", "balance sheet", "financial statement", "iso",
    "oem", "authorization", "bid", "tender", "procurement", "company", "incorporation", "emd", "bid security", "contract", "purchase order",
)
REQUIRED_DOCUMENTS = (
    ("gst", "GST certificate"), ("pan", "PAN card"), ("udyam", "Udyam/MSME certificate"), ("experience certificate", "Experience certificate"), ("work order", "Work order"),
    ("financial statement", "Financial statement"), ("balance sheet", "Balance sheet"), ("incorporation", "Certificate of incorporation"), ("emd", "EMD / Bid Security proof"),
    ("authorization", "Authorization / OEM certificate"), ("iso", "ISO certificate"),
)
DETECTED_DOCUMENTS = {
    "GST certificate": ("gst registration", "gstin", "goods and services tax"),
    "PAN card": ("pan card", "pan number", "permanent account number"),
    "Udyam/MSME certificate": ("udyam", "msme"),
    "Experience certificate": ("experience certificate", "years of relevant experience"),
    "Work order": ("work order",),
    "Financial statement": ("financial statement", "turnover"),
    "Balance sheet": ("balance sheet",),
    "Certificate of incorporation": ("certificate of incorporation", "incorporation"),
    "EMD / Bid Security proof": ("emd", "bid security"),
    "Authorization / OEM certificate": ("oem authorization", "oem certificate", "manufacturer authorization"),
    "ISO certificate": ("iso 9001", "iso certificate"),
}
# Patterns of requirements and clauses (digits are matched, and the shortest lead-in).
EXPERIENCE = r"(?i)(?:minimum|min\.?)[^.\n]{0,80}?([0-9]+)\s*years?[^.\n]{0,80}(?:experience|work)"
TURNOVER = r"(?i)(?:turnover|average annual turnover)[^.\n]{0,80}?(?:rs\.?|₹|I|■)?\s*([0-9][0-9,]*(?:\.[0-9]+)?)\s*(crore|lakh|million)?"
TAX = r"(?i)(?:gst|goods and services tax)[^.\n]{0,80}(?:registration|registered)"
MSME = r"(?i)(?:udyam|msme)[^.\n]{0,80}(?:registration|certificate)"
IDENTITY = r"(?i)(?:pan)[^.\n]{0,80}(?:card|number|details)"
DELIVERY = r"(?i)(?:delivery|completion)[^.\n]{0,100}(?:within|in)\s+([0-9]+)\s*(days?|weeks?|months?)"
VALIDITY = r"(?i)(?:bid validity|validity of bid)[^.\n]{0,80}?([0-9]+)\s*(days?|months?)"
EMD = r"(?i)(?:emd|earnest money deposit)[^.\n]{0,80}?(?:rs\.?|₹|I|■)?\s*([0-9][0-9,]*(?:\.[0-9]+)?)\s*(lakh|crore)?"
ISO = r"(?i)(?:iso)[^.\n]{0,60}(9001|14001|45001)"
OEM = r"(?i)(?:oem|original equipment manufacturer)[^.\n]{0,80}(?:authorization|certificate)"
DATES = r"(?i)\b([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}|[0-9]{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+[0-9]{4})\b"
DEFAULT_TITLE = "Extracted Tender"


def _hits(low: Column, terms: tuple[str, ...]) -> Column:
    total = F.lit(0)
    for t in terms:
        total = total + F.contains(low, F.lit(t)).cast("int")
    return total


def _normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def relevance(text: Column) -> Column:
    """empty, wrong_document (no procurement term) or success."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text == "", "empty").when(once(_normal(text), lambda low: _hits(low, PROCUREMENT_TERMS)) == 0, "wrong_document").otherwise("success")


def without_stray_i(text: Column) -> Column:
    """An I that stands for a currency sign before a digit is dropped."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(^|[^A-Za-z])I([0-9])", "$1$2")


def _where(low: Column, marks: tuple[str, ...], text: Column, pattern: str) -> Column:
    """What the pattern matches in the text, '' for nothing; only texts with one of its lead words are searched."""
    held = F.lit(False)
    for m in marks:
        held = held | F.contains(low, F.lit(m))
    return F.when(held, F.regexp_extract(text, pattern, 0)).otherwise("")


def _part(match: Column, pattern: str, group: int) -> Column:
    """A group of a match; the pattern looks at nothing outside it, so it matches there again alike."""
    return F.regexp_extract(match, pattern, group)


#: (kind, lead words, pattern, description of the match) of each requirement.
ELIGIBILITY = (
    ("experience", ("min",), EXPERIENCE, lambda m: F.concat(F.lit("Minimum "), _part(m, EXPERIENCE, 1), F.lit(" years experience"))),
    ("turnover", ("turnover",), TURNOVER, lambda m: F.concat_ws(" ", F.lit("Minimum turnover"), _part(m, TURNOVER, 1), _part(m, TURNOVER, 2))),
    ("tax", ("gst", "goods and services tax"), TAX, lambda m: F.lit("Valid GST registration")),
    ("msme", ("udyam", "msme"), MSME, lambda m: F.lit("Udyam/MSME registration information")),
    ("identity", ("pan",), IDENTITY, lambda m: F.lit("PAN information")),
)
TECHNICAL = (
    ("delivery", ("delivery", "completion"), DELIVERY, lambda m: F.concat_ws(" ", F.lit("Delivery/completion within"), _part(m, DELIVERY, 1), _part(m, DELIVERY, 2))),
    ("bid_validity", ("bid validity", "validity of bid"), VALIDITY, lambda m: F.concat_ws(" ", F.lit("Bid validity:"), _part(m, VALIDITY, 1), _part(m, VALIDITY, 2))),
    ("emd", ("emd", "earnest money deposit"), EMD, lambda m: F.concat_ws(" ", F.lit("EMD / Bid Security:"), _part(m, EMD, 1), _part(m, EMD, 2))),
    ("certification", ("iso",), ISO, lambda m: F.concat(F.lit("ISO "), _part(m, ISO, 1), F.lit(" certification"))),
    ("oem", ("oem", "original equipment manufacturer"), OEM, lambda m: F.lit("OEM authorization/certificate required")),
)


def _requirements(found: Column, rules: tuple, must: Column) -> Column:
    listed = [F.when(found[kind] != "", F.struct(F.trim(said(found[kind])).alias("requirement"), F.lit(kind).alias("type"), must.alias("mandatory"))) for kind, _, _, said in rules]
    return F.array_compact(F.array(*listed))


def clauses(text: Column) -> Column:
    """Struct of a text's match of each pattern and of ``mandatory``; the text is cleaned once and searched once a pattern."""

    def search(t: Column) -> Column:
        def matches(low: Column) -> Column:
            found = [_where(low, marks, t, pattern).alias(kind) for kind, marks, pattern, _ in ELIGIBILITY + TECHNICAL]
            return F.struct(*found, low.rlike("mandatory|shall|must").alias("mandatory"))

        return once(F.lower(t), matches)

    return once(without_stray_i(text), search)


def requirements_of(found: Column) -> Column:
    """(eligibility, technical): the requirements of ``clauses``."""
    both = (_requirements(found, rules, found["mandatory"]).alias(name) for name, rules in (("eligibility", ELIGIBILITY), ("technical", TECHNICAL)))
    return F.struct(*both)


def eligibility_requirements(text: Column) -> Column:
    return once(clauses(text), lambda c: _requirements(c, ELIGIBILITY, c["mandatory"]))


def technical_requirements(text: Column) -> Column:
    return once(clauses(text), lambda c: _requirements(c, TECHNICAL, c["mandatory"]))


def required_documents(text: Column) -> Column:
    listed = lambda low: F.array_compact(F.array(*[F.when(F.contains(low, F.lit(n)), F.lit(label)) for n, label in REQUIRED_DOCUMENTS]))
    return once(F.lower(without_stray_i(text)), listed)


def important_dates(text: Column) -> Column:
    return F.slice(F.regexp_extract_all(without_stray_i(text), F.lit(DATES), 1), 1, 20)


def tender_title(text: Column) -> Column:
    lines = F.transform(F.split(without_stray_i(text), r"\r\n|\n|\r"), F.trim)
    named = F.filter(lines, lambda x: F.length(x).between(5, 140) & F.lower(x).rlike("tender|request for proposal|rfp"))
    return F.coalesce(F.try_element_at(named, F.lit(1)), F.lit(DEFAULT_TITLE))


def detected_documents(text: Column) -> Column:
    def listed(low: Column) -> Column:
        found = []
        for label, needles in DETECTED_DOCUMENTS.items():
            held = F.lit(False)
            for n in needles:
                held = held | F.contains(low, F.lit(n))
            found.append(F.when(held, F.lit(label)))
        return F.array_compact(F.array(*found))

    return once(F.lower(F.coalesce(text, F.lit(""))), listed)


def document_status(text: Column) -> Column:
    """valid, or wrong_document for under 40 characters besides space or no business term."""
    text = F.coalesce(text, F.lit(""))
    short = F.length(F.regexp_replace(text, r"\s+", "")) < 40
    return F.when(short | (once(_normal(text), lambda low: _hits(low, RELEVANCE_TERMS)) == 0), "wrong_document").otherwise("valid")


def extract(docs: DataFrame, text_col: str = "text") -> DataFrame:
    t = F.col(text_col)
    rows = docs.select("doc_id", relevance(t).alias("status"), tender_title(t).alias("title"), clauses(t).alias("c"), required_documents(t).alias("documents"), important_dates(t).alias("dates"))
    return rows.select("doc_id", "status", "title", requirements_of(F.col("c")).alias("r"), "documents", "dates").select("doc_id", "status", "title", "r.eligibility", "r.technical", "documents", "dates")


def eligibility(tenders: DataFrame, bidders: DataFrame) -> DataFrame:
    """(tender_id, bidder_id, status, score): self-declared data against requirements.

    ``tenders``: (tender_id, requirements array of (requirement, type), documents);  ``bidders``:
    (tender_id, bidder_id, years_experience, turnover, gstin, pan, udyam, documents).
    """
    rows = bidders.withColumnRenamed("documents", "supplied").join(tenders, "tender_id")
    given = lambda c: F.coalesce(F.col(c) != "", F.lit(False))

    def one(r: Column) -> Column:
        least = F.regexp_extract(r["requirement"], r"([0-9]+)", 1).try_cast("double")
        years = F.when(F.coalesce(F.col("years_experience") >= least, F.lit(False)), "pass").when(F.col("years_experience").isNull(), "missing").otherwise("needs_review")
        kind = r["type"]
        return (
            F.when(kind == "experience", years)
            .when(kind == "turnover", F.when(F.coalesce(F.col("turnover") > 0, F.lit(False)), "pass").otherwise("needs_review"))
            .when(kind == "tax", F.when(given("gstin"), "pass").otherwise("missing"))
            .when(kind == "identity", F.when(given("pan"), "pass").otherwise("missing"))
            .when(kind == "msme", F.when(given("udyam"), "pass").otherwise("needs_review"))
        )

    low = F.transform(F.coalesce("supplied", F.array().cast("array<string>")), lambda d: F.lower(F.trim(d)))
    listed = F.transform("documents", lambda d: F.when(F.array_contains(low, F.lower(d)), "pass").otherwise("missing"))
    rows = rows.select("tender_id", "bidder_id", F.concat(F.array_compact(F.transform("requirements", one)), listed).alias("checks"))
    has = lambda s: F.exists("checks", lambda c: c == s)
    status = F.when(has("missing"), "Needs Documents").when(has("needs_review") | (F.size("checks") == 0), "Needs Review").otherwise("Pre-check Passed")
    passed = F.size(F.filter("checks", lambda c: c == "pass"))
    score = F.when(F.size("checks") > 0, F.round(100 * passed / F.size("checks"), 1)).otherwise(0.0)
    return rows.select("tender_id", "bidder_id", status.alias("status"), score.alias("score"), "checks")


def combine(extracted: DataFrame, keys: DataFrame) -> DataFrame:
    """Per tender of (tender_id, doc_id): distinct required documents and dates, first eight requirements."""
    rows = keys.join(extracted, "doc_id")
    merged = rows.groupBy("tender_id").agg(F.flatten(F.array_sort(F.collect_list(F.struct("doc_id", "eligibility")))["eligibility"]).alias("all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("documents")))).alias("documents"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("dates")))).alias("dates"))
    return merged.select("tender_id", F.size("all").alias("n_requirements"), F.transform(F.slice("all", 1, 8), lambda r: r["requirement"]).alias("summary"), "documents", "dates")
