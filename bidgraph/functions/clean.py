"""Column functions: parsing, cleaning, keys, formats and masks.

All but the accent folding of non-ASCII names are built-in expressions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidgraph.functions.settings import ADDRESS_ABBREVIATIONS, LEGAL_SUFFIXES, LOSS_TOKENS, NEGATIVE_LABELS, PERSON_TITLES, POSITIVE_LABELS, WIN_TOKENS

DATE_FORMATS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "y-M-d"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-y"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/y"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/y"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "y/M/d"),
)
# Formats of tax and account numbers.
GST = r"^\d{2}[A-Z]{5}\d{4}[A-Z]{1}[A-Z\d]{1}Z[A-Z\d]{1}$"
PAN = r"^[A-Z]{5}\d{4}[A-Z]{1}$"


def once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def identifier(c: Column) -> Column:
    """Trimmed identifier, null where it is missing."""
    t = F.trim(c)
    return F.when(~t.isin("", "nan", "None", "NaN"), t)


def blank_to_null(c: Column) -> Column:
    t = F.trim(c)
    return F.when(~F.lower(t).isin("", "nan", "none", "null"), t)


def money_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[,$₹]", ""))


def parse_money(c: Column) -> Column:
    """Amount as double; null for blank, NaN or unparsable text."""
    t = money_text(c)
    return F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))


def money_error(c: Column) -> Column:
    """True where text is given but is no amount, or a negative one."""
    t = money_text(c)
    given = t.isNotNull() & ~F.lower(t).isin("", "nan")
    return F.coalesce(given & (parse_money(c).isNull() | (parse_money(c) < 0)), F.lit(False))


def parse_date(c: Column) -> Column:
    """The first of five formats that fits, day before month; else the date of an ISO timestamp."""
    t = F.trim(c)
    tried = [F.when(t.rlike(p), F.try_to_timestamp(t, F.lit(f)).cast("date")) for p, f in DATE_FORMATS]
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]"), F.try_to_timestamp(t).cast("date"))
    return F.coalesce(*tried, iso)


def date_error(c: Column) -> Column:
    return F.coalesce(blank_to_null(c).isNotNull() & parse_date(c).isNull(), F.lit(False))


def parse_label(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when(t.isin(*POSITIVE_LABELS), 1).when(t.isin(*NEGATIVE_LABELS), 0)


def label_error(c: Column) -> Column:
    return F.coalesce(blank_to_null(c).isNotNull() & parse_label(c).isNull(), F.lit(False))


def is_winner(result: Column) -> Column:
    return F.coalesce(F.lower(F.trim(result)).isin(*WIN_TOKENS), F.lit(False))


def is_known_loser(result: Column) -> Column:
    return F.coalesce(F.lower(F.trim(result)).isin(*LOSS_TOKENS), F.lit(False))


def is_gst(c: Column) -> Column:
    return F.coalesce(c.rlike(GST), F.lit(False))


def is_pan(c: Column) -> Column:
    return F.coalesce(c.rlike(PAN), F.lit(False))


def mask_account(c: Column) -> Column:
    return F.when(F.length(c) <= 4, c).otherwise(F.concat(F.lit("XXXX XXXX "), F.right(c, F.lit(4))))


def mask_phone(c: Column) -> Column:
    return F.when(F.length(c) <= 4, c).otherwise(F.concat(F.left(c, F.lit(2)), F.lit("XXXXXX"), F.right(c, F.lit(2))))


def has_document_signature(filename: Column, content_base64: Column) -> Column:
    """First bytes of an upload fit its extension: pdf, docx or doc."""
    head = F.hex(F.substring(F.try_to_binary(content_base64, F.lit("base64")), 1, 8))
    name = F.lower(filename)
    fits = F.when(name.endswith(".pdf"), head.startswith("255044462D")).when(name.endswith(".docx"), head.startswith("504B")).when(name.endswith(".doc"), head == "D0CF11E0A1B11AE1")
    return F.coalesce(fits, F.lit(False))


def document_fingerprint(content_base64: Column) -> Column:
    """SHA-256 of the decoded content, a ``data:`` prefix dropped."""
    return F.sha2(F.try_to_binary(F.regexp_replace(content_base64, "^data:[^,]*,", ""), F.lit("base64")), 256)


def person_slug(name: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(slug != "", F.concat(F.lit("PER-"), slug))


def base_clean(c: Column) -> Column:
    """Lower case; dots and apostrophes dropped; other marks to single spaces."""
    t = F.regexp_replace(F.lower(c), "[.’']", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9\s]+", " "), r"\s+", " "))


@F.pandas_udf(T.StringType())
def _fold(texts: pd.Series) -> pd.Series:
    folded = texts.str.normalize("NFKD")
    return folded.str.replace("[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯]", "", regex=True)


def fold_accents(c: Column) -> Column:
    """Compatibility decomposition without combining marks; ASCII text does not leave the JVM's value."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), _fold(F.when(c.rlike(r"[^\x00-\x7F]"), c))).otherwise(c)


def _tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda t: t != "")


def company_key(cleaned: Column) -> Column:
    """Without legal suffixes; a name of suffixes alone stays as it is."""
    return _kept_or_whole(cleaned, lambda tokens: F.filter(tokens, lambda t: ~t.isin(*LEGAL_SUFFIXES)))


def person_key(cleaned: Column) -> Column:
    """Sorted words without titles; a name of titles alone stays as it is."""
    return _kept_or_whole(cleaned, lambda tokens: F.array_sort(F.filter(tokens, lambda t: ~t.isin(*PERSON_TITLES))))


def _kept_or_whole(cleaned: Column, choose) -> Column:
    return once(cleaned, lambda whole: once(F.array_join(choose(_tokens(whole)), " "), lambda kept: F.when(kept != "", kept).otherwise(whole)))


def address_key(cleaned: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in ADDRESS_ABBREVIATIONS.items() for x in kv])
    return F.array_join(F.array_sort(F.transform(_tokens(cleaned), lambda t: F.coalesce(F.try_element_at(table, t), t))), " ")


def stable_id(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha1(key), 1, 12))
