"""Co-bid pairs kept up to date: only tenders whose bids changed are joined again.

Bid facts are stored in buckets of tenders, each with a fingerprint of its rows; pair counts are
stored in buckets of pairs.  A feed whose bucket has the stored fingerprint isn't read further.  In
the others, facts are compared with the stored ones, and what a changed fact adds to or takes from
pairs comes from joining the changed facts alone, new with old and new with new, with all facts of
their tenders.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidgraph.plans.storage import discard, materialize
from bidgraph.sources.store import Store

FACT = ("company", "tender", "bid_amount")


def row_digest(columns: Iterable[Column]) -> Column:
    """60 bits of a row's MD5, as a number; nulls count as empty."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")


def fingerprints(facts: DataFrame, bucket: Column) -> DataFrame:
    """(bucket, rows, digest): the number of facts and the sum of their digests, which no order changes."""
    cents = F.floor(F.col("bid_amount") * 100 + 0.5)
    return facts.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("rows"), F.sum(row_digest([F.col("company"), F.col("tender"), cents])).alias("digest"))


def changed_pairs(changed: DataFrame, everyone: DataFrame) -> DataFrame:
    """(company_a, company_b, n, gaps, gap) over the pairs of a tender with a changed fact, each pair once.

    ``everyone`` has all facts of the tenders of ``changed``, with ``is_changed``.
    """
    one = changed.select("tender", F.col("company").alias("c"), F.col("bid_amount").alias("x"))
    two = everyone.select(F.col("tender").alias("t"), F.col("company").alias("d"), F.col("bid_amount").alias("y"), "is_changed")
    met = one.join(two, (F.col("tender") == F.col("t")) & (F.col("c") != F.col("d")) & (~F.col("is_changed") | (F.col("c") < F.col("d"))))
    base = F.greatest(F.abs("x"), F.abs("y"))
    gap = F.when(F.col("x").isNotNull() & F.col("y").isNotNull() & (base != 0), F.abs(F.col("x") - F.col("y")) / base)
    return met.groupBy(F.least("c", "d").alias("company_a"), F.greatest("c", "d").alias("company_b")).agg(F.count("*").alias("n"), F.count(gap).alias("gaps"), F.coalesce(F.sum(gap), F.lit(0.0)).alias("gap"))


def _summed(old: DataFrame, new: DataFrame) -> DataFrame:
    both = old.unionByName(new).groupBy("company_a", "company_b").agg(F.sum("n").alias("n"), F.sum("gaps").alias("gaps"), F.sum("gap").alias("gap"))
    return both.where("n > 0")


def apply_feed(facts: Store, pairs: Store, feed: DataFrame, whole: bool = True) -> list[int]:
    """Bring both stores up to ``feed`` (company, tender, bid_amount); the buckets of tenders that were read and written.

    A whole feed replaces what is stored: facts that it lacks go.  Else its facts are added, the
    lower amount of a company and tender counts, and buckets without new facts are not looked at.
    A run that failed between the two commits may be repeated with the same feed.
    """
    rows = materialize(feed.select(*FACT).groupBy("company", "tender").agg(F.min("bid_amount").alias("bid_amount")), "feed")
    held = facts.manifest()
    now = {str(r["bucket"]): f"{r['rows']}:{r['digest']}" for r in fingerprints(rows, facts.bucket()).collect()}  # a row per bucket
    changed = [int(b) for b in now if held["prints"].get(b) != now[b]] if whole else [int(b) for b in now]
    gone = [int(b) for b in held["at"] if b not in now] if whole else []
    of = sorted(changed + gone)
    if not of:
        discard(rows.sparkSession, rows)
        return []
    old = materialize(facts.read(rows.schema, of, held).select(*FACT), "old")
    new = rows.where(facts.bucket().isin(*of))
    if not whole:
        new = old.unionByName(new).groupBy("company", "tender").agg(F.min("bid_amount").alias("bid_amount"))
    new = materialize(new.select(*FACT), "new")
    keys = F.struct("company", "tender")
    both = old.select(keys.alias("k"), F.struct("bid_amount").alias("was")).join(new.select(keys.alias("k"), F.struct("bid_amount").alias("is")), "k", "full_outer")
    differ = materialize(both.where(~F.col("was").eqNullSafe(F.col("is"))).select("k.company", "k.tender", "was", "is"), "differ")
    delta = None
    for state, side, sign in ((old, "was", -1), (new, "is", 1)):
        part = differ.where(F.col(side).isNotNull()).select("company", "tender", f"{side}.bid_amount")
        marks = part.select("company", "tender", F.lit(True).alias("mark"))
        everyone = state.join(differ.select("tender").distinct(), "tender", "left_semi").join(marks, ["company", "tender"], "left").withColumn("is_changed", F.col("mark").isNotNull())
        found = changed_pairs(part, everyone).select("company_a", "company_b", *[(sign * F.col(c)).alias(c) for c in ("n", "gaps", "gap")])
        delta = found if delta is None else delta.unionByName(found)
    delta = materialize(delta.groupBy("company_a", "company_b").agg(F.sum("n").alias("n"), F.sum("gaps").alias("gaps"), F.sum("gap").alias("gap")), "delta")
    pairs.commit(delta, _summed, ("facts", held["version"] + 1))
    after = now if whole else {str(r["bucket"]): f"{r['rows']}:{r['digest']}" for r in fingerprints(new, facts.bucket()).collect()}
    facts.commit(new, lambda _, rows: rows, prints={str(b): after.get(str(b)) for b in of}, of=of)
    discard(rows.sparkSession, rows, old, new, differ, delta)
    return of


def stored_pairs(pairs: Store) -> DataFrame:
    """(company_a, company_b, shared_tenders, mean_price_gap)."""
    return pairs.read().select("company_a", "company_b", F.col("n").alias("shared_tenders"), F.when(F.col("gaps") > 0, F.col("gap") / F.col("gaps")).alias("mean_price_gap"))
