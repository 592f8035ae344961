"""Mixing sources to target weights under weights that change over time.

Each source has a mean weight and a schedule, a rate that is linear between knots of the training
time [0, 1].  The mean weights share out a budget of words; no source gets more than ``most`` times
its own words, and what it cannot give is shared among the others by weight.  A source's documents
stand in an order by a hash of their ids and are read round after round, so that each copy covers
an interval of the words demanded from its source.  The integral of the schedule is the share of
the demand that is due by a time; its inverse at the start of a copy is the training position of
that copy, and documents are sorted by ranges of positions.

Defined cases: a null text has no words; a null source is a source of its own, behind the others; a
null id counts as an empty one; documents without words are never taken; rows that repeat an id are
documents of their own, in order of their sizes; the last copy of a source is cut at its target, so
at most one document of it is taken in part; texts of any length are counted whole; an empty table
gives an empty result; only the columns in ``keep`` are carried, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidgraph.functions.ranks import numbered, running
from bidgraph.plans.storage import materialize

MOST = 3  # times that a document may be read
WEIGHTS = (1, 2, 3)  # mean weights of the sources in code point order, repeating
#: Of each weight in WEIGHTS, the rates at times 0 and 1 in units of the mean: light sources come early, heavy ones late.
RAMPS = ((1.5, 0.5), (1.0, 1.0), (5 / 6, 7 / 6))


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def cyclic(place: Column, values: tuple) -> Column:
    """The value for a place from 1 on, ``values`` repeating."""
    return F.element_at(F.array(*[F.lit(v) if not isinstance(v, tuple) else F.array(*map(F.lit, v)) for v in values]), ((place - 1) % len(values) + 1).cast("int"))


def source_targets(sizes: DataFrame, weight, most: float = MOST, share: float = 1.0) -> DataFrame:
    """(source, source_size, place, weight, target) of rows (source, size).

    ``weight`` makes a source's mean weight from its place.  A source is full where ``most`` times
    its size is no more than its part; in order of size by weight the full sources come first, so
    running sums give the part of a weight that is left behind each of them, and the first source
    that is not full fixes it.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = numbered(total, [F.col("source").isNull(), F.col("source")], "place").withColumn("weight", weight(F.col("place")))
    full_at = most * F.col("source_size") / F.col("weight")
    rows = materialize(running(placed, [full_at, F.col("place")], {"_full": most * F.col("source_size"), "_weights": F.col("weight"), "_total": F.col("source_size")}), "sources")
    whole = rows.agg(F.max("_total").alias("words"), F.max("_weights").alias("weights")).first()
    if whole["words"] is None:
        return rows.select("source", "source_size", "place", "weight", F.lit(0.0).alias("target"))
    part = (F.lit(share * whole["words"] if share != 1.0 else whole["words"]) - F.col("_full") + most * F.col("source_size")) / (F.lit(whole["weights"]) - F.col("_weights") + F.col("weight"))
    rest = rows.where(part <= full_at).agg(F.min_by(part, F.struct(full_at, "place")).alias("p")).first()["p"]
    target = most * F.col("source_size") if rest is None else F.least(most * F.col("source_size"), F.col("weight") * F.lit(rest))
    return rows.select("source", "source_size", "place", "weight", target.cast("double").alias("target"))


def demand(knots: Column, rates: Column) -> Column:
    """Array of the schedule's integral up to each knot, as a share of the whole."""
    width = lambda i: F.get(knots, i) - F.get(knots, i - 1)
    area = lambda i: width(i) * (F.get(rates, i) + F.get(rates, i - 1)) / 2
    summed = F.transform(knots, lambda _, i: F.aggregate(F.sequence(F.lit(0), i), F.lit(0.0), lambda a, j: a + F.when(j > 0, area(j)).otherwise(0.0)))
    return F.transform(summed, lambda x: x / F.get(summed, F.size(knots) - 1))


def due_at(share: Column, knots: Column, rates: Column, demanded: Column) -> Column:
    """The time at which ``share`` of the demand is due: a root of the quadratic of its segment."""
    k = F.least(F.size(F.filter(demanded, lambda x: x <= share)), F.size(knots) - 1)
    t0, t1, r0, r1 = F.get(knots, k - 1), F.get(knots, k), F.get(rates, k - 1), F.get(rates, k)
    last = F.size(knots) - 1
    whole = F.aggregate(F.sequence(F.lit(1), last), F.lit(0.0), lambda a, j: a + (F.get(knots, j) - F.get(knots, j - 1)) * (F.get(rates, j) + F.get(rates, j - 1)) / 2)
    owed = (share - F.get(demanded, k - 1)) * whole
    root = r0 + F.sqrt(F.greatest(F.lit(0.0), r0 * r0 + 2 * (r1 - r0) / (t1 - t0) * owed))
    return F.least(t1, t0 + F.when(root > 0, 2 * owed / root).otherwise(0.0))


def mix_documents(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS,
                  ramps: tuple[tuple[float, ...], ...] = RAMPS, most: float = MOST, share: float = 1.0) -> DataFrame:
    """The columns ``keep``, ``mix``, a struct of size, source_size, target, taken and copies (copy, words, position), and ``mix_order``.

    Columns of ``keep`` with the names of the last two are replaced.
    """
    size = count_words(F.col(f"`{text_col}`"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{source_col}`").alias("source"), size.alias("size"))
    rows = materialize(rows.select("kept", "source", "size", F.md5("id").alias("mixed"), F.monotonically_increasing_id().alias("row")), "sized")
    sources = source_targets(rows, lambda place: cyclic(place, weights), most, share)
    sources = sources.select(F.col("source").alias("of"), "source_size", "target", F.array(*[F.lit(k / (len(ramps[0]) - 1)) for k in range(len(ramps[0]))]).alias("knots"), cyclic(F.col("place"), ramps).alias("rates"))
    sources = materialize(sources.withColumn("demanded", demand(F.col("knots"), F.col("rates"))), "targets")
    keyed = rows.withColumn("within", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    placed = running(keyed, [F.col("mixed"), F.col("size"), F.col("row")], {"upto": F.col("size")}, within=("within",))
    joined = placed.join(sources, F.col("source").eqNullSafe(F.col("of")))
    end = F.least(F.floor(F.col("target") + 0.5), F.floor(F.lit(most) * F.col("source_size"))).cast("long")
    start = lambda k: F.col("upto") - F.col("size") + k * F.col("source_size")
    words = lambda k: F.greatest(F.lit(0), F.least(F.col("size"), end - start(k)))
    position = lambda k: due_at(start(k) / F.col("target"), F.col("knots"), F.col("rates"), F.col("demanded"))
    rounds = F.filter(F.sequence(F.lit(0), F.lit(math.ceil(most) - 1)), lambda k: words(k) > 0)
    copies = F.transform(rounds, lambda k: F.struct(k.alias("copy"), words(k).cast("long").alias("words"), position(k).alias("position")))
    taken = joined.select("kept", "mixed", "size", "source_size", "target", copies.alias("copies"))
    own = [F.col(f"kept.`{c}`") for c in keep if c.lower() not in ("mix", "mix_order")]
    words_taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"]).alias("taken")
    return taken.select(*own, F.struct("size", "source_size", "target", words_taken, "copies").alias("mix"), F.col("mixed").alias("mix_order"))


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per copy of a document that is taken, sorted over all partitions by its training position."""
    per = mixed.select(*[F.col(f"`{c}`") for c in mixed.columns if c not in ("mix", "mix_order")], "mix_order", F.explode("mix.copies").alias("due"))
    return per.orderBy("due.position", "mix_order", "due.copy").drop("mix_order")


ORACLE = r"""WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
  s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
  r AS (SELECT *, 3 * source_size / weight AS full_at, sum(3 * source_size) OVER o AS filled, sum(weight) OVER o AS weights, sum(source_size) OVER () AS words, sum(weight) OVER () AS whole
    FROM s WINDOW o AS (ORDER BY 3 * source_size / weight, place)),
  p AS (SELECT *, CAST(words - filled + 3 * source_size AS BIGINT) / CAST(whole - weights + weight AS BIGINT) AS part FROM r),
  m AS (SELECT arg_min(part, {'f': full_at, 'p': place}) AS rest FROM p WHERE part <= full_at),
  t AS (SELECT source, source_size, CAST(least(3 * source_size, weight * rest) AS DOUBLE) AS target FROM p, m),
  a AS (SELECT d.*, source_size, target, least(CAST(floor(target + 0.5) AS BIGINT), 3 * source_size) AS goal,
    sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), size ROWS UNBOUNDED PRECEDING) - size AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(greatest(0, least(size, goal - start)) + greatest(0, least(size, goal - start - source_size)) + greatest(0, least(size, goal - start - 2 * source_size)) AS BIGINT) AS taken FROM a"""
