"""MinHash near-duplicate detection.

Method: many universal hash minima per shingle set, banding, verification first on signatures and
then on the full sets, and connected components by alternating large-star and small-star.

Plan
1. One pass over the texts gives each row its set size, a digest of its set, band keys and an
   8-bit signature.  Rows with equal sets form a class; only one row per class goes on, so copies
   never meet each other in a bucket.
2. Every bucket compares its smallest member with the others (a star, linear in the bucket).
   Candidates pass the signature estimate and are then confirmed on the full sets.
3. Buckets whose members still lie in different components are compared in blocks of bounded
   size, members of one component never with each other.  Blocks first hold no texts but sharper
   signatures; texts go only to members that have a candidate in a block by these, and only links
   leave it.  No candidate is left out.
4. Components of the confirmed links; each document takes the smallest id of its component.

Defined cases: a null text counts as empty; empty sets are linked with nothing; rows with a null
id are never linked and get a null component; rows that repeat an id are one document that has
the links of all its rows; the smallest id of a component stays, so there are no ties; texts of any
length are shingled whole; an empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidgraph.llm.components import connected_components
from bidgraph.plans.storage import discard, materialize

BANDS, ROWS = 40, 5
#: A pair of Jaccard similarity 0.8 shares no band once in 8 million pairs: (1 - 0.8**5)**40.
SHARP = 1024  # minima in the signatures that blocks compare
DEVIATIONS = 5  # standard deviations by which an estimate may lie below the limit
BLOCK = 1024  # members of a bucket compared at once

_UPPER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
_WORD_MEMO = 400_000  # distinct words whose hash a task keeps


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    odd = rng.integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)
    return odd, rng.integers(0, 2**64, n, dtype=np.uint64)


class _WordHash(dict):
    """64-bit hash of a word, remembered for frequent words; emptied when it grows too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORD_MEMO:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_hashes(text: str | None, width: int, memo: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text."""
    words = (text or "").encode("utf-8", "replace").translate(_UPPER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    mixed = np.full(n, width, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            mixed = (mixed ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def _minima(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of the multiply-shift hashes (a * x + b) >> 32 over a set, in bounded blocks."""
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for start in range(0, len(values), 1024):
            block = values[None, start : start + 1024] * a[:, None]
            block += b[:, None]
            np.minimum(out, block.min(axis=1), out=out)
    return out >> np.uint64(32)


def _fingerprint(width: int, bands: int, rows: int):
    a, b = _coefficients(bands * rows)
    schema = "n_shingles long, set_id binary, bands array<long>, signature binary"

    @F.pandas_udf(schema)
    def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo = _WordHash()
        for texts in batches:
            out = []
            for text in texts:
                values = shingle_hashes(text, width, memo)
                if not len(values):
                    out.append((0, None, None, None))
                    continue
                minima = _minima(values, a, b).astype("<u8").reshape(bands, rows)
                keys = [xxhash.xxh3_64_intdigest(m.tobytes(), seed=i) - 2**63 for i, m in enumerate(minima)]
                out.append((len(values), xxhash.xxh3_128_digest(values.astype("<u8").tobytes()), keys, minima.astype(np.uint8).tobytes()))
            yield pd.DataFrame(out, columns=["n_shingles", "set_id", "bands", "signature"])

    return fingerprint


def _sharper(width: int):
    a, b = _coefficients(SHARP)

    @F.pandas_udf(T.BinaryType())
    def sharper(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = _WordHash()
        for texts in batches:
            yield pd.Series([_minima(shingle_hashes(t, width, memo), a, b).astype(np.uint8).tobytes() for t in texts], dtype=object)

    return sharper


def _least(percent: int, minima: int) -> float:
    """The estimate from so many minima below which a pair of ``percent`` lies once in millions."""
    share = percent / 100
    return share - DEVIATIONS * (max(share * (1 - share), 0.01) / minima) ** 0.5


def _signature_share(left: pd.Series, right: pd.Series) -> np.ndarray:
    """Estimated similarity from the signatures' equal bytes, corrected for chance."""
    if not len(left):
        return np.empty(0)
    x = np.frombuffer(b"".join(left), np.uint8).reshape(len(left), -1)
    y = np.frombuffer(b"".join(right), np.uint8).reshape(len(right), -1)
    return ((x == y).mean(axis=1) - 1 / 256) / (1 - 1 / 256)


@F.pandas_udf(T.DoubleType())
def _estimate(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series(_signature_share(left, right))


def _confirm(width: int, percent: int):
    @F.pandas_udf("boolean")
    def confirm(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        memo = _WordHash()
        for left, right in batches:
            out = []
            for one, other in zip(left, right):
                x, y = shingle_hashes(one, width, memo), shingle_hashes(other, width, memo)
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pd.Series(out, dtype=bool)

    return confirm


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, width: int, percent: int, minima: int) -> DataFrame:
    """Those pairs (a, b) that are links: by signature and then on full sets."""
    left = classes.select(F.col("rep").alias("a"), F.col("signature").alias("sig_a"))
    right = classes.select(F.col("rep").alias("b"), F.col("signature").alias("sig_b"))
    pairs = pairs.join(left, "a").join(right, "b").where(_estimate("sig_a", "sig_b") >= _least(percent, minima)).select("a", "b")
    pairs = materialize(pairs.distinct(), "pairs")
    with_a = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    links = materialize(with_b.where(_confirm(width, percent)("text_a", "text_b")).select("a", "b").distinct(), "links")
    discard(pairs.sparkSession, pairs)
    return links


def _block_pairs(block: pd.DataFrame, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place in the first side, candidates in the second) of members of different components.

    A pair that shares several bands is a candidate in the first of them only.  A block of one side
    compares it with itself, each pair once.
    """
    one, other = _sides(block)
    if not len(one):
        return
    sharp = np.frombuffer(b"".join(other.sharp), np.uint8).reshape(len(other), -1)
    bands, roots, reps = np.vstack(other.bands.to_list()), other.root.to_numpy(), other.rep.to_numpy()
    least = _least(percent, SHARP)
    for k, (rep, root, band, own, mine) in enumerate(one[["rep", "root", "band", "bands", "sharp"]].itertuples(index=False)):
        found = np.flatnonzero((roots != root) & (reps > rep) if other is one else roots != root)
        found = found[(bands[found] == own).argmax(axis=1) == band] if len(found) else found
        if len(found):
            equal = (sharp[found] == np.frombuffer(mine, np.uint8)).mean(axis=1)
            found = found[(equal - 1 / 256) / (1 - 1 / 256) >= least]
        if len(found):
            yield k, found


_MEMBER = ["bucket", "i", "j", "side", "rep", "root", "band"]


def _sides(block: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    one, other = block[block.side == 0], block[block.side == 1]
    return one, other if len(other) else one


def _block_candidates(percent: int):
    """The members of a block that have a candidate in it by their sharper signatures."""

    def candidates(block: pd.DataFrame) -> pd.DataFrame:
        one, other = _sides(block)
        left, right = np.zeros(len(one), bool), np.zeros(len(other), bool)
        for k, found in _block_pairs(block, percent):
            left[k] = right[found] = True
        if other is one:
            left = right = left | right
        hits = [one[left]] if other is one else [one[left], other[right]]
        return pd.concat([h[_MEMBER] for h in hits]).drop_duplicates()

    return candidates


def _block_links(width: int, percent: int):
    """Links of one block: its candidates, confirmed on full sets.  Only links leave the block."""

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        memo, found = _WordHash(), []
        one, other = _sides(block)
        if len(one):
            sets = [shingle_hashes(t, width, memo) for t in other.text]
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            reps, texts, ids = other.rep.to_numpy(), one.text.to_list(), one.rep.to_list()
        for k, some in _block_pairs(block, percent):
            mine, wanted = shingle_hashes(texts[k], width, memo), np.zeros(len(sets), bool)
            wanted[some] = True
            rows = np.flatnonzero(wanted[owner])
            at = np.minimum(np.searchsorted(mine, values[rows]), len(mine) - 1)
            both = np.bincount(owner[rows[mine[at] == values[rows]]], minlength=len(sets))
            linked = wanted & (both > 0) & (100 * both >= percent * (sizes + len(mine) - both))
            found += [(min(ids[k], r), max(ids[k], r)) for r in reps[linked]]
        return pd.DataFrame(sorted(set(found)), columns=["a", "b"], dtype="int64")

    return compare


def _each_once(texts: DataFrame, prints: DataFrame) -> DataFrame:
    """``texts`` with the equal texts of an id that stands on several rows taken once; pairs of ids are confirmed on these."""
    several = materialize(prints.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "several")
    if several.isEmpty():
        return texts
    once = texts.join(several, "id").groupBy("id", F.sha2(F.col("text").cast("binary"), 256).alias("digest")).agg(F.first("text").alias("text")).select("id", "text")
    return texts.join(several, "id", "left_anti").unionByName(materialize(once, "once"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n_shingles, component_id, kept) per row of ``docs``; links at ``percent`` or more."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    prints = materialize(texts.select("id", _fingerprint(width, bands, rows)("text").alias("p")).select("id", "p.*"), "prints")
    some = prints.where("n_shingles > 0 AND id IS NOT NULL")
    texts = _each_once(texts, some)
    classes = materialize(some.groupBy("set_id").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), F.first("signature").alias("signature")), "classes")

    member = classes.select("rep", F.posexplode("bands").alias("band", "key")).select("rep", "band", F.xxhash64("band", "key").alias("bucket"))
    buckets = materialize(member.groupBy("bucket").agg(F.min("rep").alias("first"), F.max("rep").alias("last"), F.count("*").alias("size")).where("size > 1 AND first < last"), "buckets")
    shared = materialize(member.join(buckets, "bucket").select("bucket", "band", "rep", "first", "size"), "members")
    star = shared.where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct()
    links = _verified(star, classes, texts, width, percent, bands * rows)

    member_of = some.select("id", "set_id").join(classes.select("set_id", "rep"), "set_id").select("id", "rep")
    member_of = materialize(member_of.distinct(), "member_of")
    several = member_of.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).where("a < last")
    repeated = materialize(several.join(member_of, "id").where("rep <> a").select("a", F.col("rep").alias("b")), "repeated")
    edges = links.unionByName(repeated)
    roots = connected_components(edges)

    placed = shared.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "band", "rep", "size", F.coalesce("root", "rep").alias("root"))
    placed = materialize(placed, "placed")
    unsettled = materialize(placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high AND bucket IS NOT NULL").select("bucket"), "unsettled")
    left = materialize(placed.where("size > 2").join(unsettled, "bucket"), "left")
    needed = materialize(left.select(F.col("rep").alias("id")).distinct(), "needed")
    held = texts.join(needed, "id").select(F.col("id").alias("rep"), "text", _sharper(width)("text").alias("sharp"))
    held = materialize(held.join(classes.select("rep", "bands"), "rep"), "held")
    # Block numbers come from a hash, so a bucket of any size is dealt to blocks without ranking it.
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = left.join(held.drop("text"), "rep").withColumn("blocks", blocks).withColumn("own", own).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "rep", "root", "band", "bands", "sharp")
    key = ["bucket", "i", "j"]
    chosen = materialize(dealt.groupBy(*key).applyInPandas(_block_candidates(percent), "bucket long, i int, j int, side int, rep long, root long, band int"), "chosen")
    more = materialize(chosen.join(held, "rep").groupBy(*key).applyInPandas(_block_links(width, percent), "a long, b long"), "more")
    final = roots if more.isEmpty() else connected_components(edges.unionByName(more))

    by_id = member_of.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("id", F.coalesce("root", "rep").alias("root"))
    by_id = materialize(by_id.groupBy("id").agg(F.min("root").alias("root")), "by_id")
    discard(spark, classes, buckets, shared, links, member_of, repeated, roots, final, placed, unsettled, left, needed, held, chosen, more)
    ids = prints.select("id", "n_shingles").join(by_id, "id", "left")
    component = F.coalesce("root", "id")
    return ids.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All pairs by their common two-word shingles; for small tables.
ORACLE = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS met FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * met >= 80 * (p.n + q.n - met)
), around AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, a.y FROM reach r JOIN around a ON r.other = a.x
), roots AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN roots r ON d.doc_id = r.doc_id LEFT JOIN sizes s ON d.doc_id = s.doc_id
"""
