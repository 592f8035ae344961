"""Benchmark decontamination by pigeonhole edit matching.

A test item may stand in a text with up to k edits.  Cut into k + 1 pieces, at least one piece
then stands there unchanged, so exact piece hits (Aho-Corasick) give every possible place, and
Myers' bit-parallel edit distance verifies the window around each.  Texts and items are compared
by their lower-cased words with single spaces between.  Before the distance is taken, a window must
hold as many of the item's trigrams as k edits have to leave.

A benchmark of up to BLOCK_CHARS characters goes to the tasks as one broadcast.  A longer one stays
a table in the shared folder, dealt to blocks of about that size by a hash of the item: a task
gathers GROUP_CHARS characters of texts and searches them for one block after another, so that it
holds one block's matcher at a time and the driver none of the items.  Documents are never shuffled.

Defined cases: a null or empty text, and items without letters or digits, match nothing; an item
of fewer than ``MIN_CHARS`` characters must stand as a whole between ends of words; equal items are
reported each; rows that repeat are judged each; without items every document is clean; texts of
any length are searched whole; other columns are kept, an older result column is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidgraph.llm.warc import open_store
from bidgraph.plans.storage import new_path

ERROR_RATE = 0.10  # edits allowed, as a share of an item's characters
MIN_CHARS, MIN_PIECE = 30, 8
BLOCK_CHARS = 1_000_000  # characters of items in one block
GROUP_CHARS = 32_000_000  # characters of texts that are searched for one block after another
HOT_PIECE = 32  # items with one piece from which their trigrams are asked for together
GRAM_BITS = 2048

_SPACED = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_WIDE_MARKS = re.compile("[\u0080-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u2000-\u206f\u3000-\u303f]")
GRAM = 3
_RESULT = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("distance", T.IntegerType())]))


def normal(text: str | None) -> str:
    """Lower case, with single spaces for ASCII and common wide punctuation and spaces."""
    low = _WIDE_MARKS.sub(" ", (text or "").lower())
    return b" ".join(low.encode("utf-8", "replace").translate(_SPACED).split()).decode("utf-8", "replace")


def budget(length: int, rate: float = ERROR_RATE) -> int:
    """Edits that an item of this length may have, so that its pieces stay long enough."""
    return 0 if length < MIN_CHARS else max(0, min(int(length * rate), length // MIN_PIECE - 1))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length with their offsets."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def nearest(item: str, text: str) -> int:
    """Least edit distance of ``item`` to any part of ``text`` (Myers, 1999)."""
    m = len(item)
    at: dict[str, int] = {}
    for i, c in enumerate(item):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, m
    for c in text:
        eq = at.get(c, 0)
        vertical = eq | down
        diagonal = (((eq & up) + up) ^ up) | eq
        plus = down | (full & ~(diagonal | up))
        minus = up & diagonal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = (minus | (full & ~(vertical | plus))), plus & vertical
        if score < best:
            best = score
    return best


SLACK = 2  # places by which a neighbour of an exact piece may have moved


def anchors(parts: list[tuple[int, str]]) -> list[tuple[tuple[str, int], ...]]:
    """Of each piece the halves (text, offset from the piece) of which one must stand beside it.

    Pieces go in groups of two, the last of three if their number is odd. With fewer edits than pieces, some
    group has fewer edits than pieces; in it a piece is exact and a neighbour has one edit at most, so
    that one of the neighbour's halves is exact.
    """
    n = len(parts)
    out = []
    for i, (offset, _) in enumerate(parts):
        first = min(i // 2 * 2, max(0, n // 2 * 2 - 2))
        last = n if n - first <= 3 else first + 2
        halves = []
        for start, text in (parts[j] for j in range(first, last) if j != i):
            cut = len(text) // 2
            halves += [(text[:cut], start - offset), (text[cut:], start + cut - offset)]
        out.append(tuple(halves))
    return out


@dataclass(frozen=True)
class Item:
    item_id: int
    text: str
    edits: int

    def distance(self, text: str, start: int) -> int:
        """Least distance to the text around ``start``; one more than the budget if it is beyond."""
        k, length = self.edits, len(self.text)
        if start >= 0 and text.startswith(self.text, start):
            end = start + length
            whole = (not start or text[start - 1] == " ") and (end == len(text) or text[end] == " ")
            return 0 if k or whole else 1
        window = text[max(0, start - k) : max(0, start + length + k)]
        return nearest(self.text, window) if k and self.may_stand_in(window) else k + 1

    def may_stand_in(self, window: str) -> bool:
        """k edits touch at most k * GRAM trigrams of the item; the window must hold the others."""
        held = {window[i : i + GRAM] for i in range(len(window) - GRAM + 1)}
        t = self.text
        return sum(t[i : i + GRAM] in held for i in range(len(t) - GRAM + 1)) >= len(t) - GRAM + 1 - GRAM * self.edits


Place = tuple[Item, int, tuple[tuple[str, int], ...]]  # an item, a piece's offset in it, the halves beside the piece


def gram_bits(text: str) -> np.ndarray:
    """The trigrams of a text as a bit set of GRAM_BITS bits."""
    c = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    held = np.zeros(GRAM_BITS, bool)
    if len(c) >= GRAM:
        mixed = (c[:-2] * np.uint64(1_000_003) + c[1:-1]) * np.uint64(1_000_003) + c[2:]
        held[(mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - GRAM_BITS.bit_length() + 1)] = True
    return np.packbits(held).view(np.uint64)


class Places:
    """The many items that hold one piece; a hit asks all of them at once for their trigrams.

    k edits touch at most k * GRAM trigrams, so an item that misses more in the text around a hit
    can't stand there.
    """

    def __init__(self, places: list[Place], bits: dict[Item, np.ndarray]):
        self.places = places
        for item, *_ in places:
            if item not in bits:
                bits[item] = gram_bits(item.text)
        self.bits = np.stack([bits[item] for item, *_ in places])
        self.missing = np.array([item.edits * GRAM for item, *_ in places])
        self.before = max(offset + item.edits for item, offset, _ in places)
        self.after = max(len(item.text) - offset + item.edits for item, offset, _ in places)

    def near(self, text: str, at: int) -> list[Place]:
        around = gram_bits(text[max(0, at - self.before) : at + self.after])
        lacking = np.bitwise_count(self.bits & ~around).sum(axis=1)
        return [self.places[k] for k in np.flatnonzero(lacking <= self.missing)]


def _near(places: list[Place], text: str, at: int) -> Iterator[Place]:
    for place in places:
        if not place[2] or any(half in text[max(0, at + o - SLACK) : max(0, at + o + len(half) + SLACK)] for half, o in place[2]):
            yield place


class Matcher:
    """The piece automaton of one block of items."""

    def __init__(self, items: Sequence[Item]):
        places: dict[str, list[Place]] = {}
        for item in items:
            parts = pieces(item.text, item.edits)
            for (offset, piece), halves in zip(parts, anchors(parts)):
                places.setdefault(piece, []).append((item, offset, halves))
        self.automaton = ahocorasick.Automaton()
        bits: dict[Item, np.ndarray] = {}
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found if len(found) < HOT_PIECE else Places(found, bits)))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def find(self, text: str | None) -> dict[int, int]:
        """item_id -> least distance, for items within their budget."""
        return {} if self.empty else self.find_normal(normal(text))

    def find_normal(self, text: str) -> dict[int, int]:
        out: dict[int, int] = {}
        if self.empty or not text:
            return out
        done = set()
        for end, (size, places) in self.automaton.iter(text):
            at = end + 1 - size
            for item, offset, _ in _near(places.near(text, at) if isinstance(places, Places) else places, text, at):
                start = at - offset
                if out.get(item.item_id) == 0 or (item.item_id, start) in done:
                    continue
                done.add((item.item_id, start))
                distance = item.distance(text, start)
                if distance <= item.edits and distance < out.get(item.item_id, item.edits + 1):
                    out[item.item_id] = distance
        return out


def _block(rows: Sequence[tuple[int, str]], rate: float) -> list[Item]:
    return [Item(i, t, budget(len(t), rate)) for i, t in sorted(rows)]


@F.pandas_udf(T.StringType())
def _normal(texts: pd.Series) -> pd.Series:
    return texts.map(normal)


def normal_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, text) of the items that can match, in the form in which texts are compared."""
    return benchmark.select(F.col(id_col).cast("long").alias("item_id"), _normal(F.col(text_col)).alias("text")).where("item_id IS NOT NULL AND text <> ''")


def write_blocks(items: DataFrame, chars: int, block_chars: int) -> list[str]:
    """Write (item_id, text) to the shared folder in blocks of about ``block_chars``; the blocks' folders."""
    spark, n = items.sparkSession, -(-chars // block_chars)
    folder = new_path(spark, "benchmark")
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    dealt.repartition("block").write.partitionBy("block").parquet(folder)
    return [f"{folder}/block={r.block}" for r in dealt.select("block").distinct().orderBy("block").collect()]


def read_block(folder: str, rate: float) -> list[Item]:
    store, inside = open_store(folder)
    found = pq.read_table(inside, filesystem=store, columns=["item_id", "text"], partitioning=None)
    return _block(list(zip(found["item_id"].to_pylist(), found["text"].to_pylist())), rate)


def _groups(batches: Iterator[pd.Series]) -> Iterator[list[list[str]]]:
    """Runs of batches of about GROUP_CHARS characters, as texts in normal form."""
    group, size = [], 0
    for texts in batches:
        group.append([normal(t) for t in texts])
        size += sum(map(len, group[-1]))
        if size >= GROUP_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def _rows(found: list[dict[int, int]]) -> pd.Series:
    return pd.Series([[{"item_id": i, "distance": d} for i, d in sorted(f.items())] for f in found], dtype=object)


def _search_one(items):
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(items.value)
        for texts in batches:
            yield _rows([matcher.find(t) for t in texts])

    return search


def _search_blocks(folders: list[str], rate: float):
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for group in _groups(batches):
            found = [[{} for _ in texts] for texts in group]
            for folder in folders:
                matcher = Matcher(read_block(folder, rate))
                for texts, out in zip(group, found):
                    for text, had in zip(texts, out):
                        for item, distance in matcher.find_normal(text).items():
                            had[item] = min(distance, had.get(item, distance))
                del matcher
            for out in found:
                yield _rows(out)

    return search


def match_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", rate: float = ERROR_RATE, block_chars: int | None = None, name: str = "benchmark_items") -> DataFrame:
    """``docs`` with an array ``name`` of (item_id, distance), by item, of the items that a text holds."""
    spark, limit = docs.sparkSession, block_chars or BLOCK_CHARS
    items = normal_items(benchmark)
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    if chars <= limit:  # the broadcast holds at most ``limit`` characters
        search = _search_one(spark.sparkContext.broadcast(_block([tuple(r) for r in items.collect()], rate)))
    else:
        search = _search_blocks(write_blocks(items, chars, limit), rate)
    return docs.withColumn(name, F.pandas_udf(search, _RESULT)(F.col(text_col)))
