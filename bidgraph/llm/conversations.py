"""Repair of the role structure of conversations by an auction for shortest paths.

The rows of a conversation stand in order of their turn.  A blank row, a row whose role and text
were seen earlier and a row whose text breaks off are faulty; each row has its first fault.  A
repaired conversation has the role initials ``(s?(ua)+)?``.  Its edits are a path over a lattice of
(rows read, state): K keeps a row, R gives it the role that is due, D deletes it, I inserts an
empty turn.  All costs are whole numbers.

The path is found by an auction: every node has a price, a lower bound of its cost to the end.  The
path's last node takes the best of its arcs; if its price is below, the price rises and the path
loses the node, else the path is extended.  When the path arrives, the prices on it are exact.  The
cheapest edits whose letters are least in ASCII are traced along the tight arcs, those whose price
makes up the difference, letter by letter; the price of an arc's end is made exact before the arc
is believed.

Conversations are cut into blocks of rows, so that none is held in one task: a block's costs between
its four states are found in parallel, multiplied from the end (min, +) while the blocks of a
conversation stream by, and give every block the exact prices at its end; then all blocks are
traced in parallel from all states in which they can be entered.  Only the walk over a
conversation's rows that picks these traces is sequential; it streams, and holds one row.

Defined cases: null roles and texts count as one space; rows with a null turn come first; rows that
share a turn are ordered by role, by the first 256 characters of their text and by a hash of it,
equal rows are adjacent; a null id is a conversation of its own; texts of any length are read
whole; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidgraph.plans.storage import materialize

BLOCK = 64  # rows of a block
START, SYSTEM, USER, ASSISTANT = range(4)
DELETE, REROLE, INSERT, BROKEN = 2, 1, 5, 5  # costs; BROKEN is added for a kept row that breaks off
NEVER = 1 << 40
ACCEPT = (0, NEVER, NEVER, 0)  # costs from the states at a conversation's end
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
DUE = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
NAMES = {USER: "user", ASSISTANT: "assistant"}


class Auction:
    """Prices and arcs of one block.

    ``codes`` has a letter per row: x must go, s, u, a by the role's initial, o for any other,
    capital if the text breaks off.  ``end`` has the costs from the four states behind the block.
    Turns are inserted before a row, and at the end only if the conversation ends there.
    """

    def __init__(self, codes: str, end: tuple[int, ...], last: bool):
        n = len(codes)
        self.sink = 4 * (n + 1)
        floor = min(end)
        least = [floor] * (n + 1)
        for i in range(n - 1, -1, -1):
            least[i] = least[i + 1] + (DELETE if codes[i] == "x" or codes[i].isupper() else REROLE if codes[i] == "o" else 0)
        self.price = [least[i] for i in range(n + 1) for _ in range(4)] + [0]
        self.exact = [False] * self.sink + [True]
        self.arcs = [self._arcs(codes, end, last, i, state) for i in range(n + 1) for state in range(4)]

    def _arcs(self, codes: str, end: tuple[int, ...], last: bool, i: int, state: int) -> list[tuple[str, int, int]]:
        """(letter, cost, node) in order of the letters."""
        insert = ("I", INSERT, 4 * i + DUE[state])
        if i == len(codes):
            return ([insert] if last else []) + ([("", end[state], self.sink)] if end[state] < NEVER else [])
        code, below = codes[i], 4 * (i + 1)
        arcs = [("D", DELETE, below + state), insert]
        if code != "x":
            extra = BROKEN if code.isupper() else 0
            to = KEPT.get(code.lower(), {}).get(state)
            arcs += [("K", extra, below + to)] if to is not None else []
            arcs.append(("R", REROLE + extra, below + DUE[state]))
        return arcs

    def converge(self, origin: int) -> int:
        """The price of ``origin``, made exact."""
        path, price, exact = [origin], self.price, self.exact
        while not exact[path[-1]]:
            node, best, to = path[-1], NEVER, None
            for _, cost, other in self.arcs[node]:
                if cost + price[other] < best:
                    best, to = cost + price[other], other
            if price[node] == best and to is not None:
                path.append(to)
                continue
            price[node] = best
            if len(path) > 1:
                path.pop()
            elif to is None:
                break
        for node in path:
            exact[node] = True
        return price[origin]

    def trace(self, state: int) -> str:
        """The letters of the cheapest path whose letters are least."""
        node, letters = state, []
        self.converge(node)
        while True:
            for letter, cost, to in self.arcs[node]:
                if self.price[node] == cost + self.price[to] and self.price[node] == cost + self.converge(to):
                    break
            if to == self.sink:
                return "".join(letters)
            letters.append(letter)
            node = to


def _marked(codes: str) -> tuple[str, bool, bool]:
    """(codes, first, last): ^ and $ mark a conversation's first and last block."""
    return codes.strip("^$"), codes.startswith("^"), codes.endswith("$")


@lru_cache(maxsize=50_000)
def costs(marked: str) -> tuple[int, ...]:
    """The 16 costs from each state before a block to each state behind it."""
    codes, _, last = _marked(marked)
    found = [NEVER] * 16
    for to in range(4):
        auction = Auction(codes, tuple(0 if k == to else NEVER for k in range(4)), last)
        for state in range(4):
            reached = to >= USER or state == to or (to, state) == (SYSTEM, START) and "s" in codes.lower()
            if reached:
                found[4 * state + to] = auction.converge(state)
    return tuple(found)


@lru_cache(maxsize=50_000)
def traces(marked: str, end: tuple[int, ...]) -> tuple[str, ...]:
    """Letters for each state in which a block can be entered; the first block is entered at the start alone."""
    codes, first, last = _marked(marked)
    auction = Auction(codes, end, last)
    return tuple(auction.trace(state) if state == START or not first else "" for state in range(4))


def broken_off(text: Column) -> Column:
    return ~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")


def blank(text: Column) -> Column:
    return ~text.rlike(r"[^\x20\x09-\x0D]")


def in_order(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(key, block, row, turn, role, text, digest, blank, broken) of all rows; ``row`` ascends with the order of a conversation.

    Rows are dealt to ranges of the whole order, which splits long conversations, and a row's number
    is that of its range and its place there.
    """
    n = max(64, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    role, text, key = F.coalesce(F.col(f"`{role_col}`"), F.lit(" ")), F.coalesce(F.col(f"`{text_col}`"), F.lit(" ")), F.coalesce(F.concat(F.lit("c"), F.col(f"`{conv_col}`").cast("string")), F.lit(""))
    rows = turns.select(key.alias("key"), F.col(f"`{turn_col}`").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumns({"starts": F.substring("text", 1, 256), "digest": F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256), "blank": blank(F.col("text")), "broken": broken_off(F.col("text")), "copy": F.monotonically_increasing_id()})
    order = ["key", "turn", "role", "starts", "digest"]
    ranged = rows.repartitionByRange(n, *order, "copy").sortWithinPartitions(*order, "copy").drop("starts", "copy").withColumn("row", F.monotonically_increasing_id())
    return materialize(ranged.withColumn("block", F.floor(F.col("row") / block)), "conversations")


def faults(rows: DataFrame) -> DataFrame:
    """(key, block, row, turn, role, fault) of the rows of ``in_order``, without their texts."""
    first = rows.groupBy("key", "digest").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("broken"), "truncated")
    return materialize(rows.join(first, "row", "left").select("key", "block", "row", "turn", "role", fault.alias("fault")), "faults")


def _code() -> Column:
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)


def decisions(found: DataFrame) -> DataFrame:
    """(key, block, letters): each block's letters by the state in which it is entered, from ``faults``."""
    blocks = found.select("key", "block", "row", _code().alias("code")).groupBy("key", "block").agg(F.array_sort(F.collect_list(F.struct("row", "code"))).alias("rows"))
    blocks = blocks.select("key", "block", F.array_join("rows.code", "").alias("codes"))
    ends = blocks.groupBy("key").agg(F.min("block").alias("first"), F.max("block").alias("last"))
    marked = F.concat(F.when(F.col("block") == F.col("first"), "^").otherwise(""), "codes", F.when(F.col("block") == F.col("last"), "$").otherwise(""))

    @F.pandas_udf("array<long>")
    def matrix(codes: pd.Series) -> pd.Series:
        return pd.Series([None if c.startswith("^") else list(costs(c)) for c in codes], dtype=object)

    blocks = materialize(blocks.join(ends, "key").select("key", "block", marked.alias("codes")), "blocks")

    def from_the_end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        end = ACCEPT
        for batch in batches:
            out = []
            for codes, step in zip(batch["codes"], batch["matrix"]):
                end = ACCEPT if codes.endswith("$") else end
                least = min(end)  # prices count from the cheapest, so that like blocks are met again
                end = tuple(NEVER if e >= NEVER else e - least for e in end)
                out.append(list(end))
                if step is not None:
                    end = tuple(min(min(step[4 * s + t] + end[t] for t in range(4)), NEVER) for s in range(4))
            yield pd.DataFrame({"key": batch["key"], "block": batch["block"], "codes": batch["codes"], "prices": pd.Series(out, dtype=object)})

    priced = blocks.select("*", matrix("codes").alias("matrix")).repartition("key").sortWithinPartitions("key", F.desc("block")).mapInPandas(from_the_end, "key string, block long, codes string, prices array<long>")

    @F.pandas_udf("array<string>")
    def traced(codes: pd.Series, prices: pd.Series) -> pd.Series:
        return pd.Series([list(traces(c, tuple(map(int, p)))) for c, p in zip(codes, prices)], dtype=object)

    return materialize(priced.repartition("key", "block").select("key", "block", traced("codes", "prices").alias("letters")), "decisions")


def edits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(key, row, edit, cost, role, text, was): one row per edit in order, deleted rows and inserted turns included.

    ``rows`` are those of ``in_order`` and ``found`` their ``faults``.  ``role`` and ``text`` are null where nothing stays, ``was``
    is the row's former role, null for an inserted turn.  A conversation's edits are in one
    partition and in their order, but are only streamed there.
    """
    none = lambda kind: F.lit(None).cast(kind)
    plans = decisions(found).select("key", "block", F.lit(-1).cast("long").alias("row"), none("string").alias("role"), none("string").alias("text"), none("boolean").alias("broken"), "letters")
    said = rows.select("key", "block", "row", "role", "text", "broken", none("array<string>").alias("letters"))
    ordered = plans.unionByName(said).repartition("key").sortWithinPartitions("key", "block", "row")

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, letters, at, state, number = None, "", 0, START, 0
        columns = ["key", "row", "edit", "cost", "role", "text", "was"]

        def inserted(out: list) -> None:
            nonlocal at, state
            while at < len(letters) and letters[at] == "I":
                state, at = DUE[state], at + 1
                out.append((key, number, "I", INSERT, NAMES[state], "", None))

        for batch in batches:
            out: list[tuple] = []
            for k, row, role, text, broken, plan in zip(batch["key"], batch["row"], batch["role"], batch["text"], batch["broken"], batch["letters"]):
                if row < 0:
                    state = START if k != key else state
                    key, letters, at = k, plan[state], 0
                    continue
                number = row
                inserted(out)
                edit, at = letters[at], at + 1
                extra = BROKEN if broken else 0
                if edit == "D":
                    out.append((key, row, "D", DELETE, None, None, role))
                elif edit == "K":
                    state = KEPT[role[0]][state]
                    out.append((key, row, "K", extra, role, text, role))
                else:
                    state = DUE[state]
                    out.append((key, row, "R", REROLE + extra, NAMES[state], text, role))
                if at < len(letters) and set(letters[at:]) == {"I"}:
                    inserted(out)  # only a conversation's last rows have turns inserted behind them
            yield pd.DataFrame(out, columns=columns)

    return ordered.mapInPandas(apply, "key string, row long, edit string, cost long, role string, text string, was string")


def digests(edited: DataFrame) -> DataFrame:
    """(key, illegal, cost, audit, repaired_sha256) of ``edits``, streamed in their order.

    ``illegal`` counts the neighbours among the rows before the repair whose initials are not su, ua or au.
    """

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def closed() -> tuple:
            return key, illegal, cost, "".join(letters), sha.hexdigest()

        key, columns = None, ["key", "illegal", "cost", "audit", "repaired_sha256"]
        for batch in batches:
            out = []
            for k, edit, price, role, text, was in zip(batch["key"], batch["edit"], batch["cost"], batch["role"], batch["text"], batch["was"]):
                if k != key:
                    out += [closed()] if key is not None else []
                    key, illegal, cost, letters, sha, started, before = k, 0, 0, [], hashlib.sha256(), False, None
                letters.append(edit)
                cost += price
                if edit != "I":
                    illegal += before is not None and before[:1] + was[:1] not in ("su", "ua", "au")
                    before = was
                if edit != "D":
                    sha.update((f"\n{role}:{text}" if started else f"{role}:{text}").encode("utf-8", "replace"))
                    started = True
            yield pd.DataFrame(out, columns=columns)
        if key is not None:
            yield pd.DataFrame([closed()], columns=columns)

    return edited.mapInPandas(digest, "key string, illegal long, cost long, audit string, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """``conversations`` with defects by a hash of conversation and turn: a twentieth each is dropped, emptied, loses its stops, is repeated, or is said by the user."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times)).drop("col")


def repair_report(conversations: DataFrame, turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per conv_id of ``conversations`` about the repair of ``turns``: gaps, faults, cost, audit and digest of the repaired conversation."""
    rows = in_order(turns, block=block)
    found = faults(rows)
    count = lambda fault: F.count(F.when(F.col("fault") == fault, 1)).alias(fault)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    stats = found.groupBy("key").agg(gaps.alias("gaps"), *[count(f) for f in ("blank", "duplicate", "truncated")])
    repaired = digests(edits(rows, found))
    every = conversations.select("conv_id", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("")).alias("key")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    joined = every.join(stats, "key", "left").join(repaired, "key", "left")
    return joined.select("conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
