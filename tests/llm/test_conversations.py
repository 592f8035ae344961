import hashlib
import random
import re
import zlib

import pytest

from bidgraph.llm import conversations as conv
from bidgraph.llm.queries import op12_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string, key string, block string"
FULL = re.compile(r"(s?(ua)+)?\Z")


def cheapest(codes):
    """(cost, letters) of the cheapest edits by search over whole strings of letters, a cost at a time."""
    best = {}
    todo = [(0, "", 0, "")]
    while todo:
        todo.sort(reverse=True)
        cost, letters, i, said = todo.pop()
        state = said[-1:] if said else ""
        if (i, state) in best and best[i, state] <= (cost, letters):
            continue
        best[i, state] = cost, letters
        if i == len(codes) and FULL.match(said):
            return cost, letters
        due = "a" if state == "u" else "u"
        if i < len(codes):
            code, extra = codes[i], 5 * codes[i].isupper()
            todo.append((cost + 2, letters + "D", i + 1, said))
            if code != "x":
                todo.append((cost + 1 + extra, letters + "R", i + 1, said + due))
                kept = code.lower()
                if kept == due or kept == "s" and not said:
                    todo.append((cost + extra, letters + "K", i + 1, said + kept))
        todo.append((cost + 5, letters + "I", i, said + due))


@pytest.mark.parametrize("size", [1, 3, 64])
def test_auction_finds_the_cheapest_and_least_letters(size):
    rng = random.Random(size)
    for _ in range(400):
        codes = "".join(rng.choice("suaoxSUAOuaua") for _ in range(rng.randint(1, 14)))
        blocks = [codes[k : k + size] for k in range(0, len(codes), size)]
        marked = ["^" * (k == 0) + b + "$" * (k == len(blocks) - 1) for k, b in enumerate(blocks)]
        ends, end = [], conv.ACCEPT
        for m in reversed(marked):
            ends.append(end)
            step = conv.costs(m)
            end = tuple(min(min(step[4 * s + t] + end[t] for t in range(4)), conv.NEVER) for s in range(4))
        state, letters = conv.START, ""
        for m, e in zip(marked, reversed(ends)):
            part, row = conv.traces(m, e)[state], 0
            for c in part:
                code = m.strip("^$")[row] if c != "I" else ""
                state = conv.KEPT[code.lower()][state] if c == "K" else conv.DUE[state] if c in "RI" else state
                row += c != "I"
            letters += part
        assert (end[conv.START], letters) == cheapest(codes)


def plain(rows):
    """The report by a walk over each whole conversation, its damage included."""
    out = []
    for c in sorted({r[0] for r in rows}, key=lambda c: (c is not None, c)):
        said = []
        for _, turn, role, text, *_ in (r for r in rows if r[0] == c):
            role, text = (" " if x is None else x for x in (role, text))
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            said += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        digest = lambda role, text: hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
        said.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:256].encode(), digest(r[1], r[2])))
        turns = [t for t, _, _ in said if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, codes, counts = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in said:
            bare = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            code = role[:1] if role[:1] in ("s", "u", "a") else "o"
            codes += "x" if fault in ("blank", "duplicate") else code.upper() if fault else code
            if fault:
                counts[fault] += 1
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
        cost, letters = cheapest(codes)
        lines, row, initials = [], 0, ""
        for x in letters:
            due = {"u": "assistant"}.get(initials[-1:], "user")
            if x == "I":
                lines.append(due + ":")
            elif x != "D":
                lines.append(f"{said[row][1] if x == 'K' else due}:{said[row][2]}")
            initials += lines[-1][0] if x != "D" else ""
            row += x != "I"
        out.append((c, gaps, *counts.values(), illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def report(spark, rows, block=64):
    said = spark.createDataFrame(rows, SCHEMA)
    found = conv.repair_report(said, conv.damaged(said), block)
    return sorted((tuple(r) for r in found.collect()), key=lambda r: (r[0] is not None, r[0]))


def test_report_equals_brute_force_with_odd_rows(spark):
    rng = random.Random(7)
    role = lambda: rng.choice(["user", "assistant"] * 4 + ["system", "tool", None, "", "User"])
    text = lambda: rng.choice([None, "", " \t", "Yes.", "No!\n", "broken off", "Why? ", "a\x0b.", "été \U0001F600!", "x" * 300 + "."])
    rows = [(c, rng.choice([None, *range(9)]), role(), text(), "k", "b") for c in range(60) for _ in range(rng.randint(1, 9))]
    rows += [(None, 1, "user", "Hello.", "", ""), (None, None, "assistant", "Hi.", "", ""), (900, 0, "user", "z" * 200_000 + ".", None, None)]
    rows += [(c, 0, "user", "Alone.", "", "") for c in range(1000, 1080)]
    want = plain(rows)
    assert report(spark, rows) == want
    assert any(r[7] == "" and r[8] == hashlib.sha256(b"").hexdigest() for r in want)


def test_one_long_conversation_in_small_blocks(spark):
    rng = random.Random(3)
    rows = [(5, t // 2, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Yes.", "No", f"Turn {t}.", f"Say {t}", ""]), "", "") for t in range(120)]
    rows += [(6, t, "user", "The same row.", "", "") for _ in range(40) for t in (1, 2)]
    assert report(spark, rows, block=4) == plain(rows)


def test_empty_table(spark):
    assert report(spark, []) == []


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = op12_conversation_repair(spark, sf)
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, found.collect())) == plain(rows)
