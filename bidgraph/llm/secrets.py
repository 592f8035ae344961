"""Secret scans: pattern spans, and random strings found by their token efficiency.

The pattern kinds are ``assign``, ``access`` and ``hex``.  Kind ``random`` holds strings whose
characters per token under a byte-pair vocabulary are few: words of a language pack well into
tokens, random strings don't.  Known digests, numbers, UUIDs and identifiers whose parts pack well
are not counted as random.  What base spans leave of a string is tested by itself.  Every scan is a
narrow pass over whole texts, in time linear in the text.

Two limits: strings under ``MIN_CHARS`` characters are not tested, as a few tokens say
too little, and random strings of ``MAX_CHARS_PER_TOKEN`` characters a token or more pass as words.

Defined cases: a null or empty text has no spans; spans of different kinds may overlap; offsets
are code points with an exclusive end; rows that repeat are scanned each; other columns are kept.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that have 24 characters or more
MIN_CHARS = 20  # least length of a string whose tokens are counted
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_CHARS)
MAX_CHARS_PER_TOKEN = 2.0
#: Digests of common lengths (MD5, SHA-1, SHA-2) and UUIDs are known, not random.
DIGEST = re.compile(r"(?:(?:md5|sha\d*)[-_=]?)?(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})", re.I)
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: Parts of identifiers between separators: words, numbers and short codes.
SEPARATORS = re.compile("[+/_=-]+")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[A-Za-z]{1,3}[0-9]{1,4}")
#: The parts of an identifier that are measured; numbers, single letters and short codes are known.
LETTERS = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2,}(?![A-Za-z0-9])")

_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ENCODINGS: dict[str, tiktoken.Encoding] = {}


def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The byte-pair encoding of a rank file, built once per process."""
    if path not in _ENCODINGS:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODINGS[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def packs(parts: list[str], tokens: tiktoken.Encoding, limit: float) -> bool:
    """Letters a token, the better of the written and the small letters: words in capitals pack like words."""
    n = sum(min(len(tokens.encode_ordinary(p)), len(tokens.encode_ordinary(p.lower()))) for p in parts)
    return sum(map(len, parts)) >= limit * n


def is_identifier(word: str) -> bool:
    """Names of things in programs, paths and dates: every part between separators is of a known kind."""
    return all(PART.fullmatch(p) for p in SEPARATORS.split(word) if p)


def is_random(word: str, tokens: tiktoken.Encoding, limit: float = MAX_CHARS_PER_TOKEN) -> bool:
    if DIGEST.fullmatch(word) or UUID.fullmatch(word):
        return False
    if is_identifier(word):
        parts = LETTERS.findall(word)
        if 2 * sum(map(len, parts)) >= len(word) and not packs(parts, tokens, limit):
            return True
        return any(len(p) >= MIN_CHARS and not packs([p], tokens, limit) for p in parts)
    return len(word) < limit * len(tokens.encode_ordinary(word))


def find_spans(text: str | None, tokens: tiktoken.Encoding, limit: float) -> list[tuple[str, int, int]]:
    text = text or ""
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    taken = sorted((s, e) for _, s, e in spans)
    for m in CANDIDATE.finditer(text):
        at, rests = m.start(), []
        for s, e in taken:
            if s < m.end() and m.start() < e:
                rests += [(at, s)] if s > at else []
                at = max(at, e)
        rests += [(at, m.end())] if at < m.end() else []
        short = [(s, e) for s, e in rests if e - s < MIN_CHARS]
        left = "".join(text[s:e] for s, e in short)
        found = [(s, e) for s, e in rests if e - s >= MIN_CHARS and is_random(text[s:e], tokens, limit)]
        found += short if len(left) >= MIN_CHARS and is_random(left, tokens, limit) else []
        spans += [("random", s, e) for s, e in found]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def secret_spans(text: Column, ranks: str, pattern: str, limit: float = MAX_CHARS_PER_TOKEN) -> Column:
    """Array of (kind, start, end) of every secret in a text, by start and then kind."""

    @F.pandas_udf(_SPANS)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = encoding(ranks, pattern)
        for texts in batches:
            yield pd.Series([[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t, tokens, limit)] for t in texts], dtype=object)

    return scan(text)


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


_REDACTED = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_spans", T.IntegerType())])


def redacted(text: Column, ranks: str, pattern: str, limit: float = MAX_CHARS_PER_TOKEN, mark: str = "[SECRET]") -> Column:
    """(text, n_spans): every span, overlapping ones together, replaced by ``mark``.  A null text stays null."""

    @F.pandas_udf(_REDACTED)
    def redact(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tokens = encoding(ranks, pattern)
        for texts in batches:
            out = []
            for t in texts:
                spans, parts, at = find_spans(t, tokens, limit), [], 0
                for _, start, end in spans:
                    if start >= at:
                        parts += [t[at:start], mark]
                    at = max(at, end)
                out.append(("".join(parts) + t[at:] if spans else t, len(spans)))
            yield pd.DataFrame(out, columns=["text", "n_spans"])

    return redact(text)


def scan_documents(docs: DataFrame, ranks: str, pattern: str, text_col: str = "text", limit: float = MAX_CHARS_PER_TOKEN) -> DataFrame:
    """``docs`` with a column ``spans``; an older column of that name is replaced."""
    return docs.withColumn("spans", secret_spans(F.col(text_col), ranks, pattern, limit))
