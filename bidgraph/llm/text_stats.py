"""Statistics of whole texts that the quality operators judge by.

Words are the runs of characters other than space and U+0009 to U+000D.  A null text counts as
empty; every count is then 0 and every share 0.0.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = (
    "log_words", "mean_word_chars", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "digit_share",
    "punct_share", "mark_share", "bang_share", "distinct_share", "words_per_line", "short_word_share", "long_word_share", "bar_share",
)
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
_UPPER, _DIGITS = string.ascii_uppercase.encode(), string.digits.encode()
_LETTERS, _PUNCT = string.ascii_letters.encode(), string.punctuation.encode()
WINDOW = 5


BATCH_ROWS = 1000  # texts that a Python task is handed at once


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python in batches of at most BATCH_ROWS rows, so that a task's memory doesn't follow its partition."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "0")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of five that stand in the text twice or more."""
    if len(words) <= WINDOW:
        return 0
    windows = list(zip(*(words[k:] for k in range(WINDOW))))
    if len(set(windows)) == len(windows):
        return 0
    count = Counter(windows)
    starts = np.fromiter((count[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for k in range(WINDOW):
        covered[k : k + len(windows)] |= starts
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    lines = text.split("\n")
    if len(lines) == len(set(lines)):
        return 0
    filled = [line for line in lines if line.strip(SPACES)]
    return len(filled) - len(set(filled))


def describe(text: str | None) -> tuple:
    """COUNTS and then SHARES of one text."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    word_chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    dup_lines, repeats = duplicate_lines(text), repeated_words(words)
    size, lines = max(1, len(raw)), text.count("\n") + 1
    without = lambda chars: len(raw) - len(raw.translate(None, chars))
    upper, letters = without(_UPPER), without(_LETTERS)
    per = 1 / max(1, n)
    length = np.fromiter(map(len, words), np.int32, n)
    return (
        n, word_chars, symbols, dup_lines, repeats,
        float(np.log1p(n)), word_chars * per, symbols * per, dup_lines / lines, repeats * per, upper / max(1, letters), without(_DIGITS) / size,
        without(_PUNCT) / size, without(b"#*$%&|<>~^_") / size, text.count("!") * per, len(set(words)) * per, n / lines, float((length <= 3).sum()) * per, float((length >= 12).sum()) * per, text.count("|") * per,
    )


_SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField(c, T.DoubleType()) for c in SHARES])


def text_stats(text: Column) -> Column:
    """Struct of COUNTS (long) and SHARES (double) of each whole text."""

    @F.pandas_udf(_SCHEMA)
    def stats(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([describe(t) for t in texts], columns=[*COUNTS, *SHARES])

    return stats(text)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, where: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, y, text) of at most ``bound`` labelled documents, chosen by a hash of their ids.

    A document with several labels takes the largest; null ids and labels are left out.  The
    chosen ids are few by construction and are broadcast to the documents.
    """
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    if where is not None:
        chosen = chosen.where(where)
    chosen = chosen.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(bound)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
