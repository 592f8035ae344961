"""Language identification by error-correcting output codes.

Every language has a codeword.  For each bit a binary classifier over hashed byte trigrams says
which side the text is on: its weights are the log odds of the trigram counts of the languages on
either side, over all texts that may be learnt from.  The language whose codeword has the least
weighted loss wins; bits that separate the languages better weigh more.  Texts whose two best
losses are close are flagged as ambiguous.

Defined cases: a text that is null or has no letter is ``und`` with score 0; rows without a
language are not learnt from; with no language learnt every text is ``und``, with one every text
with a letter has it; rows that repeat count again when learning; texts of any
length are read whole; of codewords equally near the first language by name is taken; other columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET_BITS = 16
LARGEST_CODE = 31  # bits of a random code, for more than six languages
MARGIN, CLIP = 8.0, 4.0  # scale of a mean log odds, and its bound
AMBIGUOUS = 0.2  # share of the loss between the two best codewords below which they are close
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_SPACED = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))
_COUNT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.IntegerType()), T.StructField("n", T.LongType())])
_RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])


def grams(text: str) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased words of a text, each with a space around it."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_SPACED).split()) + b" "
    if len(raw) < 3:
        return np.empty(0, np.int64)
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    packed = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
    with np.errstate(over="ignore"):
        return ((packed * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


def codewords(n: int) -> np.ndarray:
    """A row of -1 and 1 per language: all distinct splits of up to six languages, else random ones."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 6:
        bits = np.array([[1 if k == 0 or (split >> (k - 1)) & 1 else -1 for split in range(2 ** (n - 1) - 1)] for k in range(n)])
        return bits.astype(float)
    rng = np.random.default_rng(3)
    best, apart = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, LARGEST_CODE))
        near = min(int((code[a] != code[b]).sum()) for a in range(n) for b in range(a))
        varied = (abs(code.sum(axis=0)) < n).all()
        if varied and near > apart:
            best, apart = code, near
    return best


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # trigrams x bits
    bit_weight: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        found = grams(text)
        margin = np.clip(self.weights[found].mean(axis=0) * MARGIN, -CLIP, CLIP) if len(found) else np.zeros(self.code.shape[1])
        loss = (self.bit_weight * np.log1p(np.exp(-self.code * margin))).sum(axis=1)
        order = np.argsort(loss, kind="stable")
        share = np.exp(-(loss - loss[order[0]]) * len(self.bit_weight))
        close = bool(loss[order[1]] - loss[order[0]] < AMBIGUOUS * loss[order[1]])
        return self.languages[order[0]], float(share[order[0]] / share.sum()), close


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.lang, batch.text):
            if lang not in total:
                if len(total) == 64:
                    yield _rows(total)
                    total.clear()
                total[lang] = np.zeros(2**BUCKET_BITS, np.int64)
            total[lang] += np.bincount(grams(text), minlength=2**BUCKET_BITS)
    if total:
        yield _rows(total)


def _rows(total: dict[str, np.ndarray]) -> pd.DataFrame:
    parts = [pd.DataFrame({"lang": lang, "gram": (k := np.flatnonzero(n)), "n": n[k]}) for lang, n in total.items()]
    return pd.concat(parts)


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> LanguageModel:
    """Learn from every row of ``docs`` that has a text and a language.

    What reaches the driver is one count per language and trigram bucket.
    """
    known = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = known.mapInPandas(_counted, _COUNT).groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(counts.lang.unique()))
    code = codewords(len(languages))
    table = np.zeros((len(languages), 2**BUCKET_BITS))
    for k, lang in enumerate(languages):
        own = counts[counts.lang == lang]
        table[k, own.gram.to_numpy(int)] = own.n.to_numpy(float)
    share = table / np.maximum(1, table.sum(axis=1, keepdims=True))
    weights = np.zeros((2**BUCKET_BITS, code.shape[1]), np.float32)
    bit_weight = np.ones(code.shape[1])
    for b in range(code.shape[1]):
        with_bit, without = share[code[:, b] > 0].mean(axis=0), share[code[:, b] < 0].mean(axis=0)
        weights[:, b] = np.log(with_bit + 1e-6) - np.log(without + 1e-6)
        bit_weight[b] = max(0.05, float(np.tanh(code[:, b] * (share @ weights[:, b])).min()))
    return LanguageModel(languages, code, weights, bit_weight / max(1e-9, bit_weight.sum()))


def identify(text: Column, model: LanguageModel, session) -> Column:
    """Struct (lang_pred, score, ambiguous) of each whole text."""
    shared = session.sparkContext.broadcast(model)  # fixed size: buckets x bits

    @F.pandas_udf(_RESULT)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in batches:
            yield pd.DataFrame([own.predict(t) for t in texts], columns=_RESULT.names)

    return predict(text)


def identify_documents(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct ``language``; an older column of that name is replaced."""
    return docs.withColumn("language", identify(F.col(text_col), model, docs.sparkSession))
