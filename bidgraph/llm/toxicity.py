"""Toxicity by a chain of linear classifiers.

Categories are predicted one after another; each logistic model sees the words of the text and
the probabilities of the earlier categories.  Later models are trained with out-of-fold
predictions of the earlier ones, so they learn from what they will see.  Words and word beginnings
enter as features when they are tied to toxic rows beyond chance in a bounded labelled sample, by
the rows that hold them or by those that consist of them for one word in a hundred.

Categories: ``toxic`` is the label itself and the last of the chain.  There is no finer label, so
the first two are toxic rows of two kinds, told by two views of the text: ``worded`` rows are those
that a model of whole words alone finds, ``inflected`` rows those that a model of word beginnings
alone finds, each by a model that hasn't seen the row.  How much of a text is made of tied words
enters all models too, as steps of AMOUNTS: one insult in a long text weighs less than three in a line.

Limits: the chain is fitted on at most SAMPLE_ROWS labelled documents and has the MAX_FEATURES
features of the largest z of all that pass LEAST_Z; ties of z go by name.

Defined cases: a null or empty text has no features and gets the probabilities of none; with
labels of one class only, or none, every probability is the share of that label (0 without
labels); rows that repeat are judged each; other columns are kept.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidgraph.llm.text_stats import labelled_sample

SAMPLE_ROWS = 20_000  # labelled documents that select the features and fit the chain
MAX_FEATURES, LEAST_Z, LEAST_ROWS = 400, 6.0, 4
HEAVY = 0.01  # a feature is heavy in a text when it makes up this share of its words
FOLDS, RIDGE = 5, 0.3
CATEGORIES = ("worded", "inflected", "toxic")
BEGINNINGS = (4, 5, 6)
HITS, WORD_SHARES = (2, 3, 5, 8), (0.003, 0.006, 0.012, 0.025, 0.05)  # at least so many tied words, and of all words
AMOUNTS = (*[f"{n} hits" for n in HITS], *[f"{s} of words" for s in WORD_SHARES])
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> Counter[str]:
    """Occurrences of words, and of beginnings of longer words marked by a hyphen."""
    words, out = Counter(_WORD.findall((text or "").lower())), Counter()
    for w, n in words.items():
        out[w] += n
        for k in BEGINNINGS:
            if len(w) > k:
                out[f"{w[:k]}-"] += n
    return out


def _with_weight(text: str | None) -> list[tuple[str, bool]]:
    """(feature, heavy) of a text."""
    least = HEAVY * max(1, len(_WORD.findall(text or "")))
    return [(f, n >= least) for f, n in features(text).items()]


class Lookup:
    """Indices of the chosen features in a text, without building all its features."""

    def __init__(self, chosen: tuple[str, ...]):
        self.words = {f: k for k, f in enumerate(chosen) if not f.endswith("-")}
        self.starts = {f[:-1]: k for k, f in enumerate(chosen) if f.endswith("-")}
        self.heads = {s[: BEGINNINGS[0]] for s in self.starts}
        self.size = len(chosen)

    def _of_word(self, word: str) -> list[int]:
        found = [self.words[word]] if word in self.words else []
        if word[: BEGINNINGS[0]] in self.heads:
            found += [self.starts[word[:n]] for n in BEGINNINGS if len(word) > n and word[:n] in self.starts]
        return found

    def indices(self, text: str | None) -> list[int]:
        return sorted({k for w in set(_WORD.findall((text or "").lower())) for k in self._of_word(w)})

    def encode(self, text: str | None) -> list[int]:
        """``indices``, and behind them those of AMOUNTS."""
        counted = Counter(_WORD.findall((text or "").lower()))
        found, hits, total = set(), 0, counted.total()
        for word, n in counted.items():
            tied = self._of_word(word)
            if tied:
                found.update(tied)
                hits += n
        reached = [hits >= n for n in HITS] + [total > 0 and hits >= s * total for s in WORD_SHARES]
        return sorted(found) + [self.size + k for k, r in enumerate(reached) if r]


def _table(held: list[list[int]], width: int) -> np.ndarray:
    x = np.zeros((len(held), width))
    for row, found in enumerate(held):
        x[row, found] = 1
    return x


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last coefficient is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], RIDGE)
    penalty[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + penalty * w
        bend = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(bend, slope)
        w -= step
        if abs(step).max() < 1e-6:
            break
    return w


def _predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


@dataclass(frozen=True)
class Chain:
    chosen: tuple[str, ...]  # the tied features, then AMOUNTS
    models: tuple[np.ndarray, ...]
    threshold: float

    def lookup(self) -> Lookup:
        return Lookup(self.chosen[: -len(AMOUNTS)])

    def probabilities(self, held: list[list[int]]) -> np.ndarray:
        """A row per text, a column per category."""
        base = _table(held, len(self.chosen))
        out = np.zeros((len(held), 0))
        for w in self.models:
            out = np.hstack([out, _predict(np.hstack([base, out]), w)[:, None]])
        return out


def fit_chain(held: list[list[int]], y: np.ndarray, fold: np.ndarray, chosen: tuple[str, ...]) -> Chain:
    """``y``: a column per category.  Rows with the same features, labels and fold count together."""
    base = _table(held, len(chosen))
    rows, n = np.unique(np.hstack([base, y, fold[:, None]]), axis=0, return_counts=True)
    base, y, fold = rows[:, : len(chosen)], rows[:, len(chosen) : -1], rows[:, -1]
    models, earlier = [], np.zeros((len(rows), 0))
    for c in range(y.shape[1]):
        x = np.hstack([base, earlier])
        models.append(_logistic(x, y[:, c], n))
        unseen = np.zeros(len(rows))
        for k in np.unique(fold):
            other = fold != k
            unseen[~other] = _predict(x[~other], _logistic(x[other], y[other, c], n[other]) if other.any() else models[-1])
        earlier = np.hstack([earlier, unseen[:, None]])
    last, truth = earlier[:, -1], y[:, -1]
    cuts = np.unique(last)
    f1 = [2 * (n * truth)[last >= t].sum() / max(1, n[last >= t].sum() + (n * truth).sum()) for t in cuts]
    best = int(np.argmax(f1))
    below = cuts[best - 1] if best else 0.0
    return Chain(chosen, tuple(models), float((cuts[best] + below) / 2))


def _choose(sample: DataFrame) -> tuple[str, ...]:
    """Features tied to toxic rows: more of these than of the others hold them, or hold them heavily, than chance allows."""

    @F.pandas_udf("array<struct<feature:string,heavy:boolean>>")
    def all_features(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"feature": f, "heavy": h} for f, h in _with_weight(t)] for t in texts], dtype=object)

    sizes = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return ()
    one, other, heavy = F.col("y") == 1, F.col("y") == 0, F.col("heavy")
    held = sample.select("y", F.explode(all_features("text")).alias("f")).select("y", "f.*").groupBy("feature")
    per = held.agg(F.count_if(one).alias("a"), F.count_if(other).alias("b"), F.count_if(one & heavy).alias("ha"), F.count_if(other & heavy).alias("hb")).where(F.col("a") >= LEAST_ROWS)

    def z(a: str, b: str) -> Column:
        share = (F.col(a) + F.col(b)) / (toxic + clean)
        value = (F.col(a) / toxic - F.col(b) / clean) / F.sqrt(share * (1 - share) * (1 / toxic + 1 / clean))
        return F.when((F.col(a) >= LEAST_ROWS) & (share < 1), value).otherwise(0.0)

    top = per.withColumn("z", F.greatest(z("a", "b"), z("ha", "hb"))).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "feature").limit(MAX_FEATURES)
    return tuple(sorted(r.feature for r in top.select("feature").collect()))


def seen_by_views(held: list[list[int]], toxic: np.ndarray, fold: np.ndarray, chosen: tuple[str, ...]) -> list[np.ndarray]:
    """A 0/1 label per view (whole words, beginnings): toxic rows that a model of the other folds and of this view alone finds."""
    rows, back, n = np.unique(np.hstack([_table(held, len(chosen)), toxic[:, None], fold[:, None]]), axis=0, return_inverse=True, return_counts=True)
    y, folds, labels = rows[:, -2], rows[:, -1], []
    starts = np.array([f.endswith("-") for f in chosen], bool)
    for view in (~starts, starts):
        x, found = rows[:, :-2][:, view], np.zeros(len(rows))
        for k in np.unique(folds):
            other = folds != k
            if other.any():
                found[~other] = _predict(x[~other], _logistic(x[other], y[other], n[other]))
        labels.append(toxic * (found[back.reshape(-1)] >= 0.5))
    return labels


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> Chain:
    sample = labelled_sample(docs, labels, "toxic", bound).persist()
    chosen = _choose(sample)
    lookup = Lookup(chosen)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series([lookup.encode(t) for t in texts], dtype=object)

    rows = sample.select("id", "y", encode("text").alias("held")).toPandas().sort_values("id")
    sample.unpersist()
    if not len(rows) or rows.y.nunique() < 2:
        share = float(rows.y.mean()) if len(rows) else 0.0
        flat = np.array([np.log((share + 1e-9) / (1 - share + 1e-9))])
        return Chain((), tuple(np.concatenate([np.zeros(k), flat]) for k in range(len(CATEGORIES))), 0.5)
    toxic, fold = (rows.y == 1).to_numpy(float), (rows.id % FOLDS).to_numpy()
    held = [list(h) for h in rows.held]
    views = seen_by_views([[k for k in h if k < len(chosen)] for h in held], toxic, fold, chosen)
    return fit_chain(held, np.column_stack([*views, toxic]), fold, (*chosen, *AMOUNTS))


_RESULT = T.StructType([T.StructField(c, T.DoubleType()) for c in CATEGORIES])


def toxicity(text: Column, chain: Chain) -> Column:
    """Struct of the probability of each category of a whole text."""

    @F.pandas_udf(_RESULT)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lookup = chain.lookup()
        for texts in batches:
            yield pd.DataFrame(chain.probabilities([lookup.encode(t) for t in texts]), columns=list(CATEGORIES))

    return score(text)


def judge_documents(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct ``toxicity``: the categories' probabilities and ``flagged``."""
    rows = docs.withColumn("toxicity", toxicity(F.col(text_col), chain))
    return rows.withColumn("toxicity", F.col("toxicity").withField("flagged", F.col("toxicity.toxic") >= chain.threshold))
