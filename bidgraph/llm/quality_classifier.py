"""Quality classifier: a sparse rule ensemble over text statistics.

Shallow trees are grown on bootstrap samples; every path from a root to a node is a conjunctive
rule.  Lasso logistic regression keeps few rules, and those are compiled into one Spark column
expression over the statistics, so scoring needs no model object in the tasks.

The trees and weights are fitted on a bounded sample of labelled rows (``SAMPLE_ROWS``), chosen by
a hash of ids.  Inputs of a score are statistics of the text alone.

Defined cases: a null text counts as empty and gets the score of zero counts; with labels of one
class only, or none, every text gets the share of label 1 (0.5 without labels); rows that repeat
are scored each, and equal texts alike; texts of any length are read whole; other columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidgraph.llm.text_stats import SHARES, labelled_sample, text_stats

SAMPLE_ROWS = 20_000  # labelled documents that fit the rules
TREES, DEPTH, BINS, LEAST_ROWS = 40, 3, 64, 20
PENALTY, ROUNDS = 0.001, 300
GOOD_FROM = 0.7

Condition = tuple[str, bool, float]  # a statistic, whether it is above, the cut


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    weight: float

    def column(self, stats: Column) -> Column:
        held = F.lit(True)
        for name, above, cut in self.conditions:
            held = held & ((stats[name] > cut) if above else (stats[name] <= cut))
        return held


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    rules: tuple[Rule, ...]

    def score(self, stats: Column) -> Column:
        """Probability of label 1, from a struct of statistics."""
        total = F.lit(self.intercept)
        for rule in self.rules:
            total = total + F.when(rule.column(stats), rule.weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _best_split(binned: np.ndarray, y: np.ndarray, features: np.ndarray) -> tuple[float, int, int]:
    """(gain, feature, bin) of the split with the least Gini impurity."""
    best, n, positives = (0.0, -1, -1), len(y), y.sum()
    for f in features:
        rows = np.bincount(binned[:, f], minlength=BINS).cumsum()[:-1]
        ones = np.bincount(binned[:, f], weights=y, minlength=BINS).cumsum()[:-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            purity = ones**2 / rows + (positives - ones) ** 2 / (n - rows)
        purity[(rows < LEAST_ROWS) | (n - rows < LEAST_ROWS)] = -1
        k = int(purity.argmax())
        gain = purity[k] - positives**2 / n
        if gain > best[0] + 1e-12:
            best = (float(gain), int(f), k)
    return best


def _grow(binned: np.ndarray, y: np.ndarray, rng, path: tuple, found: set) -> None:
    """Add the path to each node below this one; conditions are (feature, above, bin)."""
    if len(path) == DEPTH or len(y) < 2 * LEAST_ROWS or y.min() == y.max():
        return
    features = rng.choice(binned.shape[1], max(2, binned.shape[1] // 2), replace=False)
    gain, f, k = _best_split(binned, y, features)
    if f < 0:
        return
    above = binned[:, f] > k
    for side in (False, True):
        longer = (*path, (f, side, k))
        found.add(tuple(sorted(longer)))
        part = above if side else ~above
        _grow(binned[part], y[part], rng, longer, found)


def _lasso(x: np.ndarray, y: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty by accelerated proximal gradient."""
    n, size = x.shape
    w, b = np.zeros(size), float(np.log(y.mean() / (1 - y.mean())))
    v, c, t = w.copy(), b, 1.0
    probe = np.ones(size) / np.sqrt(max(1, size))
    for _ in range(20):
        probe = x.T @ (x @ probe)
        probe /= max(1e-12, np.linalg.norm(probe))
    step = 4 * n / (float(np.linalg.norm(x @ probe) ** 2) * 1.1 + n)
    for _ in range(ROUNDS):
        slack = 1 / (1 + np.exp(-(x @ v + c))) - y
        moved = v - step * (x.T @ slack) / n
        new_w = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        new_b = c - step * slack.mean()
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new_w + (t - 1) / new_t * (new_w - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    return b, w


def fit_rules(values: np.ndarray, y: np.ndarray, names: tuple[str, ...] = SHARES, trees: int = TREES, penalty: float = PENALTY, seed: int = 11) -> RuleEnsemble:
    """The ensemble for a matrix of statistics and its 0/1 labels."""
    y = np.asarray(y, float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return RuleEnsemble(float(np.log((share + 1e-6) / (1 - share + 1e-6))), ())
    cuts = [np.unique(np.quantile(values[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(values.shape[1])]
    binned = np.stack([np.searchsorted(c, values[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    rng, found = np.random.default_rng(seed), set()
    for _ in range(trees):
        rows = rng.choice(len(y), min(len(y), 4000), replace=True)
        _grow(binned[rows], y[rows], rng, (), found)
    paths = sorted(found)
    held = np.stack([np.logical_and.reduce([(binned[:, f] > k) == side for f, side, k in p]) for p in paths], axis=1).astype(float) if paths else np.zeros((len(y), 0))
    intercept, weights = _lasso(held, y, penalty)
    rules = [Rule(tuple((names[f], side, float(cuts[f][min(k, len(cuts[f]) - 1)])) for f, side, k in p), float(w)) for p, w in zip(paths, weights) if abs(w) > 1e-3]
    return RuleEnsemble(float(intercept), tuple(rules))


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, bound: int = SAMPLE_ROWS) -> RuleEnsemble:
    """``learn``: a condition on ``id`` for the labels that may be learnt from."""
    sample = labelled_sample(docs, labels, "quality", bound, learn).select("id", "y", text_stats(F.col("text")).alias("s"))
    rows = sample.select("id", "y", *[f"s.{c}" for c in SHARES]).toPandas().sort_values(["id", *SHARES])
    return fit_rules(rows[list(SHARES)].to_numpy(float), rows.y.to_numpy(), SHARES)


def score_documents(docs: DataFrame, model: RuleEnsemble, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``quality_score`` from 0 to 1."""
    rows = docs.withColumn("quality_score", text_stats(F.col(text_col)))
    return rows.withColumn("quality_score", model.score(F.col("quality_score")))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id as text, mod ``folds``, is ``fold``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))
