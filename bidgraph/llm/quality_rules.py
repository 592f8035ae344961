"""Quality rules with an isolation forest on rule statistics.

The forest is fitted on all labelled documents: each of them is in one tree at least, and in as many
as give a tree its ``LEAST_ROWS`` where there are few.  Trees grow level by level, all at once, from
the extremes of their nodes, which Spark aggregates; only these reach the driver, at most 256 rows a
tree.  Texts of an uncommon make end in short paths.  The threshold is the one that best separates
all good and bad documents that pass the base rules, while failing at most ``max_clean_loss`` of the
good ones; it is found in running counts over the ordered scores.  Scoring is a narrow pass.

Defined cases: a null text is an empty one and fails the base rules; without two good
labelled rows there is no forest and the base rules decide alone; without bad ones the threshold is the stated
loss among good ones; of several labels of an id the largest counts; rows that repeat are judged each, and equal
texts alike; texts of any length are read whole; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidgraph.functions.ranks import running
from bidgraph.llm.text_stats import SHARES, text_stats
from bidgraph.plans.storage import discard, materialize

TREES, LEAST_ROWS, DEPTH = 100, 256, 8
MAX_CLEAN_LOSS = 0.005
#: Shares that don't follow the length of a text.
JUDGED = tuple(c for c in SHARES if c not in ("log_words", "distinct_share", "words_per_line"))


def _mean_path(n: np.ndarray | int) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), (n == 2) * 1.0)


class IsolationForest:
    """Random splits in complete binary trees: below node k are 2k + 1 and 2k + 2, and a leaf has the feature -1."""

    def __init__(self, rows: np.ndarray | None = None, trees: int = TREES, seed: int = 7):
        """Grown from a matrix; without one, ``grow`` is to follow."""
        self.seed = seed
        self.feature = np.full((trees, 2 ** (DEPTH + 1) - 1), -1, np.int16)
        self.cut, self.path = np.zeros(self.feature.shape), np.zeros(self.feature.shape)
        self.typical = 0.0
        if rows is not None:
            each = trees_a_row(len(rows), trees)
            tree = np.random.default_rng(seed).permuted(np.tile(np.arange(trees), (len(rows), 1)), axis=1)[:, :each].ravel()
            values = pd.DataFrame(np.repeat(rows, each, axis=0))

            def extremes(level: int) -> pd.DataFrame:
                parts = values.groupby([tree, self.nodes(values.to_numpy(), tree)])
                found = pd.concat([parts.size(), parts.min(), parts.max()], axis=1).reset_index()
                return found[found.iloc[:, 1] >= 2**level - 1]

            self.grow(extremes)

    def grow(self, extremes: Callable[[int], pd.DataFrame]) -> None:
        """``extremes`` of a level: (tree, node, rows, least values, most values) of its nodes that rows reach."""
        for level in range(DEPTH + 1):
            found = extremes(level)
            found = found.sort_values(list(found.columns[:2])).to_numpy(float)
            tree, node, n = found[:, 0].astype(int), found[:, 1].astype(int), found[:, 2]
            self.path[tree, node] = level + _mean_path(n)
            if level == 0:
                self.typical = float(_mean_path(n).sum())
            if level == DEPTH or not len(found):
                return
            least, most = np.split(found[:, 3:], 2, axis=1)
            rng, varied = np.random.default_rng((self.seed, level)), most > least
            f = np.where(varied, rng.random(varied.shape), -1).argmax(axis=1)
            low, high = least[np.arange(len(f)), f], most[np.arange(len(f)), f]
            self.cut[tree, node] = np.maximum(high - (high - low) * rng.random(len(f)), np.nextafter(low, np.inf))
            self.feature[tree, node] = np.where(varied.any(axis=1), f, -1)

    def nodes(self, rows: np.ndarray, tree: np.ndarray | int) -> np.ndarray:
        """The node of its tree where each row ends."""
        node, at = np.zeros(len(rows), int), np.arange(len(rows))
        for _ in range(DEPTH):
            f = self.feature[tree, node]
            node = np.where(f < 0, node, 2 * node + 1 + (rows[at, f] >= self.cut[tree, node]))
        return node

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; near 1 is isolated by few splits."""
        total = np.zeros(len(rows))
        for tree in range(len(self.path)):
            total += self.path[tree, self.nodes(rows, tree)]
        return 2.0 ** (-total / max(1e-9, self.typical))


def trees_a_row(n_rows: int, trees: int = TREES) -> int:
    """In how many trees each row is, so that a tree has LEAST_ROWS, or all rows where they are fewer."""
    return min(trees, max(1, ceil(trees * LEAST_ROWS / max(1, n_rows))))


def dealt(rows: DataFrame, n_rows: int, trees: int = TREES, seed: int = 7) -> DataFrame:
    """(tree, JUDGED) of each row of (id, JUDGED) and each of its trees, which a hash chooses."""
    strides = F.array(*[F.lit(k) for k in range(1, trees + 1) if gcd(k, trees) == 1])  # each leads through all trees
    first, other = F.pmod(F.xxhash64("id", *JUDGED), F.lit(trees)), F.xxhash64(F.lit(seed), "id", *JUDGED)
    stride = F.get(strides, F.pmod(other, F.size(strides)).cast("int"))
    places = F.sequence(F.lit(0), F.lit(trees_a_row(n_rows, trees) - 1))
    return rows.select(F.explode(F.transform(places, lambda k: F.pmod(first + k * stride, F.lit(trees)).cast("int"))).alias("tree"), *JUDGED)


def fit_forest(rows: DataFrame, n_rows: int, trees: int = TREES, seed: int = 7) -> IsolationForest:
    """A forest of all rows of (id, JUDGED)."""
    own, forest = dealt(rows, n_rows, trees, seed), IsolationForest(None, trees, seed)

    def extremes(level: int) -> pd.DataFrame:
        placed = own.withColumn("node", nodes(F.struct("tree", *JUDGED), forest)).where(F.col("node") >= 2**level - 1)
        ends = [f(c).alias(f"{name}_{c}") for name, f in (("least", F.min), ("most", F.max)) for c in JUDGED if level < DEPTH]
        return placed.groupBy("tree", "node").agg(F.count("*").alias("n"), *ends).toPandas()

    forest.grow(extremes)
    return forest


def nodes(values: Column, forest: IsolationForest) -> Column:
    """The node that a struct of a tree and JUDGED reaches in the forest as it is."""

    @F.pandas_udf(T.IntegerType())
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series(forest.nodes(rows[list(JUDGED)].to_numpy(float), rows["tree"].to_numpy()))

    return place(values)


def calibrate(scores: np.ndarray, good: np.ndarray, max_clean_loss: float) -> float:
    """The score above which a document is anomalous, from arrays; ``threshold`` finds it in a table."""
    floor = float(np.quantile(scores[good], 1 - max_clean_loss)) if good.any() else np.inf
    if good.all() or not good.any():
        return floor
    cuts = np.unique(np.concatenate([scores[scores >= floor], [floor]]))
    clean, bad = np.sort(scores[good]), np.sort(scores[~good])
    caught = 1 - np.searchsorted(bad, cuts, "right") / len(bad)
    lost = 1 - np.searchsorted(clean, cuts, "right") / len(clean)
    return float(cuts[np.argmax(caught - lost)])


def threshold(scored: DataFrame, max_clean_loss: float) -> float:
    """What ``calibrate`` finds, from all rows of (score, good)."""
    counts = scored.groupBy("score").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    upto = running(counts, [F.col("score")], {"clean": F.col("good"), "caught": F.col("bad")})
    n_good, n_bad = upto.agg(F.coalesce(F.max("clean"), F.lit(0)), F.coalesce(F.max("caught"), F.lit(0))).first()
    if not n_good:
        return np.inf
    at = (1 - max_clean_loss) * (n_good - 1)
    reach = lambda place: F.min(F.when(F.col("clean") > place, F.col("score")))
    floor = float(np.quantile(upto.agg(reach(int(at)), reach(min(int(at) + 1, n_good - 1))).first(), at - int(at)))
    if not n_bad:
        return floor
    gain = (1 - F.col("caught") / n_bad) - (1 - F.col("clean") / n_good)
    least = upto.where(F.col("score") <= floor).agg(F.max("clean").alias("clean"), F.max("caught").alias("caught")).select(gain).first()[0]
    best = upto.where(F.col("score") > floor).agg(F.max(F.struct(gain.alias("gain"), (-F.col("score")).alias("below"))).alias("best")).first()["best"]
    return -best["below"] if best and best["gain"] > least else floor


def fit(rows: DataFrame, labels: DataFrame, max_clean_loss: float = MAX_CLEAN_LOSS) -> tuple[IsolationForest, float] | None:
    """Forest and threshold from all labelled rows of (doc_id, quality_rules); None without two good ones that pass the base rules."""
    marks = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(F.max("y").alias("y"))
    s = F.col("quality_rules")
    judged = rows.select(F.col("doc_id").alias("id"), (~base_failed(s["n_words"], s["n_repeat_words"])).alias("passed"), *[s[c].alias(c) for c in JUDGED])
    labelled = materialize(judged.join(marks, "id").withColumn("good", F.col("y") == 1), "labelled")
    n_rows, n_good = labelled.agg(F.count("*"), F.count_if(F.col("good") & F.col("passed"))).first()
    model = None
    if n_good >= 2:
        forest = fit_forest(labelled, n_rows)
        scored = labelled.where("passed").select(anomaly(F.struct(*JUDGED), forest).alias("score"), "good")
        model = forest, threshold(scored, max_clean_loss)
    discard(rows.sparkSession, labelled)
    return model


def anomaly(stats: Column, forest: IsolationForest) -> Column:
    """Isolation score of a struct of statistics."""

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series(forest.score(rows[list(JUDGED)].to_numpy(float)))

    return score(stats)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def judge_documents(docs: DataFrame, labels: DataFrame, text_col: str = "text", max_clean_loss: float = MAX_CLEAN_LOSS) -> DataFrame:
    """``docs`` with a struct ``quality_rules``: the counts, base_failed, anomaly and kept."""
    return judge_statistics(docs.withColumn("quality_rules", text_stats(F.col(text_col))), labels, max_clean_loss)


def judge_statistics(rows: DataFrame, labels: DataFrame, max_clean_loss: float = MAX_CLEAN_LOSS) -> DataFrame:
    """``judge_documents`` for rows that have their ``text_stats`` as ``quality_rules``; they are read twice, so written ones save work."""
    model = fit(rows, labels, max_clean_loss)
    s = F.col("quality_rules")
    failed = base_failed(s["n_words"], s["n_repeat_words"])
    score = anomaly(s, model[0]) if model else F.lit(0.0)
    rows = rows.withColumn("quality_rules", s.withField("anomaly", score))
    kept = ~failed & (s["anomaly"] <= (model[1] if model else 1.0))
    return rows.withColumn("quality_rules", s.withField("base_failed", failed).withField("kept", kept))
