"""Scores learnt from the feature table: anomaly, probability, and their evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidgraph.functions.ranks import running
from bidgraph.operators.features import FEATURES
from bidgraph.plans.storage import materialize

#: High values are risky; for the last two low ones are.
RISKY_HIGH = ("cobid_partners", "max_cobid_count", "top_partner_ratio", "shared_director_peers", "shared_address_peers", "complementary_bid_ratio", "degree_centrality", "community_density")
RISKY_LOW = ("min_pair_price_gap", "bid_ratio_std")
FOREST_TREES, FOREST_ROWS = 300, 256
MIN_LABELLED = 12


def drop_empty(features: DataFrame, columns=FEATURES) -> DataFrame:
    """Without rows that are all zero or not finite."""
    some = F.lit(False)
    for c in columns:
        some = some | (F.coalesce(F.col(c), F.lit(0.0)) != 0)
    finite = F.lit(True)
    for c in columns:
        finite = finite & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return features.where(some & finite)


def scale(features: DataFrame, train: DataFrame | None = None, columns=FEATURES) -> DataFrame:
    """(x - mean) / population deviation of the training rows; constant columns are divided by 1."""
    stats = (train if train is not None else features).agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    out = {}
    for c in columns:
        mean, deviation = stats[f"m_{c}"] or 0.0, stats[f"s_{c}"] or 0.0
        out[c] = (F.col(c) - mean) / (deviation if deviation > 0 else 1.0)
    return features.withColumns(out)


def rank_percentiles(df: DataFrame, key: str, columns) -> DataFrame:
    """(key, name, percentile): rank / (n - 1) of each column, ties by the lowest rank, one row .5.

    The distinct values of all columns are ranked, with their counts, in one range-partitioned pass,
    so a value that most rows have is one row of it.
    """
    cells = df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])).alias("c")).select(key, "c.*")
    cells = materialize(cells, "cells")
    values = cells.groupBy("name", "value").agg(F.count("*").alias("rows"))
    ranked = materialize(running(values, [F.col("value")], {"upto": F.col("rows")}, within=("name",)), "ranked")
    total = ranked.groupBy("name").agg(F.sum("rows").alias("n"))
    places = ranked.join(total, "name").select(F.col("name").alias("of"), F.col("value").alias("at"), ((F.col("upto") - F.col("rows")) / (F.col("n") - 1)).alias("rank"), "n")
    found = cells.join(places, (F.col("name") == F.col("of")) & F.col("value").eqNullSafe(F.col("at")))
    return found.select(key, "name", F.when(F.col("n") > 1, F.col("rank")).otherwise(0.5).alias("percentile"))


def orientation(df: DataFrame, key: str) -> DataFrame:
    """(key, orientation): mean rank percentile of the risk-oriented features."""
    p = rank_percentiles(df, key, RISKY_HIGH + RISKY_LOW)
    return p.groupBy(key).agg(F.avg(F.when(F.col("name").isin(*RISKY_LOW), 1 - F.col("percentile")).otherwise(F.col("percentile"))).alias("orientation"))


def _grow(rows: np.ndarray, limit: int, rng, depth: int = 0):
    """A random split tree as nested tuples; a leaf is its depth plus the mean path of its rows."""
    n = len(rows)
    wide = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if n > 1 else []
    if depth >= limit or not len(wide):
        return depth + (2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n if n > 2 else float(n == 2))
    f = int(rng.choice(wide))
    cut = rng.uniform(rows[:, f].min(), rows[:, f].max())
    low = rows[:, f] < cut
    if low.all() or not low.any():
        return float(depth)
    return f, cut, _grow(rows[low], limit, rng, depth + 1), _grow(rows[~low], limit, rng, depth + 1)


def _path(tree, rows: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(rows), tree)
    f, cut, low, high = tree
    out, left = np.empty(len(rows)), rows[:, f] < cut
    out[left], out[~left] = _path(low, rows[left]), _path(high, rows[~left])
    return out


def isolation(scaled: DataFrame, key: str, columns=FEATURES, trees: int = FOREST_TREES, sample: int = FOREST_ROWS) -> DataFrame:
    """(key, isolation): mean path length, negated.

    The trees are grown on a sample of at most ``sample`` * 40 rows, taken by a hash of the key.
    """
    rows = scaled.orderBy(F.xxhash64(key), key).limit(sample * 40).select(*columns).toPandas().to_numpy(float)
    if not len(rows):
        return scaled.select(key, F.lit(0.0).alias("isolation"))
    rng, size = np.random.default_rng(42), min(sample, len(rows))
    forest = [_grow(rows[rng.choice(len(rows), size, replace=False)], int(np.ceil(np.log2(max(2, size)))), rng) for _ in range(trees)]
    shared = scaled.sparkSession.sparkContext.broadcast(forest)  # at most trees * 2 * sample nodes

    @F.pandas_udf(T.DoubleType())
    def score(values: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for v in values:
            x = v.to_numpy(float)
            yield pd.Series(-np.mean([_path(t, x) for t in shared.value], axis=0))

    return scaled.select(key, score(F.struct(*columns)).alias("isolation"))


def anomaly_scores(features: DataFrame, key: str = "company") -> DataFrame:
    """(key, anomaly): .45 of the isolation rank and .55 of the orientation, within 0 and 1."""
    rows = materialize(drop_empty(features).select(key, *FEATURES), "features")
    ranks = rank_percentiles(isolation(scale(rows), key), key, ["isolation"]).select(key, "percentile")
    mixed = ranks.join(orientation(rows, key), key)
    return mixed.select(key, F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.45 * F.col("percentile") + 0.55 * F.col("orientation"))).alias("anomaly"))


def split(labelled: DataFrame, key: str = "company", seed: int = 42, test: float = 0.25, validation: float = 0.15) -> DataFrame:
    """(key, label, part): stratified by label, in the order of a seeded hash of the key.

    A row's place is by its hash value, not by its rank, so no window runs over a whole label.
    """
    share = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(10_000)) / 10_000
    part = F.when(share < test, "test").when(share < test + validation, "validation").otherwise("train")
    return labelled.select(key, "label", part.alias("part"))


def exact_split(labelled: DataFrame, key: str = "company", seed: int = 42, test: float = 0.25, validation: float = 0.15) -> DataFrame:
    """(key, label, part) with exact shares of each label, in the order of a seeded hash of the key.

    Places within a label come from ranges with offsets.  The job fails if a key is in two parts.
    """
    rows = labelled.select(key, "label", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))).alias("_order"))
    placed = running(rows, [F.col("_order"), F.col(key)], {"_place": F.lit(1).cast("long")}, within=("label",))
    sizes = placed.groupBy("label").agg(F.count("*").alias("_size"))
    upto = lambda share: F.floor(share * F.col("_size") + 0.5)
    part = F.when(F.col("_place") <= upto(test), "test").when(F.col("_place") <= upto(test + validation), "validation").otherwise("train")
    parts = materialize(placed.join(sizes, "label").select(key, "label", part.alias("part")), "split")
    shared = parts.groupBy(key).agg(F.count_distinct("part").alias("n")).where("n > 1")
    if not shared.isEmpty():
        raise ValueError(f"the parts of the split share keys, such as {shared.first()[key]}")
    return parts


def neighbour_means(features: DataFrame, edges: DataFrame, key: str = "company", columns=FEATURES) -> DataFrame:
    """Features with the weighted mean of each over a company's neighbours, named ``near_...``."""
    around = edges.select(F.col("a").alias(key), F.col("b").alias("peer"), "weight").unionByName(edges.select(F.col("b").alias(key), F.col("a").alias("peer"), "weight"))
    seen = around.join(features.select(F.col(key).alias("peer"), *columns), "peer")
    means = seen.groupBy(key).agg(*[(F.sum(F.col(c) * F.col("weight")) / F.sum("weight")).alias(f"near_{c}") for c in columns])
    return features.join(means, key, "left").na.fill(0.0)


def probabilities(features: DataFrame, labels: DataFrame, edges: DataFrame, key: str = "company") -> DataFrame | None:
    """(key, model_probability) by a weighted logistic regression on own and neighbours' features.

    None with fewer than MIN_LABELLED labelled rows or one class.
    """
    counts = {r.label: r["count"] for r in labels.groupBy("label").count().collect()}
    n = sum(counts.values())
    if n < MIN_LABELLED or len(counts) < 2:
        return None
    rows = neighbour_means(features.select(key, *FEATURES), edges, key)
    inputs = [c for c in rows.columns if c != key]
    parts = split(labels, key)
    train = rows.join(parts.where("part = 'train'"), key)
    scaled = scale(rows, train, inputs)
    vectors = materialize(VectorAssembler(inputCols=inputs, outputCol="x").transform(scaled).select(key, vector_to_array("x").alias("v")), "vectors")
    vectors = VectorAssembler(inputCols=[f"f{i}" for i in range(len(inputs))], outputCol="x").transform(vectors.select(key, *[F.col("v")[i].alias(f"f{i}") for i in range(len(inputs))]))
    weight = F.when(F.col("label") == 1, n / (2 * counts[1])).otherwise(n / (2 * counts[0]))
    fitted = vectors.join(parts.where("part = 'train'"), key).withColumn("label", F.col("label").cast("double")).withColumn("w", weight)
    if fitted.select("label").distinct().count() < 2:
        return None
    model = LogisticRegression(featuresCol="x", weightCol="w", regParam=0.05, maxIter=50).fit(fitted)
    return model.transform(vectors).select(key, vector_to_array("probability")[1].alias("model_probability"))


def metrics(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row from (label, score): counts, precision, recall, F1, ROC-AUC and average precision."""
    per = scored.groupBy("score").agg(F.sum(F.col("label").cast("long")).alias("p"), F.sum((1 - F.col("label")).cast("long")).alias("n"))
    cum = running(per, [F.desc("score")], {"tp": F.col("p"), "fp": F.col("n")})
    hit = F.col("score") >= threshold
    s = cum.agg(
        F.coalesce(F.sum(F.when(hit, F.col("p"))), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("fp"), F.sum("p").alias("pos"), F.sum("n").alias("neg"),
        F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)).alias("area"), F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"),
    )
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    return s.select(
        tp.alias("true_positive"), fp.alias("false_positive"), (pos - tp).alias("false_negative"), (neg - fp).alias("true_negative"), safe(tp, tp + fp).alias("precision"), safe(tp, pos).alias("recall"),
        safe(2 * tp, tp + fp + pos).alias("f1"), F.when((pos > 0) & (neg > 0), F.col("area") / (pos * neg)).alias("roc_auc"), safe(F.col("ap"), pos).alias("average_precision"),
    )


def best_threshold(scored: DataFrame) -> DataFrame:
    """One row: the median of the thresholds, distinct rounded scores and .5, with the best F1."""
    cuts = scored.select(F.round("score", 4).alias("cut")).distinct().unionByName(scored.select(F.lit(0.5).alias("cut")).distinct()).distinct()
    per = scored.groupBy("score").agg(F.sum(F.col("label").cast("long")).alias("p"), F.count("*").alias("n")).select("score", "p", "n", F.lit(1).alias("kind"))
    marks = cuts.select(F.col("cut").alias("score"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("n"), F.lit(2).alias("kind"))
    total = scored.agg(F.sum(F.col("label").cast("long")).alias("pos")).first()["pos"] or 0
    run = running(per.unionByName(marks), [F.desc("score"), F.col("kind")], {"tp": F.col("p"), "flagged": F.col("n")}).where("kind = 2")
    f1 = run.select("score", F.round(F.when(F.col("flagged") + total > 0, 2 * F.col("tp") / (F.col("flagged") + total)).otherwise(0.0), 9).alias("f1"))
    best = f1.groupBy("f1").agg(F.median("score").alias("threshold"))
    return best.orderBy(F.desc("f1")).limit(1)
