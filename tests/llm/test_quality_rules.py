"""The isolation forest and its threshold take all labelled documents; both against brute force."""

import numpy as np
from pyspark.sql import functions as F

from bidgraph.llm import quality_rules
from bidgraph.llm.quality_rules import DEPTH, JUDGED

FORMER_BOUND = 20_000


def judged_rows(spark, n, seed=2):
    rng = np.random.default_rng(seed)
    values = np.round(rng.normal(size=(n, len(JUDGED))), 1)
    values[:, 0] = 1.0  # a share that is the same everywhere
    return spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(values)], ", ".join(["id long", *(f"{c} double" for c in JUDGED)])), values


def test_labels_beyond_the_former_bound_count(spark):
    """Of one make are 0.4 % of the first 20,000 labelled good documents and all 600 others: too many to be lost."""
    ids = spark.range(FORMER_BOUND + 600).select(F.col("id").alias("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    late = spark.createDataFrame([(r.doc_id, k >= FORMER_BOUND) for k, r in enumerate(ids)], "doc_id long, late boolean")
    words = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda k: F.concat(F.substring(F.lit("abcdefghijklmnop"), 1, (2 + F.pmod(F.hash("doc_id", k), F.lit(9))).cast("int")), k.cast("string")))
    text = F.array_join(words, " ")
    docs = late.select("doc_id", "late", F.when(F.col("late") | (F.pmod(F.hash("doc_id"), F.lit(250)) == 0), F.upper(F.concat(text, F.lit("!!! ***")))).otherwise(text).alias("text")).repartition(4)
    labels = late.select("doc_id", F.lit(1).alias("quality"))
    found = quality_rules.judge_documents(docs, labels).groupBy("late").agg(F.count("*").alias("n"), F.count_if("quality_rules.kept").alias("kept"), F.count_if("quality_rules.base_failed").alias("failed")).collect()
    assert {r.late: r.n for r in found} == {False: FORMER_BOUND, True: 600} and not any(r.failed for r in found)
    assert sum(r.n - r.kept for r in found) <= quality_rules.MAX_CLEAN_LOSS * (FORMER_BOUND + 600)


def test_each_row_is_in_its_number_of_trees(spark, monkeypatch):
    rows, values = judged_rows(spark, 300)
    for least, each in ((2, 1), (4, 2), (256, 86), (1000, 100)):
        monkeypatch.setattr(quality_rules, "LEAST_ROWS", least)
        assert quality_rules.trees_a_row(300) == each
        found = quality_rules.dealt(rows, 300).groupBy(*JUDGED).agg(F.count("*").alias("n"), F.count_distinct("tree").alias("trees")).collect()
        assert len(found) == len(set(map(tuple, values))) and {(r.n, r.trees) for r in found} == {(each, each)}


def test_path_lengths_equal_brute_force(spark):
    rows, values = judged_rows(spark, 200)
    forest = quality_rules.fit_forest(rows, 200, 12)
    again = quality_rules.fit_forest(rows.repartition(7), 200, 12)
    assert all(np.array_equal(getattr(forest, k), getattr(again, k)) for k in ("feature", "cut", "path"))

    def mean_path(n):
        return 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    total = np.zeros(200)
    for tree in range(12):  # few enough rows for each tree to have all
        parts = [(0, 0, np.arange(200))]
        while parts:
            node, depth, at = parts.pop()
            f, part = forest.feature[tree, node], values[at]
            if depth == DEPTH or (part == part[0]).all():
                assert f == -1
                total[at] += depth + mean_path(len(at))
                continue
            assert f > 0 and part[:, f].min() < forest.cut[tree, node] <= part[:, f].max()
            below = part[:, f] < forest.cut[tree, node]
            parts += [(2 * node + 1, depth + 1, at[below]), (2 * node + 2, depth + 1, at[~below])]
    assert np.allclose(forest.score(values), 2 ** (-total / (12 * mean_path(200))), rtol=1e-12)


def test_threshold_equals_calibration(spark):
    rng = np.random.default_rng(5)
    cases = [(np.round(rng.random(n), 2 if k % 2 else 9), rng.random(n) < share) for k, (n, share) in enumerate([(400, 0.8), (400, 0.8), (90, 0.05), (60, 1), (60, 0), (1, 1)])]
    cases = [(scores + 0.5 * ~good, good) for scores, good in cases[:2]] + cases[1:]
    for scores, good in cases:
        table = spark.createDataFrame(list(zip(scores.tolist(), good.tolist())), "score double, good boolean")
        assert quality_rules.threshold(table, 0.1) == quality_rules.calibrate(scores, good, 0.1)
