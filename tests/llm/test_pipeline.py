"""The pipeline's stages on planted rows, and its columns."""

import random

import corpus_pipeline as P
from pyspark.sql import functions as F

BENCH = "/root/testdata/sf0.001"


def test_stages(spark):
    item = spark.read.parquet(f"{BENCH}/benchmark.parquet").orderBy("item_id").first().text
    words = [f"word{i}" for i in range(60)]
    rows = [
        (1, " ".join(words), "en"), (2, " ".join(words), "en"), (3, " ".join([*words[:59], "other"]), "en"), (4, "12 34", "en"), (5, None, None), (6, f"before {item} after", "en"),
        (7, "my password=abcdef123456 here and some more words", "en"), (8, "clean text of some words", None), (8, "clean text of some words", None), (9, "", "de"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("*", F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"), F.lit(1).alias("language"), F.lit(2).alias("spans"))
    out, columns = df, df.columns
    kept = []
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, out, BENCH).cache()
        assert out.columns == columns
        kept.append(sorted(r.doc_id for r in out.collect()))
    assert kept == [[1, 2, 3, 6, 7, 8, 8], [1, 6, 7, 8], [1, 7, 8], [1, 7, 8]]
    text = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert text[7] == ("my [SECRET] here and some more words", 36) and text[1] == (rows[0][1], len(rows[0][1]))
    last = P.STAGES[-1][1](spark, out, BENCH).collect()
    assert sorted(r.doc_id for r in last) == [1, 7, 8] and all(len(r.ids) == 4 * r.n_tokens for r in last)
    for _, stage in P.STAGES:
        assert stage(spark, df.limit(0), BENCH).count() == 0


def test_run(spark):
    out = P.run(spark, BENCH)
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    assert 100 < len(ids) <= 200


def test_near_copies_above_the_similarity_go_and_others_stay(spark, sf):
    """Copies with a few words changed: of all pairs that share 80 % of their five-word shingles one stays, and only of these."""
    rng = random.Random(11)
    shingles = lambda words: {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
    rows, gone = [], set()
    for k in range(80):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(40, 300))]
        other = list(base)
        for _ in range(rng.randint(1, 6)):
            other[rng.randrange(len(other))] = f"x{rng.randrange(5000)}"
        one, two = shingles(base), shingles(other)
        rows += [(2 * k, " ".join(base), "en", "s", 1), (2 * k + 1, " ".join(other), "en", "s", 1)]
        if 100 * len(one & two) >= 80 * len(one | two):
            gone.add(2 * k + 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in P.near_dedup(spark, docs, sf).collect()}
    assert kept == {r[0] for r in rows} - gone and 20 < len(gone) < 70
