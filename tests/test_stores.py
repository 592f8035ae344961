"""Versioned stores, and what is kept in them over several loads and micro-batches."""

import random
from collections import defaultdict

import pytest
from compare import assert_same
from pyspark.sql import functions as F

from bidgraph.operators import incremental
from bidgraph.plans import registry
from bidgraph.sources.store import Store, first_rows, merged_attributes
from bidgraph.streaming import batches

NAMES = "stream_rejects stream_audit stream_status stream_limited_attempts persisted_nodes persisted_edges incremental_pairs bucket_fingerprints".split()


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, name):
    assert_same(registry.QUERIES[name](spark, sf), registry.ORACLE_SQL[name], sf)


def test_streams_come_in_several_batches(spark):
    rows = spark.range(100).select("id")
    seen = []
    batches.run(batches.arriving(spark, rows, "id", 5), lambda batch, number: seen.append(sorted(r.id for r in batch.collect())))
    assert len(seen) == 5 and sum(seen, []) == list(range(100))


def test_a_commit_rewrites_touched_buckets_alone(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", ["k"], buckets=8)
    store.commit(spark.range(100).select(F.col("id").alias("k"), F.lit("a").alias("v")), merged_attributes(["k"]))
    before = store.manifest()["at"]
    touched = store.commit(spark.createDataFrame([(5, "b")], "k long, v string"), merged_attributes(["k"]), ("x", 0))
    after = store.manifest()["at"]
    assert len(touched) == 1 and [b for b in after if after[b] != before[b]] == [str(touched[0])]
    assert store.commit(spark.createDataFrame([(5, "c")], "k long, v string"), merged_attributes(["k"]), ("x", 0)) == []
    store.tidy()
    assert {r.k: r.v for r in store.read().collect()} == {k: "b" if k == 5 else "a" for k in range(100)}
    with pytest.raises(RuntimeError):
        store._folder.write(f"manifest-{store.manifest()['version']:09d}.json", "{}")


def test_absent_attributes_stay_and_first_rows_stay(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/a", ["k"], buckets=4)
    store.commit(spark.createDataFrame([(1, "x", 7), (2, "y", 8)], "k long, v string, w long"), merged_attributes(["k"]))
    store.commit(spark.createDataFrame([(2, None, "new"), (3, "z", None)], "k long, v string, u string"), merged_attributes(["k"]))
    assert sorted(map(tuple, store.read().select("k", "v", "w", "u").collect())) == [(1, "x", 7, None), (2, "y", 8, "new"), (3, "z", None, None)]
    kept = Store(spark, f"file://{tmp_path}/b", ["k"], buckets=4)
    assert kept.read("k long, v string").count() == 0
    kept.commit(spark.createDataFrame([(1, "b"), (1, "a")], "k long, v string"), first_rows(["k"]))
    kept.commit(spark.createDataFrame([(1, "0"), (2, "c")], "k long, v string"), first_rows(["k"]))
    assert sorted(map(tuple, kept.read().collect())) == [(1, "a"), (2, "c")]


def plain_pairs(bids):
    met = defaultdict(list)
    for (c, t), x in bids.items():
        for (d, u), y in bids.items():
            if t == u and c < d:
                met[c, d].append(abs(x - y) / max(abs(x), abs(y)) if x is not None and y is not None else None)
    return {k: (len(v), round(sum(g for g in v if g is not None) / max(1, sum(g is not None for g in v)), 9)) for k, v in met.items()}


def test_pairs_follow_the_feed_and_unchanged_buckets_are_not_read(spark, tmp_path):
    rng = random.Random(4)
    facts, counted = Store(spark, f"file://{tmp_path}/f", ["tender"], buckets=8), Store(spark, f"file://{tmp_path}/p", ["company_a", "company_b"], buckets=4)
    bids = {(f"C{rng.randrange(6)}", f"T{rng.randrange(12)}"): rng.choice([None, 100.0, 150.0, 90.0]) for _ in range(60)}
    frame = lambda b: spark.createDataFrame([(*k, x) for k, x in b.items()], "company string, tender string, bid_amount double")
    found = lambda: {(r.company_a, r.company_b): (r.shared_tenders, round(r.mean_price_gap or 0.0, 9)) for r in incremental.stored_pairs(counted).collect()}
    incremental.apply_feed(facts, counted, frame(bids))
    assert found() == plain_pairs(bids)
    assert incremental.apply_feed(facts, counted, frame(bids)) == []
    first = next(iter(bids))
    bids[first], bids["C9", first[1]] = 42.0, 43.0
    of = facts.touched(frame({first: 1.0}))
    facts._folder.write("aside.json", "{}")  # folders of the other buckets can't be read now
    at = facts.manifest()["at"]
    for b, where in at.items():
        if int(b) not in of:
            for f in (tmp_path / "f" / where).glob("*.parquet"):
                f.write_bytes(b"not parquet")
    assert incremental.apply_feed(facts, counted, frame(bids)) == of and found() == plain_pairs(bids)
    gone = {k: x for k, x in bids.items() if facts.touched(frame({k: x})) != of or k[0] != "C9"}
    assert incremental.apply_feed(facts, counted, frame(gone)) == of and found() == plain_pairs(gone)
    gone["C7", first[1]] = 5.0
    assert incremental.apply_feed(facts, counted, frame({("C7", first[1]): 5.0}), whole=False) == of and found() == plain_pairs(gone)
