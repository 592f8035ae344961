import hashlib
import re

from pyspark.sql import functions as F

from bidgraph.llm import mixing

SCHEMA = "doc_id long, source string, text string, size string, mix string"


def plain_targets(sizes, weights, most):
    """Sources are filled by weight, the excess of full ones is shared again until none is above."""
    target, full, left = {}, set(), float(sum(sizes.values()))
    while True:
        open_ = [s for s in sizes if s not in full]
        part = left / sum(weights[s] for s in open_) if open_ else 0
        over = [s for s in open_ if weights[s] * part > most * sizes[s]]
        if not over:
            return target | {s: weights[s] * part for s in open_}
        for s in over:
            full.add(s)
            target[s] = most * sizes[s]
            left -= most * sizes[s]


def plain_mix(rows, most=3):
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted({r[1] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = {s: sum(count(r[2]) for r in rows if r[1] == s) for s in order}
    target = plain_targets(sizes, {s: k % 3 + 1 for k, s in enumerate(order)}, most)
    out = []
    for s in order:
        queue = sorted((hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest(), count(r[2]), r[0]) for r in rows if r[1] == s)
        stream = [k for _ in range(most) for k, (_, size, _) in enumerate(queue) for _ in range(size)][: int(target[s] + 0.5)]
        out += [(i, size, sizes[s], target[s], stream.count(k)) for k, (_, size, i) in enumerate(queue)]
    return out


def _rows(mixed):
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken").collect()


def test_mix_equals_a_plain_one_with_odd_rows(spark):
    rows = [(k, f"s{k % 5}", " ".join("w" * (k % 4 + 1)) * (1 + k % 3), "x", "y") for k in range(60)]
    rows += [(100, "tiny", "one two", None, None), (100, "tiny", "one two", None, None), (101, None, "a\tb\x0bc", "", ""), (None, "s0", "x y", "", ""), (102, "s1", None, "", ""), (103, "none", "", "", ""), (104, "\U0001F600", "z " * 30, "", "")]
    rows += [(105, "huge", "long " * 30000, "", "")]
    got = _rows(mixing.mix_documents(spark.createDataFrame(rows, SCHEMA), keep=("doc_id", "size", "mix")))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    assert [(*r[:3], round(r[3], 6), r[4]) for r in sorted(map(tuple, got), key=key)] == [(*r[:3], round(r[3], 6), r[4]) for r in sorted(plain_mix(rows), key=key)]
    assert all(r.taken <= 3 * r.size for r in got)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix_documents(empty).count() == 0 and mixing.training_order(mixing.mix_documents(empty)).count() == 0
    blank = spark.createDataFrame([(1, "a", None, "", ""), (2, None, " ", "", "")], SCHEMA)
    assert [(r.target, r.taken) for r in _rows(mixing.mix_documents(blank))] == [(0.0, 0)] * 2


def test_times_invert_the_integral_of_the_schedule(spark):
    knots, rates = [0.0, 0.25, 0.5, 1.0], [0.0, 2.0, 2.0, 0.5]
    k, r = F.array(*map(F.lit, knots)), F.array(*map(F.lit, rates))
    found = spark.range(0, 101).select((F.col("id") / 100).alias("f")).select("f", mixing.due_at(F.col("f"), k, r, mixing.demand(k, r)).alias("t")).collect()
    def rate(t):
        i = max(i for i in range(3) if knots[i] <= t)
        return rates[i] + (rates[i + 1] - rates[i]) * (t - knots[i]) / (knots[i + 1] - knots[i])
    steps = [(j + 0.5) / 20000 for j in range(20000)]
    whole = sum(map(rate, steps))
    for row in found:
        assert abs(sum(rate(t) for t in steps if t < row.t) / whole - row.f) < 1e-3


def test_documents_come_in_order_of_time_and_light_sources_first(spark):
    docs = spark.createDataFrame([(k, "abc"[k % 3], "word " * 20, "", "") for k in range(600)], SCHEMA)
    order = mixing.training_order(mixing.mix_documents(docs, keep=("doc_id", "source"))).collect()
    times = [r.due.position for r in order]
    assert times == sorted(times) and times == [r.due.position for r in mixing.training_order(mixing.mix_documents(docs.repartition(7), keep=("doc_id", "source"))).collect()]
    half = [r.source for r in order if r.due.position < 0.5]
    total = [r.source for r in order]
    assert abs(half.count("a") / total.count("a") - 0.625) < 0.03 and abs(half.count("b") / total.count("b") - 0.5) < 0.03 and half.count("c") / total.count("c") < 0.5
