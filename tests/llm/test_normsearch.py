import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemoframe.llm import normsearch

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, positives=5, negatives=10, every=100):
    good = {}
    for vec, x, label in rows:
        if vec is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        good[vec, tuple(math.floor(256 * float(np.float32(c))) for c in x), (label + 1) % 10 if vec % 7 == 0 else label] = None
    good = list(good)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, v, own in good:
        if a % every:
            continue
        scored = sorted((-dot(v, w), b, label) for b, w, label in good if b != a)
        for s, p, _ in [t for t in scored if t[2] == own][:positives]:
            found = [(n, -t) for t, n, label in scored if label != own and 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out += [(a, p, i, n, -s, t) for i, (n, t) in enumerate(found, 1)]
    return sorted(out)


def got(df, **sizes):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = normsearch.hard_negatives(df, label, F.col("vec_id") % 100 == 0, **sizes)
    return sorted(tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.fixture()
def rows():
    rng = random.Random(6)
    vector = lambda scale: [rng.gauss(0.3, 1) * scale for _ in range(6)]
    out = [(i, vector(rng.choice([0.01, 0.1, 1, 1, 4])), rng.choice([1, 1, 1, 2, 3])) for i in range(900)]
    same = vector(1)
    out += [(1000 + i, same, rng.choice([1, 2])) for i in range(150)]  # ties
    out += [(2000, None, 1), (2001, vector(1), None), (None, vector(1), 1), (2100, [1.0, float("nan")], 1), (2200, [None, 1.0], 2), (2300, [float("inf")] * 6, 1), (2400, [], 1), (2500, [0.5, 0.5], 2), (2600, [0.0] * 6, 3)]
    return out + [out[100], out[100], out[5]]


@pytest.mark.parametrize("sizes", [{}, {"span": 64, "bucket": 16, "block": 3}, {"span": 10_000, "bucket": 7, "block": 1}])
def test_equals_brute_force(spark, rows, sizes):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("norm", F.lit("x")).withColumn("block", F.lit(1)).repartition(3)
    assert got(df, **sizes) == brute(rows)


def test_buckets_out_of_reach_are_not_read(spark, rows, monkeypatch):
    """Long vectors that fill the first places prune all short ones."""
    read = []

    class Counted(normsearch.First):
        def offer(self, score, ids):
            read.append(len(ids))
            super().offer(score, ids)

    long = np.array([[10.0, 0.0]] * 20 + [[0.1, 0.0]] * 80)
    first = Counted(5, -normsearch.TOO_LONG)
    norms = np.sqrt((long * long).sum(axis=1))
    for s in range(0, 100, 10):
        if norms[s] * 10 >= first.limit:
            first.offer((long[s : s + 10] @ np.array([10.0, 0.0])).astype(np.int64), np.arange(s, s + 10))
    assert first.ids.tolist() == [0, 1, 2, 3, 4] and read == [10, 10]


def test_large_components_stay_exact():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(1 << 28), 1 << 28, (3, 4)), rng.integers(-(1 << 28), 1 << 28, (5, 4))
    want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
    assert normsearch.products(a.astype(float), b.astype(float), 2.0**60).tolist() == want


def test_empty_table(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
