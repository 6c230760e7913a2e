"""The quality classifier's training rows, bounds, ties and splits, held against plain definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvid.llm import quality_classifier as qc

MEASURED = "doc_id long, stats array<float>"


def data(seed, n=160):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, len(qc.FEATURES))).astype(np.float32)
    return x, (x[:, 2] + 0.3 * rng.normal(size=n) > 0).astype(float)


def test_training_rows_are_the_labelled_ones_outside_the_fold(spark):
    x, y = data(1)
    measured = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[0].tolist())], MEASURED).withColumn("mark", F.lit("own"))
    rows = [(i, int(v)) for i, v in enumerate(y) if i % 2 == 0] + [(i, 1 - int(v)) for i, v in enumerate(y) if i % 10 == 0] + [(1, None), (3, None), (None, 1), (9999, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    got = qc.train(measured.select("doc_id", "stats"), labels, "quality", ~qc.fold(3))
    import zlib

    used = [i for i in range(0, len(y), 2) if zlib.crc32(str(i).encode()) % 3 != 1]
    marks = np.array([0.5 if i % 10 == 0 else y[i] for i in used])  # labels that disagree count as their mean
    assert np.allclose(got.score(x), qc.fit(x[used], marks).score(x), atol=1e-6)


def test_the_bound_takes_the_rows_with_the_smallest_hashes(spark):
    x, y = data(2)
    measured = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], MEASURED)
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, quality int")
    s = qc.Settings(max_rows=60, trees=5)
    first = [r.doc_id for r in measured.orderBy(F.xxhash64("doc_id")).limit(60).collect()]
    assert np.allclose(qc.train(measured, labels, "quality", F.lit(True), s).score(x), qc.fit(x[first], y[first], s).score(x), atol=1e-6)


def test_without_labels_or_documents(spark):
    x, _ = data(3, 30)
    measured = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], MEASURED)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert qc.train(measured, none, "quality", F.lit(True)).score(x).tolist() == [0.5] * 30
    one = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int")
    assert (qc.train(measured, one, "quality", F.lit(True)).score(x) > 0.99).all()
    assert qc.scored(measured.where("false"), qc.train(measured, none, "quality", F.lit(True))).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_a_single_split_is_the_best_of_all(seed):
    x, y = data(seed, 90)
    s = qc.Settings(trees=1, depth=1, bins=8, min_rows=5)
    forest = qc.fit(x, y, s)
    bins, p = forest.binned(x), y.mean()
    g, h = y - p, np.full(len(y), p * (1 - p))
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + s.l2)
    best = (-1.0, None, None)
    for f in range(x.shape[1]):
        for b in range(s.bins - 1):
            left = bins[:, f] <= b
            if left.sum() >= s.min_rows and (~left).sum() >= s.min_rows:
                gain = score(left) + score(~left) - score(np.ones(len(y), bool))
                if gain > best[0] + 1e-9:
                    best = (gain, f, b)
    assert (forest.feature[0, 0], forest.split[0, 0]) == best[1:]
    left = bins[:, best[1]] <= best[2]
    assert np.allclose(forest.value[0], [s.rate * g[m].sum() / (h[m].sum() + s.l2) for m in (left, ~left)])


def test_equal_columns_split_on_the_lower_feature():
    x, y = data(5)
    x[:, 7] = x[:, 2]
    forest = qc.fit(x, y, qc.Settings(trees=1, depth=1))
    assert forest.feature[0, 0] == 2


def test_statistics_of_long_and_odd_texts():
    for text in (b"", b" \n", b"word", "éé x".encode(), b"a b " * 200_000, b"x" * 1_000_000):
        got = qc.statistics(text)
        assert len(got) == len(qc.FEATURES) and np.isfinite(got).all()
