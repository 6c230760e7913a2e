"""Quality classifier: histogram gradient-boosted trees over text statistics.

Statistics of each whole text are computed once and written; a bounded sample
of the labelled rows (``max_rows``, the rows with the smallest hashes) trains
the trees; the trees are flattened into arrays and every document is scored
by a vectorised walk over them. Labels, language, source and id never enter
a score.

Defined results: a null or empty text has zero statistics and a score; labels
that repeat or disagree for a document count as their mean; without labels of
both kinds the score is the labelled share (one half without labels); an
empty table gives an empty result; ties of a split go to the lower feature.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvid.llm.common import SPACES, as_bytes, table
from corvid.plans.scratch import materialise

FEATURES = (
    "log_words", "word_bytes", "word_bytes_sd", "symbols", "upper", "digits", "punctuation", "bars", "bangs", "brackets", "non_ascii",
    "distinct_words", "top_word", "same_as_last", "dup_lines", "log_lines", "words_per_line", "words_per_stop", "long_words", "short_words",
    "distinct_pairs", "title_words", "ends_with_stop", "spaces",
)
TYPE = T.ArrayType(T.FloatType())


def _without(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def statistics(text: bytes) -> list[float]:
    words = text.split()
    n, size = len(words), max(1, len(text))
    if not n:
        return [0.0] * len(FEATURES)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ids = np.fromiter(map(hash, words), np.int64, n)
    _, counts = np.unique(ids, return_counts=True)
    pairs = len(np.unique(ids[:-1] * np.int64(31) + ids[1:])) / max(1, n - 1) if n > 1 else 1.0
    lines = [x for x in text.split(b"\n") if x.strip()]
    stops = _without(text, b".?!")
    return [
        np.log1p(n), lengths.mean(), lengths.std(), _without(text, b"#*$%&") / n, _without(text, bytes(range(65, 91))) / size, _without(text, b"0123456789") / size,
        _without(text, b",.;:'\"()-") / n, _without(text, b"|") / n, _without(text, b"!") / n, _without(text, b"{}[]<>") / n, sum(text.count(bytes([b])) for b in (0xC3, 0xC2)) / size if not text.isascii() else 0.0,
        len(counts) / n, counts.max() / n, float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0, 1 - len(set(lines)) / len(lines), np.log1p(len(lines)),
        n / len(lines), n / (stops + 1), float((lengths > 15).mean()), float((lengths <= 2).mean()),
        pairs, sum(w[:1].isupper() for w in words) / n, float(text.rstrip()[-1:] in b".?!"), _without(text, SPACES) / size,
    ]


@F.arrow_udf(TYPE)
def text_statistics(text: pa.Array) -> pa.Array:
    return pa.array([statistics(x) for x in as_bytes(text)], pa.list_(pa.float32()))


@dataclass(frozen=True)
class Settings:
    """Production parameters."""

    max_rows: int = 40_000
    bins: int = 64
    depth: int = 4
    trees: int = 80
    rate: float = 0.15
    l2: float = 1.0
    min_rows: int = 10


@dataclass(frozen=True)
class Forest:
    """Perfect binary trees of equal depth, node k's children at 2k+1 and 2k+2."""

    edges: np.ndarray  # feature x bin edge
    feature: np.ndarray  # tree x inner node
    split: np.ndarray  # tree x inner node: goes right above this bin
    value: np.ndarray  # tree x leaf
    start: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.int16)
        for j, e in enumerate(self.edges):
            out[:, j] = np.searchsorted(e, x[:, j], side="left")
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        rows, bins = np.arange(len(x)), self.binned(x)
        total = np.full(len(x), self.start)
        inner = self.feature.shape[1]
        for feature, split, value in zip(self.feature, self.split, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and node[:1].size and node[0] < inner:
                node = 2 * node + 1 + (bins[rows, feature[node]] > split[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, s: Settings = Settings()) -> Forest:
    """Second-order boosting of the logistic loss over histograms."""
    features = x.shape[1] if x.ndim == 2 else len(FEATURES)
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
    start, inner = float(np.log(share / (1 - share))), 2**s.depth - 1
    flat = Forest(np.zeros((features, s.bins - 1)), np.zeros((0, inner), np.int64), np.zeros((0, inner), np.int64), np.zeros((0, inner + 1)), start)
    if len(y) < 2 * s.min_rows or y.min() == y.max():
        return flat
    edges = np.quantile(x, np.linspace(0, 1, s.bins + 1)[1:-1], axis=0).T.astype(np.float32)
    bins = Forest(edges, flat.feature, flat.split, flat.value, start).binned(x).astype(np.int64)
    logit, trees = np.full(len(y), start), []
    wide = bins + np.arange(features) * s.bins
    for _ in range(s.trees):
        p = 1 / (1 + np.exp(-logit))
        g, h = y - p, p * (1 - p)
        node, feature, split = np.zeros(len(y), np.int64), np.zeros(inner, np.int64), np.full(inner, s.bins, np.int64)
        for level in range(s.depth):
            first, wide_nodes = 2**level - 1, 2**level
            key = ((node - first)[:, None] * (features * s.bins) + wide).ravel()
            shape = (wide_nodes, features, s.bins)
            sums = [np.bincount(key, np.repeat(v, features) if v is not None else None, wide_nodes * features * s.bins).reshape(shape) for v in (g, h, None)]
            left = [np.cumsum(a, axis=2) for a in sums]
            whole = [a[:, :, -1:] for a in left]
            gain = left[0] ** 2 / (left[1] + s.l2) + (whole[0] - left[0]) ** 2 / (whole[1] - left[1] + s.l2) - whole[0] ** 2 / (whole[1] + s.l2)
            gain[(left[2] < s.min_rows) | (whole[2] - left[2] < s.min_rows)] = 0
            best = gain.reshape(wide_nodes, -1).argmax(axis=1)
            worth = gain.reshape(wide_nodes, -1).max(axis=1) > 1e-9
            feature[first : first + wide_nodes] = np.where(worth, best // s.bins, 0)
            split[first : first + wide_nodes] = np.where(worth, best % s.bins, s.bins)
            node = 2 * node + 1 + (bins[np.arange(len(y)), feature[node]] > split[node])
        leaf = node - inner
        value = s.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + s.l2)
        logit += value[leaf]
        trees.append((feature, split, value))
    return Forest(edges, *(np.array([t[k] for t in trees]) for k in range(3)), start)


def train(measured: DataFrame, labels: DataFrame, label: str, in_training, settings: Settings = Settings()) -> Forest:
    """Fit on at most ``max_rows`` labelled rows of ``measured(doc_id, stats)``, chosen by hash."""
    marks = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.avg(label).alias("mark"))
    rows = measured.where(in_training).join(marks, "doc_id").select("doc_id", "stats", "mark")
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.max_rows).select("stats", "mark").toArrow()
    x = np.array(sample["stats"].to_pylist(), np.float32).reshape(-1, len(FEATURES))
    return fit(x, np.asarray(sample["mark"].to_numpy(), float), settings)


def scored(measured: DataFrame, forest: Forest) -> DataFrame:
    """``measured`` plus score; the model's size is fixed by its settings."""
    model = measured.sparkSession.sparkContext.broadcast(forest)

    @F.arrow_udf(T.DoubleType())
    def score(stats: pa.Array) -> pa.Array:
        x = np.asarray(stats.flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, len(FEATURES))
        return pa.array(model.value.score(x), pa.float64())

    return measured.withColumn("score", score("stats"))


def fold(modulus: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(modulus)) == 1


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    measured = materialise(docs.select("doc_id", text_statistics(F.col("text")).alias("stats")), "statistics")
    forest = train(measured, table(spark, sf_dir, "labels"), "quality", ~fold(3))
    return scored(measured, forest).select("doc_id", fold(3).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
