"""Ranking, fusion, gating and calibration, held against plain definitions on made-up data."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvid.functions import scoring
from corvid.operators import confidence, ranking, retrieval

PREDICTIONS = "sample_id string, expected_slug string, predictions array<struct<slug:string,score:double>>, latency_ms double"
CATALOG = "slug string, title string, manufacturer string, region string, category string"
FACTS = [(f"s{k}", f"title {k % 4}", f"maker {k % 3}", "north", f"kind {k % 2}") for k in range(9)]


def made_samples(seed, n=40):
    rng, rows = np.random.default_rng(seed), []
    for i in range(n):
        slugs = [f"s{k}" for k in rng.permutation(9)[: int(rng.integers(0, 8))]]
        scores = sorted(map(float, rng.random(len(slugs))), reverse=True)
        rows.append((f"x{i}", f"s{int(rng.integers(0, 9))}", list(zip(slugs, scores, strict=True)), float(rng.integers(1, 500))))
    return rows


def place(expected, predictions):
    slugs = [s for s, _ in predictions]
    return slugs.index(expected) + 1 if expected in slugs else None


@pytest.mark.parametrize("seed", [1, 2])
def test_summary_and_errors(spark, rows, seed):
    data = made_samples(seed)
    samples, catalog = ranking.evaluated(spark.createDataFrame(data, PREDICTIONS)), spark.createDataFrame(FACTS, CATALOG)
    got = ranking.summary(samples, catalog).first()
    ranks, margins = [place(e, p) for _, e, p, _ in data], [p[0][1] - p[1][1] for _, _, p, _ in data if len(p) > 1]
    assert (got.sample_count, got.top1_correct, got.top5_correct, got.missing, got.invalid) == (40, ranks.count(1), sum(r is not None and r <= 5 for r in ranks), ranks.count(None), 0)
    assert math.isclose(got.mrr, sum(1 / r for r in ranks if r) / 40) and math.isclose(got.mean_margin, sum(margins) / len(margins))
    times = sorted(t for *_, t in data)
    nearest = lambda p: times[math.ceil(p * 40) - 1]
    assert (got.p50_ms, got.p95_ms, got.p99_ms, got.max_ms) == (nearest(0.5), nearest(0.95), nearest(0.99), times[-1])
    facts = {f[0]: f for f in FACTS}
    want = []
    for i, e, p, _ in data:
        if place(e, p) != 1:
            first = facts.get(p[0][0]) if p else None
            want.append((i, p[0][0] if p else None, *(bool(first) and facts[e][c] == first[c] for c in (2, 4, 1))))
    found = [(r["sample_id"], r["predicted_slug"], r["same_manufacturer"], r["same_category"], r["same_title"]) for r in rows(ranking.error_rows(samples, catalog))]
    assert sorted(found) == sorted(want)


def test_weighted_metrics(spark):
    data = [(1, 2.0), (3, 1.0), (None, 1.0), (7, 4.0)]
    got = ranking.rank_metrics(spark.createDataFrame(data, "rank int, w double"), weight="w").first()
    assert (got.n, got.top1, got.top5) == (4, 0.25, 0.375) and math.isclose(got.mrr, round((2 + 1 / 3 + 4 / 7) / 8, 9))


def vectors(seed, n, size=6):
    x = np.random.default_rng(seed).normal(size=(n, size))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize(("k", "cells"), [(3, 10**6), (50, 200), (1, 37)])
def test_search_against_all_scores(spark, k, cells):
    x, q = (np.random.default_rng(seed).integers(-3, 4, (n, 6)).astype(float) for seed, n in ((1, 90), (2, 7)))  # many ties
    index = spark.createDataFrame([(i, v.tolist(), f"g{i % 3}") for i, v in enumerate(x)], "item_id long, embedding array<double>, label string").repartition(4)
    queries = spark.createDataFrame([(i, v.tolist(), f"g{i % 3}") for i, v in enumerate(q)], "query_id long, embedding array<double>, label string")
    got = {(r.query_id, r["rank"]): r for r in retrieval.search(queries, index, k, max_cells=cells, parts={"head": slice(0, 2)}).collect()}
    for i, v in enumerate(q):
        order = sorted(range(90), key=lambda j: (-(x[j] @ v), j))[:k]
        assert [(got[i, n + 1].item_id, got[i, n + 1].score, got[i, n + 1].head) for n in range(len(order))] == [(j, x[j] @ v, x[j][:2] @ v[:2]) for j in order]
    same = retrieval.search(queries, index, k, max_cells=cells, same="label", above=0.0, others_only=True).collect()
    for i, v in enumerate(q):
        want = sorted((j for j in range(90) if j % 3 == i % 3 and j != i and x[j] @ v > 0), key=lambda j: (-(x[j] @ v), j))[:k]
        assert [r.item_id for r in sorted(same, key=lambda r: r["rank"]) if r.query_id == i] == want
    assert retrieval.search(queries.where("false"), index, k).count() == 0 and retrieval.search(queries, index.where("false"), k).count() == 0


def test_patch_maxsim_against_loops(spark):
    query, reference = [vectors(3, 4).tolist(), vectors(4, 2).tolist()], vectors(5, 5).tolist()
    df = spark.createDataFrame([(query, reference)], "q array<array<array<double>>>, r array<array<double>>")
    want = max(sum(max(float(np.dot(t, r)) for r in reference) for t in view) / len(view) for view in query)
    assert math.isclose(df.select(retrieval.patch_maxsim(F.col("q"), F.col("r")).alias("s")).first().s, want)


def test_min_max(spark):
    data = [(7, -1.0), (7, 0.0), (7, 3.0), (8, 5.0), (8, 5.0)]
    got = sorted((r.q, r.n) for r in spark.createDataFrame(data, "q int, v double").withColumn("n", scoring.min_max(F.col("v"), "q")).collect())
    assert got == [(7, 0.0), (7, 0.25), (7, 1.0), (8, 0.0), (8, 0.0)]


@pytest.mark.parametrize("seed", range(3))
def test_candidate_union_against_lists(spark, rows, seed):
    rng = np.random.default_rng(seed)
    visual, text = (rng.random(12).round(3) for _ in range(2))
    text[rng.random(12) < 0.5] = 0
    frame = lambda s: spark.createDataFrame([(5, i, float(x)) for i, x in enumerate(s)], "query_id int, item_id int, score double")
    got = [(r["item_id"], r["source"]) for r in rows(retrieval.candidate_union(frame(visual), frame(text), 4, 3), "position")]
    by = lambda s: sorted(range(12), key=lambda i: (-s[i], i))
    want = [(i, "visual") for i in by(visual)[:4]]
    want += [(i, "ocr") for i in by(text) if text[i] > 0 and i not in by(visual)[:4]]
    want += [(i, "fill") for i in by(visual)[4:7] if i not in {j for j, _ in want}]
    assert got == want[:7]


@pytest.mark.parametrize("seed", range(3))
def test_gate_against_lists(spark, rows, seed):
    rng = np.random.default_rng(seed)
    own, allowed = rng.permutation(20)[:6].tolist(), sorted(rng.permutation(20)[:4].tolist())
    score = rng.random(20).round(4)
    candidates = spark.createDataFrame([(1, i, p + 1) for p, i in enumerate(own)] + [(2, i, p + 1) for p, i in enumerate(own)], "query_id int, item_id int, position int")
    scores = spark.createDataFrame([(1, i, float(s)) for i, s in enumerate(score)], "query_id int, item_id int, score double")
    got = rows(retrieval.gated(candidates, scores, spark.createDataFrame([(1, i) for i in allowed], "query_id int, item_id int"), 5), "query_id", "position")
    first = sorted(allowed, key=lambda i: (-score[i], i))
    assert [r["item_id"] for r in got if r["query_id"] == 1] == [*first, *(i for i in own if i not in allowed)][:5]
    assert [r["item_id"] for r in got if r["query_id"] == 2] == own[:5] and {r["candidate_count"] for r in got} == {0, 4}
    assert {r["item_id"] for r in got if r["allowed"]} == set(allowed)


def test_logistic_and_thresholds(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 2))
    y = rng.random(300) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - x[:, 1])))
    model = confidence.fit_logistic(spark.createDataFrame([(v.tolist(), bool(t)) for v, t in zip(x, y, strict=True)], "x array<double>, y boolean"), "x", "y", 2)
    z = np.c_[np.ones(300), (x - x.mean(0)) / x.std(0)]
    beta = np.array([model.intercept, *model.coefficients])
    gradient = z.T @ (1 / (1 + np.exp(-z @ beta)) - y) + 0.08 * np.r_[0, beta[1:]]
    assert np.abs(gradient).max() < 1e-6  # the optimum of the penalised loss
    p = 1 / (1 + np.exp(-z @ beta))
    known = rng.random(300) < 0.8
    data = [(float(a), bool(b), bool(c)) for a, b, c in zip(p.round(3), y, known, strict=True)]
    accept, review = confidence.choose_thresholds(spark.createDataFrame(data, "confidence double, safe boolean, known boolean"), 0.1, 0.2)
    share = lambda rows, at: sum(c >= at for c in rows) / len(rows)
    good, wrong, unknown = [c for c, s, k in data if k and s], [c for c, s, k in data if k and not s], [c for c, _, k in data if not k]
    assert share(unknown, accept) <= 0.1 and share(wrong, accept) <= 0.2 and review <= accept
    lower = max((c for c, *_ in data if c < accept), default=None)
    assert lower is None or share(unknown, lower) > 0.1 or share(wrong, lower) > 0.2 or share(good, lower) == share(good, accept)


@pytest.mark.parametrize(("confident", "want"), [(0.9, "match"), (0.5, "alternatives"), (0.1, "not_found")])
def test_decisions(spark, confident, want):
    assert spark.range(1).select(scoring.decision(F.lit(confident), 0.8, 0.4).alias("d")).first().d == want


def test_semantic_rerank_needs_a_cue_and_two_predictions(spark, rows):
    data = [(0, 1, "a", 0.5, -0.04, True), (0, 2, "b", 0.45, 0.08, True), (1, 1, "a", 0.5, -0.04, False), (1, 2, "b", 0.45, 0.08, False), (2, 1, "c", 0.2, 0.08, True)]
    got = rows(confidence.semantic_rerank(spark.createDataFrame(data, "query_id int, position int, slug string, score double, bonus double, cued boolean"), cued="cued"), "query_id", "new_position")
    assert [(r["query_id"], r["slug"], r["score"]) for r in got] == [(0, "b", 0.45), (0, "a", 0.5), (1, "a", 0.5), (1, "b", 0.45), (2, "c", 0.2)]


def test_attribute_bonus(spark):
    bonus = lambda key, category: spark.range(1).select(confidence.attribute_bonus(F.lit(key), F.lit(category), F.lit("")).alias("b")).first().b
    assert math.isclose(bonus("white dry", "bel suh"), 0.16) and math.isclose(bonus("white dry", "krasn slad"), -0.08) and bonus("lamp", "bel") == 0


def test_views_agree(spark):
    views = {"wide": [0.3, 0.8, 0.1], "near": [0.2, 0.7, 0.4], "edge": [0.9, 0.6, 0.2]}
    df = spark.createDataFrame([(4, i, v, s, 1) for v, x in views.items() for i, s in enumerate(x)], "query_id int, item_id int, view string, score double, winner int")
    row = retrieval.views_summary(df).first()
    assert (row.agreement, row.top1_fraction, row.top5_fraction) == (round(2 / 3, 9), round(2 / 3, 9), 1.0) and math.isclose(row.score_mean, 0.7)


@pytest.mark.parametrize("value", ["k1", "другой", ""])
def test_split_and_seed(spark, value):
    row = spark.range(1).select(scoring.hash_fold(F.lit(value), 7).alias("f"), scoring.stable_seed(3, F.lit(value), F.lit(9)).alias("s")).first()
    assert row.f == int(hashlib.sha1(value.encode()).hexdigest()[:8], 16) % 7 and int(row.s) == int(hashlib.sha256(f"3:{value}:9".encode()).hexdigest()[:16], 16)


@pytest.mark.parametrize("seed", [1, 2])
def test_auc_against_pairs(spark, seed):
    rng = np.random.default_rng(seed)
    data = [(bool(rng.random() < 0.4), float(rng.integers(0, 30)) / 30) for _ in range(200)]
    pos, neg = [s for y, s in data if y], [s for y, s in data if not y]
    want = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg) / (len(pos) * len(neg))
    assert ranking.auc(spark.createDataFrame(data, "y boolean, s double"), "y", "s").first().auc == round(want, 9)
    assert ranking.auc(spark.createDataFrame([(True, 0.5)], "y boolean, s double"), "y", "s").first().auc == 0.0
