"""Calibration of a confidence model that may decline, and the attribute rerank before it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.functions.scoring import hash_fold, probability, wilson
from corvid.operators.ranking import running_sums, top_k
from corvid.plans.scratch import materialise


@dataclass(frozen=True)
class Logistic:
    mean: list[float]
    scale: list[float]
    coefficients: list[float]
    intercept: float


def fit_logistic(examples: DataFrame, features: str, label: str, size: int, l2: float = 0.08, rounds: int = 100) -> Logistic:
    """Newton steps on the summed loss; each round is one aggregation of a gradient and a Hessian of fixed size."""
    x = [F.col(features)[i].cast("double") for i in range(size)]
    first = examples.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(x)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(x))).first()
    mean = [first[f"m{i}"] or 0.0 for i in range(size)]
    scale = [s if (s := first[f"s{i}"] or 0.0) >= 1e-6 else 1.0 for i in range(size)]
    z = F.array(F.lit(1.0), *((c - m) / s for c, m, s in zip(x, mean, scale, strict=True)))
    rows = materialise(examples.select(z.alias("z"), F.col(label).cast("double").alias("y")), "examples")  # read once a round
    beta, penalty = np.zeros(size + 1), np.diag([0.0] + [l2] * size)
    for _ in range(rounds):
        t = sum((F.col("z")[i] * float(b) for i, b in enumerate(beta)), F.lit(0.0))
        p = 1 / (1 + F.exp(-F.greatest(F.least(t, F.lit(35.0)), F.lit(-35.0))))
        step = rows.select("z", (p - F.col("y")).alias("g"), F.greatest(p * (1 - p), F.lit(1e-5)).alias("h"))
        sums = step.agg(*(F.sum(F.col("g") * F.col("z")[i]) for i in range(size + 1)), *(F.sum(F.col("h") * F.col("z")[i] * F.col("z")[j]) for i in range(size + 1) for j in range(i, size + 1))).first()
        g, upper = np.array(sums[: size + 1], float), iter(sums[size + 1 :])
        hessian = np.zeros((size + 1, size + 1))
        for i in range(size + 1):
            for j in range(i, size + 1):
                hessian[i, j] = hessian[j, i] = next(upper)
        move = np.linalg.solve(hessian + penalty, g + penalty @ beta)
        beta = beta - move
        if np.abs(move).max() < 1e-8:
            break
    return Logistic(mean, scale, beta[1:].tolist(), float(beta[0]))


def choose_thresholds(examples: DataFrame, max_unknown: float = 0.025, max_wrong: float = 0.05) -> tuple[float, float]:
    """Accept and review thresholds over ``(confidence, safe, known)``.

    Rates at a threshold are sums over the scores at or above it, added up in
    ranges of scores.
    """
    c = examples.select("confidence", (F.col("known") & F.col("safe")).alias("good"), (F.col("known") & ~F.col("safe")).alias("wrong"), (~F.col("known")).alias("unknown"))
    by = c.groupBy("confidence").agg(*(F.sum(F.col(k).cast("long")).alias(k) for k in ("good", "wrong", "unknown")))
    total = by.agg(*(F.sum(k).alias(k) for k in ("good", "wrong", "unknown"))).first()
    if not total or total.good is None:
        return 1.0, 1.0
    at = running_sums(by, "confidence", ("good", "wrong", "unknown"), descending=True).select("confidence", *(F.col(f"upto_{k}").alias(k) for k in ("good", "wrong", "unknown")))
    ok = lambda k, most: (F.col(k) <= most * total[k]) if total[k] else F.lit(True)
    feasible = at.where(ok("unknown", max_unknown) & ok("wrong", max_wrong))
    best = feasible.orderBy(F.desc("good"), "confidence").first()
    # just above the next lower score accepts the same rows at the lowest threshold
    if best is None:
        top = by.agg(F.max("confidence").alias("c")).first().c
        accept = 1.0 if top >= 1.0 and total.good else float(np.nextafter(top, 1.0)) if top < 1.0 else 1.0
    else:
        below = by.where(F.col("confidence") < best.confidence).agg(F.max("confidence").alias("c")).first().c
        accept = float(np.nextafter(below, 1.0)) if below is not None else 0.0
    position = F.ceil((F.lit(total.good) - 1) * F.lit(0.05)) + 1
    review = running_sums(by.where("good > 0"), "confidence", ["good"]).where(F.col("upto_good") >= position).agg(F.min("confidence").alias("c")).first().c if total.good else accept
    return accept, min(review, accept)


def final_decision(calibrated: Column, verified: Column, accept: float, review: float) -> dict[str, Column]:
    confidence = F.when(verified, F.greatest(calibrated, F.lit(0.95))).otherwise(calibrated)
    own = F.when(calibrated >= accept, "match").when(calibrated >= review, "alternatives").otherwise("not_found")
    return {"confidence": confidence, "decision": F.when(verified, "match").otherwise(own)}


def rates(examples: DataFrame, accepted: Column) -> DataFrame:
    """False accept, false reject, coverage and precision; null where nothing is in the population."""
    known, safe = F.col("known"), F.col("safe")
    share = lambda c, pop: F.round(F.avg(F.when(pop, c.cast("double"))), 9)
    rows = examples.agg(
        share(accepted, ~known).alias("unknown_far"), share(~accepted, known & safe).alias("false_reject"), share(accepted, F.lit(True)).alias("coverage"), share(known & safe, accepted).alias("precision"),
        F.count_if(~known & accepted).alias("hits"), F.count_if(~known).alias("n_unknown"),
    )
    return rows.withColumn("w", wilson(F.col("hits").cast("double"), F.col("n_unknown").cast("double"))).select("unknown_far", "false_reject", "coverage", "precision", F.round("w.low", 9).alias("far_low"), F.round("w.high", 9).alias("far_high"))


def sources_accepted(examples: DataFrame, accepted: Column) -> DataFrame:
    """Whether any sample of a source was accepted."""
    return examples.groupBy(F.coalesce(F.nullif("source_slug", F.lit("")), F.col("sample_id").cast("string")).alias("source")).agg(F.bool_or(accepted).alias("accepted"))


def calibration_error(examples: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over the literal bin edges (each bin's upper edge is its lower plus the width)."""
    edges = [(float(lo), float(lo) + 1.0 / bins) for lo in np.linspace(0, 1, bins, endpoint=False)]
    place = F.lit(None).cast("int")
    for k, (lo, hi) in reversed(list(enumerate(edges))):
        inside = (F.col(score) >= lo) & ((F.col(score) < hi) if hi < 1.0 else (F.col(score) <= hi))
        place = F.when(inside, k).otherwise(place)
    n = examples.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("y"), F.avg(score).alias("p"))
    return n.agg(F.round(F.sum(F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("y") - F.col("p")))) / F.sum("n"), 9).alias("ece"))


def brier(examples: DataFrame, label: str, score: str) -> DataFrame:
    return examples.agg(F.round(F.avg(F.pow(F.col(score) - F.col(label).cast("double"), F.lit(2))), 9).alias("brier"))


# What a text says about an item's colour, sweetness and sparkle, on Latin keys.
CUES = {
    "colour": {"red": r"\bkrasn|\brubin|\bred|\brouge", "white": r"\bbel|\bwhite|\bblanc", "rose": r"\broz|\brose", "orange": r"\boranzh|\borange|\byantar"},
    "sweetness": {"dry": r"\bsuh|\bdry", "semi_dry": r"\bpolusuh|\bsemi.?dry", "sweet": r"\bslad|\bsweet", "semi_sweet": r"\bpoluslad|\bsemi.?sweet", "brut": r"\bbryut|\bbrut"},
    "sparkling": {"sparkling": r"\bshamp|\bigrist|\bsparkling|\bbrut|\bbryut"},
}
ITEM_COLOURS = {"red": "krasn|rubin|granat|red", "white": "bel|solom|zolot|white", "rose": "roz|pink|rose", "orange": "oranzh|yantar|orange"}


def cues(key: Column, kind: str) -> Column:
    return F.array_compact(F.array(*(F.when(key.rlike(p), F.lit(n)) for n, p in CUES[kind].items())))


def item_colours(category_and_colour: Column) -> Column:
    return F.array_compact(F.array(*(F.when(category_and_colour.rlike(p), F.lit(n)) for n, p in ITEM_COLOURS.items())))


def item_sweetness(category: Column) -> Column:
    has = category.contains
    return F.array_compact(F.array(F.when(has("poluslad"), "semi_sweet"), F.when(has("slad"), "sweet"), F.when(has("polusuh"), "semi_dry"), F.when(has("suh"), "dry"), F.when(has("bryut") | has("brut"), "brut")))


def attribute_bonus(key: Column, category: Column, colour: Column) -> Column:
    """How an item's attributes fit the cues of a query's key; all texts as Latin keys."""
    own = item_sweetness(category)
    pair = lambda a, b: F.arrays_overlap(cues(key, "sweetness"), F.array(F.lit(a), F.lit(b))) & F.arrays_overlap(own, F.array(F.lit(a), F.lit(b)))
    fits = F.arrays_overlap(cues(key, "sweetness"), own) | pair("dry", "semi_dry") | pair("sweet", "semi_sweet")
    sparkling = F.array_contains(own, "brut") | category.contains("sparkling")
    any_of = lambda kind: F.size(cues(key, kind)) > 0
    return (
        F.when(any_of("colour"), F.when(F.arrays_overlap(cues(key, "colour"), item_colours(F.concat_ws(" ", category, colour))), 0.08).otherwise(-0.04)).otherwise(0.0)
        + F.when(any_of("sweetness"), F.when(fits, 0.08).otherwise(-0.04)).otherwise(0.0)
        + F.when(any_of("sparkling"), F.when(sparkling, 0.05).otherwise(-0.025)).otherwise(0.0)
    )


def has_cue(key: Column) -> Column:
    return F.greatest(*(F.size(cues(key, kind)) for kind in CUES)) > 0


def semantic_rerank(predictions: DataFrame, query: str = "query_id", cued: str | None = None) -> DataFrame:
    """New ``position`` by score plus bonus; ties keep their place and the score stays as it was.

    A query without a cue (``cued`` false) or with one prediction keeps its order.
    """
    bonus = F.col("bonus") if cued is None else F.when(F.col(cued), F.col("bonus")).otherwise(0.0)
    own = Window.partitionBy(query)
    moved = F.when(F.count("*").over(own) > 1, F.col("score") + bonus).otherwise(F.col("score"))
    keep = F.lit(False) if cued is None else ~F.max(F.col(cued)).over(own)
    ordered = predictions.withColumn("__by", moved).withColumn("__keep", keep)
    w = Window.partitionBy(query).orderBy(F.when(F.col("__keep"), F.lit(0.0)).otherwise(-F.round("__by", 9)), "position")
    return ordered.withColumn("new_position", F.row_number().over(w)).drop("__by", "__keep")


def build_examples(ranked: DataFrame, expected: DataFrame, query: str = "query_id", item: str = "item_id", folds: int = 5) -> DataFrame:
    """One example per query of ``ranked(query, item, score, ...)``: what the calibration reads.

    The winner is the best item by score, then item; ``known`` says whether
    ``expected(query, expected, source)`` names an item, ``safe`` whether the
    winner is it, ``top5`` whether it is among five, ``margin`` how far the
    second is. A fifth of the sources (by SHA-1) is the validation split, so
    pictures of one source stay together.
    """
    five = top_k(ranked, 5, query, item)
    best = five.groupBy(query).agg(F.max(F.when(F.col("rank") == 1, F.col(item))).alias("winner"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("score"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"), F.collect_set(item).alias("five"))
    rows = expected.join(best, query, "left")
    known = F.col("expected").isNotNull()
    safe = known & F.coalesce(F.col("winner") == F.col("expected"), F.lit(False))
    split = F.when(hash_fold(F.coalesce(F.nullif("source", F.lit("")), F.col(query).cast("string")), folds) == 0, "validation").otherwise("calibration")
    return rows.select(query, "source", "expected", "winner", "score", (F.col("score") - F.col("second")).alias("margin"), known.alias("known"), safe.alias("safe"), F.coalesce(F.array_contains("five", F.col("expected")), F.lit(False)).alias("top5"), split.alias("split"))


def recognised(predictions: DataFrame, model: Logistic, features: Column, verified: Column, accept: float, review: float, query: str = "query_id", cued: str = "cued") -> DataFrame:
    """The whole decision: attribute rerank, features of the new winner, calibrated confidence, verification, decision.

    ``predictions(query, position, slug, score, bonus, cued, ...)``; ``features``
    and ``verified`` are columns over the winner's row, in which ``margin`` is
    its score minus the new second's.
    """
    moved = semantic_rerank(predictions, query, cued)
    second = F.lead("score").over(Window.partitionBy(query).orderBy("new_position"))
    winner = moved.withColumn("margin", F.col("score") - second).where("new_position = 1")
    calibrated = probability(features, model.mean, model.scale, model.coefficients, model.intercept)
    scored = winner.withColumn("calibrated", calibrated).withColumn("verified", verified)
    return scored.withColumns(final_decision(F.col("calibrated"), F.col("verified"), accept, review)).select(query, "slug", "score", "margin", "calibrated", "verified", "confidence", "decision")


def anchored(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Slug of the first rule whose pattern the text has (look-aheads allowed), null if none."""
    return F.coalesce(*(F.when(text.rlike(p), F.lit(s)) for p, s in rules)) if rules else F.lit(None).cast("string")
