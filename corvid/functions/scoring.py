"""Scalar scores, decisions, percentiles and splits."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

# Order of the confidence features.
FEATURE_NAMES = [
    "hybrid_score", "top1_margin", "embedding_score", "sift_score", "sift_inliers_log", "ocr_score", "ocr_line_count",
    "title_evidence", "manufacturer_evidence", "grape_evidence", "year_evidence", "view_top1_agreement",
    "winner_view_top1_fraction", "winner_view_top5_fraction", "winner_view_score_mean", "winner_view_consistency",
]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / norm)


def min_max(value: Column, *by: str) -> Column:
    w = Window.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return (value - low) / F.greatest(high - low, F.lit(1e-7))


def fused(embedding: Column, sift: Column, ocr: Column, weights: tuple[float, float, float]) -> Column:
    if min(weights) < 0 or abs(sum(weights) - 1) > 1e-6:
        raise ValueError("weights must not be negative and must sum to one")
    return weights[0] * embedding + weights[1] * sift + weights[2] * ocr


def gate_score(visual: Column, ocr: Column) -> Column:
    return 0.65 * visual + 0.35 * ocr


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(35.0)), F.lit(-35.0))))


def probability(features: Column, mean: list[float], scale: list[float], coefficients: list[float], intercept: float) -> Column:
    z = [(features[i] - m) / s * c for i, (m, s, c) in enumerate(zip(mean, scale, coefficients, strict=True))]
    total = F.lit(0.0)
    for x in z:
        total = total + x
    return sigmoid(total + intercept)


def decision(confidence: Column, accept: float, review: float) -> Column:
    return F.when(confidence >= accept, "match").when(confidence >= review, "alternatives").otherwise("not_found")


def multimodal_verified(ocr: Column, sift: Column, inliers: Column, title: Column) -> Column:
    return (ocr >= 0.92) & (sift >= 0.72) & (inliers >= 12) & (title >= 0.82)


def geometry_score(good: Column, inliers: Column, coverage: Column) -> Column:
    """Score of a feature match from its counts."""
    full = 0.55 * F.least(inliers / 14.0, F.lit(1.0)) + 0.30 * F.least(inliers / F.greatest(good, F.lit(1)) / 0.65, F.lit(1.0)) + 0.15 * F.least(coverage / 0.22, F.lit(1.0))
    weak = F.least(good / 10.0, F.lit(1.0)) * 0.18
    return F.when(good < 4, weak).when(inliers < 4, full * 0.25).otherwise(F.least(F.greatest(full, F.lit(0.0)), F.lit(1.0)))


def relative_support(score: Column, by: str, top: Column, temperature: float = 0.08) -> Column:
    e = F.exp((score - top) / temperature)
    return e / F.sum(e).over(Window.partitionBy(by))


def wilson(successes: Column, n: Column, z: float = 1.96) -> Column:
    p = successes / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.struct(F.greatest(centre - half, F.lit(0.0)).alias("low"), F.least(centre + half, F.lit(1.0)).alias("high")))


def pct_nearest_rank(column: str, p: float) -> Column:
    """The smallest value with a share of at least ``p`` at or below it."""
    return F.expr(f"percentile_disc({p}) within group (order by `{column}`)")


def pct_round_index(values: Column, f: float) -> Column:
    """Of a collected array: the element at the half-even rounded index."""
    return F.element_at(F.sort_array(values), 1 + F.bround((F.size(values) - 1) * F.lit(f)).cast("int"))


def quantile_higher(values: Column, p: float) -> Column:
    return F.element_at(F.sort_array(values), 1 + F.ceil((F.size(values) - 1) * F.lit(p)).cast("int"))


def hash_fold(value: Column, modulus: int) -> Column:
    """SHA-1's first 32 bits modulo ``modulus``."""
    return F.conv(F.substring(F.sha1(value.cast("string")), 1, 8), 16, 10).cast("bigint") % modulus


def field_split(slug: Column) -> Column:
    fold = hash_fold(slug, 5)
    return F.when(slug.isNull(), "unlabeled").when(fold <= 2, "calibration").when(fold == 3, "validation").otherwise("test")


def stable_seed(seed: int, slug: Column, variant: Column) -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), slug.cast("string"), variant.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def round_robin(options: list[str], index: Column) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in options)), (1 + F.pmod(index, F.lit(len(options)))).cast("int"))


def hamming256(a: list[Column], b: list[Column]) -> Column:
    """Differing bits of 256-bit hashes held as four longs each."""
    total = F.lit(0)
    for x, y in zip(a, b, strict=True):
        total = total + F.bit_count(x.bitwiseXOR(y))
    return total


def hash_words(hex64: Column) -> list[Column]:
    return [F.conv(F.substring(hex64, 1 + 16 * k, 16), 16, -10).cast("bigint") for k in range(4)]


def confidence_features(c=F.col) -> Column:
    """The feature vector from named columns, in the fixed order."""
    derived = {
        "sift_inliers_log": F.log1p(c("sift_inliers")) / F.log(F.lit(65.0)),
        "ocr_line_count": F.least(c("ocr_lines") / 6.0, F.lit(1.0)),
        "winner_view_consistency": 1 - F.least(c("winner_score_std") / 0.15, F.lit(1.0)),
    }
    return F.array(*((derived[n] if n in derived else c(n)).cast("double") for n in FEATURE_NAMES))
