"""The log of decisions and the feedback on them.

Recognitions are an append-only table; feedback is one too, and the latest
row of a recognition is the valid one, so an upsert is an append.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.operators.ranking import order_statistic

VERDICTS = ("correct", "incorrect", "not_in_catalog", "not_in_store")


def latest_feedback(feedback: DataFrame, key: str = "recognition_id", at: str = "created_at") -> DataFrame:
    """One row per key, the latest; summed before the shuffle, so a busy key costs a row per task."""
    rest = [c for c in feedback.columns if c != key]
    return feedback.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, *[c for c in rest if c != at])).alias("r")).select(key, "r.*")


def with_feedback(recognitions: DataFrame, feedback: DataFrame, how: str = "left") -> DataFrame:
    """Recognitions with their valid feedback nested, null where there is none."""
    f = latest_feedback(feedback)
    nested = f.select(F.col("recognition_id").alias("f_id"), F.struct(*[c for c in f.columns if c != "recognition_id"]).alias("feedback"))
    return recognitions.join(nested, recognitions.id == nested.f_id, how).drop("f_id")


def listing(log: DataFrame, limit: int, offset: int = 0, mode: str | None = None, decision: str | None = None) -> DataFrame:
    """A page of the log, newest first, with the total of the same filters."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must be 1 to 200 and offset not negative")
    for name, value in (("mode", mode), ("decision", decision)):
        if value is not None:
            log = log.where(F.col(name) == value)
    total = log.count()
    return log.orderBy(F.desc("created_at"), "id").offset(offset).limit(limit).withColumn("total", F.lit(total))


def latest_per_name(log: DataFrame, name: str, *order: str) -> DataFrame:
    """The latest row of each name; ties of the first order column go to the next ones."""
    w = Window.partitionBy(name).orderBy(*(F.desc(c) for c in order), "id")
    return log.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def latest_reviews(log: DataFrame, names: DataFrame, name: str = "original_name") -> DataFrame:
    """Latest reviewed row of each asked name, in the order asked; names without feedback are absent."""
    asked = names.select(F.col(name).alias("asked"), "position")
    found = log.where("feedback is not null").join(asked, F.col(name) == F.col("asked"))
    best = latest_per_name(found, "asked", "created_at")
    return best.orderBy("position")


def statistics(log: DataFrame) -> DataFrame:
    """Totals, decisions, latencies and feedback of a log with nested feedback."""
    verdict = lambda v: F.coalesce(F.sum((F.col("feedback.verdict") == v).cast("long")), F.lit(0).cast("long")).alias(v)
    decided = lambda d: F.coalesce(F.sum((F.col("decision") == d).cast("long")), F.lit(0).cast("long")).alias(f"decision_{d}")
    rows = log.agg(
        F.count("*").alias("total"), *(decided(d) for d in ("match", "alternatives", "not_found")), F.round(F.avg("total_ms"), 6).alias("mean_ms"),
        *(verdict(v) for v in VERDICTS), F.count("feedback").alias("reviewed"),
    )
    return rows


def latency_percentiles(log: DataFrame, by: str, value: str = "total_ms") -> DataFrame:
    """Half-even index percentiles per group."""
    at = lambda f: 1 + F.bround((F.col("n") - 1) * F.lit(f))
    half, most = (order_statistic(log, by, value, at(f)).withColumnRenamed(value, name) for f, name in ((0.5, "p50"), (0.95, "p95")))
    return half.join(most, by).select(by, "p50", "p95")


# What a row of the log and of the feedback must satisfy.
DECISIONS = ("match", "alternatives", "not_found")
RECOGNITION_CHECKS = {"id is missing": "id is not null", "created_at is missing": "created_at is not null", "unknown decision": f"decision in {DECISIONS}"}
FEEDBACK_CHECKS = {"recognition_id is missing": "recognition_id is not null", "unknown verdict": f"verdict in {VERDICTS}", "a correction needs a slug, and only it": "(verdict = 'incorrect') = (correct_slug is not null)"}


def checked(rows: DataFrame, checks: dict[str, str]) -> DataFrame:
    """``rows``; a row that breaks a check (a predicate, null counts as broken) fails the job with the check's name."""
    for message, predicate in checks.items():
        rows = rows.where(F.when(F.coalesce(F.expr(predicate), F.lit(False)), True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
    return rows


def widened(checks: dict[str, str], message: str, column: str, allowed: tuple[str, ...]) -> dict[str, str]:
    """Checks in which ``column`` may hold ``allowed``; stored rows stay as they are, since they met the narrower check."""
    return {**checks, message: f"{column} in {allowed}"}


def append_checked(rows: DataFrame, path: str, checks: dict[str, str], key: str) -> None:
    """Append rows that meet the checks and whose key the table at ``path`` does not have yet."""
    new = checked(rows, checks)
    try:
        stored = rows.sparkSession.read.parquet(path)
    except AnalysisException:  # no table yet
        stored = None
    if stored is not None:
        clash = new.join(stored.select(key), key, "left_semi").limit(1).count()
        if clash:
            raise ValueError(f"a row with this {key} is already stored")
    if new.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError(f"{key} repeats")
    new.write.mode("append").parquet(path)


def expanded(rows: DataFrame, payload: str = "result_json", pipeline: str = "pipeline_json", schema: str = "predictions array<struct<slug: string, score: double>>, decision string", steps: str = "map<string, double>") -> DataFrame:
    """Stored rows as the service returns them: payloads parsed, the feedback columns nested or null without a time."""
    own = [c for c in rows.columns if c.startswith("feedback_")]
    nested = F.when(F.col("feedback_created_at").isNotNull(), F.struct(*(F.col(c).alias(c.removeprefix("feedback_")) for c in own)))
    rest = [c for c in rows.columns if c not in (payload, pipeline, *own)]
    return rows.select(*rest, F.from_json(payload, schema).alias("result"), F.from_json(pipeline, steps).alias("pipeline"), nested.alias("feedback"))


def valid_feedback(verdict: Column, correct_slug: Column) -> Column:
    """A correction names the right item, and only a correction does."""
    return verdict.isin(*VERDICTS) & ((verdict == "incorrect") == correct_slug.isNotNull())


def valid_session(session: Column) -> Column:
    return session.rlike(r"^[A-Za-z0-9._:-]{8,128}$")


def upload_error(size: Column, kind: Column, width: Column, height: Column) -> Column:
    """The first rule that an upload breaks, null if none."""
    return (
        F.when(size.isNull() | (size == 0), "empty").when(size > 15 * 1024 * 1024, "too_large").when(~F.coalesce(kind.isin("JPEG", "PNG", "WEBP"), F.lit(False)), "unsupported")
        .when(F.least(width, height) < 64, "too_small").when(width * height > 40_000_000, "too_many_pixels")
    )


def safe_path(path: Column) -> Column:
    return ~path.rlike(r"(^/|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$))")


def deleted(recognitions: DataFrame, feedback: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the given ids; feedback goes with its recognition."""
    gone = ids.select(F.col("id").alias("gone")).distinct()
    return recognitions.join(gone, recognitions.id == gone.gone, "left_anti"), feedback.join(gone, feedback.recognition_id == gone.gone, "left_anti")


def review_group(verdict: Column) -> Column:
    return F.when(verdict == "correct", "top1_correct").when(verdict == "incorrect", "top5_correct").when(verdict == "not_in_catalog", "top5_miss")


def recheck_reason(verdict: Column, previous: Column, current: Column) -> Column:
    return F.when(verdict == "not_in_store", "ambiguous").when((verdict == "correct") & previous.eqNullSafe(current), "stable").otherwise("needs_recheck")


def expected_slug(fresh_verdict: Column, fresh_slug: Column, fresh_top1: Column, old_slug: Column) -> Column:
    """A fresh verdict decides; without one, history does."""
    return F.when(fresh_verdict == "correct", fresh_top1).when(fresh_verdict == "incorrect", fresh_slug).when(fresh_verdict.isNull(), old_slug)


def annotation(verdict: Column, correct_slug: Column, top1: Column, confidence: Column) -> Column:
    slug = F.when(verdict == "correct", top1).when(verdict == "incorrect", correct_slug)
    return F.struct(slug.alias("expected_slug"), F.when(slug.isNotNull(), "exact").otherwise("needs_exact_wine").alias("label_status"), F.bround(confidence, 6).alias("confidence"))
