"""Ranking, retrieval metrics and the evaluation of ranked predictions.

One total order everywhere: score descending, then item ascending.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.plans.scratch import materialise


def top_k(scored: DataFrame, k: int, query: str = "query_id", item: str = "item_id", score: str = "score") -> DataFrame:
    """The best ``k`` per query with their rank; Spark cuts each task's rows before the shuffle."""
    w = Window.partitionBy(query).orderBy(F.desc(score), F.asc(item))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rank_of_expected(slugs: Column, expected: Column) -> Column:
    return F.nullif(F.array_position(slugs, expected), F.lit(0))


def top1_margin(predictions: Column) -> Column:
    a, b = F.try_element_at(predictions, F.lit(1)), F.try_element_at(predictions, F.lit(2))
    return a["score"] - b["score"]


def rank_metrics(ranked: DataFrame, by: Sequence[str] = (), rank: str = "rank", weight: str | None = None) -> DataFrame:
    """Shares and reciprocal ranks of one row per sample, by weight if there is one; a missing rank counts as zero."""
    r, w = F.col(rank), F.lit(1.0) if weight is None else F.col(weight)
    share = lambda x: F.round(F.sum(w * F.coalesce(x, F.lit(0.0))) / F.sum(w), 9)
    out = ranked.groupBy(*by) if by else ranked.groupBy()
    return out.agg(F.count("*").alias("n"), share((r == 1).cast("double")).alias("top1"), share((r <= 5).cast("double")).alias("top5"), share(1 / r).alias("mrr"))


def running_sums(rows: DataFrame, by: str, columns: Sequence[str], descending: bool = False) -> DataFrame:
    """``rows`` plus ``upto_<column>``: sums over all rows up to and with this one in the order of ``by`` (distinct values).

    Rows are sorted in ranges; each range adds up its own rows, and a short
    table of the ranges' totals gives what came before. No task sees them all.
    """
    order = F.desc(by) if descending else F.asc(by)
    ranged = materialise(rows.repartitionByRange(order).withColumn("__range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("__range").agg(*(F.sum(c).alias(f"__{c}") for c in columns))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    before = totals.select("__range", *(F.coalesce(F.sum(f"__{c}").over(earlier), F.lit(0)).alias(f"__{c}") for c in columns))
    own = Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(F.broadcast(before), "__range").select(*rows.columns, *((F.sum(c).over(own) + F.col(f"__{c}")).alias(f"upto_{c}") for c in columns))


def expected_ranks(scored: DataFrame, expected: DataFrame, query: str = "query_id", item: str = "item_id", score: str = "score") -> DataFrame:
    """Rank of the expected item of each query (by its best-placed row), null if it is no candidate."""
    w = Window.partitionBy(query).orderBy(F.desc(score), F.asc(item))
    placed = scored.withColumn("rank", F.row_number().over(w))
    hit = expected.join(placed, [query, item], "left")
    return hit.groupBy(query).agg(F.min("rank").alias("rank"))


def breakdown(samples: DataFrame, field: str, missing: str | None = "<missing>") -> DataFrame:
    """Metrics per value of a field; rows without a value go under ``missing`` or, if that is null, out."""
    value = F.nullif(F.col(field).cast("string"), F.lit(""))
    rows = samples.withColumn("value", F.coalesce(value, F.lit(missing))) if missing is not None else samples.where(F.col(field).isNotNull()).withColumn("value", F.col(field).cast("string"))
    return rank_metrics(rows, ["value"]).orderBy(F.desc("n"), "value")


def evaluated(predictions: DataFrame) -> DataFrame:
    """``rank`` and ``margin`` of ``(sample_id, expected_slug, predictions array<struct<slug, score>>, ...)``."""
    return predictions.withColumn("rank", rank_of_expected(F.col("predictions.slug"), F.col("expected_slug"))).withColumn("margin", top1_margin(F.col("predictions")))


def summary(samples: DataFrame, catalog: DataFrame) -> DataFrame:
    """The evaluation report as one row."""
    known = catalog.select(F.col("slug").alias("known")).distinct()
    invalid = samples.select(F.explode("predictions.slug").alias("slug")).join(known, F.col("slug") == F.col("known"), "left_anti").agg(F.count("*").alias("invalid"), F.count_distinct("slug").alias("unique_invalid"))
    r = F.col("rank")
    pct = lambda c, p: F.expr(f"percentile_disc({p}) within group (order by {c})")
    main = samples.agg(
        F.count("*").alias("sample_count"), F.count_if(r == 1).alias("top1_correct"), F.count_if(r <= 5).alias("top5_correct"),
        F.avg(F.coalesce(1 / r, F.lit(0.0))).alias("mrr"), F.count_if(r.isNull()).alias("missing"), F.count_if(~F.coalesce(r == 1, F.lit(False))).alias("errors"),
        F.count("margin").alias("margin_count"), F.avg("margin").alias("mean_margin"), F.median("margin").alias("median_margin"), pct("margin", 0.05).alias("p05_margin"),
        F.avg("latency_ms").alias("mean_ms"), F.median("latency_ms").alias("median_ms"), pct("latency_ms", 0.5).alias("p50_ms"), pct("latency_ms", 0.95).alias("p95_ms"), pct("latency_ms", 0.99).alias("p99_ms"), F.max("latency_ms").alias("max_ms"),
    )
    row = invalid.first()
    return main.withColumns({"invalid": F.lit(row.invalid), "unique_invalid": F.lit(row.unique_invalid)})


def unknown_expected(samples: DataFrame, catalog: DataFrame) -> DataFrame:
    """Samples whose expected slug the catalog lacks: must be empty."""
    return samples.join(catalog.select(F.col("slug").alias("known")).distinct(), F.col("expected_slug") == F.col("known"), "left_anti")


def error_rows(samples: DataFrame, catalog: DataFrame) -> DataFrame:
    """Samples whose first prediction is wrong, with what it shares with the expected item."""
    facts = catalog.select("slug", "title", "manufacturer", "category")
    e = facts.select(*(F.col(c).alias(f"e_{c}") for c in facts.columns))
    p = facts.select(*(F.col(c).alias(f"p_{c}") for c in facts.columns))
    wrong = samples.where(~F.coalesce(F.col("rank") == 1, F.lit(False))).withColumn("predicted_slug", F.try_element_at("predictions.slug", F.lit(1)))
    rows = wrong.join(e, wrong.expected_slug == e.e_slug, "left").join(p, F.col("predicted_slug") == p.p_slug, "left")
    same = lambda c: F.coalesce(F.col(f"e_{c}") == F.col(f"p_{c}"), F.lit(False)).alias(f"same_{c}")
    return rows.select("sample_id", "expected_slug", F.col("e_title").alias("expected_title"), "predicted_slug", F.col("p_title").alias("predicted_title"), F.col("rank").alias("expected_rank"), same("manufacturer"), same("category"), same("title"), F.slice("predictions", 1, 5).alias("predictions"))


def prediction_records(ranked: DataFrame, k: int = 5, query: str = "query_id", item: str = "item_id", score: str = "score") -> DataFrame:
    """Top ``k`` as one array per query."""
    rows = top_k(ranked, k, query, item, score)
    return rows.groupBy(query).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(item).alias("slug"), F.col(score).alias("score")))), lambda x: F.struct(x["slug"].alias("slug"), x["score"].alias("score"))).alias("predictions"))


def order_statistic(rows: DataFrame, by: str, value: str, position: Column) -> DataFrame:
    """``(by, value)``: the value at ``position`` (from 1, a column over ``n``, the group's rows) of each group in order.

    Counts per distinct value are added up in ranges over all groups, so no
    group has to fit in one task.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("c")).withColumn("key", F.struct(F.col(by), F.col(value)))
    summed = materialise(running_sums(counts, "key", ["c"]), "counts")
    groups = summed.groupBy(by).agg(F.min(F.col("upto_c") - F.col("c")).alias("before"), F.sum("c").alias("n"))
    reached = summed.join(groups, by).where(F.col("upto_c") - F.col("before") >= position)
    return reached.groupBy(by).agg(F.min(value).alias(value))


def tiles(rows: DataFrame, by: str, order: list[str], k: int) -> DataFrame:
    """``rows`` (unique by ``by`` and ``order``) plus ``tile`` from 1 to ``k``, the first ones larger by one where it does not divide."""
    keyed = rows.withColumn("__key", F.struct(by, *order)).withColumn("__one", F.lit(1))
    placed = materialise(running_sums(keyed, "__key", ["__one"]), "placed")
    groups = placed.groupBy(by).agg(F.min("upto___one").alias("first"), F.count("*").alias("n"))
    at, size, more = F.col("upto___one") - F.col("first"), F.floor(F.col("n") / k), F.col("n") % k
    tile = F.when(at < more * (size + 1), F.floor(at / (size + 1))).otherwise(more + F.floor((at - more * (size + 1)) / F.greatest(size, F.lit(1))))
    return placed.join(groups, by).select(*rows.columns, (tile + 1).cast("long").alias("tile"))


def auc(samples: DataFrame, label: str, score: str) -> DataFrame:
    """Share of pairs in the right order, ties half; 0 without both classes. From counts per score, not pairs."""
    counts = samples.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum((~F.col(label)).cast("long")).alias("neg"))
    placed = running_sums(counts, score, ["neg"])
    sums = placed.agg(F.sum(F.col("pos") * (F.col("upto_neg") - F.col("neg") / 2)).alias("good"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return sums.select(F.coalesce(F.round(F.try_divide(F.col("good"), F.col("p") * F.col("n")), 9), F.lit(0.0)).alias("auc"))


def gained_and_lost(samples: DataFrame, before: str, after: str) -> DataFrame:
    b, a = F.coalesce(F.col(before) == 1, F.lit(False)), F.coalesce(F.col(after) == 1, F.lit(False))
    return samples.agg(F.count_if(a & ~b).alias("gained"), F.count_if(b & ~a).alias("lost"), F.count_if(a & b).alias("kept"), F.count_if(~F.col(before).eqNullSafe(F.col(after))).alias("changed"))
