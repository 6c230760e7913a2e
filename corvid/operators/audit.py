"""Catalog audit: coverage, issues, duplicate groups and near duplicates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.functions.text import collapse, present, present_items
from corvid.operators.graph import connected_components
from corvid.operators.ranking import running_sums

# Fields that every catalog row should have.
REQUIRED_FIELDS = ("slug", "title", "manufacturer", "region", "category", "description", "image_local", "source_url")


def _has(df: DataFrame, c: str) -> Column:
    return present_items(F.col(c)) if df.schema[c].dataType.typeName() in ("array", "map") else present(F.col(c))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).count().where("count > 1")


def coverage(df: DataFrame) -> DataFrame:
    """Per field: rows with and without a value. One pass, one short row, then a row per field."""
    sums = df.agg(*(F.sum(_has(df, c).cast("long")).alias(c) for c in df.columns), F.count("*").alias("__n"))
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c), F.lit(0).cast("long")).alias("present"), (F.col("__n") - F.coalesce(F.col(c), F.lit(0).cast("long"))).alias("missing")) for c in df.columns))
    return sums.select(F.inline(pairs))


def missing_field_issues(df: DataFrame, key: str, required: Sequence[str] = REQUIRED_FIELDS) -> DataFrame:
    gaps = F.array_compact(F.array(*(F.when(~F.coalesce(_has(df, c), F.lit(False)), F.lit(c)) for c in required)))
    return df.select(F.col(key).alias("slug"), F.explode(gaps).alias("field")).select(F.lit("warning").alias("severity"), F.lit("missing_field").alias("code"), "slug", F.concat(F.lit("missing required field: "), "field").alias("message"))


def suspicious_range(df: DataFrame, key: str, column: str, low: float = 5, high: float = 25, code: str = "suspicious_alcohol") -> DataFrame:
    bad = df.where(~F.col(column).between(low, high))
    return bad.select(F.lit("warning").alias("severity"), F.lit(code).alias("code"), F.col(key).alias("slug"), F.concat(F.lit(f"{column} out of range: "), F.col(column).cast("string")).alias("message"))


def ordered_issues(issues: DataFrame) -> DataFrame:
    return issues.orderBy("severity", "code", F.coalesce("slug", F.lit("")), "message")


def grouped_values(df: DataFrame, column: str, item: str, ignore_case: bool = False) -> DataFrame:
    """Values that several rows share after white space (and case) is evened out."""
    clean = collapse(F.col(column).cast("string"))
    key = F.lower(clean) if ignore_case else clean
    rows = df.where(present(F.col(column))).select(key.alias("key"), clean.alias("value"), F.col(item).alias("item"))
    return rows.groupBy("key").agg(F.count("*").alias("count"), F.min("value").alias("value"), F.sort_array(F.collect_set("value")).alias("observed_values"), F.sort_array(F.collect_list("item")).alias("items")).where("count > 1")


def exact_groups(df: DataFrame, digest: str, fields: Sequence[str]) -> DataFrame:
    """Rows with equal digests and the fields in which they differ (null counts as a value)."""
    distinct = {f: F.count_distinct(F.coalesce(F.col(f).cast("string"), F.lit("None"))) > 1 for f in fields}
    groups = df.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.count("*").alias("count"), *(d.alias(f"d_{f}") for f, d in distinct.items())).where("count > 1")
    return groups.select(digest, "count", F.array_compact(F.array(*(F.when(F.col(f"d_{f}"), F.lit(f)) for f in fields))).alias("differing_fields"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("<missing>")).alias("value")).count().orderBy(F.desc("count"), "value")


def orphans(files: DataFrame, df: DataFrame, path: str) -> DataFrame:
    return files.join(df.select(F.col(path).alias("used")).distinct(), F.col("path") == F.col("used"), "left_anti")


def near_membership(pairs: DataFrame) -> DataFrame:
    """``(group_id, node, size, min_distance, max_distance)``: a row for each member of the groups that ``pairs`` connect.

    Groups are numbered by size, then by their smallest member; the numbers
    are sums over ranges, so neither a group nor the groups meet in one task.
    """
    parts = connected_components(pairs.select(F.col("left").alias("src"), F.col("right").alias("dst")))
    sizes = parts.groupBy("component").agg(F.count("*").alias("size"))
    spans = pairs.join(parts, pairs.left == parts.node).groupBy("component").agg(F.min("distance").alias("min_distance"), F.max("distance").alias("max_distance"))
    groups = sizes.join(spans, "component").withColumn("order", F.struct((-F.col("size")).alias("less"), "component")).withColumn("one", F.lit(1))
    numbered = running_sums(groups, "order", ["one"]).withColumn("group_id", F.format_string("near-%04d", "upto_one"))
    return parts.join(numbered, "component").select("group_id", "node", "size", "min_distance", "max_distance")


def near_groups(pairs: DataFrame) -> DataFrame:
    """The report on ``near_membership``: a row for each group with its members as a list, for groups that fit in a row."""
    return near_membership(pairs).groupBy("group_id", "size", "min_distance", "max_distance").agg(F.sort_array(F.collect_list("node")).alias("members"))


def difference_both_ways(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("only_in", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("only_in", F.lit("right")))


def foreign_key_violations(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return child.join(parent.select(F.col(parent_key).alias("__p")).distinct(), F.col(child_key) == F.col("__p"), "left_anti")


def manifest(wines: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Catalog rows with forward slashes in paths, the file's name, and image facts where there are any."""
    out = wines.withColumn("image_local", F.replace("image_local", F.lit("\\"), F.lit("/"))).withColumn("image_name", F.element_at(F.split("image_local", "/"), -1))
    return out.join(images.withColumnRenamed("path", "image_local"), "image_local", "left") if images is not None else out


def issues(wines: DataFrame, key: str = "slug", amount: str = "alcohol") -> DataFrame:
    """All rule issues of a catalog in report order."""
    dups = duplicate_keys(wines, key).select(F.lit("error").alias("severity"), F.lit("duplicate_slug").alias("code"), F.col(key).alias("slug"), F.concat(F.lit("rows with this slug: "), F.col("count").cast("string")).alias("message"))
    required = [c for c in REQUIRED_FIELDS if c in wines.columns]
    return ordered_issues(dups.unionByName(missing_field_issues(wines, key, required)).unionByName(suspicious_range(wines, key, amount)))


def report(wines: DataFrame, files: DataFrame, digest: str = "sha", fields: Sequence[str] = ("title", "region"), key: str = "slug", near: DataFrame | None = None) -> DataFrame:
    """The whole audit as ``(section, name, value)``: totals, coverage, issues, distributions, exact and near copies, orphans.

    ``files(path, <digest>)`` are the image files found; ``near`` the pairs of ``near_pairs``.
    """
    line = lambda section, name, value: [F.lit(section).alias("section"), name.cast("string").alias("name"), value.cast("long").alias("value")]
    images = manifest(wines, files)
    copies = exact_groups(images, digest, [f for f in fields if f in wines.columns])
    parts = [
        wines.agg(F.count("*").alias("n")).select(*line("total", F.lit("rows"), F.col("n"))),
        coverage(wines).select(*line("missing", F.col("field"), F.col("missing"))),
        issues(wines, key).groupBy("code").count().select(*line("issue", F.col("code"), F.col("count"))),
        *(distribution(wines, c).select(*line(c, F.col("value"), F.col("count"))) for c in ("region", "category") if c in wines.columns),
        copies.agg(F.count("*").alias("n"), F.coalesce(F.sum("count"), F.lit(0)).alias("rows")).select(F.inline(F.array(F.struct(*line("exact copies", F.lit("groups"), F.col("n"))), F.struct(*line("exact copies", F.lit("rows"), F.col("rows")))))),
        orphans(files, images, "image_local").agg(F.count("*").alias("n")).select(*line("orphans", F.lit("files"), F.col("n"))),
        images.where(F.col(digest).isNull()).agg(F.count("*").alias("n")).select(*line("orphans", F.lit("rows without a file"), F.col("n"))),
    ]
    if near is not None:
        parts.append(near.agg(F.count("*").alias("n")).select(*line("near copies", F.lit("pairs"), F.col("n"))))
    return reduce(DataFrame.unionByName, parts)
