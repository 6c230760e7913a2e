"""Readers and writers for the catalog's files."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp", ".bmp")
LINE = "line_number"


def wine_schema() -> T.StructType:
    """The catalog row; numbers that may be whole or not are doubles."""
    text = ["slug", "title", "manufacturer", "manufacturer_slug", "region", "category", "color", "temperature", "description", "color_gradient", "image_source_url", "image_alt", "source_url", "image_local"]
    numbers = ["public_rating", "rating", "alcohol", "alcohol_max"]
    fields = [T.StructField(c, T.StringType()) for c in text] + [T.StructField(c, T.DoubleType()) for c in numbers] + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("grapes", "dishes")]
    return T.StructType(fields)


def load_catalog(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """Metadata of the root object and one row per item of its ``wines`` array, in order."""
    root = spark.read.option("multiLine", True).json(path)
    if "wines" not in root.columns or not isinstance(root.schema["wines"].dataType, T.ArrayType) or not isinstance(root.schema["wines"].dataType.elementType, T.StructType):
        raise ValueError("the root must be an object with an array of objects named wines")
    first = root.drop("wines").first()
    wines = root.select(F.posexplode("wines").alias("catalog_index", "w")).select("catalog_index", "w.*")
    return first.asDict(recursive=True) if first is not None else {}, wines


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped. Strict reading fails on a line that is no object; ``bad_lines`` numbers them."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    if strict:
        failed = F.raise_error(F.concat(F.lit("not a JSON object: "), "value"))
        lines = lines.where(F.when(_is_object(F.col("value")), F.lit(True)).otherwise(failed.cast("boolean")))
    else:
        lines = lines.where(_is_object(F.col("value")))
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def _is_object(line):
    return F.trim(line).startswith("{") & F.try_parse_json(line).isNotNull()


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line_number, line)`` of texts that are no JSON object; only files with one are read whole."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("line")).where(F.trim("line") != "")
    files = [r["file"] for r in lines.where(~_is_object(F.col("line"))).select("file").distinct().limit(100).collect()]
    if not files:
        return lines.select("file", F.lit(0).alias(LINE), "line").where("false")
    whole = spark.read.text(files, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    return whole.where((F.trim("line") != "") & ~_is_object(F.col("line"))).select("file", (F.col("pos") + 1).alias(LINE), "line")


def last_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def images(spark: SparkSession, path: str) -> DataFrame:
    """Image files below ``path`` with size and digest, ordered by their lower-case path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    wanted = F.lower("path").rlike(r"\.(" + "|".join(s[1:] for s in IMAGE_SUFFIXES) + ")$")
    return files.where(wanted).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).orderBy(F.lower("path"))


def evaluator_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated ``query_id, image_path``; wrong headers, ids, paths or repeats fail."""
    rows = spark.read.option("header", True).option("sep", "\t").csv(path)
    if rows.columns != ["query_id", "image_path"]:
        raise ValueError("the header must be query_id and image_path")
    facts = rows.agg(F.count("*").alias("n"), F.count_distinct("query_id").alias("d"), F.count_if(~F.coalesce(F.col("query_id").rlike("^[A-Za-z0-9._-]+$"), F.lit(False)) | (F.coalesce(F.trim("image_path"), F.lit("")) == "")).alias("bad")).first()
    if not facts.n or facts.bad or facts.d != facts.n:
        raise ValueError(f"{facts.n} rows, {facts.n - facts.d} repeated ids, {facts.bad} bad rows")
    return rows


def resolved_path(path, base: str):
    """Relative paths below ``base``, absolute ones as they are."""
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), path))


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object per row with its keys in order."""
    df.select(*sorted(df.columns)).write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays joined by a bar."""
    flat = [F.array_join(F.transform(c, lambda x: x.cast("string")), "|").alias(c) if isinstance(df.schema[c].dataType, T.ArrayType) else F.col(c) for c in sorted(df.columns)]
    df.select(*flat).write.option("header", True).csv(path)


def write_report(row: dict, path: str) -> None:
    """A report (one collected row) as indented JSON with sorted keys."""
    Path(path).write_text(json.dumps(row, ensure_ascii=False, indent=2, sort_keys=True, default=str) + "\n", encoding="utf-8")


def exported(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def evaluator_results(responses: DataFrame) -> DataFrame:
    """``query_id, predicted_slug, latency_ms``: a slug only from a successful answer, latency zero if it is no number."""
    from corvid.functions.parse import first_slug

    slug = F.when(F.col("status").isin(200, 201), first_slug(F.col("body")))
    latency = F.coalesce(F.round(F.expr("try_cast(seconds as double)") * 1000).cast("long"), F.lit(0).cast("long"))
    return responses.select("query_id", slug.alias("predicted_slug"), latency.alias("latency_ms"))
