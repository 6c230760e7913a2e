"""Bringing live catalog records into the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields of an item that leave the service.
PUBLIC_FIELDS = (
    "slug", "title", "manufacturer", "region", "category", "color", "alcohol", "alcohol_max", "temperature", "description",
    "grapes", "dishes", "public_rating", "rating", "source_url",
)


def filled(*values: Column) -> Column:
    """The first value that is neither null nor empty, else empty."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values), F.lit(""))


def public_item(catalog: DataFrame, image_base: str) -> DataFrame:
    kept = [c for c in PUBLIC_FIELDS if c in catalog.columns]
    return catalog.select(*kept, F.concat(F.lit(image_base.rstrip("/") + "/"), "slug").alias("image_url"))


def search(catalog: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Items whose title, maker, region or slug contains the text, in catalog order; no text gives the first ones."""
    if not 1 <= limit <= 50:
        raise ValueError("limit must be 1 to 50")
    wanted = text.strip().lower()
    fields = F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("title", "manufacturer", "region", "slug") if c in catalog.columns)))
    rows = catalog.where(fields.contains(wanted)) if wanted else catalog
    return rows.orderBy("catalog_index").limit(limit)


def promoted(live: DataFrame, catalog: DataFrame, maker: str) -> DataFrame:
    """Live records of a maker whose slug the catalog lacks."""
    return unseen(live.where(F.lower("manufacturer").contains(maker.lower())), catalog)


def unseen(live: DataFrame, catalog: DataFrame) -> DataFrame:
    return live.join(catalog.select(F.col("slug").alias("known")).distinct(), F.col("slug") == F.col("known"), "left_anti")


def children(catalog: DataFrame, column: str) -> DataFrame:
    """``(slug, name)`` rows of an array column."""
    return catalog.select("slug", F.explode(column).alias("name")).where("name is not null")
