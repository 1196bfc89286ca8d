"""Thumbnail cache as a file listing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacat.functions.paths import basename

# Thumbnail sizes.
SIZES = ("small", "medium")


def thumb_path(photo_id, size: str):
    """Where the cache keeps a thumbnail: sharded by the first two characters of the id."""
    return F.concat(F.substring(photo_id, 1, 2), F.lit("/"), photo_id, F.lit(f"_{size}.webp"))


def thumb_inventory(listing: DataFrame) -> DataFrame:
    """Parse ``<shard>/<id>_<size>.webp`` and the older flat ``<id>.webp``.

    Adds photo_id, size (null for an unsized file), shard and legacy.
    """
    stem = F.regexp_replace(basename(F.col("path")), r"\.webp$", "")
    size = F.nullif(F.regexp_extract(stem, "_(" + "|".join(SIZES) + ")$", 1), F.lit(""))
    return listing.filter(F.col("path").endswith(".webp")).withColumns(
        {
            "photo_id": F.substring_index(stem, "_", 1),
            "size": size,
            "shard": F.substring(F.substring_index(stem, "_", 1), 1, 2),
            "legacy": ~F.contains(stem, F.lit("_")),
        }
    )


def thumb_stats(listing: DataFrame) -> DataFrame:
    """One row: files, bytes, and how many of each size."""
    return thumb_inventory(listing).agg(
        F.count("*").alias("count"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("total_size"),
        F.count_if(F.col("size") == "small").alias("small_count"),
        F.count_if(F.col("size") == "medium").alias("medium_count"),
    )


def thumb_orphans(listing: DataFrame, media: DataFrame) -> DataFrame:
    """Thumbnails whose photo is not in the active catalogue."""
    alive = media.filter(F.col("deleted_at").isNull()).select(F.col("id").cast("string").alias("photo_id"))
    return thumb_inventory(listing).join(alive, "photo_id", "left_anti")


def thumb_stale(listing: DataFrame, media: DataFrame, size: str = "small") -> DataFrame:
    """Active rows to render again: no thumbnail of that size at least as new as the file.

    For the medium size a fresh unsized file of the older layout counts as well.
    """
    fits = F.col("size") == size
    if size == "medium":
        fits = fits | F.col("legacy")
    newest = (
        thumb_inventory(listing)
        .filter(F.coalesce(fits, F.lit(False)))
        .groupBy("photo_id")
        .agg(F.max("mtime").alias("thumb_mtime"))
    )
    active = media.filter(F.col("deleted_at").isNull()).select(
        "id", "path", "modified_time", F.col("id").cast("string").alias("photo_id")
    )
    fresh = F.coalesce(F.col("modified_time") <= F.col("thumb_mtime"), F.lit(False))
    return (
        active.join(newest, "photo_id", "left")
        .filter(~fresh)
        .select("id", "path", "modified_time", "thumb_mtime")
    )
