"""Library statistics: each is one pass of partial aggregation per table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacat.functions.scoring import has_location
from mediacat.operators.filters import active, trashed
from mediacat.operators.groups import redundant_members


def _one_row(*parts: DataFrame) -> DataFrame:
    """Single-row aggregates side by side."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def library_stats(
    media: DataFrame, groups: DataFrame, members: DataFrame, folders: DataFrame, active_only: bool = False
) -> DataFrame:
    """total, with_location, without_location, duplicates (redundant files), folders."""
    base = active(media).agg(F.count("*").alias("total"), F.count_if(has_location()).alias("with_location"))
    spare = redundant_members(groups, members, media if active_only else None)
    return _one_row(
        base.withColumn("without_location", F.col("total") - F.col("with_location")),
        spare.agg(F.countDistinct("photo_id").alias("duplicates")),
        folders.agg(F.count("*").alias("folders")),
    )


def top_cameras(media: DataFrame, n: int = 10) -> DataFrame:
    return (
        active(media)
        .filter(F.col("camera").isNotNull())
        .groupBy("camera")
        .agg(F.count("*").alias("count"))
        .orderBy(F.col("count").desc(), "camera")
        .limit(n)
    )


def trash_stats(media: DataFrame) -> DataFrame:
    return trashed(media).agg(
        F.count("*").alias("count"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_size")
    )


def folder_counts(media: DataFrame) -> DataFrame:
    """Active rows per folder."""
    return active(media).groupBy("folder_id").agg(F.count("*").alias("count"))


def vector_counts(embeddings: DataFrame) -> DataFrame:
    """Vectors per model."""
    return embeddings.groupBy("model").agg(F.count("*").alias("count"))


def index_progress(media: DataFrame, embeddings: DataFrame, model: str | None = None) -> DataFrame:
    """One row: active images, vectors (of a model), and their ratio."""
    if model is not None:
        embeddings = embeddings.filter(F.col("model") == model)
    row = _one_row(
        active(media).filter(F.col("media_type") == "image").agg(F.count("*").alias("images")),
        embeddings.agg(F.count("*").alias("vectors")),
    )
    return row.withColumn("progress", F.try_divide(F.col("vectors").cast("double"), F.col("images")))
