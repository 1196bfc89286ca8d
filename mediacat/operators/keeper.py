"""Which member of a group to keep.

Both rules are a ``min_by`` over an ordered struct: it combines map-side, so a group of
any size costs one small state per task, and no group is ever sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediacat.functions.scoring import has_location, keep_score
from mediacat.operators.filters import active
from mediacat.schema import instant, with_utc


def _newest_first(column: str) -> list[Column]:
    """Struct parts that sort an instant descending, nulls last."""
    return [F.col(column).isNull(), instant("1970-01-01") - F.col(column)]


def score(media: DataFrame) -> DataFrame:
    """Adds ``score``."""
    return media.withColumn("score", keep_score())


def group_media(members: DataFrame, media: DataFrame) -> DataFrame:
    """Members with the columns of their active media row."""
    return members.join(active(media).withColumnRenamed("id", "photo_id"), "photo_id")


def pick_keeper(members: DataFrame, media: DataFrame, tie: str = "taken_at") -> DataFrame:
    """(group_id, keeper_id): highest score.

    Ties go to the latest capture for exact groups (``tie='taken_at'``), else to the
    smallest id (``tie='id'``).
    """
    rows = with_utc(group_media(members.select("group_id", "photo_id"), media), "taken_at")
    later = _newest_first("taken_at") if tie == "taken_at" else []
    order = F.struct(-keep_score(), *later, F.col("photo_id"))
    return rows.groupBy("group_id").agg(F.min_by("photo_id", order).alias("keeper_id"))


def repick_keeper(members: DataFrame, media: DataFrame) -> DataFrame:
    """(group_id, keeper_id) after a deletion: located, then larger, then earlier."""
    rows = with_utc(group_media(members.select("group_id", "photo_id"), media), "taken_at")
    order = F.struct(
        ~has_location(),
        F.col("file_size").isNull(),
        -F.col("file_size"),
        F.col("taken_at").isNull(),
        F.col("taken_at"),
        F.col("photo_id"),
    )
    return rows.groupBy("group_id").agg(F.min_by("photo_id", order).alias("keeper_id"))
