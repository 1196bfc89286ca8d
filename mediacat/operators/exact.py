"""Exact duplicates: equal content hash (images) or equal first frame and size (videos).

Groups are flat member rows, never arrays: a file copied a million times is a million
rows spread over the cluster, not one row in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediacat.operators.filters import active
from mediacat.operators.keeper import pick_keeper
from mediacat.runtime import hot_keys, join_lookup, materialize


def duplicate_key() -> Column:
    """Null when the row cannot take part."""
    video = F.concat(F.col("frame_hash"), F.lit("_"), F.col("file_size").cast("string"))
    return F.when(F.col("media_type") == "image", F.col("file_hash")).when(
        F.col("media_type") == "video", video
    )


def group_equal(rows: DataFrame, keys: list[str], reason: str = "exact", min_rows: int | None = None) -> DataFrame:
    """Rows whose keys occur at least twice, with group_id (from the least id) and count.

    The key counts combine map-side; rows of very frequent keys then meet their group by
    broadcast, all others by a shuffle on the key.
    """
    groups = (
        rows.groupBy(*keys)
        .agg(F.count("*").alias("count"), F.min("photo_id").alias("__least"))
        .filter(F.col("count") > 1)
        .select(*keys, "count", F.concat(F.lit(f"{reason}:"), F.col("__least").cast("string")).alias("group_id"))
    )
    return join_lookup(rows, groups, keys, hot_keys(groups, keys, "count", min_rows))


def exact_groups(media: DataFrame, min_rows: int | None = None) -> DataFrame:
    """media_type, key, photo_id, taken_at, count, group_id for every duplicate file."""
    rows = (
        active(media)
        .select("media_type", duplicate_key().alias("key"), F.col("id").alias("photo_id"), "taken_at")
        .filter(F.col("key").isNotNull())
    )
    return group_equal(rows, ["media_type", "key"], min_rows=min_rows)


def verify_video_groups(
    groups: DataFrame,
    sampled: DataFrame | Callable[[DataFrame], DataFrame],
    min_rows: int | None = None,
    full: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Split video groups by sampled hash, then by content; image groups pass.

    ``sampled`` is (photo_id, sampled_hash) for at least the video members, or maps their
    (photo_id) to it. It is a filter: files that agree in the samples may differ between them. ``full`` maps the (photo_id) of
    those that are still together to (photo_id, full_hash), read from whole files, and splits
    them for good. Members without a hash and subgroups of one drop out.
    """
    if callable(sampled):
        groups = materialize(groups, "to_verify")
        sampled = sampled(groups.filter(F.col("media_type") == "video").select("photo_id"))
    images = groups.filter(F.col("media_type") != "video")
    hashed = (
        groups.filter(F.col("media_type") == "video")
        .join(sampled.select("photo_id", "sampled_hash"), "photo_id")
        .filter(F.col("sampled_hash").isNotNull())
        .select(
            "media_type",
            F.concat("key", F.lit("_sampled_"), "sampled_hash").alias("key"),
            "photo_id",
            "taken_at",
        )
    )
    alike = group_equal(hashed, ["media_type", "key"], min_rows=min_rows)
    if full is not None:
        alike = materialize(alike, "sampled_alike")
        whole = full(alike.select("photo_id")).filter(F.col("full_hash").isNotNull())
        exact = alike.join(whole.select("photo_id", "full_hash"), "photo_id").select(
            "media_type", F.concat("key", F.lit("_full_"), "full_hash").alias("key"), "photo_id", "taken_at"
        )
        alike = group_equal(exact, ["media_type", "key"], min_rows=min_rows)
    return images.unionByName(alike)


def touched_media(media: DataFrame, hashes: DataFrame, frame_hashes: DataFrame) -> DataFrame:
    """Active rows that share a content or frame hash with newly ingested files."""
    rows = active(media)
    images = rows.filter(F.col("media_type") == "image").join(
        hashes.select(F.col(hashes.columns[0]).alias("file_hash")).distinct(), "file_hash", "left_semi"
    )
    videos = rows.filter(F.col("media_type") == "video").join(
        frame_hashes.select(F.col(frame_hashes.columns[0]).alias("frame_hash")).distinct(),
        "frame_hash",
        "left_semi",
    )
    return images.unionByName(videos)


def exact_groups_incremental(
    media: DataFrame,
    hashes: DataFrame,
    frame_hashes: DataFrame,
    members: DataFrame,
    sampled: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
    full: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(new members, new groups) after an ingest.

    ``members`` are the exact groups so far. An ungrouped copy joins the group of any
    fellow (the least group id), else a new group opens with its keeper; keepers of
    existing groups stay.
    """
    found = exact_groups(touched_media(media, hashes, frame_hashes))
    if sampled is not None:
        found = verify_video_groups(found, sampled, full=full)
    found = materialize(found, "touched")
    known = members.select("photo_id", F.col("group_id").alias("__known"))
    placed = found.join(known.groupBy("photo_id").agg(F.min("__known").alias("__known")), "photo_id", "left")
    home = placed.groupBy("group_id").agg(
        F.min("__known").alias("__home"), F.min("key").alias("__key"), F.count("*").alias("__n")
    )
    # an id may already name a group whose first member has since changed content
    in_use = members.select("group_id").distinct().withColumn("__used", F.lit(True))
    home = home.join(in_use, "group_id", "left").select(
        "group_id",
        "__n",
        F.col("__home").isNull().alias("__opens"),
        F.coalesce(
            "__home", F.when(F.col("__used"), F.concat("group_id", F.lit(":"), "__key")).otherwise(F.col("group_id"))
        ).alias("__target"),
    )
    hot = hot_keys(home, ["group_id"], "__n")
    rows = join_lookup(placed, home.drop("__n"), ["group_id"], hot)
    added = rows.filter(F.col("__known").isNull()).select(F.col("__target").alias("group_id"), "photo_id", "__opens")
    opened = pick_keeper(added.filter("__opens"), media).withColumn("reason", F.lit("exact"))
    return added.drop("__opens"), opened.select("group_id", "reason", "keeper_id")
