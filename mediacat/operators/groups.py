"""Listing, paging and editing of stored duplicate groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacat.operators.filters import active
from mediacat.operators.keeper import group_media
from mediacat.runtime import hot_keys, join_lookup, order_by, page
from mediacat.schema import with_utc

# Member columns of a group listing.
MEMBER_COLUMNS = (
    "photo_id", "path", "filename", "file_size", "taken_at",
    "latitude", "longitude", "width", "height", "camera",
)


def group_members(members: DataFrame, media: DataFrame) -> DataFrame:
    """Members joined to their active media row."""
    return group_media(members, media)


def affected_groups(members: DataFrame, ids: DataFrame) -> DataFrame:
    """Distinct group_id of the groups that hold any of the ids."""
    ids = ids.select(F.col(ids.columns[0]).alias("photo_id"))
    return members.join(ids, "photo_id", "left_semi").select("group_id").distinct()


def affected_by_folder(members: DataFrame, media: DataFrame, folder_id) -> DataFrame:
    return affected_groups(members, media.filter(F.col("folder_id") == F.lit(folder_id)).select("id"))


def redundant_members(groups: DataFrame, members: DataFrame, media: DataFrame | None = None) -> DataFrame:
    """Members that are not their group's keeper; pass ``media`` to count active ones only."""
    keepers = groups.select("group_id", F.col("keeper_id").alias("photo_id"))
    rows = members.join(keepers, ["group_id", "photo_id"], "left_anti")
    if media is not None:
        rows = rows.join(active(media).select(F.col("id").alias("photo_id")), "photo_id", "left_semi")
    return rows


def group_sizes(members: DataFrame, media: DataFrame | None = None) -> DataFrame:
    """group_id, count; pass ``media`` to count active members only."""
    if media is not None:
        members = members.join(active(media).select(F.col("id").alias("photo_id")), "photo_id", "left_semi")
    return members.groupBy("group_id").agg(F.count("*").alias("count"))


def clear_groups(groups: DataFrame, members: DataFrame, reason: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Groups and members without those of one reason, or without any."""
    if reason is None:
        return groups.limit(0), members.limit(0)
    kept = groups.filter(F.col("reason") != reason)
    gone = groups.filter(F.col("reason") == reason).select("group_id")
    return kept, members.join(gone, "group_id", "left_anti")


def _summaries(groups: DataFrame, members: DataFrame, media: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups with size and latest capture of their active members, and those members."""
    rows = with_utc(group_media(members, media), "taken_at")
    facts = rows.groupBy("group_id").agg(F.count("*").alias("size"), F.max("taken_at").alias("latest"))
    heads = groups.join(facts, "group_id", "left").select(
        "group_id", "reason", "keeper_id", F.coalesce("size", F.lit(0)).alias("size"), "latest"
    )
    return heads, rows.select("group_id", *[c for c in MEMBER_COLUMNS if c in rows.columns])


GROUP_ORDER = [("size", "desc"), ("latest", "desc"), ("group_id", "asc")]


def _expand(heads: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per active member, groups without one once."""
    hot = hot_keys(heads, ["group_id"], "size")
    full = join_lookup(rows, heads, ["group_id"], hot)
    empty = heads.filter(F.col("size") == 0)
    return full.unionByName(empty, allowMissingColumns=True)


def _listed(df: DataFrame) -> DataFrame:
    return df.orderBy(*order_by([*GROUP_ORDER, ("taken_at", "desc"), ("photo_id", "asc")]))


def group_listing(groups: DataFrame, members: DataFrame, media: DataFrame, reason: str | None = None) -> DataFrame:
    """Groups, largest first, with their active members, newest first, one row per member.

    The range sort includes the member columns, so one huge group spans many tasks.
    """
    if reason:
        groups = groups.filter(F.col("reason") == reason)
    return _listed(_expand(*_summaries(groups, members, media)))


def group_page(
    groups: DataFrame,
    members: DataFrame,
    media: DataFrame,
    limit: int = 50,
    offset: int = 0,
    reason: str | None = None,
) -> DataFrame:
    """The listing cut to ``limit`` groups; every row carries the number of groups."""
    if reason:
        groups = groups.filter(F.col("reason") == reason)
    heads, rows = _summaries(groups, members, media)
    total = groups.agg(F.count("*")).scalar()
    return _listed(_expand(page(heads, GROUP_ORDER, limit, offset), rows)).withColumn("total", total)


def apply_keep(groups: DataFrame, members: DataFrame, keep: DataFrame) -> DataFrame:
    """Members with ``kept``: the manual choice where a group has one, else its keeper.

    ``keep`` is (group_id, photo_id); choices outside the group are ignored.
    """
    chosen = (
        keep.select("group_id", "photo_id")
        .distinct()
        .join(members, ["group_id", "photo_id"], "left_semi")
        .withColumn("__chosen", F.lit(True))
    )
    manual = chosen.select("group_id").distinct().withColumn("__manual", F.lit(True))
    heads = groups.join(manual, "group_id", "left").select("group_id", "reason", "keeper_id", "__manual")
    hot = hot_keys(group_sizes(members), ["group_id"], "count")
    rows = join_lookup(members, heads, ["group_id"], hot).join(chosen, ["group_id", "photo_id"], "left")
    kept = F.when(F.col("__manual"), F.col("__chosen")).otherwise(F.col("photo_id") == F.col("keeper_id"))
    return rows.select("group_id", "reason", "photo_id", F.coalesce(kept, F.lit(False)).alias("kept"))


def keep_violations(kept: DataFrame) -> DataFrame:
    """Groups that keep nothing, and exact groups that keep more than one."""
    counts = kept.groupBy("group_id", "reason").agg(F.count_if("kept").alias("n_kept"))
    problem = F.when(F.col("n_kept") == 0, "keeps nothing").when(
        (F.col("reason") == "exact") & (F.col("n_kept") > 1), "exact group keeps several"
    )
    return counts.select("group_id", "n_kept", problem.alias("problem")).filter(F.col("problem").isNotNull())


def reclaimable(kept: DataFrame, media: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """One row: active members not kept in the selected groups, and their bytes."""
    rows = kept.filter(~F.col("kept"))
    if selected is not None:
        rows = rows.join(selected.select("group_id").distinct(), "group_id", "left_semi")
    return group_media(rows, media).agg(
        F.count("*").alias("count"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("size")
    )
