"""Integrity checks that a database would enforce by constraints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacat.operators.groups import group_sizes
from mediacat.schema import Catalog


def orphans(child: DataFrame, parent: DataFrame, child_key: str = "photo_id", parent_key: str = "id") -> DataFrame:
    """Child rows without a parent row; a null key is an orphan too."""
    keys = parent.select(F.col(parent_key).alias(child_key))
    return child.join(keys, child_key, "left_anti")


def audit(catalog: Catalog) -> DataFrame:
    """(problem, key) for every violation; empty for a sound catalogue."""
    media, groups, members, embeddings, _ = catalog

    def found(name: str, rows: DataFrame, key: str) -> DataFrame:
        return rows.select(F.lit(name).alias("problem"), F.col(key).cast("string").alias("key"))

    def repeated(rows: DataFrame, key: str) -> DataFrame:
        return rows.groupBy(key).count().filter(F.col("count") > 1)

    sizes = groups.select("group_id").join(group_sizes(members), "group_id", "left")
    kept = groups.filter(F.col("keeper_id").isNotNull()).select("group_id", F.col("keeper_id").alias("photo_id"))
    checks = [
        found("vector without media", orphans(embeddings, media), "photo_id"),
        found("member without media", orphans(members, media), "photo_id"),
        found("member without group", orphans(members, groups, "group_id", "group_id"), "photo_id"),
        found("repeated id", repeated(media, "id"), "id"),
        found("repeated path", repeated(media, "path"), "path"),
        found(
            "unknown media type",
            media.filter(~F.coalesce(F.col("media_type").isin("image", "video"), F.lit(False))),
            "id",
        ),
        found(
            "unknown reason",
            groups.filter(~F.coalesce(F.col("reason").isin("exact", "similar"), F.lit(False))),
            "group_id",
        ),
        found("group below two", sizes.filter(F.coalesce("count", F.lit(0)) < 2), "group_id"),
        found("keeper not a member", kept.join(members, ["group_id", "photo_id"], "left_anti"), "group_id"),
    ]
    return reduce(DataFrame.unionByName, checks)
