"""Ordered lists, pages and timeline positions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacat.operators.filters import MediaFilter, active, filter_media, in_bounds, list_columns, trashed
from mediacat.functions.geo import grid_precision
from mediacat.runtime import Order, order_by, page
from mediacat.schema import UNKNOWN_MONTH, instant, utc


def newest_first(column: str = "taken_at") -> Order:
    return [(column, "desc"), ("id", "asc")]


def timeline(media: DataFrame, f: MediaFilter | None = None, unit: str = "month") -> DataFrame:
    """Rows per UTC month (or day), newest first, undated rows last.

    Grouping is by the truncated date, a fixed-width key; text is made per group.
    """
    rows = filter_media(media, f)
    taken = utc(rows, "taken_at")
    pattern = {"month": "yyyy-MM", "day": "yyyy-MM-dd"}[unit]
    return (
        rows.groupBy(F.trunc(taken.cast("date"), "month").alias("__unit") if unit == "month"
                     else taken.cast("date").alias("__unit"))
        .agg(F.count("*").alias("count"), F.min(taken).alias("first_date"))
        .select(
            F.coalesce(F.date_format("__unit", pattern), F.lit(UNKNOWN_MONTH)).alias("key"),
            "count",
            "first_date",
        )
        .orderBy(F.col("first_date").desc_nulls_last())
    )


# Month labels of a timeline.
MONTH_LABEL = "yyyy年M月"
UNKNOWN_LABEL = "未知时间"


def timeline_labels(months: DataFrame) -> DataFrame:
    """Adds the display text of a month key."""
    first = F.to_date(F.concat(F.nullif("key", F.lit(UNKNOWN_MONTH)), F.lit("-01")))
    return months.withColumn("label", F.coalesce(F.date_format(first, MONTH_LABEL), F.lit(UNKNOWN_LABEL)))


def browse(media: DataFrame, f: MediaFilter | None = None) -> DataFrame:
    """The filtered list, newest first, optionally cut to a page."""
    f = f or MediaFilter()
    return page(list_columns(filter_media(media, f)), newest_first(), f.limit, f.offset)


def browse_total(media: DataFrame, f: MediaFilter | None = None) -> DataFrame:
    """One row: how many rows the filter has, also where a page lies beyond the end."""
    return filter_media(media, f).agg(F.count("*").alias("total"))


def browse_page(media: DataFrame, f: MediaFilter | None = None) -> DataFrame:
    """A page of the list; every row carries the filter's total and whether more follow."""
    f = f or MediaFilter()
    limit, offset = f.limit or 100, f.offset or 0
    rows = list_columns(filter_media(media, f))
    total = browse_total(media, f).scalar()
    return (
        page(rows, newest_first(), limit, offset)
        .withColumn("total", total)
        .withColumn("has_more", F.lit(offset + limit) < F.col("total"))
    )


def month_offset(media: DataFrame, key: str, f: MediaFilter | None = None) -> DataFrame:
    """0-based place of a month's first row in the browse order; null if it has none.

    Rows that sort before the month are exactly those dated after it, so one pass with
    two conditional counts is enough.
    """
    rows = filter_media(media, f)
    taken = utc(rows, "taken_at")
    if key == UNKNOWN_MONTH:
        inside, before = taken.isNull(), taken.isNotNull()
    else:
        year, month = (int(p) for p in key.split("-"))
        start = date(year, month, 1)
        end = date(year + month // 12, month % 12 + 1, 1)
        inside = (taken >= instant(start)) & (taken < instant(end))
        before = taken >= instant(end)
    counts = rows.agg(F.count_if(inside).alias("__in"), F.count_if(before).alias("__before"))
    return counts.select(F.when(F.col("__in") > 0, F.col("__before")).alias("offset"))


def keyset_page(media: DataFrame, after_id=None, limit: int = 5000) -> DataFrame:
    """The next rows with a fingerprint after a cursor, by id."""
    rows = active(media).filter(F.col("perceptual_hash").isNotNull())
    if after_id is not None:
        rows = rows.filter(F.col("id") > F.lit(after_id))
    return page(rows.select("id", "perceptual_hash", "file_size"), [("id", "asc")], limit, 0)


def trash_list(media: DataFrame) -> DataFrame:
    return list_columns(trashed(media)).orderBy(*order_by(newest_first("deleted_at")))


def folder_list(folders: DataFrame, id=None, path: str | None = None) -> DataFrame:
    """Folders, latest added first; optionally the one with an id or a path."""
    if id is not None:
        folders = folders.filter(F.col("id") == F.lit(id))
    if path is not None:
        folders = folders.filter(F.col("path") == F.lit(path))
    return folders.orderBy(*order_by(newest_first("added_at")))


def cluster_drawer(media: DataFrame, lat: float, lon: float, zoom: int, representative=None) -> DataFrame:
    """Rows of one map cell, the representative first."""
    half = grid_precision(zoom) / 2
    rows = in_bounds(media, lat - half, lon - half, lat + half, lon + half)
    lead = F.when(F.col("id") == F.lit(representative), 0).otherwise(1)
    return rows.orderBy(lead, "id")
