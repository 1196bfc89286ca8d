"""Projections, row filters and lookups."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacat.functions import geo
from mediacat.functions.hashing import usable_fingerprint
from mediacat.functions.scoring import has_location
from mediacat.runtime import page
from mediacat.schema import LIST_COLUMNS, LOCATION_COLUMNS, PATH_COLUMNS, instant, project, utc


@dataclass(frozen=True)
class MediaFilter:
    """Optional conditions, all of which must hold; empty text counts as not set."""

    folder_id: object = None
    date_start: object = None
    date_end: object = None
    has_location: bool | None = None
    camera: str | None = None
    media_type: str | None = None
    limit: int | None = None
    offset: int | None = None


def _given(value) -> bool:
    return value is not None and value != ""


def active(media: DataFrame) -> DataFrame:
    return media.filter(F.col("deleted_at").isNull())


def trashed(media: DataFrame) -> DataFrame:
    return media.filter(F.col("deleted_at").isNotNull())


def filter_media(media: DataFrame, f: MediaFilter | None = None) -> DataFrame:
    """Active rows that meet the filter; date bounds are inclusive and drop undated rows."""
    f = f or MediaFilter()
    out = active(media)
    if _given(f.folder_id):
        out = out.filter(F.col("folder_id") == F.lit(f.folder_id))
    if _given(f.date_start):
        out = out.filter(utc(out, "taken_at") >= instant(f.date_start))
    if _given(f.date_end):
        out = out.filter(utc(out, "taken_at") <= instant(f.date_end))
    if f.has_location is not None:
        out = out.filter(has_location() if f.has_location else ~has_location())
    if _given(f.camera):
        out = out.filter(F.col("camera") == F.lit(f.camera))
    if f.media_type in ("image", "video"):
        out = out.filter(F.col("media_type") == F.lit(f.media_type))
    return out


def list_columns(media: DataFrame) -> DataFrame:
    return project(media, LIST_COLUMNS)


def _keys(media: DataFrame, values, column: str) -> DataFrame:
    if isinstance(values, DataFrame):
        return values.select(F.col(values.columns[0]).alias(column)).distinct()
    kind = media.schema[column].dataType
    rows = [(v,) for v in dict.fromkeys(values)]
    return media.sparkSession.createDataFrame(rows, f"{column} {kind.simpleString()}")


def by_ids(media: DataFrame, ids: DataFrame | Iterable, trashed_rows: bool = False) -> DataFrame:
    """Rows of the given ids; a table of ids may be as large as the catalogue."""
    rows = trashed(media) if trashed_rows else active(media)
    return rows.join(_keys(media, ids, "id"), "id", "left_semi")


def by_paths(media: DataFrame, paths: DataFrame | Iterable[str]) -> DataFrame:
    """Active rows at the given paths, with the columns a change check needs."""
    return project(active(media).join(_keys(media, paths, "path"), "path", "left_semi"), PATH_COLUMNS)


def by_folder(media: DataFrame, folder_id=None) -> DataFrame:
    """Active rows of a folder, or of all folders."""
    rows = active(media)
    return rows if folder_id is None else rows.filter(F.col("folder_id") == F.lit(folder_id))


def folder_paths(media: DataFrame, folder_id, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """(id, path) of a page of a folder's active rows, by id."""
    return page(by_folder(media, folder_id).select("id", "path"), [("id", "asc")], limit, offset)


def with_location(media: DataFrame) -> DataFrame:
    return project(active(media).filter(has_location()), LOCATION_COLUMNS)


def in_bounds(
    media: DataFrame, south: float, west: float, north: float, east: float, split_antimeridian: bool = False
) -> DataFrame:
    """Located rows inside the inclusive box.

    A box with west > east is empty unless ``split_antimeridian`` reads it as crossing 180°.
    """
    lon = F.col("longitude")
    across = lon.between(west, east)
    if split_antimeridian and west > east:
        across = lon.between(west, 180.0) | lon.between(-180.0, east)
    return with_location(media).filter(F.col("latitude").between(south, north) & across)


def valid_coords(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    return df.filter(geo.valid_coordinates(F.col(lat), F.col(lon)))


def usable_phash(media: DataFrame) -> DataFrame:
    """Active rows with a fingerprint of a decodable image."""
    return active(media).filter(usable_fingerprint(F.col("perceptual_hash")))


def phash_missing(media: DataFrame, *more: str) -> DataFrame:
    """id, path (and ``more`` columns) of active rows whose fingerprint is still to be computed."""
    return active(media).filter(F.col("perceptual_hash").isNull()).select("id", "path", *more)
