"""Table layout, fixed values and time handling shared by all operators."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Supported file extensions.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "webp", "heic", "heif", "raw", "cr2", "nef", "arw")
VIDEO_EXTENSIONS = ("mp4", "mov", "m4v", "3gp", "avi")

# Directories a listing never descends into. Any other directory whose
# name starts with a dot is skipped as well.
SYSTEM_DIRECTORIES = (
    "$RECYCLE.BIN",
    "System Volume Information",
    ".Trashes",
    ".Spotlight-V100",
    ".fseventsd",
    "@eaDir",
)

# Columns of a list view and of a map view.
LIST_COLUMNS = (
    "id", "folder_id", "path", "filename", "file_size", "taken_at",
    "latitude", "longitude", "width", "height", "camera", "media_type",
    "duration", "frame_hash", "deleted_at", "original_path", "trash_path",
)
LOCATION_COLUMNS = (
    "id", "path", "filename", "latitude", "longitude",
    "taken_at", "camera", "width", "height", "file_size",
)
PATH_COLUMNS = ("id", "path", "file_hash", "file_size", "modified_time")

# Fixed value: fingerprint of a file that could not be decoded.
ZERO_FINGERPRINT = "0" * 64

UNKNOWN_MONTH = "unknown"

MEDIA_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("folder_id", T.StringType()),
        T.StructField("path", T.StringType(), False),
        T.StructField("filename", T.StringType()),
        T.StructField("media_type", T.StringType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("file_hash", T.StringType()),
        T.StructField("frame_hash", T.StringType()),
        T.StructField("sampled_hash", T.StringType()),
        T.StructField("perceptual_hash", T.StringType()),
        T.StructField("taken_at", T.TimestampNTZType()),
        T.StructField("modified_time", T.TimestampNTZType()),
        T.StructField("updated_at", T.TimestampNTZType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("camera", T.StringType()),
        T.StructField("aperture", T.StringType()),
        T.StructField("shutter_speed", T.StringType()),
        T.StructField("iso", T.IntegerType()),
        T.StructField("focal_length", T.StringType()),
        T.StructField("deleted_at", T.TimestampNTZType()),
        T.StructField("original_path", T.StringType()),
        T.StructField("trash_path", T.StringType()),
    ]
)


class Catalog(NamedTuple):
    """The tables one maintenance step reads and returns."""

    media: DataFrame  # MEDIA_SCHEMA, or any subset an operator needs
    groups: DataFrame  # group_id, reason, keeper_id
    members: DataFrame  # group_id, photo_id
    embeddings: DataFrame  # photo_id, embedding, model, created_at, updated_at
    folders: DataFrame | None = None  # id, path, added_at


def utc(df: DataFrame, name: str) -> Column:
    """The column as wall-clock UTC, whatever timestamp type the table has.

    TIMESTAMP_NTZ passes through untouched (so filters still reach the scan);
    TIMESTAMP is moved from the session zone to UTC; text and dates are cast.
    """
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.col(name)
    if isinstance(kind, T.TimestampType):
        return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col(name).cast("timestamp_ntz"))
    return F.col(name).cast("timestamp_ntz")


def with_utc(df: DataFrame, *names: str) -> DataFrame:
    """Replace the named instants by their UTC wall-clock form where needed."""
    wanted = {
        n: utc(df, n)
        for n in names
        if n in df.columns and not isinstance(df.schema[n].dataType, T.TimestampNTZType)
    }
    return df.withColumns(wanted) if wanted else df


def instant(value) -> Column:
    """A literal UTC instant from text, a date or a naive datetime."""
    return value if isinstance(value, Column) else F.lit(str(value)).cast("timestamp_ntz")


def project(df: DataFrame, names) -> DataFrame:
    """Select the named columns that the table has, in order."""
    have = set(df.columns)
    return df.select(*[n for n in names if n in have])

