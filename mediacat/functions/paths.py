"""File names, folders and media types as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediacat.schema import IMAGE_EXTENSIONS, SYSTEM_DIRECTORIES, VIDEO_EXTENSIONS


def _has_extension(path: Column, extensions) -> Column:
    return path.rlike(r"(?i)\.(" + "|".join(extensions) + r")$")


def is_supported(path: Column) -> Column:
    return _has_extension(path, IMAGE_EXTENSIONS + VIDEO_EXTENSIONS)


def media_type(path: Column) -> Column:
    """'video' for a video extension, else 'image'."""
    return F.when(_has_extension(path, VIDEO_EXTENSIONS), F.lit("video")).otherwise(F.lit("image"))


def basename(path: Column) -> Column:
    """The part after the last slash or backslash."""
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def normalize_folder(path: Column) -> Column:
    """Forward slashes, no trailing slash."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"/+$", "")


def in_skipped_directory(path: Column, below: Column | None = None) -> Column:
    """True if a directory on the way (below the root, if given) is hidden or a system one."""
    inner = path if below is None else F.substr(path, F.length(below) + 1)
    named = "|".join(s.replace("$", r"\$") for s in SYSTEM_DIRECTORIES)
    return inner.rlike(rf"(^|/)(\.[^/]*|{named})/")


def split_extension(path: Column) -> tuple[Column, Column]:
    """(path without extension, extension with its dot); a leading dot is no extension."""
    ext = F.regexp_extract(path, r"[^/\\](\.[^./\\]*)$", 1)
    return F.substr(path, F.lit(1), F.length(path) - F.length(ext)), ext
