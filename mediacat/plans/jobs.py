"""End-to-end jobs: scan a folder, rebuild exact groups, rebuild similar groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacat.operators.exact import exact_groups, verify_video_groups
from mediacat.operators.ingest import apply_scan, diff_listing, fill_missing_phash, new_media
from mediacat.operators.keeper import pick_keeper
from mediacat.operators.similar import similar_groups
from mediacat.runtime import materialize
from mediacat.schema import Catalog
from mediacat.sources.listing import full_hash_files, sampled_hash_files
from mediacat.sources.tables import rebuild_groups


def scan_folder(catalog: Catalog, folder_id, listing: DataFrame, extract, scan_id: str, force: bool = False):
    """(catalog, diff) after scanning one folder.

    ``extract`` maps (path, length, mtime) to what was read from the files, keyed by path.
    """
    mine = catalog.media.filter(F.col("folder_id") == F.lit(folder_id))
    diff = materialize(diff_listing(listing, mine, force), "diff")
    todo = diff.filter(F.col("status").isin("new", "changed")).select("path", "length", "mtime")
    rows = materialize(new_media(diff, extract(todo), scan_id, folder_id), "rows")
    return apply_scan(catalog, diff, rows), diff


def exact_report(
    media: DataFrame, sampled: DataFrame | None = None, full=None, unverified: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(members, groups) of the exact reason from scratch.

    ``sampled`` and ``full`` are those of ``verify_video_groups``. Without them the files are
    read: samples of the videos that share frame hash and size, then the whole of those that
    still look alike. ``unverified`` reads nothing and rests on frame hash and size.
    """
    found = exact_groups(media)
    if not unverified:
        sampled = sampled_hashes(media) if sampled is None else sampled
        found = verify_video_groups(found, sampled, full=full_hashes(media) if full is None else full)
    members = materialize(found.select("group_id", "photo_id"), "exact")
    groups = pick_keeper(members, media).withColumn("reason", F.lit("exact"))
    return members, groups.select("group_id", "reason", "keeper_id")


def hash_video_candidates(media: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """(photo_id, sampled_hash) of the videos that share frame hash and size with another.

    Only these are read, at most three chunks each. ``ingest.hash_backfill`` stores them.
    """
    candidates = exact_groups(media).filter(F.col("media_type") == "video").select("photo_id")
    return sampled_hashes(media, chunk)(candidates)


def sampled_hashes(media: DataFrame, chunk: int = 1 << 20) -> Callable[[DataFrame], DataFrame]:
    """For ``verify_video_groups``: reads at most three chunks of the files of the (photo_id) it is given."""

    def read(ids: DataFrame) -> DataFrame:
        files = ids.join(media.selectExpr("id as photo_id", "path", "file_size as length"), "photo_id")
        files = materialize(files, "candidates")
        return files.join(sampled_hash_files(files, chunk), "path").select("photo_id", "sampled_hash")

    return read


def full_hashes(media: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """For ``verify_video_groups``: reads the files of the (photo_id) it is given, whole."""

    def read(ids: DataFrame) -> DataFrame:
        files = ids.join(media.selectExpr("id as photo_id", "path", "file_size as length"), "photo_id")
        files = materialize(files, "to_read")
        return files.join(full_hash_files(files), "path").select("photo_id", "full_hash")

    return read


def rebuild_exact(
    media: DataFrame, base: str, sampled: DataFrame | None = None, full=None, unverified: bool = False
) -> None:
    """Replace the stored exact groups by those of ``exact_report``."""
    members, groups = exact_report(media, sampled, full, unverified)
    rebuild_groups(members, groups, base, "exact")


def rebuild_similar(media: DataFrame, base: str, fingerprints: DataFrame | None = None, mode: str = "complete") -> None:
    """Fill missing fingerprints, if given as (path, perceptual_hash), then regroup."""
    if fingerprints is not None:
        media = materialize(fill_missing_phash(media, fingerprints), "media")
    members, groups = similar_groups(media, mode=mode)
    rebuild_groups(members, groups, base, "similar")
