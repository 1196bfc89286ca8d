"""File listings: what is on disk, and hashes read straight from the files."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacat.functions import paths
from mediacat.runtime import for_heavy_rows, materialize
from mediacat.schema import SYSTEM_DIRECTORIES, utc


def media_files(listing: DataFrame, roots: list[str] | None = None) -> DataFrame:
    """Keep supported files outside hidden and system directories.

    ``listing`` is any table of (path, length, mtime): a storage inventory report is the
    natural input when a bucket holds billions of objects. Only directories below the
    root count, so a root may itself lie under a hidden folder.
    """
    below = None
    if roots:
        # a handful of scan roots; the longest one that contains the file wins
        clean = sorted({r.rstrip("/") for r in roots}, key=len, reverse=True)
        below = F.coalesce(*[F.when(F.col("path").startswith(r + "/"), F.lit(r)) for r in clean], F.lit(""))
    return listing.filter(
        paths.is_supported(F.col("path")) & ~paths.in_skipped_directory(F.col("path"), below)
    )


def list_media(spark: SparkSession, roots: list[str] | str) -> DataFrame:
    """Recursive listing of the roots: path, length, mtime of supported files; no content is read.

    Hidden and system directories are not entered, and one that may not be read is left out
    (``list_folders`` names it). A root that cannot be listed raises ``FileNotFoundError``:
    taken for an empty one it would mark all its catalogue rows as deleted.
    """
    roots = [roots] if isinstance(roots, str) else list(roots)
    found = list_folders(spark, roots)
    clean = [_plain(r) for r in roots]
    lost = found.filter((F.col("kind") == "unreadable") & F.col("path").isin(clean)).limit(len(roots)).collect()
    if lost:
        raise FileNotFoundError(", ".join(sorted(r["path"] for r in lost)))
    return media_files(found.filter("kind = 'file'").select("path", "length", "mtime"), clean)


# A task goes on into the folders it finds until it has listed this many, then hands the rest on.
FOLDERS_PER_TASK = 500
_ENTRIES = "path string, kind string, length bigint, millis bigint"


def list_folders(spark: SparkSession, roots: list[str], folders_per_task: int = FOLDERS_PER_TASK) -> DataFrame:
    """path, kind ('file', 'folder' or 'unreadable'), length, mtime of everything below the roots.

    Tasks list folders; what a task does not get to is dealt out anew in the next round, so the
    driver holds the roots and one count a round, and there are at most as many rounds as levels.
    Links are not followed. Every folder appears once, as 'unreadable' if it could not be listed;
    a root that is a file is listed as one. The entries of one folder are listed by one task, on
    local disks as a stream.
    """

    def batches(frames):
        walk = _walker()
        for pdf in frames:
            open_folders, listed = list(pdf["path"])[::-1], 0
            given = len(open_folders)
            while open_folders:
                if listed >= max(given, folders_per_task):
                    yield pd.DataFrame({"path": open_folders, "kind": "open", "length": None, "millis": None})
                    break
                folder, listed = open_folders.pop(), listed + 1
                for rows in walk(folder):
                    open_folders += [path for path, kind, _, _ in rows if kind == "open"]
                    rows = [r for r in rows if r[1] != "open"]
                    if rows:
                        out = pd.DataFrame(rows, columns=["path", "kind", "length", "millis"])
                        yield out.astype({"length": "Int64", "millis": "Int64"})

    pending = spark.createDataFrame([(_plain(r),) for r in dict.fromkeys(roots)], "path string")
    rounds = []
    while not rounds or not pending.isEmpty():
        step = for_heavy_rows(pending.select("path")).mapInPandas(batches, _ENTRIES)
        rounds.append(materialize(step, "listing"))
        pending = rounds[-1].filter("kind = 'open'")
    found = reduce(DataFrame.unionByName, rounds).filter("kind <> 'open'")
    found = found.withColumn("at", F.timestamp_millis("millis"))
    return found.select("path", "kind", "length", utc(found, "at").alias("mtime"))


def _plain(path: str) -> str:
    """Local paths without scheme; no trailing slash."""
    return re.sub(r"^file:/*", "/", path).rstrip("/") or "/"


def _walker(batch: int = 10_000):
    """A function that lists one folder: lists of (path, kind, length, millis), 'open' for a folder to enter."""
    from pyarrow import ArrowException, fs

    locate = _locator()
    hidden = frozenset(SYSTEM_DIRECTORIES)

    def local(folder):
        with os.scandir(folder) as entries:
            for entry in entries:
                if entry.is_dir(follow_symlinks=False):
                    yield entry.path, entry.name, None, None
                elif entry.is_file(follow_symlinks=False):
                    try:
                        seen = entry.stat(follow_symlinks=False)
                    except FileNotFoundError:  # removed since
                        continue
                    yield entry.path, entry.name, seen.st_size, seen.st_mtime_ns // 1_000_000

    def remote(folder):
        system, inner = locate(folder)
        prefix = folder[: len(folder) - len(inner.rstrip("/"))]
        for info in system.get_file_info(fs.FileSelector(inner)):
            if info.type == fs.FileType.Directory:
                yield prefix + info.path, info.base_name, None, None
            elif info.type == fs.FileType.File:
                millis = None if info.mtime_ns is None else info.mtime_ns // 1_000_000
                yield prefix + info.path, info.base_name, info.size, millis

    def single(path):
        system, inner = locate(path)
        info = system.get_file_info(inner)
        if info.type != fs.FileType.File:
            return None
        return path, "file", info.size, None if info.mtime_ns is None else info.mtime_ns // 1_000_000

    def walk(folder):
        rows, state = [], "folder"
        try:
            for path, name, length, millis in remote(folder) if "://" in folder else local(folder):
                if length is not None:
                    rows.append((path, "file", length, millis))
                elif not name.startswith(".") and name not in hidden:
                    rows.append((path, "open", None, None))
                if len(rows) >= batch:
                    yield rows
                    rows = []
        except (OSError, ArrowException):
            try:
                alone = single(folder)
            except (OSError, ArrowException):
                alone = None
            if alone:
                yield [alone]
                return
            state = "unreadable"
        yield rows + [(folder, state, None, None)]

    return walk


def read_content(spark: SparkSession, roots: list[str] | str) -> DataFrame:
    """path, length and content of every file below the roots."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots)
    return found.select(F.regexp_replace("path", r"^file:/*", "/").alias("path"), "length", "content")


def _locator():
    """A function from a path to (file system, path in it), with one file system per scheme and bucket."""
    from pyarrow import fs

    systems: dict[str, fs.FileSystem] = {}

    def locate(path: str):
        path = re.sub(r"^s3[an]://", "s3://", path)
        if "://" not in path:
            return systems.setdefault("", fs.LocalFileSystem()), re.sub("^file:/*", "/", path)
        scheme, rest = path.split("://", 1)
        root = f"{scheme}://{rest.partition('/')[0]}"
        if root not in systems:
            systems[root] = fs.FileSystem.from_uri(path)[0]
        inner = rest if scheme in ("s3", "gs") else "/" + rest.lstrip("/") if scheme == "file" else "/" + rest.partition("/")[2]
        return systems[root], inner

    return locate


def file_opener():
    """A function that opens a path for reading; for use inside a task."""
    locate = _locator()

    def open_file(path: str):
        system, inner = locate(path)
        return system.open_input_file(inner)

    return open_file


def _hash_files(listing: DataFrame, name: str, spans: Callable[[int], list[tuple[int, int]]]) -> DataFrame:
    """(path, name): SHA-256 over the byte ranges that ``spans`` gives for a length; null if unreadable."""

    def batches(frames):
        from pyarrow import ArrowException

        open_file = file_opener()
        for pdf in frames:
            hashes = []
            for path, size in zip(pdf["path"], pdf["length"]):
                try:
                    state = hashlib.sha256()
                    with open_file(path) as f:
                        for start, width in spans(int(size)):
                            f.seek(start)
                            while width > 0:  # in pieces: a span may be a whole file
                                piece = f.read(min(width, _PIECE))
                                if not piece:
                                    break
                                state.update(piece)
                                width -= len(piece)
                    hashes.append(state.hexdigest())
                except (OSError, ArrowException):
                    hashes.append(None)
            yield pd.DataFrame({"path": pdf["path"], name: hashes})

    files = for_heavy_rows(listing.select("path", "length"))
    return files.mapInPandas(batches, f"path string, {name} string")


_PIECE = 4 << 20


def sampled_hash_files(listing: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """(path, sampled_hash) by range reads: at most three chunks per file leave storage.

    Equals ``functions.hashing.sampled_hash`` over the full content, but also works for
    files far larger than a row may be. Unreadable files give null. Equal samples do not
    make equal files: ``full_hash_files`` decides.
    """

    def spans(size: int) -> list[tuple[int, int]]:
        half = chunk // 2
        if size <= 3 * chunk:
            return [(0, size)]
        return [(0, chunk), (size // 2 - half, 2 * half), (size - chunk, chunk)]

    return _hash_files(listing, "sampled_hash", spans)


def full_hash_files(listing: DataFrame) -> DataFrame:
    """(path, full_hash): SHA-256 of each whole file, streamed in pieces; null if unreadable."""
    return _hash_files(listing, "full_hash", lambda size: [(0, size)])
