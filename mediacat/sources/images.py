"""Perceptual fingerprints of image files."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacat.functions.fingerprints import file_fingerprint, phash_batches
from mediacat.operators.filters import phash_missing
from mediacat.runtime import balanced_tasks
from mediacat.sources.listing import file_opener

# A task reads about this much; a larger file is a task of its own.
TASK_BYTES = 256 << 20
# Opening a file counts as this much reading.
OPEN_BYTES = 1 << 20


def phash_files(spark: SparkSession, roots: list[str] | str) -> DataFrame:
    """(path, perceptual_hash) of every image; undecodable files get the zero fingerprint."""
    images = (
        spark.read.format("image")
        .option("recursiveFileLookup", True)
        .option("dropInvalid", False)
        .load(roots)
    )
    return phash(
        images.select(
            F.regexp_replace("image.origin", r"^file:/*", "/").alias("path"),
            "image.height",
            "image.width",
            "image.nChannels",
            "image.data",
        )
    )


def phash(images: DataFrame) -> DataFrame:
    """Fingerprints of decoded images: path, height, width, nChannels, data (BGR bytes)."""
    return images.select("path", "height", "width", "nChannels", "data").mapInPandas(
        phash_batches, "path string, perceptual_hash string"
    )


def phash_tasks(media: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """id, path, length, task: the files still without fingerprint, dealt out by size.

    A running sum of sizes in order of id cuts the files into tasks of about ``task_bytes``
    (a file without a known size counts as opening it alone).
    """
    files = phash_missing(media, "file_size").select("id", "path", F.coalesce("file_size", F.lit(0)).alias("length"))
    weighed = files.withColumn("__weight", F.col("length") + OPEN_BYTES)
    return balanced_tasks(weighed, [F.col("id").asc()], "__weight", task_bytes).drop("__weight")


def phash_missing_files(
    media: DataFrame,
    decode: Callable[[bytes], tuple[int, int, int, bytes] | None],
    task_bytes: int = TASK_BYTES,
) -> DataFrame:
    """(path, perceptual_hash) of just the files without fingerprint; no other file is opened.

    ``decode`` maps the content of a file to (height, width, channels, pixels as in
    ``phash``), or to None. A file that it cannot decode gets the zero fingerprint; a file that
    cannot be read gives no row, so that the next run asks for it again.
    """

    def batches(frames):
        from pyarrow import ArrowException

        open_file = file_opener()
        for pdf in frames:
            paths, found = [], []
            for path in pdf["path"]:
                try:
                    with open_file(path) as f:
                        content = f.read()
                except (OSError, ArrowException):
                    continue
                paths.append(path)
                found.append(file_fingerprint(content, decode))
            yield pd.DataFrame({"path": paths, "perceptual_hash": found}, dtype="object")

    dealt = phash_tasks(media, task_bytes)
    most = dealt.agg(F.max("task")).first()[0]
    dealt = dealt.repartitionById(1 if most is None else most + 1, F.col("task").cast("int"))
    return dealt.select("path").mapInPandas(batches, "path string, perceptual_hash string")
