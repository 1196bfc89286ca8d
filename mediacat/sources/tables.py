"""Catalogue tables on shared storage: versioned snapshots, committed by Spark's marker file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacat.runtime import hot_keys, join_lookup
from mediacat.schema import utc

STORED_SCHEMA = "group_id string, keeper_id string, photo_id string"


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def versions(spark: SparkSession, base: str) -> list[int]:
    """Committed versions below ``base``; a half-written one has no marker and is not listed."""
    fs, where = _files(spark, base)
    if not fs.exists(where):
        return []
    found = []
    for entry in fs.listStatus(where):
        name = entry.getPath().getName()
        if name.startswith("v") and name[1:].isdigit():
            marker, marked = _files(spark, f"{base}/{name}/_SUCCESS")
            if marker.exists(marked):
                found.append(int(name[1:]))
    return sorted(found)


def write_snapshot(df: DataFrame, base: str) -> int:
    """Write the whole table as the next version. Readers switch when its marker appears.

    An empty table is a version like any other, so replacing everything by nothing works.
    A failed job leaves an unmarked directory that the next attempt overwrites.
    """
    done = versions(df.sparkSession, base)
    version = (done[-1] if done else 0) + 1
    df.write.mode("overwrite").parquet(f"{base}/v{version:08d}")
    return version


def read_snapshot(spark: SparkSession, base: str, schema, version: int | None = None) -> DataFrame:
    """A version of the table (the latest by default); empty if there is none."""
    done = versions(spark, base)
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{base}/v{version or done[-1]:08d}")


def rebuild_groups(members: DataFrame, keepers: DataFrame, base: str, reason: str) -> int:
    """Replace all groups of one reason, also by nothing, in a single commit.

    One stored row per member carries its group and that group's keeper, so a reader sees
    either the whole old state or the whole new one.
    """
    hot = hot_keys(members.groupBy("group_id").count(), ["group_id"], "count")
    rows = join_lookup(
        members.select("group_id", "photo_id"), keepers.select("group_id", "keeper_id"), ["group_id"], hot
    )
    return write_snapshot(rows.select("group_id", "keeper_id", "photo_id"), f"{base}/reason={reason}")


def read_groups(
    spark: SparkSession, base: str, reasons=("exact", "similar"), id_type: str = "string"
) -> tuple[DataFrame, DataFrame]:
    """(groups, members) of the given reasons, as last committed."""
    schema = STORED_SCHEMA if id_type == "string" else f"group_id string, keeper_id {id_type}, photo_id {id_type}"
    parts = [
        read_snapshot(spark, f"{base}/reason={r}", schema).withColumn("reason", F.lit(r)) for r in reasons
    ]
    rows = reduce(DataFrame.unionByName, parts)
    groups = rows.groupBy("group_id", "reason").agg(F.max("keeper_id").alias("keeper_id"))
    return groups, rows.select("group_id", "photo_id")


def clear_stored_groups(spark: SparkSession, base: str, reason: str | None = None) -> None:
    """Empty the stored groups of one reason, or of both."""
    for name in [reason] if reason else ["exact", "similar"]:
        write_snapshot(spark.createDataFrame([], STORED_SCHEMA), f"{base}/reason={name}")


def ingest_month(df: DataFrame) -> Column:
    return F.date_format(utc(df, "modified_time").cast("date"), "yyyy-MM")


def write_media(media: DataFrame, path: str) -> None:
    """Catalogue layout: one directory per ingest month, sorted by capture time inside.

    The sort gives tight row-group ranges on taken_at for time filters; bloom filters on
    the lookup columns let path and hash probes skip files.
    """
    (
        media.withColumn("ingest_month", F.coalesce(ingest_month(media), F.lit("unknown")))
        .repartitionByRange("ingest_month", "taken_at", "id")
        .sortWithinPartitions("ingest_month", "taken_at", "id")
        .write.mode("overwrite")
        .partitionBy("ingest_month")
        .option("parquet.bloom.filter.enabled#path", "true")
        .option("parquet.bloom.filter.enabled#file_hash", "true")
        .parquet(path)
    )


def read_media(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
