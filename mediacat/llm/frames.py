"""What several operators share: word patterns, bucketed tables, distributed running totals."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mediacat.runtime import materialize, scratch_folder

# What separates words, what a word is, and what lines are stripped of.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucketed(df: DataFrame, keys: list[str], buckets: int | None, name: str) -> DataFrame:
    """Write a table whose files are hash-bucketed and sorted by ``keys``, and read it back.

    Joins of two such tables on the keys need no exchange. The files lie in the shared
    scratch folder. Without ``buckets`` the rows are dealt out by the keys already, into as
    many parts as the session shuffles to.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{scratch_folder(spark)}/{table}"
    dealt = df.repartition(buckets, *keys) if buckets else df
    (
        dealt.write.bucketBy(buckets or shuffle_parts(spark), *keys)
        .sortBy(*keys)
        .option("path", path)
        .option("compression", "zstd")
        .saveAsTable(table)
    )
    out = spark.table(table)
    out._mediacat_table = table
    out._mediacat_path = path
    return out


def drop_bucketed(df: DataFrame) -> None:
    """Forget a table made by ``bucketed`` and delete its files."""
    from mediacat.runtime import release

    df.sparkSession.sql(f"DROP TABLE IF EXISTS {df.__dict__['_mediacat_table']}")
    release(df)


def running_total(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """Inclusive running sum of ``value`` in a global order, without a one-task window.

    The rows are range-sorted and written once. Each then adds the sum of the partitions
    before its own (one row per partition reaches the broadcast) to the running sum inside
    its partition. ``order`` should end in something unique, so that a run of equal leading
    values can be split between partitions.
    """
    part, before = f"__{name}_part", f"__{name}_before"
    ranked = materialize(df.orderBy(*order).withColumn(part, F.spark_partition_id()), "running")
    sums = ranked.groupBy(part).agg(F.sum(value).alias("__sum"))
    earlier = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(part, F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias(before))
    inside = W.partitionBy(part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (
        ranked.join(F.broadcast(offsets), part)
        .withColumn(name, F.col(before) + F.sum(value).over(inside))
        .drop(part, before)
    )
