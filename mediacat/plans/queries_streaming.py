"""Streams run to the end of the given tables, then compared as tables."""

from __future__ import annotations

import hashlib
import uuid
import zlib

from pyspark.sql import functions as F

from mediacat.functions.paths import media_type
from mediacat.plans import fixtures as fx
from mediacat.plans.registry import query
from mediacat.runtime import scratch_folder
from mediacat.streaming import jobs, scan


def _folder(spark, name: str) -> str:
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _stream(spark, path: str, parts: int | None = None):
    """A file stream over a Parquet table; ``parts`` files per trigger."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if parts:
        reader = reader.option("maxFilesPerTrigger", parts)
    return reader.parquet(path)


def _finish(writer, folder: str) -> None:
    stream = writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()


@query(
    """SELECT CAST(date_trunc('day', taken_at)::TIMESTAMP AS VARCHAR) AS start, count(*) AS "count" FROM shipments GROUP BY 1""", "shipments"
)
def s3_stream_timeline(spark, sf):
    """Seven years of files, the newest found first, a trigger per two and a half years."""
    folder = _folder(spark, "timeline")
    files = fx.shipments(spark, sf).select("id", "taken_at")
    for after, before in (("1996-07-01", "2100-01-01"), ("1994-01-01", "1996-07-01"), ("1900-01-01", "1994-01-01")):
        span = files.filter(f"taken_at >= timestamp'{after}' and taken_at < timestamp'{before}'")
        span.write.mode("append").parquet(f"{folder}/in")
    found = spark.read.parquet(f"{folder}/in").inputFiles()
    days = jobs.stream_timeline(_stream(spark, f"{folder}/in", -(-len(found) // 3)))
    sink = lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
    _finish(days.writeStream.outputMode("update").foreachBatch(sink), folder)
    done = spark.read.parquet(f"{folder}/out")
    last = done.groupBy("start").agg(F.max_by("count", "batch").alias("count"))
    return last.select(F.col("start").cast("string").alias("start"), "count")


@query(
    """SELECT media_type, key, count(*) AS copies, arg_min(photo_id, (modified_time, photo_id)) AS first_id,
    arg_max(photo_id, (modified_time, photo_id)) AS last_id FROM keyed JOIN media m ON m.id = photo_id WHERE key IS NOT NULL
    GROUP BY keyed.media_type, key HAVING count(*) > 1""".replace("SELECT media_type", "SELECT keyed.media_type"),
    "keyed", "media",
)
def s2_stream_duplicate_alert(spark, sf):
    folder = _folder(spark, "alerts")
    rows = fx.media(spark, sf).filter("deleted_at is null").withColumn("arrived", F.col("modified_time"))
    rows = rows.select("id", "media_type", "file_hash", "frame_hash", "file_size", "arrived")
    rows.repartitionByRange(3, "arrived").write.parquet(f"{folder}/in")
    scan.keyed_state(spark)
    writer = jobs.stream_duplicate_alert(_stream(spark, f"{folder}/in", 1), jobs.append_batches(f"{folder}/out"))
    _finish(writer, folder)
    alerts = jobs.latest_alerts(spark.read.parquet(f"{folder}/out"))
    return alerts.select("media_type", "key", "copies", "first_id", "last_id")


STREAM_MEDIA = (
    "id string, path string, filename string, media_type string, file_size bigint, file_hash string, frame_hash string, "
    "taken_at timestamp_ntz, modified_time timestamp_ntz, deleted_at timestamp_ntz, latitude double, longitude double, "
    "width int, height int"
)


def _read_files(files):
    """Stands in for reading the files: their length is their content; all videos open with the same frame."""
    nothing = {"deleted_at": "timestamp_ntz", "latitude": "double", "longitude": "double",
               "width": "int", "height": "int"}
    return files.select(
        "path",
        F.md5(F.col("length").cast("string")).alias("file_hash"),
        F.when(media_type(F.col("path")) == "video", F.md5(F.lit("black"))).alias("frame_hash"),
        *[F.lit(None).cast(kind).alias(name) for name, kind in nothing.items()],
    )


def _read_file(path, length):
    """Stands in for reading one file, as ``_read_files``; half of the videos agree in their samples."""
    found = {"file_hash": hashlib.md5(str(length).encode()).hexdigest()}
    if path.endswith(".mp4"):
        found["frame_hash"] = hashlib.md5(b"black").hexdigest()
        found["sampled_hash"] = hashlib.md5(b"" if zlib.crc32(path.encode()) % 2 == 0 else path.encode()).hexdigest()
    return found


def _read_whole(media):
    """Stands in for reading whole files: no two videos are equal."""
    paths = media.select(F.col("id").alias("photo_id"), "path")
    return lambda ids: ids.join(paths, "photo_id").select("photo_id", F.md5("path").alias("full_hash"))


@query(
    """, final AS (SELECT path, length + CASE WHEN path LIKE '%7.jpg' THEN 5 ELSE 0 END AS length FROM listing)
    SELECT path, length AS file_size, md5(length::VARCHAR) AS file_hash, CASE WHEN path LIKE '%.jpg' THEN
      (SELECT count(*) FROM final o WHERE o.length = l.length AND o.path LIKE '%.jpg') ELSE 1 END AS copies FROM final l""",
    "listing",
)
def s1_stream_ingest(spark, sf):
    """The listing arrives in two increments, then some files again with a new length."""
    folder = _folder(spark, "ingest")
    listing = fx.listing(spark, sf)
    again = listing.filter("path like '%7.jpg'").selectExpr("path", "length + 5 as length", "mtime + interval '1' day as mtime")
    listing.repartitionByRange(2, "path").write.parquet(f"{folder}/in")
    again.coalesce(1).write.mode("append").parquet(f"{folder}/in")

    scan.run_scan(scan.start_scan(spark, _stream(spark, f"{folder}/in", 1), folder, _read_file, full=_read_whole))
    c = scan.read_catalog(spark, folder)
    sizes = c.members.groupBy("group_id").agg(F.count("*").alias("copies"))
    copies = c.members.join(sizes, "group_id").select(F.col("photo_id").alias("id"), "copies")
    return c.media.join(copies, "id", "left").select(
        "path", "file_size", "file_hash", F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies")
    )


def _columns(changes):
    names = [c.split()[0] for c in STREAM_MEDIA.split(", ")]
    return changes._replace(rows=changes.rows.select(*names))
