"""Structured Streaming jobs: duplicate alert, timeline, and increments of a given catalogue.

Each streaming job takes a streaming DataFrame, so the source (file log, Kafka, ...) is the
caller's choice, and returns a DataStreamWriter to start with a checkpoint and trigger. The
streaming scan with keyed state is in ``scan``.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from mediacat.operators.exact import duplicate_key, exact_groups_incremental
from mediacat.operators.ingest import diff_listing, new_media
from mediacat.operators.keeper import repick_keeper
from mediacat.operators.maintain import prune_groups, purge
from mediacat.plans.jobs import full_hashes, sampled_hashes
from mediacat.runtime import materialize
from mediacat.schema import Catalog, utc, with_utc
from mediacat.sources.tables import versions


def latest_listing(batch: DataFrame) -> DataFrame:
    """The last entry per path of an append-only listing log."""
    return (
        batch.groupBy("path")
        .agg(F.max_by(F.struct("length", "mtime"), F.struct("mtime", "length")).alias("e"))
        .select("path", "e.length", "e.mtime")
    )


# From the media rows to what maps (photo_id) to (photo_id, hash), as ``sampled_hashes`` and ``full_hashes``.
Reader = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]


class Changes(NamedTuple):
    """What one increment adds and removes; its size follows the increment, not the catalogue."""

    rows: DataFrame  # new and re-read media rows
    leaving: DataFrame  # photo_id of rows that are replaced
    unlinked: DataFrame  # group_id, photo_id of memberships that end, also by a group's end
    members: DataFrame  # group_id, photo_id joined to a group
    groups: DataFrame  # group_id, reason, keeper_id opened


def ingest_changes(
    catalog: Catalog,
    batch: DataFrame,
    extract: Callable[[DataFrame], DataFrame],
    scan_id: str,
    sampled: Reader = sampled_hashes,
    full: Reader = full_hashes,
) -> Changes:
    """One increment of a scan: new and changed files of ``batch`` enter the catalogue and
    the exact groups; deletions need a full listing and stay with the batch scan.

    ``extract`` maps (path, length, mtime) to (path, file_hash, frame_hash, ...). Videos that
    share frame hash and size with a new one are confirmed by ``sampled``, then by ``full``,
    which read the files unless others are given.
    """
    seen = latest_listing(batch)
    known = catalog.media.join(seen.select("path"), "path", "left_semi")
    todo = materialize(diff_listing(seen, known).filter(F.col("status").isin("new", "changed")), "diff")
    rows = materialize(new_media(todo, extract(todo.select("path", "length", "mtime")), scan_id), "rows")
    leaving = todo.filter(F.col("status") == "changed").join(rows.select("id"), "id", "left_semi").select("id")
    left, unlinked = catalog, catalog.members.limit(0)
    if not leaving.isEmpty():
        left, _ = purge(catalog, leaving)
        unlinked = catalog.members.join(left.members, ["group_id", "photo_id"], "left_anti")
    media = left.media.unionByName(rows.select(*[c for c in rows.columns if c in left.media.columns]), allowMissingColumns=True)
    exact = left.groups.filter(F.col("reason") == "exact").select("group_id")
    members, groups = exact_groups_incremental(
        media,
        rows.filter(F.col("file_hash").isNotNull()).select("file_hash"),
        rows.filter(F.col("frame_hash").isNotNull()).select("frame_hash"),
        left.members.join(exact, "group_id", "left_semi"),
        sampled(media),
        full(media),
    )
    return Changes(rows, leaving.withColumnRenamed("id", "photo_id"), unlinked, members, groups)


def write_changes(changes: Changes, path: str, batch_id: int) -> None:
    """Append an increment to the change log; a replayed batch overwrites itself.

    ``rows`` is written last: its marker commits the batch.
    """
    for name in ("leaving", "unlinked", "members", "groups", "rows"):
        getattr(changes, name).write.mode("overwrite").parquet(f"{path}/{name}/v{batch_id + 1:08d}")


def committed_batch(spark: SparkSession, path: str) -> int:
    """Number of the last complete batch in a change log, -1 if none."""
    done = versions(spark, f"{path}/rows")
    return done[-1] - 1 if done else -1


def read_changes(spark: SparkSession, path: str, media_schema, id_type: str = "string") -> Catalog:
    """The catalogue a change log describes.

    A row counts unless it was replaced in a later batch, a membership unless it ended in
    one; groups without two members vanish, and groups that lost a member since they
    opened get their keeper picked anew.
    """
    last = committed_batch(spark, path)
    schemas = {
        "rows": media_schema,
        "leaving": f"photo_id {id_type}",
        "unlinked": f"group_id string, photo_id {id_type}",
        "members": f"group_id string, photo_id {id_type}",
        "groups": f"group_id string, reason string, keeper_id {id_type}",
    }

    def log(name: str) -> DataFrame:
        if last < 0:
            return spark.createDataFrame([], schemas[name]).withColumn("__batch", F.lit(0))
        number = F.regexp_extract(F.input_file_name(), r"/v(\d{8})/[^/]*$", 1).cast("int")
        entries = spark.read.schema(schemas[name]).option("recursiveFileLookup", True).parquet(f"{path}/{name}")
        return entries.withColumn("__batch", number - 1).filter(F.col("__batch") <= last)

    def current(entries: DataFrame, ended: DataFrame, keys: list[str]) -> DataFrame:
        ends = ended.groupBy(*keys).agg(F.max("__batch").alias("__end"))
        alive = F.col("__end").isNull() | (F.col("__batch") >= F.col("__end"))
        return entries.join(ends, keys, "left").filter(alive).drop("__end")

    media = current(log("rows"), log("leaving").withColumnRenamed("photo_id", "id"), ["id"]).drop("__batch")
    pair = ["group_id", "photo_id"]
    members = current(log("members"), log("unlinked"), pair).select(*pair).distinct()
    opened = log("groups").groupBy("group_id", "reason").agg(
        F.max_by("keeper_id", "__batch").alias("keeper_id"), F.max("__batch").alias("__opened")
    )
    ends = log("unlinked").groupBy("group_id").agg(F.max("__batch").alias("__end"))
    groups = opened.select("group_id", "reason", "keeper_id")
    touched = opened.join(ends, "group_id").filter(F.col("__end") > F.col("__opened")).select("group_id")
    groups, members, _ = prune_groups(groups, members)
    members = materialize(members, "members")
    best = repick_keeper(members.join(touched, "group_id", "left_semi"), media).withColumnRenamed("keeper_id", "__best")
    groups = groups.join(best, "group_id", "left").select(
        "group_id", "reason", F.coalesce("__best", "keeper_id").alias("keeper_id")
    )
    groups = materialize(groups, "groups")
    vectors = spark.createDataFrame([], f"photo_id {id_type}, embedding array<float>, model string")
    return Catalog(media, groups, members, vectors)


def duplicate_alerts(media: DataFrame) -> DataFrame:
    """Per content key seen so far: copies, first file and latest file, by capture of arrival.

    On a stream (update mode) each trigger emits the keys it touched; a key with more than
    one copy is an alert. No key expires, since a copy may come at any time: a key that returns
    takes up its stored count. ``scan.keyed_state`` keeps the state on disk in bounded memory. Copies combine before the shuffle and the state is one small row
    per key, so one endlessly repeated file is no burden. Columns: media_type, id, arrived.
    """
    arrived = F.struct(utc(media, "arrived").alias("at"), F.col("id").alias("id"))
    return (
        media.withColumn("key", duplicate_key())
        .filter(F.col("key").isNotNull())
        .groupBy("media_type", "key")
        .agg(F.count("*").alias("copies"), F.min(arrived).alias("first"), F.max(arrived).alias("last"))
        .select(
            "media_type",
            "key",
            "copies",
            F.col("first.id").alias("first_id"),
            F.col("first.at").alias("first_at"),
            F.col("last.id").alias("last_id"),
            F.col("last.at").alias("last_at"),
        )
    )


def stream_duplicate_alert(media: DataFrame, sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """Hand the keys with several copies to ``sink(alerts, batch_id)`` as they grow."""
    alerts = duplicate_alerts(media).filter(F.col("copies") > 1)
    return alerts.writeStream.outputMode("update").foreachBatch(sink)


def append_batches(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that keeps each batch in its own directory, so a replay overwrites itself."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return sink


def latest_alerts(alerts: DataFrame) -> DataFrame:
    """The newest state per key from the stored batches (column ``batch``)."""
    rest = [c for c in alerts.columns if c not in ("media_type", "key", "batch")]
    return (
        alerts.groupBy("media_type", "key")
        .agg(F.max_by(F.struct(*rest), "batch").alias("s"))
        .select("media_type", "key", *[f"s.{c}" for c in rest])
    )


def stream_timeline(media: DataFrame, unit: str = "1 day") -> DataFrame:
    """Files per tumbling window of capture time.

    On a stream, for update mode: each trigger emits the windows it touched. Files are found
    in any order of capture, so no window is ever closed and there is no watermark; the
    state is one small row per window. Works on a batch as well. Windows need a TIMESTAMP,
    so wall-clock UTC goes in as the instant it means and comes out as wall-clock UTC.
    """
    if isinstance(media.schema["taken_at"].dataType, T.TimestampNTZType):
        local = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("taken_at"))
        media = media.withColumn("taken_at", local.cast("timestamp"))
    windows = (
        media.groupBy(F.window("taken_at", unit))
        .agg(F.count("*").alias("count"), F.min("taken_at").alias("first_date"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "count", "first_date")
    )
    return with_utc(windows, "start", "end", "first_date")
