"""Change detection against the catalogue and the tables it updates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediacat.functions.hashing import is_legacy_hash
from mediacat.functions.paths import basename, media_type, normalize_folder
from mediacat.operators.filters import active
from mediacat.operators.maintain import purge
from mediacat.runtime import materialize, one_per_key, release, without_taken
from mediacat.schema import Catalog, with_utc


def diff_listing(listing: DataFrame, media: DataFrame, force: bool = False) -> DataFrame:
    """path, id, status, length, mtime: 'new', 'unchanged', 'changed' or 'deleted'.

    ``listing`` is the full listing of the folders that ``media`` covers, so an empty one
    deletes everything. A file is unchanged only if size and mtime both match; a row
    without a stored mtime counts as changed. With ``force`` every listed file is new and
    every catalogue row is deleted.
    """
    listing = with_utc(listing.select("path", "length", "mtime"), "mtime")
    known = with_utc(active(media).select("path", "id", "file_size", "modified_time"), "modified_time")
    if force:
        gone = known.select("path", "id", F.lit("deleted").alias("status"))
        new = listing.withColumn("status", F.lit("new"))
        return new.unionByName(gone, allowMissingColumns=True).select("path", "id", "status", "length", "mtime")
    same = (F.col("length") == F.col("file_size")) & (F.col("mtime") == F.col("modified_time"))
    status = (
        F.when(F.col("id").isNull(), "new")
        .when(F.col("mtime").isNull() & F.col("length").isNull(), "deleted")
        .when(F.coalesce(same, F.lit(False)), "unchanged")
        .otherwise("changed")
    )
    return listing.join(known, "path", "full_outer").select(
        "path", "id", status.alias("status"), "length", "mtime"
    )


def new_media(diff: DataFrame, extracted: DataFrame, scan_id: str, folder_id=None) -> DataFrame:
    """Catalogue rows of the new and changed files of a diff.

    ``extracted`` is keyed by path and carries whatever was read from the files
    (file_hash, frame_hash, tag columns, ...); files missing from it failed and are left
    out. A new file's id depends on path and scan only, so a repeated run agrees.
    """
    todo = diff.filter(F.col("status").isin("new", "changed"))
    rows = todo.join(extracted, "path")
    fresh_id = F.md5(F.concat_ws("|", F.lit(scan_id), F.col("path")))
    taken = F.coalesce(F.col("taken_at"), F.col("mtime")) if "taken_at" in extracted.columns else F.col("mtime")
    rows = rows.withColumns(
        {
            "id": F.coalesce(F.col("id").cast("string"), fresh_id),
            "filename": basename(F.col("path")),
            "media_type": media_type(F.col("path")),
            "file_size": F.col("length"),
            "modified_time": F.col("mtime"),
            "taken_at": default_taken_at(media_type(F.col("path")), taken, F.col("mtime")),
        }
    )
    if folder_id is not None:
        rows = rows.withColumn("folder_id", F.lit(folder_id))
    return rows.drop("length", "mtime", "status")


def default_taken_at(kind: Column, tagged: Column, mtime: Column) -> Column:
    """Images: the tagged date, else the file time; videos: the file time."""
    return F.when(kind == "video", mtime).otherwise(F.coalesce(tagged, mtime))


def insert_ignore(media: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """Append rows whose id and path are both free; of rivals in a batch one wins.

    A batch row loses only to a row that is really inserted. With ``order`` the first of rivals
    wins; without, the one whose hash comes first, the same on every run. Rounds settle all rows
    that come first for both their id and their path and strike out their rivals. An ordinary
    batch needs one round. Among hashes a chain of rivals falls apart everywhere at once, which
    takes a logarithmic number of rounds; a given ``order`` must be followed along the chain.
    """
    # rivals equal in order, path and id differ in content: its hash settles them the same way every time
    content = F.xxhash64(*new.columns)
    lead = F.col(order) if order else content.alias("chance")
    rank = F.struct(lead, F.col("path"), F.col("id"), content.alias("content"))
    open_rows = without_taken(without_taken(new, media, "id"), media, "path").withColumn("__rank", rank)
    open_rows = materialize(open_rows, "batch")
    won = []
    while not open_rows.isEmpty():
        first_path = open_rows.groupBy("path").agg(F.min("__rank").alias("__first_path"))
        first_id = open_rows.groupBy("id").agg(F.min("__rank").alias("__first_id"))
        settled = materialize(
            open_rows.join(first_path, "path")
            .join(first_id, "id")
            .filter((F.col("__rank") == F.col("__first_path")) & (F.col("__rank") == F.col("__first_id")))
            .select(*open_rows.columns),
            "settled",
        )
        won.append(settled)
        previous, open_rows = open_rows, materialize(
            open_rows.join(settled.select("id"), "id", "left_anti").join(settled.select("path"), "path", "left_anti"),
            "open",
        )
        release(previous)
    if not won:
        return media
    added = reduce(DataFrame.unionByName, won).dropDuplicates(["id"]).drop("__rank")
    extra = [c for c in added.columns if c not in media.columns]
    return media.unionByName(added.drop(*extra), allowMissingColumns=True)


def apply_scan(catalog: Catalog, diff: DataFrame, rows: DataFrame) -> Catalog:
    """Commit a scan: deleted and re-read rows leave with their vectors and memberships,
    then the new and re-read rows are inserted (a re-read row keeps its id only).

    A changed file whose content could not be read keeps its old row.
    """
    changed = diff.filter(F.col("status") == "changed").join(rows.select("id"), "id", "left_semi")
    leaving = changed.select("id").unionByName(diff.filter(F.col("status") == "deleted").select("id"))
    left, _ = purge(catalog, leaving)
    return left._replace(media=insert_ignore(left.media, rows))


def scan_summary(diff: DataFrame, folder_of: Column) -> DataFrame:
    """Per folder: files listed, new (including re-read), skipped, deleted."""
    def n(*statuses):
        return F.count_if(F.col("status").isin(*statuses))

    return diff.groupBy(folder_of.alias("folder_id")).agg(
        n("new", "changed", "unchanged").alias("total"),
        n("new", "changed").alias("new_count"),
        n("unchanged").alias("skipped"),
        n("deleted").alias("deleted"),
    )


def folder_scan_times(folders: DataFrame, media: DataFrame, scanned: DataFrame, now: Column) -> DataFrame:
    """Folders with photo_count and last_scanned brought up to date for the scanned ids."""
    counts = active(media).groupBy(F.col("folder_id").alias("id")).agg(F.count("*").alias("__n"))
    done = scanned.select("id").distinct().withColumn("__done", F.lit(True))
    rows = folders.join(counts, "id", "left").join(done, "id", "left")

    def updated(name: str, value: Column) -> Column:
        old = F.col(name) if name in folders.columns else F.lit(None)
        return F.when(F.col("__done"), value).otherwise(old)

    return rows.withColumns(
        {"photo_count": updated("photo_count", F.coalesce("__n", F.lit(0))), "last_scanned": updated("last_scanned", now)}
    ).drop("__n", "__done")


def hash_backfill(media: DataFrame, updates: DataFrame, column: str, order: str | None = None) -> DataFrame:
    """Write a hash column back by id; trashed rows stay.

    Of several updates of an id the last by ``order`` wins (the least without); an update
    without a hash never takes part.
    """
    own = [F.col(order).alias("__order")] if order else []
    given = updates.filter(F.col(column).isNotNull()).select("id", F.col(column).alias("__new"), *own)
    new = one_per_key(given, order="__order" if order else None)
    value = F.when(F.col("deleted_at").isNull() & F.col("__new").isNotNull(), F.col("__new")).otherwise(F.col(column))
    return media.join(new, "id", "left").withColumn(column, value).drop("__new").select(*media.columns)


def fill_missing_phash(media: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Write (path, perceptual_hash) back to the active rows that have none yet."""
    todo = active(media).filter(F.col("perceptual_hash").isNull()).select("id", "path")
    return hash_backfill(media, todo.join(fingerprints, "path").select("id", "perceptual_hash"), "perceptual_hash")


def legacy_hashes(media: DataFrame) -> DataFrame:
    """Active rows whose hash has the older 32-digit form."""
    return active(media).filter(is_legacy_hash(F.col("file_hash"))).select("id", "path", "file_hash")


def rehash_legacy(media: DataFrame, hashes: DataFrame) -> DataFrame:
    """Replace older hashes by the recomputed (path, file_hash)."""
    todo = legacy_hashes(media).drop("file_hash").join(hashes.select("path", "file_hash"), "path")
    return hash_backfill(media, todo.select("id", "file_hash"), "file_hash")


def upsert_embeddings(embeddings: DataFrame, batch: DataFrame) -> DataFrame:
    """Insert or replace vectors by photo_id; created_at survives.

    ``batch`` is (photo_id, embedding, model, updated_at); the latest of repeats wins.
    """
    packed = F.struct("embedding", "model", "updated_at")
    latest = batch.groupBy("photo_id").agg(
        F.max_by(packed, F.struct("updated_at", "model")).alias("__new"), F.min("updated_at").alias("__first")
    )
    def pick(name):
        return F.when(F.col("__new").isNotNull(), F.col(f"__new.{name}")).otherwise(F.col(name)).alias(name)

    # a small batch is sent to the vectors; they are not shuffled for it
    kept = embeddings.join(latest, "photo_id", "left").select(
        "photo_id", pick("embedding"), pick("model"), "created_at", pick("updated_at")
    )
    added = without_taken(latest, embeddings, "photo_id").select(
        "photo_id", "__new.embedding", "__new.model", F.col("__first").alias("created_at"), "__new.updated_at"
    )
    return kept.unionByName(added)


def folder_overlap(folders: DataFrame, candidates: DataFrame, trash_dir: str = ".media-trash") -> DataFrame:
    """path, verdict, folder_ids for each candidate folder path.

    Verdicts: 'same' (already there), 'trash' (inside the trash folder), 'child' (below a
    known folder), 'parent' (above known folders, one row per known child), 'new'.
    Containment is an equi-join on the explicit ancestors of a path, so neither side needs
    to be small.
    """
    def ancestors(path: Column) -> Column:
        parts = F.split(path, "/")
        depths = F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))
        return F.transform(depths, lambda n: F.array_join(F.slice(parts, 1, n), "/"))

    cand = candidates.select("path").distinct().withColumn("norm", normalize_folder(F.col("path")))
    known = folders.select(
        F.col("id").alias("folder_id"), F.col("path").alias("folder_path"), "added_at",
        normalize_folder(F.col("path")).alias("folder_norm"),
    )
    same = cand.join(known.select(F.col("folder_path").alias("path"), "folder_id"), "path").groupBy("path").agg(
        F.min("folder_id").alias("folder_id")
    )
    above = (
        cand.select("path", "norm", F.explode(ancestors(F.col("norm"))).alias("folder_norm"))
        .filter(F.col("folder_norm") != F.col("norm"))
        .join(known, "folder_norm")
        .groupBy("path")
        .agg(F.max_by("folder_id", F.struct("added_at", "folder_id")).alias("folder_id"))
    )
    below = (
        known.select("folder_id", "folder_norm", F.explode(ancestors(F.col("folder_norm"))).alias("norm"))
        .filter(F.col("folder_norm") != F.col("norm"))
        .join(cand, "norm")
        .select("path", "folder_id")
    )
    in_trash = F.array_contains(F.split(F.lower("norm"), "/"), trash_dir.lower())
    tagged = (
        cand.join(same.withColumnRenamed("folder_id", "__same"), "path", "left")
        .join(above.withColumnRenamed("folder_id", "__above"), "path", "left")
        .join(below.select("path").distinct().withColumn("__below", F.lit(True)), "path", "left")
        .select(
            "path",
            F.when(F.col("__same").isNotNull(), "same")
            .when(in_trash, "trash")
            .when(F.col("__above").isNotNull(), "child")
            .when(F.col("__below"), "parent")
            .otherwise("new")
            .alias("verdict"),
            "__same",
            "__above",
        )
    )
    single = tagged.filter(F.col("verdict") != "parent").select(
        "path", "verdict",
        F.when(F.col("verdict") == "same", F.col("__same")).when(F.col("verdict") == "child", F.col("__above")).alias("folder_id"),
    )
    children = tagged.filter(F.col("verdict") == "parent").select("path", "verdict").join(below, "path")
    return single.unionByName(children)
