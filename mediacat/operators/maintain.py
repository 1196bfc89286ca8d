"""Trash, restore, purge, folder removal and edits as change sets over immutable tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediacat.functions.geo import valid_coordinates
from mediacat.functions.paths import split_extension
from mediacat.operators.filters import trashed
from mediacat.operators.groups import affected_groups, group_sizes
from mediacat.operators.keeper import repick_keeper
from mediacat.runtime import (
    join_lookup,
    materialize,
    one_per_key,
    row_hot_keys,
    with_group_position,
    with_position,
    with_running_sum,
)
from mediacat.schema import Catalog, instant


def _update(media: DataFrame, changes: DataFrame, hit: Column, values: dict[str, Column]) -> DataFrame:
    """Left-join one change row per id and set columns where ``hit`` holds."""
    joined = media.join(changes.withColumn("__hit", F.lit(True)), "id", "left")
    do = F.coalesce(F.col("__hit") & hit, F.lit(False))
    new = {c: F.when(do, v).otherwise(F.col(c)) for c, v in values.items()}
    return joined.withColumns(new).select(*media.columns)


def _is_active() -> Column:
    return F.col("deleted_at").isNull()


def _edits(edits: DataFrame, order: str | None, **names: str) -> DataFrame:
    """One row per id with columns renamed: the last by ``order``, the least row without."""
    own = [F.col(order).alias("__order")] if order else []
    picked = edits.select("id", *[F.col(c).alias(n) for n, c in names.items()], *own)
    return one_per_key(picked, order="__order" if order else None)


def trash_results(media: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, outcome) of each entry's id: ``moved``, ``already trashed`` or ``unknown``.

    To be asked before ``trash``, of the same media.
    """
    ids = entries.select("id").distinct()
    known = media.join(ids, "id", "left_semi").groupBy("id").agg(F.max(_is_active()).alias("__active"))
    outcome = F.when(F.col("__active").isNull(), "unknown").when(F.col("__active"), "moved").otherwise("already trashed")
    return ids.join(known, "id", "left").select("id", outcome.alias("outcome"))


def trash(media: DataFrame, entries: DataFrame, now, order: str | None = None) -> DataFrame:
    """Move active rows to the trash. ``entries`` is (id, trash_path); of rivals the last by ``order`` counts."""
    moves = _edits(entries, order, __to="trash_path")
    return _update(
        media, moves, _is_active(),
        {
            "original_path": F.col("path"),
            "trash_path": F.col("__to"),
            "path": F.col("__to"),
            "deleted_at": instant(now),
        },
    )


def restore(media: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(media, restored) for ``entries`` (id, restored_path); only trashed rows move."""
    moves = one_per_key(entries.select("id", F.col("restored_path").alias("__to")))
    done = (
        moves.join(trashed(media).select("id"), "id", "left_semi").withColumnRenamed("__to", "restored_path")
    )
    null = F.lit(None)
    updated = _update(
        media, moves, ~_is_active(),
        {
            "path": F.col("__to"),
            "original_path": null.cast("string"),
            "trash_path": null.cast("string"),
            "deleted_at": null.cast(media.schema["deleted_at"].dataType),
        },
    )
    return updated, done


def restore_paths(entries: DataFrame, taken: DataFrame) -> DataFrame:
    """(id, restored_path): a free path for each row that wants ``target``.

    The first takes the target if it is free, later ones ``name (1).ext``, ``name (2).ext``
    and so on, skipping names in ``taken`` (path) and names that another row wants. Rows
    that want one target line up by id. No number is enumerated: below the i-th used number u
    there are u - i free ones, so the k-th free number is k plus the count of used numbers with
    u - i < k, which a running sum over slots and used numbers in one order gives.
    """
    stem, ext = split_extension(F.col("target"))
    wanted = entries.select("target").distinct()
    occupied = taken.select("path").unionByName(wanted.select(F.col("target").alias("path"))).distinct()
    numbered = F.regexp_extract(split_extension(F.col("path"))[0], r"^(?s)(.*) \(([1-9][0-9]{0,8})\)$", 1)
    number = F.regexp_extract(split_extension(F.col("path"))[0], r" \(([1-9][0-9]{0,8})\)$", 1)
    used = (
        occupied.filter(number != "")
        .select(F.concat(numbered, split_extension(F.col("path"))[1]).alias("target"), number.try_cast("bigint").alias("n"))
        .join(wanted, "target", "left_semi")
    )
    # the place among the used numbers of all targets, and where those of each target begin
    ranked = with_position(used, [F.col("target").asc(), F.col("n").asc()], "__rank")
    begins = ranked.groupBy("target").agg(F.min("__rank").alias("__base"))
    target_taken = wanted.join(taken.select(F.col("path").alias("target")).distinct(), "target", "left_semi")

    lined_up = materialize(
        with_group_position(entries.select("id", "target"), ["target"], [F.col("id").asc()], "place"), "lined_up"
    )
    hot = row_hot_keys(lined_up, ["target"])
    shifts = target_taken.withColumn("__shift", F.lit(1))
    facts = materialize(shifts.join(begins, "target", "full_outer"), "facts")
    # slot 0 is the target itself; slot k > 0 is the k-th free number
    slots = join_lookup(lined_up, facts, ["target"], hot, "left").select(
        "id", "target", "__base", (F.col("place") + F.coalesce("__shift", F.lit(0))).alias("__key"),
        F.lit(0).alias("__used"), F.lit(None).cast("bigint").alias("n"),
    )
    fences = join_lookup(ranked, begins, ["target"], row_hot_keys(ranked, ["target"])).select(
        F.lit(None).cast(entries.schema["id"].dataType).alias("id"), "target", "__base",
        (F.col("n") - (F.col("__rank") - F.col("__base") + 1)).alias("__key"), F.lit(1).alias("__used"), "n",
    )
    # a slot comes before the used numbers of its own key: those lie above it
    line = [F.col(c).asc() for c in ("target", "__key", "__used", "n")]
    passed = with_running_sum(slots.unionByName(fences), line, "__used", "__passed").filter("__used = 0")
    n = F.col("__key") + F.coalesce(F.col("__passed") - F.col("__base"), F.lit(0))
    return passed.select(
        "id",
        F.when(F.col("__key") == 0, F.col("target"))
        .otherwise(F.concat(stem, F.lit(" ("), n.cast("string"), F.lit(")"), ext))
        .alias("restored_path"),
    )


def prune_groups(
    groups: DataFrame, members: DataFrame, threshold: int = 1, only: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, members, kept ids): drop groups with at most ``threshold`` members.

    ``only`` limits the check to some group ids; kept ids are those that were checked and
    stay.
    """
    checked = groups.select("group_id") if only is None else only.select("group_id").distinct()
    theirs = members if only is None else members.join(checked, "group_id", "left_semi")
    sized = checked.join(group_sizes(theirs), "group_id", "left")
    small = F.coalesce(F.col("count"), F.lit(0)) <= threshold
    doomed = sized.filter(small).select("group_id")
    kept = sized.filter(~small).select("group_id")
    return (
        groups.join(doomed, "group_id", "left_anti"),
        members.join(doomed, "group_id", "left_anti"),
        kept,
    )


def purge(
    catalog: Catalog, ids: DataFrame, only_trashed: bool = False, threshold: int = 1
) -> tuple[Catalog, DataFrame]:
    """(catalog, surviving group ids): delete rows for good.

    Vectors and memberships go with the rows; touched groups left with at most
    ``threshold`` members vanish, the others get their keeper picked anew. With
    ``only_trashed`` rows restored meanwhile are not touched at all.
    """
    media, groups, members, embeddings, folders = catalog
    ids = ids.select(F.col(ids.columns[0]).alias("id")).distinct()
    if only_trashed:
        ids = ids.join(trashed(media).select("id"), "id", "left_semi")
    photo = ids.withColumnRenamed("id", "photo_id")
    touched = affected_groups(members, ids)
    left_media = media.join(ids, "id", "left_anti")
    left_members = members.join(photo, "photo_id", "left_anti").select(*members.columns)
    left_groups, left_members, survivors = prune_groups(groups, left_members, threshold, touched)

    lost = photo.select(F.col("photo_id").alias("keeper_id")).withColumn("__lost", F.lit(True))
    best = repick_keeper(left_members.join(survivors, "group_id", "left_semi"), left_media)
    rekept = (
        left_groups.join(lost, "keeper_id", "left")
        .join(best.withColumnRenamed("keeper_id", "__best"), "group_id", "left")
        .withColumn("keeper_id", F.coalesce("__best", F.when(F.col("__lost").isNull(), F.col("keeper_id"))))
        .select(*groups.columns)
    )
    left_vectors = embeddings.join(photo, "photo_id", "left_anti").select(*embeddings.columns)
    return Catalog(left_media, rekept, left_members, left_vectors, folders), survivors


def _folder_rows(media: DataFrame, folder_ids) -> DataFrame:
    if isinstance(folder_ids, DataFrame):
        wanted = folder_ids.select(F.col(folder_ids.columns[0]).alias("folder_id")).distinct()
        return media.join(wanted, "folder_id", "left_semi").select("id")
    values = folder_ids if isinstance(folder_ids, (list, tuple)) else [folder_ids]
    return media.filter(F.col("folder_id").isin(*values)).select("id")


def delete_folder_media(catalog: Catalog, folder_ids) -> Catalog:
    """Empty folders, trashed rows included; touched groups of one stay, empty ones go."""
    return purge(catalog, _folder_rows(catalog.media, folder_ids), threshold=0)[0]


def remove_folder(catalog: Catalog, folder_ids) -> Catalog:
    """Remove folders with all their rows; touched groups of at most one go."""
    left, _ = purge(catalog, _folder_rows(catalog.media, folder_ids), threshold=1)
    gone = folder_ids if isinstance(folder_ids, (list, tuple)) else [folder_ids]
    return left._replace(folders=left.folders.filter(~F.col("id").isin(*gone)))


def replace_with_parent(catalog: Catalog, child_ids: list, parent_id, parent_path: str, now) -> Catalog:
    """Swap some folders for one parent folder; its files come with the next scan."""
    left = remove_folder(delete_folder_media(catalog, child_ids), child_ids)
    row = left.folders.sparkSession.range(1).select(
        F.lit(parent_id).cast(left.folders.schema["id"].dataType).alias("id"),
        F.lit(parent_path).alias("path"),
        instant(now).alias("added_at"),
    )
    return left._replace(folders=left.folders.unionByName(row, allowMissingColumns=True))


def empty_trash(catalog: Catalog) -> tuple[Catalog, DataFrame]:
    return purge(catalog, trashed(catalog.media).select("id"), only_trashed=True)


def update_location(media: DataFrame, edits: DataFrame, now, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(media, one row ``updated``): set coordinates of active rows; invalid ones are skipped.

    Of several edits of an id the last by ``order`` wins.
    """
    valid = edits.filter(valid_coordinates(F.col("latitude"), F.col("longitude")))
    good = _edits(valid, order, __lat="latitude", __lon="longitude")
    updated = _update(
        media, good, _is_active(),
        {"latitude": F.col("__lat"), "longitude": F.col("__lon"), "updated_at": instant(now)},
    )
    count = good.join(media.filter(_is_active()), "id", "left_semi").agg(F.count("*").alias("updated"))
    return updated, count


def update_date(media: DataFrame, edits: DataFrame, now, order: str | None = None) -> DataFrame:
    """Set taken_at of active rows. ``edits`` is (id, taken_at); of rivals the last by ``order`` wins."""
    new = _edits(edits, order, __taken="taken_at")
    return _update(media, new, _is_active(), {"taken_at": F.col("__taken"), "updated_at": instant(now)})


def drop_vectors(embeddings: DataFrame, ids: DataFrame) -> DataFrame:
    return embeddings.join(ids.select(F.col(ids.columns[0]).alias("photo_id")), "photo_id", "left_anti").select(
        *embeddings.columns
    )
