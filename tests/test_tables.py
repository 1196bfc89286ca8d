"""Purge, trash, ingest, paging and storage."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from mediacat.functions.geo import grid_precision
from mediacat.operators import audit, browse, exact, ingest, maintain, mapview
from mediacat.operators.filters import MediaFilter
from mediacat.plans import jobs
from mediacat.runtime import with_group_position, with_position
from mediacat.schema import Catalog
from mediacat.sources import tables
from tests.helpers import media, rows_of, table

GROUPS = "group_id string, reason string, keeper_id string"
MEMBERS = "group_id string, photo_id string"
VECTORS = "photo_id string, embedding array<float>, model string, created_at timestamp_ntz, updated_at timestamp_ntz"
FOLDERS = "id string, path string, added_at timestamp_ntz"
DAY = dt.datetime(2024, 1, 1)


def catalog(spark, ids, members, keeper):
    heads = table(spark, GROUPS, ("g", "exact", keeper))
    rows = table(spark, MEMBERS, *[("g", m) for m in members])
    vectors = table(spark, VECTORS, *[(i, [1.0], "m", DAY, DAY) for i in ids])
    folders = table(spark, FOLDERS, ("f1", "/lib", DAY))
    return Catalog(media(spark, *[{"id": i} for i in ids]), heads, rows, vectors, folders)


def ids(spark, *values):
    return table(spark, "id string", *[(v,) for v in values])


def test_purge_down_to_one_member(spark):
    left, kept = maintain.purge(catalog(spark, ["p1", "p2"], ["p1", "p2"], "p1"), ids(spark, "p2"))
    assert rows_of(left.media, "id") == [("p1",)] and left.groups.count() == 0 and left.members.count() == 0
    assert kept.count() == 0 and rows_of(left.embeddings, "photo_id") == [("p1",)]


def test_purge_of_the_keeper(spark):
    left, _ = maintain.purge(catalog(spark, ["p1", "p2"], ["p1", "p2"], "p1"), ids(spark, "p1"))
    assert rows_of(left.media, "id") == [("p2",)] and audit.audit(left).count() == 0


def test_purge_with_a_surviving_group(spark):
    left, kept = maintain.purge(catalog(spark, ["p1", "p2", "p3"], ["p1", "p2", "p3"], "p3"), ids(spark, "p3"))
    assert rows_of(kept) == [("g",)] and rows_of(left.groups, "keeper_id") == [("p1",)]
    assert audit.audit(left).count() == 0


def test_purge_keeps_restored_rows(spark):
    left, _ = maintain.purge(catalog(spark, ["p1", "p2"], ["p1", "p2"], "p1"), ids(spark, "p1"), only_trashed=True)
    assert left.media.count() == 2 and rows_of(left.groups, "keeper_id") == [("p1",)]


def test_remove_folder(spark):
    left = maintain.remove_folder(catalog(spark, ["p1", "p2"], ["p1", "p2"], "p1"), "f1")
    assert [df.count() for df in left] == [0, 0, 0, 0, 0]


def test_trash_then_restore_is_identity(spark):
    rows = media(spark, {"id": "a"}, {"id": "b"})
    gone = maintain.trash(rows, table(spark, "id string, trash_path string", ("a", "/t/a.jpg")), "2024-05-05 00:00:00")
    assert rows_of(gone.filter("deleted_at is not null"), "id", "path", "original_path") == [("a", "/t/a.jpg", "/lib/a.jpg")]
    back, done = maintain.restore(gone, table(spark, "id string, restored_path string", ("a", "/lib/a.jpg"), ("b", "/no")))
    assert rows_of(done) == [("a", "/lib/a.jpg")]
    assert back.exceptAll(rows).count() == 0 and rows.exceptAll(back).count() == 0


def greedy_paths(entries, taken):
    """One row after another; names others want count as occupied once spilled into."""
    wanted = {t for _, t in entries}
    used, out, first = set(taken), {}, set()
    for i, target in sorted(entries):
        if target not in taken and target not in first:
            first.add(target)
            out[i] = target
            continue
        dot = target.rfind(".")
        stem, ext = (target[:dot], target[dot:]) if dot > target.rfind("/") + 1 else (target, "")
        n = 1
        while f"{stem} ({n}){ext}" in used or f"{stem} ({n}){ext}" in wanted:
            n += 1
        out[i] = f"{stem} ({n}){ext}"
        used.add(out[i])
    return out


def test_restore_paths(spark):
    entries = [(i, "/a/x.jpg") for i in range(7)] + [(20, "/a/x (2).jpg"), (21, "/a/x (2).jpg"), (22, "/b/.hidden"), (23, "/b/.hidden")]
    taken = ["/a/x.jpg", "/a/x (1).jpg", "/a/x (4).jpg", "/a/x (05).jpg"]
    got = maintain.restore_paths(
        table(spark, "id bigint, target string", *entries), table(spark, "path string", *[(t,) for t in taken])
    )
    assert dict(rows_of(got)) == greedy_paths(entries, taken)


def test_restore_of_many_rows_to_one_target(spark):
    entries = spark.range(12_345).select("id", F.lit("/a/x.jpg").alias("target"))
    got = maintain.restore_paths(entries, table(spark, "path string", ("/a/x (10000).jpg",)))
    assert got.select("restored_path").distinct().count() == 12_345
    assert got.filter("restored_path = '/a/x (10000).jpg'").count() == 0
    assert got.filter("restored_path = '/a/x (12345).jpg'").count() == 1


def test_restore_numbers_are_not_enumerated(spark):
    """A used number far away costs nothing, and one target's rows stay in many tasks."""
    entries = spark.range(300_000).select("id", F.lit("/a/x.jpg").alias("target"))
    taken = spark.range(0, 300_000, 3).select(F.concat(F.lit("/a/x ("), F.col("id") + 1, F.lit(").jpg")).alias("path"))
    taken = taken.unionByName(table(spark, "path string", ("/a/x (999999999).jpg",)))
    got = maintain.restore_paths(entries, taken).withColumn("n", F.regexp_extract("restored_path", r"\((\d+)\)", 1).try_cast("int"))
    # free numbers are 2, 3, 5, 6, ... below 300,001 and all from there on
    want = F.when(F.col("id") == 0, None).when(
        F.col("id") <= 200_000, F.col("id") + F.ceil(F.col("id") / 2)
    ).otherwise(F.col("id") + 100_000).cast("int")
    assert got.filter(~F.col("n").eqNullSafe(want)).count() == 0 and got.count() == 300_000
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 3 and max(sizes) < 150_000


def test_a_chain_of_rivals_without_order_needs_few_rounds(spark, monkeypatch):
    rounds = []
    kept = ingest.materialize
    monkeypatch.setattr(ingest, "materialize", lambda df, name: rounds.append(name) or kept(df, name))
    chain = spark.range(1_000).selectExpr("cast((id + 1) div 2 as string) as id", "concat('/', id div 2) as path")
    got = rows_of(ingest.insert_ignore(media(spark), chain), "id", "path")
    assert rounds.count("settled") < 15
    ids, paths = {i for i, _ in got}, {p for _, p in got}
    assert len(ids) == len(paths) == len(got)
    for i, p in rows_of(chain, "id", "path"):
        assert i in ids or p in paths
    assert got == rows_of(ingest.insert_ignore(media(spark), chain.repartition(3)), "id", "path")


def test_pruning_some_groups_leaves_the_others(spark):
    groups = table(spark, "group_id string, reason string, keeper_id string", ("a", "exact", "1"), ("b", "exact", "3"), ("c", "exact", "4"))
    members = table(spark, "group_id string, photo_id string", ("a", "1"), ("a", "2"), ("b", "3"), ("c", "4"))
    only = table(spark, "group_id string", ("a",), ("c",), ("gone",))
    left, rows, kept = maintain.prune_groups(groups, members, 1, only)
    assert rows_of(left, "group_id") == [("a",), ("b",)] and rows_of(kept) == [("a",)]
    assert rows_of(rows) == [("a", "1"), ("a", "2"), ("b", "3")]


def test_insert_ignore_only_loses_to_inserted_rows(spark):
    base = media(spark, {"id": "x", "path": "/x"})
    batch = table(
        spark, "id string, path string, n bigint",
        ("a", "/1", 1), ("b", "/1", 2), ("b", "/2", 3), ("c", "/2", 4), ("c", "/3", 5), ("x", "/9", 6), ("y", "/x", 7),
    )
    got = ingest.insert_ignore(base, batch, "n")
    assert rows_of(got, "id", "path") == [("a", "/1"), ("b", "/2"), ("c", "/3"), ("x", "/x")]


def test_scan_applied_twice_is_a_no_op(spark):
    start = catalog(spark, ["p1", "p2", "p3"], ["p1", "p2"], "p1")
    listing = table(
        spark, "path string, length bigint, mtime timestamp_ntz",
        ("/lib/p1.jpg", 1000, DAY), ("/lib/p2.jpg", 1001, DAY), ("/lib/new.mp4", 7, DAY),
    )
    extract = lambda files: files.select("path", F.md5("path").alias("file_hash"))
    after, diff = jobs.scan_folder(start, "f1", listing, extract, "s1")
    assert rows_of(diff, "path", "status") == [
        ("/lib/new.mp4", "new"), ("/lib/p1.jpg", "unchanged"), ("/lib/p2.jpg", "changed"), ("/lib/p3.jpg", "deleted"),
    ]
    assert after.media.count() == 3 and after.groups.count() == 0 and audit.audit(after).count() == 0
    assert rows_of(after.media.filter("id = 'p2'"), "file_size", "file_hash") != []
    again, diff2 = jobs.scan_folder(after, "f1", listing, extract, "s2")
    assert {r["status"] for r in diff2.collect()} == {"unchanged"}
    assert rows_of(again.media, "id") == rows_of(after.media, "id")


def test_empty_listing_deletes_everything(spark):
    empty = table(spark, "path string, length bigint, mtime timestamp_ntz")
    diff = ingest.diff_listing(empty, media(spark, {"id": "a"}, {"id": "b"}))
    assert {r["status"] for r in diff.collect()} == {"deleted"}


def test_snapshots_can_become_empty(spark, tmp_path):
    base = str(tmp_path / "groups")
    rows = media(spark, {"id": "a", "file_hash": "h"}, {"id": "b", "file_hash": "h"})
    jobs.rebuild_exact(rows, base)
    heads, members = tables.read_groups(spark, base)
    assert rows_of(members) == [("exact:a", "a"), ("exact:a", "b")] and rows_of(heads, "reason") == [("exact",)]
    jobs.rebuild_exact(rows.filter("id = 'a'"), base)
    heads, members = tables.read_groups(spark, base)
    assert heads.count() == 0 and members.count() == 0
    jobs.rebuild_exact(rows, base)
    tables.clear_stored_groups(spark, base, "exact")
    assert tables.read_groups(spark, base)[0].count() == 0


def test_half_written_snapshot_is_invisible(spark, tmp_path):
    base = str(tmp_path / "t")
    spark.range(3).write.parquet(f"{base}/v00000001")
    spark.range(9).write.parquet(f"{base}/v00000002")
    (tmp_path / "t" / "v00000002" / "_SUCCESS").unlink()
    assert tables.read_snapshot(spark, base, "id bigint").count() == 3


def test_media_layout(spark, tmp_path):
    path = str(tmp_path / "media")
    tables.write_media(media(spark, {"id": "a"}, {"id": "b", "modified_time": None}), path)
    back = tables.read_media(spark, path)
    assert rows_of(back, "id", "ingest_month") == [("a", "2024-01"), ("b", "unknown")]


def test_positions(spark):
    values = list(range(5000))
    random.Random(1).shuffle(values)
    rows = table(spark, "id bigint, g string", *[(v, "hot" if v % 3 else f"g{v % 30}") for v in values]).repartition(7)
    ranked = with_position(rows, [F.col("id").desc()])
    assert all(r["position"] == 4999 - r["id"] for r in ranked.collect())
    by_group = {}
    for r in with_group_position(rows, ["g"], [F.col("id").asc()]).collect():
        by_group.setdefault(r["g"], []).append((r["position"], r["id"]))
    for found in by_group.values():
        found.sort()
        assert [p for p, _ in found] == list(range(len(found))) and [i for _, i in found] == sorted(i for _, i in found)


def test_deep_page_equals_shallow_cut(spark, monkeypatch):
    rows = media(spark, *[{"id": f"{i:03d}", "taken_at": None if i % 4 == 0 else dt.datetime(2024, 1, 1 + i % 5)} for i in range(200)])
    f = MediaFilter(limit=30, offset=120)
    shallow = [r["id"] for r in browse.browse(rows, f).collect()]
    monkeypatch.setattr("mediacat.runtime.DEEP_PAGE", 10)
    assert [r["id"] for r in browse.browse(rows, f).collect()] == shallow and len(shallow) == 30


def test_timestamps_with_zone_are_read_as_utc(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        rows = media(spark, {"id": "a"}).withColumn("taken_at", F.timestamp_seconds(F.lit(1_709_251_200)))  # 2024-03-01 UTC
        assert rows_of(browse.timeline(rows), "key", "count") == [("2024-03", 1)]
        assert browse.month_offset(rows, "2024-02").first()["offset"] is None
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_plans_have_no_cartesian_product(spark, capsys):
    rows = media(spark, {"id": "a", "file_hash": "h"}, {"id": "b", "file_hash": "h"})
    folders = table(spark, FOLDERS, ("f1", "/lib", DAY))
    for df in (exact.exact_groups(rows), ingest.folder_overlap(folders, table(spark, "path string", ("/lib/x",)))):
        df.explain()
    text = capsys.readouterr().out
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filter_reaches_the_scan(spark, tmp_path, capsys):
    path = str(tmp_path / "m")
    media(spark, {"id": "a"}).write.parquet(path)
    f = MediaFilter(date_start="2024-01-01", camera="X", has_location=True)
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    browse.timeline(spark.read.parquet(path), f).explain()
    text = capsys.readouterr().out
    for part in ("GreaterThanOrEqual(taken_at", "EqualTo(camera,X)", "IsNotNull(latitude)", "IsNull(deleted_at)"):
        assert part in text
    assert "ReadSchema: struct<taken_at:timestamp_ntz,latitude:double,longitude:double,camera:string,deleted_at:timestamp_ntz>" in text


@pytest.mark.parametrize("bad", [(91.0, 0.0), (0.0, 181.0), (float("nan"), 0.0)])
def test_invalid_coordinates_are_skipped(spark, bad):
    rows = media(spark, {"id": "a"})
    _, n = maintain.update_location(rows, table(spark, "id string, latitude double, longitude double", ("a", *bad)), "2024-01-01")
    assert n.first()["updated"] == 0


def test_the_last_edit_wins(spark):
    rows = media(spark, {"id": "a"}, {"id": "b"}, {"id": "c", "deleted_at": dt.datetime(2024, 1, 1)})
    for turns in ((1, 2), (2, 1)):
        edits = table(spark, "id string, latitude double, longitude double, turn int", ("a", 50.0, 1.0, turns[0]), ("a", 10.0, 2.0, turns[1]))
        out, count = maintain.update_location(rows, edits, "2026-01-01", order="turn")
        assert rows_of(out.filter("id = 'a'"), "latitude") == [(10.0 if turns == (1, 2) else 50.0,)] and rows_of(count) == [(1,)]
    hashes = table(spark, "id string, file_hash string, turn int", ("a", "new", 1), ("a", None, 2), ("b", None, 1), ("c", "x", 1))
    old = dict(rows_of(rows, "id", "file_hash"))
    for order in ("turn", None):
        got = dict(rows_of(ingest.hash_backfill(rows, hashes, "file_hash", order=order), "id", "file_hash"))
        assert got == old | {"a": "new"}


def test_trash_results(spark):
    rows = media(spark, {"id": "a"}, {"id": "b", "deleted_at": dt.datetime(2024, 1, 1)})
    entries = table(spark, "id string, trash_path string", ("a", "/t/a"), ("a", "/t/a2"), ("b", "/t/b"), ("x", "/t/x"))
    assert rows_of(maintain.trash_results(rows, entries)) == [("a", "moved"), ("b", "already trashed"), ("x", "unknown")]


def test_every_zoom_out_of_one_pyramid(spark):
    """Points on and beside the edges of cells, of either sign, and at the ends of the world."""
    rng = random.Random(6)
    points = [(0.0, 0.0), (-0.0, 0.0), (90.0, 180.0), (-90.0, -180.0)]
    for zoom in range(0, mapview.NESTED_ZOOM + 1):
        p = grid_precision(zoom)
        for _ in range(12):
            lat, lon = ((rng.randint(-2, 2) + 0.5 * rng.randint(0, 1)) * p for _ in range(2))
            points.append((max(-90.0, min(90.0, lat + rng.choice([0, 0, 1e-12]))), max(-180.0, min(180.0, lon - rng.choice([0, 0, 1e-12])))))
    points += [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(100)]
    rows = [{"id": f"{i:04}", "latitude": a, "longitude": b} for i, (a, b) in enumerate(points)] + [{"id": "x"}, {"id": "y", "latitude": 1.0}]
    files = media(spark, *rows).coalesce(2)
    pyramid = spark.createDataFrame(mapview.map_pyramid(files).collect(), mapview.map_pyramid(files).schema)
    for zoom in range(0, mapview.NESTED_ZOOM + 1, 3):
        direct = mapview.map_clusters(files, -90, -180, 90, 180, zoom)
        assert rows_of(mapview.pyramid_clusters(pyramid, zoom)) == rows_of(direct)
    with pytest.raises(ValueError):
        mapview.pyramid_clusters(pyramid, mapview.NESTED_ZOOM + 1)
