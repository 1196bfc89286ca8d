"""Listings, images, thumbnails, vectors and streams."""

import datetime as dt
import hashlib
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediacat.functions import fingerprints, hashing, paths
from mediacat.operators import search
from mediacat.plans import fixtures
from mediacat.plans import jobs as jobs_plan
from mediacat.sources import images, listing, thumbnails
from mediacat.streaming import jobs
from tests.helpers import decode_png, media, png, rows_of, table


@pytest.fixture(scope="module")
def library(tmp_path_factory):
    root = tmp_path_factory.mktemp("lib")
    slope = lambda x, y: (3 * x % 256, 2 * y, x * y % 256)
    (root / "a.png").write_bytes(png(60, 48, slope))
    (root / "b.PNG").write_bytes(png(120, 96, lambda x, y: slope(x // 2, y // 2)))
    (root / "flat.png").write_bytes(png(40, 40, lambda x, y: (9, 9, 9)))
    (root / "broken.jpg").write_bytes(b"not an image")
    (root / "clip.MOV").write_bytes(bytes(range(256)) * 40)
    (root / "notes.txt").write_text("x")
    for name in (".hidden", "@eaDir", "$RECYCLE.BIN", "sub"):
        (root / name).mkdir()
        (root / name / "in.jpg").write_bytes(b"1")
    return root


def test_listing(spark, library):
    found = {r["path"].removeprefix(str(library) + "/") for r in listing.list_media(spark, str(library)).collect()}
    assert found == {"a.png", "b.PNG", "flat.png", "broken.jpg", "clip.MOV", "sub/in.jpg"}


def test_listing_sees_hidden_files_and_follows_no_links(spark, library, tmp_path):
    for name in (".dot.jpg", "_under.jpg", "_sub/x.JPG", "%41 b+.png", "only.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    (tmp_path / "up").symlink_to(tmp_path, target_is_directory=True)
    (tmp_path / "link.jpg").symlink_to(library / "a.png")
    got = listing.list_media(spark, f"file://{tmp_path}/")
    assert rows_of(got, "path", "length") == [
        (f"{tmp_path}/{n}", 5) for n in ("%41 b+.png", ".dot.jpg", "_sub/x.JPG", "_under.jpg")
    ]
    seen = {r["path"]: r["mtime"] for r in got.collect()}
    for path, mtime in seen.items():
        real = dt.datetime.fromtimestamp(Path(path).stat().st_mtime, dt.timezone.utc).replace(tzinfo=None)
        assert dt.timedelta(0) <= real - mtime < dt.timedelta(milliseconds=1)
    assert rows_of(listing.list_media(spark, [str(library / "a.png")]), "path") == [(str(library / "a.png"),)]


def test_a_root_that_cannot_be_listed_is_not_an_empty_one(spark, library, tmp_path):
    missing = str(tmp_path / "gone")
    with pytest.raises(FileNotFoundError, match="gone"):
        listing.list_media(spark, [str(library), missing])
    kinds = listing.list_folders(spark, [str(library), missing]).filter("kind <> 'file'")
    assert rows_of(kinds, "path", "kind") == sorted(
        [(missing, "unreadable"), (str(library), "folder"), (f"{library}/sub", "folder")]
    )
    (tmp_path / "empty").mkdir()
    assert listing.list_media(spark, str(tmp_path / "empty")).count() == 0


def test_listing_of_many_folders_in_rounds(spark, tmp_path, monkeypatch):
    want = []
    for i in range(10_000):
        folder = tmp_path / f"y{i % 10}" / f"m{i % 100}" / f"d{i}"
        folder.mkdir(parents=True)
        (folder / "p.jpg").write_bytes(b"x" * (i % 7))
        want.append((str(folder / "p.jpg"), i % 7))
    rounds = []
    kept = listing.materialize
    monkeypatch.setattr(listing, "materialize", lambda df, name: rounds.append(name) or kept(df, name))
    got = listing.list_folders(spark, [str(tmp_path)], folders_per_task=20)
    assert rows_of(got.filter("kind = 'file'"), "path", "length") == sorted(want)
    assert got.filter("kind = 'folder'").count() == 10_000 + 100 + 10 + 1
    assert 2 < len(rounds) < 60


def test_only_files_without_fingerprint_are_opened(spark, library, tmp_path):
    names = ["a.png", "b.PNG", "flat.png", "broken.jpg", "gone.png", "trash.png"]
    rows = media(
        spark,
        *[{"id": n, "path": str(library / n), "file_size": 3 << 20 if n == "flat.png" else 10} for n in names[:5]],
        {"id": "trash.png", "path": str(library / "a.png"), "deleted_at": dt.datetime(2024, 1, 1)},
        {"id": "known", "path": str(library / "b.PNG"), "perceptual_hash": "1" * 64},
        {"id": "unsized", "path": str(library / "a.png") + "/../a.png", "file_size": None},
    )
    opened = str(tmp_path)

    def decode(content):
        (Path(opened) / hashlib.md5(content).hexdigest()).write_bytes(b"")
        return decode_png(content)

    some = rows.filter("id not in ('b.PNG', 'unsized')")
    got = dict(rows_of(images.phash_missing_files(some, decode, task_bytes=2 << 20), "path", "perceptual_hash"))
    seen = {hashlib.md5((library / n).read_bytes()).hexdigest() for n in ("a.png", "flat.png", "broken.jpg")}
    assert {p.name for p in tmp_path.iterdir()} == seen
    assert {Path(p).name for p in got} == {"a.png", "flat.png", "broken.jpg"}
    whole = dict(rows_of(images.phash_files(spark, str(library)), "path", "perceptual_hash"))
    assert all(whole[p] == h for p, h in got.items())
    tasks = dict(rows_of(images.phash_tasks(rows, 2 << 20), "id", "task"))
    assert tasks == {"a.png": 0, "b.PNG": 0, "broken.jpg": 1, "flat.png": 1, "gone.png": 3, "unsized": 4}
    assert images.phash_missing_files(rows.filter("id = 'known'"), decode).count() == 0


def test_listing_below_a_hidden_root(spark):
    rows = table(spark, "path string", ("/x/.lib/a.jpg",), ("/x/.lib/.b/a.jpg",), ("/x/.lib/c/_a.JPG",))
    assert rows_of(listing.media_files(rows, ["/x/.lib/"])) == [("/x/.lib/a.jpg",), ("/x/.lib/c/_a.JPG",)]


def test_phash_of_files(spark, library):
    got = {r["path"].rsplit("/", 1)[-1]: r["perceptual_hash"] for r in images.phash_files(spark, str(library)).collect()}
    assert len(got["a.png"]) == 64 and "1" in got["a.png"]
    assert got["broken.jpg"] == "0" * 64
    near = sum(x != y for x, y in zip(got["a.png"], got["b.PNG"]))
    assert near < 10


def test_dct_core_against_the_definition():
    rng = np.random.default_rng(1)
    grid = rng.integers(0, 256, (32, 32)).astype(float)
    got = fingerprints.low_frequencies(grid[None])[0]
    y, x = np.mgrid[0:32, 0:32]
    for v in range(8):
        for u in range(8):
            want = (grid * np.cos(np.pi * (2 * x + 1) * u / 64) * np.cos(np.pi * (2 * y + 1) * v / 64)).sum()
            assert abs(got[v * 8 + u] - want) < 1e-6


@pytest.mark.parametrize("chunk", [100, 3000, 20_000])
def test_sampled_hash_by_ranges_equals_the_column_form(spark, library, chunk):
    files = listing.list_media(spark, str(library))
    by_range = rows_of(listing.sampled_hash_files(files, chunk), "path", "sampled_hash")
    whole = listing.read_content(spark, str(library)).join(files.select("path"), "path", "left_semi")
    assert by_range == rows_of(whole.select("path", hashing.sampled_hash(F.col("content"), chunk)))


def test_only_candidate_videos_are_read_and_split(spark, tmp_path):
    names = {"a": b"x" * 9000, "b": b"x" * 9000, "c": b"x" * 4000 + b"y" + b"x" * 4999, "d": b"other"}
    rows = []
    for i, content in names.items():
        (tmp_path / f"{i}.mp4").write_bytes(content)
        rows.append({"id": i, "path": str(tmp_path / f"{i}.mp4"), "media_type": "video", "file_hash": None,
                     "frame_hash": "f", "file_size": len(content)})
    videos = media(spark, *rows)
    sampled = jobs_plan.hash_video_candidates(videos, chunk=2000)
    assert rows_of(sampled, "photo_id") == [("a",), ("b",), ("c",)]
    members, groups = jobs_plan.exact_report(videos, sampled)
    assert rows_of(members, "photo_id") == [("a",), ("b",)] and groups.count() == 1


def test_content_hash(spark):
    rows = table(spark, "content binary", (b"abc",), (b"abc",), (b"abd",))
    got = [r[0] for r in rows.select(hashing.content_hash(F.col("content"))).collect()]
    assert got[0] == got[1] == hashlib.sha256(b"abc").hexdigest() != got[2]
    fast = [r[0] for r in rows.select(hashing.content_hash(F.col("content"), "xxhash64")).collect()]
    assert fast[0] == fast[1] != fast[2] and len(fast[0]) == 16


def test_basename_and_type(spark):
    rows = table(spark, "p string", ("/a/b.JPG",), (r"c:\x\y.3gp",), ("z.mp4.png",))
    got = rows.select(paths.basename(F.col("p")), paths.media_type(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("b.JPG", "image"), ("y.3gp", "video"), ("z.mp4.png", "image")]


def test_thumbnails(spark):
    files = table(
        spark, "path string, length bigint, mtime timestamp_ntz",
        *[(p, n, None) for p, n in (("im/img-001-abc_small.webp", 10), ("im/img-001-abc_medium.webp", 20), ("img-002.webp", 5), ("x.txt", 1))],
    )
    assert rows_of(thumbnails.thumb_stats(files)) == [(3, 35, 1, 1)]
    assert rows_of(thumbnails.thumb_orphans(files, media(spark, {"id": "img-001-abc"})), "photo_id") == [("img-002",)]


def brute_search(plans, vectors, limit):
    out = []
    for q in sorted({p[0] for p in plans}):
        scored = []
        for i, v in vectors:
            sims = [(sum(a * b for a, b in zip(p, v)), t) for qq, p, t in plans if qq == q]
            if any(s >= t for s, t in sims):
                scored.append((-max(s for s, _ in sims), i))
        out += [(q, rank + 1, i) for rank, (_, i) in enumerate(sorted(scored)[:limit])]
    return out


@pytest.mark.parametrize("per_pass", [2048, 3, 1])
def test_search_equals_brute_force(spark, monkeypatch, per_pass):
    """Ragged lengths, tied vectors, several plans per query, and more plans than one pass takes."""
    monkeypatch.setattr(search, "PLANS_PER_PASS", per_pass)
    rng = random.Random(8)
    vec = lambda n: [rng.randint(-4, 4) / 4 for _ in range(n)]
    vectors = [(i, vec(rng.choice([5, 6, 7]))) for i in range(150)]
    vectors += [(500 + i, vectors[i % 3][1]) for i in range(60)]
    plans = [(q, vec(6), rng.choice([0.5, 1.0])) for q in range(5) for _ in range(1 + q % 2)]
    got = search.search(
        table(spark, "query_id bigint, embedding array<double>, threshold double", *plans),
        table(spark, "photo_id bigint, embedding array<float>, model string", *[(i, v, "m") for i, v in vectors]).repartition(4),
        limit=10,
    )
    assert rows_of(got, "query_id", "rank", "photo_id") == brute_search(plans, vectors, 10)


@pytest.mark.parametrize("limit, remembered", [(None, 30), (7, 30), (7, 1 << 22)])
def test_tiles_of_many_blocks(spark, monkeypatch, limit, remembered):
    """Small blocks on both sides, dealt out instead of broadcast; vectors of very different norms."""
    for name, value in (("PLANS_PER_PASS", 4), ("BLOCK_BYTES", 512), ("BLOCKS_TOGETHER", 3), ("BROADCAST_BYTES", 100), ("STATE_SCORES", remembered)):
        monkeypatch.setattr(search, name, value)
    rng = np.random.default_rng(4)
    vectors = [(i, (rng.normal(size=8) * 10.0 ** rng.integers(-3, 2)).tolist()) for i in range(600)] + [(700, None), (701, [])]
    plans = [(q, rng.normal(size=8).tolist(), float(rng.choice([0.5, 5.0, 50.0, 1000.0]))) for q in range(30) for _ in range(1 + q % 3)]
    got = search.score_all(
        table(spark, "query_id bigint, embedding array<double>, threshold double", *plans),
        table(spark, "photo_id bigint, embedding array<double>", *vectors).repartition(3), limit,
    )
    want = brute_search(plans, [v for v in vectors if v[1]], limit or 10_000)
    assert rows_of(search.top_k(got, limit or 10_000), "query_id", "rank", "photo_id") == want
    hits = len(brute_search(plans, [v for v in vectors if v[1]], 10_000))
    left = got.count()
    assert left == hits if limit is None else left < hits if remembered == 30 else left < 0.7 * hits
    one, many = (
        search.score_all(table(spark, "query_id bigint, embedding array<double>, threshold double", *plans[:n]),
                         table(spark, "photo_id bigint, embedding array<double>", *vectors))._jdf.queryExecution().logical().toString().count("MapInArrow")
        for n in (1, len(plans))
    )
    assert one == many  # the plan does not grow with the queries


def test_search_refills_queries_whose_best_files_are_trashed(spark):
    """Query 0's best 40 hits are trashed, query 1's are not, query 2 has fewer hits than asked."""
    vectors = [(i, [1.0 - i / 1000, 0.0, 0.0]) for i in range(100)] + [(200 + i, [0.0, 1.0 - i / 1000, 0.0]) for i in range(100)]
    vectors += [(400, [0.0, 0.0, 1.0]), (401, [0.0, 0.0, 1.0])]
    rows = media(spark, *[{"id": f"{i}", "deleted_at": dt.datetime(2024, 1, 1) if i < 40 or i == 401 else None} for i, _ in vectors])
    plans = table(spark, "query_id bigint, embedding array<double>, threshold double",
                  (0, [1.0, 0.0, 0.0], 0.5), (1, [0.0, 1.0, 0.0], 0.5), (2, [0.0, 0.0, 1.0], 0.5))
    stored = table(spark, "photo_id string, embedding array<float>, model string", *[(f"{i}", v, "m") for i, v in vectors])
    got = rows_of(search.search(plans, stored, rows, limit=10), "query_id", "rank", "photo_id")
    assert got == [(0, k + 1, f"{40 + k}") for k in range(10)] + [(1, k + 1, f"{200 + k}") for k in range(10)] + [(2, 1, "400")]
    many = search.search(plans, stored, limit=700)
    assert many.count() == 202


def test_full_hashes_tell_apart_what_samples_do_not(spark, tmp_path):
    from mediacat.operators import exact
    from mediacat.plans import jobs

    body = bytearray(b"x" * 10_000_000)
    for name in ("a", "b", "c"):
        body[2_000_000] = ord("z") if name == "c" else ord("x")
        (tmp_path / f"{name}.mp4").write_bytes(body)
    rows = media(spark, *[
        {"id": n, "path": str(tmp_path / f"{n}.mp4"), "media_type": "video", "frame_hash": "f", "file_size": 10_000_000} for n in ("a", "b", "c")
    ])
    sampled = jobs.hash_video_candidates(rows)
    found = exact.exact_groups(rows)
    assert exact.verify_video_groups(found, sampled).count() == 3
    assert rows_of(exact.verify_video_groups(found, sampled, full=jobs.full_hashes(rows)), "photo_id") == [("a",), ("b",)]


def test_unreadable_files_hash_to_null(spark):
    files = table(spark, "path string, length bigint", ("/no/such/file", 5), ("odd://bucket/key", 5))
    assert rows_of(listing.full_hash_files(files), "path", "full_hash") == [("/no/such/file", None), ("odd://bucket/key", None)]


def test_scratch_scope_leaves_nothing_behind(spark):
    from mediacat.runtime import materialize, scratch_folder, scratch_scope

    folder = Path(scratch_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    for _ in range(20):
        with scratch_scope():
            assert materialize(spark.range(3), "kept").count() == 3
    assert set(folder.iterdir()) == before


def test_embedding_failures_are_not_retried(spark):
    rows = media(spark, *[{"id": f"{i}"} for i in range(10)])
    none = table(spark, "photo_id string, embedding array<float>, model string")

    def encoder(names):
        if any(n.endswith("3.jpg") for n in names):
            raise ValueError("bad file")
        return np.array([3.0, 4.0] * len(names))  # one flat array

    good, bad = search.embed_missing(rows, none, encoder, "m", "2024-01-01", batch_size=4)
    assert rows_of(bad) == [("3", "bad file")] and good.count() == 9
    assert all(np.allclose(r["embedding"], [0.6, 0.8]) for r in good.collect())
    left = search.without_embedding(rows, good, bad.select("photo_id"))
    assert left.count() == 0


def test_query_plans(spark):
    rows = table(
        spark, "query_id bigint, query string, translated string",
        (1, "  cat ", None), (2, "An image of a dog", None), (3, "海边", "seaside"), (4, "海边", None),
    )
    got = rows_of(search.plan_queries(rows), "query_id", "text", "threshold", "label")
    assert got == [
        (1, "a photo of cat", 0.28, "en"), (2, "An image of a dog", 0.28, "en"),
        (3, "a photo of seaside", 0.28, "translated-en"), (3, "海边 的照片", 0.18, "zh"), (4, "海边 的照片", 0.18, "zh"),
    ]


def test_alert_stream_survives_a_restart(spark, tmp_path):
    rows = fixtures.media(spark, "/root/testdata/sf0.001").withColumn("arrived", F.col("modified_time"))
    rows = rows.select("id", "media_type", "file_hash", "frame_hash", "file_size", "arrived")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        stream = spark.readStream.schema(rows.schema).parquet(source)
        writer = jobs.stream_duplicate_alert(stream, jobs.append_batches(out))
        writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    for part in range(2):
        rows.filter(F.col("id") % 2 == part).coalesce(1).write.mode("append").parquet(source)
        run()
    got = jobs.latest_alerts(spark.read.parquet(out))
    want = jobs.duplicate_alerts(rows).filter("copies > 1")
    assert rows_of(got, "key", "copies", "first_id", "last_id") == rows_of(want, "key", "copies", "first_id", "last_id")


def test_replayed_batch_takes_effect_once(spark, tmp_path):
    from mediacat.plans.queries_streaming import STREAM_MEDIA, _columns, _read_files

    log = str(tmp_path / "log")
    files = [
        [("/a/1.jpg", 10, 1), ("/a/2.jpg", 10, 1), ("/a/3.jpg", 11, 1)],
        [("/a/4.jpg", 10, 2), ("/a/1.jpg", 12, 2)],  # 1 changed: only 2 and 4 are copies now
        [("/a/2.jpg", 13, 3), ("/a/5.jpg", 13, 3)],  # 2 changed: 4 is alone, 2 and 5 are copies
        [("/a/6.jpg", 10, 4)],  # 4 and 6 are copies
    ]
    for n, rows in enumerate(files):
        batch = table(spark, "path string, length bigint, t bigint", *rows).selectExpr(
            "path", "length", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(t as int)) as mtime"
        )
        for _ in range(2):  # the second write of a batch replaces the first
            before = log if n else str(tmp_path / "none")
            state = jobs.read_changes(spark, before, STREAM_MEDIA) if n == 0 else first
            jobs.write_changes(_columns(jobs.ingest_changes(state, batch, _read_files, f"s{n}")), log, n)
        first = jobs.read_changes(spark, log, STREAM_MEDIA)
    assert jobs.committed_batch(spark, log) == 3
    by_id = {r["id"]: r["path"] for r in first.media.collect()}
    assert sorted(by_id.values()) == [f"/a/{n}.jpg" for n in range(1, 7)]
    linked = {}
    for r in first.members.collect():
        linked.setdefault(r["group_id"], []).append(by_id[r["photo_id"]])
    assert sorted(sorted(v) for v in linked.values()) == [["/a/2.jpg", "/a/5.jpg"], ["/a/4.jpg", "/a/6.jpg"]]
    assert rows_of(first.groups, "group_id") == sorted((g,) for g in linked)


def test_ingested_videos_are_confirmed_by_content(spark, tmp_path):
    """Equal size and first frame: b is a's copy, c differs in the samples, d between them; e, a copy, comes later."""
    from mediacat.plans.queries_streaming import STREAM_MEDIA, _columns

    size = 10_000_000
    for name, at in (("a", None), ("b", None), ("c", 0), ("d", 2_000_000), ("e", None)):
        body = bytearray(size)
        if at is not None:
            body[at] = 1
        (tmp_path / f"{name}.mp4").write_bytes(body)
    kinds = [c.split(" ", 1) for c in STREAM_MEDIA.split(", ")]
    given = ("id", "path", "filename", "media_type", "file_size", "taken_at", "modified_time")
    extract = lambda files: files.select(
        "path", *[F.lit("f" if n == "frame_hash" else None).cast(k).alias(n) for n, k in kinds if n not in given]
    )
    log = str(tmp_path / "log")
    for n, names in enumerate(("abcd", "e")):
        batch = table(spark, "path string, length bigint, mtime timestamp_ntz", *[(str(tmp_path / f"{x}.mp4"), size, dt.datetime(2024, 1, 1)) for x in names])
        state = jobs.read_changes(spark, log, STREAM_MEDIA)
        jobs.write_changes(_columns(jobs.ingest_changes(state, batch, extract, f"s{n}")), log, n)
        state = jobs.read_changes(spark, log, STREAM_MEDIA)
        found = state.members.join(state.media.selectExpr("id as photo_id", "filename"), "photo_id")
        assert rows_of(found, "filename") == [("a.mp4",), ("b.mp4",)] + [("e.mp4",)] * n and state.groups.count() == 1


def test_rebuilt_groups_rest_on_content(spark, tmp_path):
    """Equal size, first frame and, for c, samples: only a and b are equal."""
    from mediacat.sources import tables

    size = 10_000_000
    for name, at in (("a", None), ("b", None), ("c", 2_000_000), ("d", 0)):
        body = bytearray(size)
        if at is not None:
            body[at] = 1
        (tmp_path / f"{name}.mp4").write_bytes(body)
    rows = media(spark, *[
        {"id": n, "path": str(tmp_path / f"{n}.mp4"), "media_type": "video", "frame_hash": "f", "file_size": size} for n in "abcd"
    ])
    jobs_plan.rebuild_exact(rows, str(tmp_path / "groups"))
    groups, members = tables.read_groups(spark, str(tmp_path / "groups"))
    assert rows_of(members, "photo_id") == [("a",), ("b",)] and groups.count() == 1
    members, _ = jobs_plan.exact_report(rows, jobs_plan.hash_video_candidates(rows))
    assert rows_of(members, "photo_id") == [("a",), ("b",)]
    members, _ = jobs_plan.exact_report(rows, unverified=True)
    assert members.count() == 4
