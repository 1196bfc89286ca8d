"""Exact and similar groups, keepers, components."""

import random
from bisect import bisect_left, bisect_right
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mediacat.functions import hashing
from mediacat.operators import exact, groups, keeper, similar
from mediacat.operators.components import connected_components
from tests.helpers import brute_components, components_of, media, near_fingerprints, rows_of, table


def grouped(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["group_id"], set()).add(r["photo_id"])
    return sorted(sorted(v) for v in out.values())


def video(i, frame, size):
    return {"id": i, "media_type": "video", "file_hash": None, "frame_hash": frame, "file_size": size}


def test_images_group_by_content(spark):
    rows = media(spark, {"id": "a", "file_hash": "same"}, {"id": "b", "file_hash": "same"}, {"id": "c"})
    found = exact.exact_groups(rows)
    assert grouped(found) == [["a", "b"]]
    assert {(r["key"], r["count"]) for r in found.collect()} == {("same", 2)}


def test_videos_group_by_frame_and_size(spark):
    rows = media(spark, video("a", "fr", 1000), video("b", "fr", 1000), video("c", "fr", 2000))
    found = exact.exact_groups(rows)
    assert {r["key"] for r in found.collect()} == {"fr_1000"}
    assert grouped(found) == [["a", "b"]]


def test_images_and_videos_stay_apart(spark):
    rows = media(
        spark,
        {"id": "a", "file_hash": "same_1"}, {"id": "b", "file_hash": "same_1"},
        video("c", "same", 1), video("d", "same", 1),
    )
    assert grouped(exact.exact_groups(rows)) == [["a", "b"], ["c", "d"]]


@pytest.mark.parametrize("min_rows", [1, 3, 10**9])
def test_hot_keys_take_the_same_groups(spark, min_rows):
    rng = random.Random(3)
    rows = [{"id": f"{i:04d}", "file_hash": "hot" if i % 3 == 0 else f"h{rng.randint(0, 60)}"} for i in range(300)]
    expected = {}
    for r in rows:
        expected.setdefault(r["file_hash"], []).append(r["id"])
    found = exact.exact_groups(media(spark, *rows), min_rows=min_rows)
    assert grouped(found) == sorted(v for v in expected.values() if len(v) > 1)


def test_incremental_reaches_the_same_membership(spark):
    rng = random.Random(5)
    rows = [{"id": f"{i:03d}", "file_hash": f"h{rng.randint(0, 30)}"} for i in range(80)]
    whole = media(spark, *rows)
    first = media(spark, *rows[:40])
    old = exact.exact_groups(first).select("group_id", "photo_id")
    hashes = table(spark, "file_hash string", *[(r["file_hash"],) for r in rows[40:]])
    added, opened = exact.exact_groups_incremental(whole, hashes, hashes, old)
    assert grouped(old.unionByName(added)) == grouped(exact.exact_groups(whole))
    assert opened.count() == len(grouped(exact.exact_groups(whole))) - len(grouped(old))


def test_incremental_opens_a_new_group_when_the_id_is_taken(spark):
    rows = media(spark, {"id": "a", "file_hash": "new"}, {"id": "d", "file_hash": "new"}, {"id": "b", "file_hash": "old"}, {"id": "c", "file_hash": "old"})
    old = table(spark, "group_id string, photo_id string", ("exact:a", "b"), ("exact:a", "c"))
    added, opened = exact.exact_groups_incremental(rows, table(spark, "h string", ("new",)), table(spark, "h string", ("x",)), old)
    assert rows_of(added) == [("exact:a:new", "a"), ("exact:a:new", "d")]
    assert rows_of(opened, "group_id") == [("exact:a:new",)]


def test_score_order(spark):
    mega = 1 << 30
    rows = media(
        spark,
        {"id": "plain"}, {"id": "gps", "latitude": 1.0, "longitude": 2.0},
        {"id": "huge", "file_size": mega}, {"id": "tiny gps", "file_size": 100, "latitude": 1.0, "longitude": 2.0},
        {"id": "big", "file_size": 5000}, {"id": "sharp", "width": 4000, "height": 3000},
        {"id": "copy", "path": "/x/a_copy.jpg"}, {"id": "copy2", "path": "/x/a_副本.jpg"},
        {"id": "big gps", "file_size": 5000, "latitude": 1.0, "longitude": 2.0},
    )
    s = {r["id"]: r["score"] for r in keeper.score(rows).collect()}
    assert s["gps"] > s["plain"] and s["huge"] > s["tiny gps"] and s["big"] > s["plain"]
    assert s["sharp"] > s["plain"] and s["plain"] > s["copy"] and s["plain"] > s["copy2"]
    assert s["big gps"] > s["tiny gps"]


def test_hamming(spark):
    rng = random.Random(1)
    a = "".join(rng.choice("01") for _ in range(64))
    one = ("1" if a[0] == "0" else "0") + a[1:]
    flipped = a.translate(str.maketrans("01", "10"))
    rows = table(spark, "a string, b string", (a, a), (a, one), (a, flipped), ("", "01"), (a[:10], a[:7]))
    got = [r[0] for r in rows.select(hashing.hamming(F.col("a"), F.col("b"))).collect()]
    assert got == [0, 1, 64, 2, 3]


def test_legacy_hash(spark):
    rows = table(spark, "h string", ("0123456789abcdef0123456789ABCDEF",), ("0123456789abcdef",), (None,))
    assert [r[0] for r in rows.select(hashing.is_legacy_hash(F.col("h"))).collect()] == [True, False, False]


@pytest.mark.parametrize("min_rows", [3, None])
def test_components_of_chains_stars_and_rings(spark, min_rows):
    chain = [(i, i + 1) for i in range(0, 200)]
    star = [(1000, 1000 + i) for i in range(1, 150)]
    ring = [(3000 + i, 3000 + (i + 1) % 37) for i in range(37)]
    loops = [(5000, 5000)]
    edges = chain + star + ring + loops
    random.Random(2).shuffle(edges)
    found = connected_components(table(spark, "src bigint, dst bigint", *edges).repartition(5), min_rows=min_rows)
    assert dict(rows_of(found)) == components_of(chain + star + ring)


def test_components_of_nothing(spark):
    assert connected_components(table(spark, "src bigint, dst bigint")).count() == 0


@pytest.mark.parametrize("crowd", [2, 10, 2000])
def test_complete_mode_equals_all_pairs(spark, crowd):
    rows = near_fingerprints(260, seed=11)
    rows += [(1000 + i, 1000 + i % 7, rows[0][2]) for i in range(100)]  # one fingerprint owns a third
    rows += [(2000, 10, "0" * 64), (2001, 10, "0" * 64)]
    fp = table(spark, "id bigint, file_size bigint, ph string", *rows)
    found = similar.similar_components(fp, crowd=crowd)
    assert dict(rows_of(found)) == brute_components(rows)


@pytest.mark.parametrize("crowd", [3, 2000])
def test_batches_of_choices_contract_in_between(spark, crowd):
    rows = near_fingerprints(120, seed=21)
    fp = table(spark, "id bigint, file_size bigint, ph string", *rows)
    found = similar.similar_components(fp, crowd=crowd, batch_rows=20 * len(rows))
    assert dict(rows_of(found)) == brute_components(rows)


def test_complete_mode_with_three_and_four_intact_blocks(spark):
    rows = near_fingerprints(150, seed=4, spread=5, centres=30)
    fp = table(spark, "id bigint, file_size bigint, ph string", *rows)
    for blocks in (12, 13):
        assert dict(rows_of(similar.similar_components(fp, blocks=blocks))) == brute_components(rows)


def test_crowd_of_many_components_is_compared_across(spark):
    """Two tight crowds nine bits apart share whole buckets and must still meet."""
    rng = random.Random(9)
    base = rng.getrandbits(64)
    other = base
    for p in range(0, 63, 7):
        other ^= 1 << p
    rows = []
    for i in range(40):
        for j, bits in enumerate((base, other)):
            rows.append((2 * i + j, 1000, format(bits ^ (1 << rng.randrange(64)), "064b")))
    fp = table(spark, "id bigint, file_size bigint, ph string", *rows)
    assert dict(rows_of(similar.similar_components(fp, crowd=4))) == brute_components(rows)


def test_every_banded_pair_lies_in_one_complete_component(spark):
    rows = near_fingerprints(200, seed=6)
    fp = table(spark, "id bigint, file_size bigint, ph string", *rows)
    parts = dict(rows_of(similar.similar_components(fp)))
    for a, b, distance in rows_of(similar.similar_pairs(fp)):
        assert distance < 10 and parts[a] == parts[b]


def test_size_class_is_exact(spark):
    sizes = [0, 1, 2, 3, 4] + [2**k + d for k in (10, 31, 40, 52, 61) for d in (-1, 0, 1)]
    rows = table(spark, "size bigint", *[(s,) for s in sizes])
    got = [r[0] for r in rows.select(similar.size_class(F.col("size"))).collect()]
    assert got == [s.bit_length() - 1 for s in sizes]


def test_keep_choices(spark):
    heads = table(
        spark, "group_id string, reason string, keeper_id string",
        ("g1", "exact", "a"), ("g2", "exact", "c"), ("g3", "similar", "e"), ("g4", "similar", None),
    )
    members = table(
        spark, "group_id string, photo_id string",
        ("g1", "a"), ("g1", "b"), ("g2", "c"), ("g2", "d"), ("g3", "e"), ("g3", "f"), ("g4", "x"), ("g4", "y"),
    )
    keep = table(spark, "group_id string, photo_id string", ("g1", "b"), ("g2", "c"), ("g2", "d"), ("g3", "e"), ("g3", "f"), ("g1", "zzz"))
    kept = groups.apply_keep(heads, members, keep)
    assert rows_of(kept.filter("kept"), "group_id", "photo_id") == [
        ("g1", "b"), ("g2", "c"), ("g2", "d"), ("g3", "e"), ("g3", "f"),
    ]
    assert rows_of(groups.keep_violations(kept), "group_id", "problem") == [
        ("g2", "exact group keeps several"), ("g4", "keeps nothing"),
    ]


def test_a_burst_beyond_any_bucket_is_one_component(spark):
    """2,000 files that agree on a band, in both modes."""
    base = int("10" * 32, 2)
    rows = [(i, 1000, format(base ^ (1 << (i % 56)) ^ (1 << ((i * 7) % 50)), "064b")) for i in range(2000)]
    fp = table(spark, "id bigint, file_size bigint, ph string", *rows)
    for mode in ("banded", "complete"):
        got = rows_of(similar.similar_components(fp, mode=mode, crowd=100))
        assert got == [(i, 0) for i in range(2000)]


def test_banded_components_are_those_of_the_banded_pairs(spark):
    rows = near_fingerprints(200, seed=9) + [(10_000 + i, 1000, format(3 << i, "064b")) for i in range(40)]
    fp = table(spark, "id bigint, file_size bigint, ph string", *rows)
    pairs = similar.similar_pairs(fp)
    want = rows_of(connected_components(pairs, "id_a", "id_b"))
    for crowd in (3, 2000):
        assert rows_of(similar.similar_components(fp, mode="banded", crowd=crowd)) == want


@pytest.mark.parametrize("crowd", [3, 2000])
def test_classes_expand_to_the_pairs(spark, crowd):
    rows = near_fingerprints(150, seed=5)
    rows += [(1000 + i, i % 9 * 100, rows[0][2]) for i in range(40)]  # one burst of many sizes, size 0 included
    rows += [(2000, None, rows[1][2]), (2001, 5, "0" * 64), (2002, 5, None)]
    fp = table(spark, "id bigint, file_size bigint, ph string", *rows)
    pairs = rows_of(similar.similar_pairs(fp), "id_a", "id_b", "distance")
    members, links = similar.similar_classes(fp, crowd=crowd)
    assert rows_of(similar.expand_pairs(members, links), "id_a", "id_b", "distance") == pairs
    degree = Counter(i for a, b, _ in pairs for i in (a, b))
    counts = rows_of(similar.link_counts(members, links), "id", "n_links")
    assert counts == sorted((i, degree[i]) for i, _, ph in rows if ph and int(ph))


def test_a_burst_is_a_row_per_file_and_one_link(spark):
    rows = [(i, 1000 + i % 2500, "10" * 32) for i in range(5000)]
    fp = table(spark, "id bigint, file_size bigint, ph string", *rows)
    members, links = similar.similar_classes(fp)
    assert members.count() == 5000 and rows_of(links) == [(0, 0, 0)]
    ordered = sorted(s for _, s, _ in rows)
    want = [(i, bisect_right(ordered, 2 * s) - bisect_left(ordered, -(-s // 2)) - 1) for i, s, _ in rows]
    assert rows_of(similar.link_counts(members, links), "id", "n_links") == want


def test_classes_of_nothing(spark):
    members, links = similar.similar_classes(table(spark, "id bigint, file_size bigint, ph string"))
    assert members.count() == links.count() == similar.link_counts(members, links).count() == 0


def _one_band_apart(count, seed=3):
    """Fingerprints that agree on their first three bytes and on little else."""
    rng = random.Random(seed)
    return [(i, 1000, format(0xA5C396 << 40 | rng.getrandbits(40), "064b")) for i in range(count)]


def _recorded(monkeypatch, function, measure):
    seen, real = [], getattr(similar, function)

    def wrapped(*args, **kwargs):
        out = real(*args, **kwargs)
        seen.append(measure(args, out))
        return out

    monkeypatch.setattr(similar, function, wrapped)
    return seen


@pytest.mark.parametrize("mode, choices", [("banded", 8), ("complete", 55)])
def test_a_low_crowd_limit_does_not_multiply_rows(spark, monkeypatch, mode, choices):
    """Crowded buckets are compared as they are: no finer keys, a row per node and choice."""
    rows = _one_band_apart(300)
    fp = table(spark, "id bigint, file_size bigint, ph string", *rows)

    def in_mixed(args, out):
        return out.agg(F.sum("n")).first()[0] or 0 if args[1] == "mixed" else 0

    seen = _recorded(monkeypatch, "materialize", in_mixed)
    found = similar.similar_components(fp, mode=mode, crowd=3)
    assert dict(rows_of(found)) == brute_components(rows)
    # once when the buckets are counted, once when they are compared
    assert 0 < sum(seen) <= 2 * len(rows) * choices


def test_a_low_crowd_limit_cuts_classes_in_two_parts(spark, monkeypatch):
    rows = _one_band_apart(300) + near_fingerprints(100, seed=8, centres=3)
    rows = [(i, size, ph) for i, (_, size, ph) in enumerate(rows)]
    fp = table(spark, "id bigint, file_size bigint, ph string", *rows)
    seen = _recorded(monkeypatch, "_spread", lambda args, out: out.count())
    members, links = similar.similar_classes(fp, bands=None, crowd=3)
    assert sum(seen) <= 2 * 55 * len(rows)
    assert rows_of(links) == rows_of(similar.similar_classes(fp, bands=None)[1])


@pytest.mark.parametrize("mode", ["banded", "complete"])
@pytest.mark.parametrize("limits", [{"tile": 2}, {"tile": 2, "fine": 10}, {"fine": 3}])
def test_small_tiles_and_finer_keys_change_no_component(spark, mode, limits):
    rows = near_fingerprints(150, seed=14, spread=7, centres=20)
    fp = table(spark, "id bigint, file_size bigint, ph string", *rows)
    want = rows_of(similar.similar_components(fp, mode=mode))
    assert rows_of(similar.similar_components(fp, mode=mode, crowd=3, **limits)) == want


def test_small_tiles_change_no_link(spark):
    rows = near_fingerprints(150, seed=15, spread=7, centres=20)
    fp = table(spark, "id bigint, file_size bigint, ph string", *rows)
    want = rows_of(similar.similar_classes(fp)[1])
    assert rows_of(similar.similar_classes(fp, crowd=3, tile=2)[1]) == want


@pytest.mark.parametrize("limits", [{}, {"tile": 7}])
def test_a_crowded_bucket_passes_on_each_link_of_components_once(spark, monkeypatch, limits):
    """Pairs that agree on the first byte alone, seven bits apart, sizes at and beyond the limit."""
    rng, rows = random.Random(16), []
    for i in range(100):
        base = 0xA5 << 56 | rng.getrandbits(56)
        other = base ^ sum(1 << (8 * band + rng.randrange(8)) for band in range(7))
        rows += [(2 * i, 1000, format(base, "064b")), (2 * i + 1, 2000 + i % 2, format(other, "064b"))]
    fp = table(spark, "id bigint, file_size bigint, ph string", *rows)
    want = brute_components(rows)
    seen = _recorded(monkeypatch, "_crowded_links", lambda args, out: out.count())
    found = similar.similar_components(fp, mode="banded", crowd=100, **limits)
    assert dict(rows_of(found)) == want and len(want) == 100
    # cells of a grid may each find a pair
    assert sum(seen) <= (100 if limits else 50)
