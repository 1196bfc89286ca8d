"""Exact and similar duplicates, keepers and group editing."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediacat.functions import hashing
from mediacat.operators import components, exact, groups, keeper, similar
from mediacat.plans import fixtures as fx
from mediacat.plans.registry import flat, query, rounded

KEEPER_ORDER = "score DESC, s.taken_at DESC NULLS LAST, s.id"

# All pairs under the limits, by comparing everything with everything: what the joins
# must reproduce. {rows} is (id, file_size, ph).
NEAR_SQL = """, near AS (SELECT a.id AS id_a, b.id AS id_b, hamming(a.ph, b.ph) AS distance FROM {rows} a JOIN {rows} b ON a.id < b.id
  AND greatest(a.file_size, b.file_size) <= 2 * least(a.file_size, b.file_size) AND hamming(a.ph, b.ph) < 10
  WHERE a.ph <> repeat('0', 64) AND b.ph <> repeat('0', 64))"""
BANDED_SQL = """, band AS (SELECT id, file_size, ph, i AS band, substr(ph, CAST(i * 8 + 1 AS INT), 8) AS val FROM (SELECT *, unnest(range(8)) AS i FROM {rows}
    WHERE ph <> repeat('0', 64)) WHERE substr(ph, CAST(i * 8 + 1 AS INT), 8) <> '00000000'),
 near AS (SELECT DISTINCT a.id AS id_a, b.id AS id_b, hamming(a.ph, b.ph) AS distance FROM band a JOIN band b
  ON a.band = b.band AND a.val = b.val AND a.id < b.id
  AND greatest(a.file_size, b.file_size) <= 2 * least(a.file_size, b.file_size) AND hamming(a.ph, b.ph) < 10)"""
COMPONENT_SQL = """, both_ways AS (SELECT id_a AS a, id_b AS b FROM near UNION SELECT id_b, id_a FROM near),
 reach(id, seen) AS (SELECT a, a FROM both_ways UNION SELECT r.id, e.b FROM reach r JOIN both_ways e ON e.a = r.seen),
 comp AS (SELECT id, min(seen) AS component FROM reach GROUP BY id)"""


@query(
    """SELECT media_type, key, photo_id, CAST(taken_at AS VARCHAR) AS taken_at, "count", group_id FROM exact_rows""",
    "exact_rows",
)
def d1_exact_groups(spark, sf):
    return flat(exact.exact_groups(fx.media(spark, sf)))


VERIFIED_SQL = """, v AS (SELECT e.media_type, CASE WHEN e.media_type = 'video' THEN e.key || '_sampled_' || sampled_hash ELSE e.key END AS key,
  e.photo_id, e.taken_at FROM exact_rows e JOIN media m ON m.id = e.photo_id),
 checked AS (SELECT *, count(*) OVER w AS n, 'exact:' || min(photo_id) OVER w AS group_id FROM v WINDOW w AS (PARTITION BY media_type, key))"""


@query(
    VERIFIED_SQL + """ SELECT media_type, key, photo_id, CAST(taken_at AS VARCHAR) AS taken_at, n AS "count", group_id FROM checked WHERE n > 1""",
    "exact_rows", "media",
)
def d7_verify_video_groups(spark, sf):
    media = fx.media(spark, sf)
    sampled = media.select(F.col("id").alias("photo_id"), "sampled_hash")
    return flat(exact.verify_video_groups(exact.exact_groups(media), sampled))


@query(
    VERIFIED_SQL.replace("|| sampled_hash ELSE", "|| sampled_hash || '_full_' || md5((m.id % 3)::VARCHAR) ELSE")
    + """ SELECT media_type, key, photo_id, CAST(taken_at AS VARCHAR) AS taken_at, n AS "count", group_id FROM checked WHERE n > 1""",
    "exact_rows", "media",
)
def d7_verify_video_content(spark, sf):
    """Videos equal in the samples, some of them different between the samples."""
    media = fx.media(spark, sf)
    sampled = media.select(F.col("id").alias("photo_id"), "sampled_hash")

    def full(ids):
        return ids.select("photo_id", F.md5((F.col("photo_id") % 3).cast("string")).alias("full_hash"))

    return flat(exact.verify_video_groups(exact.exact_groups(media), sampled, full=full))


INCREMENT_SQL = """, old AS (SELECT 'old:' || key AS group_id, photo_id FROM exact_rows WHERE photo_id IN (SELECT vec_id FROM embeddings)),
 touched AS (SELECT e.* FROM exact_rows e JOIN media m ON m.id = e.photo_id WHERE
   (e.media_type = 'image' AND file_hash IN (SELECT file_hash FROM media WHERE id IN (SELECT doc_id FROM labels))) OR
   (e.media_type = 'video' AND frame_hash IN (SELECT frame_hash FROM media WHERE id IN (SELECT doc_id FROM labels)))),
 placed AS (SELECT t.*, o.group_id AS known, min(o.group_id) OVER (PARTITION BY t.group_id) AS home
   FROM touched t LEFT JOIN old o USING (photo_id)),
 added AS (SELECT coalesce(home, group_id) AS group_id, photo_id, home IS NULL AS opens FROM placed WHERE known IS NULL)"""


def _increment(spark, sf):
    """Labelled documents are the new files; groups so far hold the files with a vector."""
    media = fx.media(spark, sf)
    known = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("photo_id"))
    found = exact.exact_groups(media).join(known, "photo_id", "left_semi")
    old = found.select(F.concat(F.lit("old:"), "key").alias("group_id"), "photo_id")
    new = media.join(_labelled(spark, sf, "id"), "id", "left_semi")
    return exact.exact_groups_incremental(
        media,
        new.filter("file_hash is not null").select("file_hash"),
        new.filter("frame_hash is not null").select("frame_hash"),
        old,
    )


def _labelled(spark, sf, name):
    return fx.table(spark, sf, "labels").select(F.col("doc_id").alias(name))


@query(INCREMENT_SQL + " SELECT group_id, photo_id FROM added", "exact_rows", "media")
def d2_exact_incremental_members(spark, sf):
    return _increment(spark, sf)[0]


@query(
    INCREMENT_SQL
    + f""" SELECT group_id, 'exact' AS reason, photo_id AS keeper_id FROM added JOIN scored s ON s.id = photo_id WHERE opens
    QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY {KEEPER_ORDER}) = 1""",
    "exact_rows", "media", "scored",
)
def d2_exact_incremental_groups(spark, sf):
    return _increment(spark, sf)[1]


@query(BANDED_SQL.format(rows="fp") + " SELECT id_a, id_b, CAST(distance AS INT) AS distance FROM near", "fp")
def d3_similar_pairs(spark, sf):
    return similar.similar_pairs(fx.fingerprints(spark, sf))


LINKS_SQL = """, usable AS (SELECT id, ph, min(id) OVER (PARTITION BY ph) AS class_id FROM fp WHERE ph <> repeat('0', 64)),
 linked AS (SELECT id, count(*) AS n FROM (SELECT id_a AS id FROM near UNION ALL SELECT id_b FROM near) GROUP BY id)
 SELECT u.id, u.class_id, coalesce(n, 0) AS n_links FROM usable u LEFT JOIN linked l ON l.id = u.id"""
CLASS_LINKS_SQL = """, class AS (SELECT ph, min(id) AS class_id, min(file_size) AS lo, max(file_size) AS hi, count(*) AS n FROM fp
  WHERE ph <> repeat('0', 64) GROUP BY ph),
 class_band AS (SELECT *, i AS band, substr(ph, CAST(i * 8 + 1 AS INT), 8) AS val FROM (SELECT *, unnest(range(8)) AS i FROM class)
  WHERE substr(ph, CAST(i * 8 + 1 AS INT), 8) <> '00000000')
 SELECT DISTINCT a.class_id AS class_a, b.class_id AS class_b, CAST(hamming(a.ph, b.ph) AS INT) AS distance FROM class_band a JOIN class_band b
  ON a.band = b.band AND a.val = b.val AND (a.class_id < b.class_id OR (a.class_id = b.class_id AND a.n > 1))
  AND greatest(a.lo, b.lo) <= 2 * least(a.hi, b.hi) AND hamming(a.ph, b.ph) < 10"""


@query(BANDED_SQL.format(rows="fp") + LINKS_SQL, "fp")
def d3_similar_links(spark, sf):
    """Number of similar files of each file."""
    return similar.link_counts(*similar.similar_classes(fx.fingerprints(spark, sf)))


@query(CLASS_LINKS_SQL, "fp")
def d3_similar_class_links(spark, sf):
    """Pairs of classes of equal fingerprints that stand for the pairs of files."""
    return similar.similar_classes(fx.fingerprints(spark, sf))[1]


@query(NEAR_SQL.format(rows="fp") + LINKS_SQL, "fp")
def d4_similar_links(spark, sf):
    """The same counts without a common band, in tiles of crowded buckets."""
    return similar.link_counts(*similar.similar_classes(fx.fingerprints(spark, sf), bands=None, crowd=3))


@query(BANDED_SQL.format(rows="fp") + COMPONENT_SQL + " SELECT id, component FROM comp", "fp")
def d3_similar_pairs_small_buckets(spark, sf):
    """Files of banded pairs with every bucket of more than three nodes treated as crowded."""
    return similar.similar_components(fx.fingerprints(spark, sf), mode="banded", crowd=3)


@query(NEAR_SQL.format(rows="fp") + COMPONENT_SQL + " SELECT id, component FROM comp", "fp")
def d4_similar_complete(spark, sf):
    return similar.similar_components(fx.fingerprints(spark, sf))


@query(NEAR_SQL.format(rows="fp") + COMPONENT_SQL + " SELECT id, component FROM comp", "fp")
def d4_similar_complete_crowded(spark, sf):
    """The same rows with every bucket of more than three nodes treated as crowded."""
    return similar.similar_components(fx.fingerprints(spark, sf), crowd=3)


@query(BANDED_SQL.format(rows="fp") + COMPONENT_SQL + " SELECT id, component FROM comp", "fp")
def d4_similar_banded(spark, sf):
    return similar.similar_components(fx.fingerprints(spark, sf), mode="banded")


@query(
    """, near AS (SELECT lag(doc_id) OVER (PARTITION BY md5(text) ORDER BY doc_id) AS id_a, doc_id AS id_b FROM documents
    QUALIFY lag(doc_id) OVER (PARTITION BY md5(text) ORDER BY doc_id) IS NOT NULL)"""
    + COMPONENT_SQL
    + " SELECT id AS node, component FROM comp",
    "folders",
)
def d5_connected_components(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", F.md5("text").alias("hash"))
    first = docs.groupBy("hash").agg(F.min("doc_id").alias("first"))
    edges = docs.join(first, "hash").select(F.col("first").alias("src"), F.col("doc_id").alias("dst"))
    return components.connected_components(edges)


SIMILAR_GROUP_SQL = """, scored_fp AS (SELECT id, component, log2(greatest(1, file_size)::DOUBLE) * 10 + width::DOUBLE * height / 1000000
   + CASE WHEN filename LIKE '%copy%' THEN 0 ELSE 10 END AS score FROM comp JOIN fp_media USING (id)),
 found AS (SELECT * FROM scored_fp {skip}),
 keepers AS (SELECT component, id AS keeper_id FROM found QUALIFY row_number() OVER (PARTITION BY component ORDER BY score DESC, id) = 1)
 SELECT 'similar:' || component AS group_id, id AS photo_id, keeper_id FROM found JOIN keepers USING (component)"""


def _with_keeper(members, heads):
    return members.join(heads.select("group_id", "keeper_id"), "group_id")


@query(
    NEAR_SQL.format(rows="fp_media") + COMPONENT_SQL + SIMILAR_GROUP_SQL.format(skip=""), "fp_media"
)
def d6_similar_groups(spark, sf):
    return _with_keeper(*similar.similar_groups(fx.fingerprint_media(spark, sf)))


@query(
    BANDED_SQL.format(rows="fp_media") + COMPONENT_SQL + SIMILAR_GROUP_SQL.format(skip=""), "fp_media"
)
def d6_similar_groups_banded(spark, sf):
    return _with_keeper(*similar.similar_groups(fx.fingerprint_media(spark, sf), mode="banded"))


@query(
    NEAR_SQL.format(rows="fp_media")
    + COMPONENT_SQL
    + SIMILAR_GROUP_SQL.format(
        skip="WHERE component NOT IN (SELECT component FROM comp WHERE id IN (SELECT doc_id FROM labels))"
    ),
    "fp_media",
)
def d6_similar_groups_incremental(spark, sf):
    """Labelled documents stand in for members of earlier groups."""
    old = fx.table(spark, sf, "labels").select(F.lit("exact:0").alias("group_id"), F.col("doc_id").alias("photo_id"))
    return _with_keeper(*similar.similar_groups(fx.fingerprint_media(spark, sf), old))


@query("SELECT id, round(score, 6) AS score FROM scored", "scored")
def d8_score(spark, sf):
    return rounded(keeper.score(fx.media(spark, sf)).select("id", "score"), "score")


@query(
    f"""SELECT group_id, photo_id AS keeper_id FROM members JOIN scored s ON s.id = photo_id WHERE deleted_at IS NULL
    QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY {KEEPER_ORDER}) = 1""",
    "members", "scored",
)
def d9_pick_keeper(spark, sf):
    return keeper.pick_keeper(fx.members(spark, sf), fx.media(spark, sf))


REPICK_ORDER = """(latitude IS NOT NULL AND longitude IS NOT NULL) DESC, file_size DESC NULLS LAST, (taken_at IS NULL), taken_at, id"""


@query(
    f"""SELECT group_id, photo_id AS keeper_id FROM members JOIN active ON id = photo_id
    QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY {REPICK_ORDER}) = 1""",
    "members", "active",
)
def d10_repick_keeper(spark, sf):
    return keeper.repick_keeper(fx.members(spark, sf), fx.media(spark, sf))


@query(
    """SELECT b.id, CAST(hamming(b.ph, f.flip) AS INT) AS bits,
    CAST(CASE WHEN b.id % 64 = 0 THEN 0 ELSE hamming(substr(b.ph, 1, CAST(b.id % 64 AS INT)), substr(f.flip, 1, CAST(b.id % 64 AS INT))) END
      + 64 - b.id % 64 AS INT) AS uneven
    FROM fp_base b JOIN fp_flip f USING (id)""",
    "fp_base", "fp_flip",
)
def d11_hamming(spark, sf):
    base = fx.fingerprints(spark, sf)
    a = base.filter("id % 4 = 0").selectExpr("id div 4 as id", "ph")
    b = base.filter("id % 4 = 1").selectExpr("id div 4 as id", "ph as flip")
    part = F.substr(F.col("ph"), F.lit(1), (F.col("id") % 64).cast("int"))
    return a.join(b, "id").select(
        "id",
        hashing.hamming(F.col("ph"), F.col("flip")).alias("bits"),
        hashing.hamming(part, F.col("flip")).alias("uneven"),
    )


LISTING_SQL = """, rows AS (SELECT group_id, a.id AS photo_id, path, filename, file_size, taken_at, latitude, longitude, width, height, camera
   FROM members JOIN active a ON a.id = photo_id),
 heads AS (SELECT g.group_id, reason, keeper_id, count(r.photo_id) AS size, max(r.taken_at) AS latest
   FROM groups g LEFT JOIN rows r USING (group_id) {where} GROUP BY ALL)"""
LISTING_COLUMNS = """group_id, photo_id, path, filename, file_size, CAST(taken_at AS VARCHAR) AS taken_at, latitude, longitude,
 width, height, camera, reason, keeper_id, size, CAST(latest AS VARCHAR) AS latest"""


@query(
    LISTING_SQL.format(where="") + f" SELECT {LISTING_COLUMNS} FROM heads LEFT JOIN rows USING (group_id)",
    "members", "active", "groups",
)
def d12_group_listing(spark, sf):
    c = fx.catalog(spark, sf)
    return flat(groups.group_listing(c.groups, c.members, c.media))


@query(
    LISTING_SQL.format(where="WHERE reason = 'exact'")
    + f""", cut AS (SELECT * FROM heads ORDER BY size DESC, latest DESC NULLS LAST, group_id LIMIT 12 OFFSET 6)
    SELECT {LISTING_COLUMNS}, (SELECT count(*) FROM heads) AS total FROM cut LEFT JOIN rows USING (group_id)""",
    "members", "active", "groups",
)
def d13_group_page(spark, sf):
    c = fx.catalog(spark, sf)
    return flat(groups.group_page(c.groups, c.members, c.media, 12, 6, "exact"))


KEEP_SQL = """, keep AS (SELECT group_id, photo_id FROM members WHERE photo_id IN (SELECT doc_id FROM labels)),
 manual AS (SELECT DISTINCT group_id FROM keep),
 kept AS (SELECT m.group_id, reason, m.photo_id, coalesce(CASE WHEN u.group_id IS NOT NULL THEN k.photo_id IS NOT NULL
     ELSE m.photo_id = keeper_id END, false) AS kept FROM members m JOIN groups g USING (group_id)
   LEFT JOIN manual u USING (group_id) LEFT JOIN keep k ON k.group_id = m.group_id AND k.photo_id = m.photo_id)"""


def _kept(spark, sf):
    members = fx.members(spark, sf)
    keep = members.join(_labelled(spark, sf, "photo_id"), "photo_id", "left_semi")
    return groups.apply_keep(fx.groups(spark, sf), members, keep)


@query(KEEP_SQL + " SELECT * FROM kept", "members", "groups")
def d14_apply_keep(spark, sf):
    return _kept(spark, sf)


@query(
    KEEP_SQL
    + """ SELECT group_id, count(*) FILTER (kept) AS n_kept, CASE WHEN count(*) FILTER (kept) = 0 THEN 'keeps nothing'
    ELSE 'exact group keeps several' END AS problem FROM kept GROUP BY group_id, reason
    HAVING count(*) FILTER (kept) = 0 OR (reason = 'exact' AND count(*) FILTER (kept) > 1)""",
    "members", "groups",
)
def d14_keep_violations(spark, sf):
    return groups.keep_violations(_kept(spark, sf))


@query(
    KEEP_SQL
    + """ SELECT count(*) AS "count", CAST(coalesce(sum(file_size), 0) AS BIGINT) AS size FROM kept JOIN active ON id = photo_id
    WHERE NOT kept AND group_id LIKE 'exact:%'""",
    "members", "groups", "active",
)
def a8_reclaimable(spark, sf):
    selected = fx.groups(spark, sf).filter("reason = 'exact'")
    return groups.reclaimable(_kept(spark, sf), fx.media(spark, sf), selected)


@query(
    "SELECT group_id, photo_id, path, file_size FROM members JOIN active ON id = photo_id", "members", "active"
)
def j1_group_members(spark, sf):
    rows = groups.group_members(fx.members(spark, sf), fx.media(spark, sf))
    return rows.select("group_id", "photo_id", "path", "file_size")


@query("SELECT DISTINCT group_id FROM members WHERE photo_id IN (SELECT doc_id FROM labels)", "members")
def j4_affected_groups(spark, sf):
    return groups.affected_groups(fx.members(spark, sf), fx.table(spark, sf, "labels").select("doc_id"))


@query(
    "SELECT DISTINCT group_id FROM members WHERE photo_id IN (SELECT id FROM media WHERE folder_id = 'src3')", "members", "media"
)
def j4_affected_by_folder(spark, sf):
    return groups.affected_by_folder(fx.members(spark, sf), fx.media(spark, sf), "src3")


@query(
    """SELECT group_id, photo_id FROM members m WHERE NOT EXISTS (SELECT 1 FROM groups g WHERE g.group_id = m.group_id
    AND g.keeper_id = m.photo_id)""",
    "members", "groups",
)
def j5_redundant_members(spark, sf):
    return groups.redundant_members(fx.groups(spark, sf), fx.members(spark, sf)).select("group_id", "photo_id")


@query(
    """SELECT group_id, photo_id FROM members WHERE group_id IN (SELECT group_id FROM groups WHERE reason <> 'exact')""",
    "members", "groups",
)
def k4_clear_groups(spark, sf):
    return groups.clear_groups(fx.groups(spark, sf), fx.members(spark, sf), "exact")[1].select("group_id", "photo_id")


@query(
    """SELECT group_id, keeper_id, photo_id FROM members JOIN groups USING (group_id) WHERE reason = 'exact'""",
    "members", "groups",
)
def k3_rebuild_groups(spark, sf):
    """Written as a snapshot and read back."""
    import uuid

    from mediacat.runtime import scratch_folder
    from mediacat.sources import tables

    base = f"{scratch_folder(spark)}/groups-{uuid.uuid4().hex}"
    heads = fx.groups(spark, sf).filter("reason = 'exact'")
    members = fx.members(spark, sf).join(heads.select("group_id"), "group_id", "left_semi")
    tables.rebuild_groups(members, heads, base, "exact")
    stored_groups, stored_members = tables.read_groups(spark, base, id_type="bigint")
    return stored_members.join(stored_groups, "group_id").select("group_id", "keeper_id", "photo_id")
