"""Ingest, change sets and table maintenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacat.functions import fingerprints as fingerprint_functions
from mediacat.functions import hashing, tags
from mediacat.operators import audit, ingest, maintain
from mediacat.operators.filters import phash_missing
from mediacat.plans import fixtures as fx
from mediacat.plans.registry import flat, query, rounded
from mediacat.runtime import materialize
from mediacat.schema import Catalog
from mediacat.sources.images import phash_tasks

NOW = "2026-01-01 12:00:00"
REPICK = """(latitude IS NOT NULL AND longitude IS NOT NULL) DESC, file_size DESC NULLS LAST, (taken_at IS NULL), taken_at, id"""


def _content(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def i2_content_hash(spark, sf):
    return _content(spark, sf).select("doc_id", hashing.content_hash(F.col("content")).alias("hash"))


HEX_SQL = ", h AS (SELECT doc_id, hex(encode(text)) AS x, strlen(text) AS n FROM documents)"


@query(HEX_SQL + " SELECT doc_id, sha256(unhex(substr(x, 1, 32))) AS hash FROM h", "folders")
def i3_prefix_hash(spark, sf):
    return _content(spark, sf).select("doc_id", hashing.prefix_hash(F.col("content"), 16).alias("hash"))


@query(
    HEX_SQL
    + """ SELECT doc_id, sha256(unhex(CASE WHEN n <= 300 THEN x ELSE substr(x, 1, 200) || substr(x, CAST((n // 2 - 50) * 2 + 1 AS INT), 200)
    || right(x, 200) END)) AS hash FROM h""",
    "folders",
)
def i4_sampled_hash(spark, sf):
    return _content(spark, sf).select("doc_id", hashing.sampled_hash(F.col("content"), 100).alias("hash"))


DCT_SQL = """, px AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS val, unnest(range(64)) AS i FROM embeddings),
 uv AS (SELECT unnest(range(64)) AS k),
 coef AS (SELECT id, k, sum(val * cos(pi() * (2 * (i % 8) + 1) * (k % 8) / 16) * cos(pi() * (2 * (i // 8) + 1) * (k // 8) / 16)) AS c
   FROM px, uv GROUP BY id, k)"""


@query(DCT_SQL + """ SELECT id, k::INT AS k, round(c, 6) + 0.0 AS c FROM coef""", "folders")
def i5_dct_coefficients(spark, sf):
    rows = fx.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.posexplode(fingerprint_functions.dct_low(F.col("embedding"))).alias("k", "c")
    )
    return rows.select("id", "k", (F.round("c", 6) + 0.0).alias("c"))


@query(
    DCT_SQL
    + """, cut AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c) AS r FROM coef),
    med AS (SELECT id, c AS m FROM cut WHERE r = 33)
    SELECT id, string_agg(CASE WHEN c > m THEN '1' ELSE '0' END, '' ORDER BY k) AS ph FROM coef JOIN med USING (id) GROUP BY id""",
    "folders",
)
def i5_phash_from_pixels(spark, sf):
    return fx.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), fingerprint_functions.phash_from_pixels(F.col("embedding")).alias("ph")
    )


@query("SELECT id, path FROM active WHERE perceptual_hash IS NULL", "active")
def i6_phash_missing(spark, sf):
    return phash_missing(fx.media(spark, sf))


@query(
    """SELECT id, path, coalesce(file_size, 0) AS length, CAST(floor((sum(coalesce(file_size, 0) + 1048576) OVER (ORDER BY id)
      - coalesce(file_size, 0) - 1048576) / 8388608) AS BIGINT) AS task FROM active WHERE perceptual_hash IS NULL""",
    "active",
)
def i6_phash_tasks(spark, sf):
    """Files without fingerprint, dealt to tasks of 8 MB."""
    return phash_tasks(fx.media(spark, sf), 8 << 20)


@query(
    """SELECT id, CASE WHEN deleted_at IS NULL AND perceptual_hash IS NULL THEN ph ELSE perceptual_hash END AS perceptual_hash
    FROM media LEFT JOIN fp_base USING (id)""",
    "media", "fp_base",
)
def i6_fill_missing_phash(spark, sf):
    """Fingerprints computed from pixels fill the gaps."""
    media = fx.media(spark, sf)
    pixels = fx.fingerprints(spark, sf).filter("id % 4 = 0").selectExpr("id div 4 as id", "ph as perceptual_hash")
    computed = media.select("id", "path").join(pixels, "id").select("path", "perceptual_hash")
    return ingest.fill_missing_phash(media, computed).select("id", "perceptual_hash")


@query("SELECT path, id, status, length, CAST(mtime AS VARCHAR) AS mtime FROM diff", "diff")
def i7_diff_listing(spark, sf):
    return flat(ingest.diff_listing(fx.listing(spark, sf), fx.media(spark, sf)))


@query(
    """SELECT path, NULL::BIGINT AS id, 'new' AS status, length, CAST(mtime AS VARCHAR) AS mtime FROM listing
    UNION ALL SELECT path, id, 'deleted', NULL, NULL FROM active""",
    "listing", "active",
)
def i7_diff_listing_forced(spark, sf):
    return flat(ingest.diff_listing(fx.listing(spark, sf), fx.media(spark, sf), force=True))


def _scan(spark, sf) -> tuple[Catalog, DataFrame, DataFrame]:
    c = fx.catalog(spark, sf)
    diff = materialize(ingest.diff_listing(fx.listing(spark, sf), c.media), "diff")
    read = diff.select("path").withColumn("file_hash", F.md5("path"))
    rows = ingest.new_media(diff.withColumn("id", F.col("id").cast("string")), read, "s1")
    # test ids are numbers: derive a number for new files as well
    number = F.when(F.col("id").rlike("^[0-9]+$"), F.col("id").cast("bigint")).otherwise(
        F.conv(F.substring("id", 1, 14), 16, 10).cast("bigint")
    )
    rows = materialize(rows.withColumn("id", number).withColumn("folder_id", F.split_part("path", F.lit("/"), F.lit(3))), "rows")
    return c, diff, rows


SCAN_SQL = """, gone AS (SELECT id FROM diff WHERE status IN ('changed', 'deleted')),
 left_members AS (SELECT * FROM members WHERE photo_id NOT IN (SELECT id FROM gone)),
 sizes AS (SELECT group_id, count(*) AS n FROM left_members GROUP BY 1),
 touched AS (SELECT DISTINCT group_id FROM members WHERE photo_id IN (SELECT id FROM gone)),
 doomed AS (SELECT group_id FROM touched LEFT JOIN sizes USING (group_id) WHERE coalesce(n, 0) <= 1)"""


@query(
    SCAN_SQL
    + """ SELECT path, id, file_size, file_hash, perceptual_hash, folder_id, CAST(modified_time AS VARCHAR) AS modified_time,
      CAST(taken_at AS VARCHAR) AS taken_at FROM media WHERE id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT path, id, length, md5(path), NULL, split_part(path, '/', 3), CAST(mtime AS VARCHAR), CAST(mtime AS VARCHAR)
      FROM diff WHERE status = 'changed'
    UNION ALL SELECT path, CAST('0x' || substr(md5('s1|' || path), 1, 14) AS BIGINT), length, md5(path), NULL, split_part(path, '/', 3),
      CAST(mtime AS VARCHAR), CAST(mtime AS VARCHAR) FROM diff WHERE status = 'new'""",
    "diff", "media", "members",
)
def i8_apply_scan_media(spark, sf):
    c, diff, rows = _scan(spark, sf)
    media = ingest.apply_scan(c, diff, rows).media
    return flat(
        media.select("path", "id", "file_size", "file_hash", "perceptual_hash", "folder_id", "modified_time", "taken_at")
    )


@query(
    SCAN_SQL
    + " SELECT group_id, photo_id FROM left_members WHERE group_id NOT IN (SELECT group_id FROM doomed)",
    "diff", "members",
)
def i8_apply_scan_members(spark, sf):
    c, diff, rows = _scan(spark, sf)
    return ingest.apply_scan(c, diff, rows).members.select("group_id", "photo_id")


@query(
    """SELECT split_part(path, '/', 3) AS folder_id, count(*) FILTER (status <> 'deleted') AS total,
    count(*) FILTER (status IN ('new', 'changed')) AS new_count, count(*) FILTER (status = 'unchanged') AS skipped,
    count(*) FILTER (status = 'deleted') AS deleted FROM diff GROUP BY 1""",
    "diff",
)
def i9_scan_summary(spark, sf):
    diff = ingest.diff_listing(fx.listing(spark, sf), fx.media(spark, sf))
    return ingest.scan_summary(diff, F.split_part("path", F.lit("/"), F.lit(3)))


@query(
    f"""SELECT f.id, f.path, count(a.id) FILTER (f.id <> 'src0') AS photo_count,
    CASE WHEN f.id <> 'src0' THEN '{NOW}' END AS last_scanned
    FROM (SELECT f.id, f.path FROM folders f) f LEFT JOIN active a ON a.folder_id = f.id GROUP BY ALL""",
    "folders", "active",
)
def i9_folder_scan_times(spark, sf):
    folders = fx.folders(spark, sf)
    done = folders.filter("id <> 'src0'")
    start = folders.withColumn("photo_count", F.lit(0).cast("bigint"))
    out = ingest.folder_scan_times(start, fx.media(spark, sf), done, F.lit(NOW).cast("timestamp_ntz"))
    return flat(out.select("id", "path", "photo_count", "last_scanned"))


@query(
    """, v AS (SELECT *, CASE WHEN len(gps_lat) >= 3 THEN (gps_lat[1] + gps_lat[2] / 60 + gps_lat[3] / 3600) * CASE WHEN gps_lat_ref = 'S' THEN -1 ELSE 1 END END AS la,
      CASE WHEN len(gps_lon) >= 3 THEN (gps_lon[1] + gps_lon[2] / 60 + gps_lon[3] / 3600) * CASE WHEN gps_lon_ref = 'W' THEN -1 ELSE 1 END END AS lo,
      trim(make || ' ' || model) AS cam FROM tags)
    SELECT id, CAST(coalesce(dt_original, dt_create, alt_dt_original) AS VARCHAR) AS taken_at,
      round(CASE WHEN la IS NULL AND lo IS NULL THEN alt_lat ELSE la END, 6)::DOUBLE + 0.0 AS latitude,
      round(CASE WHEN la IS NULL AND lo IS NULL THEN alt_lon ELSE lo END, 6)::DOUBLE + 0.0 AS longitude,
      CASE WHEN exif_width <> 0 THEN exif_width WHEN image_width <> 0 THEN image_width ELSE decoder_width END::INT AS width,
      CASE WHEN cam <> '' THEN cam END AS camera, CASE WHEN f_number <> 0 THEN 'f/' || f_number END AS aperture,
      CASE WHEN exposure >= 1 THEN CAST(exposure AS BIGINT) || 's' WHEN exposure > 0 THEN '1/' || CAST(round(1 / exposure) AS BIGINT) || 's' END AS shutter_speed,
      CASE WHEN iso <> 0 THEN iso END AS iso,
      CASE WHEN focal_length <> 0 THEN replace(focal_length::VARCHAR || 'mm', '.0mm', 'mm') END AS focal_length FROM v""",
    "tags",
)
def i10_normalize_tags(spark, sf):
    out = tags.normalize_tags(fx.tags(spark, sf)).drop("height")
    out = rounded(flat(out), "latitude", "longitude")
    return out.withColumns({c: F.col(c) + 0.0 for c in ("latitude", "longitude")})


@query(
    """SELECT id, CAST(CASE WHEN media_type = 'video' THEN modified_time ELSE coalesce(taken_at, modified_time) END AS VARCHAR) AS taken FROM media""",
    "media",
)
def i11_default_taken_at(spark, sf):
    rows = fx.media(spark, sf)
    return flat(
        rows.select(
            "id", ingest.default_taken_at(F.col("media_type"), F.col("taken_at"), F.col("modified_time")).alias("taken")
        )
    )


OVERLAP_SQL = """, cand AS (SELECT DISTINCT CASE doc_id % 8 WHEN 0 THEN '/lib' WHEN 1 THEN '/lib/' || source || '/' || lang WHEN 2 THEN '/lib/' || source
   WHEN 3 THEN '/lib/' || source || '/' WHEN 4 THEN '\\lib\\' || source || '\\deep' WHEN 5 THEN '/lib/' || left(source, 3)
   WHEN 6 THEN '/lib/.media-trash/' || source ELSE '/other/' || source END AS path FROM documents),
 n AS (SELECT path, rtrim(replace(path, '\\', '/'), '/') AS norm FROM cand),
 j AS (SELECT n.path, n.norm, f.id AS folder_id, n.path = f.path AS same, starts_with(n.norm, f.path || '/') AS child,
   starts_with(f.path, n.norm || '/') AS parent FROM n LEFT JOIN folders f ON n.path = f.path OR starts_with(n.norm, f.path || '/')
   OR starts_with(f.path, n.norm || '/'))
 SELECT path, CASE WHEN same THEN 'same' WHEN norm LIKE '%/.media-trash/%' THEN 'trash' WHEN child THEN 'child' WHEN parent THEN 'parent'
   ELSE 'new' END AS verdict, CASE WHEN norm NOT LIKE '%/.media-trash/%' THEN folder_id END AS folder_id FROM j"""


def _overlap(spark, sf):
    cand = fx.table(spark, sf, "documents").selectExpr(
        r"""case doc_id % 8 when 0 then '/lib' when 1 then concat('/lib/', source, '/', lang) when 2 then concat('/lib/', source)
            when 3 then concat('/lib/', source, '/') when 4 then concat('\\lib\\', source, '\\deep')
            when 5 then concat('/lib/', left(source, 3)) when 6 then concat('/lib/.media-trash/', source)
            else concat('/other/', source) end as path"""
    )
    return ingest.folder_overlap(fx.folders(spark, sf), cand)


@query(OVERLAP_SQL, "folders")
def i13_folder_overlap(spark, sf):
    return _overlap(spark, sf)


@query(OVERLAP_SQL, "folders")
def j9_folder_overlap(spark, sf):
    return _overlap(spark, sf)


@query("SELECT id, path, file_hash FROM active WHERE regexp_full_match(file_hash, '[A-Fa-f0-9]{32}')", "active")
def i16_legacy_hashes(spark, sf):
    return ingest.legacy_hashes(fx.media(spark, sf))


@query(
    """SELECT id, CASE WHEN deleted_at IS NULL AND regexp_full_match(file_hash, '[A-Fa-f0-9]{32}') THEN sha256(path) ELSE file_hash END AS file_hash
    FROM media""",
    "media",
)
def i16_rehash_legacy(spark, sf):
    media = fx.media(spark, sf)
    fresh = media.select("path", F.sha2("path", 256).alias("file_hash"))
    return ingest.rehash_legacy(media, fresh).select("id", "file_hash")


@query(
    """, batch AS (SELECT CASE WHEN id % 6 = 0 THEN id ELSE 1000000 + id // 2 END AS id, CASE WHEN id % 5 = 0 THEN path ELSE '/n/' || (id // 3) END AS path,
      id AS seq, file_size FROM media),
    free AS (SELECT * FROM batch WHERE id NOT IN (SELECT id FROM media) AND path NOT IN (SELECT path FROM media)),
    picked AS (SELECT seq, id, path, file_size FROM free f WHERE seq IN (SELECT seq FROM greedy))
    SELECT id, path, file_size FROM media UNION ALL SELECT id, path, file_size FROM picked""".replace(
        "picked AS",
        """greedy AS (WITH RECURSIVE ordered AS (SELECT *, row_number() OVER (ORDER BY seq) AS r FROM free),
      g(r, ids, paths, seq) AS (SELECT 0::BIGINT, []::BIGINT[], []::VARCHAR[], -1::BIGINT UNION ALL
        SELECT o.r, CASE WHEN ok THEN list_append(ids, o.id) ELSE ids END, CASE WHEN ok THEN list_append(paths, o.path) ELSE paths END,
          CASE WHEN ok THEN o.seq ELSE -1 END
        FROM (SELECT o.*, g.ids, g.paths, NOT list_contains(g.ids, o.id) AND NOT list_contains(g.paths, o.path) AS ok
          FROM g JOIN ordered o ON o.r = g.r + 1) o)
      SELECT seq FROM g WHERE seq >= 0), picked AS""",
    ),
    "media",
)
def k1_insert_ignore(spark, sf):
    media = fx.media(spark, sf)
    batch = media.selectExpr(
        "case when id % 6 = 0 then id else 1000000 + id div 2 end as id",
        "case when id % 5 = 0 then path else concat('/n/', id div 3) end as path",
        "id as seq",
        "file_size",
    )
    return ingest.insert_ignore(media, batch, "seq").select("id", "path", "file_size")


@query(
    """, batch AS (SELECT vec_id * 2 AS photo_id, embedding, 'm2' AS model, TIMESTAMP '2024-03-01' + to_seconds(vec_id) AS updated_at FROM embeddings
      UNION ALL SELECT vec_id * 2, list_reverse(embedding), 'm3', TIMESTAMP '2024-04-01' FROM embeddings WHERE label < 4),
    latest AS (SELECT *, min(updated_at) OVER (PARTITION BY photo_id) AS first_at FROM batch
      QUALIFY row_number() OVER (PARTITION BY photo_id ORDER BY updated_at DESC) = 1)
    SELECT photo_id, round(coalesce(l.embedding, v.embedding)[1]::DOUBLE, 6) AS head, coalesce(l.model, v.model) AS model,
      CAST(coalesce(v.created_at, l.first_at) AS VARCHAR) AS created_at, CAST(coalesce(l.updated_at, v.updated_at) AS VARCHAR) AS updated_at
    FROM vectors v FULL JOIN latest l USING (photo_id)""",
    "vectors",
)
def k2_upsert_embeddings(spark, sf):
    rows = fx.table(spark, sf, "embeddings")
    one = rows.selectExpr(
        "vec_id * 2 as photo_id", "embedding", "'m2' as model",
        "timestamp_ntz'2024-03-01 00:00:00' + make_dt_interval(0, 0, 0, cast(vec_id as decimal(18, 6))) as updated_at",
    )
    two = rows.filter("label < 4").selectExpr(
        "vec_id * 2 as photo_id", "reverse(embedding) as embedding", "'m3' as model", "timestamp_ntz'2024-04-01 00:00:00' as updated_at"
    )
    out = ingest.upsert_embeddings(fx.embeddings(spark, sf), one.unionByName(two))
    return flat(
        out.select("photo_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("head"), "model", "created_at", "updated_at")
    )


@query(
    """SELECT id, CASE WHEN deleted_at IS NULL AND id IN (SELECT doc_id FROM labels) THEN sha256(path) ELSE perceptual_hash END AS perceptual_hash FROM media""",
    "media",
)
def k5_hash_backfill(spark, sf):
    media = fx.media(spark, sf)
    labelled = fx.table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    updates = media.join(labelled, "id", "left_semi").select("id", F.sha2("path", 256).alias("perceptual_hash"))
    return ingest.hash_backfill(media, updates, "perceptual_hash").select("id", "perceptual_hash")


@query(
    """SELECT id, CASE WHEN deleted_at IS NULL AND id IN (SELECT doc_id FROM labels) THEN
      CASE WHEN id % 2 = 0 THEN md5(path) ELSE sha256(path) END ELSE perceptual_hash END AS perceptual_hash FROM media""",
    "media",
)
def k5_hash_backfill_rivals(spark, sf):
    """Up to three updates of a file: the last one counts, but not the one without a hash."""
    media = fx.media(spark, sf)
    labelled = fx.table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    rows = media.join(labelled, "id", "left_semi").select("id", "path")
    later = F.when(F.col("id") % 2 == 0, F.md5("path"))
    updates = rows.select("id", F.posexplode(F.array(F.sha2("path", 256), later, F.lit(None))).alias("turn", "perceptual_hash"))
    return ingest.hash_backfill(media, updates, "perceptual_hash", order="turn").select("id", "perceptual_hash")


@query(
    """SELECT group_id, photo_id FROM members WHERE photo_id NOT IN (SELECT id FROM active)""", "members", "active"
)
def j6_orphans(spark, sf):
    active = fx.media(spark, sf).filter("deleted_at is null")
    return audit.orphans(fx.members(spark, sf), active).select("group_id", "photo_id")


@query(
    f"""SELECT id, CASE WHEN h THEN '/t/' || id ELSE path END AS path, CASE WHEN h THEN path ELSE original_path END AS original_path,
    CASE WHEN h THEN '/t/' || id ELSE trash_path END AS trash_path, CAST(CASE WHEN h THEN TIMESTAMP '{NOW}' ELSE deleted_at END AS VARCHAR) AS deleted_at
    FROM (SELECT *, deleted_at IS NULL AND id IN (SELECT doc_id FROM labels) AS h FROM media)""",
    "media",
)
def m1_trash(spark, sf):
    entries = fx.table(spark, sf, "labels").selectExpr("doc_id as id", "concat('/t/', doc_id) as trash_path")
    out = maintain.trash(fx.media(spark, sf), entries, NOW)
    return flat(out.select("id", "path", "original_path", "trash_path", "deleted_at"))


@query(
    """, asked AS (SELECT DISTINCT doc_id AS id FROM labels UNION SELECT -1 - doc_id FROM labels)
    SELECT asked.id, CASE WHEN m.id IS NULL THEN 'unknown' WHEN m.deleted_at IS NULL THEN 'moved' ELSE 'already trashed' END AS outcome
    FROM asked LEFT JOIN media m ON m.id = asked.id""",
    "media",
)
def m1_trash_results(spark, sf):
    entries = fx.table(spark, sf, "labels").select(F.explode(F.array("doc_id", -1 - F.col("doc_id"))).alias("id"))
    return maintain.trash_results(fx.media(spark, sf), entries)


def _restored(spark, sf):
    entries = fx.table(spark, sf, "labels").selectExpr("doc_id as id", "concat('/r/', doc_id) as restored_path")
    return maintain.restore(fx.media(spark, sf), entries)


@query(
    """SELECT id, CASE WHEN h THEN '/r/' || id ELSE path END AS path, CASE WHEN NOT h THEN original_path END AS original_path,
    CASE WHEN NOT h THEN trash_path END AS trash_path, CAST(CASE WHEN NOT h THEN deleted_at END AS VARCHAR) AS deleted_at
    FROM (SELECT *, deleted_at IS NOT NULL AND id IN (SELECT doc_id FROM labels) AS h FROM media)""",
    "media",
)
def m2_restore(spark, sf):
    return flat(_restored(spark, sf)[0].select("id", "path", "original_path", "trash_path", "deleted_at"))


@query(
    """SELECT id, '/r/' || id AS restored_path FROM media WHERE deleted_at IS NOT NULL AND id IN (SELECT doc_id FROM labels)""",
    "media",
)
def m2_restored_rows(spark, sf):
    return _restored(spark, sf)[1]


RESTORE_SQL = """, want AS (SELECT *, stem || ext AS target FROM (SELECT doc_id AS id,
     '/lib/' || source || '/' || CASE WHEN doc_id % 4 = 3 THEN lang || '.v2' ELSE lang END AS stem,
     CASE WHEN doc_id % 9 = 0 THEN '' ELSE '.jpg' END AS ext FROM documents)),
 taken AS (SELECT DISTINCT target AS path FROM want WHERE id % 5 = 0
   UNION SELECT stem || ' (' || (1 + id % 4) || ')' || ext FROM want WHERE id % 3 = 0),
 base AS (SELECT * EXCLUDE (ext), regexp_extract(target, '\\.[^./]*$') AS ext, row_number() OVER (PARTITION BY target ORDER BY id) - 1
    + CASE WHEN target IN (SELECT path FROM taken) THEN 1 ELSE 0 END AS slot FROM want),
 names AS (SELECT target, max(slot) AS top FROM base GROUP BY 1),
 num AS (SELECT target, unnest(range(1, top + 6)) AS n FROM names),
 free AS (SELECT target, cand, row_number() OVER (PARTITION BY target ORDER BY n) AS slot FROM
   (SELECT target, n, left(target, length(target) - length(regexp_extract(target, '\\.[^./]*$'))) || ' (' || n || ')'
      || regexp_extract(target, '\\.[^./]*$') AS cand FROM num) WHERE cand NOT IN (SELECT path FROM taken) AND cand NOT IN (SELECT target FROM want))
 SELECT b.id, CASE WHEN b.slot = 0 THEN b.target ELSE cand END AS restored_path FROM base b LEFT JOIN free f ON f.target = b.target AND f.slot = b.slot"""


@query(RESTORE_SQL, "folders")
def m3_restore_paths(spark, sf):
    want = (
        fx.table(spark, sf, "documents")
        .selectExpr(
            "doc_id as id",
            "concat('/lib/', source, '/', case when doc_id % 4 = 3 then concat(lang, '.v2') else lang end) as stem",
            "case when doc_id % 9 = 0 then '' else '.jpg' end as ext",
        )
        .withColumn("target", F.concat("stem", "ext"))
    )
    taken = want.filter("id % 5 = 0").selectExpr("target as path").unionByName(
        want.filter("id % 3 = 0").selectExpr("concat(stem, ' (', 1 + id % 4, ')', ext) as path")
    )
    return maintain.restore_paths(want, taken)


PURGE_SQL = """, gone AS ({gone}),
 left_members AS (SELECT * FROM members WHERE photo_id NOT IN (SELECT id FROM gone)),
 sizes AS (SELECT group_id, count(*) AS n FROM left_members GROUP BY 1),
 touched AS (SELECT DISTINCT group_id FROM members WHERE photo_id IN (SELECT id FROM gone)),
 doomed AS (SELECT group_id FROM touched LEFT JOIN sizes USING (group_id) WHERE coalesce(n, 0) <= {threshold}),
 best AS (SELECT group_id, photo_id AS b FROM left_members m JOIN active ON id = photo_id
   WHERE group_id IN (SELECT group_id FROM touched)
   QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY """ + REPICK + """) = 1),
 kept_groups AS (SELECT group_id, reason, CASE WHEN b IS NOT NULL THEN b WHEN keeper_id NOT IN (SELECT id FROM gone) THEN keeper_id END AS keeper_id
   FROM groups LEFT JOIN best USING (group_id) WHERE group_id NOT IN (SELECT group_id FROM doomed)),
 kept_members AS (SELECT group_id, photo_id FROM left_members WHERE group_id NOT IN (SELECT group_id FROM doomed))"""
STATE_SQL = """ SELECT 'media' AS kind, NULL AS name, id FROM media WHERE id NOT IN (SELECT id FROM gone)
 UNION ALL SELECT 'member', group_id, photo_id FROM kept_members
 UNION ALL SELECT 'group', group_id, keeper_id FROM kept_groups
 UNION ALL SELECT 'vector', model, photo_id FROM vectors WHERE photo_id NOT IN (SELECT id FROM gone)"""
LABELLED = "SELECT doc_id AS id FROM labels"


def _state(c: Catalog) -> DataFrame:
    """A catalogue as one flat table."""
    parts = [
        c.media.select(F.lit("media").alias("kind"), F.lit(None).cast("string").alias("name"), "id"),
        c.members.select(F.lit("member"), "group_id", "photo_id"),
        c.groups.select(F.lit("group"), "group_id", "keeper_id"),
        c.embeddings.select(F.lit("vector"), "model", "photo_id"),
    ]
    return reduce(DataFrame.union, parts)


def _labelled(spark, sf):
    return fx.table(spark, sf, "labels").select("doc_id")


@query(PURGE_SQL.format(gone=LABELLED, threshold=1) + STATE_SQL, "members", "groups", "active", "vectors")
def m4_purge(spark, sf):
    return _state(maintain.purge(fx.catalog(spark, sf), _labelled(spark, sf))[0])


@query(
    PURGE_SQL.format(gone=LABELLED, threshold=1)
    + " SELECT group_id FROM touched WHERE group_id NOT IN (SELECT group_id FROM doomed)",
    "members", "groups", "active",
)
def m4_purge_survivors(spark, sf):
    return maintain.purge(fx.catalog(spark, sf), _labelled(spark, sf))[1]


@query(
    PURGE_SQL.format(gone=LABELLED + " WHERE doc_id IN (SELECT id FROM media WHERE deleted_at IS NOT NULL)", threshold=1) + STATE_SQL,
    "members", "groups", "active", "vectors",
)
def m4_purge_only_trashed(spark, sf):
    return _state(maintain.purge(fx.catalog(spark, sf), _labelled(spark, sf), only_trashed=True)[0])


FOLDER_SQL = "SELECT id FROM media WHERE folder_id IN ('src1', 'src2', 'src3')"
FOLDERS = ["src1", "src2", "src3"]


@query(
    PURGE_SQL.format(gone=FOLDER_SQL, threshold=1) + STATE_SQL + " UNION ALL SELECT 'folder', id, NULL FROM folders WHERE id NOT IN ('src1', 'src2', 'src3')",
    "members", "groups", "active", "vectors", "folders",
)
def m5_remove_folder(spark, sf):
    c = maintain.remove_folder(fx.catalog(spark, sf), FOLDERS)
    return _state(c).union(c.folders.select(F.lit("folder"), "id", F.lit(None).cast("bigint")))


@query(PURGE_SQL.format(gone=FOLDER_SQL, threshold=0) + STATE_SQL, "members", "groups", "active", "vectors")
def m5_delete_folder_media(spark, sf):
    return _state(maintain.delete_folder_media(fx.catalog(spark, sf), FOLDERS))


@query(
    """SELECT id, path, CAST(added_at AS VARCHAR) AS added_at FROM folders WHERE id NOT IN ('src1', 'src2', 'src3')
    UNION ALL SELECT 'parent', '/lib', '2026-01-01 12:00:00'""",
    "folders",
)
def m5_replace_with_parent(spark, sf):
    c = maintain.replace_with_parent(fx.catalog(spark, sf), FOLDERS, "parent", "/lib", NOW)
    return flat(c.folders)


@query(
    PURGE_SQL.format(gone="SELECT id FROM media WHERE deleted_at IS NOT NULL", threshold=1) + STATE_SQL,
    "members", "groups", "active", "vectors",
)
def m6_empty_trash(spark, sf):
    return _state(maintain.empty_trash(fx.catalog(spark, sf))[0])


PRUNE_SQL = ", sizes AS (SELECT group_id, count(*) AS n FROM members GROUP BY 1)"


@query(
    PRUNE_SQL
    + """ SELECT 'group' AS kind, group_id FROM groups JOIN sizes USING (group_id) WHERE n > 3
    UNION ALL SELECT 'member', group_id FROM members WHERE group_id IN (SELECT group_id FROM sizes WHERE n > 3)
    UNION ALL SELECT 'kept', group_id FROM sizes WHERE n > 3""",
    "members", "groups",
)
def m7_prune_groups(spark, sf):
    left_groups, left_members, kept = maintain.prune_groups(fx.groups(spark, sf), fx.members(spark, sf), 3)
    tag = lambda df, name: df.select(F.lit(name).alias("kind"), "group_id")
    return tag(left_groups, "group").union(tag(left_members, "member")).union(tag(kept, "kept"))


@query(
    f"""SELECT id, CAST(CASE WHEN h THEN TIMESTAMP '2020-05-05' + to_seconds(id) ELSE taken_at END AS VARCHAR) AS taken_at,
    CASE WHEN h THEN '{NOW}' END AS updated_at FROM (SELECT *, deleted_at IS NULL AND id IN (SELECT doc_id FROM labels) AS h FROM media)""",
    "media",
)
def m8_update_date(spark, sf):
    edits = fx.table(spark, sf, "labels").selectExpr(
        "doc_id as id", "timestamp_ntz'2020-05-05 00:00:00' + make_dt_interval(0, 0, 0, cast(doc_id as decimal(18, 6))) as taken_at"
    )
    return flat(maintain.update_date(fx.media(spark, sf), edits, NOW).select("id", "taken_at", "updated_at"))


@query("SELECT photo_id, model FROM vectors WHERE photo_id NOT IN (SELECT doc_id FROM labels)", "vectors")
def m9_drop_vectors(spark, sf):
    return maintain.drop_vectors(fx.embeddings(spark, sf), _labelled(spark, sf)).select("photo_id", "model")


@query(
    """, bad AS (SELECT id, CASE WHEN id % 40 = 0 THEN 'audio' ELSE media_type END AS media_type,
      CASE WHEN id % 30 = 0 THEN '/same' ELSE path END AS path FROM active WHERE id % 50 <> 7
      UNION ALL SELECT id, media_type, '/again/' || id FROM active WHERE id % 70 = 3 AND id % 50 <> 7),
    bad_groups AS (SELECT group_id, CASE WHEN keeper_id % 20 = 0 THEN 'odd' ELSE reason END AS reason,
      CASE WHEN keeper_id % 9 = 0 THEN -1 ELSE keeper_id END AS keeper_id FROM groups WHERE coalesce(keeper_id, 0) % 13 <> 5),
    bad_members AS (SELECT * FROM members WHERE photo_id % 5 <> 1)
    SELECT 'vector without media' AS problem, photo_id::VARCHAR AS key FROM vectors WHERE photo_id NOT IN (SELECT id FROM bad)
    UNION ALL SELECT 'member without media', photo_id::VARCHAR FROM bad_members WHERE photo_id NOT IN (SELECT id FROM bad)
    UNION ALL SELECT 'member without group', photo_id::VARCHAR FROM bad_members WHERE group_id NOT IN (SELECT group_id FROM bad_groups)
    UNION ALL SELECT 'repeated id', id::VARCHAR FROM bad GROUP BY id HAVING count(*) > 1
    UNION ALL SELECT 'repeated path', path FROM bad GROUP BY path HAVING count(*) > 1
    UNION ALL SELECT 'unknown media type', id::VARCHAR FROM bad WHERE media_type NOT IN ('image', 'video')
    UNION ALL SELECT 'unknown reason', group_id FROM bad_groups WHERE reason NOT IN ('exact', 'similar')
    UNION ALL SELECT 'group below two', group_id FROM bad_groups g WHERE (SELECT count(*) FROM bad_members m WHERE m.group_id = g.group_id) < 2
    UNION ALL SELECT 'keeper not a member', group_id FROM bad_groups g WHERE keeper_id IS NOT NULL AND NOT EXISTS
      (SELECT 1 FROM bad_members m WHERE m.group_id = g.group_id AND m.photo_id = g.keeper_id)""",
    "active", "groups", "members", "vectors",
)
def m10_audit(spark, sf):
    """A catalogue damaged in every checked way."""
    c = fx.catalog(spark, sf)
    active = c.media.filter("deleted_at is null and id % 50 <> 7")
    media = active.selectExpr(
        "id", "case when id % 40 = 0 then 'audio' else media_type end as media_type",
        "case when id % 30 = 0 then '/same' else path end as path",
    ).unionByName(active.filter("id % 70 = 3").selectExpr("id", "media_type", "concat('/again/', id) as path"))
    heads = c.groups.filter("coalesce(keeper_id, 0) % 13 <> 5").selectExpr(
        "group_id", "case when keeper_id % 20 = 0 then 'odd' else reason end as reason",
        "case when keeper_id % 9 = 0 then -1L else keeper_id end as keeper_id",
    )
    return audit.audit(Catalog(media, heads, c.members.filter("photo_id % 5 <> 1"), c.embeddings))


@query(
    """, edits AS (SELECT event_id AS id, (event_id % 191 - 95)::DOUBLE AS lat, (event_id % 371 - 185)::DOUBLE AS lon FROM events),
    good AS (SELECT * FROM edits WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180)
    SELECT m.id, CASE WHEN h THEN lat ELSE latitude END AS latitude, CASE WHEN h THEN lon ELSE longitude END AS longitude,
      CASE WHEN h THEN '2026-01-01 12:00:00' END AS updated_at
    FROM (SELECT m.*, g.lat, g.lon, g.id IS NOT NULL AND deleted_at IS NULL AS h FROM media m LEFT JOIN good g ON g.id = m.id) m""",
    "media",
)
def g5_update_location(spark, sf):
    edits = fx.table(spark, sf, "events").selectExpr(
        "event_id as id", "cast(event_id % 191 - 95 as double) as latitude", "cast(event_id % 371 - 185 as double) as longitude"
    )
    out, _ = maintain.update_location(fx.media(spark, sf), edits, NOW)
    return flat(out.select("id", "latitude", "longitude", "updated_at"))


@query(
    """SELECT m.id, CASE WHEN h THEN (id % 80)::DOUBLE ELSE latitude END AS latitude, CASE WHEN h THEN (-(id % 90))::DOUBLE ELSE longitude END AS longitude
    FROM (SELECT *, deleted_at IS NULL AND id IN (SELECT event_id FROM events) AS h FROM media) m""",
    "media",
)
def g5_update_location_rivals(spark, sf):
    """Three edits of a place: the second is the last valid one."""
    edits = fx.table(spark, sf, "events").selectExpr(
        "event_id as id",
        """inline(array(struct(1 as turn, -80D as latitude, -170D as longitude), struct(2 as turn, cast(event_id % 80 as double) as latitude, cast(-(event_id % 90) as double) as longitude),
           struct(3 as turn, 100D as latitude, 0D as longitude)))""",
    )
    out, _ = maintain.update_location(fx.media(spark, sf), edits, NOW, order="turn")
    return out.select("id", "latitude", "longitude")


@query(
    """SELECT count(*) AS updated FROM active JOIN events ON event_id = id WHERE event_id % 191 - 95 BETWEEN -90 AND 90
    AND event_id % 371 - 185 BETWEEN -180 AND 180""",
    "active",
)
def g5_update_location_count(spark, sf):
    edits = fx.table(spark, sf, "events").selectExpr(
        "event_id as id", "cast(event_id % 191 - 95 as double) as latitude", "cast(event_id % 371 - 185 as double) as longitude"
    )
    return maintain.update_location(fx.media(spark, sf), edits, NOW)[1]
