"""Filters, pages, timelines, statistics and the map."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from mediacat.functions import geo
from mediacat.functions import paths as path_functions
from mediacat.operators import browse, filters, groups, mapview, stats
from mediacat.operators.filters import MediaFilter
from mediacat.plans import fixtures as fx
from mediacat.plans.registry import flat, query, rounded
from mediacat.runtime import materialize
from mediacat.sources import listing as listing_source
from mediacat.sources import thumbnails

LIST_SQL = """id, folder_id, path, filename, file_size, CAST(taken_at AS VARCHAR) AS taken_at, latitude, longitude,
width, height, camera, media_type, duration, frame_hash, CAST(deleted_at AS VARCHAR) AS deleted_at, original_path, trash_path"""
PLACE_SQL = """id, path, filename, latitude, longitude, CAST(taken_at AS VARCHAR) AS taken_at, camera, width, height, file_size"""


@query(f"SELECT {LIST_SQL} FROM media", "media")
def f1_list_columns(spark, sf):
    return flat(filters.list_columns(fx.media(spark, sf)))


@query(
    f"""SELECT {LIST_SQL} FROM active WHERE taken_at >= TIMESTAMP '2023-03-01' AND taken_at <= TIMESTAMP '2024-06-30'
    AND latitude IS NOT NULL AND longitude IS NOT NULL AND camera = 'Make 3' AND media_type = 'image'""",
    "active",
)
def f2_filter_media(spark, sf):
    f = MediaFilter(
        folder_id="", date_start="2023-03-01", date_end="2024-06-30", has_location=True, camera="Make 3", media_type="image"
    )
    return flat(filters.list_columns(filters.filter_media(fx.media(spark, sf), f)))


@query(f"SELECT {LIST_SQL} FROM active WHERE latitude IS NULL OR longitude IS NULL", "active")
def f2_filter_without_location(spark, sf):
    f = MediaFilter(has_location=False, media_type="all")
    return flat(filters.list_columns(filters.filter_media(fx.media(spark, sf), f)))


@query(
    "SELECT 'active' AS state, id FROM media WHERE deleted_at IS NULL UNION ALL SELECT 'trashed', id FROM media WHERE deleted_at IS NOT NULL",
    "media",
)
def f3_active_trashed(spark, sf):
    rows = fx.media(spark, sf)
    state = lambda df, name: df.select(F.lit(name).alias("state"), "id")
    return state(filters.active(rows), "active").unionByName(state(filters.trashed(rows), "trashed"))


@query(f"SELECT {LIST_SQL} FROM active WHERE id IN (SELECT vec_id FROM embeddings)", "active")
def f4_by_ids(spark, sf):
    ids = fx.table(spark, sf, "embeddings").select("vec_id")
    return flat(filters.list_columns(filters.by_ids(fx.media(spark, sf), ids)))


@query(f"SELECT {LIST_SQL} FROM media WHERE deleted_at IS NOT NULL AND id IN (SELECT doc_id FROM labels)", "media")
def f4_by_ids_trashed(spark, sf):
    ids = fx.table(spark, sf, "labels").select("doc_id")
    return flat(filters.list_columns(filters.by_ids(fx.media(spark, sf), ids, trashed_rows=True)))


@query(
    """SELECT id, path, file_hash, file_size, CAST(modified_time AS VARCHAR) AS modified_time FROM active
    WHERE path IN (SELECT path FROM listing)""",
    "active", "listing",
)
def f5_by_paths(spark, sf):
    return flat(filters.by_paths(fx.media(spark, sf), fx.listing(spark, sf).select("path")))


@query("SELECT id, path FROM active WHERE folder_id = 'src3'", "active")
def f6_by_folder(spark, sf):
    return filters.by_folder(fx.media(spark, sf), "src3").select("id", "path")


@query("SELECT id, path FROM active WHERE folder_id = 'src3' ORDER BY id LIMIT 5 OFFSET 2", "active")
def f6_folder_paths(spark, sf):
    return filters.folder_paths(fx.media(spark, sf), "src3", 5, 2)


@query(f"SELECT {PLACE_SQL} FROM active WHERE latitude IS NOT NULL AND longitude IS NOT NULL", "active")
def f7_with_location(spark, sf):
    return flat(filters.with_location(fx.media(spark, sf)))


@query(
    f"SELECT {PLACE_SQL} FROM active WHERE latitude BETWEEN -45.5 AND 60 AND longitude BETWEEN -120 AND 100.25", "active"
)
def f8_in_bounds(spark, sf):
    return flat(filters.in_bounds(fx.media(spark, sf), -45.5, -120, 60, 100.25))


@query(
    f"""SELECT {PLACE_SQL} FROM active WHERE latitude BETWEEN -45.5 AND 60
    AND (longitude BETWEEN 150 AND 180 OR longitude BETWEEN -180 AND -150)""",
    "active",
)
def f8_in_bounds_antimeridian(spark, sf):
    return flat(filters.in_bounds(fx.media(spark, sf), -45.5, 150, 60, -150, split_antimeridian=True))


@query(
    """SELECT event_id AS id, value * 10 - 50 AS lat, value * 20 - 100 AS lon FROM events
    WHERE value * 10 - 50 BETWEEN -90 AND 90 AND value * 20 - 100 BETWEEN -180 AND 180"""
)
def f10_valid_coords(spark, sf):
    rows = fx.table(spark, sf, "events").selectExpr("event_id as id", "value * 10 - 50 as lat", "value * 20 - 100 as lon")
    return filters.valid_coords(rows, "lat", "lon")


@query(
    "SELECT id, perceptual_hash FROM active WHERE perceptual_hash IS NOT NULL AND perceptual_hash <> repeat('0', 64)",
    "active",
)
def f11_usable_phash(spark, sf):
    return filters.usable_phash(fx.media(spark, sf)).select("id", "perceptual_hash")


@query(
    """SELECT coalesce(strftime(taken_at, '%Y-%m'), 'unknown') AS key, count(*) AS "count",
    CAST(min(taken_at) AS VARCHAR) AS first_date FROM active GROUP BY 1""",
    "active",
)
def a1_timeline(spark, sf):
    return flat(browse.timeline(fx.media(spark, sf)))


@query(
    """SELECT coalesce(strftime(taken_at, '%Y-%m'), 'unknown') AS key, count(*) AS "count",
    coalesce(year(min(taken_at)) || '年' || month(min(taken_at)) || '月', '未知时间') AS label FROM active GROUP BY 1""",
    "active",
)
def a1_timeline_labels(spark, sf):
    return browse.timeline_labels(browse.timeline(fx.media(spark, sf))).drop("first_date")


@query(
    """SELECT coalesce(strftime(taken_at, '%Y-%m'), 'unknown') AS key, count(*) AS "count",
    CAST(min(taken_at) AS VARCHAR) AS first_date FROM shipments WHERE folder_id = 'R' AND camera = 'F' GROUP BY 1""",
    "shipments",
)
def a1_timeline_filtered(spark, sf):
    return flat(browse.timeline(fx.shipments(spark, sf), MediaFilter(folder_id="R", camera="F")))


@query(
    """SELECT strftime(taken_at, '%Y-%m-%d') AS key, count(*) AS "count", CAST(min(taken_at) AS VARCHAR) AS first_date
    FROM shots GROUP BY 1""",
    "shots",
)
def a1_timeline_by_day(spark, sf):
    return flat(browse.timeline(fx.shots(spark, sf), unit="day"))


STATS_SQL = """SELECT (SELECT count(*) FROM active) AS total,
 (SELECT count(*) FROM active WHERE latitude IS NOT NULL AND longitude IS NOT NULL) AS with_location,
 (SELECT count(*) FROM active WHERE latitude IS NULL OR longitude IS NULL) AS without_location,
 (SELECT count(DISTINCT photo_id) FROM members m {only} WHERE NOT EXISTS (SELECT 1 FROM groups g
   WHERE g.group_id = m.group_id AND g.keeper_id = m.photo_id)) AS duplicates,
 (SELECT count(*) FROM folders) AS folders"""


@query(STATS_SQL.format(only=""), "active", "members", "groups", "folders")
def a2_library_stats(spark, sf):
    c = fx.catalog(spark, sf)
    return stats.library_stats(c.media, c.groups, c.members, c.folders)


@query(STATS_SQL.format(only="JOIN active a ON a.id = m.photo_id"), "active", "members", "groups", "folders")
def a2_library_stats_active_only(spark, sf):
    c = fx.catalog(spark, sf)
    return stats.library_stats(c.media, c.groups, c.members, c.folders, active_only=True)


@query(
    """SELECT camera, count(*) AS "count" FROM active WHERE camera IS NOT NULL GROUP BY camera
    ORDER BY count(*) DESC, camera LIMIT 4""",
    "active",
)
def a3_top_cameras(spark, sf):
    return stats.top_cameras(fx.media(spark, sf), 4)


@query(
    """SELECT count(*) AS "count", CAST(coalesce(sum(file_size), 0) AS BIGINT) AS total_size FROM media WHERE deleted_at IS NOT NULL""",
    "media",
)
def a4_trash_stats(spark, sf):
    return stats.trash_stats(fx.media(spark, sf))


@query("""SELECT folder_id, count(*) AS "count" FROM active GROUP BY 1""", "active")
def a5_folder_counts(spark, sf):
    return stats.folder_counts(fx.media(spark, sf))


@query("""SELECT model, count(*) AS "count" FROM vectors GROUP BY 1""", "vectors")
def a5_vector_counts(spark, sf):
    return stats.vector_counts(fx.embeddings(spark, sf))


@query(
    """SELECT i AS images, v AS vectors, round(v::DOUBLE / i, 6) AS progress FROM
    (SELECT count(*) AS i FROM active WHERE media_type = 'image'), (SELECT count(*) AS v FROM vectors WHERE model = 'm1')""",
    "active", "vectors",
)
def a5_index_progress(spark, sf):
    return rounded(stats.index_progress(fx.media(spark, sf), fx.embeddings(spark, sf), "m1"), "progress")


@query("""SELECT group_id, count(*) AS "count" FROM members GROUP BY 1""", "members")
def a6_group_sizes(spark, sf):
    return groups.group_sizes(fx.members(spark, sf))


@query(
    f"SELECT {LIST_SQL} FROM active WHERE media_type = 'image' ORDER BY active.taken_at DESC NULLS LAST, id LIMIT 40 OFFSET 100", "active"
)
def p1_browse(spark, sf):
    return flat(browse.browse(fx.media(spark, sf), MediaFilter(media_type="image", limit=40, offset=100)))


@query(
    """SELECT id, CAST(taken_at AS VARCHAR) AS taken_at FROM shipments ORDER BY shipments.taken_at DESC, id LIMIT 500 OFFSET 20000""",
    "shipments",
)
def p1_browse_deep(spark, sf):
    """A page far down the list: cut by global position."""
    return flat(browse.browse(fx.shipments(spark, sf), MediaFilter(limit=500, offset=20000)).select("id", "taken_at"))


@query(f"SELECT {LIST_SQL} FROM active ORDER BY active.taken_at DESC NULLS LAST, id OFFSET 700", "active")
def p1_browse_offset_only(spark, sf):
    return flat(browse.browse(fx.media(spark, sf), MediaFilter(offset=700)))


@query(
    f"""SELECT {LIST_SQL}, (SELECT count(*) FROM active WHERE camera = 'Make 2') AS total,
    (SELECT count(*) FROM active WHERE camera = 'Make 2') > 60 AS has_more FROM active WHERE camera = 'Make 2'
    ORDER BY active.taken_at DESC NULLS LAST, id LIMIT 50 OFFSET 10""",
    "active",
)
def p2_browse_page(spark, sf):
    return flat(browse.browse_page(fx.media(spark, sf), MediaFilter(camera="Make 2", limit=50, offset=10)))


@query("SELECT count(*) AS total FROM active WHERE camera = 'Make 2'", "active")
def p2_browse_total(spark, sf):
    return browse.browse_total(fx.media(spark, sf), MediaFilter(camera="Make 2", limit=50, offset=100_000))


@query(
    """SELECT (SELECT count(*) FROM shipments WHERE taken_at > (SELECT max(taken_at) FROM shipments
    WHERE strftime(taken_at, '%Y-%m') = '1996-12')) AS "offset" """,
    "shipments",
)
def p3_month_offset(spark, sf):
    return browse.month_offset(fx.shipments(spark, sf), "1996-12")


@query("""SELECT count(*) FILTER (taken_at IS NOT NULL) AS "offset" FROM active WHERE media_type = 'image'""", "active")
def p3_month_offset_unknown(spark, sf):
    return browse.month_offset(fx.media(spark, sf), "unknown", MediaFilter(media_type="image"))


@query(
    """SELECT id, perceptual_hash, file_size FROM active WHERE perceptual_hash IS NOT NULL AND id > 50 ORDER BY id LIMIT 200""",
    "active",
)
def p4_keyset_page(spark, sf):
    return browse.keyset_page(fx.media(spark, sf), 50, 200)


@query(f"SELECT {LIST_SQL} FROM media WHERE deleted_at IS NOT NULL", "media")
def p5_trash_list(spark, sf):
    return flat(browse.trash_list(fx.media(spark, sf)))


@query("SELECT id, path, CAST(added_at AS VARCHAR) AS added_at FROM folders", "folders")
def p6_folder_list(spark, sf):
    return flat(browse.folder_list(fx.folders(spark, sf)))


@query(
    f"SELECT {PLACE_SQL} FROM shipments_media WHERE latitude BETWEEN 22.5 - 11.25/2 AND 22.5 + 11.25/2 AND longitude BETWEEN 45 - 11.25/2 AND 45 + 11.25/2".replace(
        "shipments_media", "(SELECT *, CAST(NULL AS INT) AS width, CAST(NULL AS INT) AS height FROM shipments) s"
    ).replace("CAST(taken_at AS VARCHAR)", "CAST(s.taken_at AS VARCHAR)"),
    "shipments",
)
def p7_cluster_drawer(spark, sf):
    return flat(browse.cluster_drawer(fx.shipments(spark, sf), 22.5, 45.0, 3, representative=17))


CLUSTER_SQL = """SELECT round(round(latitude / {p}) * {p} + 0.0, 6) AS cluster_lat, round(round(longitude / {p}) * {p} + 0.0, 6) AS cluster_lon,
 count(*) AS "count", min(id) AS representative_id, arg_min(path, id) AS path, arg_min(filename, id) AS filename
 FROM shipments WHERE latitude BETWEEN {s} AND {n} AND longitude BETWEEN {w} AND {e}
 GROUP BY round(latitude / {p}), round(longitude / {p})"""


@query(CLUSTER_SQL.format(p="(90.0::DOUBLE / 8)", s=-90, n=90, w=-180, e=180), "shipments")
def a9_map_clusters(spark, sf):
    return rounded(mapview.map_clusters(fx.shipments(spark, sf), -90, -180, 90, 180, 3), "cluster_lat", "cluster_lon")


@query(CLUSTER_SQL.format(p="(90.0::DOUBLE / 1024)", s=-30.5, n=70, w=-100, e=150.5), "shipments")
def g1_map_clusters(spark, sf):
    return rounded(mapview.map_clusters(fx.shipments(spark, sf), -30.5, -100, 70, 150.5, 10), "cluster_lat", "cluster_lon")


@query(
    " UNION ALL ".join(
        f"SELECT {zoom} AS zoom, * FROM ({CLUSTER_SQL.format(p=f'(90.0::DOUBLE / {2**zoom})', s=-90, n=90, w=-180, e=180)})"
        for zoom in (0, 4, 9, 12)
    ),
    "shipments",
)
def g1_map_pyramid(spark, sf):
    """Four zooms out of one stored table of half cells."""
    pyramid = materialize(mapview.map_pyramid(fx.shipments(spark, sf)), "pyramid")
    views = [
        rounded(mapview.pyramid_clusters(pyramid, zoom), "cluster_lat", "cluster_lon").select(F.lit(zoom).alias("zoom"), "*")
        for zoom in (0, 4, 9, 12)
    ]
    return reduce(lambda a, b: a.unionByName(b), views)


@query(
    """SELECT latitude AS cluster_lat, longitude AS cluster_lon, 1::BIGINT AS "count", id AS representative_id, path, filename
    FROM active WHERE latitude BETWEEN -30.5 AND 70 AND longitude BETWEEN -100 AND 150.5""",
    "active",
)
def g1_map_clusters_single(spark, sf):
    return mapview.map_clusters(fx.media(spark, sf), -30.5, -100, 70, 150.5, 16)


def _sql_waves(x: str, waves) -> str:
    return "(" + " + ".join(f"{a!r} * sin({x} * {f!r} * pi())" for a, f in waves) + f") * {geo.WAVE_SCALE!r}"


def _sql_polynomial(squared: str, c) -> str:
    return f"{c[0]!r} + {c[1]!r} * x + {c[2]!r} * y + {c[3]!r} * {squared} * {squared} + {c[4]!r} * x * y + {c[5]!r} * sqrt(abs(x))"


# the offset in metres north and east, divided by the radii of curvature at the latitude
GCJ_SQL = f""", place AS (SELECT id, latitude, longitude, longitude - {geo.ORIGIN_LON!r}::DOUBLE AS x, latitude - {geo.ORIGIN_LAT!r}::DOUBLE AS y,
  1 - {geo.ECCENTRICITY_SQUARED!r}::DOUBLE * pow(sin(radians(latitude)), 2) AS w FROM shipments),
metres AS (SELECT *, {_sql_polynomial("y", geo.NORTH_POLYNOMIAL)} + {_sql_waves("x", geo.COMMON_WAVES)} + {_sql_waves("y", geo.NORTH_WAVES)} AS north,
  {_sql_polynomial("x", geo.EAST_POLYNOMIAL)} + {_sql_waves("x", geo.COMMON_WAVES)} + {_sql_waves("x", geo.EAST_WAVES)} AS east,
  {geo.SEMI_MAJOR_AXIS!r}::DOUBLE * (1 - {geo.ECCENTRICITY_SQUARED!r}::DOUBLE) / pow(w, 1.5) AS meridian,
  {geo.SEMI_MAJOR_AXIS!r}::DOUBLE / sqrt(w) * cos(radians(latitude)) AS parallel FROM place)
SELECT id, round(latitude + degrees(north / meridian), 5) AS lat,
  CASE WHEN abs(latitude) < 90 THEN round(longitude + degrees(east / parallel), 5) END AS lon FROM metres"""


@query(GCJ_SQL, "shipments")
def g3_wgs84_to_gcj02(spark, sf):
    lat, lon = geo.wgs84_to_gcj02(F.col("latitude"), F.col("longitude"))
    return fx.shipments(spark, sf).select("id", F.round(lat, 5).alias("lat"), F.round(lon, 5).alias("lon"))


@query(
    """SELECT round(s - (n - s) * 0.1, 6) AS south, round(w - (e - w) * 0.1, 6) AS west, round(n + (n - s) * 0.1, 6) AS north,
    round(e + (e - w) * 0.1, 6) AS east FROM (SELECT min(latitude) AS s, max(latitude) AS n, min(longitude) AS w, max(longitude) AS e
    FROM active WHERE latitude IS NOT NULL AND longitude IS NOT NULL)""",
    "active",
)
def g4_bounds(spark, sf):
    shown = filters.with_location(fx.media(spark, sf))
    return rounded(mapview.bounds(shown), "south", "west", "north", "east")


@query(
    """SELECT path, length FROM (SELECT CASE doc_id % 9 WHEN 0 THEN '/lib/.hidden/' WHEN 1 THEN '/lib/@eaDir/' WHEN 2 THEN '/lib/$RECYCLE.BIN/x/'
      WHEN 3 THEN '/lib/System Volume Information/' ELSE '/lib/' || source || '/' END
      || CASE WHEN doc_id % 7 = 0 THEN '.' ELSE '' END || doc_id || CASE doc_id % 5 WHEN 0 THEN '.JPG' WHEN 1 THEN '.txt' WHEN 2 THEN '.Mov'
      WHEN 3 THEN '.heic' ELSE '' END AS path, strlen(text) AS length FROM documents) t
    WHERE regexp_matches(lower(path), '\\.(jpg|mov|heic)$') AND path NOT LIKE '%/.hidden/%' AND path NOT LIKE '%/@eaDir/%'
      AND path NOT LIKE '%/$RECYCLE.BIN/%' AND path NOT LIKE '%/System Volume Information/%'"""
)
def k0_media_files(spark, sf):
    listing = fx.table(spark, sf, "documents").selectExpr(
        """concat(case doc_id % 9 when 0 then '/lib/.hidden/' when 1 then '/lib/@eaDir/' when 2 then '/lib/$RECYCLE.BIN/x/'
           when 3 then '/lib/System Volume Information/' else concat('/lib/', source, '/') end,
           case when doc_id % 7 = 0 then '.' else '' end, doc_id, case doc_id % 5 when 0 then '.JPG' when 1 then '.txt'
           when 2 then '.Mov' when 3 then '.heic' else '' end) as path""",
        "cast(octet_length(text) as bigint) as length",
    )
    return listing_source.media_files(listing, ["/lib"])


@query("SELECT id, path, media_type FROM media", "media")
def i1_media_type(spark, sf):
    return fx.media(spark, sf).select("id", "path", path_functions.media_type(F.col("path")).alias("media_type"))


@query("SELECT path, photo_id, size, substr(photo_id, 1, 2) AS shard, legacy FROM thumbs", "thumbs")
def k7_thumb_inventory(spark, sf):
    return thumbnails.thumb_inventory(fx.thumbnails(spark, sf)).select("path", "photo_id", "size", "shard", "legacy")


@query(
    """SELECT count(*) AS "count", CAST(sum(length) AS BIGINT) AS total_size, count(*) FILTER (size = 'small') AS small_count,
    count(*) FILTER (size = 'medium') AS medium_count FROM thumbs""",
    "thumbs",
)
def a7_thumb_stats(spark, sf):
    return thumbnails.thumb_stats(fx.thumbnails(spark, sf))


@query("SELECT path, photo_id FROM thumbs WHERE photo_id NOT IN (SELECT id::VARCHAR FROM active)", "thumbs", "active")
def j10_thumb_orphans(spark, sf):
    return thumbnails.thumb_orphans(fx.thumbnails(spark, sf), fx.media(spark, sf)).select("path", "photo_id")


STALE_SQL = """SELECT id, path, CAST(modified_time AS VARCHAR) AS modified_time, CAST(thumb_mtime AS VARCHAR) AS thumb_mtime FROM active a
 LEFT JOIN (SELECT photo_id, max(mtime) AS thumb_mtime FROM thumbs WHERE {fit} GROUP BY 1) t ON t.photo_id = a.id::VARCHAR
 WHERE thumb_mtime IS NULL OR modified_time > thumb_mtime"""


@query(STALE_SQL.format(fit="size = 'small'"), "active", "thumbs")
def j11_thumb_stale(spark, sf):
    return flat(thumbnails.thumb_stale(fx.thumbnails(spark, sf), fx.media(spark, sf), "small"))


@query(STALE_SQL.format(fit="size = 'medium' OR legacy"), "active", "thumbs")
def j11_thumb_stale_medium(spark, sf):
    return flat(thumbnails.thumb_stale(fx.thumbnails(spark, sf), fx.media(spark, sf), "medium"))
