"""Catalogue tables derived from the general-purpose test tables, as plain projections.

Each fixture exists twice, as a DataFrame (functions here) and as a DuckDB common table
expression (``CTES``), built from the same expressions, so a query and its SQL twin
start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacat.operators import exact, keeper
from mediacat.runtime import materialize
from mediacat.schema import Catalog


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


NAME = """concat(doc_id, case when doc_id % 11 = 0 then '_copy' else '' end,
          case when lang = 'es' then '.mp4' else '.jpg' end)"""


def media(spark: SparkSession, sf: str) -> DataFrame:
    """One file per document; Spanish ones are videos."""
    return table(spark, sf, "documents").selectExpr(
        "doc_id as id",
        "source as folder_id",
        f"concat('/lib/', source, '/', {NAME}) as path",
        f"{NAME} as filename",
        "case when lang = 'es' then 'video' else 'image' end as media_type",
        "case when lang = 'es' then 1000 + doc_id % 5 else cast(octet_length(text) as bigint) end as file_size",
        "case when lang <> 'es' then md5(text) end as file_hash",
        "case when lang = 'es' then md5(cast(doc_id % 7 as string)) end as frame_hash",
        "md5(cast(doc_id % 14 as string)) as sampled_hash",
        """case when doc_id % 5 = 0 then null when doc_id % 29 = 0 then repeat('0', 64)
           else lpad(bin(doc_id * 2654435761 % 4294967296), 64, '0') end as perceptual_hash""",
        """case when doc_id % 17 <> 0 then timestamp_ntz'2023-01-01 00:00:00'
           + make_dt_interval(cast((doc_id * 7919) % 730 as int), 0, 0, cast(doc_id % 86400 as decimal(18, 6))) end as taken_at""",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(doc_id as decimal(18, 6))) as modified_time",
        "cast(null as timestamp_ntz) as updated_at",
        "case when doc_id % 3 <> 0 then cast((doc_id * 7919) % 18000 as double) / 100 - 90 end as latitude",
        """case when doc_id % 3 <> 0 and doc_id % 13 <> 0
           then cast((doc_id * 104729) % 36000 as double) / 100 - 180 end as longitude""",
        "case when doc_id % 7 <> 0 then concat('Make ', doc_id % 7) end as camera",
        "case when doc_id % 19 <> 0 then cast(640 * (1 + doc_id % 6) as int) end as width",
        "case when doc_id % 19 <> 0 then cast(480 * (1 + doc_id % 6) as int) end as height",
        "cast(null as double) as duration",
        """case when doc_id % 23 = 0 then timestamp_ntz'2025-01-01 00:00:00'
           + make_dt_interval(0, 0, 0, cast(doc_id as decimal(18, 6))) end as deleted_at""",
        f"case when doc_id % 23 = 0 then concat('/lib/', source, '/', {NAME}) end as original_path",
        f"case when doc_id % 23 = 0 then concat('/trash/', doc_id, '/', {NAME}) end as trash_path",
    )


def members(spark: SparkSession, sf: str) -> DataFrame:
    """Exact groups of ``media`` plus 'similar' groups that also hold trashed files."""
    rows = media(spark, sf)
    found = exact.exact_groups(rows).select("group_id", "photo_id")
    similar = rows.filter("id % 10 in (0, 3)").selectExpr("concat('similar:', id div 50) as group_id", "id as photo_id")
    return materialize(found.unionByName(similar), "members")


def groups(spark: SparkSession, sf: str) -> DataFrame:
    rows = media(spark, sf)
    exact_members = materialize(exact.exact_groups(rows).select("group_id", "photo_id"), "members")
    found = keeper.pick_keeper(exact_members, rows)
    similar = (
        rows.filter("id % 10 in (0, 3)")
        .groupBy(F.expr("concat('similar:', id div 50)").alias("group_id"))
        .agg(F.min("id").alias("keeper_id"))
    )
    both = found.withColumn("reason", F.lit("exact")).unionByName(similar.withColumn("reason", F.lit("similar")))
    return materialize(both.select("group_id", "reason", "keeper_id"), "groups")


def folders(spark: SparkSession, sf: str) -> DataFrame:
    """One folder per source."""
    return (
        table(spark, sf, "documents")
        .groupBy("source")
        .agg(F.min("doc_id").alias("first"))
        .selectExpr(
            "source as id",
            "concat('/lib/', source) as path",
            "timestamp_ntz'2022-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(first as decimal(18, 6))) as added_at",
        )
    )


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors; their photo ids overlap the documents."""
    return table(spark, sf, "embeddings").selectExpr(
        "vec_id as photo_id",
        "embedding",
        "case when vec_id % 5 < 4 then 'm1' else 'm0' end as model",
        "timestamp_ntz'2024-02-01 00:00:00' as created_at",
        "timestamp_ntz'2024-02-01 00:00:00' as updated_at",
    )


def catalog(spark: SparkSession, sf: str) -> Catalog:
    return Catalog(
        media(spark, sf), groups(spark, sf), members(spark, sf), embeddings(spark, sf), folders(spark, sf)
    )


def listing(spark: SparkSession, sf: str) -> DataFrame:
    """A later listing of ``media``: some files gone, touched, grown or new."""
    rows = media(spark, sf).filter("deleted_at is null")
    seen = rows.filter("id % 10 <> 1").selectExpr(
        "path",
        "file_size + case when id % 10 = 3 then 1 else 0 end as length",
        """case when id % 10 = 2 then timestamp_ntz'2024-06-01 00:00:00' else timestamp_ntz'2024-01-01 00:00:00' end
           + make_dt_interval(0, 0, 0, cast(id as decimal(18, 6))) as mtime""",
    )
    new = rows.filter("id % 25 = 0").selectExpr(
        "concat('/lib/new/', id, '.jpg') as path",
        "file_size as length",
        "modified_time as mtime",
    )
    return seen.unionByName(new)


def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints with perturbed copies, copies of equal hash, and undecodable files."""
    base = table(spark, sf, "embeddings").selectExpr(
        "vec_id as id",
        "1000 + vec_id % 3000 as file_size",
        "concat_ws('', transform(embedding, x -> if(x > sort_array(embedding)[32], '1', '0'))) as ph",
    )
    flipped = base.withColumn(
        "flip",
        F.expr(
            """concat_ws('', transform(sequence(0, 7), i -> if(i < id % 12,
               concat(translate(substr(ph, i * 8 + 1, 1), '01', '10'), substr(ph, i * 8 + 2, 7)),
               substr(ph, i * 8 + 1, 8))))"""
        ),
    )
    flipped = materialize(flipped, "fingerprints")
    base = flipped.drop("flip").withColumn("id", F.col("id") * 4)  # an id has room for four versions
    return (
        base.unionByName(flipped.selectExpr("id * 4 + 1 as id", "file_size * (1 + id % 3) as file_size", "flip as ph"))
        .unionByName(
            flipped.filter("id % 4 = 0").selectExpr("id * 4 + 2 as id", "file_size * 2 as file_size", "flip as ph")
        )
        .unionByName(base.filter("id < 12").selectExpr("id + 3 as id", "1000L as file_size", "repeat('0', 64) as ph"))
    )


def fingerprint_media(spark: SparkSession, sf: str) -> DataFrame:
    """``fingerprints`` as catalogue rows, one in thirteen trashed."""
    return fingerprints(spark, sf).selectExpr(
        "id",
        "'image' as media_type",
        "concat('/fp/', id, '.jpg') as path",
        "concat(id, case when id % 2 = 0 then '_copy' else '' end, '.jpg') as filename",
        "file_size",
        "ph as perceptual_hash",
        "cast(null as timestamp_ntz) as taken_at",
        "cast(null as double) as latitude",
        "cast(null as double) as longitude",
        "cast(640 * (1 + id % 3) as int) as width",
        "480 as height",
        "case when id % 13 = 0 then timestamp_ntz'2025-01-01 00:00:00' end as deleted_at",
    )


def tags(spark: SparkSession, sf: str) -> DataFrame:
    """Camera tags; every second row has a fallback source."""
    return table(spark, sf, "events").selectExpr(
        "event_id as id",
        """case when event_id % 4 <> 0 then array(cast(event_id % 90 as double), cast(event_id % 60 as double),
           cast(event_id % 3600 as double) / 60) end as gps_lat""",
        "case when event_id % 2 = 0 then 'N' else 'S' end as gps_lat_ref",
        """case when event_id % 5 <> 0 then concat(array(cast(event_id % 180 as double), cast(event_id % 60 as double)),
           case when event_id % 11 = 0 then cast(array() as array<double>) else array(0.0D) end) end as gps_lon""",
        "case when event_id % 3 = 0 then 'W' else 'E' end as gps_lon_ref",
        "case when event_id % 6 <> 0 then ts end as dt_original",
        "case when event_id % 12 <> 0 then ts end as dt_create",
        "case when event_id % 3 = 0 then '' else concat('Make', event_id % 3) end as make",
        "case when event_id % 8 = 0 then '' else event_type end as model",
        "case when event_id % 9 = 0 then 0 else cast(1 + event_id % 16 as int) end as f_number",
        """case when event_id % 7 = 0 then null when event_id % 7 = 1 then 2.0D
           else 1.0D / (1 + event_id % 4000) end as exposure""",
        "cast(event_id % 4 * 100 as int) as iso",
        "case when event_id % 10 = 0 then 0.0D else cast(event_id % 300 as double) / 2 end as focal_length",
        "cast(event_id % 2 * 4000 as int) as exif_width",
        "cast(event_id % 3 * 1000 as int) as image_width",
        "800 as decoder_width",
        "case when event_id % 2 = 0 then timestamp_ntz'2020-01-01 00:00:00' end as alt_dt_original",
        "case when event_id % 2 = 0 then 10.0D end as alt_lat",
        "case when event_id % 2 = 0 then 20.0D end as alt_lon",
    )


def vector_media(spark: SparkSession, sf: str) -> DataFrame:
    """A catalogue row per vector, one in nine trashed."""
    return table(spark, sf, "embeddings").selectExpr(
        "vec_id as id",
        "concat('/v/', vec_id, '.jpg') as path",
        "'image' as media_type",
        "case when vec_id % 9 = 0 then timestamp_ntz'2025-01-01 00:00:00' end as deleted_at",
    )


def plans(spark: SparkSession, sf: str) -> DataFrame:
    """Two plans per label: the label's mean vector, and its first vector with a lower bar."""
    rows = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    mean = (
        rows.select("label", F.posexplode("embedding").alias("pos", "x"))
        .groupBy("label", "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy("label")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v"))
        .selectExpr("label as query_id", "0 as plan_no", "transform(v, e -> e.x) as embedding", "0.28D as threshold")
    )
    first = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("e")).selectExpr(
        "label as query_id", "1 as plan_no", "transform(e, x -> cast(x as double)) as embedding", "0.18D as threshold"
    )
    return mean.unionByName(first)


def shots(spark: SparkSession, sf: str) -> DataFrame:
    """Files from the event log, for day keys and streams."""
    return table(spark, sf, "events").selectExpr(
        "event_id as id",
        "cast(user_id as string) as folder_id",
        "event_type as camera",
        "ts as taken_at",
        "'image' as media_type",
        "case when event_id % 3 <> 0 then cast((event_id * 7919) % 18000 as double) / 100 - 90 end as latitude",
        """case when event_id % 3 <> 0 and event_id % 13 <> 0
           then cast((event_id * 104729) % 36000 as double) / 100 - 180 end as longitude""",
        "cast(null as timestamp_ntz) as deleted_at",
    )


def shipments(spark: SparkSession, sf: str) -> DataFrame:
    """Files from the line items: the large table, for month keys and map cells."""
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey * 8 + l_linenumber as id",
        "l_returnflag as folder_id",
        "l_linestatus as camera",
        "concat('/ship/', l_orderkey, '/', l_linenumber, '.jpg') as path",
        "concat(l_linenumber, '.jpg') as filename",
        "'image' as media_type",
        "l_shipdate as taken_at",
        "cast((l_orderkey * 7919) % 18000 as double) / 100 - 90 as latitude",
        "cast((l_partkey * 104729) % 36000 as double) / 100 - 180 as longitude",
        "cast(null as timestamp_ntz) as deleted_at",
        "cast(null as int) as width",
        "cast(null as int) as height",
        "cast(l_quantity as bigint) as file_size",
    )


def search_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Search queries from conversation turns, some opened like a prompt, some Chinese."""
    return table(spark, sf, "conversations").selectExpr(
        "concat(conv_id, '/', turn, '/', role) as query_id",
        """case when turn % 4 = 1 then concat('  A photo of ', text) when turn % 4 = 2 then concat('海边 ', text, ' ')
           when turn % 4 = 3 then concat('日落', text) else text end as query""",
        "case when turn % 4 = 2 then text end as translated",
    )


def thumbnails(spark: SparkSession, sf: str) -> DataFrame:
    """A thumbnail cache of ``media``: fresh, stale, missing, flat and orphaned files."""
    rows = media(spark, sf).selectExpr(
        "cast(id as string) as id", "id as n", "file_size",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(id as decimal(18, 6))) as mtime",
    )
    shard = "concat('/cache/', substr(id, 1, 2), '/', id, "
    small = rows.filter("n % 4 <> 0").selectExpr(
        f"{shard}'_small.webp') as path", "cast(100 + n % 50 as bigint) as length",
        "case when n % 4 = 1 then mtime - interval '1' second else mtime end as mtime",
    )
    medium = rows.filter("n % 5 < 2").selectExpr(
        f"{shard}'_medium.webp') as path", "cast(500 + n % 50 as bigint) as length",
        "case when n % 5 = 1 then mtime - interval '1' second else mtime end as mtime",
    )
    flat = rows.filter("n % 6 = 0").selectExpr(
        "concat('/cache/', id, '.webp') as path", "cast(700 as bigint) as length", "mtime"
    )
    orphan = rows.filter("n % 9 = 0").selectExpr(
        "concat('/cache/zz/zz', id, '_small.webp') as path", "cast(9 as bigint) as length", "mtime"
    )
    return small.unionByName(medium).unionByName(flat).unionByName(orphan)


_NAME = """doc_id || CASE WHEN doc_id % 11 = 0 THEN '_copy' ELSE '' END
          || CASE WHEN lang = 'es' THEN '.mp4' ELSE '.jpg' END"""

# DuckDB twins, each listed after what it depends on.
CTES = {
    "media": f"""SELECT doc_id AS id, source AS folder_id, '/lib/' || source || '/' || {_NAME} AS path, {_NAME} AS filename,
  CASE WHEN lang = 'es' THEN 'video' ELSE 'image' END AS media_type,
  CASE WHEN lang = 'es' THEN 1000 + doc_id % 5 ELSE strlen(text) END::BIGINT AS file_size,
  CASE WHEN lang <> 'es' THEN md5(text) END AS file_hash,
  CASE WHEN lang = 'es' THEN md5(CAST(doc_id % 7 AS VARCHAR)) END AS frame_hash,
  md5(CAST(doc_id % 14 AS VARCHAR)) AS sampled_hash,
  CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 29 = 0 THEN repeat('0', 64)
    ELSE lpad(bin(doc_id * 2654435761 % 4294967296), 64, '0') END AS perceptual_hash,
  CASE WHEN doc_id % 17 <> 0 THEN TIMESTAMP '2023-01-01' + to_days(CAST((doc_id * 7919) % 730 AS INT))
    + to_seconds(doc_id % 86400) END AS taken_at,
  TIMESTAMP '2024-01-01' + to_seconds(doc_id) AS modified_time,
  CAST(NULL AS TIMESTAMP) AS updated_at,
  CASE WHEN doc_id % 3 <> 0 THEN CAST((doc_id * 7919) % 18000 AS DOUBLE) / 100 - 90 END AS latitude,
  CASE WHEN doc_id % 3 <> 0 AND doc_id % 13 <> 0
    THEN CAST((doc_id * 104729) % 36000 AS DOUBLE) / 100 - 180 END AS longitude,
  CASE WHEN doc_id % 7 <> 0 THEN 'Make ' || (doc_id % 7) END AS camera,
  CASE WHEN doc_id % 19 <> 0 THEN CAST(640 * (1 + doc_id % 6) AS INT) END AS width,
  CASE WHEN doc_id % 19 <> 0 THEN CAST(480 * (1 + doc_id % 6) AS INT) END AS height,
  CAST(NULL AS DOUBLE) AS duration,
  CASE WHEN doc_id % 23 = 0 THEN TIMESTAMP '2025-01-01' + to_seconds(doc_id) END AS deleted_at,
  CASE WHEN doc_id % 23 = 0 THEN '/lib/' || source || '/' || {_NAME} END AS original_path,
  CASE WHEN doc_id % 23 = 0 THEN '/trash/' || doc_id || '/' || {_NAME} END AS trash_path
FROM documents""",
    "active": "SELECT * FROM media WHERE deleted_at IS NULL",
    "keyed": """SELECT media_type, CASE WHEN media_type = 'image' THEN file_hash ELSE frame_hash || '_' || file_size END AS key,
  id AS photo_id, taken_at FROM active""",
    "exact_rows": """SELECT media_type, key, photo_id, taken_at, count(*) OVER w AS "count",
  'exact:' || min(photo_id) OVER w AS group_id FROM keyed WHERE key IS NOT NULL
  WINDOW w AS (PARTITION BY media_type, key) QUALIFY count(*) OVER w > 1""",
    "scored": """SELECT *, CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL THEN 100 ELSE 0 END
  + log2(greatest(1, coalesce(file_size, 0))::DOUBLE) * 10
  + coalesce(width, 0)::DOUBLE * coalesce(height, 0) / 1000000
  + CASE WHEN regexp_matches(lower(filename), 'copy|副本|edited|修改|截图') THEN 0 ELSE 10 END AS score FROM media""",
    "members": """SELECT group_id, photo_id FROM exact_rows
  UNION ALL SELECT 'similar:' || (id // 50), id FROM media WHERE id % 10 IN (0, 3)""",
    "groups": """SELECT group_id, 'exact' AS reason, photo_id AS keeper_id FROM exact_rows e JOIN scored s ON s.id = e.photo_id
    QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY score DESC, s.taken_at DESC NULLS LAST, photo_id) = 1
  UNION ALL SELECT 'similar:' || (id // 50), 'similar', min(id) FROM media WHERE id % 10 IN (0, 3) GROUP BY 1""",
    "folders": """SELECT source AS id, '/lib/' || source AS path,
  TIMESTAMP '2022-01-01' + to_seconds(min(doc_id)) AS added_at FROM documents GROUP BY source""",
    "vectors": """SELECT vec_id AS photo_id, embedding, CASE WHEN vec_id % 5 < 4 THEN 'm1' ELSE 'm0' END AS model,
  TIMESTAMP '2024-02-01' AS created_at, TIMESTAMP '2024-02-01' AS updated_at FROM embeddings""",
    "listing": """SELECT path, file_size + CASE WHEN id % 10 = 3 THEN 1 ELSE 0 END AS length,
    CASE WHEN id % 10 = 2 THEN TIMESTAMP '2024-06-01' ELSE TIMESTAMP '2024-01-01' END + to_seconds(id) AS mtime
  FROM active WHERE id % 10 <> 1
  UNION ALL SELECT '/lib/new/' || id || '.jpg', file_size, modified_time FROM active WHERE id % 25 = 0""",
    "diff": """SELECT path, a.id, CASE WHEN a.id IS NULL THEN 'new' WHEN l.length IS NULL THEN 'deleted'
    WHEN l.length = a.file_size AND l.mtime = a.modified_time THEN 'unchanged' ELSE 'changed' END AS status,
  l.length, l.mtime FROM listing l FULL JOIN active a USING (path)""",
    "fp_base": """SELECT vec_id AS id, 1000 + vec_id % 3000 AS file_size,
  list_aggregate(list_transform(embedding, lambda x: CASE WHEN x > list_sort(embedding)[33] THEN '1' ELSE '0' END), 'string_agg', '') AS ph
  FROM embeddings""",
    "fp_flip": """SELECT *, list_aggregate(list_transform(range(8), lambda i: CASE WHEN i < id % 12
    THEN translate(substr(ph, CAST(i * 8 + 1 AS INT), 1), '01', '10') || substr(ph, CAST(i * 8 + 2 AS INT), 7)
    ELSE substr(ph, CAST(i * 8 + 1 AS INT), 8) END), 'string_agg', '') AS flip FROM fp_base""",
    "fp": """SELECT id * 4 AS id, file_size, ph FROM fp_base
  UNION ALL SELECT id * 4 + 1, file_size * (1 + id % 3), flip FROM fp_flip
  UNION ALL SELECT id * 4 + 2, file_size * 2, flip FROM fp_flip WHERE id % 4 = 0
  UNION ALL SELECT id * 4 + 3, 1000, repeat('0', 64) FROM fp_base WHERE id < 3""",
    "fp_media": """SELECT *, id || CASE WHEN id % 2 = 0 THEN '_copy' ELSE '' END || '.jpg' AS filename,
  640 * (1 + id % 3) AS width, 480 AS height FROM fp WHERE id % 13 <> 0""",
    "tags": """SELECT event_id AS id,
  CASE WHEN event_id % 4 <> 0 THEN [event_id % 90, event_id % 60, CAST(event_id % 3600 AS DOUBLE) / 60] END AS gps_lat,
  CASE WHEN event_id % 2 = 0 THEN 'N' ELSE 'S' END AS gps_lat_ref,
  CASE WHEN event_id % 5 <> 0 AND event_id % 11 <> 0 THEN [event_id % 180, event_id % 60, 0.0::DOUBLE] END AS gps_lon,
  CASE WHEN event_id % 3 = 0 THEN 'W' ELSE 'E' END AS gps_lon_ref,
  CASE WHEN event_id % 6 <> 0 THEN ts END AS dt_original,
  CASE WHEN event_id % 12 <> 0 THEN ts END AS dt_create,
  CASE WHEN event_id % 3 = 0 THEN '' ELSE 'Make' || (event_id % 3) END AS make,
  CASE WHEN event_id % 8 = 0 THEN '' ELSE event_type END AS model,
  CASE WHEN event_id % 9 = 0 THEN 0 ELSE 1 + event_id % 16 END AS f_number,
  CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN 2.0 ELSE 1.0::DOUBLE / (1 + event_id % 4000) END::DOUBLE AS exposure,
  CAST(event_id % 4 * 100 AS INT) AS iso,
  CASE WHEN event_id % 10 = 0 THEN 0 ELSE CAST(event_id % 300 AS DOUBLE) / 2 END AS focal_length,
  CAST(event_id % 2 * 4000 AS INT) AS exif_width, CAST(event_id % 3 * 1000 AS INT) AS image_width, 800 AS decoder_width,
  CASE WHEN event_id % 2 = 0 THEN TIMESTAMP '2020-01-01' END AS alt_dt_original,
  CASE WHEN event_id % 2 = 0 THEN 10.0 END AS alt_lat, CASE WHEN event_id % 2 = 0 THEN 20.0 END AS alt_lon FROM events""",
    "vector_media": """SELECT vec_id AS id, '/v/' || vec_id || '.jpg' AS path,
  CASE WHEN vec_id % 9 = 0 THEN TIMESTAMP '2025-01-01' END AS deleted_at FROM embeddings""",
    "plans": """SELECT label::BIGINT AS query_id, 0 AS plan_no, list(x ORDER BY pos) AS embedding, 0.28 AS threshold FROM (
    SELECT label, pos, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings)
    GROUP BY label, pos) GROUP BY label
  UNION ALL SELECT label::BIGINT, 1, arg_min(embedding, vec_id)::DOUBLE[], 0.18 FROM embeddings GROUP BY label""",
    "shots": """SELECT event_id AS id, CAST(user_id AS VARCHAR) AS folder_id, event_type AS camera, ts AS taken_at,
  CASE WHEN event_id % 3 <> 0 THEN CAST((event_id * 7919) % 18000 AS DOUBLE) / 100 - 90 END AS latitude,
  CASE WHEN event_id % 3 <> 0 AND event_id % 13 <> 0
    THEN CAST((event_id * 104729) % 36000 AS DOUBLE) / 100 - 180 END AS longitude FROM events""",
    "shipments": """SELECT l_orderkey * 8 + l_linenumber AS id, l_returnflag AS folder_id, l_linestatus AS camera,
  '/ship/' || l_orderkey || '/' || l_linenumber || '.jpg' AS path, l_linenumber || '.jpg' AS filename, l_shipdate AS taken_at,
  CAST((l_orderkey * 7919) % 18000 AS DOUBLE) / 100 - 90 AS latitude,
  CAST((l_partkey * 104729) % 36000 AS DOUBLE) / 100 - 180 AS longitude, CAST(l_quantity AS BIGINT) AS file_size FROM lineitem""",
    "search_texts": """SELECT conv_id || '/' || turn || '/' || role AS query_id,
  CASE WHEN turn % 4 = 1 THEN '  A photo of ' || text WHEN turn % 4 = 2 THEN '海边 ' || text || ' '
    WHEN turn % 4 = 3 THEN '日落' || text ELSE text END AS query,
  CASE WHEN turn % 4 = 2 THEN text END AS translated FROM conversations""",
    "thumbs": """SELECT '/cache/' || substr(id::VARCHAR, 1, 2) || '/' || id || '_small.webp' AS path, 100 + id % 50 AS length,
    id::VARCHAR AS photo_id, 'small' AS size, false AS legacy,
    modified_time - CASE WHEN id % 4 = 1 THEN INTERVAL 1 SECOND ELSE INTERVAL 0 SECOND END AS mtime FROM media WHERE id % 4 <> 0
  UNION ALL SELECT '/cache/' || substr(id::VARCHAR, 1, 2) || '/' || id || '_medium.webp', 500 + id % 50, id::VARCHAR, 'medium', false,
    modified_time - CASE WHEN id % 5 = 1 THEN INTERVAL 1 SECOND ELSE INTERVAL 0 SECOND END FROM media WHERE id % 5 < 2
  UNION ALL SELECT '/cache/' || id || '.webp', 700, id::VARCHAR, NULL, true, modified_time FROM media WHERE id % 6 = 0
  UNION ALL SELECT '/cache/zz/zz' || id || '_small.webp', 9, 'zz' || id, 'small', false, modified_time FROM media WHERE id % 9 = 0""",
}

_NEEDS = {
    "active": ["media"],
    "keyed": ["active"],
    "exact_rows": ["keyed"],
    "scored": ["media"],
    "members": ["exact_rows", "media"],
    "groups": ["exact_rows", "scored"],
    "listing": ["active"],
    "diff": ["listing", "active"],
    "fp_flip": ["fp_base"],
    "fp": ["fp_flip"],
    "fp_media": ["fp"],
    "thumbs": ["media"],
}


def with_ctes(sql: str, *names: str) -> str:
    """Prefix ``sql`` (which may open with its own CTEs, comma-first) by fixtures."""
    order: list[str] = []

    def add(name):
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    if not order:
        return sql.strip()
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in order)
    body = sql.strip()
    recursive = "RECURSIVE " if body.startswith(",") and " UNION SELECT " in body else ""
    return f"WITH {recursive}{head}{'' if body.startswith(',') else ' '}{body}"
