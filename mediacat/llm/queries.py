"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacat.llm import bpe, jaccard, lines, mixing, neighbours, packing, quality, secrets, structure, substrings, trie, urls, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query(
    r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), r AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.last AS dropped FROM k LEFT JOIN r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select(
        "doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"),
        F.sha2("__kept", 256).alias("kept_sha256"),
    )


@query()
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def _page(record_id):
    return F.regexp_extract(record_id, r"^<urn:page:(-?\d+)>$", 1)


@query(
    """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest,
         octet_length(encode(coalesce(html, ''))) AS n_bytes FROM pages
), f AS (SELECT digest, min(page_id) AS first FROM p WHERE n_bytes >= 100 GROUP BY digest)
SELECT page_id, n_bytes::BIGINT AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest AND p.n_bytes >= 100
"""
)
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    archives = warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    found = warc.read_archives(archives, folder)
    page, first = _page(F.col("record_id")), _page(F.coalesce("refers_to", F.lit("")))
    return found.select(
        F.when(page != "", page).cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.when(first != "", first).cast("long").alias("refers_to"),
    )


@query()
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rules = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.judged(docs, rules).select("doc_id", *[F.col(f"__{c}").alias(c) for c in out])


@query()
def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "id % 20 = 0")
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query()
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.round_trip(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)


@query()
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(documents(spark, sf_dir))


def _hits(rule: secrets.Rule, place: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""SELECT doc_id, '{rule.kind}' AS kind, {place} AS place, {rule.least} AS least,
       regexp_extract_all(text, '{pattern}', 0) AS hits, regexp_extract_all(text, '{pattern}', {rule.group}) AS parts,
       string_split_regex(text, '{pattern}') AS gaps FROM a"""


@query(
    rf"""
WITH a AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), raw AS (
  {" UNION ALL ".join(_hits(r, i) for i, r in enumerate(secrets.RULES))}
), e AS (
  SELECT doc_id, kind, place, least, unnest(hits) AS hit, unnest(parts) AS part, unnest(gaps[1:len(hits)]) AS gap,
         generate_subscripts(hits, 1) AS nth
  FROM raw WHERE len(hits) > 0
), s AS (
  SELECT *, (sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY nth))::BIGINT AS stop FROM e
), f AS (
  SELECT doc_id, kind, place, kind || ':' || (stop - length(hit)) || ':' || stop AS span, stop - length(hit) AS start
  FROM s WHERE length(part) >= least
), g AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
         count(*) FILTER (WHERE kind = 'hex') AS n_hex,
         string_agg(span, ',' ORDER BY start, place) FILTER (WHERE place < {len(secrets.BASE)}) AS base,
         string_agg(span, ',' ORDER BY start, place) AS spans
  FROM f GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""
)
def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scan_documents(documents(spark, sf_dir))
    base = [r.kind for r in secrets.BASE]

    def joined(found):
        return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    own = F.filter("found", lambda s: s["kind"].isin(base))
    counts = [count(kind) for kind in base]
    return rows.select("doc_id", *counts, F.sha2(joined(own), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


@query(
    r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), t AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight,
         2 * source_size AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5 AS budget FROM t
), r AS (
  SELECT *, budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS left_over,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM w
), level AS (
  SELECT left_over / open AS level FROM r WHERE cap > left_over / open * weight ORDER BY cap / weight, source NULLS LAST LIMIT 1
),
g AS (
  SELECT source, source_size, least(cap::DOUBLE, weight * level) AS target FROM r, level
), q AS (
  SELECT d.doc_id, d.size, d.source, g.target, e.epoch,
         md5(d.doc_id::VARCHAR || ':' || e.epoch) AS shuffled
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source, (VALUES (0), (1)) AS e(epoch)
  WHERE d.size > 0 AND (e.epoch = 0 OR g.target > g.source_size)
), v AS (
  SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY epoch, shuffled, doc_id))::DOUBLE / target AS finish FROM q
), a AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, epoch, shuffled, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM v
), k AS (
  SELECT doc_id, sum(size)::BIGINT AS taken FROM a WHERE upto <= 1.5 * (SELECT sum(size) FROM d) GROUP BY doc_id
)
SELECT d.doc_id, d.size, g.source_size, g.target, coalesce(k.taken, 0) AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN k ON d.doc_id = k.doc_id
"""
)
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(documents(spark, sf_dir))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


@query()
def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


# CRC-32 of a short ASCII string, bit by bit.
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))))"""


@query(
    f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS nth
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, {CRC32.format("conv_id::VARCHAR")} % 9 AS h FROM t GROUP BY conv_id
), r AS (
  SELECT c.conv_id, 0 AS part, t.nth, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.nth < c.h
  UNION ALL
  SELECT c.conv_id, 1, t.nth, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.nth >= c.h
), m AS (
  SELECT conv_id, row_number() OVER w AS depth, md5(string_agg(md5(role) || md5(text), '') OVER w) AS node, strlen(text) AS n_bytes
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, nth ROWS UNBOUNDED PRECEDING)
  UNION ALL
  SELECT conv_id, 0, '', 0 FROM c
), p AS (
  SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, max(depth) OVER (PARTITION BY conv_id) AS length FROM m
), n AS (
  SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, max(n_bytes) AS n_bytes, min(parent) AS parent,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = length), '')) AS ends_sha256
  FROM p GROUP BY depth, node
), k AS (
  SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM n GROUP BY depth, parent
), v AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON n.depth = k.depth AND n.node = k.node
), s AS (
  SELECT m.depth, m.node, count(*) FILTER (WHERE v.n_children = 0) AS n_leaves, sum((v.n_convs - 1) * v.n_bytes) AS saved
  FROM v JOIN m ON m.conv_id = v.conv_id AND m.depth <= v.depth GROUP BY m.depth, m.node
)
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, v.ends_sha256
FROM v JOIN s ON s.depth = v.depth AND s.node = v.node LEFT JOIN v AS u ON u.depth = v.depth - 1 AND u.node = v.parent
"""
)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.crc32(F.col("conv_id").cast("string")) % 9
    nodes, ends = trie.prefix_trie(conversations(spark, sf_dir), head, F.col("conv_id") - F.col("conv_id") % 5)
    return trie.with_ends_hash(nodes, ends)


@query()
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    out = ["doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step"]
    return pieces.select(*out)


@query()
def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations(spark, sf_dir)
    found, lines_left = structure.repair(structure.damage(rows), rows)
    return structure.with_repaired_hash(found, lines_left)
