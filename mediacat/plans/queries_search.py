"""Vector search."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediacat.functions import vectors
from mediacat.operators import search
from mediacat.plans import fixtures as fx
from mediacat.plans.registry import query, rounded

DOT_SQL = "list_inner_product({a}::DOUBLE[], {b}::DOUBLE[])"
SIM_SQL = """, sims AS (SELECT query_id, photo_id, max(sim) AS similarity, bool_or(sim >= threshold) AS hit FROM (
   SELECT query_id, photo_id, threshold, """ + DOT_SQL.format(a="p.embedding", b="v.embedding") + """ AS sim
   FROM plans p, vectors v {where}) GROUP BY 1, 2)"""


@query(
    """SELECT vec_id AS id, (unnest(range(len(embedding))) )::INT AS pos,
    round(unnest(list_transform(embedding, lambda x: (x::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])))::FLOAT))::DOUBLE, 6) + 0.0 AS x
    FROM embeddings"""
)
def v1_l2_normalize(spark, sf):
    unit = vectors.l2_normalize(F.col("embedding"))
    rows = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode(unit).alias("pos", "x"))
    return rows.select("id", "pos", (F.round(F.col("x").cast("double"), 6) + 0.0).alias("x"))


@query(
    """, first AS (SELECT label, arg_min(embedding, vec_id) AS e FROM embeddings GROUP BY label)
    SELECT vec_id AS id, round(""" + DOT_SQL.format(a="embedding[1:50]", b="e[1:50]") + """, 6) + 0.0 AS dot
    FROM embeddings JOIN first USING (label)""",
    "vectors",
)
def v2_dot(spark, sf):
    rows = fx.table(spark, sf, "embeddings")
    first = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("e"))
    shorter = F.slice("e", 1, 50)
    return rows.join(first, "label").select(
        F.col("vec_id").alias("id"), (F.round(vectors.dot(F.col("embedding"), shorter), 6) + 0.0).alias("dot")
    )


@query(
    """, q AS (SELECT query_id, query, translated, trim(query, ' ' || chr(9) || chr(10) || chr(13)) AS t, regexp_matches(query, '[\\x{4E00}-\\x{9FA5}]') AS cjk FROM search_texts)
    SELECT query_id, 0 AS plan_no, CASE WHEN cjk THEN t || ' 的照片' WHEN starts_with(lower(t), 'a photo of') OR starts_with(lower(t), 'an image of')
      OR starts_with(lower(t), 'picture of') THEN t ELSE 'a photo of ' || t END AS text, CASE WHEN cjk THEN 0.18 ELSE 0.28 END::DOUBLE AS threshold,
      CASE WHEN cjk THEN 'zh' ELSE 'en' END AS label FROM q
    UNION ALL SELECT query_id, 1, 'a photo of ' || translated, 0.28, 'translated-en' FROM q WHERE cjk AND translated <> ''""",
    "search_texts",
)
def v3_plan_queries(spark, sf):
    return search.plan_queries(fx.search_texts(spark, sf))


@query(
    SIM_SQL.format(where="")
    + """ SELECT query_id, photo_id, round(similarity, 6) AS similarity FROM sims WHERE hit""",
    "plans", "vectors",
)
def j8_score_all(spark, sf):
    return rounded(search.score_all(fx.plans(spark, sf), fx.embeddings(spark, sf)), "similarity")


TOP_SQL = """ SELECT query_id, photo_id, round(similarity, 6) AS similarity, rank FROM (SELECT *,
 row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, photo_id)::INT AS rank FROM sims WHERE hit) WHERE rank <= {k}"""


@query(SIM_SQL.format(where="") + TOP_SQL.format(k=20), "plans", "vectors")
def p9_top_k(spark, sf):
    scores = search.score_all(fx.plans(spark, sf), fx.embeddings(spark, sf), 20)
    return rounded(search.top_k(scores, 20), "similarity")


@query(
    SIM_SQL.format(where="WHERE v.model = 'm1' AND v.photo_id IN (SELECT id FROM vector_media WHERE deleted_at IS NULL)")
    + ", top AS (" + TOP_SQL.format(k=15).strip() + ") SELECT query_id, photo_id, similarity, rank, path FROM top JOIN vector_media ON id = photo_id",
    "plans", "vectors", "vector_media",
)
def v4_search(spark, sf):
    media = fx.vector_media(spark, sf)
    found = search.search(fx.plans(spark, sf), fx.embeddings(spark, sf), media, limit=15, model="m1")
    return rounded(found.select("query_id", "photo_id", "similarity", "rank", "path"), "similarity")


@query(
    """SELECT id, path, filename, media_type FROM active WHERE media_type = 'image' AND id NOT IN (SELECT photo_id FROM vectors)
    AND id NOT IN (SELECT doc_id FROM labels) ORDER BY id LIMIT 300""",
    "active", "vectors",
)
def j2_without_embedding(spark, sf):
    failed = fx.table(spark, sf, "labels").select("doc_id")
    return search.without_embedding(fx.media(spark, sf), fx.embeddings(spark, sf), failed, limit=300)


@query(
    """SELECT id, path, filename, media_type FROM active WHERE media_type = 'image' AND id NOT IN (SELECT photo_id FROM vectors WHERE model = 'm1')""",
    "active", "vectors",
)
def j2_without_embedding_of_model(spark, sf):
    return search.without_embedding(fx.media(spark, sf), fx.embeddings(spark, sf), model="m1")


@query("SELECT model, len(embedding)::INT AS dims FROM vectors WHERE photo_id = (SELECT max(vec_id) FROM embeddings)", "vectors")
def j3_vector_of(spark, sf):
    last = fx.table(spark, sf, "embeddings").agg(F.max("vec_id")).first()[0]
    return search.vector_of(fx.embeddings(spark, sf), last).select("model", F.size("embedding").alias("dims"))


@query(
    """SELECT photo_id, model, path FROM vectors JOIN vector_media ON id = photo_id WHERE deleted_at IS NULL AND model = 'm1'""",
    "vectors", "vector_media",
)
def j3_embeddings_with_media(spark, sf):
    rows = search.embeddings_with_media(fx.embeddings(spark, sf), fx.vector_media(spark, sf), "m1")
    return rows.select("photo_id", "model", "path")


@query(
    """SELECT id AS photo_id, 'text-length' AS model, 1.0::DOUBLE AS norm FROM active WHERE media_type = 'image'
    AND id NOT IN (SELECT photo_id FROM vectors) AND id % 11 <> 0""",
    "active", "vectors",
)
def v5_embed_missing(spark, sf):
    """With a stub encoder that rejects copies."""

    def encoder(paths):
        if any("_copy" in p for p in paths):
            raise ValueError("cannot decode")
        return [[float(len(p)), 1.0, float(sum(map(ord, p)) % 97)] for p in paths]

    good, _ = search.embed_missing(
        fx.media(spark, sf), fx.embeddings(spark, sf), encoder, "text-length", "2026-01-01 12:00:00"
    )
    norm = F.sqrt(vectors.dot(F.col("embedding"), F.col("embedding")))
    return good.select("photo_id", "model", F.round(norm, 6).alias("norm"))
