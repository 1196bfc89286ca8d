"""The corpus pipeline: quality rules, line dedup, Jaccard join, mixing, byte-level BPE.

Each stage takes the rows its predecessor kept and returns rows with the columns of
``documents``; the last returns a digest of each document's tokens. Text columns that a
stage changes keep their names, and ``n_chars`` follows the text where the table has it.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mediacat.llm import bpe, jaccard, lines, mixing, quality
from mediacat.runtime import materialize, ship_package

VOCABULARY = "byte_bpe_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned list reject."""
    ship_package(spark)
    rules = quality.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judged(docs, rules).filter("__kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines they lose; a document may become empty but stays."""
    ship_package(spark)
    done = lines.dedup_lines(docs)
    length = F.char_length("__kept").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    changed = {"text": F.col("__kept")} | ({} if length is None else {"n_chars": length})
    return done.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: that of the smallest doc_id.

    Documents without words are similar to nothing and stay; rows repeated exactly leave one.
    """
    ship_package(spark)
    found = materialize(jaccard.similar_components(docs), "similar")
    group = F.when(F.col("n_shingles") > 0, F.col("component_id"))
    order = F.struct(F.col("doc_id").isNotNull(), "doc_id", "body")
    grouped = found.filter(group.isNotNull()).groupBy(group.alias("g")).agg(F.min(order).alias("best"))
    alone = found.filter(group.isNull()).select("doc_id", "body").distinct()
    stay = grouped.select("best.doc_id", "best.body").unionByName(alone)
    stay = stay.select(F.col("doc_id").alias("__id"), F.col("body").alias("__body"))
    rows = docs.withColumn("__own", F.xxhash64("text"))
    kept = rows.join(stay, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__body")), "left_semi")
    nth = F.row_number().over(W.partitionBy("doc_id", "__own").orderBy("doc_id"))
    return kept.withColumn("__nth", nth).filter("__nth = 1").select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: never, once or twice."""
    ship_package(spark)
    return mixing.mixed_documents(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row."""
    ship_package(spark)
    ranks = bpe.read_ranks(public_tokenizers.path(VOCABULARY))
    return bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("mixed_sources", mixed_sources),
    ("byte_bpe", byte_bpe),
]

# The learned rules and the tokenizer have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
