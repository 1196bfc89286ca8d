"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a fixed shuffled order, a second copy of each
behind the first where the source's target exceeds its size. A queued copy's virtual finish
time is the source's words up to and including it, divided by the source's target. One
global range sort by finish time interleaves the queues fairly, and the mix is what comes
before the total budget is used up.

Defined results: a null or empty text has size 0 and is never taken; a null source is a
source of its own, after all others; a null doc_id is an id like others; rows repeated
exactly queue separately; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mediacat.llm.frames import running_total, word_count
from mediacat.runtime import materialize, with_position

# Production parameters: weights dealt to the sources in order, the budget as a share of
# all words, and how often a document may be taken.
WEIGHTS = (5, 2, 1)
BUDGET = 1.5
EPOCHS = 2


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target): the budget shared by weight, no source above its cap.

    A source is capped at ``epochs`` times its size; what it leaves is shared among the
    others by weight until none is above its cap. Each round is one aggregate that gives
    three numbers, and every round but the last caps at least one more source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    placed = with_position(totals, [F.col("source").asc_nulls_last()], "__place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__place") % len(weights) + 1).cast("int"))
    table = materialize(
        placed.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * epochs).alias("cap")),
        "sources",
    )
    all_words = table.agg(F.sum("source_size")).first()[0] or 0
    level, capped = -1.0, -1
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        row = table.agg(
            F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0)).alias("spent"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open"),
            F.count_if(full).alias("n"),
        ).first()
        if row["n"] == capped or not row["open"]:
            break
        capped, level = row["n"], (budget * all_words - row["spent"]) / row["open"]
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level))
    return table.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """(doc_id, source, body, size, source_size, target, copies), a row per row of ``docs``.

    ``copies`` is how often the mix takes the document, ``body`` a hash of its text. The
    order of the queues hangs on the doc_id alone, so reruns agree.
    """
    rows = materialize(
        docs.select("doc_id", "source", F.xxhash64("text").alias("body"), word_count(F.col("text")).alias("size"))
        .withColumn("__row", F.monotonically_increasing_id()),
        "sizes",
    )
    targets = source_targets(rows, weights, budget, epochs)
    rounds = F.when(F.col("target") > F.col("source_size"), F.lit(epochs)).otherwise(F.lit(1))
    lines = targets.withColumn("__queued", F.col("source_size") * rounds)
    sources = materialize(
        running_total(lines, [F.col("source").asc_nulls_last()], "__queued", "__end"), "targets"
    ).withColumn("__start", F.col("__end") - F.col("__queued"))
    same = rows["source"].eqNullSafe(sources["source"])
    joined = materialize(rows.join(sources.drop("__end", "__queued"), same).drop(sources["source"]), "queued")
    waiting = joined.filter("size > 0").select(
        "__row", "doc_id", "source", "body", "size", "target", "__start",
        F.explode(F.sequence(F.lit(0), rounds - 1)).alias("epoch"),
    )
    named = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("epoch").cast("string"))
    waiting = waiting.withColumn("shuffled", F.md5(named.cast("binary")))
    tail = [F.col("source").asc_nulls_last(), F.col("epoch"), F.col("shuffled"), F.col("doc_id"), F.col("body")]
    queued = running_total(waiting, tail + [F.col("__row")], "size", "__sum")
    finish = queued.withColumn("finish", (F.col("__sum") - F.col("__start")) / F.col("target"))
    total = running_total(
        finish.select("__row", "source", "doc_id", "body", "epoch", "shuffled", "size", "finish"),
        [F.col("finish"), *tail, F.col("__row")], "size", "__all",
    )
    words = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()["words"]
    taken = total.filter(F.col("__all") <= F.lit(budget * words)).groupBy("__row").agg(F.count("*").alias("copies"))
    return joined.join(taken, "__row", "left").select(
        "doc_id", "source", "body", "size", "source_size", "target", F.coalesce("copies", F.lit(0)).alias("copies")
    )


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them."""
    keys = ["doc_id", "source", "body"]
    decided = (
        mix(docs, **how)
        .groupBy(*keys)
        .agg(F.collect_list("copies").alias("__copies"))
        .select(*[F.col(k).alias(f"__{k}") for k in keys], "__copies")
    )
    # rows repeated exactly are told apart by a running number; which one gets which is the same
    own = [F.col("doc_id"), F.col("source"), F.xxhash64("text")]
    numbered = docs.withColumn("__body2", own[2]).withColumn(
        "__nth", F.row_number().over(W.partitionBy("doc_id", "source", "__body2").orderBy("doc_id"))
    )
    same = (
        F.col("doc_id").eqNullSafe(F.col("__doc_id"))
        & F.col("source").eqNullSafe(F.col("__source"))
        & (F.col("__body2") == F.col("__body"))
    )
    copies = F.element_at("__copies", F.col("__nth"))
    return (
        numbered.join(decided, same)
        .withColumn("__copy", F.explode(F.sequence(F.lit(0), copies)))
        .filter(F.col("__copy") > 0)
        .select(*docs.columns)
    )
