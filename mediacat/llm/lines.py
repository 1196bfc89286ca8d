"""Line dedup over levelled sorted runs of line hashes.

The index of lines seen so far is a set of runs, each a table bucketed and sorted by line
hash. A batch of documents is reduced to its distinct line keys, merge-anti-joined with the
runs, and what no run holds becomes a new run of the lowest level. Keys that some run does
hold go to a small table of repeats. When a level has ``fanout`` runs they are merged into
one run of the next level, so a key is looked for in logarithmically many runs. A key is in
one run only; its totals are that run's row and its repeats.

Defined results: null and empty texts have one empty line; a null doc_id is an id smaller
than all others; rows repeated exactly each give their own row and count as one document;
an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacat.llm.frames import BLANKS, ascii_lower, bucketed, drop_bucketed, shuffle_parts
from mediacat.runtime import materialize, release

# Production parameters: shortest key, fewest documents of a repeated line, how many batches
# a bulk load is dealt into, runs merged at a time.
MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 4
FANOUT = 2

KEY = ["k1", "k2"]  # 128 bits of line hash


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_rows(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, body, pos, k1, k2): the lines whose key is long enough."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("body"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    bare = lines.withColumn("line", F.btrim(F.col("line"), F.lit(BLANKS))).filter(F.char_length("line") >= min_chars)
    key = ascii_lower(F.col("line"))
    return bare.select("doc_id", "body", "pos", F.xxhash64(key).alias("k1"), F.xxhash64(F.lit(1), key).alias("k2"))


class LineRuns:
    """The levelled runs: rows of (k1, k2, docs, last), each key in one run."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = FANOUT):
        self.spark = spark
        self.buckets = buckets or shuffle_parts(spark)
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []
        self.repeats: list[DataFrame] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _write(self, rows: DataFrame, name: str) -> DataFrame:
        return bucketed(rows, KEY, self.buckets, name)

    def fresh(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` that no run holds."""
        for run in self.runs():
            keys = keys.join(run.select(*KEY).hint("merge"), KEY, "left_anti")
        return keys

    def add(self, rows: DataFrame) -> None:
        """Add a batch of documents' lines; no document may be in two batches."""
        own = (
            rows.select(*KEY, "doc_id").distinct()
            .groupBy(*KEY)
            .agg(F.count("*").alias("docs"), F.max("doc_id").alias("last"))
        )
        if not self.runs():
            new = self._write(own, "line_run")
        else:
            own = self._write(own, "line_batch")
            new = self._write(self.fresh(own), "line_run")
            seen = own.join(new.select(*KEY).hint("merge"), KEY, "left_anti")
            self.repeats.append(materialize(seen, "line_repeats"))
            drop_bucketed(own)
        self._place(new, 0)

    def _place(self, run: DataFrame, level: int) -> None:
        """Put a run into its level; a full level becomes one run of the next."""
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(run)
        full = self.levels[level]
        if len(full) >= self.fanout:
            merged = self._write(reduce(DataFrame.unionByName, full), "line_run")
            self.levels[level] = []
            for old in full:
                drop_bucketed(old)
            self._place(merged, level + 1)

    def totals(self, min_docs: int) -> DataFrame:
        """(k1, k2, last) of the keys in at least ``min_docs`` documents."""
        runs = self.runs()
        if self.repeats:
            again = reduce(DataFrame.unionByName, self.repeats).groupBy(*KEY)
            more = self._write(again.agg(F.sum("docs").alias("more"), F.max("last").alias("later")), "line_more")
            for old in self.repeats:
                release(old)
            runs = [run.join(more.hint("merge"), KEY, "left") for run in runs]
        else:
            runs = [run.withColumns({"more": F.lit(0), "later": F.col("last")}) for run in runs]
        return (
            reduce(DataFrame.unionByName, runs)
            .filter(F.col("docs") + F.coalesce("more", F.lit(0)) >= min_docs)
            .select(*KEY, F.greatest("last", "later").alias("last"))
        )


def repeated_lines(
    docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES
) -> DataFrame:
    """(doc_id, body, drop): positions of the lines each document loses."""
    rows = materialize(line_rows(docs, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches))), "lines")
    index = LineRuns(docs.sparkSession)
    for batch in range(batches):
        index.add(rows.filter(F.col("batch") == batch))
    twice = materialize(index.totals(min_docs), "line_totals")
    lost = rows.join(twice.hint("merge"), KEY).filter(~F.col("doc_id").eqNullSafe(F.col("last")))
    return lost.groupBy("doc_id", "body").agg(F.collect_set("pos").alias("drop"))


def dedup_lines(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` with ``__kept`` (text without the dropped lines), ``__n_lines``, ``__n_dropped``."""
    lost = repeated_lines(docs, **how).select(
        F.col("doc_id").alias("__id"), F.col("body").alias("__body"), F.col("drop").alias("__drop")
    )
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__body"))
    whole = docs.join(lost, same, "left").withColumn("__lines", _lines(F.col("text")))
    positions = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drop"))
    kept = F.array_join(F.transform(positions, lambda i: F.get("__lines", i)), "\n")
    intact = F.col("__drop").isNull()
    return whole.select(
        *docs.columns,
        F.when(intact, F.coalesce("text", F.lit(""))).otherwise(kept).alias("__kept"),
        F.size("__lines").cast("long").alias("__n_lines"),
        F.when(intact, F.lit(0)).otherwise(F.size("__drop")).cast("long").alias("__n_dropped"),
    )
