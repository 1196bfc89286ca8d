"""Secret scans with an incremental blob ledger.

A text is addressed by its content (SHA-256), whatever documents, paths or versions hold
it. The ledger keeps two tables: which (blob, rule version) pairs were scanned, and the
findings. A scan anti-joins the blobs it meets with the first, reads one carrier document
per unseen blob, applies the rule versions that are missing, and appends to both. Findings
are then joined back to every document that holds the blob. New documents with known
content cost a join; a new rule version costs one scan with that rule only.

Defined results: a null text is the empty blob and has no findings; a null doc_id is an id
like others; rows repeated exactly each get their blob's findings; an empty table gives no
rows.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mediacat.runtime import materialize, scratch_folder


@dataclass(frozen=True)
class Rule:
    """A versioned pattern. A match counts if its ``group`` has at least ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}/{self.version}"


# The three base kinds, in their order.
BASE = (
    Rule(
        "assign", 1,
        r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
        r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2, 12,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),  # runs are maximal, so shorter ones need not be met
)
# What the operator adds: armoured private keys and web tokens.
ADDED = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + ADDED


def blob_of(text: Column) -> Column:
    """The content address of a text, 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


class BlobLedger:
    """Scanned pairs and findings, as append-only Parquet folders under ``path``."""

    SCANNED = "blob binary, rule string"
    FINDINGS = "blob binary, rule string, kind string, place int, start int, end int"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{scratch_folder(spark)}/ledger-{uuid.uuid4().hex}"
        for table, schema in (("scanned", self.SCANNED), ("findings", self.FINDINGS)):
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.path}/{table}")

    def scanned(self) -> DataFrame:
        return self.spark.read.schema(self.SCANNED).parquet(f"{self.path}/scanned")

    def findings(self) -> DataFrame:
        """The findings of scanned pairs; a scan that broke off before its end left none that count."""
        found = self.spark.read.schema(self.FINDINGS).parquet(f"{self.path}/findings")
        return found.distinct()

    def scan(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> None:
        """Scan what is unseen of (blob, rule version); findings first, then the record of the pairs."""
        versions = docs.select("doc_id", blob_of(F.col("text")).alias("blob"))
        carriers = versions.groupBy("blob").agg(F.min("doc_id").alias("carrier"))
        keys = F.explode(F.array(*[F.lit(r.key) for r in rules]))
        pairs = carriers.withColumn("rule", keys).join(self.scanned(), ["blob", "rule"], "left_anti")
        batch = f"{self.path}/batch-{uuid.uuid4().hex}"
        pairs.groupBy("blob", "carrier").agg(F.collect_set("rule").alias("rules")).write.parquet(batch)
        todo = self.spark.read.parquet(batch)
        wanted = todo.select(F.col("blob").alias("__blob"), F.col("carrier").alias("__carrier"), "rules")
        carried = F.col("doc_id").eqNullSafe(F.col("__carrier")) & (F.col("__blob") == F.col("blob"))
        texts = docs.select("doc_id", "text", blob_of(F.col("text")).alias("blob")).join(wanted, carried)
        _matches(texts, rules).write.mode("append").parquet(f"{self.path}/findings")
        todo.select("blob", F.explode("rules").alias("rule")).write.mode("append").parquet(f"{self.path}/scanned")


def _matches(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings with code point positions of the rules each text still needs.

    A pattern's matches and the pieces between them alternate, so the end of a match is the
    running sum of both lengths.
    """
    each = F.array(*[
        F.struct(
            F.lit(r.key).alias("rule"), F.lit(r.kind).alias("kind"), F.lit(i).alias("place"),
            F.when(
                F.array_contains("rules", r.key) & F.col("text").rlike(r.pattern),
                F.arrays_zip(
                    F.transform(F.split("text", r.pattern, -1), F.char_length).alias("gap"),
                    F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)).alias("hit"),
                    F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)).alias("part"),
                ),
            ).alias("hits"),
            F.lit(r.least).alias("least"),
        )
        for i, r in enumerate(rules)
    ])
    rows = (
        texts.select("blob", F.explode(each).alias("r"))
        .filter("r.hits IS NOT NULL")
        .select("blob", "r.rule", "r.kind", "r.place", "r.least", F.posexplode("r.hits").alias("nth", "m"))
        .select(
            "blob", "rule", "kind", "place", "least", "nth", F.col("m.gap").alias("gap"),
            F.char_length("m.hit").alias("n"), F.char_length("m.part").alias("part"),
        )
        .distinct()  # a carrier row repeated exactly is scanned as often
    )
    upto = W.partitionBy("blob", "rule").orderBy("nth").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.coalesce("n", F.lit(0))).over(upto)
    return (
        rows.withColumn("end", end)
        .filter(F.col("part") >= F.col("least"))
        .select("blob", "rule", "kind", "place", (F.col("end") - F.col("n")).cast("int").alias("start"), F.col("end").cast("int"))
    )


def scan_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: BlobLedger | None = None) -> DataFrame:
    """(doc_id, found): each row of ``docs`` with its spans ordered by start, then kind."""
    ledger = ledger or BlobLedger(docs.sparkSession)
    ledger.scan(docs, rules)
    asked = ledger.findings().filter(F.col("rule").isin([r.key for r in rules]))
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(i))])
    span = F.struct("start", order[F.col("rule")].alias("place"), "end", "kind")
    found = materialize(asked.groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("found")), "found")  # so that a blob with many holders can be split
    rows = docs.select("doc_id", blob_of(F.col("text")).alias("blob"))
    return rows.join(found, "blob", "left").select("doc_id", F.coalesce("found", F.array().cast(found.schema["found"].dataType)).alias("found"))
