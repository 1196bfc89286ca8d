"""A filter of fixed size over 64-bit keys, to keep rows that cannot match from being moved.

The keys' hashes set bits in a table that the driver puts together from bounded blocks and
broadcasts. A row whose bit is clear has no match; what passes still needs its exact join.
Large key sets fill the table and it passes more, never less, than it should.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 24  # 2 MB
_BLOCK_BYTES = 4096  # Spark's bitmap functions work in blocks of so many


def _slot(key):
    return F.pmod(F.xxhash64(key), F.lit(BITS)) + 1  # bitmaps count from 1


def sieve(keys: DataFrame, key: str, hashed: bool = False) -> np.ndarray:
    """The bit table of a column of longs; ``hashed`` if their low bits are random already."""
    slot = F.col(key).bitwiseAND(F.lit(BITS - 1)) + 1 if hashed else _slot(key)
    blocks = (
        keys.select(slot.alias("slot"))
        .groupBy(F.bitmap_bucket_number("slot").alias("block"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    )
    table = np.zeros(BITS // 8, np.uint8)
    for row in blocks.collect():  # at most BITS / 32768 rows of 4 KB, 2 MB together
        at = (row["block"] - 1) * _BLOCK_BYTES
        data = np.frombuffer(row["bits"], np.uint8)
        table[at : at + len(data)] |= data
    return table


def marked(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which of these (random) longs have their bit set in a table made with ``hashed``."""
    at = hashes & (BITS - 1)
    return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def sifted(rows: DataFrame, key: str, table: np.ndarray, hit: bool = True) -> DataFrame:
    """The rows whose bit is set, or with ``hit`` false those whose bit is clear."""
    shared = rows.sparkSession.sparkContext.broadcast(table)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            at = batch.column("__slot").to_numpy() - 1
            found = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            yield batch.filter(pa.array(found == hit)).select(names)

    return rows.withColumn("__slot", _slot(key)).mapInArrow(run, rows.schema)
