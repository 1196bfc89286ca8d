"""SHA-256 over the joined items of groups that may be larger than any task."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacat.runtime import materialize

# Bytes of one group that a task holds before it passes them on as a piece.
PIECE_BYTES = 1 << 20


def _hashed(n_keys: int, separator: bytes, piece_bytes: int):
    """Sorted rows (keys, item) -> one row per group inside the partition, pieces of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        key, items, size, whole, n = None, [], 0, False, 0
        out: list[tuple] = []

        def leave(last: bool) -> None:
            nonlocal items, size, n
            body = separator.join(items)
            done = last and whole
            out.append((*key, (part << 32) + n, None if done else body, hashlib.sha256(body).hexdigest() if done else None))
            items, size, n = [], 0, n + 1

        def batch_of(names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        names = types = None
        for batch in batches:
            names = [*batch.schema.names[:n_keys], "piece_no", "piece", "sha256"]
            types = [*batch.schema.types[:n_keys], pa.int64(), pa.binary(), pa.string()]
            rows = zip(*[batch.column(k).to_pylist() for k in range(n_keys)])
            for own, item in zip(rows, batch.column(n_keys)):
                if own != key:
                    if key is not None:
                        leave(True)
                    key, whole = own, key is not None  # a partition's first group may have begun before it
                item = item.as_py()
                if items and size + len(item) > piece_bytes:
                    whole = False
                    leave(False)
                items.append(item)
                size += len(item) + len(separator)
                if len(out) > 1_000 or size > piece_bytes and out:
                    yield batch_of(names, types)
        if key is not None:
            whole = False  # the last group may go on in the next partition
            leave(True)
            yield batch_of(names, types)

    return run


def _finished(n_keys: int, separator: bytes):
    """Pieces sorted by group and number -> the groups' digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        names = types = None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*key, state.hexdigest()), types)], names)

        for batch in batches:
            names, types = [*batch.schema.names[:n_keys], "sha256"], [*batch.schema.types[:n_keys], pa.string()]
            rows = zip(*[batch.column(k).to_pylist() for k in range(n_keys)])
            for own, piece in zip(rows, batch.column(n_keys + 1)):
                if own != key:
                    if key is not None:
                        yield row()
                    key, state = own, hashlib.sha256()
                else:
                    state.update(separator)
                state.update(piece.as_py())
        if key is not None:
            yield row()

    return run


def joined_digests(
    df: DataFrame, keys: list[str], order: list[str], item: str, separator: bytes, piece_bytes: int = PIECE_BYTES
) -> DataFrame:
    """(keys, sha256): lower-case SHA-256 of each group's items in ``order``, joined by ``separator``.

    The rows are range-sorted by keys and order. A group inside one partition is hashed there; of
    the others, pieces of about ``piece_bytes`` go on and are hashed in turn as they stream by. No
    task holds a group. ``item`` is binary without nulls; ``order`` must be unique in a group.
    """
    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    sorted_rows = df.select(*keys, *order, item).repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    rows = sorted_rows.select(*keys, item).mapInArrow(
        _hashed(len(keys), separator, piece_bytes), f"{fields}, piece_no long, piece binary, sha256 string"
    )
    rows = materialize(rows, "digests")
    pieces = rows.filter("sha256 IS NULL").drop("sha256").repartition(*keys).sortWithinPartitions(*keys, "piece_no")
    late = pieces.mapInArrow(_finished(len(keys), separator), f"{fields}, sha256 string")
    return rows.filter("sha256 IS NOT NULL").select(*keys, "sha256").unionByName(late)


def as_bytes(text):
    return F.encode(text, "UTF-8")
