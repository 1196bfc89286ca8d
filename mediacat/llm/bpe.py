"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a linked list of tokens. Each adjacent pair that the vocabulary can merge
waits in the bucket of its merge rank; a two-level bitmap over the ranks, in words of 256
bits, marks which buckets hold anything, so find-first-set gives the lowest rank in two steps. The leftmost
position of that bucket is merged and the two new pairs enter their buckets. Entries whose
pair has changed since are stale and skipped. Every merge costs a constant number of bitmap
steps and a heap step, so a pre-token of a million bytes is no special case.

Defined results: null and empty texts have no tokens; repeated rows are encoded alike; an
empty table gives no rows. Special tokens' strings are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# A worker remembers the ids of recent short pre-tokens, in two generations of this many: as
# many as a table of 2^19 places holds, since the next size takes twice the memory.
REMEMBERED = 349_525
REMEMBERED_CHARS = 40


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file of base64 lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Codec:
    """Encoder and decoder for one vocabulary; lives in a worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.byte_rank = [ranks[bytes([b])] for b in range(256)]
        top = max(ranks.values()) + 1
        self.shift = top.bit_length()
        # ids are remembered in as few bytes as they need
        self.kind = "<u2" if top <= 1 << 16 else "<u4"
        # every way to put a token together from two tokens
        self.pairs = {
            (ranks[token[:i]] << self.shift) | ranks[token[i:]]: rank
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        }
        self.low = [0] * ((top >> 8) + 1)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        shift, lookup, low, high = self.shift, self.pairs.get, self.low, 0
        ids = [self.byte_rank[b] for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waits = [-1] * n  # the rank at which the pair starting here waits, or -1
        buckets: dict[int, list[int]] = {}
        left_id = ids[0]
        for at in range(n - 1):
            right_id = ids[at + 1]
            rank = lookup((left_id << shift) | right_id)
            left_id = right_id
            if rank is not None:
                waits[at] = rank
                if rank in buckets:
                    buckets[rank].append(at)  # in increasing order, so already a heap
                else:
                    buckets[rank] = [at]
                    high |= 1 << (rank >> 8)
                    low[rank >> 8] |= 1 << (rank & 255)
        while high:
            a = (high & -high).bit_length() - 1
            word = low[a]
            rank = (a << 8) | ((word & -word).bit_length() - 1)
            bucket = buckets[rank]
            if len(bucket) > 1:
                at = heappop(bucket)
            else:
                at = bucket[0]
                del buckets[rank]
                low[a] = word = word & (word - 1)
                if not word:
                    high &= high - 1
            if waits[at] != rank:
                continue  # stale
            right, left = after[at], before[at]
            ids[at] = rank
            waits[right] = waits[at] = -1
            after[at] = far = after[right]
            if far < n:
                before[far] = at
                new = lookup((rank << shift) | ids[far])
                if new is not None:
                    waits[at] = new
                    if new in buckets:
                        heappush(buckets[new], at)
                    else:
                        buckets[new] = [at]
                        high |= 1 << (new >> 8)
                        low[new >> 8] |= 1 << (new & 255)
            if left >= 0:
                new = lookup((ids[left] << shift) | rank)
                if new is None:
                    waits[left] = -1
                elif waits[left] != new:
                    waits[left] = new
                    if new in buckets:
                        heappush(buckets[new], left)
                    else:
                        buckets[new] = [left]
                        high |= 1 << (new >> 8)
                        low[new >> 8] |= 1 << (new & 255)
        out, at = [], 0
        while at < n:
            out.append(ids[at])
            at = after[at]
        return out

    def _packed(self, piece: str) -> bytes:
        known = self.new.get(piece)
        if known is None:
            known = self.old.get(piece)
            if known is None:
                known = np.array(self.merge(piece.encode()), self.kind).tobytes()
            if len(piece) <= REMEMBERED_CHARS:
                self.new[piece] = known
                if len(self.new) >= REMEMBERED:
                    self.old, self.new = self.new, {}
        return known

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        pieces = self.split(text)
        known = self.new
        found = [known.get(p) for p in pieces]
        if None in found:
            found = [k if k is not None else self._packed(p) for k, p in zip(found, pieces)]
        return np.frombuffer(b"".join(found), self.kind).astype("<u4").tobytes()

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_CODECS: dict = {}


def codec(shared, pattern: str) -> Codec:
    """The worker's codec for a broadcast vocabulary; kept between tasks."""
    key = (id(shared.value), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(shared.value, pattern)
    return _CODECS[key]


def encoded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text`` as an array column in its place.

    The vocabulary is broadcast; its size is that of the rank file.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    kept = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(shared, pattern)
        for batch in batches:
            packed = [np.frombuffer(tool.encode(t or ""), "<u4").astype("i4") for t in _texts(batch, text)]
            arrays = [batch.column(c) for c in kept] + [pa.array(packed, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, ids])

    schema = docs.select(*kept).schema.add(ids, T.ArrayType(T.IntegerType()))
    return docs.select(*kept, text).mapInArrow(run, schema)


def decoded(rows: DataFrame, ranks: dict[bytes, int], pattern: str, ids: str = "ids", data: str = "data") -> DataFrame:
    """``rows`` with the bytes of an array of ids as a binary column in its place; null ids are empty."""
    shared = rows.sparkSession.sparkContext.broadcast(ranks)
    kept = [c for c in rows.columns if c != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(shared, pattern)
        for batch in batches:
            out = [tool.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(ids).to_pylist()]
            arrays = [batch.column(c) for c in kept] + [pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, data])

    return rows.select(*kept, ids).mapInArrow(run, rows.select(*kept).schema.add(data, T.BinaryType()))


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[str | None]:
    column = batch.column(name)
    for i in range(len(column)):  # one text at a time: a batch may hold long ones
        yield column[i].as_py()


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encode each text, decode its ids, digest both."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(shared, pattern)
        for batch in batches:
            counts, ids, back = [], [], []
            for t in _texts(batch, "text"):
                packed = tool.encode(t or "")
                counts.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                back.append(hashlib.sha256(tool.decode(packed)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                [key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.selectExpr(f"`{key}` AS key", f"`{text}` AS text")
    return rows.mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
