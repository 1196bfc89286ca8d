"""Substring dedup: repeated word windows found by an FM-index per shard.

1. Documents with equal word sequences are one; all but the first lose everything.
2. Each window has an anchor, its word 6-gram of least hash. Equal windows have equal
   anchors, so only stretches around anchors that occur in several sequences can repeat.
   Anchors are two ninths of the words; the rest of the text is not moved for this.
3. The texts with such anchors are fetched once, and those stretches (runs of windows with
   one anchor) are cut out and dealt to shards by anchor, equal ones of a batch as one. A
   shard builds a compressed index of its stretches, and all stretches stream through it
   by backward search, which gives each window the range of its occurrences and so the
   first document that has it. An anchor shared by very many sequences is dealt out window
   by window instead, which an aggregate on the window's words settles.
4. Windows that start in an earlier document cover the words that go.

Defined results: null texts and texts with fewer words than a window have no windows and
keep all words; a null doc_id is smaller than all others; rows with one doc_id are one
document, each judged by its own text; rows repeated exactly give equal results; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacat.llm.fmindex import FMIndex
from mediacat.llm.frames import bucketed, shuffle_parts
from mediacat.llm.sieve import marked, sieve, sifted
from mediacat.llm.words import U64, Words, grouped, mix64, window_hashes
from mediacat.runtime import materialize, scratch_folder

# Production parameters.
WINDOW = 13
GRAM = 6
SHARD_WORDS = 400_000  # words of an index
CROWDED = 20_000  # sequences that share an anchor beyond which it is dealt out by window

_NULL_ID = -(2**63)


def sequence_names(w: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of each text's word sequence."""
    n = w.n_words
    place = np.arange(len(hashes)) - np.repeat(w.bounds[:-1], n)
    x = hashes ^ mix64(place.astype(U64))
    out = []
    for salt in (U64(0), U64(0x5851F42D4C957F2D)):
        sums = np.zeros(len(x) + 1, U64)
        np.cumsum(mix64(x ^ salt), out=sums[1:])
        out.append(mix64((sums[w.bounds[1:]] - sums[w.bounds[:-1]]) ^ mix64(n.astype(U64))).view(np.int64))
    return out[0], out[1]


def stretches(w: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, last window, anchor) of the runs of windows with one anchor."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),)
    if len(hashes) < WINDOW:
        return none
    text = w.text_of()
    grams = window_hashes(hashes, GRAM)
    width = WINDOW - GRAM + 1
    inside = np.flatnonzero(text[: len(hashes) - WINDOW + 1] == text[WINDOW - 1 :])
    if not len(inside):
        return none
    seen = np.lib.stride_tricks.sliding_window_view(grams, width)
    best = inside + np.argmin(seen[inside], axis=1)
    fresh = np.r_[True, (best[1:] != best[:-1]) | (inside[1:] != inside[:-1] + 1)]
    first = np.flatnonzero(fresh)
    last = np.r_[first[1:], len(inside)] - 1
    return text[inside[first]], inside[first], inside[last], grams[best[first]]


def _names(docs: DataFrame) -> DataFrame:
    """(doc_id, s1, s2, n_words, whole) of each row; ``whole`` is the digest of all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, whole = [], []
            for _, _, w in grouped(batch.column("text")):
                parts.append((*sequence_names(w, w.hashes()), w.n_words))
                body = w.data.tobytes()
                # bytes.split cuts at the same six characters
                whole += [hashlib.sha256(b" ".join(body[a:b].split())).hexdigest() for a, b in zip(w.offsets[:-1], w.offsets[1:])]
            columns = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, columns), pa.array(whole, pa.string())], ["doc_id", "s1", "s2", "n_words", "whole"]
            )

    return materialize(docs.mapInArrow(run, "doc_id long, s1 long, s2 long, n_words long, whole string"), "sequences")


def _shared_anchors(docs: DataFrame) -> DataFrame:
    """(s1, anchor): anchors of each word sequence that occur in another sequence too."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs by batch. Where a batch itself has an anchor in two sequences, its pairs are
        proven, and only one of them goes on to prove others."""
        for batch in batches:
            found = []
            for _, _, w in grouped(batch.column("text")):
                hashes = w.hashes()
                text, _, _, anchor = stretches(w, hashes)
                found.append(np.stack([anchor.view(np.int64), sequence_names(w, hashes)[0][text]], 1))
            pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
            if not len(pairs):
                continue
            fresh = np.r_[True, pairs[1:, 0] != pairs[:-1, 0]]
            several = np.repeat(np.diff(np.r_[np.flatnonzero(fresh), len(pairs)]) > 1, np.diff(np.r_[np.flatnonzero(fresh), len(pairs)]))
            sent = np.concatenate([pairs[fresh], pairs[several]])
            proven = np.r_[np.zeros(int(fresh.sum()), bool), np.ones(int(several.sum()), bool)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(sent[:, 0]), pa.array(sent[:, 1]), pa.array(proven)], ["anchor", "s1", "proven"]
            )

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From rows sorted by (anchor, s1): pass on proven ones, and all of an anchor with two sequences."""
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

        def shared(anchor, name):
            fresh = np.r_[True, (anchor[1:] != anchor[:-1]) | (name[1:] != name[:-1])]
            anchor, name = anchor[fresh], name[fresh]
            starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
            lengths = np.diff(np.r_[starts, len(anchor)])
            keep = np.repeat(lengths > 1, lengths)
            return pa.RecordBatch.from_arrays([pa.array(name[keep]), pa.array(anchor[keep])], ["s1", "anchor"])

        for batch in batches:
            flag = batch.column("proven").to_numpy(zero_copy_only=False)
            anchor, name = batch.column("anchor").to_numpy(), batch.column("s1").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(name[flag]), pa.array(anchor[flag])], ["s1", "anchor"])
            held = [np.concatenate([held[0], anchor[~flag]]), np.concatenate([held[1], name[~flag]])]
            if len(held[0]):
                cut = int(np.searchsorted(held[0], held[0][-1]))
                if cut:
                    yield shared(held[0][:cut], held[1][:cut])
                    held = [x[cut:] for x in held]
        if len(held[0]):
            yield shared(*held)

    pairs = docs.select("text").mapInArrow(emit, "anchor long, s1 long, proven boolean")
    place = F.when(F.col("proven"), F.xxhash64("s1", "anchor")).otherwise(F.col("anchor"))
    dealt = pairs.repartition(place).sortWithinPartitions("anchor", "s1")
    return materialize(dealt.mapInArrow(prove, "s1 long, anchor long").distinct(), "shared_anchors")


def _texts(docs: DataFrame, names: DataFrame, shared: DataFrame) -> DataFrame:
    """(doc_id, s1, s2, anchors, text) of the first documents that have shared anchors, bucketed by doc_id."""
    first = names.groupBy("s1", "s2").agg(F.min("doc_id").alias("doc_id"))
    wanted = materialize(shared.groupBy("s1").agg(F.collect_list("anchor").alias("anchors")).join(first, "s1"), "wanted")
    buckets = shuffle_parts(docs.sparkSession)
    near = sifted(docs, "doc_id", sieve(wanted, "doc_id")).repartition(buckets, "doc_id")
    both = near.join(wanted.repartition(buckets, "doc_id").hint("merge"), "doc_id")
    return bucketed(both.select("doc_id", "s1", "s2", "anchors", "text"), ["doc_id"], None, "shared_texts")


def _cut(texts: DataFrame, busy: np.ndarray) -> DataFrame:
    """The stretches at shared anchors, in two kinds of rows.

    Each has (doc_id, s1, start, n, h1, h2), ``start`` being its first word's place, n > 0 its
    words, and h1, h2 their digest. Once per batch and stretch (doc_id, n, h1, h2, route, words)
    follow with n = 0, ``route`` being the anchor. A stretch whose anchor the ``busy`` table
    marks is cut into its windows, which have n = -1 there and need no route and words.
    """
    shared = texts.sparkSession.sparkContext.broadcast(busy)
    out = ["doc_id", "s1", "start", "n", "h1", "h2", "route", "words"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column("doc_id").to_numpy(), batch.column("anchors")
            asked1, asked2 = batch.column("s1").to_numpy(), batch.column("s2").to_numpy()
            known: dict[bytes, list] = {}
            crowd = shared.value
            for begin, _, w in grouped(batch.column("text")):
                hashes = w.hashes()
                text, first, last, anchor = stretches(w, hashes)
                if not len(text):
                    continue
                own1, own2 = sequence_names(w, hashes)
                anchor = anchor.view(np.int64)
                edges = np.searchsorted(text, np.arange(len(own1) + 1))
                keep = np.zeros(len(text), bool)
                for t in np.unique(text):
                    row = begin + t
                    if own1[t] == asked1[row] and own2[t] == asked2[row]:  # else another text of this doc_id
                        mine = slice(edges[t], edges[t + 1])
                        keep[mine] = np.isin(anchor[mine], lists[int(row)].values.to_numpy())
                text, first, last, anchor = text[keep], first[keep], last[keep], anchor[keep]
                many = marked(anchor, crowd)
                if many.any():
                    times = np.where(many, last - first + 1, 1)
                    place = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                    text, first, last, anchor, many = (np.repeat(x, times) for x in (text, first, last, anchor, many))
                    first = np.where(many, first + place, first)
                    last = np.where(many, first, last)
                if not len(text):
                    continue
                body, starts, ends = w.data.tobytes(), w.starts, w.ends
                digests = []
                for i, (a, b) in enumerate(zip(starts[first].tolist(), ends[last + WINDOW - 1].tolist())):
                    words = b" ".join(body[a:b].split())
                    digests.append(name := hashlib.blake2b(words, digest_size=16).digest())
                    doc = int(ids[begin + text[i]])
                    if name in known:
                        known[name][1] = min(known[name][1], doc)
                    else:
                        known[name] = [None, doc, None] if many[i] else [int(anchor[i]), doc, words.decode()]
                h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                none = pa.nulls(len(text))
                row = begin + text
                columns = [ids[row], asked1[row], first - w.bounds[text], (last - first + WINDOW).astype(np.int32), h[:, 0], h[:, 1]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), none.cast(kinds[6]), none.cast(kinds[7])], out)
            h = np.frombuffer(b"".join(known), "<i8").reshape(-1, 2)
            none = pa.nulls(len(known))
            values = list(known.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array([v[1] for v in values], kinds[0]), none.cast(kinds[1]), none.cast(kinds[2]),
                 pa.array([-1 if v[2] is None else 0 for v in values], kinds[3]), pa.array(h[:, 0]), pa.array(h[:, 1]),
                 pa.array([v[0] for v in values], kinds[6]), pa.array([v[2] for v in values], kinds[7])],
                out,
            )

    schema = "doc_id long, s1 long, start long, n int, h1 long, h2 long, route long, words string"
    path = f"{scratch_folder(texts.sparkSession)}/stretches-{uuid.uuid4().hex}"
    texts.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    return texts.sparkSession.read.schema(schema).parquet(path)


def _once(table: pa.Table) -> pa.Table:
    """One row per stretch, with its least document."""
    h1, h2, first = (table[c].to_numpy() for c in ("h1", "h2", "first"))
    order = np.lexsort((first, h2, h1))
    h1, h2 = h1[order], h2[order]
    fresh = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
    return table.take(pa.array(order[fresh]))


def _search(table: pa.Table) -> pa.Table:
    """(h1, h2, first, hits) of a shard's distinct stretches (h1, h2, words, first).

    ``hits`` are the offsets of windows that an earlier document has as well.
    """
    table = _once(table.combine_chunks())
    groups, ids, lengths = list(grouped(table["words"].combine_chunks())), [], []
    for _, _, w in groups:
        ids.append(w.hashes())
        lengths.append(w.n_words)
    hashes, lengths = np.concatenate(ids), np.concatenate(lengths)
    distinct, number = np.unique(hashes, return_inverse=True)
    starts = np.cumsum(lengths) - lengths + np.arange(len(lengths))  # a separator after each stretch
    text = np.zeros(len(hashes) + len(lengths), np.int64)
    text[np.arange(len(hashes)) + np.repeat(np.arange(len(lengths)), lengths)] = number + 1
    first = table["first"].to_numpy()
    owner = np.repeat(first, lengths + 1)
    index = FMIndex(text, len(distinct) + 1, WINDOW)
    stretch, offset, block = index.windows(starts, lengths, text)
    hit = index.least(owner)[block] < first[stretch]
    stretch, offset = stretch[hit], offset[hit]
    order = np.lexsort((offset, stretch))
    stretch, offset = stretch[order], offset[order]
    edges = np.searchsorted(stretch, np.arange(len(lengths) + 1))
    hits = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(offset, pa.int64()))
    return pa.Table.from_arrays([table["h1"].combine_chunks(), table["h2"].combine_chunks(), table["first"].combine_chunks(), hits], ["h1", "h2", "first", "hits"])


def _judge(found: DataFrame, shard_words: int) -> DataFrame:
    """(h1, h2, first, hits) of every distinct stretch, from the rows without a place."""
    usual = found.filter("n = 0")
    shards = max(1, -(-usual.count() * (WINDOW + 4) // shard_words))
    shard = F.pmod(F.xxhash64("route"), F.lit(shards)).alias("shard")
    judged = usual.select("h1", "h2", "words", F.col("doc_id").alias("first"), shard).groupBy("shard").applyInArrow(
        lambda t: _search(t), "h1 long, h2 long, first long, hits array<long>"
    )
    # single windows need no index: their first document is an aggregate
    first = found.filter("n = -1").groupBy("h1", "h2").agg(F.min("doc_id").alias("first"))
    return materialize(judged.unionByName(first.withColumn("hits", F.array().cast("array<long>"))), "judged")


def _digest(rows: DataFrame) -> DataFrame:
    """(doc_id, s1, s2, n_removed, kept) from (doc_id, text, s1, s2, spans), ``spans`` the places of windows to remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked1, asked2, lists = batch.column("s1").to_numpy(), batch.column("s2").to_numpy(), batch.column("spans")
            at, removed, digests = [], [], []
            for begin, end, w in grouped(batch.column("text")):
                own1, own2 = sequence_names(w, w.hashes())
                body = w.data.tobytes()
                for t in range(end - begin):
                    row = begin + t
                    if asked1[row] != own1[t] or asked2[row] != own2[t]:
                        continue  # another text of this doc_id
                    words = body[w.offsets[t] : w.offsets[t + 1]].split()
                    gone = np.zeros(len(words) + 1, np.int64)
                    places = np.unique(lists[row].values.to_numpy())
                    np.add.at(gone, places, 1)
                    np.add.at(gone, places + WINDOW, -1)
                    kept = np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()
                    at.append(row)
                    digests.append(hashlib.sha256(b" ".join([words[k] for k in kept])).hexdigest())
                    removed.append(len(words) - len(kept))
            taken = batch.select(["doc_id", "s1", "s2"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(removed, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "s1", "s2", "n_removed", "kept"]
            )

    return rows.mapInArrow(run, "doc_id long, s1 long, s2 long, n_removed long, kept string")


def repeated_windows(cut: DataFrame, judged: DataFrame) -> DataFrame:
    """(doc_id, s1, spans): places of the windows that an earlier document has, for first documents."""
    both = cut.select("doc_id", "s1", "start", "n", "h1", "h2").join(judged.hint("merge"), ["h1", "h2"])
    every = F.sequence(F.lit(0).cast("long"), (F.col("n") - WINDOW).cast("long"))
    hits = F.when(F.col("doc_id") > F.col("first"), every).otherwise(F.col("hits"))
    places = both.select("doc_id", "s1", F.transform(hits, lambda x: x + F.col("start")).alias("at")).filter(F.size("at") > 0)
    return places.groupBy("doc_id", "s1").agg(F.flatten(F.collect_list("at")).alias("spans"))


def dedup_substrings(docs: DataFrame, shard_words: int = SHARD_WORDS, crowded: int = CROWDED) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.coalesce("doc_id", F.lit(_NULL_ID)).alias("doc_id"), "text")
    names = _names(rows)
    shared = _shared_anchors(rows)
    busy = shared.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > crowded)
    texts = _texts(rows, names, shared)
    stretched = _cut(texts, sieve(busy, "anchor", hashed=True))
    judged = _judge(stretched.filter("n <= 0"), shard_words)
    spans = repeated_windows(stretched.filter("n > 0"), judged)
    touched = texts.drop("anchors").join(spans.withColumnRenamed("doc_id", "__id").hint("merge"), (F.col("doc_id") == F.col("__id")) & (texts["s1"] == spans["s1"])).select(
        "doc_id", "text", texts["s1"], "s2", "spans"
    )
    digests = _digest(touched).dropDuplicates(["doc_id", "s1", "s2"])
    first = materialize(names.groupBy("s1", "s2").agg(F.min("doc_id").alias("__first")), "firsts")
    placed = names.join(first.hint("merge"), ["s1", "s2"]).join(digests, ["doc_id", "s1", "s2"], "left")
    copy = (F.col("doc_id") > F.col("__first")) & (F.col("n_words") >= WINDOW)
    return placed.select(
        F.when(F.col("doc_id") != _NULL_ID, F.col("doc_id")).alias("doc_id"), "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "whole")).alias("kept_sha256"),
    )
