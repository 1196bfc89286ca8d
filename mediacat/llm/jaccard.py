"""N-gram Jaccard join: documents whose sets of word shingles overlap enough, as components.

1. One pass over the texts gives each document's set a 64-bit signature (the node: documents
   with equal sets are one), its size and a small histogram, and counts shingles in a table of
   fixed size. The counts fix one global order of shingles, rare first.
2. A second pass emits each node's prefix in that order: so many shingles that two similar
   sets must share one. Shingles are dealt out by hash and sorted, and streamed bucket by
   bucket. Length and positional filters drop nodes that no other of the bucket can match. The
   rest go to the group of the bucket's least node (by a hash), so the many shingles that the
   same documents share meet in few groups and each pair is verified there once.
3. Groups are cut into parts of bounded size with the least node in each. The suffix filter
   compares the histograms; what passes has its sets computed from the texts once more and
   verified exactly. A node leaves its part with the name of what it is connected to there:
   the group's least node where possible.
4. Groups of several parts are gone through again by pairs of parts, for nodes that are not
   yet connected to the most of the group, and only pairs not connected yet are compared.

No pairs are listed and nothing is capped: a group of n near copies costs its parts, and
only members that stay apart are compared with the others.

Defined results: a text without words (null, empty) has the empty set and is linked with
nothing; rows with one doc_id and different texts are judged each by its own text; a null
doc_id takes part but is never a component's name unless it has no other; rows repeated
exactly share their component; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacat.llm.sieve import sieve, sifted
from mediacat.llm.words import U64, grouped, mix64, window_hashes
from mediacat.operators.components import connected_components
from mediacat.runtime import materialize

# Production parameters.
SHINGLE = 5
THRESHOLD = (75, 100)  # similarity as a fraction
SLOTS = 1 << 20  # counters of shingles; fixes the size of the broadcast (4 MB)
CLASSES = 512  # classes of the suffix filter's histogram
PART = 256  # nodes compared with each other at a time
HOT_NODES = 200_000  # shingles counted at least so often take their least node by an aggregate

_BLOCK = 1024
_SLOT_SHIFT = U64(64 - (SLOTS - 1).bit_length())


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    for first, end, w in grouped(column):
        words = w.hashes(lower=True)
        runs = window_hashes(words, size)
        for i in range(end - first):
            a, b = w.bounds[i], w.bounds[i + 1]
            if b - a >= size:
                yield np.unique(runs[a : b - size + 1])
            else:
                yield window_hashes(words[a:b], int(b - a)) if b > a else runs[:0]


def histogram(s: np.ndarray) -> bytes:
    """Saturating counts by class; their differences bound the sets' difference from below."""
    counts = np.bincount((s & U64(CLASSES - 1)).astype(np.int64), minlength=CLASSES)
    return zlib.compress(np.minimum(counts, 255).astype(np.uint8).tobytes(), 1)


def signature(s: np.ndarray) -> int:
    """A 64-bit name of a set, signed as Spark has it."""
    a, b = s.sum(dtype=U64), mix64(s).sum(dtype=U64)
    return int(mix64(np.array([a ^ mix64(np.array([b ^ U64(len(s))]))[0]], U64)).view(np.int64)[0])


def least_overlap(x, y, threshold=THRESHOLD):
    """Fewest common elements of similar sets of sizes x and y."""
    num, den = threshold
    return -((-(x + y) * num) // (num + den))


def prefix_length(n: int, threshold=THRESHOLD) -> int:
    num, den = threshold
    return n - -(-num * n // den) + 1


def _slots(s: np.ndarray) -> np.ndarray:
    return (mix64(s) >> _SLOT_SHIFT).astype(np.int64)


def _sketch(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, body, node, size, hist) and (block, data): counters of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(SLOTS, np.int32), False
        for batch in batches:
            seen = True
            nodes, sizes, hists = [], [], []
            for s in shingle_sets(batch.column("text")):
                sizes.append(len(s))
                nodes.append(signature(s) if len(s) else None)
                hists.append(histogram(s) if len(s) else None)
                at, n = np.unique(_slots(s), return_counts=True)
                counts[at] += n.astype(np.int32)
            none = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("body"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()),
                 pa.array(hists, pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())],
                names,
            )
        if seen:
            blocks = [(i, counts[i * _BLOCK : (i + 1) * _BLOCK]) for i in range(SLOTS // _BLOCK)]
            kept = [(i, zlib.compress(b.tobytes(), 1)) for i, b in blocks if b.any()]
            n = pa.nulls(len(kept))
            yield pa.RecordBatch.from_arrays(
                [n.cast(pa.int64()), n.cast(pa.int64()), n.cast(pa.int64()), n.cast(pa.int32()), n.cast(pa.binary()),
                 pa.array([i for i, _ in kept], pa.int32()), pa.array([d for _, d in kept], pa.binary())],
                names,
            )

    names = ["doc_id", "body", "node", "size", "hist", "block", "data"]
    rows = docs.select("doc_id", F.xxhash64("text").alias("body"), "text").mapInArrow(
        run, "doc_id long, body long, node long, size int, hist binary, block int, data binary"
    )
    out = materialize(rows, "sketch")
    sketches = out.filter("block IS NULL").select("doc_id", "body", "node", "size", "hist")
    return sketches, out.filter("block IS NOT NULL").select("block", "data")


def _counts(parts: DataFrame) -> np.ndarray:
    """The tasks' counters added up, block by block; the result has a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data")):
                new = np.frombuffer(zlib.decompress(data.as_py()), np.int32).astype(np.int64)
                sums[block] = sums[block] + new if block in sums else new
        names, kinds = list(sums), [np.minimum(s, 2**31 - 1).astype(np.int32).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(kinds, pa.binary())], ["block", "data"])

    total = np.zeros(SLOTS, np.int32)
    for row in parts.repartition("block").mapInArrow(run, "block int, data binary").collect():  # 4 MB together
        total[row["block"] * _BLOCK : (row["block"] + 1) * _BLOCK] = np.frombuffer(row["data"], np.int32)
    return total


def _prefixes(docs: DataFrame, counts: np.ndarray, threshold, hot: int) -> DataFrame:
    """(shingle, node, place, hot): each set's prefix, rare shingles first; place packs size and position."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        names = ["shingle", "node", "place", "hot"]

        def flush(held):
            sh, nd, pl, ht = (np.concatenate(x) for x in zip(*held))
            return pa.RecordBatch.from_arrays([pa.array(sh.view(np.int64)), pa.array(nd), pa.array(pl), pa.array(ht)], names)

        for batch in batches:
            held, known, n_held = [], set(), 0
            for s in shingle_sets(batch.column("text")):
                n = len(s)
                if not n:
                    continue
                node = signature(s)
                if node in known:  # copies in a task need not be sent twice
                    continue
                known.add(node)
                k = prefix_length(n, threshold)
                often = order[_slots(s)]
                first = np.lexsort((s, often))[:k]
                place = (np.int64(n) << np.int64(32)) | np.arange(k, dtype=np.int64)
                held.append((s[first], np.full(k, node), place, often[first] >= hot))
                n_held += k
                if n_held > 200_000:
                    yield flush(held)
                    held, n_held = [], 0
            if held:
                yield flush(held)

    return docs.select("text").mapInArrow(run, "shingle long, node long, place long, hot boolean")


def _rank(node: np.ndarray) -> np.ndarray:
    """A fixed random order of nodes."""
    return mix64(node.view(np.uint64))


def _useful(size: np.ndarray, pos: np.ndarray, threshold) -> np.ndarray:
    """Which rows of a bucket match another by length and position."""
    num, den = threshold
    small, large = np.minimum(size[:, None], size[None, :]), np.maximum(size[:, None], size[None, :])
    before = np.minimum(pos[:, None], pos[None, :])
    after = np.minimum((size - pos)[:, None], (size - pos)[None, :])
    fits = (small * den >= large * num) & (before + after >= least_overlap(small, large, threshold))
    np.fill_diagonal(fits, False)
    return fits.any(1)


def _gather(rows: DataFrame, threshold) -> DataFrame:
    """(pivot, node) from rows sorted by (shingle, node): who meets in the group of which least node."""

    def buckets(shingle, node, place):
        fresh = np.r_[True, (shingle[1:] != shingle[:-1]) | (node[1:] != node[:-1])]
        shingle, node, place = shingle[fresh], node[fresh], place[fresh]
        starts = np.flatnonzero(np.r_[True, shingle[1:] != shingle[:-1]])
        lengths = np.diff(np.r_[starts, len(shingle)])
        size, pos = place >> 32, place & 0xFFFFFFFF
        keep = np.zeros(len(node), bool)
        two = starts[lengths == 2]
        if len(two):
            a, b = two, two + 1
            small, large = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
            room = np.minimum(pos[a], pos[b]) + np.minimum(size[a] - pos[a], size[b] - pos[b])
            fits = (small * threshold[1] >= large * threshold[0]) & (room >= least_overlap(small, large, threshold))
            keep[a] = keep[b] = fits
        for at, n in zip(starts[lengths > 2], lengths[lengths > 2]):
            # a crowded bucket's rows are kept as they are: nearly all have a match by length
            keep[at : at + n] = _useful(size[at : at + n], pos[at : at + n], threshold) if n <= 4 * PART else True
        group = np.repeat(np.arange(len(starts)), lengths)[keep]
        node = node[keep]
        if not len(node):
            return None
        rank = _rank(node)
        order = np.lexsort((rank, group))
        group, node = group[order], node[order]
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        pivot = np.repeat(node[first], np.diff(np.r_[first, len(node)]))
        pairs = np.unique(np.stack([pivot, node], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["pivot", "node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(c).to_numpy() for c in ("shingle", "node", "place")]
            held = [np.concatenate([a, b]) for a, b in zip(held, new)]
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last bucket may go on
            if cut:
                out = buckets(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
                if out is not None:
                    yield out
        if len(held[0]):
            out = buckets(*held)
            if out is not None:
                yield out

    return rows.mapInArrow(run, "pivot long, node long")


def _groups(docs: DataFrame, counts: np.ndarray, threshold, hot: int) -> DataFrame:
    """(pivot, node): the groups whose members are compared."""
    rows = _prefixes(docs, counts, threshold, hot)
    crowded = bool((counts >= hot).any())
    usual = rows.filter("NOT hot") if crowded else rows
    met = _gather(usual.select("shingle", "node", "place").repartition("shingle").sortWithinPartitions("shingle", "node"), threshold)
    if crowded:
        # a shingle in very many sets never enters one task: its least node comes from a partial
        # aggregate, and the join back can be split
        many = rows.filter("hot").select("shingle", "node")
        least = many.groupBy("shingle").agg(F.min(F.struct(F.xxhash64("node"), "node")).alias("least"), F.count("*").alias("n"))
        least = materialize(least.filter("n > 1").select("shingle", F.col("least.node").alias("pivot")), "pivots")
        met = met.unionByName(many.join(least.hint("merge"), "shingle").select("pivot", "node"))
    return materialize(met.distinct(), "groups")


def _texts(docs: DataFrame, nodes: DataFrame, carriers: DataFrame) -> DataFrame:
    """(node, set) of the nodes asked for, computed from one carrier document each.

    A filter of fixed size on the carriers' ids keeps most other texts from being moved; the
    join behind it is exact.
    """
    wanted = materialize(carriers.join(nodes.distinct(), "node", "left_semi"), "wanted")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [s.tobytes() for s in shingle_sets(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(out, pa.binary())], ["node", "set"])

    own = F.coalesce("doc_id", F.lit(-(2**63)))
    rows = docs.select(own.alias("doc_id"), F.xxhash64("text").alias("body"), "text")
    near = sifted(rows, "doc_id", sieve(wanted, "carrier"))
    exact = near.join(wanted.withColumnRenamed("carrier", "doc_id"), ["doc_id", "body"])
    return materialize(exact.select("node", "text").mapInArrow(sets, "node long, set binary"), "sets").dropDuplicates(["node"])


def _hists(column) -> np.ndarray:
    return np.stack([np.frombuffer(zlib.decompress(x), np.uint8) for x in column.to_pylist()]).astype(np.int16)


def _candidates(size, hist, comp, side, threshold):
    """(i, j) of rows that pass the length and suffix filters and are in different components."""
    num, den = threshold
    out_i, out_j = [], []
    for i in range(len(size) - 1):
        j = np.arange(i + 1, len(size))
        small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        j = j[(small * den >= large * num) & (comp[i] != comp[j]) & ((side[i] == 0) | (side[j] == 0) | (side[i] != side[j]))]
        if len(j):
            apart = np.abs(hist[j] - hist[i]).sum(1)
            j = j[apart <= size[i] + size[j] - 2 * least_overlap(size[i], size[j], threshold)]
            out_i.append(np.full(len(j), i))
            out_j.append(j)
    if not out_i:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(out_i), np.concatenate(out_j)


def _joined(size, hist, comp, side, sets, threshold, first: int) -> list[tuple[int, int]]:
    """(component, name) of components that similar sets connect to others, one pair verified per connection.

    The name is ``first`` where that is among them.
    """
    i, j = _candidates(size, hist, comp, side, threshold)
    lead: dict[int, int] = {}

    def root(x):
        while lead.setdefault(x, x) != x:
            lead[x] = lead[lead[x]]
            x = lead[x]
        return x

    for a, b in zip(i.tolist(), j.tolist()):
        ra, rb = root(int(comp[a])), root(int(comp[b]))
        if ra == rb:
            continue
        small, large = (sets[a], sets[b]) if size[a] <= size[b] else (sets[b], sets[a])
        at = np.searchsorted(large, small)
        at[at == len(large)] = 0
        common = int((large[at] == small).sum())
        if common * threshold[1] >= (size[a] + size[b] - common) * threshold[0]:
            lead[ra] = rb
    if first in lead:
        top = root(first)
        lead[top] = lead[first] = first
    return [(c, root(c)) for c in sorted(lead) if root(c) != c]


def _compare(parts: DataFrame, sketches: DataFrame, docs: DataFrame, carriers: DataFrame, threshold) -> DataFrame:
    """(pivot, src, dst): what components inside parts (pivot, part, node, comp, side) are connected to.

    Sides 1 and 2 of a part meet each other only.
    """
    keys = ["pivot", "part"]

    def prune(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        i, j = _candidates(
            table["size"].to_numpy().astype(np.int64), _hists(table["hist"]), table["comp"].to_numpy(), table["side"].to_numpy(), threshold
        )
        kept = np.zeros(table.num_rows, bool)
        kept[i] = kept[j] = True
        return table.filter(pa.array(kept))

    def link(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, U64) for x in table["set"].to_pylist()]
        pivot = table["pivot"][0].as_py()
        pairs = _joined(
            table["size"].to_numpy().astype(np.int64), _hists(table["hist"]), table["comp"].to_numpy(), table["side"].to_numpy(),
            sets, threshold, pivot,
        )
        columns = [[pivot] * len(pairs), [a for a, _ in pairs], [b for _, b in pairs]]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], ["pivot", "src", "dst"])

    schema = "pivot long, part string, node long, comp long, side int, size int, hist binary"
    known = parts.join(sketches, "node").select(*[c.split()[0] for c in schema.split(", ")])
    close = materialize(known.groupBy(*keys).applyInArrow(prune, schema), "close")
    full = close.join(_texts(docs, close.select("node"), carriers), "node")
    full = full.select(*close.columns, "set")
    return materialize(full.groupBy(*keys).applyInArrow(link, "pivot long, src long, dst long"), "links")


def similar_components(docs: DataFrame, threshold=THRESHOLD, part: int = PART, hot: int = HOT_NODES) -> DataFrame:
    """(doc_id, body, n_shingles, component_id) of each row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    rows, tallies = _sketch(docs)
    own = F.coalesce("doc_id", F.lit(-(2**63)))
    least = F.min(F.struct(own.alias("doc_id"), "body")).alias("least")
    nodes = materialize(
        rows.filter("node IS NOT NULL").groupBy("node")
        .agg(least, F.min("doc_id").alias("name"), F.first("size").alias("size"), F.first("hist").alias("hist")),
        "nodes",
    )
    carriers = nodes.select("node", F.col("least.doc_id").alias("carrier"), F.col("least.body").alias("body"))
    sketches = nodes.select("node", "size", "hist")
    met = _groups(docs, _counts(tallies), threshold, hot)
    sizes = materialize(met.groupBy("pivot").agg(F.count("*").alias("n")), "group_sizes")
    sized = materialize(met.join(sizes.hint("merge"), "pivot"), "sized")
    n_parts = F.ceil(F.col("n") / part)
    members = sized.select(
        "pivot",
        # the least node of a group goes to every part
        F.explode(
            F.when(F.col("node") == F.col("pivot"), F.sequence(F.lit(0).cast("long"), n_parts - 1))
            .otherwise(F.array(F.pmod(F.xxhash64("node"), n_parts)))
        ).alias("number"),
        "node", F.col("node").alias("comp"), F.lit(0).alias("side"),
    ).withColumn("part", F.col("number").cast("string"))
    links = _compare(members, sketches, docs, carriers, threshold)
    large = sized.filter(F.col("n") > part)
    if not large.isEmpty():
        links = links.unionByName(_compare(_cross_parts(large, links, part), sketches, docs, carriers, threshold))
    labels = connected_components(links.select("src", "dst"))
    labelled = nodes.select("node", "name").join(labels, "node", "left").withColumn("comp", F.coalesce("component", "node"))
    labelled = materialize(labelled.select("node", "name", "comp"), "labelled")
    names = materialize(labelled.groupBy("comp").agg(F.min("name").alias("component_id")), "names")
    table = materialize(labelled.join(names.hint("merge"), "comp").select("node", "component_id"), "components")
    return rows.join(table.hint("merge"), "node", "left").select(
        "doc_id", "body", F.col("size").cast("long").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def _cross_parts(large: DataFrame, links: DataFrame, part: int) -> DataFrame:
    """Pairs of parts of groups larger than one, for nodes outside the group's largest component.

    Components are those that the parts have found, (pivot, src, dst): nearly all of a crowd
    is connected to its least node, which every part has.

    The others ("minor" nodes) are dealt into parts that meet each other and every part of the
    largest component.
    """
    names = links.select("pivot", F.col("src").alias("node"), F.col("dst").alias("component"))
    known = large.join(names, ["pivot", "node"], "left").select("pivot", "node", F.coalesce("component", "node").alias("comp"))
    known = materialize(known, "cross_members")
    counts = known.groupBy("pivot", "comp").agg(F.count("*").alias("n"))
    top = counts.groupBy("pivot").agg(
        F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("total")
    ).filter(F.col("total") > F.col("top.n"))  # else all are one component
    half = part // 2
    minor_parts = F.ceil((F.col("total") - F.col("top.n")) / half)
    major_parts = F.ceil(F.col("top.n") / half)
    top = materialize(
        top.select("pivot", F.col("top.comp").alias("__top"), minor_parts.alias("__a"), major_parts.alias("__b")), "cross_groups"
    )
    rows = known.join(top.hint("merge"), "pivot").withColumn("__minor", F.col("comp") != F.col("__top"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("__minor"), F.col("__a")).otherwise(F.col("__b")))
    rows = rows.withColumn("__own", own)

    def entry(kind, i, j, side):
        return F.struct(F.concat_ws(":", F.lit(kind), i.cast("string"), j.cast("string")).alias("part"), side.alias("side"))

    zero = F.lit(0).cast("long")
    with_minor = F.transform(
        F.sequence(zero, F.col("__a") - 1),
        lambda j: entry(
            "a", F.least(j, F.col("__own")), F.greatest(j, F.col("__own")),
            F.when(j == F.col("__own"), 0).when(F.col("__own") < j, 1).otherwise(2),
        ),
    )
    with_major = F.transform(F.sequence(zero, F.col("__b") - 1), lambda j: entry("b", F.col("__own"), j, F.lit(1)))
    from_major = F.transform(F.sequence(zero, F.col("__a") - 1), lambda i: entry("b", i, F.col("__own"), F.lit(2)))
    places = F.when(F.col("__minor"), F.concat(with_minor, with_major)).otherwise(from_major)
    return rows.select("pivot", F.explode(places).alias("e"), "node", "comp").select(
        "pivot", F.col("e.part").alias("part"), "node", "comp", F.col("e.side").cast("int").alias("side")
    )
