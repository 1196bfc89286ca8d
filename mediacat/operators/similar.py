"""Similar images: fingerprints within a Hamming limit and comparable file sizes.

Two modes. ``banded`` links similar files that agree on one of eight non-zero 8-bit bands.
``complete`` (the default) misses nothing: by pigeonhole, two fingerprints that differ in
fewer than ``threshold`` of 64 bits agree on all bits of at least ``pick`` of ``blocks``
blocks, so a join on every choice of ``pick`` blocks meets every such pair.

Neither mode has a bucket limit or lists all pairs of a crowd:

* equal fingerprints collapse to one node per run of comparable sizes, so a burst or a
  picture that makes up a third of the catalogue is one node;
* first, each node is only linked to the pivot of some of its buckets, and the components
  of these links are contracted; a dense crowd becomes one component at linear cost;
* then nodes of different components are compared, in batches of choices: buckets held by
  one component leave first, one link per pair of components is kept, and the contracted
  graph is solved before the next batch;
* a bucket beyond ``CROWD`` nodes is dealt out in cells of bounded size, and each is compared
  as blocks of bits, the nodes outside the leading component with all others; only links that
  join components leave a cell. Beyond ``FINE`` nodes the key is finer as well.

Every step drops only comparisons whose outcome cannot change a component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mediacat.functions.hashing import fingerprint_bits, hamming_bits, usable_fingerprint
from mediacat.operators.components import connected_components
from mediacat.operators.filters import active
from mediacat.operators.keeper import pick_keeper
from mediacat.runtime import hot_keys, join_lookup, materialize, with_running_sum, written_hot_keys

# Limits of the similarity test.
THRESHOLD = 10
BANDS = 8
SIZE_RATIO = 2

BITS = 64
# A bucket with more nodes than this is crowded.
CROWD = 2_000
# Rows of a crowded bucket that meet in one part; every further part repeats rows.
TILE = 2_000
# Rows on either side of a cell of a crowded bucket of nodes, which one task holds at a time.
CELL = 16_384
# Comparisons made at once in a cell, which fit a core's cache.
BLOCK = 1 << 17
# A crowded bucket beyond this gets finer keys, which repeat each of its rows 55 times: below,
# comparing its nodes costs less than that.
FINE = 80_000
# Choices of intact blocks whose buckets get pivot links.
STAR_CHOICES = 12
# Candidate rows per task of a self-join.
ROWS_PER_TASK = 500_000
# Comparisons per task inside crowded buckets.
PAIRS_PER_TASK = 500_000_000
# Keyed rows (nodes times choices) that one batch shuffles.
BATCH_ROWS = 2_000_000_000


def fingerprints(media: DataFrame) -> DataFrame:
    """(id, file_size, ph) of active rows with a usable fingerprint."""
    return active(media).select("id", "file_size", F.col("perceptual_hash").alias("ph"))


def _packed(fp: DataFrame) -> DataFrame:
    """id, size (missing as 0), bits."""
    return fp.filter(usable_fingerprint(F.col("ph"))).select(
        "id", F.coalesce("file_size", F.lit(0)).cast("bigint").alias("size"), fingerprint_bits(F.col("ph")).alias("bits")
    )


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask


def _mask(positions) -> int:
    return sum(1 << p for p in positions)


# --- banded mode ---------------------------------------------------------------------


def similar_pairs(
    fp: DataFrame,
    threshold: int = THRESHOLD,
    bands: int = BANDS,
    size_ratio: int = SIZE_RATIO,
) -> DataFrame:
    """(id_a, id_b, distance) of all similar pairs that share a non-zero band.

    For callers that want the pairs themselves, whose number grows with the square of a
    crowd; ``similar_classes`` holds the same pairs in a row per file and one per pair of
    different fingerprints, and groups come from ``near_components``, which lists none.
    """
    width = BITS // bands
    rows = _packed(fp)
    keys = [
        F.shiftrightunsigned("bits", (bands - 1 - i) * width).bitwiseAND(F.lit((1 << width) - 1)) for i in range(bands)
    ]
    banded = rows.select("id", "size", "bits", F.posexplode(F.array(*keys)).alias("band", "value")).filter(
        F.col("value") != 0
    )
    kept = banded
    left = kept.select("band", "value", F.col("id").alias("id_a"), F.col("size").alias("size_a"), F.col("bits").alias("bits_a"))
    right = kept.select("band", "value", F.col("id").alias("id_b"), F.col("size").alias("size_b"), F.col("bits").alias("bits_b"))
    distance = hamming_bits(F.col("bits_a"), F.col("bits_b"))
    near = (
        (F.col("id_a") < F.col("id_b"))
        & (F.greatest("size_a", "size_b") <= size_ratio * F.least("size_a", "size_b"))
        & (distance < threshold)
    )
    return (
        left.join(right.hint("merge"), ["band", "value"])
        .filter(near)
        .select("id_a", "id_b", distance.alias("distance"))
        .distinct()
    )


# --- complete mode -------------------------------------------------------------------


def blocks_for(nodes: int, threshold: int = THRESHOLD) -> int:
    """Number of blocks: finer keys for larger catalogues.

    ``threshold - 1`` differing bits spoil at most as many blocks, so ``threshold - 1 +
    pick`` blocks leave ``pick`` intact. The smallest ``pick`` is taken that keeps buckets
    of random fingerprints well below a crowd.
    """
    for pick in (2, 3, 4, 5):
        blocks = threshold - 1 + pick
        if nodes / 2 ** (BITS * pick / blocks) <= CROWD / 2:
            break
    return blocks


def _cut(positions: list[int], parts: int) -> list[list[int]]:
    edges = [round(i * len(positions) / parts) for i in range(parts + 1)]
    return [positions[a:b] for a, b in zip(edges, edges[1:])]


def _intact_before(x: Column, blocks: list[int], last: Column, bits: Column | None = None) -> Column:
    """How many blocks up to number ``last`` agree, given the XOR of two fingerprints.

    With ``bits``, one of the two, blocks without a set bit do not count.
    """
    total = F.lit(0)
    for number, mask in enumerate(blocks):
        agree = (last >= number) & (x.bitwiseAND(F.lit(_signed(mask))) == 0)
        if bits is not None:
            agree = agree & (bits.bitwiseAND(F.lit(_signed(mask))) != 0)
        total = total + F.when(agree, 1).otherwise(0)
    return total


def size_class(size: Column) -> Column:
    """Exact floor(log2(size)); -1 for 0."""
    return F.when(size > 0, F.length(F.bin(size)) - 1).otherwise(-1)


def fingerprint_nodes(fp: DataFrame, size_ratio: int = SIZE_RATIO) -> tuple[DataFrame, DataFrame]:
    """Collapse equal fingerprints: (files, nodes).

    files: id, node. nodes: node (its least id), bits, lo, hi, copies. Sizes within one
    power of two are always comparable, so per fingerprint only the extremes of at most
    64 classes matter; a run of classes whose neighbours are comparable is one node.
    """
    if size_ratio != 2:
        raise ValueError("size classes are powers of two: size_ratio must be 2")
    rows = _packed(fp).withColumn("class", size_class(F.col("size")))
    classes = rows.groupBy("bits", "class").agg(
        F.min("size").alias("lo"), F.max("size").alias("hi"), F.min("id").alias("least"), F.count("*").alias("n")
    )
    # at most 64 rows per fingerprint
    w = W.partitionBy("bits").orderBy("class")
    starts = (F.lag("hi").over(w) * size_ratio < F.col("lo")) | F.lag("hi").over(w).isNull()
    runs = classes.withColumn("run", F.sum(starts.cast("int")).over(w))
    w_run = W.partitionBy("bits", "run")
    runs = materialize(
        runs.select(
            "bits", "class", "n",
            F.min("least").over(w_run).alias("node"),
            F.min("lo").over(w_run).alias("lo"),
            F.max("hi").over(w_run).alias("hi"),
        ),
        "runs",
    )
    hot = written_hot_keys(runs, ["bits", "class"], "n")
    files = join_lookup(rows, runs.select("bits", "class", "node"), ["bits", "class"], hot).select("id", "node")
    nodes = runs.groupBy("node", "bits", "lo", "hi").agg(F.sum("n").alias("copies"))
    return files, nodes


def _near(a: str, b: str, threshold: int, size_ratio: int) -> Column:
    sizes = F.greatest(f"lo_{a}", f"lo_{b}") <= size_ratio * F.least(f"hi_{a}", f"hi_{b}")
    return sizes & (hamming_bits(F.col(f"bits_{a}"), F.col(f"bits_{b}")) < threshold)


def _spread(keyed: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Partition by key once, for both sides of a self-join (the exchange is reused).

    The number of partitions follows the exploded row count: the optimizer sizes a
    generated table like its input, so it would broadcast or coalesce far too much.
    """
    configured = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(max(configured, -(-rows // ROWS_PER_TASK)), *keys)


def _side(rows: DataFrame, side: str, keys: list[str]) -> DataFrame:
    return rows.select(*[F.col(c) if c in keys else F.col(c).alias(f"{c}_{side}") for c in rows.columns])


def _star_links(in_buckets: DataFrame, keys: list[str], near: Column) -> DataFrame:
    """(label_a, label_b): links from the least node of each bucket to the others it is near to."""
    rest = [c for c in in_buckets.columns if c not in (*keys, "nid")]
    pivot = in_buckets.groupBy(*keys).agg(
        F.min("nid").alias("nid_a"), *[F.min_by(c, "nid").alias(f"{c}_a") for c in rest], F.count("*").alias("n")
    )
    pivot = materialize(pivot.filter(F.col("n") > 1), "pivots")
    hot = written_hot_keys(pivot, keys, "n")
    rows = join_lookup(_side(in_buckets, "b", keys), pivot.drop("n"), keys, hot)
    return rows.filter((F.col("nid_a") != F.col("nid_b")) & near).select("label_a", "label_b")


def _merged(labelled: DataFrame, links: DataFrame) -> DataFrame:
    """``labelled`` with the labels of linked components replaced by their least."""
    # links between components repeat: they combine in the task that finds them
    top = connected_components(links.distinct(), "label_a", "label_b")
    if top.isEmpty():
        return labelled
    top = top.select(F.col("node").alias("label"), F.col("component").alias("__top"))
    counts = labelled.groupBy("label").agg(F.count("*").alias("n")).join(top, "label")
    renamed = materialize(counts.select("label", "__top", "n"), "renamed")
    hot = written_hot_keys(renamed, ["label"], "n")
    moved = join_lookup(labelled, renamed.drop("n"), ["label"], hot, "left")
    moved = moved.withColumn("label", F.coalesce("__top", "label")).select(*labelled.columns)
    return materialize(moved, "labelled")


def key_masks(blocks: int, pick: int) -> tuple[list[list[int]], list[tuple], list[int]]:
    """(bit positions of each block, choices of ``pick`` blocks, mask of each choice)."""
    cuts = _cut(list(range(BITS)), blocks)
    choices = list(combinations(range(blocks), pick))
    return cuts, choices, [_signed(_mask(p for b in c for p in cuts[b])) for c in choices]


def _keyed(rows: DataFrame, masks: list[int], numbers) -> DataFrame:
    """One row per choice in ``numbers``, with its number and the bits it keeps."""
    picked = F.array(*[F.struct(F.lit(i).alias("choice"), F.lit(masks[i]).alias("mask")) for i in numbers])
    return rows.select("*", F.explode(picked).alias("c")).select(
        *rows.columns, "c.choice", F.col("bits").bitwiseAND(F.col("c.mask")).alias("key")
    )


def near_components(
    nodes: DataFrame,
    threshold: int = THRESHOLD,
    size_ratio: int = SIZE_RATIO,
    blocks: int | None = None,
    crowd: int = CROWD,
    bands: int | None = None,
    batch_rows: int = BATCH_ROWS,
    tile: int = CELL,
    fine: int = FINE,
) -> DataFrame:
    """(nid, label): the components of all similar pairs of ``nodes`` (nid, bits, lo, hi).

    With ``bands``, only of pairs that agree on one of so many bands with a bit set in it.
    The choices of blocks are worked off in batches of at most ``batch_rows`` keyed rows (at
    least one choice), and each batch contracts what it linked before the next one starts:
    buckets whose nodes all have one label by then leave before the self-join.

    A bucket beyond ``crowd`` nodes is compared in cells of about ``tile`` nodes a side, and
    beyond ``fine`` nodes on finer keys. ``crowd`` alone repeats no row, however small it is.
    """
    total = nodes.count()
    blocks = bands or blocks or blocks_for(total, threshold)
    pick = 1 if bands else blocks - (threshold - 1)
    cuts, choices, masks = key_masks(blocks, pick)
    keys = ["choice", "key"]

    def keyed(rows: DataFrame, numbers) -> DataFrame:
        out = _keyed(rows, masks, numbers)
        return out.filter(F.col("key") != 0) if bands else out

    near = _near("a", "b", threshold, size_ratio)
    lasts = F.array(*[F.lit(max(c)) for c in choices])[F.col("choice")]
    differing = F.col("bits_a").bitwiseXOR(F.col("bits_b"))
    first = _intact_before(differing, [_mask(c) for c in cuts], lasts, F.col("bits_a") if bands else None) == pick

    # Pass 1: stars, in evenly spread choices.
    spread = range(0, len(choices), -(-len(choices) // STAR_CHOICES))
    stars = _star_links(keyed(nodes.withColumn("label", F.col("nid")), spread), keys, near)
    parts = connected_components(stars, "label_a", "label_b")
    parts = parts.select(F.col("node").alias("nid"), F.col("component").alias("label"))
    labelled = materialize(nodes.join(parts, "nid", "left").withColumn("label", F.coalesce("label", "nid")), "labelled")

    # Pass 2: compare across components; a pair counts at the first choice it agrees on.
    width = max(1, min(len(choices), batch_rows // max(total, 1)))
    for start in range(0, len(choices), width):
        numbers = range(start, min(start + width, len(choices)))
        sizes = keyed(labelled, numbers).groupBy(*keys).agg(
            F.count("*").alias("n"), F.min("label").alias("least"), F.max("label").alias("most")
        )
        mixed = materialize(sizes.filter(F.col("least") < F.col("most")).select(*keys, "n"), "mixed")
        rows = mixed.agg(F.sum("n").alias("rows"), F.max("n").alias("most")).first()
        if rows["rows"] is None:
            continue
        if rows["most"] > crowd:
            crowded = mixed.filter(F.col("n") > crowd)
            hot = written_hot_keys(crowded, keys, "n")
            rows_of = partial(join_lookup, keys=keys, hot=hot)
            stars = _star_links(rows_of(keyed(labelled, numbers), crowded.drop("n")), keys, near)
            labelled = _merged(labelled, stars)
            links = []
            plain = crowded.filter(F.col("n") <= fine).drop("n")
            links.append(_crowded_links(rows_of(keyed(labelled, numbers), plain), keys, tile, threshold, size_ratio))
            if rows["most"] > fine:
                large = rows_of(keyed(labelled, numbers), crowded.filter(F.col("n") > fine).drop("n"))
                finer, finer_keys = _finer(large, cuts, choices, threshold)
                links.append(_crowded_links(finer, finer_keys, tile, threshold, size_ratio))
            labelled = _merged(labelled, reduce(DataFrame.unionByName, links))
        calm = keyed(labelled, numbers).join(mixed.filter(F.col("n") <= crowd).drop("n"), keys, "left_semi")
        calm = _spread(calm, keys, rows["rows"])
        across = (
            _side(calm, "a", keys)
            .join(_side(calm, "b", keys).hint("merge"), keys)
            .filter((F.col("nid_a") < F.col("nid_b")) & (F.col("label_a") != F.col("label_b")) & near & first)
        )
        labelled = _merged(labelled, across.select("label_a", "label_b"))
    return labelled.select("nid", "label")


def _finer(
    in_crowd: DataFrame, cuts: list[list[int]], choices: list[tuple], threshold: int
) -> tuple[DataFrame, list[str]]:
    """(rows, keys): buckets cut by two intact parts of the bits outside their key.

    So even one enormous bucket spreads over thousands of finer ones, and every similar pair
    still meets in one of them.
    """
    parts, pick = threshold + 1, 2
    rows = []
    for number, choice in enumerate(choices):
        outside = [p for b in range(len(cuts)) if b not in choice for p in cuts[b]]
        pieces = _cut(outside, parts)
        for fine, two in enumerate(combinations(range(parts), pick)):
            rows.append((number, fine, _signed(_mask(p for b in two for p in pieces[b]))))
    # a fixed number of rows: choices times pairs of parts
    finer = F.broadcast(in_crowd.sparkSession.createDataFrame(rows, "choice int, fine int, fine_mask bigint"))
    fine = (
        in_crowd.join(finer, "choice")
        .withColumn("fine_key", F.col("bits").bitwiseAND(F.col("fine_mask")))
        .drop("fine_mask")
    )
    return fine, ["choice", "key", "fine", "fine_key"]


def _crowded_links(in_crowd: DataFrame, keys: list[str], tile: int, threshold: int, size_ratio: int) -> DataFrame:
    """(label_a, label_b): links that join the components similar inside crowded buckets.

    A bucket held by one component has nothing left to find; in a mixed one the nodes outside
    its leading component, the minor ones, meet all others, which covers every cross pair. A
    bucket is a grid of cells of about ``tile`` minor nodes by ``tile`` nodes, one cell if it
    is no larger. The pairs of a cell are not rows: its task compares them in blocks.
    """
    sizes = in_crowd.groupBy(*keys, "label").agg(F.count("*").alias("n"))
    lead = sizes.groupBy(*keys).agg(
        F.max_by("label", "n").alias("lead"), F.count("*").alias("labels"), F.sum("n").alias("n"), F.max("n").alias("top")
    )
    minors = F.col("n") - F.col("top")
    mixed = materialize(
        lead.filter(F.col("labels") > 1).select(
            *keys, "lead", "n", "top",
            F.ceil(minors / tile).cast("int").alias("minor_splits"), F.ceil(F.col("n") / tile).cast("int").alias("splits"),
        ),
        "mixed",
    )
    work = mixed.agg(
        F.sum(F.col("n") * F.col("minor_splits") + minors * F.col("splits")).alias("rows"), F.sum(F.col("n") * minors).alias("pairs")
    ).first()
    # sized by comparisons too: few rows can hold many
    size = max(work["rows"] or 0, -(-(work["pairs"] or 0) // PAIRS_PER_TASK) * ROWS_PER_TASK)
    rows = join_lookup(in_crowd, mixed.drop("n", "top"), keys, written_hot_keys(mixed, keys, "n"))
    rows = rows.select("*", (F.col("label") == F.col("lead")).alias("leads")).withColumns({
        "minor_part": F.pmod(F.xxhash64("nid"), F.col("minor_splits")).cast("int"),
        "part": F.pmod(F.xxhash64("nid"), F.col("splits")).cast("int"),
    })

    def cell(minor_part: Column, part: Column, asks: Column, held: Column) -> Column:
        return F.struct(minor_part.alias("cell_minor"), part.alias("cell_part"), asks.alias("asks"), held.alias("held"))

    # every node is held by the cells of its part; a minor one asks in those of its minor part
    holding = F.transform(
        F.sequence(F.lit(0), F.col("minor_splits") - 1), lambda i: cell(i, F.col("part"), F.lit(False), F.lit(True))
    )
    asking = F.transform(
        F.sequence(F.lit(0), F.col("splits") - 1),
        lambda j: cell(F.col("minor_part"), j, F.lit(True), j == F.col("part")),
    )
    elsewhere = F.filter(holding, lambda c: c["cell_minor"] != F.col("minor_part"))
    cells = F.when(F.col("leads"), holding).otherwise(F.concat(asking, elsewhere))
    by = [*keys, "cell_minor", "cell_part"]
    dealt = rows.withColumn("c", F.explode(cells)).select(*keys, "c.*", "nid", "label", "bits", "lo", "hi", "leads")
    dealt = _spread(dealt, by, size).sortWithinPartitions(*by)
    kind = in_crowd.schema["label"].dataType.simpleString()
    return dealt.mapInArrow(_cell_links(by, threshold, size_ratio), f"label_a {kind}, label_b {kind}")


def _cell_links(by: list[str], threshold: int, size_ratio: int):
    """Rows sorted by ``by`` -> (label_a, label_b); holds a cell and a batch of rows at a time."""

    def links(cell: pa.Table) -> pa.RecordBatch:
        nid, label, bits, lo, hi, asks, held, leads = [
            cell.column(c).to_numpy() for c in ("nid", "label", "bits", "lo", "hi", "asks", "held", "leads")
        ]
        a, b = _joining(nid, label, bits.view(np.uint64), lo, hi, asks, held, leads, threshold, size_ratio)
        kind = cell.schema.field("label").type
        return pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], ["label_a", "label_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_cell = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            if open_cell is not None:
                rows = pa.concat_tables([open_cell, rows])
            new = np.zeros(rows.num_rows - 1, bool)
            for c in by:
                key = rows.column(c).to_numpy()
                new |= key[1:] != key[:-1]
            starts = [0, *(np.flatnonzero(new) + 1).tolist()]
            for start, stop in zip(starts, starts[1:]):
                yield links(rows.slice(start, stop - start))
            open_cell = rows.slice(starts[-1])
        if open_cell is not None:
            yield links(open_cell)

    return run


def _joining(
    nid: np.ndarray, label: np.ndarray, bits: np.ndarray, lo: np.ndarray, hi: np.ndarray,
    asks: np.ndarray, held: np.ndarray, leads: np.ndarray, threshold: int, size_ratio: int,
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of labels that join what is similar in a cell, fewer than it has labels."""
    order = np.argsort(nid)
    asking, minor = order[asks[order]], order[(held & ~leads)[order]]
    # two minor nodes meet where either asks: a block leaves out those before its first one
    first = np.searchsorted(nid[minor], nid[asking], "right")
    others = np.concatenate([minor, np.flatnonzero(held & leads)])
    labels, code = np.unique(label, return_inverse=True)
    root = np.arange(len(labels))
    step = max(1, BLOCK // max(1, len(others)))
    asking_bits, other_bits = bits[asking][:, None], bits[others]
    for at in range(0, len(asking), step):
        b = others[first[at] :]
        differing = np.bitwise_count(asking_bits[at : at + step] ^ other_bits[first[at] :])
        i, j = np.divmod(np.flatnonzero(differing < threshold), max(1, len(b)))
        if not len(i):
            continue
        i, j = asking[at + i], b[j]
        # lo <= size_ratio * hi without the product, which could overflow
        fits = -(-np.maximum(lo[i], lo[j]) // size_ratio) <= np.minimum(hi[i], hi[j])
        root = _united(root, code[i[fits]], code[j[fits]])
    moved = np.flatnonzero(root != np.arange(len(root)))
    return labels[moved], labels[root[moved]]


def _united(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root``, the least member of each component, after the pairs (a, b) are joined."""
    while True:
        a, b = root[a], root[b]
        apart = a != b
        if not apart.any():
            return root
        a, b = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        root = root.copy()
        np.minimum.at(root, b, a)
        while True:
            further = root[root]
            if np.array_equal(further, root):
                break
            root = further


# --- factorised pairs ----------------------------------------------------------------


def similar_classes(
    fp: DataFrame,
    threshold: int = THRESHOLD,
    bands: int | None = BANDS,
    size_ratio: int = SIZE_RATIO,
    blocks: int | None = None,
    crowd: int = CROWD,
    tile: int = TILE,
) -> tuple[DataFrame, DataFrame]:
    """(members, links): the pairs of ``similar_pairs`` without those of equal fingerprints spelled out.

    members: id, class_id (least id with the fingerprint), size; one row per usable file.
    links: class_a <= class_b, distance; classes whose size ranges are comparable, a class
    of several files with itself included. A pair of files is similar exactly if their
    classes link and their sizes are comparable, so a burst costs a row per file and one
    link. ``bands=None`` asks for no common band. Repeated ids stay repeated; no usable
    file gives two empty tables.

    Candidates meet on choices of intact blocks, as in the complete mode. A bucket beyond
    ``crowd`` classes is cut into parts that meet in tiles of two. As each row is repeated for
    every part, there are two of them, or more only where they would exceed ``tile`` classes.
    """
    rows = _packed(fp)
    classes = materialize(
        rows.groupBy("bits").agg(
            F.min("id").alias("class_id"), F.min("size").alias("lo"), F.max("size").alias("hi"), F.count("*").alias("n")
        ),
        "classes",
    )
    hot = written_hot_keys(classes, ["bits"], "n")
    members = join_lookup(rows, classes.select("bits", "class_id"), ["bits"], hot).select("id", "class_id", "size")

    total = classes.count()
    blocks = blocks or blocks_for(total, threshold)
    pick = blocks - (threshold - 1)
    cuts, choices, masks = key_masks(blocks, pick)
    keys = ["choice", "key"]
    keyed = _keyed(classes.drop("n"), masks, range(len(masks)))
    shared = materialize(
        keyed.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)
        .withColumn("parts", F.when(F.col("n") <= crowd, 1).otherwise(F.greatest(F.lit(2), F.ceil(F.col("n") / tile))).cast("int")),
        "shared",
    )
    held = join_lookup(keyed, shared.select(*keys, "parts"), keys, written_hot_keys(shared, keys, "n"))
    held = held.withColumn("part", F.pmod(F.xxhash64("class_id"), "parts").cast("int"))
    tile = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    tiled = held.withColumn("other", tile).withColumns(
        {"tile_lo": F.least("part", "other"), "tile_hi": F.greatest("part", "other")}
    )
    cells = [*keys, "tile_lo", "tile_hi"]
    spread = shared.agg(F.sum(F.col("n") * F.col("parts")).alias("rows")).first()["rows"] or 0
    tiled = _spread(tiled.drop("parts", "other"), cells, spread)
    differing = F.col("bits_a").bitwiseXOR(F.col("bits_b"))
    lasts = F.array(*[F.lit(max(c)) for c in choices])[F.col("choice")]
    once = (_intact_before(differing, [_mask(c) for c in cuts], lasts) == pick) & (
        (F.col("tile_lo") == F.col("tile_hi")) | (F.col("part_a") != F.col("part_b"))
    )
    if bands:
        in_band = _intact_before(differing, [_mask(c) for c in _cut(list(range(BITS)), bands)], F.lit(bands), F.col("bits_a"))
        once = once & (in_band > 0)
    across = (
        _side(tiled, "a", cells)
        .join(_side(tiled, "b", cells).hint("merge"), cells)
        .filter((F.col("class_id_a") < F.col("class_id_b")) & _near("a", "b", threshold, size_ratio) & once)
        .select(
            F.col("class_id_a").alias("class_a"), F.col("class_id_b").alias("class_b"),
            F.bit_count(differing).alias("distance"),
        )
    )
    own = classes.filter(F.col("n") > 1).select(
        F.col("class_id").alias("class_a"), F.col("class_id").alias("class_b"), F.lit(0).alias("distance")
    )
    return members, own.unionByName(across)


def expand_pairs(members: DataFrame, links: DataFrame, size_ratio: int = SIZE_RATIO) -> DataFrame:
    """(id_a, id_b, distance): the pairs that ``similar_classes`` stands for."""
    a = members.select(F.col("class_id").alias("class_a"), F.col("id").alias("x"), F.col("size").alias("size_x"))
    b = members.select(F.col("class_id").alias("class_b"), F.col("id").alias("y"), F.col("size").alias("size_y"))
    comparable = F.greatest("size_x", "size_y") <= size_ratio * F.least("size_x", "size_y")
    once = (F.col("class_a") != F.col("class_b")) | (F.col("x") < F.col("y"))
    return (
        links.join(a, "class_a").join(b, "class_b").filter(comparable & once)
        .select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "distance")
    )


def link_counts(members: DataFrame, links: DataFrame, size_ratio: int = SIZE_RATIO) -> DataFrame:
    """(id, class_id, n_links): how many files each file is similar to, with no pair listed.

    The partners of a file of size s are those of linked classes with sizes from s / ratio
    to s * ratio: a difference of two running sums over sizes. Of two linked classes that
    with fewer sizes does the work: it asks for its sizes in the other's sums, and adds its
    own sizes to those of the other's neighbourhood, where the other asks once for all. So a
    burst of many sizes that links with many classes costs their sum, not their product.
    """
    sizes = materialize(members.groupBy("class_id", "size").agg(F.count("*").alias("n")), "sizes")
    widths = materialize(sizes.groupBy("class_id").agg(F.count("*").alias("width")), "widths")
    links = materialize(links.select("class_a", "class_b"), "links")
    swapped = links.filter(F.col("class_a") != F.col("class_b")).select(
        F.col("class_b").alias("class_a"), F.col("class_a").alias("class_b")
    )
    directed = links.unionByName(swapped)
    for side in ("a", "b"):
        width = widths.select(F.col("class_id").alias(f"class_{side}"), F.col("width").alias(f"width_{side}"))
        directed = directed.join(width, f"class_{side}")
    directed = materialize(directed, "directed")
    asking = directed.filter(F.col("width_a") < F.col("width_b")).select("class_a", "class_b")
    giving = directed.filter(F.col("width_a") >= F.col("width_b")).select("class_a", "class_b")

    # own: the sizes of a class; all: those of its neighbourhood
    asks = materialize(
        asking.join(sizes.select(F.col("class_id").alias("class_a"), "size"), "class_a"), "asks"
    )
    around = giving.join(sizes.withColumnRenamed("class_id", "class_b"), "class_b").groupBy("class_a", "size").agg(
        F.sum("n").alias("n")
    )
    own, every = F.lit("own").alias("sums"), F.lit("all").alias("sums")
    given = sizes.select(own, F.col("class_id").alias("of"), F.col("size").alias("at"), F.lit(-2).alias("sign"), "size", "n")
    given = given.unionByName(
        around.select(every, F.col("class_a").alias("of"), F.col("size").alias("at"), F.lit(-2).alias("sign"), "size", "n")
    )
    below = F.when(F.col("size") > 0, F.expr(f"(size - 1) div {int(size_ratio)}")).otherwise(-1)
    ends = F.explode(F.array(
        F.struct((F.col("size") * size_ratio).alias("at"), F.lit(1).alias("sign")),
        F.struct(below.cast("bigint").alias("at"), F.lit(-1).alias("sign")),
    ))
    wanted = asks.select(own, F.col("class_b").alias("of"), "size").distinct()
    wanted = wanted.unionByName(sizes.select(every, F.col("class_id").alias("of"), "size"))
    points = wanted.withColumn("e", ends).select("sums", "of", "e.at", "e.sign", "size", F.lit(0).cast("bigint").alias("n"))
    # at one place the files come before the questions
    order = [F.col(c).asc() for c in ("sums", "of", "at", "sign", "size")]
    summed = with_running_sum(given.unionByName(points), order, "n", "upto").filter(F.col("sign") >= -1)
    partners = summed.groupBy("sums", "of", "size").agg(F.sum(F.col("upto") * F.col("sign")).alias("partners"))
    partners = materialize(partners, "partners")
    asked = asks.join(
        partners.filter(F.col("sums") == "own").select(F.col("of").alias("class_b"), "size", "partners"), ["class_b", "size"]
    )
    found = asked.select(F.col("class_a").alias("class_id"), "size", "partners").unionByName(
        partners.filter(F.col("sums") == "all").select(F.col("of").alias("class_id"), "size", "partners")
    )
    # a file is no partner of itself
    selves = links.filter(F.col("class_a") == F.col("class_b")).select(F.col("class_a").alias("class_id"))
    found = found.unionByName(
        sizes.join(selves, "class_id", "left_semi").select("class_id", "size", F.lit(-1).cast("bigint").alias("partners"))
    )
    found = materialize(found.groupBy("class_id", "size").agg(F.sum("partners").alias("n_links")), "found")
    hot = written_hot_keys(sizes, ["class_id", "size"], "n")
    return join_lookup(members, found, ["class_id", "size"], hot).select("id", "class_id", "n_links")


# --- groups --------------------------------------------------------------------------


def similar_components(fp: DataFrame, mode: str = "complete", **limits) -> DataFrame:
    """(id, component) of every file similar to another, directly or through others.

    ``fp`` is (id, file_size, ph); the component is its least id.
    """
    if mode == "banded":
        limits = {"bands": BANDS} | limits
    files, nodes = fingerprint_nodes(fp)
    nodes = materialize(nodes.withColumn("nid", F.monotonically_increasing_id()), "nodes")
    parts = near_components(nodes.select("nid", "bits", "lo", "hi"), **limits)
    placed = materialize(nodes.select("nid", "node", "copies").join(parts, "nid"), "placed")
    # a node is named by its least file, so the least node of a component is its least file
    names = placed.groupBy("label").agg(
        F.min("node").alias("component"), F.sum("copies").alias("files"), F.count("*").alias("n")
    )
    names = names.filter(F.col("files") > 1)
    named = join_lookup(placed, names.select("label", "component"), ["label"], hot_keys(names, ["label"], "n"))
    hot = written_hot_keys(placed, ["node"], "copies")
    return join_lookup(files, named.select("node", "component"), ["node"], hot).select("id", "component")


def similar_groups(
    media: DataFrame,
    members: DataFrame | None = None,
    mode: str = "complete",
    **limits,
) -> tuple[DataFrame, DataFrame]:
    """(members, groups) of the 'similar' reason.

    With ``members`` (of any reason) the run is incremental: a component with a member
    that already belongs to a group is left alone.
    """
    found = similar_components(fingerprints(media), mode, **limits)
    found = materialize(found, "components")
    if members is not None:
        taken = (
            found.join(members.select(F.col("photo_id").alias("id")), "id", "left_semi").select("component").distinct()
        )
        found = found.join(taken, "component", "left_anti")
    rows = found.select(
        F.concat(F.lit("similar:"), F.col("component").cast("string")).alias("group_id"), F.col("id").alias("photo_id")
    )
    groups = pick_keeper(rows, media, tie="id").withColumn("reason", F.lit("similar"))
    return rows, groups.select("group_id", "reason", "keeper_id")
