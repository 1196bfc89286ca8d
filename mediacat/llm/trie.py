"""Prefix trie of conversations, with subtree sums by the Euler-tour technique.

A node is a distinct sequence of first turns. Every node has an enter and an exit arc; the
successor of an arc follows from first child, next sibling and parent. The tour is list-ranked by
contraction: runs of arcs that lie in one task become one element each, then rounds of joins
merge elements with their successors by coin until few are left, and ranks are handed back down.
Prefix sums at the ranks give each subtree's leaves and savings as a difference.

A conversation or node may hold any share of the rows: places and prefix hashes are sums of
blocks, siblings are dealt out by range, and no join has a key with an unbounded number of rows.

Nulls: a null role or text is empty, null turns come first, rows without conversation id are
left out. Rows of equal turn come in order of a hash of role and text. An empty table has no
nodes; other columns are ignored. Sequences are told apart by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mediacat.llm.digests import as_bytes, joined_digests
from mediacat.runtime import materialize, release

# Turns and arcs whose prefix sums one task makes.
BLOCK = 1 << 12
ARC_BLOCK = 1 << 16
# Arcs that a task contracts at once.
LOCAL_ROWS = 1 << 20
# Elements of the list that one task ranks in the end.
LAST_ELEMENTS = 1 << 12
# Rounds whose ranks are handed down in one job.
DOWN_ROUNDS = 4


def turns_in_order(rows: DataFrame) -> DataFrame:
    """(conv_id, nth, one, two, n_bytes): places from 0, two hash lanes, UTF-8 bytes of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    lanes = [F.conv(F.substring(said, at, 16), 16, -10).cast("long").alias(n) for at, n in ((1, "one"), (17, "two"))]
    light = rows.filter("conv_id IS NOT NULL").select("conv_id", "turn", *lanes, F.octet_length(text).cast("long").alias("n_bytes"))
    order = ["conv_id", "turn", "one", "two"]
    dealt = light.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    return _places(materialize(dealt, "turns"), ["conv_id"], "nth").drop("turn", "at")


def _places(ranked: DataFrame, group: list[str], name: str) -> DataFrame:
    """0-based place in its group of each row of a written range-sorted table with ``at``.

    A group may span many partitions; (group, partition) pairs are joined back, never groups.
    """
    ranked = ranked.withColumn("__part", F.shiftright("at", 33))
    parts = ranked.groupBy(*group, "__part").agg(F.count("*").alias("__n"), F.min("at").alias("__low"))
    earlier = W.partitionBy(*group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("__n").over(earlier), F.lit(0))
    parts = parts.select(*group, "__part", (before - F.col("__low")).alias("__shift"))
    return ranked.join(parts, [*group, "__part"]).withColumn(name, F.col("at") + F.col("__shift")).drop("__part", "__shift")


def rebuilt(turns: DataFrame, head: Column | None = None, base: Column | None = None) -> DataFrame:
    """(conv_id, depth, one, two, n_bytes): the first turns of a base conversation, then one's own.

    ``head`` is the number of turns taken from ``base``, both functions of conv_id; by default
    nothing is taken. A conversation keeps its own turns behind its first ``head``.
    """
    head = F.lit(0) if head is None else head
    base = F.col("conv_id") if base is None else base
    own = turns.withColumn("__head", head).withColumn("__base", base)
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("__length"))
    convs = lengths.select("conv_id", head.cast("long").alias("__head"), base.alias("__base"))
    given = convs.join(lengths.withColumnRenamed("conv_id", "__base"), "__base", "left")
    given = given.select("conv_id", "__base", "__head", F.least("__head", F.coalesce("__length", F.lit(0))).alias("__given"))
    # a place block of a conversation is joined, not the conversation
    block = F.floor(F.col("nth") / BLOCK)
    tail = own.filter(F.col("nth") >= F.col("__head")).drop("__head", "__base").withColumn("__block", block)
    blocks = tail.groupBy("conv_id", "__block").agg(F.lit(0).alias("__0")).drop("__0").join(given, "conv_id")
    tail = tail.join(blocks.select("conv_id", "__block", "__head", "__given"), ["conv_id", "__block"])
    tail = tail.withColumn("depth", F.col("nth") - F.col("__head") + F.col("__given") + 1)
    first = turns.withColumnRenamed("conv_id", "__base").join(given.drop("__given"), "__base")
    first = first.filter(F.col("nth") < F.col("__head")).withColumn("depth", F.col("nth") + 1)
    out = ["conv_id", "depth", "one", "two", "n_bytes"]
    return tail.select(*out).unionByName(first.select(*out))


def prefixes(rows: DataFrame) -> DataFrame:
    """Rows with ``p1, p2``, the hash of the turns up to each, and ``q1, q2``, that of those before."""
    lanes = {"e1": F.xxhash64(F.lit(1), "depth", "one", "two"), "e2": F.xxhash64(F.lit(2), "depth", "two", "one")}
    rows = rows.withColumns(lanes).withColumn("__block", F.floor(F.col("depth") / BLOCK))
    blocks = rows.groupBy("conv_id", "__block").agg(F.bit_xor("e1").alias("__x1"), F.bit_xor("e2").alias("__x2"))
    earlier = W.partitionBy("conv_id").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    before = [F.coalesce(F.expr(f"bit_xor(__x{k})").over(earlier), F.lit(0)).alias(f"__b{k}") for k in (1, 2)]
    blocks = blocks.select("conv_id", "__block", *before)
    inside = W.partitionBy("conv_id", "__block").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    joined = rows.join(blocks, ["conv_id", "__block"])
    upto = {f"p{k}": F.bit_xor(f"e{k}").over(inside).bitwiseXOR(F.col(f"__b{k}")) for k in (1, 2)}
    own = {f"q{k}": F.col(f"p{k}").bitwiseXOR(F.col(f"e{k}")) for k in (1, 2)}
    return joined.withColumns(upto).withColumns(own).select("conv_id", "depth", "n_bytes", "p1", "p2", "q1", "q2")


def nodes_of(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes (nid, conv_id, depth, p1, p2, q1, q2, n_convs, n_bytes), range-sorted by parent and conv_id."""
    found = rows.groupBy("depth", "p1", "p2").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"),
        F.min("q1").alias("q1"), F.min("q2").alias("q2"),
    )
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    zero = F.lit(0).cast("long")
    root = root.select(zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), "conv_id", "n_convs",
                       zero.alias("n_bytes"), zero.alias("q1"), zero.alias("q2"))
    order = ["depth", "q1", "q2", "conv_id"]
    found = materialize(found.unionByName(root), "found")
    dealt = found.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(dealt.withColumn("nid", F.monotonically_increasing_id()), "nodes")


def family(nodes: DataFrame) -> DataFrame:
    """Nodes with parent, parent_conv_id, next sibling, first child and n_children.

    Siblings lie side by side in the written order. What they need of their parent is joined to
    (parent, partition) pairs first and then, by those, to the siblings themselves.
    """
    group = ["depth", "q1", "q2"]
    nodes = nodes.withColumn("__part", F.shiftright("nid", 33))
    runs = nodes.groupBy(*group, "__part").agg(
        F.count("*").alias("__n"), F.min("nid").alias("__low"), F.max("nid").alias("__high")
    )
    of_parent = W.partitionBy(*group)
    runs = runs.withColumn("__after", F.lead("__low").over(of_parent.orderBy("__part")))
    children = runs.groupBy(*group).agg(F.sum("__n").alias("n_children"), F.min("__low").alias("first_child"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"),
                           F.col("nid").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    runs = runs.join(parents, group, "left").drop("__n", "__low")
    joined = nodes.join(runs, [*group, "__part"])
    # inside a run the next sibling has the next number
    following = F.when(F.col("nid") < F.col("__high"), F.col("nid") + 1).otherwise(F.col("__after"))
    joined = joined.withColumn("next", following).drop("__part", "__high", "__after")
    below = children.select((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"),
                            "n_children", "first_child")
    out = joined.join(below, ["depth", "p1", "p2"], "left")
    return out.withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def arcs_of(nodes: DataFrame) -> DataFrame:
    """The tour's arcs (id, succ, conv_id, depth): 2 * nid enters a node, 2 * nid + 1 leaves it."""
    enter, leave = F.col("nid") * 2, F.col("nid") * 2 + 1
    down = F.coalesce(F.col("first_child") * 2, leave)
    on = F.coalesce(F.col("next") * 2, F.col("parent") * 2 + 1)
    pair = F.array(F.struct(enter.alias("id"), down.alias("succ")), F.struct(leave.alias("id"), on.alias("succ")))
    return nodes.select("conv_id", "depth", F.explode(pair).alias("arc")).select("arc.id", "arc.succ", "conv_id", "depth")


def _contracted(local_rows: int):
    """Chains of arcs that lie in one chunk become elements; the others learn their lead and distance."""

    def chunk(ids: np.ndarray, succ: np.ndarray) -> pa.RecordBatch:
        n = len(ids)
        order = np.argsort(ids)
        at = np.minimum(np.searchsorted(ids[order], succ), n - 1)
        to = np.where(ids[order][at] == succ, order[at], -1)  # index of the successor, -1 outside
        before = np.full(n, -1)
        here = np.flatnonzero(to >= 0)
        before[to[here]] = here
        lead, far = np.where(before < 0, np.arange(n), before), (before >= 0).astype(np.int64)
        while True:  # pointer jumping towards the chain's head
            jump = lead[lead]
            if (jump == lead).all():
                break
            far, lead = far + far[lead], jump
        ends = np.flatnonzero(to < 0)
        tail, length = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        tail[lead[ends]], length[lead[ends]] = succ[ends], far[ends] + 1
        head = before < 0
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids), pa.array(ids[lead], mask=head), pa.array(far),
                pa.array(tail, mask=~head | (tail < 0)), pa.array(length, mask=~head),
            ],
            ["id", "lead", "far", "succ", "length"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).fill_null(-1).to_numpy()))
            n += batch.num_rows
            if n >= local_rows:
                yield chunk(*map(np.concatenate, zip(*held)))
                held, n = [], 0
        if n:
            yield chunk(*map(np.concatenate, zip(*held)))

    return run


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranks of the few elements that are left, by walking the list."""
    rows = [r for batch in batches for r in batch.to_pylist()]
    if not rows:
        return
    by_id = {r["id"]: r for r in rows}
    start = by_id.keys() - {r["succ"] for r in rows}
    ids, ranks, rank = [], [], 0
    at = start.pop() if start else None
    while at is not None:
        ids.append(at)
        ranks.append(rank)
        rank += by_id[at]["length"]
        at = by_id[at]["succ"]
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ranks, pa.int64())], ["id", "rank"])


def list_ranks(arcs: DataFrame, local_rows: int = LOCAL_ROWS, last: int = LAST_ELEMENTS) -> DataFrame:
    """(id, rank) of the arcs (id, succ, conv_id, depth) of one list, ranks from 0.

    Arcs of neighbouring depths of one conversation meet in one task and contract there. In each
    round an element with coin 1 takes in its successor if that has coin 0, a quarter of all on
    average; every join key is one element's id.
    """
    dealt = arcs.repartition("conv_id", F.floor(F.col("depth") / BLOCK)).sortWithinPartitions("conv_id", "depth")
    rounds = [
        materialize(
            dealt.select("id", "succ").mapInArrow(_contracted(local_rows), "id long, lead long, far long, succ long, length long"),
            "contracted",
        )
    ]
    while True:
        left = rounds[-1].filter("lead IS NULL")
        if left.count() <= last:
            break
        seed = F.lit(len(rounds))
        coin = {c: F.xxhash64(seed, c).bitwiseAND(F.lit(1)) for c in ("id", "succ")}
        takes = (coin["id"] == 1) & (coin["succ"] == 0) & F.col("succ").isNotNull()
        left = left.select("id", "succ", "length", F.coalesce(takes, F.lit(False)).alias("takes"), (coin["id"] == 0).alias("given"))
        leads = left.filter("takes").select(F.col("id").alias("l_id"), F.col("succ").alias("l_succ"), F.col("length").alias("l_length"))
        rest = left.filter("NOT takes")
        met = rest.join(leads, (F.col("id") == F.col("l_succ")) & F.col("given"), "left")
        null, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
        merged = F.struct(F.col("id"), F.col("l_id").alias("lead"), F.col("l_length").alias("far"), null.alias("succ"), null.alias("length"))
        grown = F.struct(F.col("l_id").alias("id"), null.alias("lead"), zero.alias("far"), F.col("succ"),
                         (F.col("length") + F.col("l_length")).alias("length"))
        same = F.struct("id", null.alias("lead"), zero.alias("far"), "succ", "length")
        rows = F.explode(F.when(F.col("l_id").isNotNull(), F.array(grown, merged)).otherwise(F.array(same)))
        rounds.append(materialize(met.select(rows.alias("r")).select("r.*"), "contracted"))
    few = rounds[-1].filter("lead IS NULL").select("id", "succ", "length")
    ranks = few.repartition(1).mapInArrow(_ranked, "id long, rank long")
    for k, table in enumerate(reversed(rounds)):
        known = ranks.select(F.col("id").alias("lead"), "rank")
        down = table.select("id", F.coalesce("lead", "id").alias("lead"), "far")
        ranks = down.join(known, "lead").select("id", (F.col("rank") + F.col("far")).alias("rank"))
        if k % DOWN_ROUNDS == DOWN_ROUNDS - 1 and k < len(rounds) - 1:
            ranks = materialize(ranks, "ranks")
    ranks = materialize(ranks, "ranks")
    for table in rounds:
        release(table)
    return ranks


def subtree_sums(ranks: DataFrame, nodes: DataFrame, values: list[str]) -> DataFrame:
    """(nid, values) summed over each node's subtree, from prefix sums along the tour."""
    own = nodes.select((F.col("nid") * 2).alias("id"), *values)
    rows = ranks.join(own, "id", "left").fillna(0, values).withColumn("__block", F.floor(F.col("rank") / ARC_BLOCK))
    blocks = rows.groupBy("__block").agg(*[F.sum(v).alias(f"__{v}") for v in values])
    earlier = W.orderBy("__block").rowsBetween(W.unboundedPreceding, -1)  # one row per ARC_BLOCK arcs
    blocks = blocks.select("__block", *[F.coalesce(F.sum(f"__{v}").over(earlier), F.lit(0)).alias(f"__{v}") for v in values])
    inside = W.partitionBy("__block").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.join(blocks, "__block")
    upto = [(F.sum(v).over(inside) + F.col(f"__{v}")).alias(f"__upto_{v}") for v in values]
    rows = rows.select("id", *values, *upto)
    # enter arc: sum before it; exit arc: sum up to it; sums never fall along the tour
    sums = [(F.max(f"__upto_{v}") - F.min(F.col(f"__upto_{v}") - F.col(v))).alias(v) for v in values]
    return rows.groupBy(F.expr("id div 2").alias("nid")).agg(*sums)


def prefix_trie(
    rows: DataFrame, head: Column | None = None, base: Column | None = None,
    local_rows: int = LOCAL_ROWS, last: int = LAST_ELEMENTS,
) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of conversations (conv_id, turn, role, text), rebuilt as ``rebuilt`` says.

    Nodes: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, and p1, p2, which with depth name the node. Ends: (depth, p1, p2, conv_id), the
    node that each conversation ends at.
    """
    turns = materialize(turns_in_order(rows), "places")
    convs = materialize(turns.select("conv_id").distinct(), "conversations")
    said = materialize(prefixes(rebuilt(turns, head, base)), "prefixes")
    nodes = materialize(family(nodes_of(said, convs)), "family")
    ranks = list_ranks(arcs_of(nodes), local_rows, last)
    values = nodes.select(
        "nid", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"),
    )
    sums = subtree_sums(ranks, values, ["n_leaves", "saved_tokens"])
    out = nodes.select("nid", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "p1", "p2").join(sums, "nid").drop("nid")
    ends = said.groupBy("conv_id").agg(F.max(F.struct("depth", "p1", "p2")).alias("end"))
    zero = F.lit(0).cast("long")
    ends = convs.join(ends, "conv_id", "left").select(
        *[F.coalesce(F.col("end")[c], zero).alias(c) for c in ("depth", "p1", "p2")], "conv_id"
    )
    return out, ends


def with_ends_hash(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """Nodes with ``ends_sha256`` over the ids of the conversations that end there, in order, comma-joined."""
    key = ["depth", "p1", "p2"]
    ends = materialize(ends, "ends").withColumn("item", as_bytes(F.col("conv_id").cast("string")))
    hashes = joined_digests(ends, key, ["conv_id"], "item", b",").withColumnRenamed("sha256", "ends_sha256")
    out = nodes.join(hashes, key, "left")
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))).drop("p1", "p2")
