"""Connected components by randomised contraction.

Each round every node points at the neighbour (or itself) with the smallest random
priority, edges are relabelled to the representatives and loops vanish. A constant
fraction of the nodes disappears per round in expectation, whatever the shape of the
graph, so the number of rounds is logarithmic even for long chains, and the edge table
only shrinks (Bögeholz, Brand, Todor: In-database connected component analysis, 2020).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacat.runtime import join_lookup, materialize, release, row_hot_keys, written_hot_keys


def _relabel(rows: DataFrame, column: str, table: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Replace ``column`` by its representative; ``table`` is (node, rep) and total on it."""
    mapped = join_lookup(
        rows.withColumnRenamed(column, "__node"),
        table.select(F.col("node").alias("__node"), F.col("rep").alias("__rep")),
        ["__node"],
        None if hot is None else hot.select(F.col("node").alias("__node")),
    )
    return mapped.drop("__node").withColumnRenamed("__rep", column)


def _priority(node, round_no: int):
    return F.xxhash64(node, F.lit(round_no))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", min_rows: int | None = None) -> DataFrame:
    """(node, component) for every node on an edge; the component is its least node.

    The only thing that reaches the driver is whether any edge is left.
    """
    current = materialize(
        edges.select(F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst"))
        .filter(F.col("src") != F.col("dst"))
        .distinct(),
        "edges",
    )
    maps: list[DataFrame] = []
    while not current.isEmpty():
        n = len(maps)
        both = current.unionByName(current.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = F.min(F.struct(_priority(F.col("dst"), n).alias("p"), F.col("dst").alias("node"))).alias("near")
        own = F.struct(_priority(F.col("src"), n).alias("p"), F.col("src").alias("node"))
        reps = materialize(
            both.groupBy("src")
            .agg(least, F.count("*").alias("degree"))
            .select(F.col("src").alias("node"), F.least("near", own)["node"].alias("rep"), "degree"),
            "reps",
        )
        hot = written_hot_keys(reps, ["node"], "degree", min_rows)
        moved = _relabel(_relabel(current, "src", reps, hot), "dst", reps, hot)
        maps.append(reps.select("node", "rep"))
        previous, current = current, materialize(
            moved.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
            .filter(F.col("src") != F.col("dst"))
            .distinct(),
            "edges",
        )
        release(previous)
    if not maps:
        return current.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    # Resolve the pointers from the last round back; the tables grow geometrically, so all
    # rounds together cost about as much as the first.
    labels = maps.pop()
    while maps:
        step = maps.pop()
        # a representative that met no edge in a later round is final
        later = labels.select(F.col("node").alias("rep"), F.col("rep").alias("__final"))
        resolved = join_lookup(step, later, ["rep"], row_hot_keys(step, ["rep"], min_rows), "left")
        labels = materialize(resolved.select("node", F.coalesce("__final", "rep").alias("rep")), "labels")
    names = materialize(
        labels.groupBy("rep").agg(F.min("node").alias("component"), F.count("*").alias("__n")), "names"
    )
    hot = written_hot_keys(names, ["rep"], "__n", min_rows)
    return join_lookup(labels, names.drop("__n"), ["rep"], hot).select("node", "component")
