"""Approximate nearest neighbours: stable projections, a kd-tree, and a chi-square stopping test.

Largest inner products become nearest points by one more coordinate that gives every vector
the same length. A few Gaussian projections keep the law of distances: squared projected
over squared true distance is chi-square with as many degrees of freedom as projections. A
kd-tree on the projections is laid over three levels: boxes of few rows, their tree built on a
bounded sample and all rows sorted into it; cells of neighbouring boxes, which Spark deals out;
and leaves inside a cell. A query verifies points leaf by leaf in the order of projected
distance and stops when the next leaf is so far that, by the chi-square law, a point better
than the k-th found would lie nearer with probability ``certainty``, which is therefore the
recall to expect at least. The same test, on the k-th found in the few cells nearest to the
query and on every box, decides which other cells see the query at all. A cell's vectors are
sent once for each ``QUERY_BLOCK`` queries that visit it, and not at all if none does.

Defined results: vectors that are null, zero, of another length than ``dims`` (by default the
most frequent one), or hold null or non-finite components, and rows without vec_id take no part; rows with an equal vec_id
count once, by the least vector; ties go to the smaller vec_id; a query with fewer
candidates gets all of them that the test leaves; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mediacat.runtime import materialize

# Production parameters.
NEIGHBOURS = 20
PROJECTIONS = 8
CERTAINTY = 0.997  # above the recall wanted: rows repeated exactly share one error of projection
SAMPLE = 100_000  # about so many vectors build the tree of boxes; every row is sorted into it
BOX_ROWS = 64  # aimed at; at least 16 rows of the sample make a box, so there are at most 6,250 or so
CELL_ROWS = 512  # aimed at; larger cells are split further by a hash
LEAF_ROWS = 128
HOME_CELLS = 8  # nearest cells that give a query its first bound
QUERY_BLOCK = 4096  # queries that meet a cell at a time
ROUTE_ROWS = 256  # queries held against all boxes at a time
_SEED = 20_240_601


def chi_square_quantile(p: float, degrees: int) -> float:
    """The value below which a chi-square variable of an even number of degrees lies with probability p."""
    half = degrees // 2

    def below(x):
        return 1 - exp(-x / 2) * sum((x / 2) ** i / factorial(i) for i in range(half))

    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of an array column of one length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


class Space:
    """The lifted and projected space; the same on every task."""

    def __init__(self, dims: int, longest: float, projections: int = PROJECTIONS):
        self.longest = longest
        self.planes = np.random.default_rng(_SEED).standard_normal((dims + 1, projections))

    def lifted(self, rows: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.longest**2 - (rows**2).sum(1), 0.0)
        return np.concatenate([rows, np.sqrt(rest)[:, None]], 1)

    def aimed(self, queries: np.ndarray) -> np.ndarray:
        """Queries at the common length: the nearest lifted row has the largest inner product."""
        queries = queries / np.abs(queries).max(1, keepdims=True)  # squares of tiny components would vanish
        scale = self.longest / np.sqrt((queries**2).sum(1))
        return np.concatenate([queries * scale[:, None], np.zeros((len(queries), 1))], 1)


class Cells:
    """The upper kd-tree: a widest-side median split of a sample, level by level."""

    def __init__(self, points: np.ndarray, count: int):
        self.splits: list[tuple[int, int, float, int, int]] = []  # node, side, cut, left, right
        self.count, self.root = 0, 0
        self._nodes = 0
        self.cell_of: dict[int, int] = {}
        self.root = self._build(points, max(count, 1))
        table = np.zeros((5, self._nodes))  # side, cut, left, right, number; a leaf leads to itself
        table[2:4] = np.arange(self._nodes)
        for node, *split in self.splits:
            table[:4, node] = split
        for node, number in self.cell_of.items():
            table[4, node] = number
        self.side, self.left, self.right, self.number = table[[0, 2, 3, 4]].astype(np.int64)
        self.cut = table[1]

    def _build(self, points, count) -> int:
        node = self._nodes
        self._nodes += 1
        spread = np.ptp(points, axis=0) if len(points) else np.zeros(1)
        if count <= 1 or len(points) < 2 or not spread.max() > 0:
            self.cell_of[node] = self.count
            self.count += 1
            return node
        side = int(np.argmax(spread))
        values = np.sort(points[:, side])
        cut = float(values[len(values) // 2])
        if cut == values[0]:
            cut = float(values[values > cut][0])
        low = points[:, side] < cut
        left, right = self._build(points[low], count // 2), self._build(points[~low], count - count // 2)
        self.splits.append((node, side, cut, left, right))
        return node

    def assign(self, points: np.ndarray) -> np.ndarray:
        at, row = np.full(len(points), self.root), np.arange(len(points))
        while len(points):
            to = np.where(points[row, self.side[at]] < self.cut[at], self.left[at], self.right[at])
            if (to == at).all():
                break
            at = to
        return self.number[at]


def gaps(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each query from each box."""
    out = np.zeros((len(queries), len(low)))
    for j in range(queries.shape[1]):
        q = queries[:, j, None]
        out += np.maximum(np.maximum(low[None, :, j] - q, q - high[None, :, j]), 0.0) ** 2
    return out


def leaves(points: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers of the kd-tree's leaves, in rising order within a leaf."""
    todo, out = [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            if len(rows):
                out.append(np.sort(rows))
            continue
        side = int(np.argmax(np.ptp(points[rows], axis=0)))
        order = rows[np.argsort(points[rows, side], kind="stable")]
        todo += [order[: len(order) // 2], order[len(order) // 2 :]]
    return out


def dots(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products added up component by component, so that equal rows score equally."""
    out = np.zeros(len(rows))
    for j in range(rows.shape[1]):
        out += rows[:, j] * queries[..., j]
    return out


def search_cell(space: Space, ids, rows, query_ids, queries, bounds, k: int, stop: float):
    """(kth distances, hits) of queries in one cell.

    The first are each query's k least squared distances here, in no order. ``hits`` are
    arrays (query, row number, score) of its best rows within ``bounds``, squared distances
    that the k-th found anywhere does not exceed; best first, ties to the smaller id.
    """
    lifted, aimed = space.lifted(rows), space.aimed(queries)
    points, targets = lifted @ space.planes, aimed @ space.planes
    parts = leaves(points, LEAF_ROWS)
    low = np.array([points[p].min(0) for p in parts])
    high = np.array([points[p].max(0) for p in parts])
    near = gaps(targets, low, high)
    turn = np.argsort(near, axis=1, kind="stable")
    slack = 1e-9 * space.longest**2
    least = np.full((len(queries), k), np.inf)
    kth = bounds.copy()
    going = np.ones(len(queries), bool)
    seen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for step in range(len(parts)):
        leaf = turn[:, step]
        going &= near[np.arange(len(queries)), leaf] <= stop * kth + slack
        if not going.any():
            break
        for number in np.unique(leaf[going]):
            mine = np.flatnonzero(going & (leaf == number))
            part = parts[number]
            apart = 2 * space.longest**2 - 2 * (aimed[mine] @ lifted[part].T)
            apart[query_ids[mine, None] == ids[part][None, :]] = np.inf  # a query's own row is no candidate
            q, r = np.nonzero(apart <= kth[mine, None] + slack)
            q, r, far = mine[q], part[r], apart[q, r]
            real = np.isfinite(far)
            seen.append((q[real], r[real], far[real]))
            hit = mine[np.unique(np.searchsorted(mine, q))] if len(q) else mine[:0]
            if len(hit):
                both = np.concatenate([least[hit], apart[np.searchsorted(mine, hit)]], 1)
                least[hit] = np.partition(both, k - 1, axis=1)[:, :k]
                kth[hit] = np.minimum(kth[hit], least[hit].max(1))
    q, r, far = (np.concatenate(x) if seen else np.zeros(0, int) for x in (zip(*seen) if seen else [()] * 3))
    within = far <= kth[q] + slack
    q, r = q[within], r[within]
    score = dots(rows[r], queries[q])
    order = np.lexsort((ids[r], -score, q))
    q, r, score = q[order], r[order], score[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return least, (q[rank < k], r[rank < k], score[rank < k])


def clean(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(id, v, norm2) of the rows that take part."""
    value = F.transform(F.col(column), lambda x: x.cast("double"))
    usable = (
        F.col(key).isNotNull() & F.col(column).isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    )
    rows = vectors.select(key, column).withColumn("v", value).filter(usable)
    rows = rows.groupBy(F.col(key).alias("id")).agg(F.min("v").alias("v"))
    rows = rows.filter(F.exists("v", lambda x: x != 0))
    return rows.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))


def nearest(
    vectors: DataFrame, queries_where: str, key: str = "vec_id", column: str = "embedding",
    k: int = NEIGHBOURS, certainty: float = CERTAINTY, dims: int | None = None,
) -> DataFrame:
    """(query_id, rank, id, score): the k rows of largest inner product found for each query row.

    ``certainty`` is the least recall to expect; ``dims`` the length of vectors that take part.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, id long, score double"
    rows = materialize(clean(vectors, key, column), "vectors")
    if dims is None:
        most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        dims = most["d"] if most else 0
    rows = rows.filter(F.size("v") == dims)
    size = rows.agg(F.count("*").alias("n"), F.max("norm2").alias("m")).first()
    if not size["n"]:
        return spark.createDataFrame([], schema)
    space = Space(dims, float(np.sqrt(size["m"])))
    sides = range(PROJECTIONS)
    names = [f"p{j}" for j in sides]
    places = ", ".join(f"{p} double" for p in names)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = space.lifted(matrix(batch.column("v"))) @ space.planes
            yield pa.RecordBatch.from_arrays([pa.array(points[:, j]) for j in sides], names)

    # the same rows on every run; about SAMPLE of them, as ids are distinct
    drawn = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 31)) < F.lit(int(min(1.0, SAMPLE / size["n"]) * (1 << 31))))
    drawn = drawn.select("v").mapInArrow(project, places).toArrow()
    sample = np.stack([drawn[p].to_numpy() for p in names], 1) if len(drawn) else np.zeros((0, PROJECTIONS))
    cells = Cells(sample, min(ceil(size["n"] / BOX_ROWS), max(1, len(sample) // 16)))
    per_cell = max(1, ceil(cells.count * CELL_ROWS / size["n"]))  # boxes; their numbers follow the tree
    stop = chi_square_quantile(certainty, PROJECTIONS)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = space.lifted(matrix(batch.column("v"))) @ space.planes
            extra = [pa.array(cells.assign(points), pa.int64())] + [pa.array(points[:, j]) for j in sides]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], ["id", "v", "box", *names])

    placed = materialize(
        rows.select("id", "v").mapInArrow(place, f"id long, v array<double>, box long, {places}"), "placed"
    ).withColumn("cell", F.expr(f"box div {per_cell}"))
    # one row per box, and the number of boxes is bounded by the sample
    box = placed.groupBy("box").agg(
        F.count("*").alias("n"), *[F.min(p).alias(f"a{p}") for p in names], *[F.max(p).alias(f"b{p}") for p in names]
    ).toPandas().sort_values("box")
    low, high = box[[f"a{p}" for p in names]].to_numpy(), box[[f"b{p}" for p in names]].to_numpy()
    number, begins = np.unique(box["box"].to_numpy() // per_cell, return_index=True)
    subs = np.ceil(np.add.reduceat(box["n"].to_numpy(), begins) / (2 * CELL_ROWS)).astype(int)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (id, bound, cell, sub): for the cells nearest to a query, or for all with a box within its bound."""
        for whole in batches:
            for start in range(0, len(whole), ROUTE_ROWS):
                batch = whole.slice(start, ROUTE_ROWS)
                asked = matrix(batch.column("v"))
                near = np.minimum.reduceat(gaps(space.aimed(asked) @ space.planes, low, high), begins, axis=1)
                who = batch.column("id").to_numpy()
                if "bound" in batch.schema.names:
                    bound = batch.column("bound").to_numpy()
                    q, c = np.nonzero(near <= stop * bound[:, None] + 1e-9 * space.longest**2)
                    many = subs[c]
                    q, c = np.repeat(q, many), np.repeat(c, many)
                    sub = np.arange(len(q)) - np.repeat(np.cumsum(many) - many, many)
                else:
                    close = np.argsort(near, axis=1, kind="stable")[:, :HOME_CELLS]
                    q, c = np.repeat(np.arange(len(asked)), close.shape[1]), close.ravel()
                    bound = np.full(len(asked), np.inf)
                    sub = who[q] % subs[c]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(who[q]), pa.array(bound[q]), pa.array(number[c], pa.int64()), pa.array(sub, pa.int64())],
                    ["id", "bound", "cell", "sub"],
                )

    def looked_up(cell_rows: pa.Table, asked: pa.Table):
        who = asked["id"].to_numpy()
        ids = cell_rows["id"].to_numpy()
        bound = asked["bound"].to_numpy()
        least, hits = search_cell(space, ids, matrix(cell_rows["v"]), who, matrix(asked["v"]), bound, k, stop)
        return who, ids, least, hits

    def measure(cell_rows: pa.Table, asked: pa.Table) -> pa.Table:
        """The distances of each query's nearest rows in a cell."""
        names, kinds = ["query_id", "apart"], pa.list_(pa.float64())
        if not len(cell_rows) or not len(asked):
            return pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], kinds)], names)
        who, _, least, _ = looked_up(cell_rows, asked)
        return pa.Table.from_arrays([pa.array(who), pa.array([x[np.isfinite(x)] for x in least], kinds)], names)

    def meet(cell_rows: pa.Table, asked: pa.Table) -> pa.Table:
        """One row per query that has hits in a cell."""
        names, lists = ["query_id", "hits"], pa.list_(pa.struct([("id", pa.int64()), ("score", pa.float64())]))
        if not len(cell_rows) or not len(asked):
            return pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], lists)], names)
        who, ids, _, (q, r, score) = looked_up(cell_rows, asked)
        some, first = np.unique(q, return_index=True)
        values = pa.StructArray.from_arrays([pa.array(ids[r]), pa.array(score)], ["id", "score"])
        hits = pa.ListArray.from_arrays(pa.array(np.r_[first, len(q)], pa.int32()), values)
        return pa.Table.from_arrays([pa.array(who[some]), hits], names)

    def of_cell(values) -> Column:
        filled = np.zeros(number[-1] + 1, int)
        filled[number] = values
        return F.get(F.array(*[F.lit(int(x)) for x in filled]), F.col("cell").cast("int"))

    parts = placed.select("id", "v", "cell", F.pmod(F.xxhash64("id"), of_cell(subs)).cast("long").alias("sub"))
    queries = materialize(placed.filter(F.expr(queries_where)).select("id", "v"), "queries")
    visit_schema = "id long, bound double, cell long, sub long"
    home = queries.mapInArrow(visits, visit_schema).join(queries, "id")
    first = parts.groupBy("cell", "sub").cogroup(home.groupBy("cell", "sub")).applyInArrow(measure, "query_id long, apart array<double>")
    # a row for each of the few home cells
    nearby = first.groupBy(F.col("query_id").alias("__q")).agg(F.array_sort(F.flatten(F.collect_list("apart"))).alias("apart"))
    bounded = queries.join(nearby, F.col("id") == F.col("__q"), "left").select(
        "id", "v", F.coalesce(F.get("apart", F.lit(k - 1)), F.lit(float("inf"))).alias("bound")
    )
    sent = materialize(bounded.mapInArrow(visits, visit_schema), "visits")
    # a cell's vectors are repeated for each block of its queries; one row per cell
    asked_of = sent.groupBy("cell", "sub").count().groupBy("cell").agg(F.max("count").alias("n")).toPandas()
    blocks = np.zeros(number[-1] + 1, int)
    blocks[asked_of["cell"]] = np.ceil(asked_of["n"] / QUERY_BLOCK)
    blocks = of_cell(blocks[number])
    sent = sent.join(queries, "id").withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("long"))
    every = (
        parts.withColumn("blocks", blocks).filter("blocks > 0")
        .withColumn("block", F.explode(F.expr("sequence(0L, cast(blocks as bigint) - 1)"))).drop("blocks")
    )
    keys = ["cell", "sub", "block"]
    met = every.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(meet, "query_id long, hits array<struct<id:long,score:double>>")
    found = met.select("query_id", F.inline("hits"))
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
