"""Vector search: query plans, one pass over the vectors, exact top-k."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediacat.functions.tags import WHITESPACE
from mediacat.functions.vectors import dense
from mediacat.operators.filters import active
from mediacat.runtime import for_heavy_rows, materialize
from mediacat.schema import instant

# Similarity thresholds, known prompt openings and prompt texts.
MIN_SIMILARITY = 0.28
MIN_SIMILARITY_CJK = 0.18
PROMPT_OPENINGS = ("a photo of", "an image of", "picture of")
PROMPT_PREFIX = "a photo of "
PROMPT_SUFFIX_CJK = " 的照片"
CJK = r"[\x{4E00}-\x{9FA5}]"
DEFAULT_LIMIT, MAX_LIMIT = 50, 500  # the second is for callers to apply; no limit is cut here

# Plans of one query block.
PLANS_PER_PASS = 1_024
# Bytes of one block of float vectors, and how many blocks a task sorts by norm together.
BLOCK_BYTES, BLOCKS_TOGETHER = 1 << 21, 8
# Query blocks up to this size are broadcast.
BROADCAST_BYTES = 1 << 25
# Scores that a task remembers to raise its bounds.
STATE_SCORES = 1 << 22
NO_LIMIT = 1 << 62


def plan_queries(queries: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """query_id, plan_no, text, threshold, label for a table (query_id, query[, translated]).

    Chinese text gets its own prompt form and a lower threshold; its translation, if
    given, is a second plan.
    """
    text = F.btrim(F.col("query"), F.lit(WHITESPACE))
    cjk = F.col("query").rlike(CJK)
    opened = F.lit(False)
    for opening in PROMPT_OPENINGS:
        opened = opened | F.lower(text).startswith(opening)
    prompt = (
        F.when(cjk, F.concat(text, F.lit(PROMPT_SUFFIX_CJK)))
        .when(opened, text)
        .otherwise(F.concat(F.lit(PROMPT_PREFIX), text))
    )
    main = F.struct(
        F.lit(0).alias("plan_no"),
        prompt.alias("text"),
        F.when(cjk, min(min_similarity, MIN_SIMILARITY_CJK)).otherwise(min_similarity).alias("threshold"),
        F.when(cjk, "zh").otherwise("en").alias("label"),
    )
    plans = [main]
    if "translated" in queries.columns:
        given = cjk & (F.coalesce("translated", F.lit("")) != "")
        plans.append(
            F.when(
                given,
                F.struct(
                    F.lit(1).alias("plan_no"),
                    F.concat(F.lit(PROMPT_PREFIX), F.col("translated")).alias("text"),
                    F.lit(float(min_similarity)).alias("threshold"),
                    F.lit("translated-en").alias("label"),
                ),
            )
        )
    return (
        queries.select("query_id", F.explode(F.array(*plans)).alias("p"))
        .filter(F.col("p").isNotNull())
        .select("query_id", "p.plan_no", "p.text", "p.threshold", "p.label")
    )


def _id_type(kind: T.DataType) -> T.DataType:
    return T.StringType() if isinstance(kind, T.StringType) else T.LongType()


def _query_blocks(plans: DataFrame) -> DataFrame:
    """Plans as matrices, all plans of a query in one block: (queries, starts, thresholds, matrix, dims, reach, floor).

    A block has up to PLANS_PER_PASS plans, or those of one query. ``reach`` is the largest
    plan's norm, ``floor`` the least threshold: a vector whose norm times ``reach`` stays below
    ``floor`` hits no query of the block.
    """
    query_type = _id_type(plans.schema["query_id"].dataType)
    id_type = pa.string() if isinstance(query_type, T.StringType) else pa.int64()

    def block(ids: list, vectors: list, thresholds: list) -> pa.RecordBatch:
        rows = [np.nan_to_num(np.asarray(v if v is not None else [], dtype="float64")) for v in vectors]
        dims = max(map(len, rows))
        matrix = np.zeros((dims, len(rows)))
        for i, v in enumerate(rows):
            matrix[: len(v), i] = v
        starts = [i for i, q in enumerate(ids) if i == 0 or q != ids[i - 1]]
        reach = float(np.linalg.norm(matrix, axis=0).max()) if dims else 0.0
        return pa.RecordBatch.from_arrays(
            [
                pa.array([[ids[i] for i in starts]], pa.list_(id_type)), pa.array([starts], pa.list_(pa.int32())),
                pa.array([thresholds], pa.list_(pa.float64())), pa.array([matrix.tobytes()], pa.binary()),
                pa.array([dims], pa.int32()), pa.array([reach], pa.float64()), pa.array([min(thresholds)], pa.float64()),
            ],
            ["queries", "starts", "thresholds", "matrix", "dims", "reach", "floor"],
        )

    limit = PLANS_PER_PASS

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, thresholds = [], [], []
        for batch in batches:
            for q, v, t in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                if len(ids) >= limit and q != ids[-1]:
                    yield block(ids, vectors, thresholds)
                    ids, vectors, thresholds = [], [], []
                ids.append(q)
                vectors.append(v)
                thresholds.append(t)
        if ids:
            yield block(ids, vectors, thresholds)

    rows = plans.select(F.col("query_id").cast(query_type).alias("query_id"), "embedding", F.col("threshold").cast("double"))
    rows = rows.repartition("query_id").sortWithinPartitions("query_id")
    fields = (
        f"queries array<{query_type.simpleString()}>, starts array<int>, thresholds array<double>, "
        "matrix binary, dims int, reach double, floor double"
    )
    return materialize(rows.mapInArrow(pack, fields), "query_blocks")


def _vector_blocks(embeddings: DataFrame, slots: int) -> DataFrame:
    """Vectors in blocks of about BLOCK_BYTES and of similar norms: (ids, lengths, components, norm, slot).

    A task sorts BLOCKS_TOGETHER blocks' worth of vectors by norm and cuts them; no single vector
    is shuffled. ``norm`` is the largest of a block, ``slot`` where it meets the query blocks.
    """
    id_type = _id_type(embeddings.schema["photo_id"].dataType)
    ids_type = pa.string() if isinstance(id_type, T.StringType) else pa.int64()
    most = BLOCK_BYTES // 4  # components

    def cut(table: pa.Table, number: int) -> Iterator[pa.RecordBatch]:
        column = table.column("embedding").combine_chunks()
        lengths = np.asarray(column.value_lengths().fill_null(0)).astype("int64")
        flat = column.flatten().to_numpy(zero_copy_only=False)
        flat = flat.astype("float32" if flat.dtype == np.float32 else "float64")
        upto = np.concatenate(([0], np.cumsum(lengths)))
        squares = np.concatenate(([0.0], np.cumsum(np.nan_to_num(flat.astype("float64"), posinf=np.inf, neginf=-np.inf) ** 2)))
        norms = np.sqrt(np.maximum(squares[upto[1:]] - squares[upto[:-1]], 0)) if np.isfinite(squares[-1]) else np.full(len(lengths), np.inf)
        # the difference of running sums is off by the rounding of the sum
        norms = norms + np.sqrt(squares[-1] * 1e-12) if np.isfinite(squares[-1]) else norms
        order = np.argsort(-norms, kind="stable")
        size = np.cumsum(lengths[order] + 1)
        edges = [0, *np.flatnonzero(np.diff(size // most)) + 1, len(order)]
        ids = table.column("photo_id").combine_chunks().cast(ids_type)
        for first, last in zip(edges, edges[1:]):
            own, number = order[first:last], number + 1
            if not len(own):
                continue
            at = np.repeat(upto[own], lengths[own])
            place = np.arange(len(at)) - np.repeat(np.cumsum(lengths[own]) - lengths[own], lengths[own])
            values = flat[at + place]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids.take(pa.array(own)).to_pylist()], pa.list_(ids_type)),
                    pa.array([lengths[own].astype("<i4").tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary()),
                    pa.array([values.dtype.itemsize], pa.int32()), pa.array([float(norms[own].max())], pa.float64()),
                    pa.array([number % slots], pa.int32()),
                ],
                ["ids", "lengths", "components", "width", "norm", "slot"],
            )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, number = 0, TaskContext.get().partitionId()
        for batch in batches:
            step = max(1, min(batch.num_rows, most * batch.num_rows // max(1, len(batch.column("embedding").flatten()))))
            for at in range(0, batch.num_rows, step):
                held.append(batch.slice(at, step))
                size += len(held[-1].column("embedding").flatten())
                if size >= most * BLOCKS_TOGETHER:
                    yield from cut(pa.Table.from_batches(held), number)
                    held, size, number = [], 0, number + 2 * BLOCKS_TOGETHER
        if held:
            yield from cut(pa.Table.from_batches(held), number)

    rows = embeddings.select(F.col("photo_id").cast(id_type).alias("photo_id"), "embedding")
    return rows.mapInArrow(
        pack, f"ids array<{id_type.simpleString()}>, lengths binary, components binary, width int, norm double, slot int"
    )


def _components(row: dict, dims: int) -> np.ndarray:
    """A block's vectors as a float64 matrix, cut or zero-padded to ``dims``."""
    values = np.frombuffer(row["components"], "<f4" if row["width"] == 4 else "<f8")
    lengths = np.frombuffer(row["lengths"], "<i4")
    offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32())
    return dense(pa.ListArray.from_arrays(offsets, pa.array(values)), dims)


def _tile_scorer(limit: int, id_type: pa.DataType, query_type: pa.DataType):
    """mapInArrow body over tiles: the hits of a query block in a vector block.

    With a limit, a task remembers the best scores it has seen for each query. A tile whose
    bound lies below a query's limit-th best skips that query, and only rows that may still be
    among the best leave. STATE_SCORES bounds what is remembered; forgetting costs rows only.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, np.ndarray] = {}  # query block -> limit best scores per query, -inf at first
        remembered = 0
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                queries, starts, dims = row["queries"], np.array(row["starts"]), row["dims"]
                thresholds = np.array(row["thresholds"])
                matrix = np.frombuffer(row["matrix"], "<f8").reshape(dims, len(thresholds))
                open_ = np.ones(len(queries), bool)
                top = None
                if limit < NO_LIMIT:
                    name = (queries[0], len(queries))
                    if name not in best:
                        if remembered + len(queries) * limit > STATE_SCORES:
                            best.clear()
                            remembered = 0
                        best[name] = np.full((len(queries), limit), -np.inf)
                        remembered += len(queries) * limit
                    top = best[name]
                    reach = np.maximum.reduceat(np.linalg.norm(matrix, axis=0), starts) * row["norm"] if dims else np.zeros(len(queries))
                    with np.errstate(invalid="ignore"):
                        open_ = ~(reach * (1 + 1e-9) < top.min(1))
                if not open_.any():
                    continue
                sims = _components(row, dims) @ matrix
                scores = np.maximum.reduceat(sims, starts, axis=1)
                hits = np.logical_or.reduceat(sims >= thresholds, starts, axis=1)
                picked_q, picked_row = [], []
                for q in np.flatnonzero(open_):
                    rows = np.flatnonzero(hits[:, q])
                    if top is not None and len(rows):
                        both = np.concatenate([top[q], scores[rows, q]])
                        top[q] = np.partition(both, len(both) - limit)[len(both) - limit :]
                        rows = rows[scores[rows, q] >= top[q].min()]  # ties stay: ids decide later
                    picked_q.append(np.full(len(rows), q))
                    picked_row.append(rows)
                q, at = np.concatenate(picked_q), np.concatenate(picked_row)
                if len(at):
                    ids = pa.array(row["ids"], id_type)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(queries, query_type).take(pa.array(q)), ids.take(pa.array(at)), pa.array(scores[at, q], pa.float64())],
                        names=["query_id", "photo_id", "similarity"],
                    )

    return score


def score_all(plans: DataFrame, embeddings: DataFrame, limit: int | None = None) -> DataFrame:
    """(query_id, photo_id, similarity): each vector against every query of the batch.

    ``plans`` is (query_id, embedding, threshold), one or more rows per query. A vector
    hits a query if any plan reaches its own threshold; its similarity is the best over
    the query's plans. Plans and vectors are packed into blocks, and every tile of a query
    block and a vector block is one matrix product. A join decides on the tiles by their bound
    (largest norms multiplied, against the least threshold), so the plan of the job is the same
    for any number of queries and the driver holds none. Query blocks of up to BROADCAST_BYTES
    are sent to the vectors, which stay where they are; more of them are copied to as many slots
    as there are shuffle partitions and meet the vector blocks there. With ``limit`` only rows
    that can still be among the best leave a task.
    """
    query_type, id_type = (_id_type(t.schema[c].dataType) for t, c in ((plans, "query_id"), (embeddings, "photo_id")))
    schema = T.StructType(
        [T.StructField("query_id", query_type), T.StructField("photo_id", id_type), T.StructField("similarity", T.DoubleType())]
    )
    asked = _query_blocks(plans)
    size = asked.agg(F.sum(F.length("matrix") + F.length(F.to_json("queries")))).first()[0] or 0
    slots = 1 if size <= BROADCAST_BYTES else int(plans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stored = _vector_blocks(embeddings, slots)
    met = asked.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    near = (stored["slot"] == met["slot"]) & (stored["norm"] * met["reach"] * (1 + 1e-9) >= met["floor"])
    tiles = stored.join(F.broadcast(met) if slots == 1 else met.hint("merge"), near).drop(met["slot"])
    arrow = [pa.string() if isinstance(t, T.StringType) else pa.int64() for t in (id_type, query_type)]
    return tiles.mapInArrow(_tile_scorer(NO_LIMIT if limit is None else limit, *arrow), schema)


def top_k(scores: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The best ``limit`` (1 or more) rows per query, with ``rank``; ties go to the smaller id."""
    limit = max(1, limit)
    w = W.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("photo_id"))
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def embeddings_with_media(embeddings: DataFrame, media: DataFrame, model: str | None = None) -> DataFrame:
    """Vectors (of a model) of active files, with the file's columns."""
    if model is not None:
        embeddings = embeddings.filter(F.col("model") == model)
    return embeddings.join(active(media).withColumnRenamed("id", "photo_id"), "photo_id")


def search(
    plans: DataFrame,
    embeddings: DataFrame,
    media: DataFrame | None = None,
    limit: int = DEFAULT_LIMIT,
    model: str | None = None,
) -> DataFrame:
    """Best files per query: query_id, rank, photo_id, similarity, and the file's columns.

    With ``media`` only active files take part. That test runs on the best hits, never on
    all of them or on the vectors: each query's best ``limit`` are looked up, and queries that
    came up short although more hits exist are asked again for twice as many.
    """
    limit = max(1, limit)
    if model is not None:
        embeddings = embeddings.filter(F.col("model") == model)
    if media is None:
        return top_k(score_all(plans, embeddings, limit), limit)
    alive = active(media).select(F.col("id").alias("photo_id"))
    settled, wanted, asked = None, limit, plans
    while True:
        hits = materialize(top_k(score_all(asked, embeddings, wanted), wanted), "hits")
        found = materialize(top_k(hits.drop("rank").join(alive, "photo_id", "left_semi"), limit), "found")
        kept = found.groupBy("query_id").agg(F.count("*").alias("__alive"))
        # a query is short if its hits were cut off and too few of them are alive
        short = (
            hits.groupBy("query_id").agg(F.count("*").alias("__hits")).filter(F.col("__hits") >= wanted)
            .join(kept, "query_id", "left")
            .filter(F.coalesce("__alive", F.lit(0)) < limit)
            .select("query_id")
        )
        short = materialize(short, "short")
        done = found.join(short, "query_id", "left_anti")
        settled = done if settled is None else settled.unionByName(done)
        if short.isEmpty():
            break
        asked = materialize(asked.join(short, "query_id", "left_semi"), "asked")
        wanted *= 2
    return settled.join(active(media).withColumnRenamed("id", "photo_id"), "photo_id")


def without_embedding(
    media: DataFrame,
    embeddings: DataFrame,
    exclude: DataFrame | None = None,
    limit: int | None = None,
    model: str | None = None,
) -> DataFrame:
    """Active images without a vector (of any model unless one is named) and not excluded."""
    if model is not None:
        embeddings = embeddings.filter(F.col("model") == model)
    rows = active(media).filter(F.col("media_type") == "image")
    rows = rows.join(embeddings.select(F.col("photo_id").alias("id")), "id", "left_anti")
    if exclude is not None:
        rows = rows.join(exclude.select(F.col(exclude.columns[0]).alias("id")), "id", "left_anti")
    rows = rows.select("id", "path", "filename", "media_type")
    return rows.orderBy("id").limit(limit) if limit else rows


def vector_of(embeddings: DataFrame, photo_id) -> DataFrame:
    """(embedding, model) of one file; no row if it has none."""
    return embeddings.filter(F.col("photo_id") == F.lit(photo_id)).select("embedding", "model")


def embed_missing(
    media: DataFrame,
    embeddings: DataFrame,
    encoder: Callable[[list[str]], np.ndarray],
    model: str,
    now,
    exclude: DataFrame | None = None,
    batch_size: int = 32,
) -> tuple[DataFrame, DataFrame]:
    """(new vectors, rejects): encode the images that have none.

    ``encoder`` takes paths and returns one row per path, or one flat array to be cut
    evenly. A failing batch is retried file by file; files that still fail are rejects to
    pass as ``exclude`` next time. The encoder runs once: its output is written out.
    """
    todo = without_embedding(media, embeddings, exclude)

    def unit(rows: np.ndarray, n: int) -> np.ndarray:
        rows = np.asarray(rows, dtype="float32").reshape(n, -1)
        norms = np.linalg.norm(rows.astype("float64"), axis=1, keepdims=True)
        return np.where(norms > 0, rows / np.where(norms > 0, norms, 1), rows).astype("float32")

    def encode(paths: list[str]):
        try:
            return [(v.tolist(), None) for v in unit(encoder(paths), len(paths))]
        except Exception as error:  # noqa: BLE001 - any encoder failure rejects the file
            if len(paths) == 1:
                return [(None, str(error) or type(error).__name__)]
            return [encode([p])[0] for p in paths]

    def batches(frames):
        for pdf in frames:
            for start in range(0, len(pdf), batch_size):
                part = pdf.iloc[start : start + batch_size]
                done = encode(part["path"].tolist())
                yield pd.DataFrame(
                    {"photo_id": part["id"].to_numpy(), "embedding": [d[0] for d in done], "error": [d[1] for d in done]}
                )

    id_type = media.schema["id"].dataType.simpleString()
    tried = materialize(
        for_heavy_rows(todo).mapInPandas(batches, f"photo_id {id_type}, embedding array<float>, error string"), "encoded"
    )
    good = tried.filter(F.col("error").isNull()).select(
        "photo_id", "embedding", F.lit(model).alias("model"), instant(now).alias("updated_at")
    )
    return good, tried.filter(F.col("error").isNotNull()).select("photo_id", "error")
