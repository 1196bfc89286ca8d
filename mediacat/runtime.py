"""Session defaults, lineage cuts, global positions and skew-proof joins."""

from __future__ import annotations

import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# A key with at least this many rows is routed around the shuffle.
HOT_ROWS = 1_000_000
# Never more hot keys than this are broadcast; further ones take the shuffle path,
# where the adaptive skew join splits them.
HOT_KEYS = 1_000
# Pages that end beyond this row are cut by global position, not by a driver-side top-n.
DEEP_PAGE = 10_000


def local_session(cpus: int | str = "*", app: str = "mediacat", **conf) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_mediacat_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(
        str(Path(tempfile.mkdtemp(prefix="mediacat-")) / "mediacat"), "zip", package.parent, package.name
    )
    sc.addPyFile(archive)
    sc._mediacat_shipped = True


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session without that
    setting gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    existing = sc.getCheckpointDir()
    if existing:
        return existing.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="mediacat-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch_folder(spark: SparkSession) -> str:
    """This application's part of the scratch root, removed when the driver exits."""
    sc = spark.sparkContext
    folder = f"{scratch_root(spark)}/mediacat/{sc.applicationId}"
    if getattr(sc, "_mediacat_scratch", None) != folder:
        sc._mediacat_scratch = folder
        where = sc._jvm.org.apache.hadoop.fs.Path(folder)
        files = where.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(where)  # only an existing folder can be marked
        files.deleteOnExit(where)
    return folder


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Cut the lineage: write the rows once to the shared folder and read them back.

    Unlike a cached frame the result survives lost executors, and unlike an RDD
    checkpoint it is computed once, stays columnar and has a known size.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._mediacat_path = path
    if getattr(_scope, "steps", None) is not None:
        _scope.steps.append(out)
    return out


_scope = threading.local()


@contextmanager
def scratch_scope() -> Iterator[None]:
    """Release every step this thread materializes inside, at the end.

    For loops whose results are written elsewhere before the scope closes, such as the
    micro-batches of a stream.
    """
    outer, _scope.steps = getattr(_scope, "steps", None), []
    try:
        yield
    finally:
        for step in _scope.steps:
            release(step)
        _scope.steps = outer


def release(df: DataFrame) -> None:
    """Delete a materialized step that nothing reads any more."""
    path = df.__dict__.get("_mediacat_path")
    if path:
        sc = df.sparkSession.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def one_per_key(df: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """One row per key, the same on every run and retry.

    With ``order``, the last of rivals by that column wins (of equals the greatest row) and
    the column is dropped; without, the least row.
    """
    rest = [c for c in df.columns if c not in (key, order)]
    if order is not None:
        last = F.max(F.struct(order, *rest)).alias("__row")
        return df.groupBy(key).agg(last).select(key, *[F.col("__row")[c].alias(c) for c in rest])
    return df.groupBy(key).agg(F.min(F.struct(*rest)).alias("__row")).select(key, "__row.*")


def for_heavy_rows(df: DataFrame) -> DataFrame:
    """Spread rows whose processing (reading a file, running a model) dwarfs their size.

    Partition sizing goes by bytes and would put many such rows into one task.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def without_taken(few: DataFrame, many: DataFrame, key: str) -> DataFrame:
    """Rows of ``few`` whose key does not occur in ``many``.

    The large side is first cut to the keys of the small one, so a small batch is sent to
    the large table instead of the large table being shuffled.
    """
    taken = many.select(key).join(few.select(key), key, "left_semi").distinct()
    return few.join(taken, key, "left_anti")


def hot_keys(counts: DataFrame, keys: list[str], count: str, min_rows: int | None = None) -> DataFrame:
    """At most HOT_KEYS of the keys whose count reaches ``min_rows``."""
    return (
        counts.filter(F.col(count) >= (HOT_ROWS if min_rows is None else min_rows))
        .select(*keys, count)
        .orderBy(F.col(count).desc(), *keys)
        .limit(HOT_KEYS)
        .select(*keys)
    )


def written_hot_keys(
    counts: DataFrame, keys: list[str], count: str, min_rows: int | None = None
) -> DataFrame | None:
    """``hot_keys`` of a materialized table: a short look saves the split where there are none."""
    least = HOT_ROWS if min_rows is None else min_rows
    if counts.filter(F.col(count) >= least).isEmpty():
        return None
    return hot_keys(counts, keys, count, min_rows)


def row_hot_keys(rows: DataFrame, keys: list[str], min_rows: int | None = None) -> DataFrame | None:
    """Hot keys of a materialized table of rows; a table below the limit has none."""
    if rows.count() < (HOT_ROWS if min_rows is None else min_rows):
        return None
    return written_hot_keys(rows.groupBy(*keys).count(), keys, "count", min_rows)


def join_lookup(
    many: DataFrame, one: DataFrame, keys: list[str], hot: DataFrame | None, how: str = "inner"
) -> DataFrame:
    """Join rows to a table with one row per key, however skewed ``many`` is.

    Rows of the hot keys meet their lookup row by broadcast (bounded by HOT_KEYS), so a
    key that owns a third of the data never lands in one task; the rest is an ordinary
    shuffle join.
    """
    if hot is None:
        return many.join(one, keys, how)
    hot = F.broadcast(hot)
    heavy = many.join(hot, keys, "left_semi").join(
        F.broadcast(one.join(hot, keys, "left_semi")), keys, how
    )
    light = many.join(hot, keys, "left_anti").join(one, keys, how)
    return light.unionByName(heavy)


def with_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Exact 0-based global rank without a single-partition window.

    The rows are range-sorted and written once; each row then knows its partition and its
    place in it, and the partition offsets are a running sum over one row per partition.
    ``order`` must end in a unique column: it both makes the rank stable and lets the range
    partitioner split any run of equal leading values.
    """
    slot, part = f"__{name}_slot", f"__{name}_part"
    ranked = materialize(df.orderBy(*order).withColumn(slot, F.monotonically_increasing_id()), "sorted")
    ranked = ranked.withColumn(part, F.shiftright(F.col(slot), 33))
    sizes = ranked.groupBy(part).agg(F.count("*").alias("__n"))
    before = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.col(slot).bitwiseAND(F.lit((1 << 33) - 1))
    # one row per sorted partition, so the offsets are bounded by the partition count
    return (
        ranked.join(F.broadcast(offsets), part)
        .withColumn(name, F.col("__before") + inside)
        .drop(slot, part, "__before")
    )


def with_running_sum(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """The sum of ``value`` up to and including each row, without a single-partition window.

    As in ``with_position``: rows are range-sorted and written once, each range is summed by
    its own task, and the sums of the ranges before it are added. ``order`` must be unique.
    """
    slot, part = f"__{name}_slot", f"__{name}_part"
    ranked = materialize(df.orderBy(*order).withColumn(slot, F.monotonically_increasing_id()), "summed")
    ranked = ranked.withColumn(part, F.shiftright(F.col(slot), 33))
    totals = ranked.groupBy(part).agg(F.sum(value).alias("__n"))
    before = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.sum(value).over(W.partitionBy(part).orderBy(slot).rowsBetween(W.unboundedPreceding, 0))
    # one row per sorted partition, so the offsets are bounded by the partition count
    return (
        ranked.withColumn("__inside", inside)
        .join(F.broadcast(offsets), part)
        .withColumn(name, F.col("__before") + F.col("__inside"))
        .drop(slot, part, "__before", "__inside")
    )


def balanced_tasks(df: DataFrame, order: list[Column], weight: str, per_task: int, name: str = "task") -> DataFrame:
    """The rows with the number of the task they go to, about ``per_task`` of ``weight`` each.

    A row belongs to the task in which its running sum begins, so neighbours stay together, a
    task exceeds ``per_task`` by less than its last row, and numbers may be left out only
    behind a row that is larger than a task. ``order`` must be unique.
    """
    summed = with_running_sum(df, order, weight, "__upto")
    return summed.withColumn(name, F.floor((F.col("__upto") - F.col(weight)) / per_task)).drop("__upto")


def with_group_position(
    df: DataFrame, group: list[str], order: list[Column], name: str = "position"
) -> DataFrame:
    """0-based rank inside each group; a group may be larger than any one task."""
    ranked = with_position(df, [F.col(g).asc() for g in group] + order, name)
    starts = ranked.groupBy(*group).agg(F.min(name).alias("__start"), F.count("*").alias("__n"))
    hot = hot_keys(starts, group, "__n")
    placed = join_lookup(ranked, starts.drop("__n"), group, hot)
    return placed.withColumn(name, F.col(name) - F.col("__start")).drop("__start")


Order = list[tuple[str, str]]  # (column, 'asc' or 'desc'), nulls last; ends in a unique column


def order_by(order: Order) -> list[Column]:
    return [F.col(c).desc_nulls_last() if way == "desc" else F.col(c).asc_nulls_last() for c, way in order]


def _narrow_by_day(df: DataFrame, order: Order, limit: int, offset: int) -> tuple[DataFrame | None, int]:
    """Cut a page's search to the days it falls into: (rows, offset within them).

    One count per day of the leading instant is all the driver-side decision needs.
    """
    lead = order[0][0]
    day = F.col(lead).cast("date")
    days = df.groupBy(day.alias("day")).agg(F.count("*").alias("n"))
    before = F.coalesce(
        F.sum("n").over(W.orderBy(*order_by([("day", order[0][1])])).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    touched = days.withColumn("before", before).filter(
        (F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset)
    )
    hit = touched.agg(
        F.min("day").alias("lo"), F.max("day").alias("hi"), F.min("before").alias("before"),
        F.count_if(F.col("day").isNull()).alias("undated"),
    ).first()
    if hit["before"] is None:
        return None, 0
    dated = F.lit(False)
    if hit["lo"] is not None:
        low, high = F.lit(hit["lo"]).cast("timestamp_ntz"), F.date_add(F.lit(hit["hi"]), 1).cast("timestamp_ntz")
        dated = F.col(lead).cast("timestamp_ntz").between(low, high) & day.between(F.lit(hit["lo"]), F.lit(hit["hi"]))
    keep = dated | F.col(lead).isNull() if hit["undated"] else dated
    return df.filter(keep), offset - hit["before"]


def page(df: DataFrame, order: Order, limit: int | None, offset: int | None) -> DataFrame:
    """Rows [offset, offset + limit) of the ordered table; unset or 0 means no bound.

    A page near the top is a plain top-n. A deeper one first finds the days it falls into,
    ranks only the order columns of those days, and fetches the other columns for the page
    alone.
    """
    limit, offset = limit or 0, offset or 0
    if limit and limit + offset <= DEEP_PAGE:
        return df.orderBy(*order_by(order)).offset(offset).limit(limit)
    if not limit and not offset:
        return df.orderBy(*order_by(order))
    keys = [c for c, _ in order]
    narrow: DataFrame | None = df.select(*keys)
    if limit and df.schema[keys[0]].dataType.simpleString().startswith("timestamp"):
        narrow, offset = _narrow_by_day(narrow, order, limit, offset)
        if narrow is None:
            return df.limit(0)
    if limit and limit + offset <= DEEP_PAGE:
        cut = narrow.orderBy(*order_by(order)).offset(offset).limit(limit)
    else:
        cut = with_position(narrow, order_by(order), "__pos").filter(F.col("__pos") >= offset)
        if limit:
            cut = cut.filter(F.col("__pos") < offset + limit)
    cut = cut.select(*[F.col(c).alias(f"__{c}") for c in keys])
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys])
    return df.join(cut, same).drop(*cut.columns).orderBy(*order_by(order))
