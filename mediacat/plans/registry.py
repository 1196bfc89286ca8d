"""Registration of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacat.plans.fixtures import with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None, *ctes: str):
    """Register a function (spark, sf_dir) -> DataFrame under its own name."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = with_ctes(sql, *ctes)
        return fn

    return register


def flat(df: DataFrame) -> DataFrame:
    """Instants as text, arrays joined, so both engines return the same plain types."""
    out = []
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        if kind.startswith("timestamp") or kind == "date":
            out.append(F.col(field.name).cast("string").alias(field.name))
        elif kind.startswith("array"):
            out.append(F.array_join(field.name, ",").alias(field.name))
        else:
            out.append(F.col(field.name))
    return df.select(*out)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})
