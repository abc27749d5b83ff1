"""Query registry: one callable (spark, table_folder) -> DataFrame per operator key.

Integer outputs are widened to bigint so every key has one schema whatever the
operator produced internally (row numbers are int in Spark, bigint in SQL engines).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, ShortType

from leafcast.session import release

QueryFn = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, QueryFn] = {}


def widen_ints(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (ByteType, ShortType, IntegerType)):
            cols.append(F.col(f.name).cast("long").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def query(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _REGISTRY:
            raise ValueError(f"duplicate query key {name}")

        def wrapped(spark: SparkSession, base: str) -> DataFrame:
            # What earlier queries kept for reuse is freed; their results, if still wanted, recompute it.
            release(spark)
            return widen_ints(fn(spark, base))

        wrapped.__name__ = fn.__name__
        wrapped.__doc__ = fn.__doc__
        _REGISTRY[name] = wrapped
        return wrapped

    return deco


def all_queries() -> dict[str, QueryFn]:
    from leafcast import queries  # noqa: F401  (registers every key)

    return dict(_REGISTRY)
