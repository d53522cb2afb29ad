"""Small helpers of the operators: tables, caches of words, Arrow columns."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstrata.session import checkpoint
from gridstrata.sources.tables import table

__all__ = ["Memo", "as_text", "checkpoint", "drop_kept", "kept", "list_column", "spread", "table", "task_block"]


class Memo(dict):
    """A dict that computes what it lacks and holds two generations of at most ``limit`` values each."""

    def __init__(self, make: Callable, limit: int = 400_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key: Hashable):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


_KEPT: list = []


def kept(make: Callable) -> Callable:
    """``lru_cache`` for large tables that a Python worker keeps from task to task, until ``drop_kept``."""
    _KEPT.append(lru_cache(maxsize=2)(make))
    return _KEPT[-1]


def drop_kept() -> None:
    """Drop the tables that tasks of an earlier stage left: Spark hands its Python workers on from stage to stage."""
    if any(tables.cache_info().currsize for tables in _KEPT):
        for tables in _KEPT:
            tables.cache_clear()
        pa.default_memory_pool().release_unused()


def as_text(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """One Arrow string array without nulls: null texts are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    return column.fill_null("") if column.null_count else column


def list_column(values: pa.Array, lengths: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def task_block(batch: int) -> int:
    """A number of one Arrow batch, the same when the task is run again."""
    from pyspark import TaskContext

    return (TaskContext.get().partitionId() << 24) + batch


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows dealt by ``key`` into the session's number of shuffle partitions, each in the order of key and ``order``."""
    return df.repartition(partitions(df.sparkSession), F.col(key)).sortWithinPartitions(key, *order)
