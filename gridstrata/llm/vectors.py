"""Vectors as Arrow columns: which rows take part, blocks of vectors as arrays of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = "block long, ids binary, vectors binary"


def usable(vector: Column) -> Column:
    """True for vectors without null or non-finite components that are not zero."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, fine) & F.exists(vector, lambda x: x != 0), F.lit(False))


def one_per_id(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (id long, v array<float or double>), one per id: the least of its usable vectors, null if it has none.

    Rows without id are left out. The element type of the column stays.
    """
    kind = "array<float>" if dict(df.dtypes)[vector] == "array<float>" else "array<double>"
    v = F.col(vector).cast(kind)
    rows = df.select(F.col(key).cast("long").alias("id"), F.when(usable(v), v).alias("v")).where("id IS NOT NULL")
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def _block(width: int, kind: str):
    def run(table: pa.Table) -> pa.Table:
        block, ids = table.column(0)[0].as_py(), table.column(1).combine_chunks().to_numpy()
        lists = table.column(2).combine_chunks()
        sizes = lists.value_lengths().to_numpy()
        out = np.zeros((len(ids), width), kind)
        out[np.repeat(np.arange(len(ids)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
        return pa.table({"block": pa.array([block], pa.int64()), "ids": [ids.astype("<i8").tobytes()], "vectors": [out.tobytes()]})

    return run


def blocks(rows: DataFrame, count: int, width: int) -> DataFrame:
    """Rows (block, ids, vectors): the vectors of ``rows`` (id, v) dealt by id into ``count`` blocks of like size.

    Shorter vectors are padded by zeros to ``width``.
    """
    kind = "<f4" if dict(rows.dtypes)["v"] == "array<float>" else "<f8"
    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(count)).cast("long").alias("block"), "id", "v")
    return dealt.groupBy("block").applyInArrow(_block(width, kind), BLOCK)


def unpack(ids: bytes, vectors: bytes, width: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors in double precision."""
    return np.frombuffer(ids, "<i8"), np.frombuffer(vectors, kind).reshape(-1, width).astype(np.float64)


def extent(rows: DataFrame) -> tuple[int, int]:
    """Number of rows with a vector and the longest vector's length."""
    n, width = rows.where("v IS NOT NULL").agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    return int(n), int(width or 1)


def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Single rows of Arrow batches, so that one block at a time is in memory."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}
