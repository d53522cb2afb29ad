"""Vectors as whole numbers, and whole-number sums across tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components beyond this bound count as the bound, so that squared distances fit into a long.
LARGEST = 1 << 24
SUMS = "entry int, place int, total long"


def finite(vector: Column) -> Column:
    """True for vectors without null or non-finite components; null vectors are not."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, fine), F.lit(False))


def floors(vector: Column, scale: int) -> Column:
    """Components as floor(scale * x), cut off at the bound on both sides."""
    bound = F.lit(float(LARGEST))
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, bound), -bound)).cast("int"))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as rows, padded by zeros to ``width``."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = lists.value_lengths().to_numpy()
    out = np.zeros((len(sizes), width), np.int64)
    starts = np.cumsum(sizes) - sizes
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(starts, sizes)] = lists.flatten().to_numpy()
    return out


def sum_rows(sums: np.ndarray, extra: dict[str, pa.DataType]) -> pa.RecordBatch:
    """A batch of (entry, place, total) for the totals that are not zero, with null in the ``extra`` columns before them."""
    entry, place = np.nonzero(sums)
    columns = [pa.nulls(len(entry), kind) for kind in extra.values()]
    columns += [pa.array(entry, pa.int32()), pa.array(place, pa.int32()), pa.array(sums[entry, place], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, [*extra, "entry", "place", "total"])


def totals(rows: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The (entry, place, total) rows of all tasks added up: as many numbers as the model has, whatever the input."""
    out = np.zeros(shape, object)
    for r in rows.where("entry IS NOT NULL").groupBy("entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        out[r.entry, r.place] = int(r.total)
    return out
