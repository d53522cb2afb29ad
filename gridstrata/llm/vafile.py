"""Centroid clustering over a vector-approximation file.

Vectors are whole numbers, floor(scale * x). Each part of up to 4096 vectors keeps, besides the vectors, one cell number
of six bits for every component; a cell is a range of like many of the part's values and knows its least and largest.
For every round a lookup table per part gives, for each component, cell and centroid c, the least and largest value of
(c − o)² − 2 (x − o)(c − o), which is the squared distance without |x − o|², the same for all centroids (o: a point amid
the centroids). Sums over the components are an interval for each centroid. A vector with one centroid whose interval
reaches below the upper end of the best is settled; where intervals overlap the full vector is fetched and only
the overlapping centroids are compared, exactly.

A round reads the cells alone. Full vectors lie in slices of 256 in a file of their own; slices with an open or moved
vector are joined to it, and the sums of the centroids change by the moved vectors only. The first sums and the last
distances need every vector. Tasks hand over whole-number sums per centroid and component; the driver gets the sums of
all tasks together: k times the components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstrata.llm import whole
from gridstrata.llm.common import task_block
from gridstrata.session import scratch_path

BITS = 6
PART, SLICE = 4096, 256
_OPEN = -1


def cells(x: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell of each component, and least and largest value of each cell (width × cells), for the vectors of one part."""
    n, width = x.shape
    count = 1 << bits
    ordered = np.sort(x, axis=0)
    cuts = ordered[(np.arange(1, count) * n) // count]
    cell = np.empty((n, width), np.uint8)
    low, high = np.zeros((width, count), np.int64), np.zeros((width, count), np.int64)
    for j in range(width):
        cell[:, j] = np.searchsorted(cuts[:, j], x[:, j], side="right")
        first = np.searchsorted(ordered[:, j], np.concatenate([[ordered[0, j]], cuts[:, j]]))
        last = np.append(first[1:], n) - 1
        low[j], high[j] = ordered[first, j], ordered[np.maximum(last, first), j]
    return cell, low, high


def intervals(cell: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bound of every vector's squared distance to every centroid, without the part all centroids share."""
    o = centroids.sum(axis=0) // len(centroids)
    lower = np.zeros((len(cell), len(centroids)), np.int64)
    upper = np.zeros_like(lower)
    for j in range(cell.shape[1]):
        c = centroids[:, j] - o[j]
        ends = c * c - 2 * (low[j] - o[j])[:, None] * c, c * c - 2 * (high[j] - o[j])[:, None] * c
        lower += np.minimum(*ends)[cell[:, j]]
        upper += np.maximum(*ends)[cell[:, j]]
    return lower, upper


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of the vectors to the centroids, exactly."""
    out = np.empty((len(x), len(centroids)), np.int64)
    for i, c in enumerate(centroids):
        d = x - c
        out[:, i] = np.einsum("ij,ij->i", d, d)
    return out


def _pack(width: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held, number = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                piece = batch.slice(at, PART)
                if held and held + piece.num_rows > PART:
                    yield part(pa.Table.from_batches(waiting), number)
                    waiting, held, number = [], 0, number + 1
                waiting.append(piece)
                held += piece.num_rows
        if held:
            yield part(pa.Table.from_batches(waiting), number)

    def part(rows: pa.Table, number: int) -> pa.RecordBatch:
        x = whole.matrix(rows.column(1), width)
        cell, low, high = cells(x, bits)
        slices = range(0, len(x), SLICE)
        block = task_block(number)
        ids = rows.column(0).combine_chunks().to_pylist()
        packed = [(block, -1, None, cell.tobytes(), np.stack([low, high]).astype("<i4").tobytes(), None)]
        packed += [(block, k, ids[at : at + SLICE], None, None, x[at : at + SLICE].astype("<i4").tobytes()) for k, at in enumerate(slices)]
        kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())
        names = ("part", "slice", "ids", "cells", "marks", "vectors")
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*packed), kinds)], list(names))

    return run


def _bounds(centroids: np.ndarray, bits: int):
    """Settled centroid of each vector of a slice, −1 where intervals overlap, and the centroids still possible there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = centroids.shape[1]
        for batch in batches:
            for i in range(batch.num_rows):
                cell = np.frombuffer(batch.column(1)[i].as_py(), np.uint8).reshape(-1, width)
                low, high = np.frombuffer(batch.column(2)[i].as_py(), "<i4").reshape(2, width, 1 << bits).astype(np.int64)
                lower, upper = intervals(cell, low, high, centroids)
                possible = lower <= upper.min(axis=1, keepdims=True)
                nearest = np.where(possible.sum(axis=1) == 1, possible.argmax(axis=1), _OPEN).astype("<i4")
                out = []
                for k, at in enumerate(range(0, len(cell), SLICE)):
                    near = nearest[at : at + SLICE]
                    out.append((batch.column(0)[i].as_py(), k, near.tobytes(), np.packbits(possible[at : at + SLICE], axis=1).tobytes(), int((near == _OPEN).sum())))
                kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), kinds)], ["part", "slice", "near", "possible", "open"])

    return run


def _settle(near: bytes, possible: bytes, x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Nearest centroid of every vector of a slice; only overlapping centroids of open vectors are compared."""
    nearest = np.frombuffer(near, "<i4").copy()
    open_ = np.flatnonzero(nearest == _OPEN)
    if len(open_):
        mask = np.unpackbits(np.frombuffer(possible, np.uint8).reshape(len(nearest), -1), axis=1, count=len(centroids))[open_].astype(bool)
        far = distances(x[open_], centroids)
        far[~mask] = np.iinfo(np.int64).max
        nearest[open_] = far.argmin(axis=1)
    return nearest


def _moves(centroids: np.ndarray):
    """The slices' centroids, and after the last slice of the task what the moved vectors change in the sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, width = centroids.shape
        sums = np.zeros((k, width + 1), np.int64)
        extra = {"part": pa.int64(), "slice": pa.int32(), "near": pa.binary()}
        for batch in batches:
            parts, slices, found = [], [], []
            for part, slice_, near, possible, old, vectors in zip(*(batch.column(j).to_pylist() for j in range(6))):
                x = np.frombuffer(vectors, "<i4").reshape(-1, width).astype(np.int64)
                nearest = _settle(near, possible, x, centroids)
                before = np.frombuffer(old, "<i4") if old is not None else np.full(len(nearest), _OPEN)
                moved = np.flatnonzero(nearest != before)
                one = np.concatenate([x[moved], np.ones((len(moved), 1), np.int64)], axis=1)
                np.add.at(sums, nearest[moved], one)
                left = before[moved] != _OPEN
                np.subtract.at(sums, before[moved][left], one[left])
                parts.append(part)
                slices.append(slice_)
                found.append(nearest.astype("<i4").tobytes())
            columns = [pa.array(parts, pa.int64()), pa.array(slices, pa.int32()), pa.array(found, pa.binary())]
            columns += [pa.nulls(len(parts), t) for t in (pa.int32(), pa.int32(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*extra, "entry", "place", "total"])
        yield whole.sum_rows(sums, extra)

    return run


def _last(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = centroids.shape[1]
        for batch in batches:
            for near, possible, ids, vectors in zip(*(batch.column(j).to_pylist() for j in range(4))):
                x = np.frombuffer(vectors, "<i4").reshape(-1, width).astype(np.int64)
                nearest = _settle(near, possible, x, centroids)
                d = x - centroids[nearest]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(nearest, pa.int32()), pa.array(np.einsum("ij,ij->i", d, d), pa.int64())],
                    ["id", "cluster", "distance"])

    return run


def _written(df: DataFrame, name: str) -> str:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def seeds(rows: DataFrame, count: int, prefix: str = "1:") -> np.ndarray:
    """The vectors of the ``count`` smallest hashes of their ids, in the order of the hashes; equal ids by their vectors."""
    mark = F.sha2(F.concat(F.lit(prefix), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return np.array([r.v for r in rows.orderBy(mark, "v").limit(count).collect()], np.int64)


def clusters(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", width: int = 64, scale: int = 64, count: int = 16, rounds: int = 3, bits: int = BITS
) -> tuple[DataFrame, np.ndarray]:
    """Rows (``key``, cluster, distance) of all vectors with ``width`` finite components, and the last centroids.

    Null vectors, vectors of another length and those with null or non-finite components are left out. Rows with equal or
    null ids are all kept. Components beyond ±2^24 after scaling count as that bound. With fewer vectors than ``count``
    each is a centroid; an empty table has no centroids and no rows. Ties go to the smaller centroid; a centroid without
    vectors stays. Other columns are not read.
    """
    spark: SparkSession = df.sparkSession
    v = F.col(vector)
    kept = df.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(whole.finite(F.col("v")) & (F.size("v") == width))
    kept = kept.select("id", whole.floors(F.col("v"), scale).alias("v"))
    centroids = seeds(kept, count)
    if not len(centroids):
        return kept.select(F.col("id").alias(key), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where("false"), centroids
    packed = kept.mapInArrow(_pack(width, bits), "part long, slice int, ids array<long>, cells binary, marks binary, vectors binary")
    stored = spark.read.parquet(_written(packed, "va-file"))
    approximate = stored.where("slice = -1").select("part", "cells", "marks")
    full = stored.where("slice >= 0").select("part", "slice", "ids", "vectors")
    shape = (len(centroids), width + 1)
    sums, state = np.zeros(shape, object), None
    for _ in range(rounds):
        bounds = approximate.mapInArrow(_bounds(centroids, bits), "part long, slice int, near binary, possible binary, open int")
        if state is None:
            todo = bounds.withColumn("old", F.lit(None).cast("binary"))
        else:
            bounds = spark.read.parquet(_written(bounds.join(state, ["part", "slice"]), "va-bounds"))
            todo = bounds.where((F.col("open") > 0) | (F.col("near") != F.col("old")))
        fetched = todo.join(full.select("part", "slice", "vectors"), ["part", "slice"]).select("part", "slice", "near", "possible", "old", "vectors")
        moved = spark.read.parquet(_written(fetched.mapInArrow(_moves(centroids), f"part long, slice int, near binary, {whole.SUMS}"), "va-moves"))
        sums = sums + whole.totals(moved, shape)
        now = moved.where("part IS NOT NULL").select("part", "slice", F.col("near").alias("old"))
        if state is not None:
            now = now.unionByName(bounds.where((F.col("open") == 0) & (F.col("near") == F.col("old"))).select("part", "slice", "old"))
        state = now
        centroids = np.array([
            [int(total // n) for total in row[:-1]] if (n := row[-1]) else list(centroids[i]) for i, row in enumerate(sums)], np.int64)
    bounds = approximate.mapInArrow(_bounds(centroids, bits), "part long, slice int, near binary, possible binary, open int")
    done = bounds.join(full, ["part", "slice"]).select("near", "possible", "ids", "vectors").mapInArrow(_last(centroids), "id long, cluster int, distance long")
    return spark.read.parquet(_written(done, "va-clusters")).withColumnRenamed("id", key), centroids


def report(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``found`` with cluster_inertia, inertia and centroid_sha256: sums of distances and digests of the centroids."""
    spark = found.sparkSession
    per = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    small = lambda n: min(n, (1 << 63) - 1)
    all_ = small(sum(per.values()))
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    rows = [(i, small(per.get(i, 0)), all_, digest(c)) for i, c in enumerate(centroids)]
    # one row for each centroid, so it is small whatever the input
    of = F.broadcast(spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return found.join(of, "cluster").select(found.columns[0], "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
