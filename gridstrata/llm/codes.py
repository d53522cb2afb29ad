"""Vector codes: consecutive parts of vectors as numbers of codebook entries, trained by exact whole-number rounds.

Vectors are whole numbers, floor(scale * x), in chunks of up to 8192. For each part position a chunk's parts are sorted
along a Hilbert curve and cut into flat blocks of 32, each with the least and largest of every component and the sums of
its parts. Every round works on blocks first: the distance from an entry to the nearest and to the farthest point of a
block's box bounds the distance to every part in it, so only entries whose least distance does not exceed the smallest
farthest distance can be nearest to a part of the block, ties included. A block with one such entry is assigned whole and
adds its stored sums; the others are evaluated by a small exact kernel of the block's parts against its shortlist.

A chunk is one row and is written once; no vector is shuffled. Tasks hand over the sums per position and entry, which
Spark adds up to the size of the codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstrata.llm import whole
from gridstrata.llm.common import checkpoint
from gridstrata.session import scratch_path

CHUNK, BLOCK = 8192, 32


def hilbert(x: np.ndarray) -> np.ndarray:
    """Place of each row along a Hilbert curve through the rows' box, with as many bits a component as fit into 62."""
    n, dims = x.shape[0], min(x.shape[1], 62)
    bits = max(1, min(16, 62 // dims))
    low, high = x[:, :dims].min(axis=0), x[:, :dims].max(axis=0)
    axes = ((x[:, :dims] - low) * ((1 << bits) - 1) // np.maximum(high - low, 1)).T.copy()
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # from the transposed axes to the curve: undo the turns of each level
        for i in range(dims):
            up = (axes[i] & q) != 0
            swap = np.where(up, 0, (axes[0] ^ axes[i]) & (q - 1))
            axes[0] ^= np.where(up, q - 1, swap)
            if i:
                axes[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        axes[i] ^= axes[i - 1]
    turn = np.zeros(n, np.int64)
    q = top
    while q > 1:
        turn ^= np.where((axes[-1] & q) != 0, q - 1, 0)
        q >>= 1
    axes ^= turn
    out = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = out << 1 | (axes[i] >> b & 1)
    return out


class Blocks:
    """The parts of one position of a chunk in Hilbert order: blocks with boxes and sums."""

    def __init__(self, parts: np.ndarray, size: int = BLOCK):
        self.order = np.argsort(hilbert(parts), kind="stable")
        self.size, self.n = size, len(parts)
        self.sorted = parts[self.order]
        starts = np.arange(0, self.n, size)
        self.low = np.minimum.reduceat(self.sorted, starts)
        self.high = np.maximum.reduceat(self.sorted, starts)
        self.sums = np.add.reduceat(self.sorted, starts)
        self.counts = np.diff(np.append(starts, self.n))

    def shortlists(self, entries: np.ndarray) -> np.ndarray:
        """For each block and entry whether the entry can be nearest to a part of the block."""
        near = np.zeros((len(self.low), len(entries)), np.int64)
        far = np.zeros_like(near)
        for j in range(entries.shape[1]):
            e = entries[:, j]
            below, above = self.low[:, j, None] - e, e - self.high[:, j, None]
            gap = np.maximum(np.maximum(below, above), 0)
            near += gap * gap
            reach = np.maximum(np.abs(below), np.abs(above))
            far += reach * reach
        return near <= far.min(axis=1, keepdims=True)

    def nearest(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry of each part in sorted order, and for blocks with a shortlist of one that entry, else −1."""
        listed = self.shortlists(entries)
        length = listed.sum(axis=1)
        ranked = np.argsort(~listed, axis=1, kind="stable")  # a block's entries first, in their order
        alone = np.where(length == 1, ranked[:, 0], -1)
        out = np.repeat(alone, self.counts)
        width = 2
        while width < 2 * len(entries):  # blocks with shortlists of like length together
            some = np.flatnonzero((length > (width >> 1 if width > 2 else 1)) & (length <= width))
            for at in range(0, len(some), 64):
                take = some[at : at + 64]
                rows = np.minimum(take[:, None] * self.size + np.arange(self.size), self.n - 1)
                wide = min(width, len(entries))
                use = np.minimum(np.arange(wide), length[take, None] - 1)  # short lists repeat their last entry
                entry = np.take_along_axis(ranked[take], use, axis=1)
                away = np.zeros((len(take), self.size, wide), np.int64)
                for j in range(entries.shape[1]):
                    d = self.sorted[rows, j][:, :, None] - entries[entry, j][:, None, :]
                    away += d * d
                found = np.take_along_axis(entry, away.argmin(axis=2), axis=1)
                out[rows.ravel()] = found.ravel()
            width *= 2
        return out, alone


def _chunks(width: int, size: int):
    def row(rows: pa.Table) -> pa.RecordBatch:
        x = whole.matrix(rows.column(1), width)
        ids, labels = (rows.column(k).combine_chunks().to_pylist() for k in (0, 2))
        kinds = (pa.list_(pa.int64()), pa.list_(rows.schema.field(2).type), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((ids, labels, x.astype("<i4").tobytes()), kinds)], ["ids", "labels", "vectors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                piece = batch.slice(at, size)
                if held and held + piece.num_rows > size:
                    yield row(pa.Table.from_batches(waiting))
                    waiting, held = [], 0
                waiting.append(piece)
                held += piece.num_rows
        if held:
            yield row(pa.Table.from_batches(waiting))

    return run


def _positions(vectors: bytes, width: int, positions: int) -> Iterator[np.ndarray]:
    x = np.frombuffer(vectors, "<i4").reshape(-1, width).astype(np.int64)
    step = width // positions
    for p in range(positions):
        yield np.ascontiguousarray(x[:, p * step : (p + 1) * step])


def _round(books: np.ndarray, width: int):
    positions, count, step = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((positions * count, step + 1), np.int64)
        for batch in batches:
            for vectors in batch.column(0):
                for p, parts in enumerate(_positions(vectors.as_py(), width, positions)):
                    blocks = Blocks(parts)
                    near, alone = blocks.nearest(books[p])
                    kept = np.flatnonzero(alone >= 0)
                    np.add.at(sums, p * count + alone[kept], np.concatenate([blocks.sums[kept], blocks.counts[kept, None]], axis=1))
                    rest = np.repeat(alone, blocks.counts) < 0
                    one = np.concatenate([blocks.sorted[rest], np.ones((int(rest.sum()), 1), np.int64)], axis=1)
                    np.add.at(sums, p * count + near[rest], one)
        yield whole.sum_rows(sums, {})

    return run


def _codes(books: np.ndarray, width: int, label: pa.DataType):
    positions, _, _ = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                code = np.zeros((len(ids), positions), np.int64)
                error = np.zeros(len(ids), np.int64)
                for p, parts in enumerate(_positions(batch.column(2)[i].as_py(), width, positions)):
                    blocks = Blocks(parts)
                    near, _ = blocks.nearest(books[p])
                    d = blocks.sorted - books[p][near]
                    code[blocks.order, p] = near
                    error[blocks.order] += (d * d).sum(axis=1)
                wide = 1 if books.shape[1] <= 256 else 2
                raw = code.astype(">u1" if wide == 1 else ">u2").tobytes()
                step = wide * positions
                text = [raw[k * step : (k + 1) * step].hex() for k in range(len(ids))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(labels, label), pa.array(text, pa.string()), pa.array(error, pa.int64())],
                    ["id", "label", "code", "error"])

    return run


def quantise(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256, positions: int = 16, entries: int = 64, rounds: int = 2
) -> tuple[DataFrame, np.ndarray]:
    """Rows (``key``, ``label``, code, error) of all vectors with finite components, and the codebooks.

    Null vectors and those with null or non-finite components are left out. Rows with equal or null ids are all kept. The
    width is that of the longest vector, rounded up to whole parts; shorter vectors are padded by zeros. Components beyond
    ±2^24 after scaling count as that bound. With fewer vectors than ``entries`` the codebooks are as short as there are
    vectors; null ids come last among them, equal ids are taken in the order of their vectors. An empty table gives no
    rows. Ties go to the smaller entry; entries without parts stay. Other columns are not read.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.col(label).alias("label")).where(whole.finite(F.col("v")))
    rows = rows.select("id", whole.floors(F.col("v"), scale).alias("v"), "label")
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    width = -(-max(1, longest or 0) // positions) * positions
    first = [r.v for r in rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()]
    kind = df.schema[label].dataType
    coded = f"id long, label {kind.simpleString()}, code string, error long"
    if not first:
        none = spark.createDataFrame([], coded)
        return none.toDF(key, label, "code", "error"), np.zeros((positions, 0, width // positions), np.int64)
    start = np.zeros((len(first), width), np.int64)
    for i, v in enumerate(first):
        start[i, : len(v)] = v
    books = np.ascontiguousarray(start.reshape(len(first), positions, -1).transpose(1, 0, 2))
    path = scratch_path(spark, "code-chunks")
    rows.mapInArrow(_chunks(width, CHUNK), f"ids array<long>, labels array<{kind.simpleString()}>, vectors binary").write.parquet(path)
    chunks = spark.read.parquet(path)
    count, step = len(first), width // positions
    for _ in range(rounds):
        found = whole.totals(chunks.select("vectors").mapInArrow(_round(books, width), whole.SUMS), (positions * count, step + 1))
        for p in range(positions):
            for e in range(count):
                *sums, n = found[p * count + e]
                if n:
                    books[p, e] = [int(s // n) for s in sums]
    from pyspark.sql.pandas.types import to_arrow_type

    out = chunks.select("ids", "labels", "vectors").mapInArrow(_codes(books, width, to_arrow_type(kind)), coded)
    return out.select(F.col("id").alias(key), F.col("label").alias(label), "code", "error"), books


def digest(books: np.ndarray) -> str:
    """Hash of all components by position, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def report(found: DataFrame, books: np.ndarray) -> DataFrame:
    """``found`` with label_error (error summed over equal labels, nulls together) and codebooks_sha256."""
    key, label = found.columns[:2]
    rows = checkpoint(found)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1)).cast("long")
    # written out, so that the join has two plain shuffled sides and a hot label can be split
    per = checkpoint(rows.groupBy(F.col(label).alias("of")).agg(total.alias("label_error")))
    joined = rows.join(per, rows[label].eqNullSafe(per["of"]))
    return joined.select(key, "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
