"""Approximate nearest neighbours by a forest of hash prefixes.

Rows are dealt into blocks of a fixed size, and each block builds its own forest: per tree, every row has a string of 32
bits (sides of random planes through the block's centre), and the strings are held as one sorted array. A query descends
in all trees at once to its longest matching prefixes, then ascends in all trees level by level until the rows below
hold enough entries; their exact distances decide. Query blocks visit every block of rows; each gives its nearest ten,
and the best ten of all blocks stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridstrata.llm import vectors
from gridstrata.llm.common import checkpoint

TREES = 64
BITS = 32
#: Rows of a block.
BLOCK_ROWS = 8192
#: The ascent ends when the rows below the prefixes of all trees, counted with repeats, reach this share of the block.
SHARE = 0.75
NEAREST = 10
#: One row in so many is a query.
EVERY = 100
_QUERIES = 512


class Forest:
    def __init__(self, x: np.ndarray, trees: int = TREES, seed: int = 6):
        self.x, self.trees = x, trees
        rng = np.random.default_rng(seed)
        self.planes = rng.standard_normal((x.shape[1], trees * BITS)).astype(np.float32)
        self.centre = x.mean(axis=0)
        self.scale = max(float(np.abs(x - self.centre).max()), 1e-300)
        strings = self.strings(x)
        self.order = np.argsort(strings, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.ascontiguousarray(np.take_along_axis(strings, self.order.astype(np.int64), 0).T)

    def strings(self, x: np.ndarray) -> np.ndarray:
        """The hash string of each row in each tree."""
        out = np.empty((len(x), self.trees), np.uint64)
        for lo in range(0, len(x), 1024):
            side = ((x[lo : lo + 1024] - self.centre) / self.scale).astype(np.float32) @ self.planes > 0
            packed = np.packbits(side.reshape(-1, self.trees, BITS), axis=2)
            out[lo : lo + 1024] = packed.reshape(-1, self.trees, 4).view(">u4")[:, :, 0]
        return out

    def below(self, strings: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the rows that share the first ``depth`` bits begin and end in each tree's array, for each query."""
        cut = np.uint64(BITS - depth)
        first = (strings >> cut) << cut
        lo, hi = np.empty(strings.shape, np.int64), np.empty(strings.shape, np.int64)
        for t in range(self.trees):
            lo[:, t] = np.searchsorted(self.sorted[t], first[:, t])
            hi[:, t] = np.searchsorted(self.sorted[t], first[:, t] + (np.uint64(1) << cut))
        return lo, hi

    def candidates(self, queries: np.ndarray, share: float = SHARE, least: int = NEAREST + 1):
        """For each query the rows below its prefixes, as numbers of rows in ascending order, ``least`` or all at least."""
        strings, need = self.strings(queries), share * len(self.x)
        lo, hi = self.below(strings, BITS)
        depth = np.full(len(queries), BITS)
        live = np.arange(len(queries))
        for d in range(BITS - 1, -1, -1):
            live = live[(hi[live] - lo[live]).sum(axis=1) < need]
            if not len(live):
                break
            depth[live] = d
            lo[live], hi[live] = self.below(strings[live], d)
        for i in range(len(queries)):
            while True:
                mask = np.zeros(len(self.x), bool)
                for t in range(self.trees):
                    mask[self.order[lo[i, t] : hi[i, t], t]] = True
                if not depth[i] or np.count_nonzero(mask) >= least:
                    break
                depth[i] -= 1
                lo[i : i + 1], hi[i : i + 1] = self.below(strings[i : i + 1], int(depth[i]))
            yield np.flatnonzero(mask)


def _visit(width: int, kind: str, nearest: int, share: float, trees: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if rows.num_rows and queries.num_rows:
            ids, x = vectors.unpack(rows.column("ids")[0].as_py(), rows.column("vectors")[0].as_py(), width, kind)
            forest = Forest(x, trees)
            for q in queries.to_pylist():
                names, y = vectors.unpack(q["ids"], q["vectors"], width, kind)
                for name, point, near in zip(names, y, forest.candidates(y, share, nearest + 1)):
                    near = near[ids[near] != name]
                    gap = x[near] - point
                    score = np.sqrt((gap * gap).sum(axis=1))
                    if len(near) > nearest:
                        limit = np.partition(score, nearest - 1)[nearest - 1]
                        near, score = near[score <= limit], score[score <= limit]
                    best = np.lexsort((ids[near], score))[:nearest]
                    out.append((np.full(len(best), name), ids[near][best], score[best]))
        cols = [np.concatenate([o[i] for o in out]) if out else np.zeros(0) for i in range(3)]
        return pa.table({"query_id": cols[0].astype(np.int64), "vec_id": cols[1].astype(np.int64), "score": cols[2].astype(np.float64)})

    return run


def neighbours(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", nearest: int = NEAREST, every: int = EVERY, block_rows: int = BLOCK_ROWS,
    share: float = SHARE, trees: int = TREES,
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``nearest`` rows found for each row whose id is divisible by ``every``.

    score is the Euclidean distance in double precision, ties go to the smaller id, and a row is not its own neighbour.
    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without id; of rows that
    repeat an id the least usable vector counts. Shorter vectors are padded by zeros. With fewer candidates all are
    returned; other columns are not read; an empty table gives no rows.
    """
    rows = checkpoint(vectors.one_per_id(df, key, vector).where("v IS NOT NULL"))
    n, width = vectors.extent(rows)
    count = max(1, -(-n // block_rows))
    kind = "<f4" if dict(rows.dtypes)["v"] == "array<float>" else "<f8"
    asked = rows.where(F.pmod("id", F.lit(every)) == 0)
    per = max(1, -(-n // (every * _QUERIES)))
    sent = vectors.blocks(asked, per, width).select(F.explode(F.expr(f"sequence(0L, {count - 1}L)")).alias("block"), "ids", "vectors")
    held = vectors.blocks(rows, count, width)
    found = held.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(_visit(width, kind, nearest, share, trees), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
