"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Vectors are scaled to length one and quantised to int8 with one scale each. For x = s·q + e the product of two vectors
differs from s·s'·(q·q') by at most |s·q|·|e'| + |e|, since all lengths are known exactly and |y| = 1. Tiles of two
blocks are multiplied as whole numbers; pairs whose upper bound stays below the threshold are done, pairs whose lower
bound reaches it are links, and only the pairs between are computed again in double precision.

Every pair of blocks meets in one tile: block i meets the blocks half way round the circle, so each block is copied to
about half of all tiles in its row. All pairs are compared, as cosine neighbours of high-dimensional vectors have no
smaller exact candidate set; a tile returns numbers of links per vector and a star per component, never its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstrata.llm import vectors
from gridstrata.llm.common import checkpoint
from gridstrata.llm.components import components, stars

THRESHOLD = 0.95
#: Vectors in a block; a tile holds two blocks and works through strips of 512 rows.
BLOCK_ROWS = 4096
_SLACK = 1e-6  # more than the rounding of the bounds themselves


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors, their int8 form, scales, lengths of the quantised vectors and lengths of the errors."""
    big = np.abs(x).max(axis=1, keepdims=True)
    unit = x / big
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    near = q * scale[:, None]
    return unit, q, scale, np.sqrt((near * near).sum(axis=1)), np.sqrt(((unit - near) ** 2).sum(axis=1))


def tile(left: np.ndarray, right: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of all pairs of the two blocks with cosine of at least the threshold (i < j within one block)."""
    ux, qx, sx, nx, ex = quantise(left)
    uy, qy, sy, ny, ey = quantise(right)
    rows, cols = [], []
    wide = qy.astype(np.float32).T if qy.shape[1] * 127 * 127 < 1 << 24 else qy.astype(np.float64).T  # whole numbers stay exact
    for lo in range(0, len(qx), 512):
        hi = min(lo + 512, len(qx))
        about = (qx[lo:hi].astype(wide.dtype) @ wide) * sy.astype(np.float32)
        # |x·y − about| ≤ nx·ey + ex ≤ nx·max(ey) + ex: one limit per row first, the pair's own bound for what is left
        least = (threshold - _SLACK - nx[lo:hi] * ey.max() - ex[lo:hi]) / sx[lo:hi]
        i, j = np.nonzero(about >= (least - np.abs(least) * 1e-5)[:, None].astype(np.float32))
        if same:
            keep = i + lo < j
            i, j = i[keep], j[keep]
        for at in range(0, len(i), 1 << 17):
            a, b = i[at : at + (1 << 17)] + lo, j[at : at + (1 << 17)]
            exact = (qx[a].astype(np.int32) * qy[b]).sum(axis=1) * sx[a] * sy[b]
            bound = nx[a] * ey[b] + ex[a] + _SLACK
            sure = exact - bound >= threshold
            open_ = np.flatnonzero(~sure & (exact + bound >= threshold))
            sure[open_] = (ux[a[open_]] * uy[b[open_]]).sum(axis=1) >= threshold
            rows.append(a[sure])
            cols.append(b[sure])
    return (np.concatenate(rows), np.concatenate(cols)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _compare(width: int, kind: str, threshold: float):
    def run(table: pa.Table) -> pa.Table:
        sides = sorted(table.to_pylist(), key=lambda r: r["side"])
        ids, x = vectors.unpack(sides[0]["ids"], sides[0]["vectors"], width, kind)
        other, y = vectors.unpack(sides[-1]["ids"], sides[-1]["vectors"], width, kind)
        i, j = tile(x, y, threshold, len(sides) == 1)
        linked, times = np.unique(np.concatenate([ids[i], other[j]]), return_counts=True)
        u, v = stars(ids[i], other[j])
        return pa.table({
            "u": np.concatenate([linked, u]),
            "v": pa.concat_arrays([pa.nulls(len(linked), pa.int64()), pa.array(v)]),
            "n": pa.concat_arrays([pa.array(times.astype(np.int64)), pa.nulls(len(u), pa.int64())]),
        })

    return run


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one per id.

    n_links counts the other vectors with cosine of at least ``threshold``; component_id is the smallest id that links reach;
    kept marks it. Vectors that are null, zero or hold null or non-finite components link with nothing. Rows without id
    are left out; of rows that repeat an id the least usable vector counts. Shorter vectors are padded by zeros. Other
    columns are not read; an empty table gives no rows.
    """
    rows = checkpoint(vectors.one_per_id(df, key, vector))
    good = rows.where("v IS NOT NULL")
    n, width = vectors.extent(rows)
    count = max(1, -(-n // block_rows))
    kind = "<f4" if dict(rows.dtypes)["v"] == "array<float>" else "<f8"
    half = count // 2
    # tile (i, d) holds block i on the left and block i + d on the right; at half way round only one of the two is made
    steps = F.sequence(F.lit(0), F.lit(half))
    left = F.transform(steps, lambda d: F.struct(F.col("block").alias("i"), d.alias("d"), F.lit(0).alias("side")))
    right = F.transform(steps, lambda d: F.struct(F.pmod(F.col("block") - d, F.lit(count)).alias("i"), d.alias("d"), F.lit(1).alias("side")))
    places = vectors.blocks(good, count, width).select(F.explode(F.concat(left, right)).alias("t"), "ids", "vectors").select("t.*", "ids", "vectors")
    places = places.where("NOT (d = 0 AND side = 1)")
    if count % 2 == 0:
        places = places.where(f"d < {half} OR i < {half}")
    found = checkpoint(places.groupBy("i", "d").applyInArrow(_compare(width, kind, threshold), "u long, v long, n long"))
    links = found.where("v IS NULL").groupBy(F.col("u").alias("id")).agg(F.sum("n").alias("n_links"))
    groups = components(found.where("v IS NOT NULL").select("u", "v")).withColumnRenamed("node", "id")
    out = rows.select("id").join(links, "id", "left").join(groups, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), (component == F.col("id")).alias("kept"))
