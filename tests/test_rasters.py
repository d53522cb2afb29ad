"""Common grids and bilinear alignment: the same as by loops, each grid cell made and met once."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridstrata.operators import spatial

RASTER = "col long, row long, v double"


def bilinear(cells, size, raster_size, col, row):
    x, y = ((c + 0.5) * size / raster_size - 0.5 for c in (col, row))
    top = weights = 0.0
    for dx in (0, 1):
        for dy in (0, 1):
            fx, fy = x - math.floor(x), y - math.floor(y)
            w = (fx if dx else 1 - fx) * (fy if dy else 1 - fy)
            for v in cells.get((math.floor(x) + dx, math.floor(y) + dy), ()) if w > 0 else ():
                top, weights = top + w * v, weights + w
    return top / weights if weights else None


@pytest.mark.parametrize("size, raster_size", [(2.0, 3.0), (3.0, 2.0), (1.0, 1.0), (7.0, 0.7), (0.3, 2.9)])
def test_bilinear_alignment_by_loops(spark, size, raster_size):
    rng = np.random.default_rng(8)
    n = math.ceil(24 * size / raster_size) + 2
    rows = [(int(c), int(r), float(v)) for c, r, v in zip(rng.integers(-2, n, 300), rng.integers(-2, n, 300), rng.normal(size=300))]
    rows += [(c, r, float(c - r)) for c in range(6) for r in range(6)] + [(3, 3, None), (None, 2, 5.0)]  # cells may come twice
    cells = {}
    for c, r, v in rows:
        if c is not None and v is not None:
            cells.setdefault((c, r), []).append(v)
    grid = [(c, r, (c + 2) * 100 + r + 2) for c in range(-2, 24) for r in range(-2, 24)] + [(1, 1, -1), (None, 4, -2)]
    out = spatial.align_bilinear(spark.createDataFrame(grid, "col long, row long, g int"), size, spark.createDataFrame(rows, RASTER), raster_size, "v", "got")
    assert out.columns == ["col", "row", "g", "got"]
    got = {r.g: r for r in out.collect()}
    assert len(got) == len(grid) and got[-2].got is None and got[-2].col is None
    for c, r, g in grid[:-1]:
        want = bilinear(cells, size, raster_size, c, r)
        assert (got[g].col, got[g].row) == (c, r) and got[g].got == (want if want is None else pytest.approx(want, abs=1e-9)), (c, r)


def test_the_grid_is_dealt_out_and_met_once(spark):
    raster = spark.range(300 * 40).selectExpr("id % 40 AS col", "id DIV 40 AS row", "id * 1.0D AS v")
    grid = spatial.common_grid([(raster, 1.0)], 1.0)
    got = grid.withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.row, r.col) for r in got) == [(r, c) for r in range(300) for c in range(40)]
    assert len({r.task for r in got}) > 1  # few bytes go in: merged by them, one task would make all cells
    cells = spark.range(100).selectExpr("id % 10 AS col", "id DIV 10 AS row")
    plan = spatial.align_bilinear(cells, 2.0, spark.createDataFrame([(0, 0, 1.0)], RASTER), 3.0, "v", "got")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (0, 100") == 1


def test_common_grid_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(spatial, "TILE", (4, 8))
    box = lambda c0, c1, r0, r1: spark.createDataFrame([(c0, r0, 0.0), (c1, r1, 0.0)], RASTER)
    got = spatial.common_grid([(box(-7, 30, -9, 21), 1.0), (box(-1, 20, -2, 3), 3.0)], 2.0).collect()
    assert sorted((r.col, r.row) for r in got) == [(c, r) for c in range(-1, 15) for r in range(-3, 6)]
    assert spatial.common_grid([(box(0, 3, 0, 3), 1.0), (box(5, 9, 0, 3), 1.0)], 1.0).count() == 0  # nothing in common, no cells as in SQL
    assert spatial.common_grid([(box(0, 3, 0, 3).limit(0), 1.0)], 1.0).count() == 0
