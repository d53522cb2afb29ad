"""Density clusters against brute force, and the number of pairs that are compared."""

import math

import numpy as np
import pytest

from gridstrata.operators import density

PLACES = "g int, id int, x double, y double"


def brute_dbscan(points, eps, need):
    near = {a: [b for b in points if math.dist(points[a], points[b]) <= eps] for a in points}
    core = {a for a in points if len(near[a]) >= need}
    root = {a: a for a in core}
    changed = True
    while changed:
        changed = False
        for a in core:
            low = min(root[b] for b in near[a] if b in core)
            if low < root[a]:
                root[a], changed = low, True
    return {a: root[a] if a in core else min((root[b] for b in near[a] if b in core), default=-1) for a in points}


def clusters(spark, rows, eps, need):
    out = density.density_clusters(spark.createDataFrame(rows, PLACES), ["g"], "id", "x", "y", eps, need)
    return {r["id"]: (r["cluster"], r["core"]) for r in out.collect()}


def wanted(rows, eps, need):
    out = {}
    for g in {r[0] for r in rows}:
        points = {i: (x, y) for k, i, x, y in rows if k == g}
        near = {a: sum(math.dist(points[a], q) <= eps for q in points.values()) for a in points}
        out |= {i: (c, int(near[i] >= need)) for i, c in brute_dbscan(points, eps, need).items()}
    return out


@pytest.mark.parametrize(("seed", "spread", "need"), [(5, 6, 3), (6, 2, 3), (7, 12, 4), (8, 3, 8)])
def test_density_clusters(spark, seed, spread, need):
    """Thin, dense and mixed places in two groups, with copies of one place."""
    rng = np.random.default_rng(seed)
    rows = [(int(i % 2), i, *map(float, np.round(rng.uniform(-spread, spread, 2) if i % 3 else rng.normal(0, 0.3, 2), 2))) for i in range(160)]
    rows += [(0, 200 + i, 30.0, 30.0) for i in range(9)]
    assert clusters(spark, rows, 0.7, need) == wanted(rows, 0.7, need)


@pytest.mark.parametrize("gap", [0.99, 1.0, 1.0000001, 1.01])
def test_crowded_cells_meet_at_the_closest_pair(spark, gap):
    """Two crowded bands whose closest places are exactly in reach, or just out of it."""
    rng = np.random.default_rng(11)
    left = [(-float(a), float(b)) for a, b in rng.uniform(0.001, 0.5, (80, 2))] + [(0.0, 0.25)]
    right = [(gap + float(a), float(b)) for a, b in rng.uniform(0.001, 0.5, (80, 2))] + [(gap, 0.25)]
    rows = [(0, i, x, y) for i, (x, y) in enumerate(left + right)]
    got = clusters(spark, rows, 1.0, 5)
    assert got == wanted(rows, 1.0, 5)
    assert len({c for c, _ in got.values()}) == (1 if gap <= 1 else 2)


def test_lines_of_crowded_cells_just_out_of_reach(spark):
    """Facing columns of places: every box pair stays open until single places are compared."""
    rows = [(0, i + 200 * side, side * 1.00001, i / 100) for side in (0, 1) for i in range(60)]
    assert {c for c, _ in clusters(spark, rows, 1.0, 4).values()} == {0, 200}


def test_pairs_grow_with_the_places(spark):
    """Ten times the places on the same ground: compared pairs stay below a fixed number a place, and crowded cells form none."""
    rng = np.random.default_rng(3)
    need, counts = 5, {}
    for n in (400, 4000):
        rows = [(0, i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 10, (n, 2)))]
        placed = density.placed_in_cells(spark.createDataFrame(rows, PLACES), ["g"], "id", "x", "y", 1.0, need)
        thin = placed.where("not crowded").count()
        counts[n] = density.candidates(placed, 1).count()
        assert counts[n] <= 25 * (need - 1) * n and thin <= n
    assert counts[4000] < counts[400]


def test_rows_without_a_place_are_noise(spark):
    rows = [(0, 1, 0.0, 0.0), (0, 2, -0.0, 0.0), (0, 3, None, 0.0), (0, 4, float("nan"), 0.0), (0, 5, 0.0, float("inf")), (None, 6, 0.0, 0.0)]
    got = clusters(spark, rows, 1.0, 2)
    assert got == {1: (1, 1), 2: (1, 1), **{i: (-1, 0) for i in (3, 4, 5, 6)}}
    assert clusters(spark, [], 1.0, 2) == {}
