"""Plane and sphere geometry as column expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def squared_distance(x1, y1, x2, y2) -> Column:
    dx, dy = _c(x1) - _c(x2), _c(y1) - _c(y2)
    return dx * dx + dy * dy


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dp, dl = p2 - p1, F.radians(_c(lon2)) - F.radians(_c(lon1))
    a = F.pow(F.sin(dp / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def sphere_cells(lat, lon, chord: float) -> dict[str, Column]:
    """Cell numbers of the point on the unit sphere; points closer than the chord lie in touching cells."""
    p, l = F.radians(_c(lat)), F.radians(_c(lon))
    return {
        "cx": F.floor(F.cos(p) * F.cos(l) / chord).cast("bigint"),
        "cy": F.floor(F.cos(p) * F.sin(l) / chord).cast("bigint"),
        "cz": F.floor(F.sin(p) / chord).cast("bigint"),
    }


def chord_of_km(km: float) -> float:
    return 2 * math.sin(min(km / EARTH_KM, math.pi) / 2)


def within_km(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray, km: float) -> np.ndarray:
    """Which places of the first list are within ``km`` of which of the second, as a matrix, in degrees.

    The angle's cosine is a product of unit vectors; where it is so close to the limit that rounding may decide, the
    haversine formula does, as in ``haversine_km``.
    """
    p1, l1, p2, l2 = (np.radians(np.asarray(v, float)) for v in (lat1, lon1, lat2, lon2))
    unit = lambda p, l: np.stack([np.cos(p) * np.cos(l), np.cos(p) * np.sin(l), np.sin(p)], 1)
    over = unit(p1, l1) @ unit(p2, l2).T
    over -= math.cos(min(km / EARTH_KM, math.pi))
    near = over > 0
    i, j = np.nonzero(np.abs(over, out=over) < 1e-14)
    if len(i):
        a = np.sin((p2[j] - p1[i]) / 2) ** 2 + np.cos(p1[i]) * np.cos(p2[j]) * np.sin((l2[j] - l1[i]) / 2) ** 2
        near[i, j] = 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(a, 1.0))) <= km
    return near


def segment_distance(px, py, ax, ay, bx, by) -> Column:
    """Distance of a point to a line segment."""
    px, py, ax, ay, bx, by = map(_c, (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length > 0, ((px - ax) * dx + (py - ay) * dy) / length).otherwise(0.0)
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return F.sqrt(squared_distance(px, py, ax + t * dx, ay + t * dy))


def in_ellipse(x, y, cx, cy, width, height, angle_deg) -> dict[str, Column]:
    """Inside test and distances (degrees turned to km by 111) to the centre and the boundary of a turned ellipse."""
    dx, dy = _c(x) - _c(cx), _c(y) - _c(cy)
    turn = F.radians(_c(angle_deg))
    u = (dx * F.cos(turn) + dy * F.sin(turn)) / (_c(width) / 2)
    v = (dy * F.cos(turn) - dx * F.sin(turn)) / (_c(height) / 2)
    level = u * u + v * v
    half = F.sqrt(F.pow(_c(width) / 2, 2) + F.pow(_c(height) / 2, 2))
    return {
        "inside": level <= 1,
        "to_center": F.sqrt(dx * dx + dy * dy) * 111,
        "to_boundary": F.abs(F.sqrt(level) - 1) * half * 111,
    }
