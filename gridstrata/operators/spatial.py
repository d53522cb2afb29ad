"""Ellipses, moving clusters, hit zones, tessellation and raster tables."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstrata.functions import geo
from gridstrata.operators.joins import around, inside_ring, points_in_polygons, within_distance, within_km
from gridstrata.operators.ranks import attach, exact_quantiles
from gridstrata.operators.resample import spread
from gridstrata.session import checkpoint


def _moments(df: DataFrame, keys: Sequence[str], x: str, y: str, w: str) -> DataFrame:
    """Weighted centre and covariance (reliability weights) per key, by sums of centred products."""
    centre = df.groupBy(*keys).agg(
        (F.sum(F.col(x) * F.col(w)) / F.sum(w)).alias("cx"), (F.sum(F.col(y) * F.col(w)) / F.sum(w)).alias("cy"),
        F.count(F.lit(1)).alias("n"), F.avg(w).alias("weight"),
    )
    c = df.join(centre, list(keys))
    dx, dy, wt = F.col(x) - F.col("cx"), F.col(y) - F.col("cy"), F.col(w)
    norm = F.sum(wt) - F.sum(wt * wt) / F.sum(wt)
    cov = c.groupBy(*keys).agg(
        F.try_divide(F.sum(wt * dx * dx), norm).alias("vxx"), F.try_divide(F.sum(wt * dy * dy), norm).alias("vyy"),
        F.try_divide(F.sum(wt * dx * dy), norm).alias("vxy"),
    )
    return centre.join(cov, list(keys))


def weighted_ellipse(df: DataFrame, keys: Sequence[str], x: str, y: str, w: str, outliers_from: int = 10) -> DataFrame:
    """Weighted centre, two-sigma axes and angle of each group of points.

    Groups of at least ``outliers_from`` points first lose those beyond the 90 % quantile of the Mahalanobis distance
    (Euclidean where the covariance is singular). Axes are the closed-form eigenvalues of the 2×2 covariance.
    """
    m = _moments(df, keys, x, y, w)
    rows = df.join(m.drop("weight"), list(keys))
    dx, dy = F.col(x) - F.col("cx"), F.col(y) - F.col("cy")
    det = F.col("vxx") * F.col("vyy") - F.col("vxy") * F.col("vxy")
    maha = F.sqrt((dx * dx * F.col("vyy") - 2 * dx * dy * F.col("vxy") + dy * dy * F.col("vxx")) / det)
    rows = rows.withColumn("_d", F.when(det > 1e-12, maha).otherwise(F.sqrt(dx * dx + dy * dy)))
    cut = exact_quantiles(rows, keys, "_d", {"_cut": 0.9})
    rows = rows.join(cut, list(keys)).where((F.col("n") < outliers_from) | (F.col("_d") <= F.col("_cut")))
    e = _moments(rows.select(*keys, x, y, w), keys, x, y, w)
    half, diff = (F.col("vxx") + F.col("vyy")) / 2, (F.col("vxx") - F.col("vyy")) / 2
    root = F.sqrt(diff * diff + F.col("vxy") * F.col("vxy"))
    return e.select(
        *keys, "cx", "cy", (4 * F.sqrt(half + root)).alias("width"), (4 * F.sqrt(F.greatest(half - root, F.lit(0.0)))).alias("height"),
        F.degrees(F.atan2(2 * F.col("vxy"), F.col("vxx") - F.col("vyy")) / 2).alias("angle"), "weight", F.col("n").alias("size"),
    )


def cluster_motion(df: DataFrame, pid: str, hour: str, lat: str, lon: str, weight: str, size: str, back: int = 4, max_km: float = 100.0) -> DataFrame:
    """Velocity and change of each centroid against the nearest one of the most recent earlier hour within reach.

    ``hour`` is a whole number. An earlier centroid is offered to the next ``back`` hours and meets them by hour and
    grid cell of the largest reach.
    """
    past = df.select(pid, hour, lat, lon, weight, size)
    offered = past.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(back)))).withColumn(hour, F.col(hour) + F.col("lag"))
    pairs = within_km(past, offered, lat, lon, max_km * back, suffix="_1", keys=[hour])
    pairs = pairs.where(F.col("km") <= max_km * F.col("lag_1"))
    order = F.struct("lag_1", "km", f"{pid}_1")
    best = pairs.groupBy(pid, hour).agg(F.min_by(F.struct(*pairs.columns), order).alias("_b")).select("_b.*")
    moved = (F.col(lat) != F.col(f"{lat}_1")) | (F.col(lon) != F.col(f"{lon}_1"))
    n = F.col("lag_1")
    return best.where(moved).select(
        pid, hour, lat, lon, weight, size, ((F.col(lat) - F.col(f"{lat}_1")) / n).alias("lat_diff"), ((F.col(lon) - F.col(f"{lon}_1")) / n).alias("lon_diff"),
        ((F.col(weight) - F.col(f"{weight}_1")) / n).alias("weight_diff"), (F.col(size) - F.col(f"{size}_1")).alias("size_diff"),
    )


def hit_zones(vectors: DataFrame, counties: DataFrame, neighbours: DataFrame, hours: Sequence[int] = (3, 6), cell: float = 2.0) -> DataFrame:
    """Strongest projected impact per stamp, county and horizon.

    ``vectors``: vid, ts, lat, lon, lat_diff, lon_diff, width, height, angle, weight, weight_diff, size_diff;
    ``counties``: county, lat, lon; ``neighbours``: county, other. An ellipse is moved ahead and widened, hits the
    counties inside and their neighbours; the impact falls with the distance to its centre. Ellipses meet counties in
    the grid cells of their bounding circles.
    """
    v = vectors.withColumn("h", F.explode(F.array(*map(F.lit, hours))))
    clip = lambda c, lo, hi: F.greatest(F.least(c, F.lit(hi)), F.lit(lo))
    impact = clip(F.col("weight") / 600, 0.0, 10.0) + clip(F.col("h") * F.col("weight_diff") / 250, -3.0, 3.0) + clip(F.col("size_diff") / 2, -1.0, 10.0)
    v = v.withColumn("impact", F.round(impact, 1))
    grow = F.when(F.col("impact") > 0, F.col("h") * 0.15).otherwise(0.0)
    v = v.select(
        "vid", "ts", "h", "impact", (F.col("lat") + F.col("h") * F.col("lat_diff")).alias("py"), (F.col("lon") + F.col("h") * F.col("lon_diff")).alias("px"),
        (F.col("width") + grow).alias("pw"), (F.col("height") + grow).alias("ph"), "angle",
    )
    r = F.greatest("pw", "ph") / 2
    boxes = v.withColumn("_cx", F.explode(F.sequence(F.floor((F.col("px") - r) / cell), F.floor((F.col("px") + r) / cell))))
    boxes = boxes.withColumn("_cy", F.explode(F.sequence(F.floor((F.col("py") - r) / cell), F.floor((F.col("py") + r) / cell))))
    places = counties.withColumns({"_cx": F.floor(F.col("lon") / cell), "_cy": F.floor(F.col("lat") / cell)})
    inside = boxes.join(places, ["_cx", "_cy"]).where(geo.in_ellipse("lon", "lat", "px", "py", "pw", "ph", "angle")["inside"])
    keep = ["vid", "ts", "h", "impact", "py", "px"]
    hit = inside.select(*keep, "county")
    around = hit.join(neighbours, "county").select(*keep, F.col("other").alias("county")).distinct()
    sizes = hit.select("vid", "h").unionByName(around.select("vid", "h")).groupBy("vid", "h").agg(F.count(F.lit(1)).alias("n_hit"))
    rows = hit.unionByName(around).distinct().join(counties, "county").join(sizes, ["vid", "h"])
    dist = F.sqrt(geo.squared_distance("lon", "lat", "px", "py")) * 111
    fade = clip(1 + dist / 150, 1.0, 3.0)
    power = F.greatest("impact", F.lit(0.0)) / clip(fade * fade, 1.0, 4.0)
    rows = rows.withColumns({"distance": dist, "power": F.round(power, 9)})
    best = F.min_by(F.struct("vid", "distance", "n_hit", "power"), F.struct(-F.col("power"), F.col("vid"))).alias("_b")
    return rows.groupBy("ts", "county", "h").agg(best).select("ts", "county", "h", "_b.*")


def tessellate(polygons: DataFrame, ids: Sequence[str], ring: str, size: float) -> DataFrame:
    """Squares of the size over each polygon's box whose four corners lie inside it."""

    def steps(pick: str) -> Column:
        values = F.transform(ring, lambda p: p[pick])
        return F.sequence(F.floor(F.array_min(values) / size), F.floor(F.array_max(values) / size))

    squares = polygons.withColumn("col", F.explode(steps("x"))).withColumn("row", F.explode(steps("y")))
    corners = [
        inside_ring((F.col("col") + dx) * F.lit(size), (F.col("row") + dy) * F.lit(size), F.col(ring)) for dx in (0, 1) for dy in (0, 1)
    ]
    return squares.where(corners[0] & corners[1] & corners[2] & corners[3]).select(*ids, "col", "row")


def buffer_label(cells: DataFrame, cid: str, deposits: DataFrame, x: str, y: str, radius: float, data: str) -> DataFrame:
    """1 for cells within the radius of a deposit, 0 for others, null where the cell has no data."""
    near = within_distance(cells.select(cid, x, y), deposits.select(x, y), x, y, radius).select(cid).distinct()
    out = cells.join(near.withColumn("_n", F.lit(1)), cid, "left")
    return out.withColumn("label", F.when(F.col(data).isNotNull(), F.coalesce("_n", F.lit(0)))).drop("_n")


#: Places in a square of the finest level of ``zonal_stats``, about, and most halvings of the radius.
SQUARE_PLACES, HALVINGS = 4, 8


def zonal_stats(cells: DataFrame, zones: DataFrame, zid: str, x: str, y: str, radius: float, value: str) -> DataFrame:
    """Count, mean, minimum and maximum of the cells inside each zone's radius; zones without cells keep 0 and null.

    Cells are summed up by place and by squares whose side is the radius, its half, and so on. A square inside the circle
    counts as a whole, one on its edge is cut in four; only in the smallest squares places are compared one by one. The
    smallest ones hold few places, so the work of a zone grows with the root of the density. Squares of zones meet those of
    cells in all shuffle tasks: their estimated size is that of the zones, so the engine would broadcast them.
    """
    state = [F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("low").alias("low"), F.max("high").alias("high")]
    at = lambda c, size: F.floor(F.col(c) / size)
    places = cells.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("_px"), F.col(y).alias("_py")).agg(
        F.count(value).alias("n"), F.sum(F.col(value).cast("double")).alias("s"), F.min(value).alias("low"), F.max(value).alias("high"))
    places = checkpoint(places)
    squares = places.groupBy(at("_px", radius), at("_py", radius)).agg(F.count(F.lit(1)).alias("k"))
    dense = squares.agg(F.avg("k")).first()[0] or 0
    depth = min(HALVINGS, max(0, math.ceil(math.log(max(dense, 1) / SQUARE_PLACES, 4))))
    edge = spread(zones.select(zid, F.col(x).alias("_x"), F.col(y).alias("_y")), zid)
    edge = edge.withColumn("_cx", around(at("_x", radius))).withColumn("_cy", around(at("_y", radius)))
    found = []
    for level in range(depth + 1):
        size = radius / 2**level
        # farthest and nearest point of the square, with room for rounding: squares in doubt are looked into
        far, near = F.lit(0.0), F.lit(0.0)
        for c, place in (("_cx", "_x"), ("_cy", "_y")):
            slack = (F.abs(place) + radius) * 1e-12
            low, high = F.col(c) * F.lit(size) - F.col(place) - slack, (F.col(c) + 1) * F.lit(size) - F.col(place) + slack
            far += F.pow(F.greatest(-low, high), F.lit(2.0))
            near += F.pow(F.greatest(low, -high, F.lit(0.0)), F.lit(2.0))
        known = edge.where(near <= radius * radius * (1 + 1e-9)).withColumn("_in", far <= radius * radius * (1 - 1e-9))
        held = places.groupBy(at("_px", size).alias("_cx"), at("_py", size).alias("_cy")).agg(*state)
        found.append(known.where("_in").hint("merge").join(held, ["_cx", "_cy"]).select(zid, "n", "s", "low", "high"))
        edge = known.where("not _in").drop("_in")
        if level < depth:
            edge = edge.withColumn("_cx", F.explode(F.array(F.col("_cx") * 2, F.col("_cx") * 2 + 1)))
            edge = edge.withColumn("_cy", F.explode(F.array(F.col("_cy") * 2, F.col("_cy") * 2 + 1)))
    single = places.withColumns({"_cx": at("_px", size), "_cy": at("_py", size)})
    single = edge.hint("merge").join(single, ["_cx", "_cy"]).where(geo.squared_distance("_px", "_py", "_x", "_y") <= radius * radius)
    found.append(single.select(zid, "n", "s", "low", "high"))
    sums = reduce(DataFrame.unionByName, found).groupBy(zid).agg(*state)
    stats = sums.select(zid, "n", F.try_divide("s", "n").alias("mean"), "low", "high")
    return zones.select(zid).join(stats, zid, "left").na.fill(0, ["n"])


def sample_points(points: DataFrame, x: str, y: str, raster: DataFrame, size: float) -> DataFrame:
    """Raster columns at each point: the point's cell number is computed, then joined."""
    cell = {"col": F.floor(F.col(x) / size), "row": F.floor(F.col(y) / size)}
    return points.withColumns(cell).join(raster, ["col", "row"], "left")


#: Lines and columns of a tile of ``common_grid``.
TILE = (64, 4096)


def common_grid(rasters: Sequence[tuple[DataFrame, float]], size: float) -> DataFrame:
    """Cells of ``size`` over the intersection of the rasters' extents; each raster is (cells with col and row, its size)."""
    ends = None
    for r, s in rasters:
        e = r.agg(
            (F.min("col") * F.lit(s)).alias("x0"), ((F.max("col") + 1) * F.lit(s)).alias("x1"),
            (F.min("row") * F.lit(s)).alias("y0"), ((F.max("row") + 1) * F.lit(s)).alias("y1"),
        )
        ends = e if ends is None else ends.unionByName(e)
    box = ends.agg(F.max("x0").alias("x0"), F.min("x1").alias("x1"), F.max("y0").alias("y0"), F.min("y1").alias("y1"))
    first, last = lambda c: F.ceil(F.col(c) / size), lambda c: F.floor(F.col(c) / size) - 1
    box = box.select(first("x0").alias("_c0"), last("x1").alias("_c1"), first("y0").alias("_r0"), last("y1").alias("_r1"))
    tiles = box.where("_c0 <= _c1 AND _r0 <= _r1")
    # Tiles are dealt out to all tasks before their cells are made: the engine would merge these few bytes into one task.
    for at, least, most, side in (("_r", "_r0", "_r1", TILE[0]), ("_c", "_c0", "_c1", TILE[1])):
        tiles = tiles.withColumn(at, F.explode(F.sequence(least, most, F.lit(side).cast("bigint"))))
    inside = lambda at, most, side: F.explode(F.sequence(at, F.least(F.col(at) + (side - 1), most)))
    rows = spread(tiles, "_r", "_c").withColumn("row", inside("_r", "_r1", TILE[0]))
    return rows.select(inside("_c", "_c1", TILE[1]).alias("col"), "row")


def align_nearest(grid: DataFrame, size: float, raster: DataFrame, raster_size: float, value: str, name: str) -> DataFrame:
    """Value of the raster cell under the centre of each grid cell."""
    at = lambda c: F.floor((F.col(c) + 0.5) * size / raster_size)
    r = raster.select(F.col("col").alias("_c"), F.col("row").alias("_r"), F.col(value).alias(name))
    return grid.withColumns({"_c": at("col"), "_r": at("row")}).join(r, ["_c", "_r"], "left").drop("_c", "_r")


def align_bilinear(grid: DataFrame, size: float, raster: DataFrame, raster_size: float, value: str, name: str) -> DataFrame:
    """Weighted mean of the four raster cells around the centre of each grid cell; weights of missing cells are left out.

    Four neighbouring raster cells are brought together in one row first. The grid meets these rows once, with one row for
    each of its cells. A finer raster is copied only to the rows that some grid cell needs.
    """
    at = lambda c: (c + 0.5) * size / raster_size - 0.5
    corners = [(dx, dy) for dx in (0, 1) for dy in (0, 1)]

    def needed(c: str) -> Column:
        """Whether the centre of a whole-numbered grid cell lies between the centres of raster cells c and c + 1."""
        near = F.ceil((F.col(c) + 0.5) * raster_size / size - 0.5)
        return reduce(Column.__or__, [F.floor(at(near + d)) == F.col(c) for d in (-1, 0, 1)])

    r = raster.select(F.col("col").alias("_c"), F.col("row").alias("_r"), F.col(value).cast("double").alias("_v")).where("_v is not null")
    copies = [F.struct((F.col("_c") - dx).alias("_c"), (F.col("_r") - dy).alias("_r"), F.lit(k).alias("_k"), "_v") for k, (dx, dy) in enumerate(corners)]
    r = r.select(F.inline(F.array(*copies)))
    if raster_size < size:
        r = r.where(needed("_c") & needed("_r"))
    own = [F.when(F.col("_k") == k, F.col("_v")) for k in range(4)]
    four = r.groupBy("_c", "_r").agg(*[F.sum(v).alias(f"_s{k}") for k, v in enumerate(own)], *[F.count(v).alias(f"_n{k}") for k, v in enumerate(own)])
    met = grid.withColumns({"_c": F.floor(at(F.col("col"))), "_r": F.floor(at(F.col("row")))}).join(four, ["_c", "_r"], "left")
    fx, fy = at(F.col("col")) - F.col("_c"), at(F.col("row")) - F.col("_r")
    top, weights = F.lit(0.0), F.lit(0.0)
    for k, (dx, dy) in enumerate(corners):
        w = (fx if dx else 1 - fx) * (fy if dy else 1 - fy)
        used = (w > 0) & (F.col(f"_n{k}") > 0)
        top, weights = top + F.when(used, w * F.col(f"_s{k}")).otherwise(0.0), weights + F.when(used, w * F.col(f"_n{k}")).otherwise(0.0)
    others = [c for c in grid.columns if c not in ("col", "row")]
    return met.select("col", "row", *others, F.when(weights > 0, top / weights).alias(name))


def nodata_mask(raster: DataFrame, bands: dict[str, float]) -> DataFrame:
    """No-data values to null; only cells valid in all bands stay."""
    return raster.withColumns({b: F.nullif(F.col(b), F.lit(v)) for b, v in bands.items()}).na.drop(subset=list(bands))


def clip_to_polygons(cells: DataFrame, x: str, y: str, polygons: DataFrame, ring: str, cell: float) -> DataFrame:
    """Cells inside any polygon, once each."""
    cols = cells.columns
    return points_in_polygons(cells, polygons.select(ring), x, y, ring, cell).select(*cols).distinct()


def stack_bands(bands: DataFrame, names: Sequence[str]) -> DataFrame:
    """(band, col, row, value) to one row per cell with a column per band."""
    return bands.groupBy("col", "row").pivot("band", list(names)).agg(F.first("value"))


def scale_to_reference(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Value ÷ largest value of its key."""
    return attach(df, keys, df.groupBy(*keys).agg(F.max(value).alias("_m"))).withColumn("scaled", F.col(value) / F.col("_m")).drop("_m")
