"""Interval, nearest, radius, polygon and name joins.

None of them is a cross join: ranges meet in time buckets, points in grid cells, names in shared letter triples. Sides
are not hinted; the engine broadcasts a side only when its measured size is under the session's limit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from gridstrata.functions import geo
from gridstrata.operators.resample import spread
from gridstrata.session import checkpoint


def around(cell: Column) -> Column:
    """The cell and its two neighbours, one row each."""
    return F.explode(F.sequence(cell - 1, cell + 1))


def _length_class(start: Column, stop: Column, width: int) -> Column:
    """0 for intervals up to ``width`` seconds, then one more for each doubling."""
    long = (F.unix_timestamp(stop) - F.unix_timestamp(start)) / F.lit(float(width))
    return F.when(long > 1, F.ceil(F.log2(long)).cast("int")).otherwise(0)


def _bin(stamp: Column, level: Column, width: int) -> Column:
    return F.floor(F.unix_timestamp(stamp) / (F.lit(width) * F.pow(F.lit(2.0), level)))


def range_join(
    intervals: DataFrame, points: DataFrame, keys: Sequence[str], start: str, stop: str, ts: str, width: int, how: str = "inner"
) -> DataFrame:
    """Points inside ``[start, stop]`` of the intervals with the same keys.

    Bins of time come in levels, each twice as long as the one before it, from ``width`` seconds. An interval lies on the
    first level whose bins are no shorter than itself, so in one bin or two however long it is; a point looks in its bin
    of every level that has intervals. Each pair is found once, and a hot key is spread over its bins. Intervals or
    points with a null end, stamp or key meet nothing. ``left`` keeps intervals without points: there the points are in
    their bin and in the one before it, so that an interval looks in its first bin alone and one outer join does it.
    """
    first, last = F.col(start), F.col(stop)
    level = _length_class(first, last, width)
    used = intervals.where(last >= first).agg(F.bit_or(F.pow(F.lit(2.0), level).cast("bigint")).alias("levels"))
    levels = used.select(F.filter(F.sequence(F.lit(0), F.lit(40)), lambda i: F.getbit("levels", i) == 1).alias("levels")).scalar()
    placed = intervals.withColumn("_level", level)
    right = points.withColumn("_level", F.explode(levels))
    right = right.withColumn("_bin", _bin(F.col(ts), F.col("_level"), width))
    if how == "left":
        near = right.withColumn("_bin", F.explode(F.array(F.col("_bin") - 1, F.col("_bin"))))
        near = near.withColumnsRenamed({c: f"_k_{c}" for c in (*keys, "_level", "_bin")})
        left = placed.withColumn("_bin", _bin(first, F.col("_level"), width))
        same = F.col(ts).between(first, last)
        for c in (*keys, "_level", "_bin"):
            same &= F.col(c) == F.col(f"_k_{c}")
        return left.join(near, same, "left").drop("_level", "_bin", *[f"_k_{c}" for c in (*keys, "_level", "_bin")])
    placed = placed.withColumns({"_first": _bin(first, F.col("_level"), width), "_last": _bin(last, F.col("_level"), width)})
    left = placed.where(last >= first).withColumn("_bin", F.explode(F.array_distinct(F.array("_first", "_last")))).drop("_first", "_last")
    return left.join(right, [*keys, "_level", "_bin"]).where(F.col(ts).between(first, last)).drop("_level", "_bin")


def storm_causes(
    storms: DataFrame, outages: DataFrame, county: str, begin: str, end: str, start: str, days_after: int = 1
) -> DataFrame:
    """Storms with the outages they caused: start inside the storm or up to ``days_after`` days behind its end.

    Storms without such an outage stay, with flag 0.
    """
    reach = storms.withColumn("_stop", F.timestamp_add("DAY", F.lit(days_after), F.col(end)))
    found = range_join(reach, outages, [county], begin, "_stop", start, width=86400, how="left").drop("_stop")
    return found.withColumn("caused", F.col(start).isNotNull().cast("int"))


def hours_inside(df: DataFrame, begin: str, end: str, name: str = "hour") -> DataFrame:
    """One row per event and hour from the floor of its begin to the ceiling of its end."""
    top = F.date_trunc("hour", end)
    ceil = F.when(top == F.col(end), top).otherwise(F.timestamp_add("HOUR", F.lit(1), top))
    return df.withColumn(name, F.explode(F.sequence(F.date_trunc("hour", begin), ceil, F.expr("INTERVAL 1 HOUR"))))


#: Places of sites in a cell of the first level of ``nearest``, at most.
CELL_SITES = 16


def nearest(points: DataFrame, pid: str, sites: DataFrame, sid: str, x: str, y: str, cell: float, growth: int = 4) -> DataFrame:
    """Nearest site of each point (the smallest id of several), with the squared distance.

    Level by level: sites are copied to the 3×3 cells around them, a point looks in its own cell and is settled when
    its best site is closer than the cell size. The rest goes on with larger cells, so dense areas are settled where
    cells are small. Each level is cut off by a checkpoint; cells grow until they span the extent of points and sites,
    so that at the latest the last level settles every point with a place. Without sites there are no rows.

    ``cell`` is the first size, or ever smaller ones until no cell holds more than ``CELL_SITES`` places of sites, so the
    sites a point looks at stay as many when the sites grow in number. Of several sites in one place only the smallest id is used.
    """
    place = lambda df, *cols: df.agg(*[f(c) for c in cols for f in (F.min, F.max)]).first()
    ends = [v for v in (*place(points, x, y), *place(sites, x, y)) if v is not None]
    span = max(ends, default=0) - min(ends, default=0)
    rest, settled, level, last = spread(points, pid), [], 0, False
    s = sites.groupBy(F.col(x).alias("_sx"), F.col(y).alias("_sy")).agg(F.min(sid).alias(sid))
    finest = span * 2.0**-30
    while cell > finest:
        busy = s.groupBy(F.floor(F.col("_sx") / cell), F.floor(F.col("_sy") / cell)).count().agg(F.max("count")).first()[0]
        if (busy or 0) <= CELL_SITES:
            break
        cell /= growth
    while not last:
        size = cell * growth**level
        last, level = size > span, level + 1  # such a cell and its neighbours hold every site
        near = s.withColumn("_cx", around(F.floor(F.col("_sx") / size)))
        near = near.withColumn("_cy", around(F.floor(F.col("_sy") / size)))
        here = rest.withColumns({"_cx": F.floor(F.col(x) / size), "_cy": F.floor(F.col(y) / size)})
        d2 = geo.squared_distance(x, y, "_sx", "_sy")
        best = here.join(near, ["_cx", "_cy"]).groupBy(pid).agg(F.min(F.struct(d2.alias("d2"), sid)).alias("_b"))
        if not last:
            best = best.where(F.col("_b.d2") <= size * size)
        best = checkpoint(best)
        settled.append(best)
        rest = checkpoint(rest.join(best, pid, "left_anti"))
        if rest.isEmpty():
            break
    found = settled[0]
    for b in settled[1:]:
        found = found.unionByName(b)
    return points.join(found, pid).select(*points.columns, F.col(f"_b.{sid}").alias(sid), F.col("_b.d2").alias("d2"))


#: Rows of the first table in a cell that one task compares with the rows around them, about.
CELL_ROWS = 4096


def _deal(left: DataFrame, right: DataFrame, on: Sequence[str], cells: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of both tables with the ``_part`` of a cell where they meet; those of the second go to the cells around too.

    Cells with more than ``CELL_ROWS`` rows of the first table are cut in parts, and what lies around them goes to each part.
    """
    parts = left.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).alias("_parts"))
    for c in cells:
        right = right.withColumn(c, around(F.col(c)))
    right = right.join(parts, on).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1))).drop("_parts")
    return left.join(parts, on).withColumn("_part", F.pmod(F.xxhash64(*left.columns), "_parts")).drop("_parts"), right


def _meet(left: DataFrame, right: DataFrame, keys: Sequence[str], cells: Sequence[str]) -> DataFrame:
    """Rows of both tables whose keys agree and whose cells are the same or touch, without the cells.

    Pairs outgrow the rows by far, so they are made where the cells are dealt out to: in all shuffle tasks and never by a
    broadcast, which would make them in the few tasks that read the first table.
    """
    on, tasks = [*keys, *cells], int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, right = _deal(left, right, on, cells)
    rows = rows.repartition(tasks, *on, "_part")
    return rows.hint("merge").join(right, [*on, "_part"]).drop(*cells, "_part")


def within_km(
    a: DataFrame, b: DataFrame, lat: str, lon: str, km: float, suffix: str = "_2", keys: Sequence[str] = (),
    facts: DataFrame | None = None, on: str = "", by: str = "", total: str = "",
) -> DataFrame:
    """Pairs of rows of two point tables closer than ``km`` on the sphere; the second one's columns get the suffix.

    Rows also have to agree on ``keys``, which keep their names.

    With ``facts`` the pairs are joined to the facts of the second row and added up where they are made, so that no pair
    leaves its task: for each row of ``a`` and value of ``by`` the number ``n`` of facts with the same ``on`` as a row of
    ``b`` in reach, and the sum of their ``total`` as double, nulls left out. Rows without such facts are not in the
    result. ``by`` is to have few values, like months: a task holds a number for each of them and ``CELL_ROWS`` rows.
    """
    chord = geo.chord_of_km(km)
    left = a.withColumns(geo.sphere_cells(lat, lon, chord))
    if facts is not None:
        return _totals_in_reach(left, a.columns, b.withColumns(geo.sphere_cells(lat, lon, chord)), lat, lon, km, keys, facts, on, by, total)
    right = b.withColumnsRenamed({c: c + suffix for c in b.columns if c not in keys}).withColumns(
        geo.sphere_cells(lat + suffix, lon + suffix, chord)
    )
    pairs = _meet(left, right, keys, ("cx", "cy", "cz")).withColumn("km", geo.haversine_km(lat, lon, lat + suffix, lon + suffix))
    return pairs.where(F.col("km") <= km)


#: Rows of the second table that are compared at once with those of a part.
_AT_ONCE = 256


class _Part:
    """Rows of the first table in one part and, by the values of ``by``, what the rows around them brought so far."""

    def __init__(self, km: float, labels: list):
        self.km, self.labels, self.rows, self.lat, self.lon = km, labels, [], [], []
        self.sums = None

    def first(self, batch: pa.RecordBatch) -> None:
        self.rows.append(batch.column("_row"))
        self.lat.append(batch.column("_lat").to_numpy(zero_copy_only=False))
        self.lon.append(batch.column("_lon").to_numpy(zero_copy_only=False))

    def around(self, batch: pa.RecordBatch, codes: dict) -> None:
        if not self.rows:  # no row of its cell fell to this part
            return
        if self.sums is None:
            self.lat, self.lon = np.concatenate(self.lat), np.concatenate(self.lon)
            self.sums = np.zeros((2, len(self.lat), 0))
        for at in range(0, batch.num_rows, _AT_ONCE):
            own = batch.slice(at, _AT_ONCE)
            lat, lon = (own.column(c).to_numpy(zero_copy_only=False) for c in ("_lat", "_lon"))
            near = geo.within_km(self.lat, self.lon, lat, lon, self.km)
            met = near.any(axis=0)
            if not met.any():
                continue
            fact = np.repeat(np.arange(len(lat)), own.column("_by").value_lengths().to_numpy())
            by = own.column("_by").flatten().dictionary_encode(null_encoding="encode")
            new = [codes.setdefault(v, len(codes)) for v in by.dictionary.to_pylist()]
            self.labels.extend(list(codes)[len(self.labels) :])
            total = own.column("_total").flatten().cast(pa.float64(), safe=False).fill_null(0).to_numpy()
            self._add(near, met, fact, by.indices.to_numpy(), np.array(new), total)

    def _add(self, near: np.ndarray, met: np.ndarray, fact: np.ndarray, by: np.ndarray, codes: np.ndarray, total: np.ndarray) -> None:
        """Add facts ``total``, each of the row ``fact`` and the value ``codes[by]``, to the rows that are near."""
        if len(self.labels) > self.sums.shape[2]:
            self.sums = np.pad(self.sums, ((0, 0), (0, 0), (0, len(self.labels) - self.sums.shape[2])))
        size, fine, place = (len(met), len(codes)), np.isfinite(total), fact * len(codes) + by
        reach = near[:, met].astype(float)
        for sums, weights in zip(self.sums, (None, np.where(fine, total, 0.0))):
            brought = np.bincount(place, weights, size[0] * size[1]).reshape(size)[met].astype(float)
            sums[:, codes] += reach @ brought
        for f in np.flatnonzero(~fine):  # no product with zero is to make these NaN where they are out of reach
            self.sums[1, near[:, fact[f]], codes[by[f]]] += total[f]

    def out(self, names: Sequence[str], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        if self.sums is None:
            return
        rows, labels = pa.concat_arrays(self.rows), pa.array(self.labels, kind)
        for at in range(0, len(rows), 256):
            row, label = np.nonzero(self.sums[0, at : at + 256])
            n, total = self.sums[:, at + row, label]
            columns = [*rows.take(pa.array(at + row)).flatten(), labels.take(pa.array(label)), pa.array(n.astype(np.int64)), pa.array(total)]
            yield pa.RecordBatch.from_arrays(columns, names)


def _count_parts(km: float, names: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, name, labels, codes = None, None, [], {}
        for batch in batches:
            kind = batch.schema.field("_by").type.value_type
            groups = batch.column("_group").dictionary_encode()
            key = 2 * groups.indices.to_numpy().astype(np.int64) + batch.column("_around").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for lo, hi in zip(edges, edges[1:]):
                own = batch.slice(lo, hi - lo)
                if (here := own.column("_group")[0].as_py()) != name:
                    if part:
                        yield from part.out(names, kind)
                    part, name = _Part(km, labels), here
                if key[lo] % 2:
                    part.around(own, codes)
                else:
                    part.first(own)
        if part:
            yield from part.out(names, kind)

    return run


def _totals_in_reach(
    left: DataFrame, names: Sequence[str], right: DataFrame, lat: str, lon: str, km: float, keys: Sequence[str], facts: DataFrame, on: str, by: str, total: str
) -> DataFrame:
    """``within_km`` with facts: in each task the rows of a part come first, then the rows around it with their facts."""
    meet = [*keys, "cx", "cy", "cz"]
    rows, near = _deal(left, right.select(*dict.fromkeys([on, lat, lon, *meet])), meet, ("cx", "cy", "cz"))
    lists = facts.groupBy(on).agg(F.collect_list(F.struct(F.col(by).alias("by"), F.col(total).alias("total"))).alias("_f"))
    near = near.join(lists.select(on, F.col("_f.by").alias("_by"), F.col("_f.total").alias("_total")), on)
    place = [F.to_json(F.struct(*meet, "_part")).alias("_group"), F.col(lat).cast("double").alias("_lat"), F.col(lon).cast("double").alias("_lon")]
    first = rows.select(*place, F.lit(0).alias("_around"), F.struct(*names).alias("_row"))
    both = first.unionByName(near.select(*place, F.lit(1).alias("_around"), "_by", "_total"), allowMissingColumns=True)
    schema = StructType([*left.select(*names).schema, facts.select(by).schema[0], StructField("n", LongType()), StructField("total", DoubleType())])
    return spread(both, "_group").sortWithinPartitions("_group", "_around").mapInArrow(_count_parts(km, schema.names), schema)


def within_distance(
    a: DataFrame, b: DataFrame, x: str, y: str, radius: float, suffix: str = "_2", keys: Sequence[str] = ()
) -> DataFrame:
    """Pairs closer than the radius in the plane, by grid cells of the radius."""
    left = a.withColumns({"_cx": F.floor(F.col(x) / radius), "_cy": F.floor(F.col(y) / radius)})
    right = b.withColumnsRenamed({c: c + suffix for c in b.columns if c not in keys}).withColumns(
        {"_cx": F.floor(F.col(x + suffix) / radius), "_cy": F.floor(F.col(y + suffix) / radius)}
    )
    pairs = _meet(left, right, keys, ("_cx", "_cy")).withColumn("d2", geo.squared_distance(x, y, x + suffix, y + suffix))
    return pairs.where(F.col("d2") <= radius * radius)


def inside_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule over the edges of a closed ring of ``(x, y)`` structs: crossings of the ray to the right."""

    def crosses(a: Column, b: Column) -> Column:
        spans = (a["y"] > y) != (b["y"] > y)
        at = (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]
        return F.when(spans, (x < at).cast("int")).otherwise(0)

    shifted = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))
    hits = F.zip_with(ring, shifted, crosses)
    return F.aggregate(hits, F.lit(0), lambda acc, h: acc + h) % 2 == 1


def points_in_polygons(points: DataFrame, polygons: DataFrame, x: str, y: str, ring: str, cell: float) -> DataFrame:
    """Points with the polygons that hold them; polygons are copied to the grid cells of their bounding boxes."""

    def cells(c: str, pick: str) -> Column:
        values = F.transform(ring, lambda v: v[pick])
        return F.sequence(F.floor(F.array_min(values) / cell), F.floor(F.array_max(values) / cell))

    boxes = polygons.withColumn("_cx", F.explode(cells("_cx", "x"))).withColumn("_cy", F.explode(cells("_cy", "y")))
    here = points.withColumns({"_cx": F.floor(F.col(x) / cell), "_cy": F.floor(F.col(y) / cell)})
    joined = here.join(boxes, ["_cx", "_cy"]).drop("_cx", "_cy")
    return joined.where(inside_ring(F.col(x), F.col(y), F.col(ring)))


def similarity(a: str | Column, b: str | Column) -> Column:
    """1 − edit distance ÷ longer length."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(1.0)


def _grams(name: str, size: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(name) - size + 1, F.lit(1)))
    return F.transform(starts, lambda i: F.substring(F.col(name), i, F.lit(size)))


def _triples(name: str, short: bool) -> Column:
    """Runs of three letters; a name of one or two letters is its own run, and with ``short`` such runs of longer names too."""
    runs = F.concat(*[_grams(name, k) for k in (1, 2, 3)]) if short else F.when(F.length(name) < 3, F.array(name)).otherwise(_grams(name, 3))
    return F.array_distinct(runs)


def match_names(names: DataFrame, known: DataFrame, block: str, name: str, limit: float = 0.8) -> DataFrame:
    """Best known name of the block for each distinct name: contained in one another, or more alike than the limit.

    Names that alike, or one containing the other, share three letters in a row when they have at least three. A name of
    one or two letters is held by any name with that run, so such names meet the one- and two-letter runs of the others.
    """
    a = names.select(block, F.lower(name).alias("_a")).distinct()
    k = known.select(block, F.lower(name).alias("_k")).distinct()
    run = lambda df, c, short: df.withColumn("_t", F.explode(_triples(c, short)))
    long = run(a, "_a", False).join(run(k, "_k", False), [block, "_t"])
    brief = run(a.where(F.length("_a") < 3), "_a", False).join(run(k, "_k", True), [block, "_t"])
    held = run(a, "_a", True).join(run(k.where(F.length("_k") < 3), "_k", False), [block, "_t"])
    pairs = long.select(block, "_a", "_k").unionByName(brief.select(block, "_a", "_k")).unionByName(held.select(block, "_a", "_k")).distinct()
    pairs = pairs.withColumn("ratio", similarity("_a", "_k"))
    held = F.col("_a").contains(F.col("_k")) | F.col("_k").contains(F.col("_a"))
    best = pairs.where(held | (F.col("ratio") > limit)).groupBy(block, "_a").agg(
        F.min(F.struct((-F.col("ratio")).alias("r"), F.col("_k"))).alias("_b")
    )
    out = names.withColumn("_a", F.lower(name)).join(best, [block, "_a"], "left")
    return out.select(*names.columns, F.coalesce("_b._k", "_a").alias("matched"), (-F.col("_b.r")).alias("ratio"))
