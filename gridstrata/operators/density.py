"""Density clusters over grid cells: the work grows with the number of places, not with the square of their density."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstrata.operators.graph import connected_components
from gridstrata.session import checkpoint

#: Cells are this much smaller than the square whose diagonal is the reach, against rounding of cell numbers.
MARGIN = 1e-6
#: Halvings of a cell before single places are compared.
DEPTH = 24


def _square(a: Column, b: Column) -> Column:
    return a * a + b * b


def placed_in_cells(df: DataFrame, keys: Sequence[str], pid: str, x: str, y: str, eps: float, min_samples: int) -> DataFrame:
    """One row per key and place: its rows ``n``, smallest id ``p``, cell, and of the cell the smallest id and whether it is crowded.

    Two places of a cell are always within ``eps``, so all places of a cell with ``min_samples`` rows are cores.
    """
    side = eps / math.sqrt(2) * (1 - MARGIN)
    known = F.lit(True)
    for c in keys:
        known &= F.col(c).isNotNull()
    for c in (x, y):
        known &= F.abs(F.col(c).cast("double")) < math.inf
    rows = df.where(known).select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(pid).alias("p"))
    kept = [f"k{i}" for i in range(len(keys))]
    places = rows.groupBy(*kept, "x", "y").agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("p"))
    places = checkpoint(places.withColumns({"cx": F.floor(F.col("x") / side), "cy": F.floor(F.col("y") / side)}))
    cells = places.groupBy(*kept, "cx", "cy").agg(F.min("p").alias("node"), (F.sum("n") >= min_samples).alias("crowded"))
    return checkpoint(places.join(cells, [*kept, "cx", "cy"]))


def candidates(placed: DataFrame, keys: int) -> DataFrame:
    """Pairs that are compared: each place ``a`` of a cell that is not crowded with all places of the 25 cells around it.

    Such cells have fewer than ``min_samples`` places, so a place is in at most 25 times as many pairs, however dense
    the others are.
    """
    kept = [f"k{i}" for i in range(keys)]
    step = lambda: F.explode(F.sequence(F.lit(-2), F.lit(2)))
    probe = placed.where("not crowded").withColumn("dx", step()).withColumn("dy", step())
    probe = probe.select(*kept, (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"), F.col("p").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    return probe.join(placed, [*kept, "cx", "cy"])


def _boxes(crowded: DataFrame, side: float, level: int, above: int, nodes: DataFrame | None = None) -> DataFrame:
    """Boxes around the places of each cell cut ``level`` times in halves, with their numbers and those of ``above`` halvings.

    Halving scales by powers of two, which is exact, so the numbers of one level are those of the next shifted.
    """
    rows = crowded if nodes is None else crowded.join(nodes, "node", "left_semi")
    number = lambda c, l: F.floor(F.col(c) / side * 2.0**l)
    parent = {"px": number("x", above), "py": number("y", above)}
    own = {"ix": number("x", level), "iy": number("y", level)} if level <= DEPTH else {"ix": F.col("x"), "iy": F.col("y")}
    out = rows.withColumns({**parent, **own}).groupBy("node", "px", "py", "ix", "iy")
    return out.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


def _measured(pairs: DataFrame, eps: float) -> DataFrame:
    """The pairs of boxes that may hold places within reach, and whether all their places are."""
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"b{c}0") - F.col(f"a{c}1"), F.col(f"a{c}0") - F.col(f"b{c}1"))
    span = lambda c: F.greatest(F.col(f"b{c}1") - F.col(f"a{c}0"), F.col(f"a{c}1") - F.col(f"b{c}0"))
    out = pairs.where(_square(gap("x"), gap("y")) <= eps * eps)
    return out.withColumn("all", _square(span("x"), span("y")) <= eps * eps)


def _sided(boxes: DataFrame, s: str) -> DataFrame:
    names = {"node": s, "px": f"{s}px", "py": f"{s}py", "ix": f"{s}ix", "iy": f"{s}iy", "x0": f"{s}x0", "x1": f"{s}x1", "y0": f"{s}y0", "y1": f"{s}y1"}
    return boxes.withColumnsRenamed(names)


def crowded_links(placed: DataFrame, keys: int, eps: float) -> DataFrame:
    """Pairs (u, v) of neighbouring crowded cells that have two places within reach.

    Boxes around their places are compared: boxes out of reach go, boxes wholly in reach link their cells, the others
    are halved again. A pair of cells leaves the search with its first link. Rounding keeps the order of distances, so that
    box distances never contradict the distance of two places.
    """
    side = eps / math.sqrt(2) * (1 - MARGIN)
    kept = [f"k{i}" for i in range(keys)]
    crowded = placed.where("crowded")
    names = crowded.groupBy("node").agg(*[F.first(k).alias(k) for k in kept], F.first("cx").alias("cx"), F.first("cy").alias("cy"))
    cells = checkpoint(_boxes(crowded, side, 0, 0).join(names, "node"))
    ahead = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in range(3) for j in range(-2, 3) if (i, j) > (0, 0)])
    left = _sided(cells, "a").withColumn("o", F.explode(ahead)).withColumns({"cx": F.col("cx") + F.col("o.dx"), "cy": F.col("cy") + F.col("o.dy")})
    pairs = left.drop("o").join(_sided(cells, "b"), [*kept, "cx", "cy"])
    links, level = None, 0
    while True:
        pairs = checkpoint(_measured(pairs, eps))
        found = pairs.where("all").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()
        links = found if links is None else links.unionByName(found)
        still = pairs.where("not all").join(found.select(F.col("u").alias("a"), F.col("v").alias("b")), ["a", "b"], "left_anti")
        still = still.select("a", "b", "aix", "aiy", "bix", "biy")
        if still.isEmpty():
            return links
        nodes = still.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        finer = checkpoint(_boxes(crowded, side, level + 2, level, nodes))
        level += 2
        above = still.withColumnsRenamed({"aix": "apx", "aiy": "apy", "bix": "bpx", "biy": "bpy"})
        pairs = above.join(_sided(finer, "a"), ["a", "apx", "apy"]).join(_sided(finer, "b"), ["b", "bpx", "bpy"])


def density_clusters(df: DataFrame, keys: Sequence[str], pid: str, x: str, y: str, eps: float, min_samples: int) -> DataFrame:
    """Density clusters per key: places with ``min_samples`` rows within ``eps`` are cores; cores within reach join.

    A cluster is named by the smallest id of its cores' places, border places take the smallest cluster in reach, the
    rest is noise (−1). Rows at one place are one weighted place. Rows with a null key or without a finite place are noise.
    Coordinates are to stay below 2^30 times ``eps``. Ids are unique over all keys.

    A cell with enough rows is all core without any pair and one node of the graph; only places of the other cells
    are compared one by one, and pairs of crowded cells by boxes.
    """
    kept = [f"k{i}" for i in range(len(keys))]
    placed = placed_in_cells(df, keys, pid, x, y, eps, min_samples)
    close = candidates(placed, len(keys)).where(_square(F.col("ax") - F.col("x"), F.col("ay") - F.col("y")) <= eps * eps)
    stands = F.when(F.col("crowded"), F.col("node")).otherwise(F.col("p"))
    reach = checkpoint(close.groupBy("a", stands.alias("b"), "crowded").agg(F.sum("n").alias("n")))
    single = checkpoint(reach.groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= min_samples).select("a"))
    nodes = checkpoint(single.select(F.col("a").alias("node")).unionByName(placed.where("crowded").select("node").distinct()))
    toward = checkpoint(reach.join(nodes.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b"))
    links = toward.join(single, "a", "left_semi").select(F.col("a").alias("u"), F.col("b").alias("v"))
    roots = connected_components(links.unionByName(crowded_links(placed, len(keys), eps)))
    labels = checkpoint(nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("cluster")))
    near = toward.join(labels.select(F.col("node").alias("b"), "cluster"), "b").groupBy(F.col("a").alias("stands")).agg(F.min("cluster").alias("near"))
    own = labels.select(F.col("node").alias("stands"), F.col("cluster").alias("own"))
    found = placed.withColumn("stands", stands).join(own, "stands", "left").join(near, "stands", "left")
    found = found.select(
        *[F.col(k).alias(f"_{k}") for k in kept], F.col("x").alias("_x"), F.col("y").alias("_y"),
        F.coalesce("own", "near").alias("_cluster"), F.col("own").isNotNull().alias("_core"),
    )
    same = (F.col(x).cast("double") == F.col("_x")) & (F.col(y).cast("double") == F.col("_y"))
    for i, k in enumerate(keys):
        same &= F.col(k) == F.col(f"_k{i}")
    out = df.join(found, same, "left")
    return out.select(*df.columns, F.coalesce("_cluster", F.lit(-1)).alias("cluster"), F.coalesce("_core", F.lit(False)).cast("int").alias("core"))
