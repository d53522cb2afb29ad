"""Neighbour degrees, neighbour sums, connected components and merged vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstrata.session import checkpoint


def k_hop(edges: DataFrame, degrees: int = 4) -> DataFrame:
    """Rows (src, dst, degree) of 1st- to 4th-degree neighbours; nearer degrees and the node itself are left out.

    ``edges`` has src, dst and near (far links enter one degree later). Each degree is distinct pairs, cut off by a
    checkpoint since the next two degrees read it.
    """
    near = edges.where("near").select("src", "dst").distinct()
    far = edges.where("not near").select("src", "dst").distinct()
    step = lambda a, b: a.join(b.select(F.col("src").alias("dst"), F.col("dst").alias("_n")), "dst").select("src", F.col("_n").alias("dst"))
    levels = [checkpoint(near)]
    for d in range(2, degrees + 1):
        reached = step(levels[-1], near).unionByName(far if d == 2 else step(levels[-2], far))
        fresh = reached.where(F.col("src") != F.col("dst")).distinct()
        for seen in levels:
            fresh = fresh.join(seen, ["src", "dst"], "left_anti")
        levels.append(checkpoint(fresh))
    out = None
    for d, pairs in enumerate(levels, 1):
        one = pairs.withColumn("degree", F.lit(d))
        out = one if out is None else out.unionByName(one)
    return out


def neighbour_sums(facts: DataFrame, pairs: DataFrame, node: str, ts: str, value: str, degrees: Sequence[int]) -> DataFrame:
    """Sum of the neighbours' values per node and stamp, one column per degree and one for all with the node itself."""
    near = facts.join(pairs.select(F.col("dst").alias(node), "src", "degree"), node).select(F.col("src").alias(node), ts, value, "degree")
    own = facts.select(node, ts, value, F.lit(0).alias("degree"))
    rows = own.unionByName(near)
    cols = [F.sum(F.when(F.col("degree") == d, F.col(value))).alias(f"{value}_degree_{d}") for d in degrees]
    return rows.groupBy(node, ts).agg(*cols, F.sum(value).alias(f"{value}_all"))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Node → smallest node of its component, for all nodes with an edge (u, v).

    Alternates linking the larger neighbours and the smaller neighbours of each node to the smallest one, which takes
    about log² rounds however long the chains are. Every round is checkpointed; minima are combined before the shuffle.
    """
    e = checkpoint(edges.where("u <> v").select("u", "v").distinct())
    mark = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        linked = down.join(low, "u")
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(linked.select("u", F.col("m").alias("v")))
        e = checkpoint(small.where("u <> v").distinct())
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def merge_similar(df: DataFrame, key: str, pid: str, tolerances: dict[str, float], size: str, area: Column) -> DataFrame:
    """Vectors of one key that agree within all tolerances are one; the largest of each chain of such vectors stays.

    The first two tolerances make the grid cells in which vectors meet.
    """
    cells = list(tolerances.items())[:2]
    grid = {f"_g{i}": F.floor(F.col(c) / t) for i, (c, t) in enumerate(cells)}
    left = df.select(key, pid, *tolerances).withColumns(grid)
    right = df.select(key, F.col(pid).alias("_q"), *[F.col(c).alias(f"_{c}") for c in tolerances])
    for i, (c, t) in enumerate(cells):
        right = right.withColumn(f"_g{i}", F.explode(F.sequence(F.floor(F.col(f"_{c}") / t) - 1, F.floor(F.col(f"_{c}") / t) + 1)))
    pairs = left.join(right, [key, *grid]).where(F.col(pid) < F.col("_q"))
    for c, t in tolerances.items():
        pairs = pairs.where(F.abs(F.col(c) - F.col(f"_{c}")) <= t)
    roots = connected_components(pairs.select(F.col(pid).alias("u"), F.col("_q").alias("v")))
    joined = df.join(roots.withColumnRenamed("node", pid), pid, "left").withColumn("_root", F.coalesce("component", pid))
    best = joined.groupBy("_root").agg(F.min_by(pid, F.struct(-F.col(size), -area, F.col(pid))).alias(pid))
    return df.join(best.select(pid), pid, "left_semi")
