"""Connected components of links between rows, without a task that holds a component.

Links found in one task are first cut down to stars (``stars``); then rounds of joins hang every node on the smallest
node around it. Minima are combined before the shuffle and written out, so that joins against them have two plain
shuffled sides, which the adaptive engine splits where one node holds many links.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstrata.llm.common import checkpoint


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's component, for nodes 0 to n − 1 and links a – b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for side in (a, b):
            np.minimum.at(new, root[side], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        root = new
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewest links that join the same ids as the links u – v: each id with the smallest id of its component."""
    ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = roots(place[: len(u)], place[len(u) :], len(ids))
    other = np.flatnonzero(root != np.arange(len(ids)))
    return ids[other], ids[root[other]]


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Rows (node, component) of all nodes of the links (u, v); component is the smallest node that links reach.

    Null ends and links of a node to itself say nothing. Every round hangs larger neighbours, then smaller ones, on the
    smallest; about log² rounds settle any chain, else an error is raised.
    """
    e = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e, mark = checkpoint(e.distinct()), None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpoint(both.groupBy("u").agg(F.min("v").alias("m")))
        large = e.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u")
        large = large.select("v", F.least("u", "m").alias("m"))
        down = checkpoint(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = checkpoint(down.groupBy("u").agg(F.min("v").alias("m")))
        moved = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpoint(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    tops = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return tops.unionByName(e.select(F.col("u").alias("node"), F.col("v").alias("component")))
