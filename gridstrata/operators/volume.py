"""Seismic volumes and images as voxel and pixel tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slices(voxels: DataFrame, sample: str, axes: Sequence[str], label: str) -> DataFrame:
    """Per sample, axis and index: the extent of the two other axes and the number of positive voxels."""
    entries = []
    for a in axes:
        b, c = (o for o in axes if o != a)
        entries.append(
            F.struct(F.lit(a).alias("axis"), F.col(a).cast("bigint").alias("idx"), F.col(b).cast("bigint").alias("_b"), F.col(c).cast("bigint").alias("_c"), F.col(label).alias("_l"))
        )
    rows = voxels.select(sample, F.inline(F.array(*entries)))
    return rows.groupBy(sample, "axis", "idx").agg(
        (F.max("_b") + 1).alias("height"), (F.max("_c") + 1).alias("width"), F.count_if(F.col("_l") > 0).alias("n_positive")
    )


def empty_report(samples: DataFrame, sample: str, voxels: DataFrame, label: str) -> DataFrame:
    """Samples without labels, and labelled samples without a positive voxel."""
    facts = voxels.groupBy(sample).agg(F.count(label).alias("n_labelled"), F.count_if(F.col(label) > 0).alias("n_positive"))
    out = samples.join(facts, sample, "left").na.fill(0, ["n_labelled", "n_positive"])
    state = F.when(F.col("n_labelled") == 0, "no label").when(F.col("n_positive") == 0, "empty").otherwise("filled")
    return out.withColumn("state", state)


def sparse_coords(traces: DataFrame, keys: Sequence[str], mask: str) -> DataFrame:
    """Dense mask arrays to the positions of their ones."""
    return traces.select(*keys, F.posexplode(mask).alias("t", "_m")).where("_m > 0").drop("_m")


def class_of_colour(pixels: DataFrame, colours: DataFrame) -> DataFrame:
    """Class id of each pixel by its (r, g, b); −1 for colours outside the map."""
    return pixels.join(colours, ["r", "g", "b"], "left").withColumn("label", F.coalesce("label", F.lit(-1)))


def profile_features(grid: DataFrame, sample: str, axes: Sequence[str], value: str) -> DataFrame:
    """Minimum, maximum, mean and population deviation by position along each axis."""
    entries = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("bigint").alias("pos"), F.col(value).alias("_v")) for a in axes])
    rows = grid.select(sample, F.inline(entries))
    return rows.groupBy(sample, "axis", "pos").agg(
        F.min("_v").alias("low"), F.max("_v").alias("high"), F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std")
    )
