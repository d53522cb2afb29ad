"""Sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstrata.operators.blocks import DAY


def write_if_absent(df: DataFrame, path: str, fmt: str = "parquet", by: Sequence[str] = ()) -> str:
    """Write unless the target exists; the existing target is left as it is."""
    writer = df.write.mode("ignore").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if by:
        writer = writer.partitionBy(*by)
    writer.save(path)
    return path


def write_split(df: DataFrame, path: str, split: str = "split") -> str:
    """One folder per split; rows are spread by size, so that a large split becomes many files."""
    df.hint("rebalance", split).write.mode("error").partitionBy(split).parquet(path)
    return path


def interval_json(df: DataFrame, name: str, start: str, stop: str, width: int = 30 * DAY) -> DataFrame:
    """JSON lines ``{name: [[start, stop], …]}`` of interval seconds, one line per name and time block.

    A name with very many intervals gets many lines; the arrays of one name are joined in block order.
    """
    block = F.floor(F.col(start) / width).cast("bigint")
    pairs = df.groupBy(name, block.alias("block")).agg(F.sort_array(F.collect_list(F.array(start, stop))).alias("_p"))
    entry = F.to_json(F.map_from_arrays(F.array(F.col(name).cast("string")), F.array("_p")))
    return pairs.select(name, "block", entry.alias("json"))
