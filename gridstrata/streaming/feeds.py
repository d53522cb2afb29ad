"""Streaming forms of batch operators: DataFrame in, DataFrame out, plus one bounded run over a file source.

All results are appended: a window leaves the state, and reaches the sink once, when the watermark has passed its end.
State is keyed by entity and window, so a hot entity is bounded by its open windows; sums are combined before the
shuffle. Sliding sums hold panes of time, see ``rolling_cost``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstrata.session import scratch_path


def hourly_max(df: DataFrame, key: str, ts: str, value: str, delay: str = "1 hour") -> DataFrame:
    out = df.withWatermark(ts, delay).groupBy(key, F.window(ts, "1 hour").alias("w")).agg(F.max(value).alias("peak"))
    return out.select(key, F.col("w.start").alias("hour"), "peak")


#: Groups of entities whose open readings are held together by ``rolling_cost``; fixed for the life of a checkpoint.
BUCKETS = 1024
#: Held sums of which the windows are made at once.
SLICE = 1 << 14


def rolling_cost(df: DataFrame, key: str, ts: str, value: str, length: str = "4 hours", slide: str = "15 minutes", delay: str = "1 hour") -> DataFrame:
    """Sums of a double in sliding windows. The state holds each entity's sums per pane, not per window.

    A pane is the largest step that divides slide and length, so every window is whole panes. Windows are added up when the
    watermark passes their end, and a pane is forgotten with its last window. A late row counts in those of its windows that
    are still open: the engine drops rows without any, by the end of the longest reach, and each bucket keeps the last
    watermark it saw. Only late rows of a bucket without any row before them count in closed windows too.
    """
    span, every, late = (int(pd.Timedelta(x) // pd.Timedelta(1, "us")) for x in (length, slide, delay))
    pane = math.gcd(span, every)
    micros, entity = F.unix_micros(ts), F.col(key)
    rows = df.where(F.col(ts).isNotNull()).select(
        F.when(entity.isNull(), -1).otherwise(F.pmod(F.xxhash64(entity), F.lit(BUCKETS))).cast("int").alias("bucket"),
        entity.alias("entity"),
        ((micros - F.pmod(micros, F.lit(pane))) / pane).cast("bigint").alias("pane"),
        F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("total"),
        F.col(value).isNotNull().alias("known"),
        (F.col(ts) + F.make_dt_interval(secs=F.lit(span / 1e6))).alias("until"),
    )
    kind = df.schema[key].dataType.simpleString()
    out = rows.withWatermark("until", f"{late + span} microseconds").groupBy("bucket").applyInPandasWithState(
        _close_windows(pane, span // pane, every // pane),
        f"entity {kind}, start bigint, total double, known boolean, odd boolean", "seen bigint, open binary", "append", "EventTimeTimeout",
    )
    cost = F.when(F.col("odd"), float("nan")).when(F.col("known"), F.col("total"))
    return out.select(F.col("entity").alias(key), F.timestamp_micros("start").alias("start"), cost.alias("cost"))


def _merged(parts: list[pd.DataFrame]) -> pd.DataFrame:
    """One row per entity and pane, in this order; null values count as 0 and are known by ``known``, NaN stays NaN."""
    all_ = pd.concat(parts, ignore_index=True)
    code = all_.groupby("entity", dropna=False, sort=False).ngroup().to_numpy()
    order = np.lexsort((all_["pane"].to_numpy(), code))
    code, pane = code[order], all_["pane"].to_numpy()[order]
    first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (pane[1:] != pane[:-1])])
    out = all_.iloc[order[first]][["entity", "pane"]].reset_index(drop=True)
    out["total"] = np.add.reduceat(all_["total"].to_numpy()[order], first)
    out["known"] = np.logical_or.reduceat(all_["known"].to_numpy(bool)[order], first)
    return out


def _windows(held: pd.DataFrame, length: int, slide: int, after: float, upto: float) -> Iterator[pd.DataFrame]:
    """Sums of the windows that end behind ``after`` and not behind ``upto``; all but the sums counted in panes.

    Slices reach on by the panes that a window may have behind them; a window belongs to the slice of its first pane.
    """
    code = held.groupby("entity", dropna=False, sort=False).ngroup().to_numpy()
    pane, total, known = (held[c].to_numpy() for c in ("pane", "total", "known"))
    for at in range(0, len(held), SLICE):
        here = slice(at, min(at + SLICE + length - 1, len(held)))
        window = (pane[here] // slide)[:, None] - np.arange(-(-length // slide))
        begin = window * slide
        row, col = np.nonzero((begin + length > pane[here][:, None]) & (begin + length > after) & (begin + length <= upto))
        if not len(row):
            continue
        begin, c = begin[row, col], code[here][row]
        order = np.lexsort((row, begin, c))
        row, begin, c = row[order], begin[order], c[order]
        first = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (begin[1:] != begin[:-1])])
        sums, some = np.add.reduceat(total[here][row], first), np.logical_or.reduceat(known[here][row], first)
        own = row[first] < SLICE
        if at:
            own &= (c[first] != code[at - 1]) | (begin[first] > pane[at - 1])
        entity = held["entity"].iloc[at + row[first][own]]
        yield pd.DataFrame({"entity": entity.to_numpy(), "start": begin[first][own], "total": sums[own], "known": some[own]})


def _close_windows(pane: int, length: int, slide: int):
    """The function of one bucket: takes its rows, gives the windows that the watermark has passed since the last call."""

    def run(bucket: tuple, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = max(state.getCurrentWatermarkMs(), 0)
        seen, held, new = 0, None, []
        if state.exists:
            seen, kept = state.get
            held = pa.ipc.open_stream(bytes(kept)).read_pandas()
        for chunk in chunks:
            new.append(chunk[["entity", "pane", "total", "known"]])
            if sum(map(len, new)) > max(1 << 18, 0 if held is None else len(held)):
                held, new = _merged([*([] if held is None else [held]), *new]), []
        new = [c for c in new if len(c)]
        if new:
            held = _merged([*([] if held is None else [held]), *new])
        if held is not None:
            edge = now * 1000 / pane
            if now > seen:
                for out in _windows(held, length, slide, seen * 1000 / pane, edge):
                    if bucket[0] < 0:  # objects, for next to them whole numbers of other buckets would turn into floats
                        out["entity"] = np.full(len(out), None, object)
                    out["start"] *= pane
                    out["odd"] = np.isnan(out["total"])
                    yield out
            held = held[held["pane"] // slide * slide + length > edge]
            sink = pa.BufferOutputStream()
            table = pa.Table.from_pandas(held, preserve_index=False)
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            state.update((now, sink.getvalue().to_pybytes()))
        state.setTimeoutTimestamp(max(now, 1))

    return run


def outage_sessions(df: DataFrame, key: str, ts: str, value: str, gap_hours: int = 18, delay: str = "1 hour") -> DataFrame:
    """Sessions split where the gap is at least ``gap_hours``; the engine joins rows at exactly its gap, so it gets 1 µs less."""
    gap = f"{gap_hours * 3_600_000_000 - 1} microseconds"
    out = df.withWatermark(ts, delay).groupBy(key, F.session_window(ts, gap).alias("s")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(ts).alias("start"), F.max(ts).alias("last")
    )
    return out.select(key, "n", "total", "start", "last")


def first_per_key(df: DataFrame, keys: Sequence[str], ts: str, delay: str = "1 hour") -> DataFrame:
    """The first row to arrive per key; the key is forgotten once the watermark has passed it."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def enrich(df: DataFrame, static: DataFrame, on: Sequence[str]) -> DataFrame:
    """Stream–static join; the engine broadcasts the static side only if its size allows."""
    return df.join(static, list(on), "left")


def file_stream(spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def run_to_end(df: DataFrame, name: str) -> DataFrame:
    """Work off all files that are there, through an exactly-once file sink, and read the result back."""
    spark = df.sparkSession
    target = scratch_path(spark, name)
    query = (
        df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{target}-state")
        .option("path", target).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(target)
