"""Complete time axes, resampling and disaggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ends(df: DataFrame, first: str | Column, last: str | Column | None = None) -> tuple[Column, Column]:
    """Earliest ``first`` and latest ``last`` (the same column if not given) of a table, as scalar subqueries.

    Both are null for a table without stamps.
    """
    facts = df.agg(F.min(first).alias("first"), F.max(first if last is None else last).alias("last"))
    return facts.select("first").scalar(), facts.select("last").scalar()


def _stamp(at: str | Column) -> Column:
    return F.to_timestamp(F.lit(at)) if isinstance(at, str) else at


def spine(keys: DataFrame, start: str | Column, end: str | Column, step: str, name: str = "ts") -> DataFrame:
    """Each key row on every stamp from ``start`` to ``end``; a generator, not a join. No rows where an end is null."""
    bounds = keys.withColumns({"_start": _stamp(start), "_end": _stamp(end)})
    stamps = F.sequence("_start", "_end", F.expr(f"interval {step}"))
    return bounds.withColumn(name, F.explode(stamps)).drop("_start", "_end")


#: Seconds of the units of a step of fixed length.
_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
_DAY = 86_400_000_000


def _micros(step: str) -> int:
    """Length of a fixed step such as ``15 minutes`` in microseconds."""
    number, unit = step.split()
    return round(float(number) * _UNITS[unit.lower().rstrip("s")] * 1_000_000)


def spread(df: DataFrame, *by: str, least: int = 1) -> DataFrame:
    """Rows dealt out by ``by`` to as many tasks as the session's shuffles have, ``least`` at least.

    For rows that each become many: the engine merges partitions by the bytes that go in, so one task would make all.
    """
    return df.repartition(max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by)


def spine_fill(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, step: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Sum by key and stamp on the complete axis, 0 where nothing was measured.

    The axis reaches from the first to the last stamp of all keys; ``start`` or ``end``, if given, bound it instead, and
    rows outside are left out. Rows without a stamp are in no sum. ``step`` has a fixed length. The sums meet one axis row
    for each key and day, and only there the stamps of the day are made: no aggregation holds the axis.
    """
    first, last = ends(df, ts) if start is None or end is None else (None, None)
    bounds = {"_start": F.unix_micros(first if start is None else _stamp(start)), "_end": F.unix_micros(last if end is None else _stamp(end))}
    day = lambda c: f"CAST(({c} - pmod({c}, {_DAY})) DIV {_DAY} AS INT)"
    inside = F.col(ts).isNotNull()
    if start is not None:
        inside &= F.col(ts) >= _stamp(start)
    if end is not None:
        inside &= F.col(ts) <= _stamp(end)
    sums = df.where(inside).groupBy(*keys, ts).agg(F.sum(F.col(value).cast("double")).alias(value))
    sums = sums.withColumn("_us", F.unix_micros(ts)).select(*keys, F.expr(day("_us")).alias("_day"), F.struct("_us", F.col(value).alias("v")).alias("_sum"))
    days = df.select(*keys).distinct().withColumns(bounds).where("_start <= _end")
    days = days.select(*keys, F.expr(f"explode(sequence({day('_start')}, {day('_end')}))").alias("_day"), F.lit(None).cast(sums.schema["_sum"].dataType).alias("_sum"))
    parts = spread(sums.unionByName(days), *keys, "_day").groupBy(*keys, "_day").agg(F.collect_list("_sum").alias("_sums")).withColumns(bounds)
    us, size = f"CAST(_day AS BIGINT) * {_DAY}", _micros(step)
    parts = parts.withColumns({
        "_from": F.expr(f"(greatest({us} - _start, 0L) + {size - 1}) DIV {size}"), "_to": F.expr(f"(least({us} + {_DAY - 1}, _end) - _start) DIV {size}"),
        "_by": F.map_from_entries("_sums")})
    axis = F.expr(
        f"""CASE WHEN _from <= _to THEN transform(sequence(_from, _to), k -> named_struct('_us', _start + k * {size}, 'v',
            coalesce(try_element_at(_by, _start + k * {size}), 0.0D) + 0.0D)) ELSE array() END""")
    beside = F.expr(f"filter(_sums, s -> pmod(s._us - _start, {size}) <> 0)")
    rows = parts.select(*keys, F.explode(F.concat(axis, beside)).alias("_row"))
    return rows.select(*keys, F.timestamp_micros("_row._us").alias(ts), F.col("_row.v").alias(value))
