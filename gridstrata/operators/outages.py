"""Outage sessions, storm episodes and event counts on a time axis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridstrata.operators.blocks import DAY, block_no, running
from gridstrata.operators.resample import ends, spine


def sessions(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, gap: int, tail: int = 900, ties: Sequence[str] = (),
    width: int = 30 * DAY,
) -> DataFrame:
    """Rows closer than ``gap`` seconds form a session; one row per session.

    Sessions are built per time block, summed up, and joined across block borders on the summed rows, so a key of any
    length is worked on by many tasks and shuffled once.
    """
    work = df.select(*keys, ts, value, *[t for t in ties if t not in (ts, value)]).withColumn("_block", block_no(ts, width))
    w = Window.partitionBy(*keys, "_block").orderBy(ts, *ties)
    micros = F.unix_micros(ts)
    cut = F.coalesce(micros - F.lag(micros).over(w) >= gap * 1_000_000, F.lit(False)).cast("int")
    work = work.withColumn("_cut", cut)
    work = work.withColumn("_no", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = work.groupBy(*keys, "_block", "_no").agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(ts).alias("start"), F.max(ts).alias("last"),
        F.min_by(value, F.struct(ts, *ties)).alias("first_value"),
    )
    across = Window.partitionBy(*keys).orderBy("_block", "_no")
    before = F.lag("last").over(across)
    starts = F.coalesce(F.unix_micros("start") - F.unix_micros(before) >= gap * 1_000_000, F.lit(True)).cast("int")
    pieces = pieces.withColumn("_new", starts)
    pieces = pieces.withColumn("session", F.sum("_new").over(across.rowsBetween(Window.unboundedPreceding, 0)))
    out = pieces.groupBy(*keys, "session").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("start").alias("start"),
        F.min_by("first_value", "start").alias("first_value"), F.max("last").alias("last"),
    )
    stop = F.timestamp_add("SECOND", F.lit(tail), F.col("last"))
    days = (F.unix_micros(stop) - F.unix_micros("start")) / (DAY * 1_000_000)
    out = out.withColumns({"stop": stop, "duration_days": days})
    return out.withColumn("total_per_day", F.col("total") / F.col("duration_days")).drop("last")


def episodes(df: DataFrame, episode: str, county: str, begin: str, end: str, kind: str, story: str, event: str) -> DataFrame:
    """Episode facts on each of its counties. ``kind`` has few values, so its set is small."""
    facts = df.groupBy(episode).agg(
        F.count(F.lit(1)).alias("n_events"), F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("kinds"),
        F.min_by(story, F.struct(event, story)).alias("story"), F.min(begin).alias("begin_ts"), F.max(end).alias("end_ts"),
    )
    hours = (F.unix_timestamp("end_ts") - F.unix_timestamp("begin_ts")) / 3600
    facts = facts.withColumn("storm_hours", F.when(hours == 0, 0.01).otherwise(hours))
    return df.select(episode, county).distinct().join(facts, episode)


def episode_summary(df: DataFrame, keys: Sequence[str], ts: str, value: str, ties: Sequence[str] = ()) -> DataFrame:
    at = F.struct(ts, *ties)
    return df.groupBy(*keys).agg(
        F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"), F.sum(value).alias("total"),
        F.max(value).alias("peak"), F.avg(value).alias("mean"),
    )


def type_severity(df: DataFrame, kind: str, episode: str, damages: dict[str, str]) -> DataFrame:
    """Severity 2, 1 or 0 of each event type from the means and maxima of its damages.

    Severe: at least two of mean ≥ 20 000 and maximum ≥ 1 000 000 over the damage columns; moderate: at least one of
    mean > 5 000 and maximum > 500 000.
    """
    stats = df.groupBy(kind).agg(
        F.count_distinct(episode).alias("n_episodes"),
        *[fn(c).alias(f"{n}_{s}") for n, c in damages.items() for s, fn in (("sum", F.sum), ("mean", F.avg), ("max", F.max))],
    )

    def hits(mean: float, top: float, strict: bool) -> Column:
        tests = []
        for n in damages:
            for s, limit in (("mean", mean), ("max", top)):
                c = F.col(f"{n}_{s}")
                tests.append((c > limit if strict else c >= limit).cast("int"))
        return sum(tests[1:], tests[0])

    severity = F.when(hits(20000, 1e6, False) >= 2, 2).when(hits(5000, 5e5, True) >= 1, 1).otherwise(0)
    return stats.withColumn("severity", severity)


# Simplified groups of event types; all others are named after their severity.
EVENT_GROUPS = {
    "Flood": ("Flash Flood", "Flood", "Debris Flow", "Coastal Flood"),
    "Wind": ("Strong Wind", "High Wind", "Marine Strong Wind", "Thunderstorm Wind", "Tornado"),
    "Storm": (
        "Tropical Storm", "Ice Storm", "Lightning", "Winter Storm", "Hurricane", "Hurricane (Typhoon)",
    ),
    "Fire": ("Wildfire",),
}


def simplified_type(kind: str, severity: str) -> Column:
    out = None
    for group, members in EVENT_GROUPS.items():
        hit = F.col(kind).isin(*members)
        out = F.when(hit, group) if out is None else out.when(hit, group)
    level = F.col(severity)
    return out.when(level == 2, "Other_severe").when(level == 1, "Other_moderate").otherwise("Other_light")


def count_active(
    df: DataFrame, kind: str, begin: str, end: str, kinds: Sequence[str], seconds: int
) -> DataFrame:
    """Events under way per slot and type, on the complete axis from the first begin to the last end.

    An event adds one at its first slot and takes it away after its last; running sums over the axis give the counts.
    The work grows with events + slots, not with event length.
    """

    def slot(c: str) -> Column:
        return F.timestamp_seconds(F.floor(F.unix_timestamp(c) / seconds) * seconds)

    on = df.select(kind, slot(begin).alias("ts"), F.lit(1).alias("d"))
    off = df.select(kind, F.timestamp_seconds(F.unix_timestamp(slot(end)) + seconds).alias("ts"), F.lit(-1).alias("d"))
    names = F.array(*[F.lit(k) for k in kinds])
    axis = df.sparkSession.range(1).select(F.explode(names).alias(kind))
    first, last = ends(df, slot(begin), slot(end))
    axis = spine(axis, first, last, f"{seconds} seconds")
    deltas = on.unionByName(off).unionByName(axis.withColumn("d", F.lit(0))).groupBy(kind, "ts").agg(F.sum("d").alias("d"))
    counted = running(deltas, [kind], "ts", {"n": F.col("d")}, width=90 * DAY)
    return counted.where(F.col("ts") <= last).groupBy("ts").pivot(kind, list(kinds)).agg(F.first("n"))
