"""Peaks of outage series and labelled intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridstrata.functions.arrays import let
from gridstrata.operators.blocks import DAY, carry, over_blocks, running
from gridstrata.operators.resample import ends, spine
from gridstrata.session import checkpoint


def local_maxima(df: DataFrame, keys: Sequence[str], ts: str, value: str, step: int) -> DataFrame:
    """Rows (keys, pos, x) of the local maxima; flat tops count at their middle, the ends of a series are none.

    ``pos`` counts steps. Stretches of equal values are one row each before neighbours are compared, so a flat stretch
    may have any length.
    """
    rows = df.select(*keys, ts, F.floor(F.unix_timestamp(ts) / step).alias("pos"), F.col(value).cast("double").alias("x"))
    starts = over_blocks(rows, keys, ts, lambda w: {"_b": F.lag("x").over(w)}, before=step).where(F.col("_b").isNull() | (F.col("_b") != F.col("x")))
    ahead = carry(starts.select(*keys, ts, "pos", "x", "_b"), keys, ts, {"_n": F.struct("pos", "x")}, ahead=True, current=False)
    top = ahead.where((F.col("x") > F.col("_b")) & (F.col("x") > F.col("_n.x")))
    return top.select(*keys, F.floor((F.col("pos") + F.col("_n.pos") - 1) / 2).alias("pos"), "x")


def apart(candidates: DataFrame, keys: Sequence[str], distance: int, inner: int = 4, width: int = 4096) -> DataFrame:
    """Of candidates (keys, pos, x) closer than ``distance`` the higher stays, of equal ones the later.

    A candidate above all open ones around it stays and removes them; what is still open goes on. Each round makes
    ``inner`` such steps over blocks of positions with a halo as wide as they reach.
    """
    reach = distance - 1
    halo = 2 * inner * reach
    kept, rest = [], checkpoint(candidates.select(*keys, "pos", "x"))
    while True:
        block = F.explode(F.sequence(F.floor((F.col("pos") - halo) / width), F.floor((F.col("pos") + halo) / width)))
        work = rest.withColumn("_block", block).withColumns({"_home": F.col("_block") == F.floor(F.col("pos") / width), "_s": F.lit(0)})
        near = Window.partitionBy(*keys, "_block").orderBy("pos").rangeBetween(-reach, reach)
        for _ in range(inner):
            rank = F.when(F.col("_s") == 0, F.struct("x", "pos"))
            work = work.withColumn("_top", F.max(rank).over(near))
            work = work.withColumn("_won", F.coalesce((F.col("_s") == 0) & (F.col("_top.pos") == F.col("pos")), F.lit(False)))
            work = work.withColumn("_lost", F.max("_won").over(near) & (F.col("_s") == 0) & ~F.col("_won"))
            work = work.withColumn("_s", F.when(F.col("_won"), 1).when(F.col("_lost"), 2).otherwise(F.col("_s")))
        done = checkpoint(work.where("_home AND _s < 2").select(*keys, "pos", "x", "_s"))
        kept.append(done.where("_s = 1").drop("_s"))
        rest = done.where("_s = 0").drop("_s")
        if rest.isEmpty():
            break
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    return out


#: Samples in a block and blocks in a group of blocks, for searches without limit of reach.
SAMPLES, GROUP = 128, 128


class _Levels:
    """Samples in blocks, blocks in groups, groups in a series; every level as arrays of (i, top, low, first, last)."""

    def __init__(self, rows: DataFrame, keys: Sequence[str]):
        keys = list(keys)
        entry = F.struct(F.col("pos").alias("i"), F.col("x").alias("top"), F.col("x").alias("low"), F.col("pos").alias("first"), F.col("pos").alias("last"))
        self.blocks = checkpoint(rows.groupBy(*keys, F.floor(F.col("pos") / SAMPLES).alias("_at")).agg(F.collect_list(entry).alias("_line")))
        self.groups = checkpoint(self._above(self.blocks, keys).groupBy(*keys, F.floor(F.col("_e.i") / GROUP).alias("_at")).agg(F.collect_list("_e").alias("_line")))
        self.series = checkpoint(self._above(self.groups, keys).groupBy(*keys).agg(F.collect_list("_e").alias("_line")))

    @staticmethod
    def _above(level: DataFrame, keys: list[str]) -> DataFrame:
        """One entry for each array: its largest and least value and where the least comes first and last."""
        line = F.col("_line")
        first = F.array_min(F.transform(line, lambda e: F.struct(e["low"].alias("low"), e["first"].alias("at"))))
        last = F.array_min(F.transform(line, lambda e: F.struct(e["low"].alias("low"), (-e["last"]).alias("at"))))
        top = F.array_max(F.transform(line, lambda e: e["top"]))
        return level.select(*keys, F.struct(F.col("_at").alias("i"), top.alias("top"), first["low"].alias("low"), first["at"].alias("first"), (-last["at"]).alias("last")).alias("_e"))


def _walk(asked: DataFrame, near: Column | None) -> DataFrame:
    """Walk along ``_line`` from ``near`` (from the near end if null) outwards: ``hit`` is the first entry above ``h``.

    ``low`` takes in the entries walked over: the least value and, of several, its place next to the peak.
    """
    left, h = F.col("side") < 0, F.col("h")

    def beyond(e: Column) -> Column:
        return F.lit(True) if near is None else F.when(left, e["i"] < near).otherwise(e["i"] > near)

    higher = F.transform(F.filter("_line", lambda e: beyond(e) & (e["top"] > h)), lambda e: e["i"])
    first = F.when(left, F.array_max(higher)).otherwise(F.array_min(higher))

    def passed(hit: Column) -> Column:
        inside = F.filter("_line", lambda e: beyond(e) & (hit.isNull() | F.when(left, e["i"] > hit).otherwise(e["i"] < hit)))
        lows = F.array_min(F.transform(inside, lambda e: F.struct(e["low"].alias("v"), F.when(left, -e["last"]).otherwise(e["first"]).alias("o"))))
        return F.struct(hit.alias("hit"), F.least("low", lows).alias("low"))

    return asked.withColumn("_w", let(first, passed)).withColumns({"hit": F.col("_w.hit"), "low": F.col("_w.low")}).drop("_line", "_w")


def prominences(rows: DataFrame, peaks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``peaks`` (keys, pos, x) with prominence, start_ago and end_in, by the samples ``rows`` (keys, pos, x).

    Both ways from a peak, up to the next higher sample or the end of the series, the least value is sought; the
    prominence is the height above the larger of the two, the bases are their places (the one next to the peak of
    several). The search goes up from the peak's block to its group of blocks and to the groups of the series by their
    largest values, and down again where something higher is: five short arrays, however far it is.
    """
    keys = list(keys)
    levels = _Levels(rows, keys)
    sides = F.explode(F.array(F.lit(-1), F.lit(1))).alias("side")
    low = F.struct(F.col("h").alias("v"), F.when(F.col("side") < 0, -F.col("pos")).otherwise(F.col("pos")).alias("o"))
    asked = peaks.select(*keys, "pos", F.col("x").alias("h"), sides).withColumn("low", low)
    columns = [*keys, "pos", "h", "side", "low"]

    def look(part: DataFrame, level: DataFrame, at: Column | None, near: Column | None) -> DataFrame:
        joined = part.withColumn("_at", at).join(level, [*keys, "_at"]).drop("_at") if at is not None else part.join(level, keys)
        return checkpoint(_walk(joined, near))

    block = F.floor(F.col("pos") / SAMPLES)
    one = look(asked, levels.blocks, block, F.col("pos"))
    two = look(one.where("hit IS NULL").select(*columns), levels.groups, F.floor(block / GROUP), block)
    three = look(two.where("hit IS NULL").select(*columns), levels.series, None, F.floor(block / GROUP))
    down = look(three.where("hit IS NOT NULL").withColumnRenamed("hit", "_group"), levels.groups, F.col("_group"), None).drop("_group")
    found = two.where("hit IS NOT NULL").select(*columns, "hit").unionByName(down.select(*columns, "hit"))
    last = look(found.withColumnRenamed("hit", "_b"), levels.blocks, F.col("_b"), None)
    ends_ = [one.where("hit IS NOT NULL"), three.where("hit IS NULL"), last]
    done = ends_[0].select(*columns).unionByName(ends_[1].select(*columns)).unionByName(ends_[2].select(*columns))
    per = done.groupBy(*keys, "pos").agg(
        F.first("h").alias("x"), F.max(F.when(F.col("side") < 0, F.col("low"))).alias("_l"), F.max(F.when(F.col("side") > 0, F.col("low"))).alias("_r"))
    return per.select(
        *keys, "pos", "x", (F.col("x") - F.greatest("_l.v", "_r.v")).alias("prominence"), (F.col("pos") + F.col("_l.o")).alias("start_ago"),
        (F.col("_r.o") - F.col("pos")).alias("end_in"))


def peak_detect(df: DataFrame, key: str, ts: str, value: str, distance: int = 6, prominence: float = 30.0, step: int = 3600) -> DataFrame:
    """Peaks of each series on its complete axis of ``step`` seconds, at least ``distance`` steps apart."""
    keys = [key]
    df = checkpoint(df.select(key, ts, value))  # read for the maxima and for the levels
    rows = df.select(key, F.floor(F.unix_timestamp(ts) / step).alias("pos"), F.col(value).cast("double").alias("x"))
    found = prominences(rows, apart(local_maxima(df, keys, ts, value, step), keys, distance), keys)
    return found.where(F.col("prominence") >= prominence).select(
        key, F.timestamp_seconds(F.col("pos") * step).alias(ts), F.col("x").alias(value), "prominence", "start_ago", "end_in")


# Below this envelope a peak needs this share of prominence.
PROMINENCE_STEPS = ((100, 0.5), (200, 0.45), (400, 0.4), (600, 0.35), (1000, 0.3))


def peak_correct(df: DataFrame, value: str, envelop: str, prominence: str, floor: float = 10.0) -> DataFrame:
    """``peak`` 1 where the peak is not a fluctuation of a larger one; spans of low rows are reset."""
    share = F.col(prominence) / F.col(envelop)
    small = (F.col(value) < floor) | F.coalesce(share < 0.2, F.lit(False))
    for limit, needed in PROMINENCE_STEPS:
        small = small | ((F.col(envelop) < limit) & F.coalesce(share < needed, F.lit(False)))
    low = F.col(value) < floor
    return df.withColumns(
        {
            "peak": F.when(small, 0).otherwise(1), "start_ago": F.when(low, 0).otherwise(F.col("start_ago")),
            "end_in": F.when(low, 0).otherwise(F.col("end_in")),
        }
    )


def gaussian_envelope(
    rows: DataFrame, peaks: DataFrame, keys: Sequence[str], ts: str, value: str, envelop: str, step: int
) -> DataFrame:
    """Half bells around the peaks times the envelope: wide to the left, steep to the right.

    Left of a peak the result is not below the raw value. Rows are reached by at most 36 + 6 offsets per peak.
    """
    left = F.greatest(F.lit(3), F.least(F.lit(36), F.col("start_ago"))).cast("int")
    right = F.greatest(F.lit(3), F.least(F.lit(6), F.col("end_in"))).cast("int")
    half = F.bround(F.col("start_ago") / 2)
    sigma = F.greatest(F.lit(1), F.least(F.lit(15), half))
    around = peaks.select(*keys, ts, sigma.alias("_sl"), F.explode(F.sequence(-left, right)).alias("_o"))
    width = F.when(F.col("_o") < 0, F.col("_sl")).otherwise(F.lit(1.0))
    coef = F.exp(-(F.col("_o") * F.col("_o")) / (2 * width * width))
    reach = around.select(
        *keys, F.timestamp_seconds(F.unix_timestamp(ts) + F.col("_o") * step).alias(ts), coef.alias("_c"),
        (F.col("_o") < 0).alias("_left"),
    ).groupBy(*keys, ts).agg(F.max("_c").alias("_c"), F.max("_left").alias("_left"))
    out = rows.join(reach, [*keys, ts], "left")
    bell = F.coalesce(F.col(envelop) * F.coalesce("_c", F.lit(0.0)), F.lit(0.0))
    lifted = F.when(F.coalesce("_left", F.lit(False)) & (bell > 0), F.greatest(bell, F.col(value))).otherwise(bell)
    return out.withColumn("outbreak", lifted).drop("_c", "_left")


def intervals_from_extrema(df: DataFrame, keys: Sequence[str], ts: str, kind: str, ties: Sequence[str] = ()) -> DataFrame:
    """An interval from the last extremum of one type to the first of the other; the last extremum closes alone."""
    here = F.struct(F.col(ts).alias("t"), F.col(kind).alias("k"))
    rows = carry(df, keys, ts, {"_p": here}, current=False, ties=ties, width=7 * DAY)
    changed = rows.where(F.col("_p.k") != F.col(kind)).select(*keys, F.col("_p.t").alias("start"), F.col(ts).alias("stop"))
    last = df.groupBy(*keys).agg(F.max(ts).alias("start")).withColumn("stop", F.col("start"))
    return changed.unionByName(last)


def gap_stats(df: DataFrame, keys: Sequence[str], start: str, stop: str, ties: Sequence[str] = ()) -> DataFrame:
    """Mean interval length and mean gap to the next interval, over all but the last interval of each series."""
    rows = carry(df, keys, start, {"_n": F.col(start)}, ahead=True, current=False, ties=ties)
    known = rows.where(F.col("_n").isNotNull())
    length = F.unix_timestamp(stop) - F.unix_timestamp(start)
    gap = F.unix_timestamp("_n") - F.unix_timestamp(stop)
    return known.groupBy(*keys).agg(F.avg(length).alias("mean_length"), F.avg(gap).alias("mean_gap"))


def interval_labels(df: DataFrame, keys: Sequence[str], start: str, stop: str, step: int) -> DataFrame:
    """Label 1 for the stamps of the axis inside ``[start, stop)`` of any interval of the key, else 0.

    The axis has every ``step`` seconds between the first start and the last stop of all keys.

    Starts and ends change a running count of open intervals, so long intervals cost no more than short ones.
    """

    def up(c: str) -> Column:
        return F.timestamp_seconds(F.ceil(F.unix_timestamp(c) / step) * step)

    some = df.where(F.col(start) < F.col(stop))
    on = some.select(*keys, up(start).alias("ts"), F.lit(1).alias("d"))
    off = some.select(*keys, up(stop).alias("ts"), F.lit(-1).alias("d"))
    first, last = ends(df, up(start), up(stop))
    axis = spine(df.select(*keys).distinct(), first, last, f"{step} seconds").withColumn("d", F.lit(0))
    deltas = on.unionByName(off).unionByName(axis).groupBy(*keys, "ts").agg(F.sum("d").alias("d"))
    counted = running(deltas, keys, "ts", {"n": F.col("d")}, width=360 * DAY)
    return counted.select(*keys, "ts", (F.col("n") > 0).cast("bigint").alias("label"))
