"""Statistics of many calendar groupings from one read of the rows.

``cells`` sums the rows up to mergeable states (count, sum, squared deviations, least, largest) per key, day and hour, and
keeps the counted values of the measure whose quantiles are asked for; the table is written once. Every grouping of
day or hour is a roll-up of the states: a cell is handed to all groupings at once and combined in its task before the
shuffle, so neither the input nor its width grows with the number of groupings.

Quantiles, trimmed sums and mean deviations are exact. ``rank_facts`` counts values in bins of nearly equal relative
width (a bin is an exponent and ten bits below it, so it needs no look at the range beforehand and merges like any
count), finds the bins that hold the wanted ranks of all groups at once, and orders the values of those bins alone.

``by_key`` deals the rows out by key once, and every grouping is made where the rows of its key are: no cell is written
and no grouping is shuffled. Groups are then ordered as arrays. Keys with more than ``WHOLE`` rows go the other way, over
written cells and bins, so that no task holds them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridstrata.operators.resample import spread
from gridstrata.session import scratch_path

#: Bins between two powers of two, and room for the exponents of all doubles.
STEPS = 1024
_SHIFT = 1100 * STEPS
_FAR = 1 << 40
#: Most rows of a key that are worked on in one task, and rows that a task has of all its keys, about.
WHOLE, DEALT = 1 << 18, 1 << 16


def magnitude_bin(x: str | Column) -> Column:
    """Whole number that never falls where the value rises; NaN counts as the largest."""
    c = (F.col(x) if isinstance(x, str) else x).cast("double")
    size = F.abs(c)
    exponent = F.floor(F.log2(size))
    place = F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * STEPS)
    finite = exponent * STEPS + place + _SHIFT
    bin_ = F.when(F.isnan(c), 2 * _FAR).when(size == float("inf"), _FAR).when(size < 2.3e-308, 0).otherwise(finite)
    return F.when(c < 0, -bin_).otherwise(bin_).cast("bigint")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, read back; computed once whatever is made of them."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def by_key(rows: DataFrame, keys: Sequence[str], make: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
    """``make(rows, whole)`` over the rows dealt out by key (whole), and over those of keys with more than ``WHOLE`` rows.

    At most one number per ``WHOLE`` rows comes to the driver: the hash of a crowded key.
    """
    mark = F.xxhash64(*keys)
    sizes = rows.groupBy(mark.alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    n, crowded = sizes.agg(F.sum("_n"), F.collect_list(F.when(F.col("_n") > WHOLE, F.col("_k")))).first()
    tasks = (n or 0) // DEALT
    if not crowded:
        return make(spread(rows, *keys, least=tasks), True)
    return make(spread(rows.where(~mark.isin(crowded)), *keys, least=tasks), True).unionByName(make(rows.where(mark.isin(crowded)), False))


def single(df: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """Each row as a cell of its own: day, hour, value ``x`` and one row."""
    return df.select(
        *keys, F.date_trunc("day", ts).alias("day"), F.hour(ts).alias("hour"), F.col(value).cast("double").alias("x"), F.lit(1).cast("bigint").alias("rows"))


def cells(df: DataFrame, keys: Sequence[str], ts: str, measures: Sequence[str], counted: str | None = None) -> DataFrame:
    """States of the measures per key, day, hour and, if ``counted`` names a measure, its value (column ``x``)."""
    t = F.col(ts)
    by = [*keys, F.date_trunc("day", t).alias("day"), F.hour(t).alias("hour")]
    if counted:
        by.append(F.col(counted).cast("double").alias("x"))
    states = [F.count(F.lit(1)).alias("rows")]
    for m in measures:
        states += [
            F.count(m).alias(f"n_{m}"), F.sum(m).alias(f"s_{m}"), (F.var_pop(m) * F.count(m)).alias(f"d_{m}"), F.min(m).alias(f"lo_{m}"), F.max(m).alias(f"hi_{m}")]
    return df.groupBy(*by).agg(*states)


def merged(measures: Sequence[str]) -> list[Column]:
    """Aggregates that combine states into the state of all their rows."""
    out = [F.sum("rows").alias("rows")]
    for m in measures:
        n, s = F.col(f"n_{m}"), F.col(f"s_{m}")
        # squared deviations: those inside the parts, and those of the parts' means
        between = F.sum(F.try_divide(s * s, n)) - F.try_divide(F.sum(s) * F.sum(s), F.sum(n))
        out += [
            F.sum(n).alias(f"n_{m}"), F.sum(s).alias(f"s_{m}"), (F.sum(f"d_{m}") + F.greatest(between, F.lit(0.0))).alias(f"d_{m}"),
            F.min(f"lo_{m}").alias(f"lo_{m}"), F.max(f"hi_{m}").alias(f"hi_{m}")]
    return out


def statistic(measure: str, name: str) -> Column:
    """mean, sum, std, min or max of a measure from its state."""
    n, s = F.col(f"n_{measure}"), F.col(f"s_{measure}")
    return {
        "mean": F.try_divide(s, n), "sum": s, "min": F.col(f"lo_{measure}"), "max": F.col(f"hi_{measure}"), "n": n,
        "std": F.when(n > 1, F.sqrt(F.col(f"d_{measure}") / (n - 1))),
    }[name]


def entries(groupings: dict[str, Column]) -> Column:
    """One (grouping, bucket) entry for each grouping; the buckets are columns of day and hour as text."""
    return F.array(*[F.struct(F.lit(g).alias("grouping"), b.cast("string").alias("bucket")) for g, b in groupings.items()])


def coarser(states: DataFrame, keys: Sequence[str], parts: dict[str, Column], measures: Sequence[str]) -> DataFrame:
    """States per key and the named parts of the calendar: the level from which groupings of these parts are rolled up."""
    return states.groupBy(*keys, *[c.alias(n) for n, c in parts.items()]).agg(*merged(measures))


def roll_up(states: DataFrame, keys: Sequence[str], groupings: dict[str, Column], measures: Sequence[str]) -> DataFrame:
    """States per key, grouping and bucket. A null bucket takes part as the empty text."""
    long = states.withColumn("_e", F.explode(entries(groupings))).withColumns(
        {"grouping": F.col("_e.grouping"), "bucket": F.coalesce("_e.bucket", F.lit(""))})
    return long.groupBy(*keys, "grouping", "bucket").agg(*merged(measures))


def by_bucket(counted: DataFrame, keys: Sequence[str], groupings: dict[str, Column]) -> DataFrame:
    """Counted values (x, c) per key, grouping and bucket, not yet combined; null values are left out."""
    long = counted.where("x IS NOT NULL").withColumn("_e", F.explode(entries(groupings)))
    return long.select(*keys, "_e.grouping", F.coalesce("_e.bucket", F.lit("")).alias("bucket"), "x", F.col("rows").alias("c"))


def rank_facts(values: DataFrame, by: Sequence[str], ranks: dict[str, Column], below: dict[str, Column] | None = None) -> DataFrame:
    """Exact facts at ranks of each group of counted values (x, c).

    ``ranks`` are 0-based ranks as expressions of ``n`` (the group's rows) and ``total`` (their sum); each gives
    ``<name>`` (the value at that rank, null outside) and ``<name>_under`` (the sum of all values of smaller rank).
    ``below`` are numbers as such expressions; each gives ``<name>_count`` and ``<name>_under``: rows with a smaller
    value and their sum. Also n, total, lo, hi. A group may be of any size: it is ordered bin by bin.
    """
    by, below = list(by), below or {}
    rows = values.withColumn("_bin", magnitude_bin("x"))
    bins = rows.groupBy(*by, "_bin").agg(F.sum("c").alias("_c"), F.sum(F.col("x") * F.col("c")).alias("_s"), F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    along = Window.partitionBy(*by).orderBy("_bin")  # one row for each bin of the group
    order, whole = along.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    zero, none = F.lit(0).cast("bigint"), F.lit(0.0)
    bins = bins.select(
        "*", F.coalesce(F.sum("_c").over(order), zero).alias("_c0"), F.coalesce(F.sum("_s").over(order), none).alias("_s0"), F.lead("_bin").over(along).alias("_next"),
        F.sum("_c").over(whole).alias("n"), F.sum("_s").over(whole).alias("total"), F.min("_lo").over(whole).alias("lo"), F.max("_hi").over(whole).alias("hi"))
    # the bins to look into: those that hold a rank, the last one not above a number, and a first one for every group
    hit = F.col("_c0") == 0
    for r in ranks.values():
        hit |= F.coalesce((r >= F.col("_c0")) & (r < F.col("_c0") + F.col("_c")), F.lit(False))
    for e in below.values():
        at = magnitude_bin(e)
        hit |= F.coalesce((F.col("_bin") <= at) & F.coalesce(F.col("_next") > at, F.lit(True)), F.lit(False))
    facts = ("_c0", "_s0", "n", "total", "lo", "hi")
    inside = rows.select(*by, "_bin", "x", "c").join(bins.where(hit).select(*by, "_bin", *facts), [*by, "_bin"])
    counted = inside.groupBy(*by, "_bin", "x").agg(F.sum("c").alias("c"), *[F.first(c).alias(c) for c in facts])
    upto = Window.partitionBy(*by, "_bin").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumns({
        "_a": F.col("_c0") + F.coalesce(F.sum("c").over(upto), zero),
        "_u": F.col("_s0") + F.coalesce(F.sum(F.col("x") * F.col("c")).over(upto), none)})
    pick = [F.first(c).alias(c) for c in ("n", "total", "lo", "hi")]
    for name, r in ranks.items():
        own = (r >= F.col("_a")) & (r < F.col("_a") + F.col("c"))
        pick += [F.max(F.when(own, F.col("x"))).alias(name), F.max(F.when(own, F.col("_u") + F.col("x") * (r - F.col("_a")))).alias(f"{name}_under")]
    for name, e in below.items():
        smaller = F.col("x") < e
        upto_bin = F.col("_bin") <= magnitude_bin(e)
        count = F.when(upto_bin, F.when(smaller, F.col("_a") + F.col("c")).otherwise(F.col("_c0")))
        under = F.when(smaller, F.col("_u") + F.col("x") * F.col("c")).otherwise(F.col("_s0"))
        pick += [F.coalesce(F.max(count), zero).alias(f"{name}_count"), F.coalesce(F.max_by(under, count), none).alias(f"{name}_under")]
    return counted.groupBy(*by).agg(*pick)


def quantile_ranks(probs: dict[str, float]) -> dict[str, Column]:
    """The two ranks around each quantile."""
    out = {}
    for name, p in probs.items():
        h = (F.col("n") - 1) * F.lit(float(p))
        out[f"_{name}_a"], out[f"_{name}_z"] = F.floor(h), F.ceil(h)
    return out


def quantile(name: str, p: float) -> Column:
    """Linear interpolation between the two ranks."""
    h = (F.col("n") - 1) * F.lit(float(p))
    part = h - F.floor(h)
    low, high = F.col(f"_{name}_a"), F.col(f"_{name}_z")
    return F.when(part > 0, low + (high - low) * part).otherwise(low)


def ordered(values: DataFrame, by: Sequence[str]) -> DataFrame:
    """Single values (x, each one row) as a rising array ``_xs`` per group, with n and total as ``rank_facts`` has them.

    Null values come before all others: they count in n (``_nulls`` of them) and have ranks, but no value. Groups with a
    null name and groups without a value are left out, as by the joins of ``rank_facts``.
    """
    groups = values.groupBy(*by).agg(F.sort_array(F.collect_list("x")).alias("_xs"), F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"))
    named = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in by])
    return groups.where(named & (F.size("_xs") > 0)).withColumns({"_nulls": F.col("n") - F.size("_xs"), "hi": F.element_at("_xs", -1)})


def at_rank(rank: Column, array: str = "_xs") -> Column:
    """Value of a 0-based rank in a group of ``ordered``; null outside."""
    return F.get(array, (rank - F.col("_nulls")).cast("int"))


def quantile_of(p: float, array: str = "_xs") -> Column:
    """Linear interpolation between the two ranks in a group of ``ordered``."""
    h = (F.col("n") - 1) * F.lit(float(p))
    part, low = h - F.floor(h), at_rank(F.floor(h), array)
    return F.when(part > 0, low + (at_rank(F.ceil(h), array) - low) * part).otherwise(low)


def _sum_of(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def quantiles(values: DataFrame, by: Sequence[str], probs: dict[str, float], whole: bool = False) -> DataFrame:
    """Exact quantiles of counted values (x, c), one column for each of ``probs``; ``whole``: values of one row each, by key."""
    if whole:
        return ordered(values, by).select(*by, *[quantile_of(p).alias(n) for n, p in probs.items()])
    facts = rank_facts(values, by, quantile_ranks(probs))
    return facts.select(*by, *[quantile(n, p).alias(n) for n, p in probs.items()])


def shapes(values: DataFrame, by: Sequence[str], whole: bool = False) -> DataFrame:
    """Median ``med``, largest value ``hi`` and skewness ``skew`` of counted values (x, c); ``whole``: values of one row each, by key."""
    if whole:
        power = lambda k: _sum_of(F.transform("_xs", lambda x: reduce(lambda a, b: a * b, [x - F.col("total") / F.col("n")] * k)))
        n = F.col("n")
        skew = F.when(n > 2, F.sqrt(n * (n - 1.0)) / (n - 2) * F.try_divide(power(3) / n, F.pow(power(2) / n, F.lit(1.5))))
        return ordered(values, by).select(*by, "hi", quantile_of(0.5).alias("med"), skew.alias("skew"))
    medians = rank_facts(values, by, quantile_ranks({"m": 0.5})).select(*by, "hi", quantile("m", 0.5).alias("med"))
    moments = values.join(written(values.groupBy(*by).agg((F.sum(F.col("x") * F.col("c")) / F.sum("c")).alias("_m")), "means"), by)
    d = F.col("x") - F.col("_m")
    n = F.sum("c")
    skew = moments.groupBy(*by).agg(
        F.when(n > 2, F.sqrt(n * (n - 1.0)) / (n - 2) * F.try_divide(F.sum(d * d * d * F.col("c")) / n, F.pow(F.sum(d * d * F.col("c")) / n, 1.5))).alias("skew"))
    return medians.join(skew, by)


def ordered_distribution(groups: DataFrame, by: Sequence[str], probs: dict[str, float], cut: float = 0.1) -> DataFrame:
    """``distribution`` of the groups that ``ordered`` made; a group is one row, so nothing is joined."""
    n, mean, k = F.col("n"), F.col("total") / F.col("n"), F.floor(F.col("n") * cut)
    # groups whose median is a null value have no deviations
    g = groups.withColumn("_median", quantile_of(0.5)).where("_median IS NOT NULL")
    g = g.withColumn("_away", F.sort_array(F.transform("_xs", lambda x: F.abs(x - F.col("_median")))))

    def under(rank: Column) -> Column:
        return F.when(at_rank(rank).isNotNull(), _sum_of(F.slice("_xs", F.lit(1), (rank - F.col("_nulls")).cast("int"))))

    g = g.withColumns({"_less": F.filter("_xs", lambda x: x < mean), "_to": F.when(k == 0, F.col("total")).otherwise(under(n - k))})
    less = F.when(magnitude_bin(F.col("_xs")[0]) <= magnitude_bin(mean), F.col("_nulls") + F.size("_less")).otherwise(0)
    share = lambda x: F.try_divide(x, "total")
    shares = F.filter(F.transform("_xs", share), lambda s: s > 0)
    positive = F.filter("_xs", lambda x: x > 0)
    return g.select(
        *by, *[quantile_of(p).alias(name) for name, p in probs.items()],
        F.try_divide(F.col("_to") - under(k), n - 2 * k).alias("trimmed_mean"), (at_rank(n - k - 1) - at_rank(k)).alias("trimmed_range"),
        (2 * (mean * less - _sum_of(F.col("_less"))) / n).alias("mean_abs_dev"), F.try_divide(mean, "hi").alias("mean_to_peak"),
        F.when(F.size(shares) > 0, -_sum_of(F.transform(shares, lambda s: s * F.ln(s)))).alias("entropy"),
        F.exp(F.try_divide(_sum_of(F.transform(positive, F.ln)), F.size(positive))).alias("geometric_mean"),
        quantile_of(0.5, "_away").alias("median_abs_dev"))


def distribution(values: DataFrame, by: Sequence[str], probs: dict[str, float], cut: float = 0.1) -> DataFrame:
    """Quantiles, trimmed mean and range, mean and median absolute deviation, entropy and geometric mean of counted values.

    ``cut`` of the rows, rounded down, leaves at both ends. Entropy is that of the positive shares of the total; the
    geometric mean is that of the positive values.
    """
    n, mean = F.col("n"), F.col("total") / F.col("n")
    k = F.floor(n * cut)
    ends = {"_first": k, "_last": n - k - 1, "_next": n - k}
    facts = rank_facts(values, by, {**quantile_ranks({**probs, "_med": 0.5}), **ends}, {"_mean": mean})
    facts = facts.withColumn("_median", quantile("_med", 0.5))
    facts = facts.withColumns({"_kept": n - 2 * k, "_to": F.when(k == 0, F.col("total")).otherwise(F.col("_next_under"))})
    facts = facts.select(
        *by, *[quantile(name, p).alias(name) for name, p in probs.items()], n, "total", "_median",
        F.try_divide(F.col("_to") - F.col("_first_under"), F.col("_kept")).alias("trimmed_mean"), (F.col("_last") - F.col("_first")).alias("trimmed_range"),
        (2 * (mean * F.col("_mean_count") - F.col("_mean_under")) / n).alias("mean_abs_dev"), F.try_divide(mean, "hi").alias("mean_to_peak"))
    facts = written(facts, "distribution")
    joined = values.join(facts.select(*by, F.col("total").alias("_total"), "_median"), list(by))
    away = joined.select(*by, F.abs(F.col("x") - F.col("_median")).alias("x"), "c")
    share = F.try_divide("x", "_total")
    shape = joined.groupBy(*by).agg(
        (-F.sum(F.when(share > 0, share * F.ln(share) * F.col("c")))).alias("entropy"),
        F.exp(F.try_divide(F.sum(F.when(F.col("x") > 0, F.ln("x") * F.col("c"))), F.sum(F.when(F.col("x") > 0, F.col("c"))))).alias("geometric_mean"))
    out = facts.drop("n", "total", "_median").join(shape, list(by))
    return out.join(quantiles(away, by, {"median_abs_dev": 0.5}), list(by))
