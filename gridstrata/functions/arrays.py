"""Array columns: row statistics, class probabilities.

An expression used inside a lambda is evaluated once per element, so intermediate results are bound with ``let``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.transform(F.array(value), body)[0]


def total(arr) -> Column:
    return F.aggregate(_c(arr), F.lit(0.0), lambda acc, v: acc + v)


def mean(arr) -> Column:
    return total(arr) / F.size(_c(arr))


def std_pop(arr) -> Column:
    a = _c(arr)

    def spread(m: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + (v - m) * (v - m))

    return F.sqrt(let(mean(a), spread) / F.size(a))


def zscores(arr) -> Column:
    def scale(t: Column) -> Column:
        return F.transform(
            t["a"], lambda v: F.when(t["s"] > 0, (v - t["m"]) / t["s"]).otherwise(F.lit(0.0))
        )

    a = _c(arr)
    return let(F.struct(a.alias("a"), mean(a).alias("m"), std_pop(a).alias("s")), scale)


def despike(arr, limit: float) -> Column:
    """Values with a row z-score beyond the limit become the mean of the others of the row."""
    a = _c(arr)

    def fill(kept: Column) -> Column:
        level = mean(F.filter(kept, lambda v: v.isNotNull()))
        return let(level, lambda m: F.transform(kept, lambda v: F.coalesce(v, m)))

    kept = F.zip_with(a, zscores(a), lambda v, s: F.when(F.abs(s) <= limit, v))
    return let(kept, fill)


def minmax(arr) -> Column:
    def scale(t: Column) -> Column:
        span = t["hi"] - t["lo"]
        return F.transform(t["a"], lambda v: F.when(span > 0, (v - t["lo"]) / span).otherwise(F.lit(0.0)))

    a = _c(arr)
    return let(F.struct(a.alias("a"), F.array_min(a).alias("lo"), F.array_max(a).alias("hi")), scale)


def argmax(arr) -> Column:
    """Position of the largest value from 0, the first of several."""
    a = _c(arr)
    return F.array_position(a, F.array_max(a)) - 1


def threshold_argmax(probs, thresholds: list[float]) -> Column:
    """Argmax of what exceeds the class thresholds; plain argmax where nothing does."""
    p = _c(probs)
    over = F.zip_with(p, F.array(*[F.lit(t) for t in thresholds]), lambda v, t: F.greatest(v - t, F.lit(0.0)))
    return let(over, lambda o: F.when(F.array_max(o) > 0, argmax(o)).otherwise(argmax(p)))


def softmax(arr) -> Column:
    a = _c(arr)

    def share(powers: Column) -> Column:
        return let(total(powers), lambda s: F.transform(powers, lambda v: v / s))

    powers = let(F.array_max(a), lambda peak: F.transform(a, lambda v: F.exp(v - peak)))
    return let(powers, share)


def softmax_blocks(arr, blocks: list[tuple[int, int]]) -> Column:
    """Softmax inside each block of positions (first from 0, length)."""
    a = _c(arr)
    return F.concat(*[softmax(F.slice(a, first + 1, length)) for first, length in blocks])
