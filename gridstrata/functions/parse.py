"""Text to value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def damage_amount(text) -> Column:
    """``10K``, ``2.5M``, ``1B``, plain numbers; ``nan`` and null are 0. Cut to an integer."""
    t = _c(text)
    number = F.regexp_extract(t, r"^([0-9.]+)", 1).try_cast("double")
    unit = F.substring(t, -1, 1)
    factor = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)
    return F.coalesce((number * factor).cast("bigint"), F.lit(0).cast("bigint"))


def census_value(text) -> Column:
    """``%`` is divided by 100, ``Z`` is 0, ``S`` and other marks are null, ``$`` and ``,`` are dropped."""
    t = _c(text)
    number = F.regexp_replace(t, r"[$,%]", "").try_cast("double")
    return F.when(t == "Z", F.lit(0.0)).when(t.endswith("%"), number / 100).otherwise(number)


def fips(state, county) -> Column:
    return F.concat(F.lpad(_c(state).cast("string"), 2, "0"), F.lpad(_c(county).cast("string"), 3, "0"))


def flag_thunder(flag) -> Column:
    """Any 1 in the last two digits of the six-digit weather flag."""
    six = F.rpad(_c(flag).cast("string"), 6, "0")
    return F.substring(six, 5, 2).contains("1")


def stamp_from_parts(year_month, day, hour_minute) -> Column:
    text = F.concat(
        _c(year_month).cast("string"),
        F.lpad(_c(day).cast("string"), 2, "0"),
        F.lpad(_c(hour_minute).cast("string"), 4, "0"),
    )
    return F.to_timestamp(text, "yyyyMMddHHmm")


def letters_only(text) -> Column:
    return F.regexp_replace(_c(text), r"[^A-Za-z]", "")


def band_name(path) -> Column:
    """The part of a raster file name that starts with its survey kind and ends before ``.tif``; else the name."""
    found = F.regexp_extract(_c(path), r"((GRAV|MAG|RAD).*?)(\.tif|$)", 1)
    return F.when(found != "", found).otherwise(_c(path))


def fixed_width(line, fields: dict[str, tuple[int, int, str]]) -> dict[str, Column]:
    """Columns cut from a text line: name → (first character from 1, length, type)."""
    return {
        name: F.trim(F.substring(_c(line), first, length)).try_cast(kind)
        for name, (first, length, kind) in fields.items()
    }
