"""Calendar columns of a stamp. All take a column (or its name) and return a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Holidays of the building year as MM-DD.
HOLIDAYS_MM_DD = (
    "01-01",
    "01-15",
    "02-19",
    "05-28",
    "07-04",
    "09-03",
    "10-08",
    "11-11",
    "11-12",
    "11-22",
    "12-25",
)

# First and last hour of the hour bands; hour 0 belongs to 22_24.
HOUR_BANDS = ((1, 6), (7, 8), (9, 11), (12, 14), (15, 18), (19, 21), (22, 24))

# Season codes by 30-day months since the start of the year.
SEASON_BANDS = ((0, 0.0, 2.5), (1, 2.5, 4.0), (2, 4.0, 6.0), (3, 6.0, 8.5), (4, 8.5, 10.5), (0, 10.5, 12.0))

# Time-of-use tariff slots; all other hours are off-peak (0).
MID_PEAK_HOURS = (13, 14, 15)
ON_PEAK_HOURS = (16, 17, 18, 19)


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def mm_dd(ts) -> Column:
    return F.date_format(_c(ts), "MM-dd")


def hh_mm(ts) -> Column:
    return F.date_format(_c(ts), "HH:mm")


def quarter_of_day(ts) -> Column:
    return F.hour(_c(ts)) * 4 + F.floor(F.minute(_c(ts)) / 15).cast("int")


def is_weekend(ts) -> Column:
    return F.weekday(_c(ts)) >= 5


def is_holiday(ts, days=HOLIDAYS_MM_DD) -> Column:
    return mm_dd(ts).isin(*days)


def seconds_since(ts, origin: str = "2018-01-01 00:00:00") -> Column:
    return F.unix_timestamp(_c(ts)) - F.unix_timestamp(F.to_timestamp(F.lit(origin)))


def season_by_seconds(seconds) -> Column:
    """0 winter, 1 early spring, 2 spring, 3 summer, 4 autumn; 0 outside the year. The first band that fits wins."""
    unit = 30 * 24 * 3600
    out = None
    for code, start, stop in SEASON_BANDS:
        inside = _c(seconds).between(int(start * unit), int(stop * unit))
        out = F.when(inside, code) if out is None else out.when(inside, code)
    return out.otherwise(0)


def season_name(month) -> Column:
    m = _c(month)
    return (
        F.when(m.isin(12, 1, 2), "Winter")
        .when(m.isin(3, 4, 5), "Spring")
        .when(m.isin(6, 7, 8), "Summer")
        .otherwise("Autumn")
    )


def season_cold_hot_mild(month) -> Column:
    m = _c(month)
    return F.when(m.isin(12, 1, 2), 0).when(m.isin(6, 7, 8), 1).otherwise(2)


def hour_band(hour) -> Column:
    h = _c(hour)
    out = F.when(h == 0, "22_24")
    for first, last in HOUR_BANDS:
        out = out.when(h.between(first, last), f"{first}_{last}")
    return out


def day_period(hour) -> Column:
    h = _c(hour)
    return (
        F.when(h.between(1, 6), "night")
        .when(h.between(7, 11), "morning")
        .when(h.between(11, 14), "noon")
        .when(h.between(14, 19), "afternoon")
        .otherwise("evening")
    )


def time_of_day(hour) -> Column:
    h = _c(hour)
    return (
        F.when((h >= 5) & (h < 12), "Morning")
        .when(h.between(12, 15), "Afternoon")
        .when((h > 15) & (h <= 19), "Evening")
        .otherwise("Night")
    )


def time_of_use(hour) -> Column:
    h = _c(hour)
    return F.when(h.isin(*MID_PEAK_HOURS), 1).when(h.isin(*ON_PEAK_HOURS), 2).otherwise(0)


def week_of_month(ts) -> Column:
    return F.floor((F.dayofmonth(_c(ts)) + 6) / 7).cast("int")


def cyclic(col, period: float) -> dict[str, Column]:
    angle = _c(col) * (2 * F.pi() / F.lit(float(period)))
    return {"sin": F.sin(angle), "cos": F.cos(angle)}


def base_columns(ts: str = "ts") -> dict[str, Column]:
    """The calendar columns shared by the profile operators."""
    t = F.col(ts)
    return {
        "day": F.date_trunc("day", t),
        "month": F.month(t),
        "week": F.weekofyear(t),
        "weekday": F.weekday(t),
        "hour": F.hour(t),
        "weekend": is_weekend(t).cast("int"),
        "season": season_cold_hot_mild(F.month(t)),
        "tou": time_of_use(F.hour(t)),
        "holiday": is_holiday(t).cast("int"),
    }


def minutes_to_sun_event(ts, lat, lon) -> dict[str, Column]:
    """Minutes from the stamp (UTC) to dawn, sunrise, noon, sunset and dusk of its day.

    Declination and equation of time by the usual trigonometric series of the day angle; dawn and dusk at 6 degrees
    below the horizon. Null where the sun does not cross the height on that day.
    """
    t = _c(ts)
    day_angle = (F.dayofyear(t) - 1) * (2 * F.pi() / F.lit(365.0))
    decl = (
        F.lit(0.006918)
        - 0.399912 * F.cos(day_angle)
        + 0.070257 * F.sin(day_angle)
        - 0.006758 * F.cos(2 * day_angle)
        + 0.000907 * F.sin(2 * day_angle)
    )
    equation = 229.18 * (
        F.lit(0.000075)
        + 0.001868 * F.cos(day_angle)
        - 0.032077 * F.sin(day_angle)
        - 0.014615 * F.cos(2 * day_angle)
        - 0.040849 * F.sin(2 * day_angle)
    )
    phi = F.radians(_c(lat))
    now = F.hour(t) * 60 + F.minute(t) + F.second(t) / 60.0
    noon = F.lit(720.0) - 4 * _c(lon) - equation

    def half_day(height: float) -> Column:
        x = (F.sin(F.radians(F.lit(height))) - F.sin(phi) * F.sin(decl)) / (F.cos(phi) * F.cos(decl))
        return F.when(F.abs(x) <= 1, 4 * F.degrees(F.acos(x)))

    rise, twilight = half_day(-0.833), half_day(-6.0)
    return {
        "to_dawn": noon - twilight - now,
        "to_sunrise": noon - rise - now,
        "to_noon": noon - now,
        "to_sunset": noon + rise - now,
        "to_dusk": noon + twilight - now,
    }
