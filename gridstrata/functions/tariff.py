"""Energy prices and loads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hours of the dear tariff (of the stamp moved back by 15 minutes), both prices per kWh, share of the
# load that stays in use, extra load in kWh per quarter hour.
RUSH_HOURS = (18, 19, 20, 21)
RUSH_PRICE = 0.35
BASE_PRICE = 0.2
PARTY_SHARE = 0.3
PARTY_EXTRA = 0.5


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def price(hour, rush: float = RUSH_PRICE, base: float = BASE_PRICE) -> Column:
    return F.when(_c(hour).isin(*RUSH_HOURS), rush).otherwise(base)


def party_load(energy, extra: float = PARTY_EXTRA) -> Column:
    return _c(energy) * PARTY_SHARE + extra


def temperature_weight(temp) -> Column:
    """Sample weight, larger for colder hours."""
    t = _c(temp)
    return F.when(t < 0, 4.0).when(t < 5, 3.0).when(t < 10, 2.0).otherwise(1.0)
