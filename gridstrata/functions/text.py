"""Words of narratives."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keyword sets of event narratives.
KEYWORDS = {
    "wind_and_storm": (
        "blowing", "blown", "cyclone", "gust", "gusts", "hurricane", "storm", "storms", "sustained", "tempest",
        "thunderstorm", "thunderstorms", "tornado", "tornados", "wind", "winds",
    ),
    "downed_trees": (
        "blown", "branches", "broken", "down", "downed", "fallen", "fell", "limbs", "snapped", "tree", "trees",
        "uprooted",
    ),
    "heavy_damage": (
        "accident", "collapse", "crash", "damage", "damaged", "destruction", "devastated", "devastating", "emergency",
        "extreme", "heavy", "major", "numerous", "several", "widespread", "severe", "strong", "terrible", "wreckage",
    ),
    "wires": (
        "blackout", "electrical", "knocked", "lines", "outage", "poles", "power", "transformer", "wire", "wires",
        "blocked",
    ),
    "water_and_flood": (
        "creek", "flood", "flooded", "flooding", "inundated", "overflow", "precipitation", "rain", "rainfall",
        "river", "stormwater", "water", "waters",
    ),
    "heat_and_fire": (
        "arid", "blaze", "burning", "drought", "dry", "fire", "heat", "hot", "scorching", "wildfire",
    ),
    "snow": (
        "accumulation", "accumulations", "blizzard", "cold", "feet", "freezing", "ice", "inches", "inches.", "sleet",
        "snow", "snow.", "snowed", "snowfall",
    ),
}

# The most common English function words, left out of word counts.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "had", "has", "have", "he", "in", "is",
    "it", "its", "of", "on", "or", "that", "the", "their", "there", "they", "this", "to", "was", "were", "which",
    "with",
)


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def tokens(text) -> Column:
    """Pieces between white space, empty ones dropped."""
    return F.filter(F.split(_c(text), r"[ \t\n\r]+"), lambda w: w != "")


def content_words(text, stop: Iterable[str] = STOP_WORDS) -> Column:
    return F.filter(tokens(F.lower(_c(text))), lambda w: ~w.isin(*stop))


def keyword_count(text, words: Iterable[str]) -> Column:
    """Number of tokens that belong to the set."""
    return F.size(F.filter(tokens(text), lambda w: w.isin(*words)))
