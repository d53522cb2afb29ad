"""Registered queries over the given tables, one module per operator family."""

from gridstrata.plans import (  # noqa: F401
    cleaning, cubes, joining, models, moving, profiles, reshaping, scalars, scans, scoring, signals, spaces, storms, streams,
)
from gridstrata.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
