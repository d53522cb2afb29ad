"""Gridstrata: energy, outage and earth-table analytics as plain Spark DataFrame functions."""

from gridstrata.session import build_session, configure

__all__ = ["build_session", "configure"]
