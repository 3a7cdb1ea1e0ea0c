"""Queries over the given tables, one module per operator family. Importing a module registers its queries."""

from tidepanel.plans import audits, deliveries, effects, forecasts, grain, launches, panel, scoring, streams  # noqa: F401
from tidepanel.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
