"""Registered queries with their SQL oracles."""

from netvigil.plans import cleaning, correlation, detection, models, sources, storage, streams, training  # noqa: F401
from netvigil.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
