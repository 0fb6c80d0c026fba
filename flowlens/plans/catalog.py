"""Imports every plan module so that all queries are registered."""

from flowlens.plans import checks, detector, eda, explain, labels, learning, marts, models, quality  # noqa: F401
from flowlens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
