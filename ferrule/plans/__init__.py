"""Queries over the driver's tables, each with the SQL that says the same."""

from ferrule.plans import binaries, folders, parts, rules, scalars, scans  # noqa: F401
from ferrule.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
