"""Importing this package registers every query."""

from natal.catalog import exposures, fitted, joins, models, panels, pipelines, recodes, tables  # noqa: F401
from natal.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
