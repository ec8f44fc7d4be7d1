"""The queries that SQL can express, as DuckDB SQL."""

from sitegrid.plans import queries
from sitegrid.plans.core import ORACLES

__all__ = ["ORACLES", "queries"]
