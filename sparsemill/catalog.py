"""The reference operators' queries by name, and the SQL they must agree with."""

from __future__ import annotations

from .queries import graph, models, params, text  # noqa: F401  they register their queries
from .queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
