"""All queries over the engine's operators, and their SQL."""

from heddle.plans import analytics, files, indexes, more, parts, readmodels, stored  # noqa: F401  they register their queries
from heddle.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
