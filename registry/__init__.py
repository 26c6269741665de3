"""All registered queries and their SQL."""

from registry import activity, features, models, profiling, splitting, tables  # noqa: F401  (registers its queries)
from registry.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
