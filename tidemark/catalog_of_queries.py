"""Every registered query of the engine's own operators, with its SQL oracle."""

from .plans import functions, relational, retrieval, writes  # noqa: F401  (they register themselves)
from .plans.registry import QUERIES, SQL

FLAGSHIP = "r5_hybrid_fusion"

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
