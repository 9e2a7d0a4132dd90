"""All queries of the engine and the SQL that each is held against."""

from recallgrid.plans import extra_queries, graph_queries, more_queries, recall_queries, row_queries, store_queries  # noqa: F401  (they register their queries)
from recallgrid.plans.memory_queries import ORACLES, QUERIES

FLAGSHIP = "i1_recall"
__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
