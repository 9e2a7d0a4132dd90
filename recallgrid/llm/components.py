"""Connected components of an edge table, as the engine has them."""

from recallgrid.operators.components import components

__all__ = ["components"]
