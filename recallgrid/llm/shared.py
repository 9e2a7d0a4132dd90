"""Tables in the folder that driver and executors share."""

from recallgrid.sources.shared import discard, shared_root, stored

__all__ = ["discard", "shared_root", "stored"]
