"""Tumbling roll-up of actions, the same expression for batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rollup(actions: DataFrame, key: str, minutes: int = 30, least: int = 3, ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """(key, start, n, kinds, summary) of windows with ``least`` actions or more. Kinds are few, so their set is small."""
    kinds = F.array_sort(F.collect_set(kind))
    out = actions.groupBy(key, F.window(ts, f"{minutes} minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"), kinds.alias("k"))
    return out.where(F.col("n") >= least).select(key, F.col("w.start").alias("start"), "n", F.size("k").cast("long").alias("kinds"), F.array_join("k", ", ").alias("summary"))


def rollup_stream(actions: DataFrame, key: str, late: str = "1 hour", **options) -> DataFrame:
    """The roll-up of a stream: a window is given out once the watermark has passed it. Append mode."""
    return rollup(actions.withWatermark(options.get("ts", "ts"), late), key, **options)
