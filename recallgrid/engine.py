"""An engine over stored tables: open, insert, update, forget, recall, maintain, close."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.operators import lifecycle, maintain, recall
from recallgrid.operators.store import Store, updated


class Engine:
    """Tables under ``root`` in a folder that all executors share. Every call is one batch job; ``now`` is always given."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)
        if not self.store.version("processes"):
            empty = self.store.read("processes")
            self.store.write("processes", lifecycle.domain_processes(empty.select("name", "decay", "kinds")))

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *error) -> None:
        self.close()

    def close(self) -> None:
        """Nothing is held open: tables are complete after every call. The session belongs to the caller."""

    def memories(self) -> DataFrame:
        return self.store.read("memories")

    def insert(self, rows: DataFrame) -> None:
        self.store.insert_memories(rows)

    def update(self, changes: DataFrame, columns: list[str]) -> None:
        self.store.write("memories", updated(self.memories(), changes, columns))

    def forget(self, gone: DataFrame) -> None:
        self.store.forget(gone)

    def recall(self, text: str, query: list[float], k: int = 5, min_heat: float = 0.1) -> DataFrame:
        """(id, score) of the k best memories."""
        m = self.memories().join(self.store.read("vectors").select("id", "embedding"), "id", "left").withColumn("label", F.lit(0))
        m = recall.gathered(m)
        return recall.recall(m, recall.mentioned(m), text, query, k, min_heat)

    def decay_entities(self, now: Column) -> None:
        self.store.write("entities", lifecycle.decayed_entities(self.store.read("entities"), now))

    def validate(self, files: DataFrame) -> None:
        self.store.write("memories", maintain.validated(self.memories(), files))
