"""Ingest of new memories: every step is a column of the batch; one append writes it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid.functions import extract as X
from recallgrid.functions import patterns as P
from recallgrid.functions import scoring as S
from recallgrid.operators.relate import MOST_BLOCKS, TILE, block_count, embed, mentions, spread, tiles, unit_rows

# What the write gate always lets pass.
PASS_ERRORS = r"(?i)\b(error|exception|traceback|failed|bug|crash)\b"
PASS_DECISIONS = r"(?i)\b(decided|chose|switched to|migrated|architecture)\b"
PASS_TAGS = ("important", "critical")
BYPASS_TAGS = ("important", "remember", "decision", "critical")


def nearest_known(batch: DataFrame, known: DataFrame, block: int = 1024, most: int = MOST_BLOCKS) -> DataFrame:
    """(id, near_id, cosine) of each new row's most similar known row of its directory, ties to the least id.

    New and known rows of a directory are dealt into blocks of about ``block``, at most ``most`` of each, which then grow with the
    rows; a new and a known block meet tile by tile, and only the best of each new row leaves the task. A row travels at most
    ``most`` times.
    """
    batch, known = (rows.where("embedding is not null").select("id", "directory", "embedding") for rows in (batch, known))
    sizes = block_count(batch, "directory", block, most, "_is").join(block_count(known, "directory", block, most, "_js"), "directory")

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        """A row for each block of the other side in the row's directory."""
        placed = rows.join(sizes, "directory").withColumn(own, F.pmod(F.xxhash64("id"), F.col(f"_{own}s")).cast("int"))
        return placed.select("directory", "id", "embedding", own, F.explode(F.sequence(F.lit(0), F.col(f"_{other}s") - 1)).alias(other))

    keys = ["directory", "i", "j"]
    new = dealt(batch, "i", "j").select(*keys, "id", "embedding")
    old = dealt(known, "j", "i").select(*keys, "id", "embedding")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, found, near = left.column("id").to_numpy(), np.zeros(0), np.zeros(0, np.int64)
        if len(left) and len(right):
            numbers = right.column("id").to_numpy()
            order = np.argsort(numbers, kind="stable")
            numbers, x, y = numbers[order], unit_rows(left.column("embedding")), unit_rows(right.column("embedding"))[order]
            found, near = np.full(len(x), -np.inf), np.zeros(len(x), np.int64)
            for r, c in tiles(len(x), len(y), TILE):
                cosine = x[r] @ y[c].T
                at = np.argmax(np.round(cosine, 6, out=cosine), axis=1)  # the first of equals has the least id
                top = cosine[np.arange(len(at)), at]
                better = top > found[r]
                near[r][better], found[r][better] = numbers[c][at[better]], top[better]
        return pa.table({"id": ids[: len(found)], "near_id": near, "cosine": found})

    met = spread(new, *keys).groupBy(*keys).cogroup(spread(old, *keys).groupBy(*keys)).applyInArrow(best, "id long, near_id long, cosine double")
    top = met.groupBy("id").agg(F.max(F.struct("cosine", (-F.col("near_id")).alias("n"))).alias("m"))
    return top.select("id", (-F.col("m.n")).alias("near_id"), F.col("m.cosine").alias("cosine"))


def _nearest_anywhere(batch: DataFrame, known: DataFrame, block: int) -> DataFrame:
    """``nearest_known`` over all directories."""
    everywhere = lambda rows: rows.select(F.col("id").alias("id"), F.lit("").alias("directory"), F.col("embedding").alias("embedding"))
    return nearest_known(everywhere(batch), everywhere(known), block)


def curate(batch: DataFrame, known: DataFrame, merge: float = 0.85, link: float = 0.6, overlap: float = 0.5, block: int = 1024) -> DataFrame:
    """The batch with action, near_id and cosine: ``merge`` where the nearest known row is that similar and shares more than
    ``overlap`` of the words, ``link`` from ``link`` on, else ``create``. Rows of both: id, content, embedding.
    """
    near = _nearest_anywhere(batch, known, block)
    texts = known.select(F.col("id").alias("near_id"), F.col("content").alias("_near"))
    words = lambda c: F.array_distinct(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"))
    shared = S.jaccard(words(F.col("content")), words(F.col("_near")))
    action = F.when((F.col("cosine") >= merge) & (shared > overlap), "merge").when(F.col("cosine") >= link, "link").otherwise("create")
    rows = batch.join(near, "id", "left").join(texts, "near_id", "left").withColumn("action", action).drop("_near")
    return rows.withColumn("near_id", F.when(F.col("action") != "create", F.col("near_id")))


def write_gate(batch: DataFrame, known: DataFrame, names: DataFrame, relations: DataFrame, now: Column, continuity: Column | None = None, block: int = 1024) -> DataFrame:
    """id, vector, entity, topic, structure (four novelties), surprisal, stored and reason of each new row.

    batch: id, content, directory, tags, embedding; known: the same with heat and created_at. names: known entity names;
    relations: known kinds of relations (``context``). A row of a directory without known rows has surprisal 0.8. Topic
    novelty is 0.1, 0.3 or 0.7 by the hours since a known row of some heat held one of the row's names. Errors, decisions
    and marked tags pass; others need a surprisal of 0.4, lowered by 0.15 of the task's continuity (0 to 1), at least 0.1.
    """
    found = X.typed_entities(batch, "id", "content")
    listed = names.select("name").distinct()
    kinds = relations.select("context").distinct().withColumn("_old", F.lit(True))
    judged = found.join(listed.withColumn("_known", F.lit(True)), "name", "left").join(kinds, "context", "left")
    own = judged.groupBy("id").agg(
        F.avg(F.when(F.col("_known"), 0.0).otherwise(1.0)).alias("entity"), F.max((F.col("context") != "") & F.col("_old").isNull()).alias("_new")
    )
    spoken = found.select("id", "name").unionAll(mentions(batch, listed)).distinct()
    every = listed.unionAll(found.select("name")).distinct()
    latest = mentions(known.where("heat > 0"), every).join(known.select("id", "created_at"), "id").groupBy("name").agg(F.max("created_at").alias("seen"))
    seen = spoken.join(latest, "name").groupBy("id").agg(F.max("seen").alias("seen"))
    places = known.select("directory").distinct().withColumn("_place", F.lit(True))
    rows = batch.join(_nearest_anywhere(batch, known, block).select("id", "cosine"), "id", "left").join(own, "id", "left").join(seen, "id", "left").join(places, "directory", "left")
    hours = S.hours_between(F.col("seen"), now)
    signals = {
        "vector": F.when(F.col("cosine").isNull(), 0.8).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("cosine")))),
        "entity": F.coalesce("entity", F.lit(0.5)),
        "topic": F.when(F.col("seen").isNull(), 0.7).when(hours < 1, 0.1).when(hours < 24, 0.3).otherwise(0.7),
        "structure": F.when(F.col("_new"), 0.8).otherwise(0.2),
    }
    rows = rows.withColumns(signals)
    weighted = 0.4 * F.col("vector") + 0.25 * F.col("entity") + 0.2 * F.col("topic") + 0.15 * F.col("structure")
    surprisal = F.round(F.when(F.col("_place"), weighted).otherwise(0.8), 6)
    least = F.greatest(F.lit(0.1), 0.4 - 0.15 * (F.lit(0.0) if continuity is None else continuity))
    marked = F.arrays_overlap(F.transform("tags", lambda t: F.lower(t)), F.array(*map(F.lit, PASS_TAGS)))
    reason = F.when(F.col("content").rlike(PASS_ERRORS), "error").when(F.col("content").rlike(PASS_DECISIONS), "decision").when(marked, "tag").when(F.col("surprisal") >= least, "surprising").otherwise("expected")
    return rows.withColumn("surprisal", surprisal).withColumn("reason", reason).select("id", "vector", "entity", "topic", "structure", "surprisal", (F.col("reason") != "expected").alias("stored"), "reason")


def remember(batch: DataFrame, known: DataFrame, now: Column, gate: float = 0.25, merge: float = 0.85, link: float = 0.6, encoder=None) -> DataFrame:
    """The batch with embedding, importance, valence, class, domains, surprise, surprisal, action and near_id.

    batch: id, content, directory, tags. known: id, content, directory, embedding (of equal size). action is ``skip`` for
    rows under the gate (0.40 vector novelty, 0.25 names, 0.20 directory, 0.15 length; decisions, errors and marked tags
    pass), ``merge`` for near rows whose words overlap by half, ``link`` or ``create``. Ids of the two are distinct.
    """
    rows = embed(batch.select("id", "content", "directory", "tags"), encoder=encoder)
    near = nearest_known(rows, known)
    texts = known.select(F.col("id").alias("near_id"), F.col("content").alias("_near"))
    places = known.select("directory").distinct().withColumn("_seen", F.lit(True))
    rows = rows.join(near, "id", "left").join(texts, "near_id", "left").join(places, "directory", "left")
    words = lambda c: F.array_distinct(F.split(F.lower(c), r"\s+"))
    overlap = F.when(F.col("_near").isNotNull(), S.jaccard(words(F.col("content")), words(F.col("_near")))).otherwise(0.0)
    novelty = F.when(F.col("cosine").isNull(), 0.5).otherwise(1 - F.col("cosine"))
    names = X.query_entities(F.col("content"))
    fresh = F.when(F.col("_near").isNull(), 1.0).otherwise(F.size(F.array_except(names, X.query_entities(F.col("_near")))) / F.greatest(F.size(names), F.lit(1)))
    surprisal = 0.40 * novelty + 0.25 * fresh + 0.20 * F.when(F.col("_seen"), 0.0).otherwise(1.0) + 0.15 * F.least(F.length("content") / 500, F.lit(1.0))
    bypass = F.col("content").rlike(P.DECISION_WORDS) | F.col("content").rlike(P.ERROR_WORDS) | F.arrays_overlap("tags", F.array(*map(F.lit, BYPASS_TAGS)))
    action = F.when(~bypass & (surprisal < gate), "skip").when((F.col("cosine") >= merge) & (overlap > 0.5), "merge").when(F.col("cosine") >= link, "link").otherwise("create")
    return rows.select(
        "id", "content", "directory", "tags", "embedding", S.importance(F.col("content"), F.col("tags")).alias("importance"), S.valence(F.col("content")).alias("valence"),
        S.memory_class(F.col("content"), F.col("tags")).alias("store_type"), S.domains(F.col("content"), F.col("tags")).alias("domains"), F.round(novelty, 6).alias("surprise"),
        F.round(surprisal, 6).alias("surprisal"), action.alias("action"), F.when(action.isin("merge", "link"), F.col("near_id")).alias("near_id"), now.alias("created_at"), S.surprise_boost(F.lit(0.7), novelty).alias("heat"),
    )


def remember_stream(stream: DataFrame, path: str, checkpoint: str, now: Column, **options):
    """Each micro-batch is compared with the table at ``path`` and appended to it; a repeated batch replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        schema = "id long, content string, directory string, embedding array<double>"
        known = spark.read.schema(schema + ", batch long").option("basePath", path).parquet(path).where(F.col("batch") < number).select("id", "content", "directory", "embedding")
        remember(batch, known, now, **options).where("action <> 'skip'").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
