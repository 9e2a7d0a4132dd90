"""Batch maintenance: each step maps one snapshot of memories, edges or facts to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.functions import extract as X
from recallgrid.functions import patterns as P
from recallgrid.functions import scoring as S


def decay(memories: DataFrame, now: Column) -> DataFrame:
    """Heat after the hours since the last access."""
    hours = S.hours_between(F.col("last_accessed"), now)
    return memories.withColumn("heat", S.decayed_heat(F.col("heat"), hours, F.col("importance"), F.col("valence"), F.col("confidence")))


def prune(memories: DataFrame, heat: float = 0.01, confidence: float = 0.3) -> DataFrame:
    return memories.where(~((F.col("heat") < heat) & (F.col("confidence") < confidence) & (F.col("access_count") == 0)))


def strengthen(memories: DataFrame) -> DataFrame:
    raised = F.least(F.col("importance") + 0.1, F.lit(1.0))
    return memories.withColumn("importance", F.when((F.col("access_count") > 5) & (F.col("confidence") > 0.8), raised).otherwise(F.col("importance")))


def validated(memories: DataFrame, files: DataFrame, path: str = "directory") -> DataFrame:
    """Memories marked stale where the file at their ``path`` has another hash now; those of unknown files stay as they are."""
    now = files.select(F.col("path").alias(path), F.col("hash").alias("_hash"))
    stale = F.when(F.col("_hash").isNull(), F.col("is_stale")).otherwise(F.coalesce(F.col("file_hash") != F.col("_hash"), F.lit(True)))
    return memories.join(now, path, "left").withColumn("is_stale", stale).drop("_hash")


def reweigh(edges: DataFrame, heat: DataFrame) -> DataFrame:
    """Edges between hot ends (mean over 0.7, weight 5 or more) gain 0.5; between cold ends (under 0.1) lose a tenth, not below 0.1."""
    a, b = heat.select(F.col("id").alias("src"), F.col("heat").alias("_a")), heat.select(F.col("id").alias("dst"), F.col("heat").alias("_b"))
    mean = (F.col("_a") + F.col("_b")) / 2
    weight = F.when((mean > 0.7) & (F.col("weight") >= 5), F.col("weight") + 0.5).when(mean < 0.1, F.greatest(F.col("weight") * 0.9, F.lit(0.1))).otherwise(F.col("weight"))
    return edges.join(a, "src").join(b, "dst").withColumn("weight", weight).drop("_a", "_b")


def gist(memories: DataFrame, share: float = 0.3, text: str = "content") -> DataFrame:
    """(id, gist): the first, the last and the best-scored sentences, a ``share`` of all, in their order."""
    parts = memories.select("id", F.posexplode(X.sentences(F.col(text))).alias("pos", "s"))
    w = Window.partitionBy("id")
    ranked = parts.withColumn("rank", F.row_number().over(w.orderBy(F.desc(S.sentence_score(F.col("s"))), "pos"))).withColumn("n", F.count(F.lit(1)).over(w))
    kept = ranked.where((F.col("pos") == 0) | (F.col("pos") == F.col("n") - 1) | (F.col("rank") <= F.ceil(F.col("n") * share)))
    return kept.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("p")).select("id", F.array_join(F.transform("p", lambda x: x["s"]), " ").alias("gist"))


def compress(memories: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(memories with content by level, archive of the contents replaced): level 1 the gist, level 2 a tag line."""
    age = S.hours_between(F.col("created_at"), now)
    level = S.compression_level(age, F.col("importance"), F.col("surprise"), F.col("confidence"), F.col("access_count"), F.col("store_type"), F.col("is_protected"))
    levelled = memories.withColumn("level", level)
    short = levelled.join(gist(levelled.where("level = 1")), "id", "left")
    tag = F.substring(F.concat_ws(" | ", F.array_join("tags", ","), F.substring("content", 1, 120)), 1, 199)
    content = F.when(F.col("level") == 1, F.coalesce("gist", "content")).when(F.col("level") == 2, tag).otherwise(F.col("content"))
    return short.withColumn("content", content).drop("gist"), levelled.where("level > 0").select("id", "content", F.lit("compressed").alias("reason"), now.alias("archived_at"))


def decompress(memories: DataFrame, archive: DataFrame) -> DataFrame:
    """Contents from the earliest archive entry of each id."""
    first = archive.groupBy("id").agg(F.min_by("content", "archived_at").alias("_first"))
    return memories.join(first, "id", "left").withColumn("content", F.coalesce("_first", "content")).drop("_first")


def narrative(memories: DataFrame, period: str = "day") -> DataFrame:
    """(directory, period, n, decisions, events): first sentences that decide something, and those that name an error or success."""
    rows = memories.select("directory", F.date_trunc(period, "created_at").alias("period"), "id", F.explode(X.sentences(F.col("content"))).alias("s"))
    picked = lambda p: F.array_sort(F.collect_set(F.when(F.col("s").rlike(p), F.substring("s", 1, 120))))
    return rows.groupBy("directory", "period").agg(F.count_distinct("id").alias("n"), F.array_join(picked(P.DECISION_WORDS), "; ").alias("decisions"), F.array_join(picked(P.SUCCESS_WORDS), "; ").alias("events"))


def consensus(memories: DataFrame, query: str, similarity: Column, k: int = 5) -> DataFrame:
    """(id, score): best domain score of 0.6 similarity + 0.4 heat, weighted by the query's domain words, and 15 % more for each further domain."""
    import re

    weight = F.lit(1.0)
    for name, words, _, _ in P.DOMAINS:
        weight = F.when(F.col("domain") == name, 1.0 + 0.5 * len(re.findall(words, query))).otherwise(weight)
    votes = memories.where("heat > 0").select("id", (0.6 * similarity + 0.4 * F.col("heat")).alias("base"), F.explode(S.domains(F.col("content"), F.col("tags"))).alias("domain"))
    best = votes.select("id", (F.col("base") * weight).alias("s")).groupBy("id").agg(F.max("s").alias("s"), F.count(F.lit(1)).alias("n"))
    return best.select("id", F.round(F.col("s") * (1 + 0.15 * (F.col("n") - 1)), 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def cycle(memories: DataFrame, now: Column) -> DataFrame:
    """The ordered steps of one maintenance run on memories: decay, prune, strengthen, class."""
    out = strengthen(prune(decay(memories, now)))
    return out.withColumn("store_type", S.memory_class(F.col("content"), F.col("tags")))
