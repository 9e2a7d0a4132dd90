"""Maintenance jobs: ordered steps over a bundle of frames, each job one batch run.

A bundle maps names to frames: memories, edges (src, dst, weight), heat (id, heat of the edges' ends), actions (user_id, ts,
event_type). A job returns the bundle after its steps and a frame of (step, rows) counts. Steps that read a whole frame
again take it from a table in the shared folder, so that plans do not grow from step to step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid.functions import vectors as V
from recallgrid.operators import graph, maintain, relate
from recallgrid.sources.shared import stored
from recallgrid.streaming.rollup import rollup

Bundle = dict[str, DataFrame]


def _counts(steps: dict[str, DataFrame]) -> DataFrame:
    out = None
    for step, rows in steps.items():
        one = rows.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(step).alias("step"), "rows")
        out = one if out is None else out.unionAll(one)
    return out


def duplicates(memories: DataFrame, similar: float = 0.95) -> DataFrame:
    """(id) of the colder of two similar memories of a store and directory, of equals the later one."""
    keyed = memories.withColumn("_key", F.concat_ws("\u0001", "store_type", "directory"))
    return relate.outranked(keyed, similar, "_key")


def promoted(memories: DataFrame, members: int = 3, sessions: int = 2, key: str = "label") -> DataFrame:
    """(key, members, sessions) of episodic clusters that recur often enough, in enough sessions, to become semantic."""
    found = memories.where("store_type = 'episodic' and heat > 0").groupBy(key).agg(F.count(F.lit(1)).alias("members"), F.count_distinct("session_id").alias("sessions"))
    return found.where((F.col("members") >= members) & (F.col("sessions") >= sessions))


def memify(bundle: Bundle) -> tuple[Bundle, DataFrame]:
    """Prune, strengthen, reweigh, derive."""
    kept = maintain.prune(bundle["memories"])
    edges = maintain.reweigh(bundle["edges"], bundle["heat"])
    facts = edges.where("weight >= 5").select("src", "dst", "weight")
    strong = kept.where("access_count > 5 and confidence > 0.8")
    changed = edges.join(bundle["edges"].select("src", "dst", F.col("weight").alias("_before")), ["src", "dst"]).where("weight <> _before")
    steps = {"pruned": bundle["memories"].join(kept.select("id"), "id", "left_anti"), "strengthened": strong, "reweighted": changed, "derived": facts}
    return bundle | {"memories": maintain.strengthen(kept), "edges": edges, "facts": facts}, _counts(steps)


def consolidate(bundle: Bundle, now: Column, similar: float = 0.95) -> tuple[Bundle, DataFrame]:
    """Decay, duplicates, memify, promotion, compression, action roll-up, in this order; order-bound causal discovery and
    episode cutting are operators of their own (``causal.pc``, ``ordered.episodes``).
    """
    before = bundle["memories"]
    warm = stored(maintain.decay(before, now), "decayed")
    doomed = stored(duplicates(warm, similar), "doomed")
    left = bundle | {"memories": stored(warm.join(doomed, "id", "left_anti"), "merged")}
    left, memified = memify(left)
    memories = stored(left["memories"], "memified")
    recurring = promoted(memories)
    shorter, archive = maintain.compress(memories, now)
    levels = shorter.groupBy("level").agg(F.count(F.lit(1)).alias("rows")).where("level > 0").select(F.concat(F.lit("compressed_"), F.col("level").cast("string")).alias("step"), "rows")
    actions = rollup(bundle["actions"], "user_id")
    stats = _counts({"decayed": warm.where("heat = 0"), "duplicates": doomed, "promoted": recurring, "action_memories": actions}).unionAll(memified).unionAll(levels)
    return left | {"memories": shorter.drop("level"), "archive": archive, "patterns": recurring, "action_memories": actions}, stats


def sleep(bundle: Bundle, now: Column, near: float = 0.3, pairs: int = 20, model: str | None = None, encoder=None) -> tuple[Bundle, DataFrame]:
    """Replay, communities, cluster summaries, new vectors for rows of another encoder, compression, narrative.

    Replay links the drawn pairs whose vectors are similar by ``near`` or more, with weight 0.5. Rows get new vectors where
    ``model`` is named and the column ``embedding_model`` is not that name.
    """
    memories = stored(bundle["memories"], "asleep")
    vectors = memories.select("id", "embedding")
    drawn = graph.dream_pairs(memories, pairs).join(vectors.toDF("a", "va"), "a").join(vectors.toDF("b", "vb"), "b")
    links = drawn.where(V.cosine(F.col("va"), F.col("vb")) >= near).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(0.5).alias("weight"))
    groups = graph.communities(bundle["edges"])
    first = F.slice(F.array_sort(F.collect_list(F.when(F.col("_rank") <= 3, F.struct("_rank", F.substring("content", 1, 100).alias("text"))))), 1, 3)
    ranked = memories.select("label", "content", F.row_number().over(_hottest("label")).alias("_rank"))
    summaries = ranked.groupBy("label").agg(F.array_join(F.transform(first, lambda x: x["text"]), " | ").alias("summary"))
    old = memories.where(F.col("embedding_model").isNull() | (F.col("embedding_model") != model)) if model and "embedding_model" in memories.columns else memories.limit(0)
    fresh = relate.embed(old.drop("embedding"), encoder=encoder)
    shorter, archive = maintain.compress(memories, now)
    story = maintain.narrative(memories)
    steps = {"replayed": links, "communities": groups.select("community").distinct(), "summaries": summaries, "reembedded": fresh, "compressed": shorter.where("level > 0"), "narratives": story}
    return bundle | {"links": links, "communities": groups, "summaries": summaries, "reembedded": fresh, "memories": shorter.drop("level"), "archive": archive, "narrative": story}, _counts(steps)


def _hottest(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(F.desc("heat"), "id")
