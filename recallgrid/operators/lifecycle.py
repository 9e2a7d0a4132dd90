"""Steps of a memory's and a session's life: graph building, reconsolidation, links, checkpoints, restoring, gaps, idle jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.functions import patterns as P
from recallgrid.functions import scoring as S
from recallgrid.operators import graph, search

# What makes a micro-checkpoint.
CRITICAL_TAGS = ("critical", "important", "architecture", "breaking")


# Entities and edges
def entity_scan(entities: DataFrame, min_heat: float = 0.0, archived: bool = False) -> DataFrame:
    """Entities of some heat; archived ones only if asked for."""
    rows = entities.where(F.col("heat") >= min_heat)
    return rows if archived else rows.where(~F.col("archived"))


def decayed_entities(entities: DataFrame, now: Column, factor: float = 0.95, cold: float = 0.05) -> DataFrame:
    """Entities after the hours since their last access; cold ones get heat 0 and are archived."""
    heat = F.col("heat") * F.pow(F.lit(factor), F.greatest(S.hours_between(F.col("last_accessed"), now), F.lit(0.0)))
    gone = heat < cold
    live = entities.where(~F.col("archived"))
    return live.withColumns({"heat": F.when(gone, 0.0).otherwise(heat), "archived": gone}).unionByName(entities.where("archived"))


def reinforced(entities: DataFrame, hits: DataFrame, step: float = 0.1, key: str = "id") -> DataFrame:
    """Entities with ``step`` more heat for each of their ``hits`` (key), up to 1."""
    n = hits.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return entities.join(n, key, "left").withColumn("heat", F.least(F.lit(1.0), F.col("heat") + step * F.coalesce("_n", F.lit(0)))).drop("_n")


def upserted_edges(edges: DataFrame, pairs: DataFrame, kind: str, weight: float = 1.0) -> DataFrame:
    """Edges (src, dst, kind, weight) after each of ``pairs`` (src, dst): an edge between the two, in either direction and of
    any kind, gains 1 for each pair, the strongest one if there are several; a pair without one gets an edge of ``kind``.
    """
    one = lambda rows: rows.withColumns({"_a": F.least("src", "dst"), "_b": F.greatest("src", "dst")})
    seen = one(pairs.select("src", "dst")).groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_n"))
    first = F.row_number().over(Window.partitionBy("_a", "_b").orderBy(F.desc("weight"), "kind", "src", "dst"))
    known = one(edges.select("src", "dst", "kind", "weight")).withColumn("_first", first == 1).join(seen, ["_a", "_b"], "full_outer")
    gained = F.when(F.col("_first"), F.col("weight") + F.coalesce("_n", F.lit(0))).otherwise(F.col("weight"))
    fresh = F.col("src").isNull()
    return known.select(
        F.when(fresh, F.col("_a")).otherwise(F.col("src")).alias("src"), F.when(fresh, F.col("_b")).otherwise(F.col("dst")).alias("dst"),
        F.when(fresh, F.lit(kind)).otherwise(F.col("kind")).alias("kind"), F.when(fresh, weight + F.col("_n") - 1.0).otherwise(gained).alias("weight"),
    )


def episode_graph(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) of episodes' names (id, name, kind, context): a name's first kind by (id, kind); heat 1 at birth; edges
    of co-occurrence between names of one episode by their episodes, and "imports" from a name to the first module of its text.
    """
    one = found.groupBy("id", "name").agg(F.min("kind").alias("kind"))
    kinds = one.groupBy("name").agg(F.min(F.struct("id", "kind")).alias("k"), F.count(F.lit(1)).alias("episodes"))
    entities = kinds.select("name", F.col("k.kind").alias("kind"), F.lit(1.0).alias("heat"), "episodes")
    pairs = one.select("id", F.col("name").alias("src")).join(one.select("id", F.col("name").alias("dst")), "id").where("src < dst")
    together = pairs.groupBy("src", "dst").agg(F.lit("co_occurrence").alias("kind"), F.count(F.lit(1)).cast("double").alias("weight"))
    module = found.where("kind = 'dependency'").groupBy("id").agg(F.min("name").alias("dst"))
    used = found.where("context = 'imports'").join(module, "id").where("name <> dst")
    imports = used.groupBy(F.col("name").alias("src"), "dst").agg(F.lit("imports").alias("kind"), F.count_distinct("id").cast("double").alias("weight"))
    return entities, together.unionByName(imports)


def memory_links(edges: DataFrame, pairs: DataFrame, kind: str = "derived_from", weight: float = 1.0) -> DataFrame:
    """``upserted_edges`` between memories (a, b), which stand in the graph as entities "memory:<id>"."""
    named = pairs.select(F.concat(F.lit("memory:"), "a").alias("src"), F.concat(F.lit("memory:"), "b").alias("dst"))
    return upserted_edges(edges, named, kind, weight)


def dreamed(pairs: DataFrame, edges: DataFrame, link: float = 0.4, insight: float = 0.7) -> DataFrame:
    """(a, b, cosine, action) of pairs not yet connected: "insight" (and a link of weight 0.5) over ``insight``, "link" over ``link``."""
    known = edges.select(F.least("src", "dst").alias("_a"), F.greatest("src", "dst").alias("_b")).distinct()
    ends = [F.concat(F.lit("memory:"), c) for c in ("a", "b")]
    fresh = pairs.withColumns({"_a": F.least(*ends), "_b": F.greatest(*ends)}).join(known, ["_a", "_b"], "left_anti")
    action = F.when(F.col("cosine") > insight, "insight").when(F.col("cosine") > link, "link")
    return fresh.where(F.col("cosine") > link).select("a", "b", "cosine", action.alias("action"))


# Reconsolidation
def reconsolidated(memories: DataFrame, context: Column, mismatch: Column, now: Column, directory: Column) -> tuple[DataFrame, DataFrame]:
    """(memories, archives) after each memory met ``context``: updated ones hold both texts, archived ones leave their content in
    the archive and are replaced by the context, at heat 1 in ``directory``; the count of reconsolidations grows by one for both.
    """
    rows = memories.withColumn("_m", F.round(mismatch, 6))
    rows = rows.withColumn("action", S.reconsolidation(F.col("_m"), F.col("stability"), F.col("plasticity"), F.col("is_protected")))
    archive = rows.where("action = 'archive'").select("id", "content", F.col("_m").alias("mismatch"), F.lit("extinction").alias("reason"), now.alias("archived_at"))
    changed, replaced = F.col("action") != "none", F.col("action") == "archive"
    new = rows.withColumns({
        "content": F.when(replaced, context).when(F.col("action") == "update", merged_text(F.col("content"), context)).otherwise(F.col("content")),
        "directory": F.when(replaced, directory).otherwise(F.col("directory")),
        "heat": F.when(replaced, 1.0).otherwise(F.col("heat")),
        "reconsolidations": F.coalesce("reconsolidations", F.lit(0)) + changed.cast("int"),
    })
    return new.drop("_m"), archive


def merged_text(old: Column, new: Column) -> Column:
    """Both texts, a line each; beyond 2,000 characters the first 500 of each."""
    long = F.length(old) + F.length(new) + 1 > 2000
    return F.when(long, F.concat_ws("\n", F.substring(old, 1, 500), F.substring(new, 1, 500))).otherwise(F.concat_ws("\n", old, new))


# Checkpoints
def active_checkpoints(checkpoints: DataFrame) -> DataFrame:
    """The latest active checkpoint of each session."""
    return search.top_by(checkpoints.where("active"), ["session"], 1, "created_at").drop("rank")


def drained(checkpoints: DataFrame, directory: str, now: Column) -> DataFrame:
    """Checkpoints of each session before a compaction: the epoch rises by one; the active checkpoint takes it, or, if it lags by
    more than one or is missing, a captured one is added with a new id.
    """
    epoch = checkpoints.groupBy("session").agg((F.max("epoch") + 1).alias("_epoch"), F.max("id").alias("_last"))
    latest = active_checkpoints(checkpoints).select(F.col("id").alias("_active"), "session", F.col("epoch").alias("_own"))
    plan = epoch.join(latest, "session", "left").withColumn("_fresh", F.col("_own").isNull() | (F.col("_own") < F.col("_epoch") - 1))
    moved = checkpoints.join(plan, "session").withColumn("epoch", F.when((F.col("id") == F.col("_active")) & ~F.col("_fresh"), F.col("_epoch")).otherwise(F.col("epoch"))).select(*checkpoints.columns)
    base = checkpoints.agg(F.max("id").alias("m")).scalar()
    added = plan.where("_fresh").select(
        (base + F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("session"))).cast("long").alias("id"), "session", F.lit(directory).alias("directory"),
        F.lit("[auto-captured before compaction]").alias("task"), F.col("_epoch").alias("epoch"), F.lit(True).alias("active"), now.alias("created_at"),
    )
    return moved.unionByName(added.select(*checkpoints.columns))


def micro_checkpoint(content: Column, tags: Column, surprisal: Column, calls: Column, cooldown: int = 5) -> Column:
    """Why a store makes a micro-checkpoint: error, decision, surprise over 0.8, or a critical tag; null during the cooldown and else."""
    marked = F.arrays_overlap(F.transform(tags, lambda t: F.lower(t)), F.array(*map(F.lit, CRITICAL_TAGS)))
    why = F.when(content.rlike(P.ERROR_WORDS), "error_detected").when(content.rlike(P.DECISION_WORDS), "decision_made").when(surprisal > 0.8, "high_surprise_event").when(marked, "critical_tag")
    return F.when(calls >= cooldown, why)


def anchored(rows: DataFrame, reason: str) -> DataFrame:
    """Rows as anchors: hot, important, protected, tagged, and prefixed with the reason."""
    return rows.withColumns({
        "tags": F.array_union("tags", F.array(F.lit("_anchor"))), "heat": F.lit(1.0), "importance": F.lit(1.0), "is_protected": F.lit(True),
        "content": F.concat(F.lit(f"[ANCHOR: {reason}] "), "content"),
    })


def restored(memories: DataFrame, directory: str | None, predicted: DataFrame | None = None, k: int = 10, hot: float = 0.7) -> DataFrame:
    """(id, part) of what a session starts from: anchored, recent, hot (of the directory) and predicted memories, k of each at
    most, a memory in the first part that has it.
    """
    live, anchor = memories.where("heat > 0"), F.array_contains("tags", "_anchor")
    newest = lambda rows: search.top(rows.select("id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("at")), k, "at").select("id")
    first = newest(live.where(F.col("is_protected") & anchor))
    recent = newest(live.where(~F.col("is_protected") & ~anchor))
    place = live.where(F.col("heat") >= hot) if directory is None else live.where((F.col("heat") >= hot) & (F.col("directory") == directory))
    seen = first.unionAll(recent)
    warm = search.top(place.join(seen, "id", "left_anti").select("id", "heat"), k, "heat").select("id")
    tag = lambda rows, part: rows.select("id", F.lit(part).alias("part"))
    out = tag(first, "anchored").unionAll(tag(recent, "recent")).unionAll(tag(warm, "hot"))
    if predicted is not None:
        likely = search.top(predicted.join(seen.unionAll(warm), "id", "left_anti"), k // 2, "score").select("id")
        out = out.unionAll(tag(likely, "predicted"))
    return out


# Gaps
def gaps(memories: DataFrame, entities: DataFrame, edges: DataFrame, mentions: DataFrame) -> DataFrame:
    """(kind, subject, severity) of five kinds of gaps in what is known.

    isolated_entity (at most one edge), stale_region (by directory: two or more live memories under heat 0.3),
    low_confidence (by directory: live memories under 0.5), missing_connection (names together in two or more memories without an
    edge) and one_sided_knowledge (errors without a resolved_by edge). entities: name, kind; edges: src, dst, kind by name.
    """
    plain = edges.select("src", "dst", F.lit(1.0).alias("weight"))
    alone = graph.isolated(entities.select(F.col("name").alias("id")), plain.groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    parts = [alone.select(F.lit("isolated_entity").alias("kind"), F.col("id").alias("subject"), F.col("severity"))]
    live = memories.where("heat > 0").groupBy("directory").agg(F.count_if(F.col("heat") < 0.3).alias("cold"), F.count_if(F.col("confidence") < 0.5).alias("unsure"))
    parts.append(live.where("cold >= 2").select(F.lit("stale_region").alias("kind"), F.col("directory").alias("subject"), F.least(F.lit(0.9), 0.3 + F.col("cold") * 0.1).alias("severity")))
    parts.append(live.where("unsure >= 1").select(F.lit("low_confidence").alias("kind"), F.col("directory").alias("subject"), F.least(F.lit(0.8), 0.3 + F.col("unsure") * 0.1).alias("severity")))
    one = mentions.join(memories.where("heat > 0").select("id"), "id", "left_semi").select("id", "name").distinct()
    pairs = one.select("id", F.col("name").alias("src")).join(one.select("id", F.col("name").alias("dst")), "id").where("src < dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    missing = graph.missing_links(pairs, edges.select("src", "dst"))
    parts.append(missing.select(F.lit("missing_connection").alias("kind"), F.concat_ws(" + ", "src", "dst").alias("subject"), F.least(F.lit(0.7), 0.2 + F.col("n") * 0.1).alias("severity")))
    solved = edges.where("kind = 'resolved_by'").select(F.col("src").alias("name")).distinct()
    errors = entities.where("kind = 'error'").join(solved, "name", "left_anti")
    parts.append(errors.select(F.lit("one_sided_knowledge").alias("kind"), F.col("name").alias("subject"), F.lit(0.5).alias("severity")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("kind", "subject", F.round("severity", 6).alias("severity"))


# Jobs
def idle_jobs(last_seen: DataFrame, now: Column, idle: int = 300, rest_hours: float = 6.0, key: str = "session_id") -> DataFrame:
    """(key, idle_seconds, consolidate, sleep) by the seconds since the last activity (``at``) and the hours since the last sleep
    (``slept``, null for never): a session that idles consolidates, one that idles twice as long sleeps too, if it has not of late.
    """
    seconds = F.unix_seconds(now) - F.unix_seconds(F.col("at").cast("timestamp"))
    rested = F.col("slept").isNull() | (S.hours_between(F.col("slept"), now) >= rest_hours)
    return last_seen.select(key, seconds.alias("idle_seconds"), (seconds > idle).alias("consolidate"), ((seconds > 2 * idle) & rested).alias("sleep"))


def domain_processes(existing: DataFrame) -> DataFrame:
    """(name, decay, kinds): the processes of all domains; those that exist stay as they are."""
    rows = [(name, float(decay), ",".join(sorted(kinds))) for name, _, kinds, decay in P.DOMAINS]
    return existing.unionByName(existing.sparkSession.createDataFrame(rows, "name string, decay double, kinds string").join(existing.select("name"), "name", "left_anti"))


def domain_consolidation(memories: DataFrame, processes: DataFrame) -> DataFrame:
    """(name, n, heat, kept): memories by domain, their mean heat, and how many keep some warmth after the domain's own decay."""
    voted = memories.where("heat > 0").select("id", "heat", F.explode(S.domains(F.col("content"), F.col("tags"))).alias("name"))
    joined = voted.join(processes.select("name", "decay"), "name")
    return joined.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("heat"), 6).alias("heat"), F.count_if(F.round(F.col("heat") * F.pow(F.lit(0.95), F.col("decay")), 6) >= 0.05).alias("kept"))


def checked_triggers(triggers: DataFrame, kinds: tuple[str, ...] = ("directory_match", "keyword_match", "entity_match", "time_based")) -> DataFrame:
    """Triggers with ``problem``: an unknown kind, an empty condition, or a time that is no clock or weekday; null where sound."""
    timed = F.col("condition").rlike(r"^(\d{1,2}:\d{2}|weekday:[0-6])$")
    problem = F.when(~F.col("kind").isin(*kinds), "unknown kind").when(F.trim(F.coalesce("condition", F.lit(""))) == "", "no condition").when((F.col("kind") == "time_based") & ~timed, "no time")
    return triggers.withColumn("problem", problem)


def context_lines(memories: DataFrame, directory: str, k: int = 10) -> DataFrame:
    """(rank, line): the hottest memories of a directory as lines of a session's context."""
    best = search.top(memories.where((F.col("directory") == directory) & (F.col("heat") > 0)).select("id", "content", "heat"), k, "heat")
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("heat"), "id"))  # at most k rows
    line = F.concat(F.lit("- ["), F.format_number("heat", 2), F.lit("] "), F.substring(F.regexp_replace("content", r"\s+", " "), 1, 120))
    return best.select(rank.alias("rank"), line.alias("line"))
