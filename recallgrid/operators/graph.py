"""Entity graph: adjacency, as-of edges, spreading activation, personalised PageRank, components, gaps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallgrid.operators.components import components as linked
from recallgrid.sources.shared import discard, stored


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of (src, dst, weight)."""
    return edges.select("src", "dst", "weight").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def named(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with the names of both ends."""
    a = entities.select(F.col("id").alias("src"), F.col("name").alias("src_name"))
    b = entities.select(F.col("id").alias("dst"), F.col("name").alias("dst_name"))
    return edges.join(a, "src").join(b, "dst")


def as_of(edges: DataFrame, when: Column) -> DataFrame:
    """The latest edge of each pair with event_time up to ``when``."""
    w = Window.partitionBy("src", "dst").orderBy(F.desc("event_time"), "id")
    return edges.where(F.col("event_time") <= when).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def partners(edges: DataFrame, node: int, k: int = 10) -> DataFrame:
    """(dst, weight): neighbours of a node by summed weight."""
    return undirected(edges).where(F.col("src") == node).groupBy("dst").agg(F.sum("weight").alias("weight")).orderBy(F.desc("weight"), "dst").limit(k)


def spread(edges: DataFrame, seeds: DataFrame, depth: int = 2, decay: float = 0.5) -> DataFrame:
    """(id, activation): decay to the power of the least number of steps from a seed, up to ``depth``."""
    both = undirected(edges).select("src", "dst").distinct()
    reached = seeds.select("id", F.lit(1.0).alias("activation"))
    front = reached
    for _ in range(depth):
        front = front.join(both, front["id"] == both["src"]).select(F.col("dst").alias("id"), (F.col("activation") * decay).alias("activation")).groupBy("id").agg(F.max("activation").alias("activation"))
        reached = reached.unionAll(front)
    return reached.groupBy("id").agg(F.max("activation").alias("activation"))


def page_rank(edges: DataFrame, seeds: DataFrame, alpha: float = 0.85, rounds: int = 200, tolerance: float = 1e-10, local_edges: int = 200_000) -> DataFrame:
    """(id, rank): personalised PageRank on the undirected weighted graph; dangling mass returns to the seeds.

    Where two edges join the same pair the larger weight counts. Rounds end when the ranks change by ``tolerance`` in all,
    or after ``rounds``. A graph of at most ``local_edges`` directed edges is walked in one task; a larger one by joins, with
    every fifth round's ranks written to the shared folder, so that neither plan nor lineage grows. Without seeds all is 0.
    """
    both = undirected(edges).groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    out = both.groupBy("src").agg(F.sum("weight").alias("total"))
    share = both.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share"))
    nodes = both.select(F.col("src").alias("id")).unionAll(seeds.select("id")).distinct()
    size = seeds.agg(F.count(F.lit(1)).alias("n"))
    start = nodes.join(seeds.select("id", F.lit(1.0).alias("s")).distinct(), "id", "left").select("id", F.coalesce(F.try_divide(F.coalesce("s", F.lit(0.0)), size.scalar()), F.lit(0.0)).alias("seed"))
    start = start.join(out.select(F.col("src").alias("id"), F.lit(False).alias("ends")), "id", "left").select("id", "seed", F.coalesce("ends", F.lit(True)).alias("ends"))
    share, start = stored(share, "shares"), stored(start, "seeds")
    if share.count() <= local_edges:
        return _walked(share, start, alpha, rounds, tolerance)
    ranks, last = start.select("id", "seed", "ends", F.col("seed").alias("rank")), None
    for turn in range(1, rounds + 1):
        sent = share.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("ends"), F.col("rank"))), F.lit(0.0)).alias("lost")).scalar()
        joined = start.join(sent.withColumnRenamed("dst", "id"), "id", "left").join(ranks.select("id", F.col("rank").alias("old")), "id")
        turned = joined.select("id", "seed", "ends", (alpha * (F.coalesce("got", F.lit(0.0)) + lost * F.col("seed")) + (1 - alpha) * F.col("seed")).alias("rank"), "old")
        if turn % 5:
            ranks = turned.drop("old")
            continue
        ranks = stored(turned, "ranks")
        discard(last)
        last = ranks
        if ranks.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] <= tolerance:
            break
    return ranks.select("id", "rank")


def _walked(share: DataFrame, start: DataFrame, alpha: float, rounds: int, tolerance: float) -> DataFrame:
    """``page_rank`` of a graph whose size has been checked, in one task."""
    kind = start.schema["id"].dataType
    rows = share.select(F.col("src").alias("id"), "dst", "share", F.lit(None).cast("double").alias("seed"), F.lit(None).cast("boolean").alias("ends"))
    rows = rows.unionAll(start.select("id", F.lit(None).cast(kind).alias("dst"), F.lit(None).cast("double").alias("share"), "seed", "ends")).withColumn("all", F.lit(0))

    def walk(graph: pd.DataFrame) -> pd.DataFrame:
        nodes = graph[graph["seed"].notna()].sort_values("id", ignore_index=True)
        links = graph[graph["share"].notna()]
        at = pd.Series(np.arange(len(nodes)), index=nodes["id"])
        src, dst, weight = at[links["id"]].to_numpy(), at[links["dst"]].to_numpy(), links["share"].to_numpy(float)
        seed, ends = nodes["seed"].to_numpy(float), nodes["ends"].to_numpy(bool)
        rank = seed
        for _ in range(rounds):
            turned = alpha * (np.bincount(dst, rank[src] * weight, len(nodes)) + rank[ends].sum() * seed) + (1 - alpha) * seed
            moved, rank = np.abs(turned - rank).sum(), turned
            if moved <= tolerance:
                break
        return pd.DataFrame({"id": nodes["id"], "rank": rank})

    return rows.groupBy("all").applyInPandas(walk, T.StructType([T.StructField("id", kind), T.StructField("rank", T.DoubleType())]))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id that is reached, for every end of an edge (long ids), whatever the length of the paths."""
    found = linked(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    least = found.groupBy("component").agg(F.min("node").alias("least"))
    return found.join(least, "component").select(F.col("node").alias("id"), F.col("least").alias("component"))


def missing_links(pairs: DataFrame, edges: DataFrame, least: int = 2) -> DataFrame:
    """Pairs (src, dst, n) that occur together ``least`` times or more without an edge in either direction."""
    known = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return pairs.where(F.col("n") >= least).join(known, ["src", "dst"], "left_anti")


def isolated(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree, severity) of entities with at most one edge."""
    degree = undirected(edges).groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    joined = entities.join(degree, entities["id"] == degree["src"], "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))
    return joined.where("degree <= 1").select("id", "degree", F.when(F.col("degree") == 0, 0.6).otherwise(0.4).alias("severity"))


def paths(edges: DataFrame, start: int, depth: int = 3) -> DataFrame:
    """(id, depth, path): directed walks from ``start`` that never visit a node twice, up to ``depth`` steps."""
    front = edges.where(F.col("src") == start).select(F.col("dst").alias("id"), F.lit(1).alias("depth"), F.array("src", "dst").alias("path"))
    out = front
    for d in range(2, depth + 1):
        step = edges.select("src", "dst")
        front = front.join(step, (front["id"] == step["src"]) & ~F.array_contains(front["path"], step["dst"])).select(F.col("dst").alias("id"), F.lit(d).alias("depth"), F.concat("path", F.array("dst")).alias("path"))
        out = out.unionAll(front)
    return out


def transitions(events: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """(src, dst, n): counts of a state following another within a key."""
    w = Window.partitionBy(key).orderBy(*order)
    return events.select(F.lag(state).over(w).alias("src"), F.col(state).alias("dst")).where("src is not null").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def order_votes(events: DataFrame, key: str, kind: str, ts: str, least: int = 3) -> DataFrame:
    """(a, b, before, after) of kinds a < b: in how many keys a first stands before, or after, b; pairs of ``least`` keys or more.

    Kinds of a key are few; ties in time do not vote.
    """
    first = events.groupBy(key, kind).agg(F.min(ts).alias("t"))
    both = first.select(key, F.col(kind).alias("a"), F.col("t").alias("ta")).join(first.select(key, F.col(kind).alias("b"), F.col("t").alias("tb")), key).where("a < b and ta <> tb")
    votes = both.groupBy("a", "b").agg(F.count_if(F.col("ta") < F.col("tb")).alias("before"), F.count_if(F.col("ta") > F.col("tb")).alias("after"))
    return votes.where(F.col("before") + F.col("after") >= least)


def stochastic(counts: DataFrame) -> DataFrame:
    """Counts over the sum of their source."""
    return counts.select("src", "dst", (F.col("n") / F.sum("n").over(Window.partitionBy("src"))).alias("p"))


def successors(chances: DataFrame, gamma: float = 0.9, terms: int = 20) -> DataFrame:
    """(src, dst, m): the series of gamma**t T**t, t from 0 to ``terms``, as terms of total = 1 + gamma T total: one join a term.

    Every fourth total is written to the shared folder, so that the plan stays short.
    """
    nodes = chances.select(F.col("src").alias("n")).unionAll(chances.select(F.col("dst").alias("n"))).distinct()
    one = stored(nodes.select(F.col("n").alias("src"), F.col("n").alias("dst"), F.lit(1.0).alias("m")), "ones")
    step = stored(chances.select("src", F.col("dst").alias("mid"), "p"), "steps")
    total = one
    for t in range(1, terms + 1):
        moved = step.join(total.select(F.col("src").alias("mid"), "dst", "m"), "mid").select("src", "dst", (F.col("p") * F.col("m") * gamma).alias("m"))
        total = moved.unionByName(one).groupBy("src", "dst").agg(F.sum("m").alias("m"))
        if t % 4 == 0:
            total = stored(total, "total")
    return total


def successors_from(chances: DataFrame, seeds: DataFrame, gamma: float = 0.9, terms: int = 8) -> DataFrame:
    """(id, m): discounted visits of the states that follow ``seeds`` (id), over ``terms`` steps; the seeds themselves left out."""
    step = stored(chances.select("src", "dst", "p"), "steps")
    start = stored(seeds.select("id", F.lit(1.0).alias("m")), "starts")
    total = start
    for t in range(1, terms + 1):
        moved = step.join(total.select(F.col("id").alias("src"), "m"), "src").select(F.col("dst").alias("id"), (F.col("p") * F.col("m") * gamma).alias("m"))
        total = moved.unionByName(start).groupBy("id").agg(F.sum("m").alias("m"))
        if t % 4 == 0:
            total = stored(total, "total")
    return total.join(start.select("id"), "id", "left_anti")


def communities(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, community): label spreading by summed weight, a node's own label with its strongest edge's weight, ties to the
    least label; deterministic. It ends when no label changes, or after ``rounds`` where labels keep swinging.
    """
    both = stored(undirected(edges), "edges")
    own = both.groupBy("src").agg(F.max("weight").alias("weight")).select("src", F.col("src").alias("dst"), "weight")
    both = stored(both.unionByName(own), "edges")
    labels = stored(both.select(F.col("src").alias("id")).distinct().withColumn("community", F.col("id")), "labels")
    for _ in range(rounds):
        seen = both.join(labels.select(F.col("id").alias("dst"), "community"), "dst").groupBy("src", "community").agg(F.sum("weight").alias("w"))
        best = seen.groupBy("src").agg(F.min(F.struct((-F.round("w", 6)).alias("w"), "community"))["community"].alias("community"))
        last, labels = labels, stored(best.withColumnRenamed("src", "id"), "labels")
        same = labels.join(last, ["id", "community"], "left_anti").isEmpty()
        discard(last)
        if same:
            break
    return labels


def neighbourhood(edges: DataFrame, start: int, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes with their least depth, edges between them) within ``depth`` undirected steps of ``start``."""
    both = undirected(edges).select("src", "dst").distinct()
    front = edges.sparkSession.createDataFrame([(start, 0)], "id long, depth int")
    reached = front
    for d in range(1, depth + 1):
        front = front.select("id").join(both, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().withColumn("depth", F.lit(d))
        reached = reached.unionAll(front)
    nodes = reached.groupBy("id").agg(F.min("depth").alias("depth"))
    inside = edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return nodes, inside


def dream_pairs(memories: DataFrame, pairs: int = 20, salt: int = 1) -> DataFrame:
    """(a, b): disjoint pairs of memories in the order of a digest, the sampling step of replay; 2 * ``pairs`` rows leave the scan."""
    order = F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(salt))))
    drawn = memories.select("id", order.alias("o")).orderBy("o", "id").limit(2 * pairs)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("o", "id")) - 1  # of 2 * pairs rows
    placed = drawn.withColumn("r", rank).withColumn("pair", F.floor(F.col("r") / 2))
    return placed.groupBy("pair").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count(F.lit(1)).alias("n")).where("n = 2").select("a", "b")
