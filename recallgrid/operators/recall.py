"""Hybrid recall: nine signals of one query, gated convex fusion, heat filter and lexical rerank, as one operator.

Signals: vector (nearest), fts (BM25 of boosted terms), ppr (PageRank of names from those in the query), spread (activation
from the names of the nearest memories), hopfield (softmax over the hottest), fractal (memory and cluster similarity), hdc
(hypervectors, over the candidates of the others), sr (successor proximity over the order of visits) and temporal (dates,
months and sessions named in the query). Every signal is a bounded pool of rows; a signal without rows has no say.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.functions import extract as X
from recallgrid.functions import patterns as P
from recallgrid.functions import vectors as V
from recallgrid.operators import fusion, graph, ordered, search
from recallgrid.sources.shared import stored

# Month names in their order.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
SIGNALS = ("vector", "fts", "ppr", "spread", "hopfield", "fractal", "hdc", "sr", "temporal")


@dataclass(frozen=True)
class RecallSettings:
    """pool: rows of a signal for each result asked for. signals: those that run. rerank: share of the lexical score."""

    pool: int = 20
    signals: tuple[str, ...] = SIGNALS
    weights: dict[str, float] = field(default_factory=lambda: {**fusion.WEIGHTS, "fts": 0.5, "temporal": 0.8})
    beta: float = 8.0
    rerank: float = 0.15
    dims: int = 2048


def boosted_terms(text: str) -> dict[str, float]:
    """Weights of a query's words for BM25: 3 for capitalised, 2 for content words, 1 for others."""
    out: dict[str, float] = {}
    for raw in re.findall(r"[A-Za-z][\w'.-]*", text):
        word = raw.strip(".,'")
        weight = 1.0 if len(word) <= 1 or word.lower() in P.QUERY_STOPS else 3.0 if word[0].isupper() else 2.0
        for part in re.split(r"[^\w]+|_", word.lower()):
            if part:
                out[part] = out.get(part, 0.0) + weight
    return out


def query_names(text: str) -> list[str]:
    """Names in a query, in lower case: words that begin with a capital, and files, dotted names and errors."""
    words = [w.strip(".,;:!?()[]{}\"'") for w in text.split()]
    found = [w for w in words if len(w) > 1 and (w[0].isupper() or "." in w or "_" in w) and w.lower() not in P.QUERY_STOPS]
    return sorted({w.lower() for w in found})


def name_edges(mentions: DataFrame) -> DataFrame:
    """(src, dst, weight): names that stand in the same memory, by the number of such memories. Names of a memory are few."""
    one = mentions.select("id", "name").distinct()
    pairs = one.select("id", F.col("name").alias("src")).join(one.select("id", F.col("name").alias("dst")), "id").where("src < dst")
    return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def _best(scores: DataFrame, k: int, scale: bool = True) -> DataFrame:
    """(id, score) of the k best, as shares of the best one if ``scale``; equal sixths of decimals are ties."""
    rows = search.top(scores.where("score > 0").select("id", F.round("score", 6).alias("score")).where("score > 0"), k, "score")
    if not scale:
        return rows
    return rows.withColumn("score", F.col("score") / F.max("score").over(Window.partitionBy(F.lit(0))))  # at most k rows


def named_scores(mentions: DataFrame, weights: DataFrame, total: bool) -> DataFrame:
    """(id, score): sum, or else largest, of the weights (id as a name, score) of the names that a memory holds."""
    rows = mentions.select("id", "name").distinct().join(weights.select(F.col("id").alias("name"), "score"), "name")
    return rows.groupBy("id").agg((F.sum if total else F.max)("score").alias("score"))


def temporal(memories: DataFrame, text: str, k: int) -> DataFrame:
    """(id, score): memories that hold a date, month or session of the query, newest first, by 1 / rank; those created in a
    month of the query get at least 0.5.
    """
    low = text.lower()
    months = [m for m in MONTHS if re.search(rf"\b{m}\b", low)]
    hints = months + re.findall(r"\b\d{4}-\d{2}-\d{2}\b", low) + re.findall(r"\bsession \d+\b", low)
    none = memories.select("id", F.lit(0.0).alias("score")).limit(0)
    if not hints:
        return none
    held = F.lit(False)
    for h in hints:
        held = held | F.contains(F.lower("content"), F.lit(h))
    found = search.top(memories.where(held).select("id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("at")), k, "at")
    out = found.select("id", (1 / F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("at"), "id"))).alias("score"))  # at most k rows
    if months:
        numbers = [MONTHS.index(m) + 1 for m in months]
        own = search.top(memories.where(F.month("created_at").isin(numbers)).select("id", "heat"), k, "heat").select("id", F.lit(0.5).alias("score"))
        out = out.unionAll(own).groupBy("id").agg(F.max("score").alias("score"))
    return out


def signals(memories: DataFrame, mentions: DataFrame, visits: DataFrame | None, text: str, query: list[float], pool: int, min_heat: float, settings: RecallSettings) -> DataFrame:
    """(query_id, id, signal, score) of every signal that runs; memories: id, content, heat, embedding, created_at, and
    label, directory, tags, store_type for fractal and hdc. mentions: (id, name). visits: (key, ts, id), the order of visits.
    """
    wanted, parts = settings.signals, {}
    mentions = stored(mentions.select("id", "name").distinct(), "mentions")  # read by several signals, and far smaller than the texts
    hot = memories.where(F.col("heat") >= min_heat)
    near = stored(search.nearest(memories, query, pool, min_heat), "near")
    parts["vector"] = near.select("id", F.col("similarity").alias("score"))
    if "fts" in wanted:
        parts["fts"] = _best(search.bm25(memories, boosted_terms(text), pool).select("id", F.col("bm25").alias("score")), pool)
    seen = mentions.join(hot.select("id"), "id", "left_semi") if min_heat > 0 else mentions
    edges = stored(name_edges(mentions), "names") if {"ppr", "spread"} & set(wanted) else None
    if "ppr" in wanted:
        seeds = mentions.select(F.col("name").alias("id")).where(F.lower("name").isin(*query_names(text))).distinct()
        parts["ppr"] = _best(named_scores(seen, graph.page_rank(edges, seeds).select("id", F.col("rank").alias("score")), True), pool)
    if "spread" in wanted:
        seeds = mentions.join(search.top(near, 5, "similarity").select("id"), "id", "left_semi").select(F.col("name").alias("id")).distinct()
        parts["spread"] = _best(named_scores(seen, graph.spread(edges, seeds).select("id", F.col("activation").alias("score")), False), pool)
    if "hopfield" in wanted:
        parts["hopfield"] = _best(search.hopfield(memories, query, settings.beta, min_heat).select("id", F.col("weight").alias("score")), pool)
    if "fractal" in wanted:
        q = V.constant(query)
        centre = V.centroid(memories.where(F.col("embedding").isNotNull()), ["label"], "embedding").select("label", V.cosine(F.col("centroid"), q).alias("s1"))
        own = hot.where(F.col("embedding").isNotNull()).join(centre, "label")
        parts["fractal"] = _best(own.select("id", (0.3 * V.cosine(F.col("embedding"), q) + 0.5 * F.col("s1")).alias("score")), pool)
    if "sr" in wanted and visits is not None:
        chances = graph.stochastic(graph.transitions(visits, "key", ["ts", "id"], "id"))
        parts["sr"] = _best(graph.successors_from(chances, search.top(near, 5, "similarity").select("id")).select("id", F.col("m").alias("score")), pool)
    if "temporal" in wanted:
        parts["temporal"] = temporal(hot, text, pool)
    if "hdc" in wanted and query_names(text):
        candidates = None
        for rows in parts.values():
            candidates = rows.select("id") if candidates is None else candidates.unionAll(rows.select("id"))
        names = mentions.groupBy("id").agg(F.array_sort(F.collect_set(F.lower("name"))).alias("names"))
        pooled = memories.join(candidates.distinct(), "id", "left_semi").join(names, "id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
        vector = ordered.hypervector(None, [], query_names(text), None, settings.dims)
        parts["hdc"] = _best(ordered.hyper_search(pooled, vector, pool).select("id", F.col("similarity").alias("score")), pool)
    out = None
    for name in wanted:
        if name in parts:
            rows = parts[name].select(F.lit(0).alias("query_id"), F.col("id").cast("long").alias("id"), F.lit(name).alias("signal"), F.col("score").cast("double").alias("score"))
            out = rows if out is None else out.unionByName(rows)
    return out


def recall(memories: DataFrame, mentions: DataFrame, text: str, query: list[float], k: int = 5, min_heat: float = 0.1, visits: DataFrame | None = None, settings: RecallSettings | None = None) -> DataFrame:
    """(id, score): the k best memories of a query by text and vector; see ``signals`` for the frames."""
    s = settings or RecallSettings()
    fused = fusion.convex(signals(memories, mentions, visits, text, query, k * s.pool, min_heat, s), s.weights)
    pool = fused.select("id", "score").join(memories.where(F.col("heat") >= min_heat).select("id", "content"), "id")
    lexical = fusion.lexical_score(text, F.col("content"), P.STOP_WORDS)
    return search.top(pool.select("id", F.round((1 - s.rerank) * F.col("score") + s.rerank * lexical, 6).alias("score")), k, "score")


def gathered(memories: DataFrame) -> DataFrame:
    """The columns that a recall reads, written once: its signals read them ten times, and a frame that joins texts and vectors
    would move the texts each time.
    """
    names = ("id", "content", "heat", "embedding", "created_at", "label", "directory", "tags", "store_type")
    return stored(memories.select(*(n for n in names if n in memories.columns)), "memories")


def mentioned(memories: DataFrame) -> DataFrame:
    """(id, name) of the names that each memory's content holds by their form."""
    return X.entities(memories, "id", "content").select("id", "name").distinct()
