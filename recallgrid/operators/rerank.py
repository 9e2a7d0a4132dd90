"""Reranking of bounded pools (query_id, id, query, content, score) by pluggable scorers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallgrid.operators.search import top_by

Scorer = Callable[[list[str], list[str]], list[float]]


def word_overlap(queries: list[str], texts: list[str]) -> list[float]:
    """Built-in scorer: share of the query's words that the text holds."""
    out = []
    for q, t in zip(queries, texts, strict=True):
        wanted, own = set(q.lower().split()), set(t.lower().split())
        out.append(len(wanted & own) / len(wanted) if wanted else 0.0)
    return out


def scored(pool: DataFrame, scorer: Scorer = word_overlap, out: str = "pair_score") -> DataFrame:
    """Pairs of query and content through ``scorer``, an Arrow batch at a time."""
    schema = T.StructType([*pool.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch[out] = list(map(float, scorer(batch["query"].fillna("").tolist(), batch["content"].fillna("").tolist())))
            yield batch

    return pool.mapInPandas(run, schema)


def cross_rerank(pool: DataFrame, k: int, scorer: Scorer = word_overlap, weight: float = 0.6, short: int = 10, brief: int = 20, most: int = 75) -> DataFrame:
    """The k best of a query's ``most`` best by (1 - weight) * score + weight * pair score (min-max by query; 1 if constant).

    The pair score of passages under ``short`` words is halved, under ``brief`` words it counts 0.8.
    """
    w = Window.partitionBy("query_id")
    low, high = F.min("pair_score").over(w), F.max("pair_score").over(w)
    norm = F.when(high == low, 1.0).otherwise((F.col("pair_score") - low) / (high - low))
    words = F.size(F.split(F.trim("content"), r"\s+"))
    held = norm * F.when(words < short, 0.5).when(words < brief, 0.8).otherwise(1.0)
    cut = top_by(pool, ["query_id"], most, "score").drop("rank")
    blended = scored(cut, scorer).withColumn("score", F.round((1 - weight) * F.col("score") + weight * held, 6))
    return top_by(blended, ["query_id"], k, "score").drop("pair_score")


def entail_rerank(pool: DataFrame, k: int, scorer: Scorer = word_overlap, weight: float = 0.3) -> DataFrame:
    """The k best by (1 - weight) * score + weight * entailment."""
    blended = scored(pool, scorer).withColumn("score", F.round((1 - weight) * F.col("score") + weight * F.col("pair_score"), 6))
    return top_by(blended, ["query_id"], k, "score").drop("pair_score")


def support_boost(pool: DataFrame, pairs: DataFrame) -> DataFrame:
    """Raise each row by half of what its best partner adds: pairs (query_id, id, with_score) are scores of joined passages."""
    best = pairs.groupBy("query_id", "id").agg(F.max("with_score").alias("w"))
    gain = F.greatest(F.coalesce("w", "score") - F.col("score"), F.lit(0.0)) / 2
    return pool.join(best, ["query_id", "id"], "left").withColumn("score", F.round(F.col("score") + gain, 6)).drop("w")


def merged(*rankings: DataFrame) -> DataFrame:
    """(query_id, id, score) of several searches, the best score of each id: the comparison search of two options."""
    out = rankings[0].select("query_id", "id", "score")
    for r in rankings[1:]:
        out = out.unionByName(r.select("query_id", "id", "score"))
    return out.groupBy("query_id", "id").agg(F.max("score").alias("score"))


def with_facts(ranking: DataFrame, facts: DataFrame) -> DataFrame:
    """A ranking and matching profile facts (query_id, fact_id, confidence, score) under negative ids; confidence over 0.7 counts 1.2."""
    lifted = F.col("score") * F.when(F.col("confidence") > 0.7, 1.2).otherwise(1.0)
    return ranking.select("query_id", "id", "score").unionByName(facts.select("query_id", (-F.col("fact_id")).alias("id"), lifted.alias("score")))
