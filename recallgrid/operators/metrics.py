"""Retrieval metrics over (query_id, id, rank) results and (query_id, id) relevant sets."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.functions.extract import numbered, tokens


def retrieval_metrics(results: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, mrr, recall, ndcg) at k with binary relevance; queries without hits get 0, those without relevant rows none."""
    hits = results.where(F.col("rank") <= k).join(relevant, ["query_id", "id"], "left_semi")
    found = hits.groupBy("query_id").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("hits"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("wanted", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    wanted = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"))
    joined = wanted.join(found, "query_id", "left")
    zero = F.lit(0.0)
    return joined.select(
        "query_id", F.round(F.coalesce(1 / F.col("first"), zero), 6).alias("mrr"), F.round(F.coalesce(F.col("hits") / F.col("wanted"), zero), 6).alias("recall"),
        F.round(F.coalesce(F.col("dcg") / ideal, zero), 6).alias("ndcg"),
    )


def token_f1(pairs: DataFrame, prediction: str, truth: str, key: str = "id") -> DataFrame:
    """(key, f1) of lower-case words, each as often as both texts have it; 0 without a common word. Counted within a row."""
    words = lambda text: F.coalesce(tokens(F.col(text)), F.array().cast("array<string>"))
    rows = pairs.select(key, words(prediction).alias("p"), words(truth).alias("t"))
    common = F.size(F.array_intersect(numbered(F.col("p")), numbered(F.col("t"))))
    return rows.select(key, F.round(F.coalesce(2.0 * common / F.nullif(F.size("p") + F.size("t"), F.lit(0)), F.lit(0.0)), 6).alias("f1"))


def paired_bootstrap(a: list[float], b: list[float], rounds: int = 5000, seed: int = 1337, level: float = 0.95) -> tuple[float, float, float]:
    """(mean difference, low, high) of paired scores by resampling queries."""
    d = np.asarray(a, float) - np.asarray(b, float)
    means = d[np.random.default_rng(seed).integers(0, len(d), (rounds, len(d)))].mean(axis=1)
    low, high = np.quantile(means, [(1 - level) / 2, (1 + level) / 2])
    return float(d.mean()), float(low), float(high)


def sign_test(a: list[float], b: list[float]) -> float:
    """Two-sided p-value of the signs of paired differences; ties do not count."""
    wins, losses = sum(x > y for x, y in zip(a, b, strict=True)), sum(x < y for x, y in zip(a, b, strict=True))
    n, k = wins + losses, min(wins, losses)
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0
