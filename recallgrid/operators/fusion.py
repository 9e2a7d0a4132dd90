"""Fusion of retrieval signals in long form (query_id, id, signal, score)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Default weights of the signals.
WEIGHTS = {"vector": 1.0, "fts": 0.0, "ppr": 0.5, "spread": 0.3, "hopfield": 0.2, "hdc": 0.3, "fractal": 0.2, "sr": 0.3}
KEYS = ["query_id", "signal"]


def weight_of(signal: Column, weights: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for name, w in weights.items():
        out = F.when(signal == name, float(w)).otherwise(out)
    return out


def min_max(signals: DataFrame) -> DataFrame:
    """norm: scores between 0 and 1 by signal; a constant signal gives 0.5."""
    w = Window.partitionBy(*KEYS)
    low, high = F.min("score").over(w), F.max("score").over(w)
    return signals.withColumn("norm", F.when(high == low, 0.5).otherwise((F.col("score") - low) / (high - low)))


def z_score(signals: DataFrame) -> DataFrame:
    """norm: min-max of the z-score (population deviation)."""
    w = Window.partitionBy(*KEYS)
    z = (F.col("score") - F.avg("score").over(w)) / F.nullif(F.stddev_pop("score").over(w), F.lit(0.0))
    return min_max(signals.withColumn("score", F.coalesce(z, F.lit(0.0))))


def max_norm(signals: DataFrame) -> DataFrame:
    w = Window.partitionBy(*KEYS)
    return signals.withColumn("norm", F.col("score") / F.nullif(F.max("score").over(w), F.lit(0.0)))


def _rated(signals: DataFrame) -> DataFrame:
    """Signals with their rank r and the confidence of their signal; one shuffle, and the signals are computed once."""
    w = Window.partitionBy(*KEYS)
    rows = signals.withColumn("r", F.row_number().over(w.orderBy(F.desc("score"), "id")))
    n, top, mean = F.count(F.lit(1)).over(w), F.max("score").over(w), F.avg("score").over(w)
    gap = F.coalesce(top - F.max(F.when(F.col("r") == 2, F.col("score"))).over(w), top)
    graph = F.when(n == 1, top).when(top > 0, (top - mean) / top).otherwise(0.0)
    s, one = F.col("signal"), F.lit(1.0)
    value = (
        F.when(s == "vector", F.least(one, top * (1 + gap))).when(s.isin("fts", "hdc"), F.least(one, n / 5))
        .when(s.isin("sr", "temporal"), F.least(one, n / 3)).when(s.isin("ppr", "spread"), graph).otherwise(top)
    )
    return rows.withColumn("confidence", value)


def confidence(signals: DataFrame) -> DataFrame:
    """(query_id, signal, confidence) by the rule of each signal; a signal without rows has none."""
    return _rated(signals).where("r = 1").select(*KEYS, "confidence")


def gated(signals: DataFrame, weights: dict[str, float], least: float = 0.1) -> DataFrame:
    """Signals with their rank r and weight; a signal whose confidence is under ``least`` weighs 0."""
    weight = F.when(F.col("confidence") < least, 0.0).otherwise(weight_of(F.col("signal"), weights))
    return _rated(signals).withColumn("weight", weight)


def convex(signals: DataFrame, weights: dict[str, float] | None = None, gate: bool = True) -> DataFrame:
    """(query_id, id, score): sum of min-max scores by weights that add up to 1; ids count in a signal where their score is over 0.

    The weights of a query's signals are summed over the first row of each; without any weight the query has no result.
    """
    rows = min_max(gated(signals.where("score > 0"), weights or WEIGHTS, 0.1 if gate else float("-inf")))
    total = F.sum(F.when(F.col("r") == 1, F.col("weight"))).over(Window.partitionBy("query_id"))
    rows = rows.withColumn("total", total).where("total > 0")
    return rows.groupBy("query_id", "id").agg(F.round(F.sum(F.col("weight") / F.col("total") * F.col("norm")), 6).alias("score"))


def weighted(signals: DataFrame, weights: dict[str, float], multiply: bool = True) -> DataFrame:
    """Sum of weighted min-max scores, times the number of signals that found the id (CombMNZ) if ``multiply``."""
    rows = min_max(signals.where("score > 0")).withColumn("weight", weight_of(F.col("signal"), weights))
    total = F.sum(F.col("weight") * F.col("norm"))
    return rows.groupBy("query_id", "id").agg(F.round(total * F.count(F.lit(1)) if multiply else total, 6).alias("score"))


def reciprocal_rank(signals: DataFrame, weights: dict[str, float], k: int = 60) -> DataFrame:
    """Sum of weight / (k + rank + 1), ranks from 0."""
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("score"), "id"))
    rows = signals.withColumn("part", weight_of(F.col("signal"), weights) / (k + rank))
    return rows.groupBy("query_id", "id").agg(F.round(F.sum("part"), 8).alias("score"))


def diversity(signals: DataFrame, k: int = 10) -> DataFrame:
    """Distinct (query_id, id) of the k best of every signal."""
    r = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("score"), "id"))
    return signals.withColumn("r", r).where(F.col("r") <= k).select("query_id", "id").distinct()


def result_confidence(scores: DataFrame) -> DataFrame:
    """(query_id, confidence, uncertain, abstain) of a fused ranking, from the first gap and the spread of its scores."""
    ranked = scores.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    s = ranked.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("score").alias("s1"), F.max(F.when(F.col("r") == 2, F.col("score"))).alias("s2"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std")
    )
    gap = F.when(F.col("std") > 0, (F.col("s1") - F.col("s2")) / F.col("std")).otherwise(0.0)
    cv = F.when(F.col("mean") > 0, F.col("std") / F.col("mean")).otherwise(0.0)
    one = F.lit(1.0)
    value = F.when(F.col("n") == 1, F.least(one, F.col("s1"))).otherwise(0.4 * F.least(one, gap / 2) + 0.4 * F.least(one, 2 * F.col("s1")) + 0.2 * F.least(one, 2 * cv))
    s = s.select("query_id", "s1", gap.alias("gap"), F.round(value, 6).alias("confidence"))
    return s.select("query_id", "confidence", (F.col("confidence") < 0.3).alias("uncertain"), ((F.col("confidence") < 0.15) | ((F.col("s1") < 0.1) & (F.col("gap") < 0.5))).alias("abstain"))


def bare_words(text: Column) -> Column:
    """Lower-case words between white space without signs at their ends."""
    cut = F.transform(F.split(F.lower(text), r"\s+"), lambda t: F.regexp_replace(t, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.filter(cut, lambda t: t != "")


def bigrams(words: Column) -> Column:
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))


def query_parts(query: str, stop: tuple[str, ...]) -> tuple[list[str], list[str], list[str]]:
    """Names, terms and word pairs of a query, in lower case."""
    bare = [re.sub(r"^[\W_]+|[\W_]+$", "", t) for t in query.split()]
    words = [t.lower() for t in bare if t]
    names = sorted({t.lower() for t in bare if len(t) > 1 and t[0].isupper()})
    terms = sorted({t for t in words if len(t) > 2 and t not in stop})
    return names, terms, sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def lexical_score(query: str, content: Column, stop: tuple[str, ...]) -> Column:
    """0.35 names + 0.30 terms + 0.20 word pairs + 0.15 exact: what share of the query the content holds."""
    names, terms, pairs = query_parts(query, stop)
    own = bare_words(content)
    share = lambda wanted, have: F.size(F.array_intersect(F.array(*map(F.lit, wanted)), have)) / len(wanted) if wanted else F.lit(0.0)
    exact = F.when(F.contains(F.lower(content), F.lit(query.lower())), 0.15).otherwise(0.0)
    return 0.35 * share(names, own) + 0.30 * share(terms, own) + 0.20 * share(pairs, bigrams(own)) + exact
