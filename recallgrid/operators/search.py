"""Ranked search: exact nearest neighbours, BM25, and batch forms with one row set for many queries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.functions import vectors as V
from recallgrid.functions.extract import counted, tokens
from recallgrid.sources.shared import stored


def top(df: DataFrame, k: int, score: str, ties: str = "id") -> DataFrame:
    """The k best rows, ties by ``ties``; one TakeOrdered, no full sort."""
    return df.orderBy(F.desc(score), ties).limit(k)


def top_by(df: DataFrame, keys: list[str], k: int, score: str, ties: str = "id", rank: str = "rank") -> DataFrame:
    """The k best rows for each key with their rank."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), ties)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def nearest(memories: DataFrame, query: list[float], k: int = 10, min_heat: float = 0.1, vector: str = "embedding") -> DataFrame:
    """(id, similarity): the k nearest memories by Euclidean distance, heat filtered before the cut."""
    q = V.constant(query)
    scored = memories.where((F.col("heat") >= min_heat) & F.col(vector).isNotNull()).select("id", F.round(V.similarity(F.col(vector), q), 6).alias("similarity"))
    return top(scored, k, "similarity")


def nearest_batch(memories: DataFrame, queries: DataFrame, k: int = 10, min_heat: float = 0.1, vector: str = "embedding", block: int = 512, chunk: int = 65536) -> DataFrame:
    """(query_id, id, similarity, rank): the k nearest memories of each row of ``queries`` (query_id, query), exactly.

    Queries are dealt into blocks and memories into chunks by a hash; a block and a chunk meet in one task as matrices, and
    only the k best of each query leave it. A memory travels once for each block of queries.
    """
    hot = memories.where((F.col("heat") >= min_heat) & F.col(vector).isNotNull()).select("id", F.col(vector).alias("v"))
    asked = queries.where("query is not null").select("query_id", "query")
    n = lambda rows, size: rows.agg(F.greatest(F.ceil(F.count(F.lit(1)) / size), F.lit(1)).cast("int").alias("n")).scalar()
    blocks, chunks = n(asked, block), n(hot, chunk)
    left = hot.select("id", "v", F.pmod(F.xxhash64("id"), chunks).alias("i"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("j"))
    right = asked.select("query_id", "query", F.pmod(F.xxhash64("query_id"), blocks).cast("int").alias("j"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("i"))

    def meet(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({"query_id": [], "id": [], "similarity": []})
        rows = rows.sort_values("id", ignore_index=True)
        x = np.stack(rows["v"].map(np.asarray)).astype(float)
        found = []
        for number, query in zip(asked["query_id"], asked["query"], strict=True):
            near = np.round(1 / (1 + np.sqrt(((x - np.asarray(query, float)) ** 2).sum(axis=1))), 6)
            best = np.argsort(-near, kind="stable")[:k]
            found.append(pd.DataFrame({"query_id": number, "id": rows["id"].to_numpy()[best], "similarity": near[best]}))
        return pd.concat(found, ignore_index=True)

    keys = ["i", "j"]
    left, right = left.withColumn("i", F.col("i").cast("int")), right.select("query_id", "query", "i", "j")
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "query_id long, id long, similarity double")
    return top_by(met, ["query_id"], k, "similarity")


def hot_scores(memories: DataFrame, query: list[float], min_heat: float, most: int, vector: str) -> DataFrame:
    """(query_id, id, s): dot products of the ``most`` hottest memories with the query; a pool of bounded size."""
    hot = top(memories.where((F.col("heat") >= min_heat) & F.col(vector).isNotNull()).select("id", "heat", vector), most, "heat")
    return hot.select(F.lit(0).alias("query_id"), "id", V.dot(F.col(vector), V.constant(query)).alias("s"))


def hopfield(memories: DataFrame, query: list[float], beta: float = 8.0, min_heat: float = 0.1, most: int = 5000, sparse: bool = False, vector: str = "embedding") -> DataFrame:
    """(id, weight): softmax, or sparsemax if ``sparse``, of beta times the dot products of the ``most`` hottest memories."""
    s = hot_scores(memories, query, min_heat, most, vector)
    weighed = V.sparsemax(s.withColumn("s", beta * F.col("s")), ["query_id"], "s", "id", "w") if sparse else V.softmax(s, ["query_id"], "s", beta, "w")
    return weighed.select("id", F.round("w", 6).alias("weight"))


def energy(memories: DataFrame, query: list[float], beta: float = 8.0, min_heat: float = 0.1, most: int = 5000, vector: str = "embedding") -> DataFrame:
    """(energy): half the query's square minus the log-sum-exp of the hottest memories over beta."""
    z = hot_scores(memories, query, min_heat, most, vector).select((beta * F.col("s")).alias("z"))
    summed = z.agg(F.collect_list("z").alias("z")).select(F.array_max("z").alias("t"), "z")  # at most ``most`` numbers
    spread = F.aggregate(F.transform("z", lambda x: F.exp(x - F.col("t"))), F.lit(0.0), lambda a, x: a + x)
    return summed.select(F.round(-(F.col("t") + F.log(spread)) / beta + 0.5 * sum(x * x for x in query), 6).alias("energy"))


def dual_nearest(memories: DataFrame, query: list[float], k: int = 10, min_heat: float = 0.1, weight: float = 0.3, vector: str = "embedding", implicit: str = "implicit") -> DataFrame:
    """(id, score): the k nearest by either vector, (1 - weight) of the explicit and ``weight`` of the implicit similarity."""
    a = nearest(memories, query, k, min_heat, vector).select("id", ((1 - weight) * F.col("similarity")).alias("s"))
    b = nearest(memories, query, k, min_heat, implicit).select("id", (weight * F.col("similarity")).alias("s"))
    return top(a.unionAll(b).groupBy("id").agg(F.round(F.sum("s"), 6).alias("score")), k, "score")


def naming(memories: DataFrame, name: str, min_heat: float = 0.1, text: str = "content") -> DataFrame:
    """Memories of some heat that hold a name: as a phrase of words or, where no memory has that, as a part of the text."""
    rows = memories.where(F.col("heat") >= min_heat)
    words = F.concat(F.lit(" "), F.array_join(tokens(F.col(text)), " "), F.lit(" "))
    spoken = F.concat(F.lit(" "), F.array_join(tokens(F.lit(name)), " "), F.lit(" "))
    phrase = F.contains(words, spoken)
    any_phrase = rows.agg(F.coalesce(F.max(phrase), F.lit(False))).scalar()
    return rows.where(F.when(any_phrase, phrase).otherwise(F.contains(F.lower(text), F.lit(name.lower()))))


def passage_clusters(pool: DataFrame, stop: tuple[str, ...], overlap: float = 0.3, size: int = 3, most: int = 20) -> DataFrame:
    """(query_id, id, cluster) of the ``most`` best rows of each query: a row opens a cluster unless it is in one, and takes
    the rows that follow it while they share ``overlap`` of the words, until one is taken already or the cluster is full.
    """
    ignored = set(stop)

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank", ignore_index=True)
        words = [set((t or "").lower().split()) - ignored for t in rows["content"]]
        cluster = np.full(len(rows), -1)
        for i in range(len(rows)):
            if cluster[i] >= 0:
                continue
            cluster[i], held = i, 1
            for j in range(i + 1, len(rows)):
                if cluster[j] >= 0 or held >= size:
                    break
                union = len(words[i] | words[j])
                if union and len(words[i] & words[j]) / union >= overlap:
                    cluster[j], held = i, held + 1
        return pd.DataFrame({"query_id": rows["query_id"], "id": rows["id"], "cluster": cluster})

    best = top_by(pool, ["query_id"], most, "score")
    return best.groupBy("query_id").applyInPandas(group, "query_id long, id long, cluster long")



LEVEL_WEIGHTS = ((10, (0.3, 0.5, 1.0)), (31, (1.0, 1.0, 1.0)), (None, (1.0, 0.5, 0.3)))  # fixed values: fewer words than this, weights of levels 0, 1, 2


def tree(memories: DataFrame, query: list[float], text: str, keys: tuple[str, str], k: int = 10, vector: str = "embedding") -> DataFrame:
    """(level, item, score): the k best memories, clusters and super-clusters (by the two ``keys``), each level weighted by
    the number of words of the query: short ones prefer the broad levels, long ones the memories.
    """
    weights = next(w for below, w in LEVEL_WEIGHTS if below is None or len(text.split()) < below)
    q = V.constant(query)
    levels = [memories.where(F.col(vector).isNotNull()).select(F.col("id").cast("string").alias("item"), F.round(weights[0] * V.similarity(F.col(vector), q), 6).alias("score"))]
    for key, weight in zip(keys, weights[1:], strict=True):
        levels.append(V.centroid(memories, [key], vector, unit=False).select(F.col(key).cast("string").alias("item"), F.round(weight * V.cosine(F.col("centroid"), q), 6).alias("score")))
    out = None
    for level, rows in enumerate(levels):
        best = top(rows, k, "score", "item").select(F.lit(level).alias("level"), "item", "score")
        out = best if out is None else out.unionAll(best)
    return out


def postings(docs: DataFrame, text: str = "content") -> DataFrame:
    """(term, id, tf, dl): the inverted index. The words of a text are counted within its row, so nothing is shuffled or grouped."""
    words = docs.select("id", tokens(F.col(text)).alias("w"))
    return words.select("id", F.size("w").alias("dl"), F.inline(counted(F.col("w")))).select("term", "id", "dl", "tf")


def bm25(docs: DataFrame, terms: dict[str, float], k: int = 50, text: str = "content", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, bm25): BM25 of weighted query terms, the k best.

    Texts are read and cut into words once: a row's length and its counts of the query's terms, a few numbers, are written to
    the shared folder. One aggregate of them gives the row count, mean length and document counts, a second pass the scores;
    only the top k of each task leaves it. Where postings are stored, ``bm25_postings`` reads those of the terms alone.
    """
    if not terms:
        return docs.select("id", F.lit(0.0).alias("bm25")).limit(0)
    listed = sorted(terms.items())
    split = docs.select("id", tokens(F.col(text)).alias("w"))
    hit = split.select("id", F.size("w").alias("dl"), F.filter("w", lambda x: x.isin(*terms)).alias("w"))
    rows = stored(hit.select("id", "dl", *(_occurrences("w", t).alias(f"tf{i}") for i, (t, _) in enumerate(listed))), "counts")
    counts = [F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(listed))]
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean"), *counts).select(F.struct("*").alias("s")).scalar()
    total = F.lit(0.0)
    for i, (_, weight) in enumerate(listed):
        total = total + F.when(F.col(f"tf{i}") > 0, weight * _bm25_part(F.col(f"tf{i}"), stats[f"df{i}"], F.col("dl"), stats["n"], stats["mean"], k1, b)).otherwise(0.0)
    some = F.greatest(*(F.col(f"tf{i}") for i in range(len(listed))), F.lit(0)) > 0
    return top(rows.where(some).select("id", F.round(total, 6).alias("bm25")), k, "bm25")


def _bm25_part(tf: Column, df: Column, dl: Column, n: Column, mean: Column, k1: float, b: float) -> Column:
    idf = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(idf <= 0, 1e-6).otherwise(idf) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean))


def bm25_postings(index: DataFrame, sizes: DataFrame, terms: dict[str, float], k: int = 50, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, bm25) from a stored index (term, id, tf, dl), of which only the query's terms are read; sizes: one row (n, mean)."""
    if not terms:
        return index.select("id", F.lit(0.0).alias("bm25")).limit(0)
    found = index.where(F.col("term").isin(*terms))
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row for each term of the query
    weight = F.lit(0.0)
    for t, w in terms.items():
        weight = F.when(F.col("term") == t, float(w)).otherwise(weight)
    s = sizes.select(F.struct("n", "mean").alias("s")).scalar()
    part = weight * _bm25_part(F.col("tf"), F.col("df"), F.col("dl"), s["n"], s["mean"], k1, b)
    return top(found.join(df, "term").groupBy("id").agg(F.round(F.sum(part), 6).alias("bm25")), k, "bm25")


def _occurrences(array: str, value: str) -> Column:
    return F.size(F.filter(array, lambda x: x == value))


def mmr(candidates: DataFrame, k: int, keep: float = 0.7, score: str = "score", vector: str = "embedding") -> DataFrame:
    """Greedy maximal marginal relevance by query_id: relevance against the closest chosen vector. Pools are cut before (2k rows)."""

    def choose(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values([score, "id"], ascending=[False, True], ignore_index=True)
        v = np.stack(pool[vector].map(np.asarray)) if len(pool) else np.zeros((0, 1))
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        chosen: list[int] = []
        while len(chosen) < min(k, len(pool)):
            near = (v @ v[chosen].T).max(axis=1) if chosen else np.zeros(len(pool))
            gain = keep * pool[score].to_numpy() - (1 - keep) * near
            gain[chosen] = -np.inf
            chosen.append(int(gain.argmax()))
        return pd.DataFrame({"query_id": pool["query_id"].iloc[chosen].to_numpy(), "id": pool["id"].iloc[chosen].to_numpy(), "position": np.arange(1, len(chosen) + 1)})

    pools = top_by(candidates, ["query_id"], 2 * k, score).drop("rank")
    return pools.groupBy("query_id").applyInPandas(choose, "query_id long, id long, position long")
