"""Vector arithmetic on array<double> columns, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def constant(values: list[float]) -> Column:
    """A stated vector as one literal expression."""
    return F.expr(f"array({', '.join(f'{float(x)!r}D' for x in values)})")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def similarity(a: Column, b: Column) -> Column:
    """1 / (1 + Euclidean distance)."""
    return 1 / (1 + distance(a, b))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def normalised(a: Column) -> Column:
    size = norm(a)
    return F.when(size == 0, a).otherwise(F.transform(a, lambda x: x / size))


def truncated(a: Column, dims: int) -> Column:
    """The first ``dims`` values, normalised anew."""
    return normalised(F.slice(a, 1, dims))


def quantised(a: Column) -> Column:
    """Values times 127, rounded, within -127..127."""
    return F.transform(a, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x * 127).cast("int"))))


def dequantised(a: Column) -> Column:
    return F.transform(a, lambda x: x / F.lit(127.0))


def centroid(df: DataFrame, keys: list[str], vector: str, unit: bool = True) -> DataFrame:
    """Mean vector by keys, of unit length if ``unit``; the mean of each position is summed before the shuffle."""
    at = df.select(*keys, F.posexplode(vector).alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg("x").alias("x"))
    mean = at.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"))
    return mean.withColumn("centroid", normalised(F.col("centroid"))) if unit else mean


def softmax(df: DataFrame, keys: list[str], score: str, beta: float, out: str) -> DataFrame:
    """exp(beta * score) over its sum by ``keys``, computed from the largest score down."""
    w = Window.partitionBy(*keys)
    e = F.exp(beta * (F.col(score) - F.max(score).over(w)))
    return df.withColumn("_e", e).withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def sparsemax(df: DataFrame, keys: list[str], score: str, order: str, out: str) -> DataFrame:
    """Projection on the simplex by ``keys``: the threshold follows from the cumulative sums of the sorted scores."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), order)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = df.withColumn("_k", F.row_number().over(w)).withColumn("_c", F.sum(score).over(run))
    inside = F.when(1 + F.col("_k") * F.col(score) > F.col("_c"), (F.col("_c") - 1) / F.col("_k"))
    tau = F.max_by(inside, F.when(inside.isNotNull(), F.col("_k"))).over(Window.partitionBy(*keys))
    return sized.withColumn("_t", tau).withColumn(out, F.greatest(F.col(score) - F.col("_t"), F.lit(0.0))).drop("_k", "_c", "_t")
