"""Conflict-free merging of replicas: vector clocks, tag sets, content conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid.functions.patterns import CONFLICT_MARK


def _counts(a: Column, b: Column) -> Column:
    return F.map_values(F.map_zip_with(a, b, lambda k, x, y: F.struct(F.coalesce(x, F.lit(0)).alias("x"), F.coalesce(y, F.lit(0)).alias("y"))))


def compare_clocks(a: Column, b: Column) -> Column:
    """equal, before, after or concurrent; a missing agent counts 0."""
    less = F.exists(_counts(a, b), lambda p: p["x"] < p["y"])
    more = F.exists(_counts(a, b), lambda p: p["x"] > p["y"])
    return F.when(less & more, "concurrent").when(less, "before").when(more, "after").otherwise("equal")


def merge_clocks(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda k, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def tick(clock: Column, agent: Column) -> Column:
    """The clock with the agent's count one higher."""
    return F.map_zip_with(clock, F.create_map(agent, F.lit(1)), lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def merge_tags(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def conflicted(content: Column) -> Column:
    return content.rlike(CONFLICT_MARK)


def conflict_agents(content: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(content, F.lit(CONFLICT_MARK), F.lit(1)))


def parts(content: Column) -> Column:
    """The versions in a conflicted content, trimmed."""
    return F.filter(F.transform(F.split(content, CONFLICT_MARK), lambda p: F.trim(F.regexp_replace(p, r"^\n+|\n+$", ""))), lambda p: p != "")


def resolve(content: Column, how: str) -> Column:
    """latest: the last version; longest; merge: all, one to a line; agent:NAME: that agent's version, else the first."""
    versions = parts(content)
    if how == "latest":
        out = F.element_at(versions, -1)
    elif how == "longest":
        out = F.array_max(F.transform(versions, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]
    elif how == "merge":
        out = F.array_join(F.array_distinct(versions), "\n")
    elif how.startswith("agent:"):
        at = F.array_position(F.regexp_extract_all(content, F.lit(CONFLICT_MARK), F.lit(1)), how[6:])
        out = F.get(versions, at.cast("int"))
    else:
        raise ValueError(f"unknown resolution {how!r}")
    return F.when(conflicted(content), out).otherwise(content)


def merge_records(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Full outer merge by content: tag union, greatest scores, merged clocks, and which side was newer.

    Both: content, tags, heat, importance, clock. Contents join by their SHA-256.
    """
    a = local.select(F.sha2("content", 256).alias("key"), F.struct("content", "tags", "heat", "importance", "clock").alias("l"))
    b = remote.select(F.sha2("content", 256).alias("key"), F.struct("content", "tags", "heat", "importance", "clock").alias("r"))
    both = a.join(b, "key", "full_outer")
    l, r = F.col("l"), F.col("r")
    none = F.array().cast("array<string>")
    empty = F.from_json(F.lit("{}"), "map<string,int>")
    lc, rc = F.coalesce(l["clock"], empty), F.coalesce(r["clock"], empty)
    return both.select(
        F.coalesce(l["content"], r["content"]).alias("content"),
        merge_tags(F.coalesce(l["tags"], none), F.coalesce(r["tags"], none)).alias("tags"),
        F.greatest(l["heat"], r["heat"]).alias("heat"),
        F.greatest(l["importance"], r["importance"]).alias("importance"),
        merge_clocks(lc, rc).alias("clock"),
        F.when(l.isNull(), "remote").when(r.isNull(), "local").otherwise(compare_clocks(lc, rc)).alias("origin"),
    )
