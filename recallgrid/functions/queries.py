"""Kinds of searches and their rewriting, as Columns over a frame of queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recallgrid.functions import patterns as P
from recallgrid.functions.subqueries import options


LEAD = rf"(?i)^(?:(?:{'|'.join(P.LEADING_WORDS)})[?,]*\s+){{1,3}}"


def _any(text: Column, keys: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for k in keys:
        out = out | F.contains(text, F.lit(k.lower()))
    return out


def kind(query: Column) -> Column:
    """temporal, open_domain, factoid, code, relational, keyword, simple or complex, in this order of precedence."""
    low = F.trim(F.lower(query))
    words = F.filter(F.split(low, r"\s+"), lambda w: w != "")
    listed = lambda names: F.arrays_overlap(words, F.array(*map(F.lit, names)))
    relational = _any(low, P.RELATION_KEYS)
    cued = _any(low, P.CUE_PHRASES) | _any(low, tuple(t for t, _ in P.TOPICS)) | (F.size(options(query)) > 0)
    open_domain = cued | (listed(P.MODAL_WORDS) & relational) | low.rlike("^(?:would|could|might) ")
    return (
        F.when(_any(low, P.TEMPORAL_KEYS), "temporal").when(open_domain, "open_domain").when(listed(P.QUESTION_WORDS), "factoid")
        .when(_any(low, P.CODE_KEYS), "code").when(relational, "relational").when(F.size(words) <= 2, "keyword")
        .when(F.size(words) < 5, "simple").otherwise("complex")
    )


def enabled_signals(kind: Column) -> Column:
    """Signals that a kind of search runs."""
    names = lambda *s: F.array(*map(F.lit, s))
    two = names("vector", "fts")
    return (
        F.when(kind == "factoid", names("vector", "fts", "ppr")).when(kind == "relational", names("vector", "fts", "ppr", "spreading"))
        .when(kind == "complex", names("vector", "fts", "ppr", "spreading", "fractal", "hopfield", "hdc", "sr")).otherwise(two)
    )


def statement(query: Column) -> Column:
    """A question turned into a statement; other texts lose up to three leading question words, or only the question mark."""
    text = F.trim(query)
    rest = F.trim(F.regexp_replace(F.regexp_replace(text, LEAD, ""), r"[?.!]+$", ""))
    out = F.when(text.rlike(LEAD) & (rest != ""), rest).otherwise(F.trim(F.regexp_replace(text, r"[?]+$", "")))
    for pattern, after in reversed(P.STATEMENTS):
        out = F.when(text.rlike(pattern), F.trim(F.regexp_replace(F.regexp_replace(text, pattern, "$1" + after), r"[?.!]+$", ""))).otherwise(out)
    return out
