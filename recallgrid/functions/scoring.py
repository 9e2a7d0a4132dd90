"""Scores, decays and decisions of single memories, as Column expressions. ``now`` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recallgrid.functions import patterns as P


def hours_between(earlier: Column, later: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(3.6e9)


def _has(content: Column, pattern: str, points: float) -> Column:
    return F.when(content.rlike(pattern), points).otherwise(0.0)


def importance(content: Column, tags: Column) -> Column:
    """Sum of fixed points for errors, decisions, design, many tags, length and code, at most 1."""
    total = _has(content, P.ERROR_WORDS, 0.2) + _has(content, P.DECISION_WORDS, 0.3) + _has(content, P.DESIGN_WORDS, 0.2)
    total = total + F.when(F.size(tags) >= 3, 0.1).otherwise(0.0) + F.when(F.length(content) > 500, 0.1).otherwise(0.0)
    return F.least(total + F.when(content.rlike(P.CODE_SPAN) | content.rlike(P.FILE_PATH), 0.1).otherwise(0.0), F.lit(1.0))


def valence(content: Column) -> Column:
    """(successes - errors) / both, 0 without any."""
    bad, good = F.regexp_count(content, F.lit(P.ERROR_WORDS)), F.regexp_count(content, F.lit(P.SUCCESS_WORDS))
    return F.when(bad + good == 0, 0.0).otherwise((good - bad) / (good + bad))


def decay_factor(importance: Column, valence: Column, confidence: Column) -> Column:
    """Hourly factor: slower for importance over 0.7, strong valence and confidence."""
    f = F.when(importance > 0.7, 0.998).otherwise(0.95)
    f = 1 - (1 - f) / (1 + 0.5 * F.abs(valence))
    f = 1 - (1 - f) / (1 + 0.1 * confidence)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), f))


def decayed_heat(heat: Column, hours: Column, importance: Column, valence: Column, confidence: Column, cold: float = 0.05) -> Column:
    """Heat after ``hours``; below ``cold`` it is 0."""
    left = heat * F.pow(decay_factor(importance, valence, confidence), F.greatest(hours, F.lit(0.0)))
    return F.when(left < cold, 0.0).otherwise(left)


def surprise_boost(heat: Column, surprise: Column) -> Column:
    return F.least(heat + 0.3 * surprise, F.lit(1.0))


def coherence(heat: Column, hours: Column, window: float = 4.0, bonus: float = 0.2) -> Column:
    """A bonus that falls linearly to 0 over the session window."""
    return F.when(hours < window, F.least(heat + bonus * (1 - hours / window), F.lit(1.0))).otherwise(heat)


def rated_confidence(access: Column, useful: Column, confidence: Column) -> Column:
    """Useful share once there are more than 3 accesses."""
    return F.when(access > 3, useful / access).otherwise(confidence)


def reliability(access: Column, confidence: Column) -> Column:
    return F.when(access < 3, 1.0).otherwise(confidence)


def half_life(value: Column, hours: Column, half: float = 6.0) -> Column:
    return value * F.pow(F.lit(2.0), -F.greatest(hours, F.lit(0.0)) / half)


def plasticity(value: Column, hours: Column, half: float = 6.0, spike: float = 0.3) -> Column:
    return F.least(half_life(value, hours, half) + spike, F.lit(1.0))


def stability(value: Column, useful: Column, access: Column, step: float = 0.1) -> Column:
    return F.when(useful, F.least(value + step, F.lit(1.0))).when(access > 5, F.greatest(value - step / 2, F.lit(0.0))).otherwise(value)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def tag_divergence(tags: Column, context: Column) -> Column:
    """1 - Jaccard of the tags and the words of the context; 0 if both are empty, 1 if one is."""
    none = (F.size(tags) == 0).cast("int") + (F.size(context) == 0).cast("int")
    return F.when(none == 2, 0.0).when(none == 1, 1.0).otherwise(1 - jaccard(tags, context))


def mismatch(similarity: Column, directory: Column, current: Column, hours: Column, tags: Column, context: Column) -> Column:
    """0.5 embedding + 0.2 directory + 0.15 time + 0.15 tags, within 0..1; a null similarity counts as 0.5."""
    place = F.when(directory == current, 0.0).when(parent(directory) == parent(current), 0.5).otherwise(1.0)
    total = 0.5 * (1 - F.coalesce(similarity, F.lit(0.5))) + 0.2 * place + 0.15 * F.least(hours / 168.0, F.lit(1.0)) + 0.15 * tag_divergence(tags, context)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def reconsolidation(mismatch: Column, stability: Column, plasticity: Column, protected: Column) -> Column:
    """none, update or archive."""
    loose = F.when(plasticity > 0.5, 0.1).otherwise(0.0)
    low, high = 0.3 + 0.2 * stability - loose, 0.7 + 0.1 * stability - loose
    return F.when(protected, "none").when(mismatch < low, "none").when(mismatch < high, "update").otherwise("archive")


def memory_class(content: Column, tags: Column) -> Column:
    """semantic by tag, else episodic if it names specifics, else semantic if it states rules or designs."""
    tagged = F.arrays_overlap(F.transform(tags, F.lower), F.array(*map(F.lit, P.SEMANTIC_TAGS)))
    general = content.rlike(P.RULE_WORDS) | content.rlike(P.THEORY_WORDS)
    return F.when(tagged, "semantic").when(content.rlike(P.SPECIFIC), "episodic").when(general, "semantic").otherwise("episodic")


def store_weights(query: Column) -> tuple[Column, Column]:
    """(episodic, semantic) weights."""
    specific, general = query.rlike(P.SPECIFIC), query.rlike(P.RULE_WORDS) | query.rlike(P.THEORY_WORDS)
    return F.when(specific & ~general, 2.0).otherwise(1.0), F.when(general & ~specific, 2.0).otherwise(1.0)


def compression_level(hours: Column, importance: Column, surprise: Column, confidence: Column, access: Column, store: Column, protected: Column, gist: float = 168.0, tag: float = 720.0) -> Column:
    """0 whole, 1 gist, 2 tag; resistance multiplies both ages."""
    hold = F.when(importance > 0.7, 2.0).otherwise(1.0) * F.when(surprise > 0.6, 1.5).otherwise(1.0)
    hold = hold * F.when(confidence > 0.8, 1.3).otherwise(1.0) * F.when(access > 10, 1.5).otherwise(1.0)
    return F.when(protected | (store == "semantic") | (hours < gist * hold), 0).when(hours < tag * hold, 1).otherwise(2)


def domains(content: Column, tags: Column) -> Column:
    """Names of the domains that score 0.3 or more; code-patterns if none does."""
    text, found = F.lower(F.array_join(tags, " ")), []
    for name, words, types, _ in P.DOMAINS:
        score = 0.3 * F.regexp_count(content, F.lit(words)) + 0.2 * F.regexp_count(text, F.lit(words))
        for kind in types:
            score = score + F.when(F.contains(F.lower(content), F.lit(kind)), 0.2).otherwise(0.0)
        found.append(F.when(F.round(score, 6) >= 0.3, F.lit(name)))
    known = F.array_compact(F.array(*found))
    return F.when(F.size(known) == 0, F.array(F.lit("code-patterns"))).otherwise(known)


def contradicts(a: Column, b: Column) -> Column:
    """One of two texts is negated and the other is not, or their actions differ."""
    actions = lambda c: F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(P.ACTION), F.lit(0)), F.lower))
    x, y = actions(a), actions(b)
    differ = (F.size(x) > 0) & (F.size(y) > 0) & (F.size(F.array_intersect(x, y)) == 0)
    return (a.rlike(P.NEGATION) != b.rlike(P.NEGATION)) | differ


def sentence_score(s: Column) -> Column:
    """Points for paths, errors, decisions, numbers, names and code."""
    return (
        _has(s, P.FILE_PATH, 3.0) + _has(s, P.ERROR_WORDS, 4.0) + _has(s, P.DECISION_WORDS, 3.0) + _has(s, P.NUMBER_VERSION, 2.0)
        + _has(s, P.CAMEL_NAME, 2.0) + F.when(F.contains(s, F.lit("`")), 2.0).otherwise(0.0)
    )
