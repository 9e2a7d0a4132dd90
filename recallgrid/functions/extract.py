"""Text to terms, sentences, entities, intentions, attributes and time expressions; expressions and exploded frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid.functions import patterns as P


def all_of(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once a row however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _runs(words: Column, body) -> Column:
    """``body(word, start, n)`` for each different word of ``words``, at its ``n`` places from ``start`` in the sorted words."""
    at = lambda w, i: F.get(w, i)

    def of(w: Column) -> Column:
        places = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: (i == 0) | (at(w, i) != at(w, i - 1)))
        return let(starts, lambda s: F.transform(s, lambda i, k: body(at(w, i), i, F.coalesce(at(s, k + 1), F.size(w)) - i)))

    return let(F.sort_array(words), of)


def counted(words: Column) -> Column:
    """(term, tf) of each different word of an array, sorted by word: within the row, in the time of a sort."""
    return _runs(words, lambda word, i, n: F.struct(word.alias("term"), n.cast("long").alias("tf")))


def numbered(words: Column) -> Column:
    """The words with a space and the number of the occurrence, so that equal words differ; words hold no space."""
    return F.flatten(_runs(words, lambda word, i, n: F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(word, F.lit(" "), k))))


def identifier_parts(text: Column) -> Column:
    """The text, and the parts of its CamelCase and snake_case tokens."""
    cut = lambda t: F.filter(F.split(F.regexp_replace(F.regexp_replace(t, "([a-z])([A-Z])", "$1 $2"), "_", " "), r"\s+"), lambda x: x != "")
    parts = F.flatten(F.transform(F.split(text, r"\s+"), lambda t: F.when(F.size(cut(t)) > 1, F.filter(cut(t), lambda x: x != t)).otherwise(F.array().cast("array<string>"))))
    return F.when(F.size(parts) > 0, F.concat(text, F.lit(" "), F.array_join(parts, " "))).otherwise(text)


def query_terms(text: Column) -> Column:
    """Terms of a search: identifier parts of two characters or more that are no stop words."""
    cut = F.regexp_replace(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2"), r"[_.]", " ")
    bare = F.transform(F.split(cut, r"\s+"), lambda t: F.regexp_replace(t, r"""^[?!,;:()\[\]{}"']+|[?!,;:()\[\]{}"']+$""", ""))
    return F.filter(bare, lambda t: (F.length(t) >= 2) & ~F.lower(t).isin(*P.STOP_WORDS))


def query_entities(text: Column) -> Column:
    """Paths, dotted names, errors, capitalised names and words of three characters or more, each once."""
    words = F.filter(F.transform(F.split(text, r"\s+"), lambda t: F.regexp_replace(t, r"""^[.,;:!?()\[\]{}"']+|[.,;:!?()\[\]{}"']+$""", "")), lambda t: F.length(t) > 2)
    named = F.concat(all_of(text, P.FILE_PATH), all_of(text, P.DOTTED_NAME), all_of(text, P.ERROR_NAME), all_of(text, P.CAPITAL_NAME))
    return F.array_distinct(F.concat(F.filter(named, lambda t: F.length(t) > 1), words))


def sentences(text: Column) -> Column:
    """Split after ., ! or ? before white space, and at line ends."""
    marked = F.regexp_replace(text, r"([.!?])\s+", "$1\n")
    return F.filter(F.transform(F.split(marked, r"\n+"), lambda s: F.trim(s)), lambda s: s != "")


def intentions(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, phrase) of every intention of five characters or more."""
    found = F.flatten(F.array(*(all_of(F.col(text_col), p, 1) for p in P.INTENTIONS)))
    return df.select(id_col, F.explode(found).alias("phrase")).select(id_col, F.trim("phrase").alias("phrase")).where("length(phrase) >= 5")


def attributes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, name, kind, key, value, confidence) of every personal attribute."""
    text, parts = F.col(text_col), []
    for kind, key, pattern, confidence in P.ATTRIBUTES:
        pairs = F.arrays_zip(all_of(text, pattern, 1).alias("name"), all_of(text, pattern, 2).alias("value"))
        parts.append(F.transform(pairs, _attribute(kind, key, confidence)))
    rows = df.select(id_col, F.inline(F.flatten(F.array(*parts))))
    return rows.where(F.col("name").rlike("^[A-Z][a-z]+$") & ~F.col("name").isin(*P.NOT_NAMES) & (F.col("value") != ""))


def _attribute(kind: str, key: str | None, confidence: float):
    def build(pair: Column) -> Column:
        value = F.trim(pair["value"])
        named = F.lit(key) if key else F.substring(F.replace(F.lower(value), F.lit(" "), F.lit("_")), 1, 50)
        return F.struct(pair["name"].alias("name"), F.lit(kind).alias("kind"), named.alias("key"), value.alias("value"), F.lit(confidence).alias("confidence"))

    return build


def times(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, kind, expression) of every time expression."""
    kinds = [F.transform(all_of(F.col(text_col), p, 1), _of_kind(k, "expression", F.lower)) for k, p in P.TIMES]
    return df.select(id_col, F.inline(F.flatten(F.array(*kinds))))


def _of_kind(kind: str, name: str, change=lambda c: c):
    return lambda found: F.struct(change(found).alias(name), F.lit(kind).alias("kind"))


ENTITY_FORMS = (
    ("file", rf"({P.FILE_PATH})"),
    ("function", r"\b(?:def|class)\s+(\w+)"),
    ("function", P.FUNCTION_WORD),
    ("error", r"\b(\w*(?:Error|Exception))\b"),
    ("error", P.TRACEBACK),
    ("dependency", P.IMPORTED),
    ("dependency", r"(?:^|\n)\s*from\s+([\w.]+)\s+import"),
    ("dependency", P.REQUIRED),
    ("decision", P.DECISION_SPAN),
)


def entities(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, name, kind) of code files, definitions, errors, imports and decisions, each once for an id."""
    found = [F.transform(all_of(F.col(text_col), p, 1), _of_kind(k, "name")) for k, p in ENTITY_FORMS]
    rows = df.select(id_col, F.inline(F.array_distinct(F.flatten(F.array(*found)))))
    return rows.where((F.col("kind") != "file") | F.col("name").rlike(P.CODE_SUFFIX))


def _typed(names: Column, kind: str, context: str = "") -> Column:
    return F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(kind).alias("kind"), F.lit(context).alias("context")))


def typed_entities(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, name, kind, context) of imports, definitions, errors and decisions, each once for an id.

    context is the kind of relation that the text states: imports (names of a module), calls (a function of the same text,
    outside lines that define), resolved_by (an error that was fixed), decided_to_use (both sides of a decision), or empty.
    """
    text = F.col(text_col)
    imported = F.flatten(F.transform(all_of(text, P.FROM_IMPORT, 2), lambda names: F.transform(F.split(names, ","), lambda n: F.trim(n))))
    lines = F.filter(F.split(text, "\n"), lambda l: ~l.rlike(r"^\s*def "))
    called = F.array_intersect(F.flatten(F.transform(lines, lambda l: all_of(l, P.CALLED, 1))), all_of(text, P.DEFINED, 1))
    found = F.array(
        _typed(all_of(text, P.FROM_IMPORT, 1), "dependency"), _typed(F.filter(imported, lambda n: n != ""), "function", "imports"), _typed(all_of(text, P.IMPORTED, 1), "dependency"),
        _typed(all_of(text, P.DEFINED, 1), "function"), _typed(called, "function", "calls"), _typed(all_of(text, P.ERROR_FIXED, 1), "error", "resolved_by"),
        _typed(all_of(text, P.DECIDED, 1), "decision", "decided_to_use"), _typed(all_of(text, P.DECIDED, 2), "decision", "decided_to_use"),
    )
    return df.select(id_col, F.inline(F.array_distinct(F.flatten(found))))
