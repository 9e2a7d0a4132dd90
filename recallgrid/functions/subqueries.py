"""Open-ended questions: content terms, compared options, topic words, sub-queries, and facts that a text implies. All Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recallgrid.functions import patterns as P
from recallgrid.functions.extract import all_of

WORD = r"[A-Za-z][\p{L}\p{N}_'-]*"
EDGE = r"""^[.,;:!?()\[\]{}"']+|[.,;:!?()\[\]{}"']+$"""


def _none() -> Column:
    return F.array().cast("array<string>")


def _once(items: Column) -> Column:
    """The first of items that are equal in lower case, in their order."""
    low = F.transform(items, lambda t: F.lower(t))
    return F.filter(items, lambda t, i: F.array_position(low, F.lower(t)) == i + 1)


def content_terms(query: Column) -> Column:
    """Words of three characters or more that carry content, each once."""
    return _once(F.filter(all_of(query, WORD), lambda t: (F.length(t) >= 3) & ~F.lower(t).isin(*P.QUERY_STOPS)))


def names(query: Column) -> Column:
    """Words after the first that begin with a capital letter."""
    words = F.filter(F.split(F.trim(query), r"\s+"), lambda w: w != "")
    return F.filter(F.transform(F.slice(words, 2, 10_000), lambda w: F.regexp_replace(w, EDGE, "")), lambda w: w.rlike(r"^\p{Lu}"))


def options(query: Column) -> Column:
    """At most two options that stand beside an "or", of at most three words each, articles left out."""
    words = all_of(F.lower(query), WORD)

    def side(near: Column) -> Column:
        bare = F.filter(near, lambda w: ~w.isin(*P.ARTICLES))
        stop = F.array_position(F.transform(bare, lambda w: w.isin(*P.QUERY_STOPS, *P.OPTION_STOPS)), True)
        return F.slice(bare, 1, F.least(F.lit(3), F.when(stop == 0, F.size(bare)).otherwise(stop - 1)).cast("int"))

    places = F.filter(F.transform(words, lambda w, i: F.when(w == "or", i)), lambda i: i.isNotNull())
    both = lambda i: F.array(
        F.array_join(F.reverse(side(F.reverse(F.slice(words, F.lit(1), i)))), " "),
        F.array_join(side(F.slice(words, i + 2, F.size(words))), " "),
    )
    return F.slice(F.array_distinct(F.filter(F.flatten(F.transform(places, both)), lambda o: o != "")), 1, 2)


def topics(query: Column) -> Column:
    """Words that go with the topics of a question, at most eight."""
    low = F.lower(query)
    found = (F.when(F.contains(low, F.lit(phrase)), F.array(*map(F.lit, words))).otherwise(_none()) for phrase, words in P.TOPICS)
    return F.slice(F.flatten(F.array(*found)), 1, 8)


def confirmed(query: Column) -> Column:
    """The statement that a question asks to confirm; other texts lose a leading modal verb."""
    text = F.trim(F.regexp_replace(F.trim(query), r"[?]+$", ""))
    out = F.regexp_replace(text, P.CONFIRM_LEAD, "")
    for pattern, verb in reversed(P.CONFIRMED):
        out = F.when(text.rlike(pattern), F.regexp_replace(text, pattern, f"$1{verb}$2")).otherwise(out)
    return out


def subqueries(query: Column, statement: Column) -> Column:
    """At most four further searches for a question: its statement, and its subject with terms, options or topic words."""
    who, rivals, more = F.slice(names(query), 1, 1), options(query), topics(query)
    known = F.transform(names(query), lambda n: F.lower(n))
    terms = F.slice(F.filter(F.slice(content_terms(query), 1, 12), lambda t: ~F.array_contains(known, F.lower(t))), 1, 8)
    joined = lambda *parts: F.array_join(F.concat(*parts), " ")
    subject, no_terms = F.size(who) > 0, F.size(terms) == 0
    made = F.concat(
        F.array(statement, F.when(subject & ~no_terms & (F.size(rivals) == 0), joined(who, F.slice(terms, 1, 4)))),
        F.when(subject, F.transform(rivals, lambda o: F.concat_ws(" ", F.get(who, F.lit(0)), o))).otherwise(_none()),
        F.array(
            F.when(subject & (F.size(more) > 0), joined(who, F.slice(more, 1, 4))).when(~subject & ~no_terms, F.array_join(F.slice(terms, 1, 6), " ")),
            F.when(F.size(more) > 0, F.array_join(F.slice(more, 1, 4), " ")),
        ),
    )
    clean = F.transform(F.array_compact(made), lambda t: F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"^[ ?.!]+|[ ?.!]+$", ""))
    return F.slice(_once(F.filter(clean, lambda t: (t != "") & (F.lower(t) != F.lower(query)))), 1, 4)


def implied_facts(content: Column) -> Column:
    """At most four short facts that the lines of a text imply about their speakers and subjects, in the order of the lines.

    What one of the first two speakers says tells about the other; other lines tell about the name that they begin with.
    """
    lines = F.filter(F.transform(F.split(content, r"\r?\n"), lambda l: F.trim(l)), lambda l: l != "")
    speakers = F.transform(F.slice(F.filter(lines, lambda l: l.rlike(P.SPEAKER)), 1, 2), lambda l: F.regexp_extract(l, P.SPEAKER, 1))
    first, second = F.get(speakers, F.lit(0)), F.get(speakers, F.lit(1))

    def told(line: Column) -> Column:
        who, said = F.regexp_extract(line, P.SPEAKER, 1), F.lower(F.regexp_extract(line, P.SPEAKER, 2))
        other = F.when(who == first, second).when(who == second, first)
        praise = F.array(*(F.when(said.rlike(words), F.concat(other, F.lit(fact))) for words, fact in P.PRAISE))
        subject, low = F.regexp_extract(line, r"^([A-Z][a-z]+)\b", 1), F.lower(line)
        stated = [F.when(line.rlike(p) & (_object(line, p) != ""), F.concat(F.regexp_extract(line, p, 1), F.lit(verb), _object(line, p))) for p, verb in P.FACTS]
        hints = [F.when(low.rlike(words) & (~low.rlike(unless) if unless else F.lit(True)), F.concat(subject, F.lit(fact))) for words, unless, fact in P.HINTS]
        return F.when(line.rlike(P.SPEAKER), praise).when(subject != "", F.array(*stated, *hints)).otherwise(_none())

    facts = F.array_compact(F.flatten(F.transform(lines, told)))
    return F.transform(F.slice(_once(F.transform(facts, lambda t: F.regexp_replace(F.trim(t), r"[.]+$", ""))), 1, 4), lambda t: F.concat(t, F.lit(".")))


def _object(line: Column, pattern: str) -> Column:
    """The object of a fact up to its next clause, ten words at most."""
    short = F.regexp_replace(F.regexp_replace(F.regexp_extract(line, pattern, 2), P.CLAUSE_END, ""), r"^[ ,.;:!?]+|[ ,.;:!?]+$", "")
    return F.array_join(F.slice(F.split(short, r"\s+"), 1, 10), " ")
