"""License scans by ordered signature rules, in DataFrame expressions alone.

A text becomes its words, A-Z lower-cased, between single spaces. A text that holds no keyword of any rule is done with; of
the others, a keyword's rules run only where one expression of all their patterns matches, and then each for itself. Each
match is a detection with an interval and a priority. A detection inside another one's interval is suppressed; of equal
intervals the higher priority stays. The rules are sentences of license texts, notices and deeds (``license_texts``), written
one by one, and the forms in which licenses are named, from families, versions and forms.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.llm.license_texts import TEXTS

@dataclass(frozen=True)
class Rule:
    """pattern: over words between single spaces; it must not take the space before or after. Order in the list breaks ties.

    A rule runs only where the words hold ``keyword`` at the start of a word, and ``also`` anywhere; so every text that
    the pattern matches must hold both.
    """

    label: str
    keyword: str
    pattern: str
    priority: int
    also: str = ""


# The base phrases.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

# (label, keyword, name pattern, whether the bare name with "license" is enough); names without a common keyword are apart.
FAMILIES = (
    ("mit", "mit ", r"mit", True),
    ("mit", "expat ", r"expat", True),
    ("mit", "x11 ", r"x11", True),
    ("mit-0", "mit ", r"mit (?:no attribution|0)", False),
    ("bsd-2-clause", "clause", r"(?:bsd 2|2|two) clause(?: bsd)?", True),
    ("bsd-2-clause", "bsd", r"simplified bsd", True),
    ("bsd-2-clause", "freebsd", r"freebsd", True),
    ("bsd-3-clause", "clause", r"(?:bsd 3|3|three) clause(?: bsd)?", True),
    ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|revised bsd)", True),
    ("bsd-4-clause", "clause", r"(?:bsd 4|4|four) clause(?: bsd)?", True),
    ("bsd-4-clause", "bsd", r"original bsd", True),
    ("bsd", "bsd", r"bsd(?: style)?", True),
    ("apache-1.1", "apache", r"apache(?: software)?(?: license)?(?: version| v)? 1 1", False),
    ("apache-2", "apache", r"apache(?: software)?(?: license)?(?: version| v)? ?2(?: 0)?", False),
    ("isc", "isc", r"isc", True),
    ("zlib", "zlib", r"zlib(?: libpng)?", True),
    ("boost-1.0", "boost", r"boost(?: software)?(?: license)?(?: version)?(?: 1 0)?", True),
    ("unlicense", "unlicense", r"unlicense", False),
    ("wtfpl", "wtfpl", r"wtfpl", False),
    ("wtfpl", "do what the fuck", r"do what the fuck you want to public", False),
    ("python-2", "python", r"python(?: software foundation)?(?: license)?(?: version)?(?: 2)?", True),
    ("postgresql", "postgresql", r"postgresql", True),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?", True),
    ("openssl", "openssl", r"openssl", True),
    ("php-3.01", "php", r"php(?: license)?(?: version)?(?: 3 01)?", True),
    ("ruby", "ruby", r"ruby", True),
    ("vim", "vim ", r"vim", True),
    ("perl-artistic-1", "artistic", r"artistic(?: license)?(?: version)? 1(?: 0)?", False),
    ("artistic-2", "artistic", r"artistic(?: license)?(?: version)? 2(?: 0)?", False),
    ("ofl-1.1", "sil", r"sil open font(?: license)?(?: version)?(?: 1 1)?", True),
    ("odbl-1.0", "open database", r"open database(?: license)?(?: 1 0)?", True),
    ("pddl-1.0", "public domain", r"public domain dedication and(?: license)?(?: 1 0)?", True),
    ("pddl-1.0", "pddl", r"pddl(?: license)?(?: 1 0)?", True),
    ("public-domain", "public domain", r"(?:the )?public domain", False),
    ("ms-pl", "microsoft", r"microsoft public", True),
    ("ms-rl", "microsoft", r"microsoft reciprocal", True),
    ("eupl-1.1", "european union", r"european union public(?: license| licence)?(?: version)? 1 1", False),
    ("eupl-1.2", "european union", r"european union public(?: license| licence)?(?: version)? 1 2", False),
    ("cecill-2.1", "cecill", r"cecill(?: free software)?(?: license)?(?: 2 1)?", True),
    ("json", "json", r"json", True),
    ("beerware", "beerware", r"beerware", False),
    ("beerware", "beer ware", r"beer ware", False),
    ("proprietary", "proprietary", r"proprietary", True),
    ("all-rights-reserved", "all rights", r"all rights reserved", False),
    ("bsl-1.1", "business source", r"business source(?: license)?(?: 1 1)?", True),
    ("sspl-1", "server side", r"server side public(?: license)?(?: version)?(?: 1)?", True),
    ("elastic-2", "elastic", r"elastic(?: license)?(?: 2 0)?", True),
)
# (label stem, keyword, name pattern, versions): a family for each version, alone and "or later".
VERSIONED = (
    ("gpl", "general public", r"gnu general public(?: license| licence)?", ("1", "2", "3")),
    ("lgpl", "gnu l", r"gnu (?:lesser|library) general public(?: license| licence)?", ("2", "2 1", "3")),
    ("agpl", "affero", r"gnu affero general public(?: license| licence)?", ("1", "3")),
    ("gpl", "gpl", r"(?:gnu )?gpl", ("1", "2", "3")),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl", ("2", "2 1", "3")),
    ("agpl", "agpl", r"(?:gnu )?agpl", ("1", "3")),
    ("gfdl", "free documentation", r"gnu free documentation(?: license| licence)?", ("1 1", "1 2", "1 3")),
    ("mpl", "mozilla", r"mozilla public(?: license| licence)?", ("1 0", "1 1", "2 0")),
    ("mpl", "mpl", r"mpl", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse", r"eclipse public(?: license| licence)?", ("1 0", "2 0")),
    ("cddl", "common development", r"common development and distribution(?: license| licence)?", ("1 0", "1 1")),
    ("cpl", "common public", r"common public(?: license| licence)?", ("1 0",)),
    ("osl", "open software", r"open software(?: license| licence)?", ("1 0", "2 0", "3 0")),
    ("afl", "academic free", r"academic free(?: license| licence)?", ("1 1", "2 0", "3 0")),
)
CC_KINDS = (("by", "attribution"), ("by-sa", "attribution share ?alike"), ("by-nc", "attribution non ?commercial"), ("by-nd", "attribution no ?derivati(?:ve)?s?"), ("by-nc-sa", "attribution non ?commercial share ?alike"), ("by-nc-nd", "attribution non ?commercial no ?derivati(?:ve)?s?"))
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
_GRANT = r"(?:licen[sc]ed|released|distributed|available|provided|published|redistributed|covered|shared) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?"
_LICENSE = r"(?: licen[sc]es?)?"


def default_rules() -> list[Rule]:
    """All signature rules: license texts, then the forms in which a license is named, most specific first."""
    out = [Rule(label, keyword, pattern, priority) for label, keyword, pattern, priority in TEXTS]

    def forms(label: str, keyword: str, name: str, bare: bool) -> None:
        out.append(Rule(label, keyword, rf"spdx license identifier (?:{name})", 40, " spdx "))
        out.append(Rule(label, keyword, rf"{_GRANT}(?:{name}){_LICENSE}", 30, " under "))
        out.append(Rule(label, keyword, rf"(?:{name}) licen[sc]e" if bare else rf"(?:{name}){_LICENSE}", 20, " licen" if bare else ""))

    for stem, keyword, name, versions in VERSIONED:
        for v in versions:
            number = rf"(?: ?v ?| version )?{v if ' ' in v else v + '(?: 0)?'}"
            label = f"{stem}-{v.replace(' ', '.')}"
            forms(f"{label}-or-later", keyword, rf"{name} ?{number}(?: of the license)?(?: or (?:at your option )?any later(?: version)?| or later| plus)", False)
            forms(label, keyword, rf"{name} ?{number}", False)
        forms(stem, keyword, name, False)
    for kind, words in CC_KINDS:
        short = kind.replace("-", " ")
        for v in CC_VERSIONS:
            forms(f"cc-{kind}-{v.replace(' ', '.')}", "cc by", rf"cc {short} {v}", False)
            forms(f"cc-{kind}-{v.replace(' ', '.')}", "creative commons", rf"creative commons {words} {v}(?: international| unported| generic)?", False)
        forms(f"cc-{kind}", "creative commons", rf"creative commons {words}", False)
        forms(f"cc-{kind}", "cc by", rf"cc {short}", False)
    forms("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?", False)
    for label, keyword, name, bare in FAMILIES:
        forms(label, keyword, name, bare)
    return out


def words_of(text: Column) -> Column:
    """Words of ``text``, lower-cased, with one space before and after each; one space for none.

    Beyond A-Z, lower-casing moves only characters that stand in no phrase or pattern; the one that would become an ASCII
    letter, the Kelvin sign, is put aside.
    """
    own = F.replace(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")), F.lit("\u212a"), F.lit("\u24c0"))
    return F.regexp_replace(F.lower(own), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


_FOUND = "array<struct<from:int,to:int,label:string,priority:int,turn:int>>"


def _matches(body: Column, rule: Column) -> Column:
    """Intervals of a rule's matches, from the texts between them."""
    found = F.regexp_extract_all(body, rule["pattern"], F.lit(0))
    item = lambda at, x: F.struct((at + F.length(x["b"])).alias("from"), (at + F.length(x["b"]) + F.length(x["m"])).alias("to"), rule["label"].alias("label"), rule["priority"].alias("priority"), rule["turn"].alias("turn"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_FOUND).alias("out"))
    pairs = F.arrays_zip(found.alias("m"), F.slice(F.split(body, rule["pattern"], -1), 1, F.size(found)).alias("b"))
    placed = F.aggregate(pairs, zero, lambda acc, x: F.struct((acc["at"] + F.length(x["b"]) + F.length(x["m"])).alias("at"), F.concat(acc["out"], F.array(item(acc["at"], x))).alias("out")), lambda acc: acc["out"])
    return placed


def _sql(text: str) -> str:
    """A string literal; the rule table is given as one SQL expression, as thousands of Column calls take long."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def any_of(words: list[str]) -> str:
    """An expression that matches any of ``words``, as a tree by letters: at each place few branches are tried."""
    if "" in words:
        return ""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[0], []).append(w[1:])
    branches = [re.escape(first) + any_of(rest) for first, rest in sorted(by.items())]
    return branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"


def _keyword_groups(rules: list[Rule]) -> dict[str, list[Rule]]:
    by: dict[str, list[Rule]] = {}
    for r in rules:
        by.setdefault(r.keyword, []).append(r)
    return by


def _present(body: str, rules: list[Rule]) -> Column:
    """Numbers of the keyword groups of which some rule matches: one literal expression of a group's patterns, behind its keyword."""
    tests = []
    groups = _keyword_groups(rules)
    for n, (keyword, own) in enumerate(groups.items()):
        either = "|".join(dict.fromkeys(r.pattern for r in own))
        tests.append(f"CASE WHEN contains({body}, {_sql(' ' + keyword)}) AND rlike({body}, {_sql(f'(?<= )(?:{either})(?= )')}) THEN {n} END")
    return F.expr(f"CASE WHEN rlike({body}, {_sql(' ' + any_of(list(groups)))}) THEN array_compact(array({', '.join(tests)})) ELSE CAST(array() AS array<int>) END")


def _hits(body: Column, present: Column, rules: list[Rule]) -> Column:
    """All matches of the rules of the groups in ``present``, each rule for itself."""
    turns = {id(r): i for i, r in enumerate(rules)}

    def row(r: Rule) -> str:
        return f"struct({_sql(r.label)} AS label, {_sql(r.also)} AS also, {_sql(rf'(?<= )(?:{r.pattern})(?= )')} AS pattern, {r.priority} AS priority, {turns[id(r)]} AS turn)"

    groups = F.expr(f"array({', '.join('array(' + ', '.join(map(row, own)) + ')' for own in _keyword_groups(rules).values())})")
    named = F.flatten(F.transform(present, lambda n: F.get(groups, n)))
    tried = F.filter(named, lambda r: F.contains(body, r["also"]) & F.rlike(body, r["pattern"]))
    return F.flatten(F.transform(tried, lambda r: _matches(body, r)))


def scan(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text", base=BASE) -> DataFrame:
    """All columns of ``docs`` and n_words, n_base, first_word, last_word, base_labels, labels, score and detections.

    detections: all matches, in the order in which suppression reads them (start, longer, higher priority, rule order).
    labels: those of the base phrases and of detections that are not suppressed. score: 1 with a base phrase, else the
    highest priority of a detection over 40, at most 1. A null or empty text has no words and no labels. Every row stays,
    repeated rows too; texts of any length are scanned whole; an empty table gives an empty one; columns of those names give way.
    """
    rules = default_rules() if rules is None else rules
    own = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")
    kept = docs.drop(*own)
    body = F.col("_body")
    rows = kept.withColumn("_body", words_of(F.col(text_col)))
    words = _spaces(body) - 1
    counts, firsts, lasts = [], [], []
    for _, phrase in base:
        between = F.split(body, f" {phrase}(?= )", -1)
        has = F.contains(body, F.lit(f" {phrase} "))
        size = len(phrase.split(" "))
        counts.append(F.when(has, F.size(between) - 1).otherwise(0))
        firsts.append(F.when(has, _spaces(F.get(between, F.lit(0)))))
        lasts.append(F.when(has, words - (_spaces(F.element_at(between, -1)) - 1) - size))
    tagged = [F.when(F.contains(body, F.lit(f" {p} ")), F.lit(l)) for l, p in base]
    base_labels = F.array_sort(F.array_distinct(F.array_compact(F.array(*tagged))))
    rows = rows.withColumn("_present", _present("_body", rules))
    order = F.transform(_hits(body, F.col("_present"), rules), lambda h: F.struct(h["from"].alias("from"), (-h["to"]).alias("end"), (-h["priority"]).alias("rank"), h["turn"].alias("turn"), h["label"].alias("label")))
    empty = F.array().cast("array<struct<from:int,end:int,rank:int,turn:int,label:string>>")
    rows = rows.withColumn("_hits", F.when(F.size("_present") > 0, F.array_sort(order)).otherwise(empty))
    zero = F.struct(F.lit(-1).alias("reach"), F.array().cast("array<string>").alias("labels"))
    merge = lambda acc, h: F.struct(F.greatest(acc["reach"], -h["end"]).alias("reach"), F.when(-h["end"] > acc["reach"], F.array_union(acc["labels"], F.array(h["label"]))).otherwise(acc["labels"]).alias("labels"))
    found = F.aggregate("_hits", zero, merge, lambda acc: acc["labels"])
    rows = rows.select(
        *(kept.columns),
        words.cast("long").alias("n_words"),
        sum(counts[1:], counts[0]).cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"),
        base_labels.alias("_base"),
        found.alias("_found"),
        F.transform("_hits", lambda h: F.struct(h["from"].alias("from"), (-h["end"]).alias("to"), h["label"].alias("label"), (-h["rank"]).alias("priority"))).alias("detections"),
    )
    best = F.least(F.coalesce(F.array_max(F.transform("detections", lambda h: h["priority"])), F.lit(0)) / F.lit(40.0), F.lit(1.0))
    return rows.select(
        *(kept.columns), "n_words", "n_base", "first_word", "last_word",
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", "_found")), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(best).alias("score"),
        "detections",
    )


def detections(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each detection of ``scan`` that is not suppressed: id, character interval in the words, label, priority."""
    numbered = scanned.select(id_col, "detections").withColumn("_row", F.monotonically_increasing_id())
    rows = numbered.select(id_col, "_row", F.posexplode("detections").alias("at", "d")).select(id_col, "_row", "at", "d.*")
    before = F.max("to").over(Window.partitionBy("_row").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_reach", before).where("_reach is null or to > _reach").drop("_reach", "_row", "at")
