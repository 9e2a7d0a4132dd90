"""Rule conditions and actions as Columns: filters and score changes in order of priority."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS = ("not_contains", ">=", "<=", "==", "!=", ">", "<", "contains", "matches")
NUMBERS = ("heat", "importance", "confidence", "valence", "surprise", "access_count", "plasticity", "stability")


@dataclass(frozen=True)
class Rule:
    """kind: hard (filter) or soft (boost:x, penalty:x). scope: global, directory or file, with its value."""

    condition: str
    action: str
    kind: str = "soft"
    scope: str = "global"
    value: str = ""
    priority: int = 0
    active: bool = True


def parse(condition: str) -> tuple[str, str, str]:
    """(field, operator, value); longer operators first."""
    for op in OPERATORS:
        left, found, right = condition.partition(f" {op} ")
        if found:
            return left.strip(), op, right.strip()
    raise ValueError(f"no operator in {condition!r}")


def parse_action(action: str) -> tuple[str, float]:
    name, _, amount = action.partition(":")
    if name == "filter":
        return name, 0.0
    if name not in ("boost", "penalty"):
        raise ValueError(f"unknown action {action!r}")
    return name, float(amount)


def glob_pattern(glob: str) -> str:
    """A file glob as an anchored pattern: * any run, ? one character."""
    return "^(?s)" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in glob) + "$"


def predicate(condition: str, columns: list[str]) -> Column:
    """The condition on memory columns. ``tag`` means any tag; an unknown field is looked up as a ``field:value`` or ``field=value`` tag."""
    name, op, value = parse(condition)
    low = value.lower()
    if name in ("tag", "tags"):
        texts = lambda test: F.exists("tags", lambda t: test(F.lower(t)))
        return _text_test(op, low, texts)
    if name in NUMBERS:
        x, v = F.coalesce(F.col(name).cast("double"), F.lit(0.0)), float(value)
        return {">": x > v, "<": x < v, ">=": x >= v, "<=": x <= v, "==": x == v, "!=": x != v}[op]
    if name in columns:
        own = F.lower(F.coalesce(F.col(name).cast("string"), F.lit("")))
        return _text_test(op, low, lambda test: test(own))
    values = F.transform(F.filter("tags", lambda t: F.lower(t).rlike(f"^{re.escape(name.lower())}[:=]")), lambda t: F.regexp_replace(F.lower(t), "^[^:=]+[:=]", ""))
    own = F.coalesce(F.get(values, F.lit(0)), F.lit(""))
    return _text_test(op, low, lambda test: test(own))


def _text_test(op: str, value: str, apply) -> Column:
    if op == "==":
        return apply(lambda c: c == value)
    if op == "!=":
        return ~apply(lambda c: c == value)
    if op == "contains":
        return apply(lambda c: F.contains(c, F.lit(value)))
    if op == "not_contains":
        return ~apply(lambda c: F.contains(c, F.lit(value)))
    if op == "matches":
        return apply(lambda c: c.rlike(glob_pattern(value)))
    raise ValueError(f"{op} needs a number field")


def applicable(rules: list[Rule], directory: str, file: str = "") -> list[Rule]:
    """Active rules of the global scope, of a directory that begins ``directory``, or of a glob that fits ``file``."""
    fits = {"global": lambda r: True, "directory": lambda r: directory.startswith(r.value), "file": lambda r: bool(file) and re.match(glob_pattern(r.value).replace("^(?s)", "(?s)"), file)}
    return sorted((r for r in rules if r.active and fits[r.scope](r)), key=lambda r: -r.priority)


def applicable_to(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, rule) for rows (id, directory, file) and a table of rules: global ones, those whose directory begins the row's, and
    those whose glob fits its file. The table is written by hand, so it is taken along as one array.
    """
    listed = rules.where("active").agg(F.collect_list(F.struct("id", "scope", "value")).alias("r")).scalar()
    quoted = F.regexp_replace(F.col("r.value"), r"([.^$+(){}|\[\]\\])", r"\\$1")
    glob = F.concat(F.lit("^(?s)"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))
    scope = F.col("r.scope")
    fits = (scope == "global") | ((scope == "directory") & F.col("directory").startswith(F.col("r.value"))) | ((scope == "file") & F.coalesce(F.rlike("file", glob), F.lit(False)))
    return rows.select("id", "directory", "file", F.explode(listed).alias("r")).where(fits).select("id", F.col("r.id").alias("rule"))


def apply_rules(rows: DataFrame, rules: list[Rule], score: str = "score") -> DataFrame:
    """Rows after all rules in order: hard rules keep or drop, soft rules raise or lower the score."""
    for rule in rules:
        test, (name, amount) = predicate(rule.condition, rows.columns), parse_action(rule.action)
        if rule.kind == "hard" or name == "filter":
            rows = rows.where(test)
        else:
            rows = rows.withColumn(score, F.when(test, F.col(score) + (amount if name == "boost" else -amount)).otherwise(F.col(score)))
    return rows


def checked(rule: Rule) -> Rule:
    """The rule, or a ValueError: kinds, scopes, conditions and actions must be known; hard rules filter."""
    if rule.kind not in ("hard", "soft"):
        raise ValueError(f"kind must be hard or soft, not {rule.kind!r}")
    if rule.scope not in ("global", "directory", "file"):
        raise ValueError(f"scope must be global, directory or file, not {rule.scope!r}")
    parse(rule.condition)
    if parse_action(rule.action)[0] != "filter" and rule.kind == "hard":
        raise ValueError("hard rules filter")
    return rule


def added(rules: DataFrame, rule: Rule) -> DataFrame:
    """The table of rules (id, condition, action, kind, scope, value, priority, active) with a checked rule under the next id."""
    r = checked(rule)
    number = (F.coalesce(F.max("id"), F.lit(0)) + 1).cast("long").alias("id")
    fields = {"condition": r.condition, "action": r.action, "kind": r.kind, "scope": r.scope, "value": r.value, "priority": r.priority, "active": r.active}
    return rules.unionByName(rules.agg(number).select("id", *(F.lit(v).alias(k) for k, v in fields.items())))


def retired(rules: DataFrame, number: int) -> DataFrame:
    """The table with a rule out of use; the row stays."""
    return rules.withColumn("active", F.col("active") & (F.col("id") != number))


def listed(rules: DataFrame) -> DataFrame:
    """Rules in use with their place, by scope and falling priority."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("scope", F.desc("priority"), "id"))  # rules are written by hand
    return rules.where("active").withColumn("place", place)
