"""Weighted lexicon matching with Aho-Corasick after folding look-alike characters and digit substitutions.

The lexicon holds whole words and word beginnings. Seed entries are a parameter; the others and all weights are learned
from labelled rows as smoothed log-odds. An exception phrase that covers a match takes it away; beside the given phrases,
pairs of words around an entry that stand in clean labelled rows only are learned as exceptions. A document's evidence is
the sum of matched weights; a logistic function of its logarithm and of its density per word gives the score. That
function is fitted on evidence from lexicons that were learned without the rows in question.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallgrid.llm.encode import text_slices
from recallgrid.llm.quality import logistic, training_rows
from recallgrid.llm.shared import discard, stored

# Cyrillic, Greek, Armenian and Cherokee letters that look like Latin ones, and digits and signs written for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ғ": "f", "ԍ": "g", "һ": "h", "н": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "п": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ц": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ӡ": "z", "ё": "e", "ї": "i",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ϲ": "c",
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "Ꭺ": "a", "Ᏼ": "b", "Ꮯ": "c", "Ꭰ": "d", "Ꭼ": "e", "ı": "i", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l"}
# Seed words and phrases that excuse a word.
SEEDS = ("idiot", "moron", "scum", "worthless", "pathetic", "stupid", "imbecile", "loser", "vermin", "filthy", "dumbass", "bastard", "retard", "degenerate", "subhuman")
EXCEPTIONS = (
    "clown fish", "class clown", "trash can", "trash bin", "pond scum", "soap scum", "worthless check", "sore loser", "loser pays", "winner and loser", "fire retardant",
    "degenerate case", "degenerate matter", "degenerate triangle", "pathetic fallacy", "bastard file", "bastard title", "white trash bag", "filthy rich", "the idiot by dostoevsky",
)

_letter = re.compile(r"(?:LATIN (?:SMALL |CAPITAL )?LETTER (?:SMALL CAPITAL )?|(?:NEGATIVE )?(?:CIRCLED|SQUARED|PARENTHESIZED) LATIN (?:SMALL|CAPITAL) LETTER |REGIONAL INDICATOR SYMBOL LETTER )([A-Z])(?: WITH .*)?$")


def _letter_table() -> dict[int, str | None]:
    """Every character that Unicode names as a form of a Latin letter, to that letter; marks and invisible characters to nothing."""
    table: dict[int, str | None] = {ord(k): v for k, v in LOOKALIKES.items()}
    for code in (*range(0x80, 0x2E80), *range(0xA640, 0xAB70), *range(0x1F100, 0x1F200)):
        char = chr(code)
        if unicodedata.category(char) in ("Mn", "Cf"):
            table[code] = None
        elif found := _letter.match(unicodedata.name(char, "")):
            table.setdefault(code, found[1].lower())
    return table


_fold = _letter_table()
_digits = str.maketrans(DIGITS)
_sign = re.compile(r"(?<=[^\W\d_])[@$!|](?=[^\W\d_])")
_numbered = re.compile(r"\b\w*[0-9]\w*")
_gap = re.compile(r"[^a-z\x80-\U0010ffff]+")


@dataclass(frozen=True)
class ToxicitySettings:
    """sample: most labelled rows that training uses. support: least share (and ``least`` count) of toxic rows with an entry.

    odds: least log-odds of an entry. letters: shortest and longest word that can become an entry. beginnings: letters of
    word beginnings. most: entries, and learned exceptions, that a model holds; those of the largest odds. excuse: clean
    rows that a learned exception stands in. folds: parts of the sample; the curve sees each through the others' lexicon.
    """

    sample: int = 10_000
    support: float = 0.01
    least: int = 3
    odds: float = 2.0
    letters: tuple[int, int] = (3, 40)
    beginnings: tuple[int, ...] = (4, 5, 6, 7, 8)
    most: int = 20_000
    excuse: int = 3
    folds: int = 3
    seeds: tuple[str, ...] = SEEDS
    exceptions: tuple[str, ...] = EXCEPTIONS


@dataclass(frozen=True)
class Lexicon:
    """entries: weight by word (``=word``) or beginning (``^begin``). curve: bias, slope of log evidence, slope of density."""

    entries: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, float, float] = (-4.0, 3.0, 0.1)
    exceptions: tuple[str, ...] = EXCEPTIONS


def folded(text: str) -> str:
    """Lower-case words of ``text`` after folding, with one space before and after each.

    Compatibility forms (full-width, mathematical) and accents go first, then look-alikes; digits count as letters only in
    words that hold a letter, signs only between letters.
    """
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).lower().translate(_fold)
    if _numbered.search(text):
        text = _numbered.sub(lambda m: m[0].translate(_digits) if any(c.isalpha() for c in m[0]) else m[0], text)
    if "@" in text or "$" in text or "!" in text or "|" in text:
        text = _sign.sub(lambda m: SIGNS[m[0]], text)
    return f" {_gap.sub(' ', text).strip()} "


def candidates(text: str, lengths: Iterable[int], letters: tuple[int, int] = (3, 40)) -> set[str]:
    """Possible entries of one document."""
    words = set(folded(text).split())
    out = {f"={w}" for w in words if letters[0] <= len(w) <= letters[1]}
    for k in lengths:
        out |= {f"^{w[:k]}" for w in words if len(w) > k}
    return out


def word_pairs(text: str, entries: dict[str, float], lengths: Iterable[int]) -> set[str]:
    """Pairs of neighbouring words of one document of which one is matched by an entry."""
    words = folded(text).split()
    hit = [f"={w}" in entries or any(f"^{w[:k]}" in entries for k in lengths if len(w) > k) for w in words]
    return {f"{a} {b}" for a, b, x, y in zip(words, words[1:], hit, hit[1:], strict=False) if x or y}


class Matcher:
    """The automaton of a lexicon and its exception phrases."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.automaton = ahocorasick.Automaton()
        for entry, weight in lexicon.entries.items():
            pattern = f" {entry[1:]} " if entry[0] == "=" else f" {entry[1:]}"
            self.automaton.add_word(pattern, (weight, len(pattern), False))
        for phrase in lexicon.exceptions:
            pattern = folded(phrase)
            self.automaton.add_word(pattern, (0.0, len(pattern), True))
        if len(self.automaton):
            self.automaton.make_automaton()

    def evidence(self, text: str) -> tuple[float, int, int]:
        """(sum of weights, matched words, words). A word counts once, with its largest weight."""
        text = folded(text)
        words = text.count(" ") - 1 if len(text) > 2 else 0
        if not len(self.automaton):
            return 0.0, 0, words
        best: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (weight, length, excuse) in self.automaton.iter(text):
            start = end - length + 1
            if excuse:
                excused.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        if excused:
            covered, reach, starts = {}, 0, sorted(best)
            at = 0
            for a, b in sorted(excused):
                while at < len(starts) and starts[at] < a:
                    at += 1
                while at < len(starts) and starts[at] < b:
                    covered[starts[at]] = True
                    at += 1
                reach = max(reach, b)
            best = {s: w for s, w in best.items() if s not in covered}
        return sum(best.values()), len(best), words


def _curve_input(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones_like(total), np.log1p(total), 100 * total / np.maximum(words, 1) / 10], axis=1)


def fit_curve(total: np.ndarray, words: np.ndarray, label: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps; with labels of one kind only, the smoothed base rate."""
    n, ones = len(label), label.sum()
    rate = (ones + 0.5) / (n + 1)
    if not 0 < ones < n:
        return (math.log(rate / (1 - rate)) if n else -4.0, 3.0, 0.0)
    x, w = _curve_input(total, words), np.array([math.log(rate / (1 - rate)), 0.0, 0.0])
    ridge = np.diag([1e-3, 0.1, 0.1])
    for _ in range(30):
        p = logistic(x @ w)
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - label) + ridge @ w)
    return tuple(float(v) for v in w)


def _counted(sample: DataFrame, found, folds: int) -> DataFrame:
    """(entry, bad0, all0, bad1, ...) of every member of ``found(text)``: in how many toxic rows, and rows, of each fold it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, parts = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for low, texts in text_slices(batch.column(0)):
                per = [sorted(found(t)) for t in texts]
                own, sizes = slice(low, low + len(texts)), [len(p) for p in per]
                yield pa.RecordBatch.from_arrays([pa.array([e for p in per for e in p], pa.string()), pa.array(np.repeat(kinds[own], sizes), pa.int32()), pa.array(np.repeat(parts[own], sizes), pa.int32())], ["entry", "label", "fold"])

    rows = sample.select("text", "label", "fold").mapInArrow(run, "entry string, label int, fold int")
    sums = [x for k in range(folds) for x in (F.count_if((F.col("fold") == k) & (F.col("label") == 1)).alias(f"bad{k}"), F.count_if(F.col("fold") == k).alias(f"all{k}"))]
    return stored(rows.groupBy("entry").agg(*sums), "entries")


def _sum(what: str, folds: Iterable[int]) -> Column:
    return sum((F.col(f"{what}{k}") for k in folds), F.lit(0))


def _entries(seen: DataFrame, toxic: int, clean: int, folds: list[int], settings: ToxicitySettings) -> dict[str, float]:
    """Weights of the entries that the rows of ``folds`` teach, with the seeds."""
    entries = {f"={s}": settings.odds for s in settings.seeds}
    if not toxic:
        return entries
    need = max(min(settings.least, toxic), math.ceil(settings.support * toxic))
    hits = _sum("bad", folds)
    odds = F.log((hits + 0.5) / (toxic + 1)) - F.log((_sum("all", folds) - hits + 0.5) / (clean + 1))
    best = seen.where(hits >= need).select("entry", odds.alias("odds")).where(F.col("odds") >= settings.odds).orderBy(F.desc("odds"), "entry").limit(settings.most)
    return entries | {r["entry"]: min(float(r["odds"]), 8.0) for r in best.collect()}  # at most ``most`` entries


def _excused(pairs: DataFrame, folds: list[int], settings: ToxicitySettings) -> tuple[str, ...]:
    """The given exceptions and the pairs of words that stand in enough rows of ``folds``, all of them clean."""
    n = _sum("all", folds)
    found = pairs.where((_sum("bad", folds) == 0) & (n >= settings.excuse)).select("entry", n.alias("n")).orderBy(F.desc("n"), "entry").limit(settings.most)
    return (*settings.exceptions, *(r["entry"] for r in found.collect()))  # at most ``most`` pairs


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", settings: ToxicitySettings | None = None) -> Lexicon:
    """Learn entries, exceptions, weights and curve from at most ``settings.sample`` labelled rows; texts that repeat teach once.

    Null texts count as empty. Labels without a document, and without an id or a label of 0 or 1, teach nothing. Without
    rows, or with labels of one kind only, the lexicon holds the seeds and the curve the smoothed base rate.
    """
    settings = settings or ToxicitySettings()
    chosen = F.broadcast(stored(training_rows(docs, labels, label, id_col, settings.sample), "chosen"))  # at most ``sample`` pairs of numbers
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(chosen, "_id")
    fold = F.pmod(F.xxhash64("text", F.lit(77)), F.lit(settings.folds))
    sample = stored(rows.dropDuplicates(["text", "label"]).select("text", "label", fold.cast("int").alias("fold")), "sample")
    counts = {(r["label"], r["fold"]): r["n"] for r in sample.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows a fold
    known = lambda label, folds: sum(counts.get((label, k), 0) for k in folds)
    seen = _counted(sample, lambda t: candidates(t, settings.beginnings, settings.letters), settings.folds)
    every = list(range(settings.folds))
    whole = _entries(seen, known(1, every), known(0, every), every, settings)
    pairs = _counted(sample, lambda t: word_pairs(t, whole, settings.beginnings), settings.folds)
    rated = []
    for k in every:
        others = [j for j in every if j != k]
        without = Lexicon(_entries(seen, known(1, others), known(0, others), others, settings), exceptions=_excused(pairs, others, settings))
        rated += [(r["total"], r["words"], r["label"]) for r in evidence(sample.where(F.col("fold") == k).select("text", "label"), without).select("total", "words", "label").collect()]  # at most ``sample`` rows
    total, words, truth = (np.array(c, float) for c in zip(*sorted(rated), strict=True)) if rated else (np.zeros(0),) * 3
    exceptions = _excused(pairs, every, settings) if known(1, every) else settings.exceptions
    discard(seen, pairs, sample)
    return Lexicon(whole, fit_curve(total, words, truth), exceptions)


def evidence(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, and total (weights), matches and words of each text; a null text counts as empty.

    Whole texts of any length; repeated rows stay, an empty table gives an empty one, columns of those names give way.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        for batch in batches:
            got = [matcher.evidence(t) for _, texts in text_slices(batch.column(batch.schema.names.index(text_col))) for t in texts]
            total, matches, words = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total, pa.float64()), pa.array(matches, pa.int64()), pa.array(words, pa.int64())], [*batch.schema.names, "total", "matches", "words"])

    kept = docs.drop("total", "matches", "words")
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("total", T.DoubleType()), T.StructField("matches", T.LongType()), T.StructField("words", T.LongType())]))


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, its evidence and toxicity_score (0 to 1). Every row stays; a text without words gets the bias."""
    bias, slope, density = lexicon.curve
    per_word = F.col("total") * 10 / F.greatest(F.col("words"), F.lit(1))
    x = F.lit(bias) + F.lit(slope) * F.log1p("total") + F.lit(density) * per_word
    return evidence(docs, lexicon, text_col).withColumn("toxicity_score", 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), x)))))
