"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows, each text scanned once.

A benchmark item's windows are all runs of ``window`` consecutive words, or all its words if it has fewer. Texts are
normalised to lower-case words with a space before and after each; matches are mapped back to words, and to characters
of the original. The automaton is held by every task, so it serves benchmarks up to ``automaton_bytes`` of text (its size is
about thirty times that). A larger benchmark is met by an exact join with the same results: window hashes of the texts
pass a bit map of fixed size, and only what passes is joined with the windows themselves.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallgrid.llm.shared import stored
from recallgrid.llm.textscan import Words, slices

_word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_gap = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@dataclass(frozen=True)
class WindowSettings:
    """window: words. automaton_bytes: text of a benchmark that an automaton is built for. map_bits: of the larger one's bit map."""

    window: int = 10
    automaton_bytes: int = 2 << 20
    map_bits: int = 27


def normalise(text: str) -> str:
    """Lower-case words, a space before and after each; one space for none."""
    body = _gap.sub(" ", text.translate(_lower) if not text.isascii() else text.lower()).strip(" ")
    return f" {body} " if body else " "


def windows(text: str, width: int) -> list[str]:
    words = _word.findall(normalise(text))
    if not words:
        return []
    return [f" {' '.join(words[i : i + width])} " for i in range(max(1, len(words) - width + 1))]


class Scanner:
    """The automaton of some items: ``spans`` finds which words of a text are hit, and by which items."""

    def __init__(self, items: list[tuple[str | None, str]], width: int):
        found: dict[str, list[int]] = {}
        self.names = [name for name, _ in items]
        for n, (_, text) in enumerate(items):
            for w in windows(text, width):
                owners = found.setdefault(w, [])
                if not owners or owners[-1] != n:
                    owners.append(n)
        self.automaton = ahocorasick.Automaton()
        for w, owners in found.items():
            self.automaton.add_word(w, (len(w), w.count(" ") - 1, owners))
        if found:
            self.automaton.make_automaton()

    def spans(self, text: str) -> tuple[int, list[tuple[int, int]], set[str | None]]:
        """(words of the text, merged word intervals [from, to) hit, names of items). Intervals are in ascending order."""
        body = normalise(text)
        n_words = body.count(" ") - 1 if len(body) > 1 else 0
        if n_words <= 0 or not len(self.automaton):
            return max(n_words, 0), [], set()
        ends, names = [], set()
        for end, (_, words, owners) in self.automaton.iter(body):
            ends.append((end, words))
            names.update(owners)
        if not ends:
            return n_words, [], set()
        spaces = np.flatnonzero(np.frombuffer(body.encode("utf-32-le"), np.uint32) == 32)
        merged: list[tuple[int, int]] = []
        for last, words in sorted((int(np.searchsorted(spaces, e)), w) for e, w in ends):
            start = last - words
            while merged and merged[-1][1] >= start:
                start = min(start, merged.pop()[0])
            merged.append((start, last))
        return n_words, merged, {self.names[o] for o in names}


def original_spans(text: str, intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character positions [from, to) in the original text of word intervals."""
    if not intervals:
        return []
    at = [m.span() for m in _word.finditer(text.translate(_lower))]
    return [(at[a][0], at[b - 1][1]) for a, b in intervals]


_SPAN = T.StructType([T.StructField(n, T.LongType()) for n in ("word_from", "word_to", "char_from", "char_to")])
_RESULT = [T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(_SPAN)), T.StructField("items", T.ArrayType(T.StringType()))]


def _table(batch: pa.RecordBatch, width: int, schema: T.StructType, counts: list, hits: list, names: list) -> pa.RecordBatch:
    """The first ``width`` columns of ``batch`` with the results."""
    span = pa.struct([(n, pa.int64()) for n in _SPAN.names])
    rows = [[dict(zip(_SPAN.names, h, strict=True)) for h in hs] for hs in hits]
    return pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(counts, pa.int64()), pa.array(rows, pa.list_(span)), pa.array(names, pa.list_(pa.string()))], schema.names)


def scan(docs: DataFrame, items: list[tuple[str | None, str]], text_col: str = "text", settings: WindowSettings | None = None) -> DataFrame:
    """All columns of ``docs``, and n_words, hits (array of word_from, word_to, char_from, char_to) and items (sorted names).

    A null text has no words; texts of any length are scanned whole, one at a time. Items are (name, text) pairs; those
    without words have no window. Repeated items both count, under their names. An item whose name is null is searched for as
    the others are, but has no name to list. Every row stays, repeated rows too; an empty table gives an empty one, columns
    named n_words, hits or items give way.
    """
    settings = settings or WindowSettings()
    shared = docs.sparkSession.sparkContext.broadcast(items)
    kept = docs.drop(*(f.name for f in _RESULT))
    schema = T.StructType([*kept.schema.fields, *_RESULT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value, settings.window)
        for batch in batches:
            counts, hits, names = [], [], []
            for text in batch.column(batch.schema.names.index(text_col)):
                text = text.as_py() or ""
                n_words, merged, owners = scanner.spans(text)
                counts.append(n_words)
                hits.append([(a, b, c, d) for (a, b), (c, d) in zip(merged, original_spans(text, merged), strict=True)])
                names.append(sorted(owners - {None}))
            yield _table(batch, len(batch.columns), schema, counts, hits, names)

    return kept.mapInArrow(run, schema)


def benchmark_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> list[tuple[str | None, str]]:
    """The benchmark as (name, text) pairs on the driver; for benchmarks of a checked size, as in ``decontaminate``.

    An item with a null id stays, under a null name and after the others; one with a null text has no windows and is left out.
    """
    rows = benchmark.select(F.col(id_col).cast("string").alias("name"), F.col(text_col).alias("text")).where("text is not null")
    return sorted(((r["name"], r["text"]) for r in rows.collect()), key=lambda x: (x[0] is None, x[0] or "", x[1]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", settings: WindowSettings | None = None) -> DataFrame:
    """``scan`` of ``docs`` for all items of ``benchmark``, by the automaton or, beyond its size, by the join: equal results."""
    settings = settings or WindowSettings()
    size = benchmark.select(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    if size <= settings.automaton_bytes:
        return scan(docs, benchmark_items(benchmark, id_col, text_col), settings=settings)
    return scan_joined(docs, benchmark.select(F.col(id_col).cast("string").alias("name"), F.col(text_col).cast("string").alias("text")), settings=settings)


def _window_rows(width: int):
    """(words, hash, window, name) for each distinct window of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, (name, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                found = windows(text or "", width)
                if found:
                    _, _, data, at = next(slices(batch.column(1).slice(row, 1)))
                    hashes = Words(data, at).shingles(width)[0]
                    rows = {(w.count(" ") - 1, h, w, name) for w, h in zip(found, hashes.view(np.int64).tolist(), strict=True)}
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.string(), pa.string()), strict=True)], ["words", "hash", "window", "name"])

    return run


def _bit_map(found: DataFrame, bits: int) -> np.ndarray:
    """One bit for each hash modulo 2**bits, as bytes. Parts of 8 KB are combined by key; the driver gets at most 2**(bits-3) bytes."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, whole = None, np.zeros(1 << 16, bool)
        for batch in batches:
            keys, places = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for key in np.unique(keys):  # rows are sorted by key
                if last is not None and key != last:
                    yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([np.packbits(whole, bitorder="little").tobytes()], pa.binary())], ["part", "bits"])
                    whole[:] = False
                last = int(key)
                whole[places[keys == key]] = True
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([np.packbits(whole, bitorder="little").tobytes()], pa.binary())], ["part", "bits"])

    place = F.pmod(F.col("hash"), F.lit(1 << bits))
    placed = found.select(F.shiftright(place, 16).alias("part"), F.pmod(place, F.lit(1 << 16)).alias("at")).distinct()
    out = np.zeros(max(1 << (bits - 3), 1 << 13), np.uint8)
    for row in placed.repartition("part").sortWithinPartitions("part").mapInArrow(parts, "part long, bits binary").toLocalIterator():
        out[row["part"] << 13 : (row["part"] + 1) << 13] = np.frombuffer(row["bits"], np.uint8)
    return out


def scan_joined(docs: DataFrame, items: DataFrame, text_col: str = "text", settings: WindowSettings | None = None) -> DataFrame:
    """``scan`` for a benchmark of any size, given as a table (name, text); the same rows.

    Places of a text whose window hash is set in the bit map are joined with the windows, as strings, by equality; texts are
    named by a digest of their words, so that copies are joined once. The bit map's size is fixed, whatever the benchmark's.
    """
    settings = settings or WindowSettings()
    found = stored(items.where("text is not null").select("name", "text").mapInArrow(_window_rows(settings.window), "words int, hash long, window string, name string").distinct(), "windows")
    widths = sorted(r["words"] for r in found.select("words").distinct().collect())  # at most ``window`` numbers
    shared = docs.sparkSession.sparkContext.broadcast(_bit_map(found.select("hash"), settings.map_bits))
    mask = np.int64((1 << settings.map_bits) - 1)
    own = ("_key", "_spans", "_names")
    kept = docs.drop(*(f.name for f in _RESULT), *own)

    def key_of(body: memoryview) -> str:
        return hashlib.sha256(body).hexdigest()

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for _, _, data, at in slices(batch.column(0)):
                words = Words(data, at)
                body, bounds = words.normalised()
                view, ends, rows = memoryview(body), np.cumsum(words.ends - words.starts + 1), []
                for width in widths:
                    counts = np.maximum(np.diff(words.first) - width + 1, 0)
                    if not counts.sum():
                        continue
                    start = np.repeat(words.first[:-1], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                    hashes, offsets = words.shingles(width)
                    full = np.repeat(np.diff(words.first) >= width, np.diff(offsets))
                    hashes = hashes[full].view(np.int64)
                    places = hashes & mask
                    some = np.flatnonzero(bits[places >> 3] >> (places & 7).astype(np.uint8) & 1)
                    of = np.searchsorted(words.first, start[some], side="right") - 1
                    for x, doc in zip(some.tolist(), of.tolist(), strict=True):
                        a = int(start[x])
                        low = int(ends[a - 1]) if a else 0
                        rows.append((key_of(view[bounds[doc] : bounds[doc + 1]]), a - int(words.first[doc]), width, f" {body[low : int(ends[a + width - 1])].decode('utf-8', 'surrogatepass')}"))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int32(), pa.string()), strict=True)], ["key", "at", "words", "window"])

    texts = kept.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    near = stored(texts.mapInArrow(candidates, "key string, at long, words int, window string").distinct(), "near")
    spots = near.join(found.select("window").distinct(), "window", "left_semi").groupBy("key").agg(F.collect_set(F.struct("at", (F.col("at") + F.col("words")).alias("to"))).alias("_spans"))
    names = near.select("key", "window").distinct().join(found.select("window", "name").where("name is not null"), "window").groupBy("key").agg(F.collect_set("name").alias("_names"))
    hits = stored(spots.join(names, "key", "left").withColumnRenamed("key", "_key"), "hits")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for _, _, data, at in slices(batch.column(batch.schema.names.index(text_col))):
                body, bounds = Words(data, at).normalised()
                keys += [key_of(memoryview(body)[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.string())], [*batch.schema.names, "_key"])

    with_key = kept.mapInArrow(keyed, T.StructType([*kept.schema.fields, T.StructField("_key", T.StringType())]))
    joined = with_key.join(hits, "_key", "left").select(*kept.columns, "_spans", "_names")
    schema = T.StructType([*kept.schema.fields, *_RESULT])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width, counts, hits, names = len(schema) - 3, [], [], []
            for text, spans, who in zip(batch.column(batch.schema.names.index(text_col)), batch.column(width).to_pylist(), batch.column(width + 1).to_pylist(), strict=True):
                text = text.as_py() or ""
                merged: list[tuple[int, int]] = []
                for a, b in sorted((s["at"], s["to"]) for s in spans or []):
                    if merged and merged[-1][1] >= a:
                        merged[-1] = (merged[-1][0], max(merged[-1][1], b))
                    else:
                        merged.append((a, b))
                counts.append(max(0, normalise(text).count(" ") - 1))
                hits.append([(a, b, c, d) for (a, b), (c, d) in zip(merged, original_spans(text, merged), strict=True)])
                names.append(sorted(who or []))
            yield _table(batch, width, schema, counts, hits, names)

    return joined.mapInArrow(placed, schema)
