"""Hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

A token is a run of word characters or a run of punctuation. A document's features are hashes of its tokens, of its
token pairs, of one to three consecutive token shapes (a word's case and length class, punctuation as it stands) and of
a mark where a word repeats the word before it; a feature's value is its share of the tokens. A score is the sparse dot
product of these values with the weights, through the logistic function.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallgrid.llm.shared import stored
from recallgrid.llm.textscan import IS_WORD, LOWER, hash_runs, mix, run_bounds, slices

_codes = np.arange(256)
_UPPER = (_codes >= 65) & (_codes <= 90)
_LOWER = (_codes >= 97) & (_codes <= 122)
_DIGIT = (_codes >= 48) & (_codes <= 57)
_SPACE = _codes <= 32


@dataclass(frozen=True)
class QualitySettings:
    """sample, sample_bytes: most labelled rows that training uses, those with the least hash of their id, and the bytes of
    text from which no further row is taken; the task that trains holds no more. l1, l2, alpha, beta: of FTRL-proximal.
    """

    bits: int = 18
    sample: int = 6000
    sample_bytes: int = 64 << 20
    epochs: int = 3
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.05
    scale: float = 12.0
    threshold: float = 0.3


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature numbers by token and kind, token offsets by document, tokens by document)."""
    word = IS_WORD[data]
    w_start, w_end = run_bounds(word, offsets)
    p_start, p_end = run_bounds(~word & ~_SPACE[data], offsets)
    starts, ends = np.concatenate([w_start, p_start]), np.concatenate([w_end, p_end])
    order = np.argsort(starts, kind="stable")
    hashes = hash_runs(LOWER[data], starts, ends)
    zero = lambda flags: np.concatenate([[0], np.cumsum(flags[data])])
    upper, lower, digit = zero(_UPPER), zero(_LOWER), zero(_DIGIT)
    count = lambda c: c[ends] - c[starts]
    first_upper = _UPPER[data[starts]] if len(starts) else np.zeros(0, bool)
    length = ends - starts
    shape = np.where(count(digit) > 0, 1, np.where((count(upper) > 1) & (count(lower) == 0), 2, np.where(first_upper, 3, np.where(count(upper) > 0, 4, 5)))).astype(np.uint64)
    shape = shape * np.uint64(8) + np.minimum(np.log2(np.maximum(length, 1)), 7).astype(np.uint64)
    is_word = np.arange(len(starts)) < len(w_start)
    shape = np.where(is_word, mix(shape + np.uint64(77)), hashes ^ np.uint64(0x5555))
    starts, hashes, shape, is_word = starts[order], hashes[order], shape[order], is_word[order]
    first = np.searchsorted(starts, offsets)
    n = len(starts)
    at = np.arange(n)
    begin = np.repeat(first[:-1], np.diff(first))

    def back(values: np.ndarray, k: int) -> np.ndarray:
        return np.where(at - k >= begin, values[np.maximum(at - k, 0)], np.uint64(k)) if n else values

    again = is_word & (at - 1 >= begin) & (back(hashes, 1) == hashes)
    mask, k = np.uint64((1 << bits) - 1), np.uint64
    kinds = [
        mix(hashes + k(11)),
        mix(hashes * k(3) + back(hashes, 1) * k(7) + k(13)),
        mix(shape + k(17)),
        mix(shape * k(3) + back(shape, 1) * k(5) + k(19)),
        mix(shape * k(3) + back(shape, 1) * k(5) + back(shape, 2) * k(9) + k(23)),
        np.where(again, mix(np.full(n, 29, np.uint64)), mix(np.full(n, 31, np.uint64))),
    ]
    return (np.stack(kinds) & mask).astype(np.int64), first, np.diff(first)


def dot(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, settings: QualitySettings) -> np.ndarray:
    """Sum of weight times value over each document's features; the last weight is the bias."""
    kinds, first, counts = features(data, offsets, settings.bits)
    total = np.zeros(len(counts))
    full = np.flatnonzero(counts)
    if len(full):  # each document is summed by itself, so that equal texts get equal scores wherever they stand
        total[full] = np.add.reduceat(weights[kinds].sum(axis=0), first[full])
    return total * settings.scale / np.maximum(counts, 1) + weights[-1]


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """FTRL-proximal state: z and n by coordinate; weights follow from them in closed form."""

    def __init__(self, settings: QualitySettings):
        self.s = settings
        self.z = np.zeros((1 << settings.bits) + 1)
        self.n = np.zeros((1 << settings.bits) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.s.l1, 0.0, (np.sign(z) * self.s.l1 - z) / ((self.s.beta + np.sqrt(n)) / self.s.alpha + self.s.l2))

    def learn(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (logistic(w @ values) - label) * values
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.s.alpha * w
        self.n[at] = n + g * g


def _train(settings: QualitySettings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = []
        for batch in batches:
            labels = batch.column(1).to_numpy(zero_copy_only=False)
            for low, _, data, at in slices(batch.column(0)):
                kinds, first, counts = features(data, at, settings.bits)
                for i in range(len(counts)):
                    ids, times = np.unique(kinds[:, first[i] : first[i + 1]], return_counts=True)
                    ids = np.append(ids, 1 << settings.bits).astype(np.int32)
                    values = np.append(times * (settings.scale / max(counts[i], 1)), 1.0).astype(np.float32)
                    examples.append((ids, values, int(labels[low + i])))
        model = Ftrl(settings)
        for _ in range(settings.epochs):
            for ids, values, label in examples:
                model.learn(ids, values.astype(float), label)
        weights = model.weights(slice(None))
        used = np.flatnonzero(weights).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([used.tobytes()], pa.binary()), pa.array([weights[used].astype(np.float32).tobytes()], pa.binary())], ["at", "weights"])

    return run


def training_rows(docs: DataFrame, labels: DataFrame, label: str, id_col: str, limit: int) -> DataFrame:
    """(id, label) of at most ``limit`` rows of ``labels`` outside the held-out fifth, those with the least hash of their id.

    Held out: crc32 of the id as text is divisible by 5. Rows without an id or a label of 0 or 1 teach nothing.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & (F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0))
    return known.select(F.col(id_col).cast("long").alias("_id"), F.col(label).cast("int").alias("label")).orderBy(F.xxhash64("_id"), "_id", "label").limit(limit)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", settings: QualitySettings | None = None) -> np.ndarray:
    """Weights by feature number, the bias last. Training is one task over at most ``settings.sample`` documents, which
    ends with the document that reaches ``settings.sample_bytes`` of text.

    Null and empty texts teach the bias alone; rows that repeat an id teach as often as they stand. Labels without a
    document, and without an id or a label of 0 or 1, teach nothing; with no rows at all every weight is 0.
    """
    settings = settings or QualitySettings()
    chosen = F.broadcast(stored(training_rows(docs, labels, label, id_col, settings.sample), "chosen"))  # at most ``sample`` pairs of numbers
    sample = stored(docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text")).join(chosen, "_id"), "sample")
    sizes = sample.orderBy(F.xxhash64("_id"), "_id", "text").limit(settings.sample)
    before = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("_id"), "_id", "text").rowsBetween(Window.unboundedPreceding, -1))  # at most ``sample`` rows
    ordered = sizes.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < settings.sample_bytes)
    weights = np.zeros((1 << settings.bits) + 1)
    for row in ordered.select("text", "label").coalesce(1).mapInArrow(_train(settings), "at binary, weights binary").collect():
        weights[np.frombuffer(row["at"], np.int32)] = np.frombuffer(row["weights"], np.float32)
    return weights


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", settings: QualitySettings | None = None) -> DataFrame:
    """All columns of ``docs`` and quality_score (0 to 1); a null or empty text gets the bias alone. Every row stays.

    Equal texts get equal scores, whatever stands beside them. Texts of any length are scored whole. An empty table gives an
    empty one, a column named quality_score gives way.
    """
    settings = settings or QualitySettings()
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = shared.value.astype(float)
        for batch in batches:
            column = batch.column(batch.schema.names.index(text_col))
            scores = [dot(data, at, values, settings) for _, _, data, at in slices(column)]
            got = logistic(np.concatenate(scores)) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got)], [*batch.schema.names, "quality_score"])

    kept = docs.drop("quality_score")
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("quality_score", T.DoubleType())]))
