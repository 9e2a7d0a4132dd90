"""Token-id files: ids of many documents in one array, with Elias-Fano encoded document boundaries.

A block is one self-contained binary value: a header, the ascending document numbers and the document ends as
Elias-Fano sequences, and the ids as two- or four-byte little-endian integers. An Elias-Fano sequence keeps the low
bits of each value packed, and the high parts as a bit vector with one set bit for each value; selecting the i-th set
bit gives the i-th value, helped by a sample of every 256th position. No 64-bit offset table is stored.

Blocks are rows of a Parquet table (part, block, document and token counts, payload), so that writing is atomic,
repeatable after a lost executor and works in any store; parts are in ascending order of document number.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.llm.encode import encoder, text_slices
from recallgrid.llm.shared import stored

MAGIC = b"RGT1"
SAMPLE = 256


class EliasFano:
    """A non-decreasing sequence of non-negative integers below 2**62."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        low_bits = max(0, int(values[-1] // n).bit_length() - 1)
        places = (values >> low_bits) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1, np.uint8)
        bits[places] = 1
        if low_bits:
            low = ((values[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8).reshape(-1)
            low = np.packbits(low, bitorder="little")
        else:
            low = np.zeros(0, np.uint8)
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), places[::SAMPLE].astype(np.uint32))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        at = i[:, None] * self.low_bits + np.arange(self.low_bits)
        return (((self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)

    def select(self, i: int) -> int:
        """The i-th value: from the nearest sample before it, on to the set bit, then its low bits."""
        start = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, start >> 3
        word = int(self.high[byte]) >> (start & 7) << (start & 7)
        while (found := word.bit_count()) <= left:
            left -= found
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        return ((place - i) << self.low_bits) | int(self._low(np.array([i]))[0])

    def all(self) -> np.ndarray:
        """All values."""
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        i = np.arange(self.n)
        return ((places - i) << self.low_bits) | self._low(i)

    def dump(self) -> bytes:
        parts = [self.low.tobytes(), self.high.tobytes(), self.samples.astype("<u4").tobytes()]
        return struct.pack("<IBIII", self.n, self.low_bits, *map(len, parts)) + b"".join(parts)

    @classmethod
    def load(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, low_bits, a, b, c = struct.unpack_from("<IBIII", data, at)
        at += struct.calcsize("<IBIII")
        low, high, samples = (np.frombuffer(data, np.uint8, x, y) for x, y in ((a, at), (b, at + a), (c, at + a + b)))
        return cls(n, low_bits, low, high, np.frombuffer(samples.tobytes(), "<u4")), at + a + b + c


def dump_block(docs: np.ndarray, counts: np.ndarray, ids: bytes, width: int) -> bytes:
    """docs: ascending document numbers; counts: ids of each; ids: all ids, ``width`` bytes each."""
    base = int(docs[0]) if len(docs) else 0
    return MAGIC + struct.pack("<Bq", width, base) + EliasFano.build(docs - base).dump() + EliasFano.build(np.cumsum(counts)).dump() + ids


class Block:
    """A block as stored: document numbers, ends, and ids without a copy."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        if bytes(view[:4]) != MAGIC:
            raise ValueError("not a token-id block")
        width, self.base = struct.unpack_from("<Bq", view, 4)
        self.docs, at = EliasFano.load(view, 4 + struct.calcsize("<Bq"))
        self.ends, at = EliasFano.load(view, at)
        self.ids = np.frombuffer(view, f"<u{width}", -1, at)

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document, found through select alone."""
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


def _write(path: str, end_id: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, block, before = encoder(path), TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], coder.dtype).tobytes()
        docs: list[int] = []
        counts: list[int] = []
        held: list[bytes] = []
        total = 0

        def table() -> pa.RecordBatch:
            nonlocal block, before
            payload = dump_block(np.array(docs, np.int64), np.array(counts, np.int64), b"".join(held), coder.dtype.itemsize)
            row = [part, block, len(docs), before, sum(counts), payload]
            block, before = block + 1, before + sum(counts)
            for x in (docs, counts, held):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], ["part", "block", "n_docs", "before", "n_tokens", "payload"])

        for batch in batches:
            numbers = batch.column(0).to_pylist()
            for row, ids in ((low + i, ids) for low, texts in text_slices(batch.column(1)) for i, ids in enumerate(coder.many(texts))):
                number, ids = numbers[row], ids.tobytes() + end
                docs.append(number)
                counts.append(len(ids) // coder.dtype.itemsize)
                held.append(ids)
                total += counts[-1]
                if total >= block_ids or len(docs) >= 4096:
                    yield table()
                    total = 0
        if docs:
            yield table()

    return run


BLOCK_SCHEMA = "part long, block long, n_docs long, before long, n_tokens long, payload binary"


def write_token_file(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block_ids: int = 1 << 20) -> DataFrame:
    """Encode every text (null: empty), append ``end_id``, and store blocks in ascending document order in the shared folder.

    The only shuffle sorts the texts by number. Blocks hold about ``block_ids`` ids, or one longer document. Rows with a
    null number are not part of the file, as they have no place in its order. Rows that repeat a number follow each other
    in the order of their texts.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("id is not null")
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    return stored(ordered.mapInArrow(_write(path, end_id, block_ids), BLOCK_SCHEMA), "tokens")


def read_token_file(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the stored blocks; start counts the ids of all documents before.

    Only part totals are broadcast: a row of two numbers for each file part, and a file has at most as many parts as the
    shuffle that sorted it has partitions.
    """
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row for each file part
    offsets = parts.select("part", F.coalesce(before, F.lit(0)).alias("part_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block = Block(payload.as_py())
                ends = block.ends.all()
                starts = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(block.ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(block.docs.all() + block.base), pa.array(starts + first), pa.array(ends - starts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = blocks.join(F.broadcast(offsets), "part").select((F.col("part_start") + F.col("before")).alias("first"), "payload")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
