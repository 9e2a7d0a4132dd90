"""TIFF as a media column: encode bytes as grey 8-bit pages, walk image directories, decode pages.

Read: both byte orders; strips and tiles; no compression, PackBits, LZW, deflate (8 and 32946); horizontal predictor; one
or more 8-bit samples, chunky or planar. Written: one page for every ``page_rows`` rows, in strips or tiles, with one
compression and predictor for payloads of any size. A decoder stops at the bytes that its strip can hold, and a page
that is larger than its file can hold is an error, so a broken file never takes more memory than its pixels would.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallgrid.llm.encode import text_slices

# Tags and codes of the TIFF 6.0 format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 322, 323, 324, 325
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
# No code of these compressions stands for more than 4,096 bytes a byte; a page is a binary value of a row, below 2 GB.
MOST_RATIO, MOST_PIXELS = 4096, (1 << 31) - 1
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}


def unpack_bits(data: bytes, most: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < most:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run > 2:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        start = i
        while i < n and i - start < 128 and not (i + 2 < n and data[i] == data[i + 1] == data[i + 2]):
            i += 1
        out.append(i - start - 1)
        out += data[start:i]
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Most significant bit first; code widths grow one code early, as TIFF has it."""
    out, held, bits = bytearray(), 0, 0
    width, table, nxt = 9, {bytes((i,)): i for i in range(256)}, 258

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(256)
    seen = b""
    for k in range(len(data)):
        longer = seen + data[k : k + 1]
        if longer in table:
            seen = longer
            continue
        put(table[seen])
        table[longer] = nxt
        nxt += 1
        if nxt in (512, 1024, 2048):
            width += 1
        elif nxt == 4095:
            put(256)
            width, table, nxt = 9, {bytes((i,)): i for i in range(256)}, 258
        seen = longer[-1:]
    if seen:
        put(table[seen])
        nxt += 1
        if nxt in (512, 1024, 2048):
            width += 1
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def lzw_decode(data: bytes, most: int) -> bytes:
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, held, bits, last, out, size = list(base), 9, 0, 0, b"", [], 0
    for byte in data:
        if size >= most:
            break
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = list(base), 9, b""
            continue
        if not last:
            last = table[code]
            out.append(last)
            size += len(last)
            continue
        if code > len(table):
            raise ValueError("LZW code out of order")
        entry = table[code] if code < len(table) else last + last[:1]
        out.append(entry)
        size += len(entry)
        if len(table) < 4096:
            table.append(last + entry[:1])
        last = entry
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)


def inflate(data: bytes, most: int) -> bytes:
    return zlib.decompressobj().decompress(data, most)


# Decoders take the stored bytes and the most bytes that the strip or tile holds.
_decode = {NONE: lambda data, most: bytes(data[:most]), LZW: lzw_decode, DEFLATE: inflate, OLD_DEFLATE: inflate, PACKBITS: unpack_bits}
_encode = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, 1), PACKBITS: pack_bits}


@dataclass(frozen=True)
class TiffSettings:
    """page_rows: rows of a page. tile: side of square tiles in place of strips. One compression holds for all sizes."""

    width: int = 576
    page_rows: int = 1024
    strip_rows: int = 64
    compression: int = DEFLATE
    predictor: int = 2
    tile: int | None = None


def encode(payload: bytes, settings: TiffSettings | None = None) -> bytes:
    """``payload``, of a positive multiple of ``width`` bytes, as a little-endian TIFF of grey pages."""
    s = settings or TiffSettings()
    if not payload or len(payload) % s.width:
        raise ValueError("the payload must be a positive multiple of the width")
    rows = np.frombuffer(payload, np.uint8).reshape(-1, s.width)
    kind = s.compression
    out = bytearray(struct.pack("<2sHI", b"II", 42, 8))
    link = 4
    for top in range(0, len(rows), s.page_rows):
        page = rows[top : top + s.page_rows]
        if s.tile:
            t = s.tile
            full = np.zeros((-(-page.shape[0] // t) * t, -(-s.width // t) * t), np.uint8)
            full[: page.shape[0], : s.width] = page
            parts = [full[y : y + t, x : x + t] for y in range(0, full.shape[0], t) for x in range(0, full.shape[1], t)]
        else:
            parts = [page[y : y + s.strip_rows] for y in range(0, len(page), s.strip_rows)]
        if s.predictor == 2:
            parts = [np.diff(p, axis=1, prepend=np.zeros((len(p), 1), np.uint8)).astype(np.uint8) for p in parts]
        data = [_encode[kind](p.tobytes()) for p in parts]
        at = len(out)
        offsets = [at + sum(map(len, data[:i])) for i in range(len(data))] if len(data) < 64 else (np.cumsum([0, *map(len, data)])[:-1] + at).tolist()
        out += b"".join(data)
        out += b"\0" * (len(out) % 2)
        tags = [(WIDTH, 4, [s.width]), (HEIGHT, 4, [len(page)]), (BITS, 3, [8]), (COMPRESSION, 3, [kind]), (PHOTOMETRIC, 3, [1])]
        if s.tile:
            tags += [(SAMPLES, 3, [1]), (PREDICTOR, 3, [s.predictor]), (TILE_WIDTH, 4, [s.tile]), (TILE_HEIGHT, 4, [s.tile]), (TILE_OFFSETS, 4, offsets), (TILE_BYTES, 4, [*map(len, data)])]
        else:
            tags += [(STRIP_OFFSETS, 4, offsets), (SAMPLES, 3, [1]), (ROWS_PER_STRIP, 4, [s.strip_rows]), (STRIP_BYTES, 4, [*map(len, data)]), (PREDICTOR, 3, [s.predictor])]
        struct.pack_into("<I", out, link, len(out))
        extra = len(out) + 2 + 12 * len(tags) + 4
        entries, tail = bytearray(struct.pack("<H", len(tags))), bytearray()
        for tag, form, values in tags:
            body = struct.pack(f"<{len(values)}{'H' if form == 3 else 'I'}", *values)
            if len(body) > 4:
                entries += struct.pack("<HHII", tag, form, len(values), extra + len(tail))
                tail += body
            else:
                entries += struct.pack("<HHI", tag, form, len(values)) + body.ljust(4, b"\0")
        link = len(out) + len(entries)
        out += entries + struct.pack("<I", 0) + tail
    return bytes(out)


@dataclass(frozen=True)
class Page:
    """pixels: height x width x samples."""

    number: int
    width: int
    height: int
    samples: int
    compression: int
    predictor: int
    pixels: np.ndarray


def pages(data: bytes) -> Iterator[Page]:
    """The pages in the order of the directory chain. Raises ValueError where the file breaks the format."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or len(data) < 8 or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen, number = struct.unpack_from(f"{order}I", data, 4)[0], set(), 0
    while at:
        if at in seen:
            raise ValueError("the directory chain has a loop")
        seen.add(at)
        try:
            n = struct.unpack_from(f"{order}H", data, at)[0]
            tags = {}
            for k in range(n):
                tag, form, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * k)
                place = at + 10 + 12 * k
                if SIZES.get(form, 1) * count > 4:
                    place = struct.unpack_from(f"{order}I", data, place)[0]
                if form in (1, 3, 4):
                    tags[tag] = struct.unpack_from(order + str(count) + {1: "B", 3: "H", 4: "I"}[form], data, place)
            yield _page(data, tags, number)
            at = struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)[0]
        except (struct.error, KeyError, zlib.error, IndexError, OverflowError, MemoryError) as e:
            raise ValueError(f"broken directory or image data: {e}") from e
        number += 1


def _page(data: bytes, tags: dict[int, tuple[int, ...]], number: int) -> Page:
    width, height, samples = tags[WIDTH][0], tags[HEIGHT][0], tags.get(SAMPLES, (1,))[0]
    if set(tags.get(BITS, (1,))) != {8}:
        raise ValueError("only 8-bit samples are read")
    kind, predictor = tags.get(COMPRESSION, (1,))[0], tags.get(PREDICTOR, (1,))[0]
    if kind not in _decode or predictor not in (1, 2):
        raise ValueError(f"compression {kind} or predictor {predictor} is not read")
    tiled = TILE_OFFSETS in tags
    across, down = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (width, min(tags.get(ROWS_PER_STRIP, (height,))[0], height))
    offsets, lengths = (tags[TILE_OFFSETS], tags[TILE_BYTES]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_BYTES])
    planes, depth = (samples, 1) if tags.get(PLANAR, (1,))[0] == 2 else (1, samples)
    if min(width, height, samples, across, down) < 1 or len(offsets) != len(lengths):
        raise ValueError("a page, strip or tile without extent")
    size = width * height * samples
    if size > min(MOST_RATIO * min(len(data), sum(lengths)), MOST_PIXELS):
        raise ValueError(f"{size} samples are more than the file can hold")
    columns, rows = -(-width // across), -(-height // down)
    if planes * rows * columns > len(offsets) or across * down > MOST_RATIO * len(data):
        raise ValueError("strips or tiles are missing")
    pixels = np.zeros((height, width, samples), np.uint8)
    for k in range(planes * rows * columns):
        plane, rest = divmod(k, rows * columns)
        y, x = rest // columns * down, rest % columns * across
        high = down if tiled else min(down, height - y)
        raw = np.frombuffer(_decode[kind](data[offsets[k] : offsets[k] + lengths[k]], high * across * depth), np.uint8)
        part = raw[: high * across * depth].reshape(high, across, depth)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=np.uint8)
        h, w = min(high, height - y), min(across, width - x)
        pixels[y : y + h, x : x + w, plane : plane + depth] = part[:h, :w]
    return Page(number, width, height, samples, kind, predictor, pixels)


def padded(text: bytes, unit: int, fill: int = 255) -> bytes:
    """``text`` and bytes ``fill`` up to a positive multiple of ``unit``."""
    return text + bytes([fill]) * (max(unit, -(-len(text) // unit) * unit) - len(text))


def text_to_media(docs: DataFrame, text_col: str = "text", settings: TiffSettings | None = None, media_col: str = "media") -> DataFrame:
    """``docs`` with a media column in place of its text: the TIFF of the text's UTF-8 bytes, padded to whole rows, and n_bytes.

    A null or empty text gives one row of padding, a very long one as many pages as it needs. Equal texts give equal files.
    Repeated rows stay, an empty table gives an empty one, columns named like the new ones give way.
    """
    s = settings or TiffSettings()
    rest = [c for c in docs.columns if c not in (text_col, media_col, "n_bytes")]
    kept = docs.select(*rest, text_col)
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("n_bytes", T.LongType()), T.StructField(media_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, texts in text_slices(batch.column(len(rest)), 4 << 20):
                raw = [t.encode("utf-8", "surrogatepass") for t in texts]
                media = [encode(padded(b, s.width), s) for b in raw]
                own = [c.slice(low, len(texts)) for c in batch.columns[: len(rest)]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], schema.names)

    return kept.mapInArrow(run, schema)


def media_pages(files: DataFrame, media_col: str = "media", batch_bytes: int = 4 << 20) -> DataFrame:
    """One row for each page of each file: the other columns of ``files``, page, width, height, samples, compression,
    predictor, pixels and error, in the order of the files and of their pages, without a shuffle.

    A null, empty or broken file gives a row with an error and no pixels, after the pages before it. Repeated rows stay, an
    empty table gives an empty one, columns named like the new ones give way. One file is decoded page by page; a batch
    of rows holds about ``batch_bytes`` of pixels or one page.
    """
    own = ("page", "width", "height", "samples", "compression", "predictor", "pixels", "error")
    rest = [c for c in files.columns if c != media_col and c not in own]
    kept = files.select(*rest, media_col)
    kinds = [T.IntegerType()] * 6 + [T.BinaryType(), T.StringType()]
    schema = T.StructType([*kept.schema.fields[:-1], *(T.StructField(n, k) for n, k in zip(own, kinds, strict=True))])

    def decoded(data: bytes | None) -> Iterator[tuple]:
        try:
            for p in pages(data or b""):
                yield p.number, p.width, p.height, p.samples, p.compression, p.predictor, p.pixels.tobytes(), None
        except ValueError as e:
            yield (None,) * 7 + (str(e),)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32()] * 6 + [pa.binary(), pa.string()]
        for batch in batches:
            rows: list[tuple] = []
            of: list[int] = []

            def table(batch=batch, rows=rows, of=of) -> pa.RecordBatch:
                at = pa.array(of, pa.int64())
                out = [*(c.take(at) for c in batch.columns[: len(rest)]), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))]
                rows.clear(), of.clear()
                return pa.RecordBatch.from_arrays(out, schema.names)

            held = 0
            for r in range(batch.num_rows):
                for row in decoded(batch.column(len(rest))[r].as_py()):
                    rows.append(row)
                    of.append(r)
                    held += len(row[6] or b"")
                    if held >= batch_bytes:
                        yield table()
                        held = 0
            if rows:
                yield table()

    return kept.mapInArrow(run, schema)


def feature(histogram: np.ndarray) -> str:
    """Mean, standard deviation and entropy of 8-bit samples, from their histogram."""
    share = histogram / histogram.sum()
    level = np.arange(256)
    mean = float(share @ level)
    spread = float(np.sqrt(max(0.0, share @ (level - mean) ** 2)))
    entropy = float(-(share[share > 0] * np.log2(share[share > 0])).sum())
    return f"mean={mean:.4f};std={spread:.4f};entropy={entropy:.4f}"


def media_digest(files: DataFrame, media_col: str = "media", id_col: str = "doc_id") -> DataFrame:
    """A row for each file of ``text_to_media``: digests of the payload read back from its pages, of the file, and a feature.

    The pages come from ``media_pages`` in the order of their file, so a file is folded page by page as its rows pass and is
    never held whole. A null, empty or broken file keeps its row with the error, and null digests of the payload. Repeated
    rows stay, equal files give equal values, an empty table an empty one; columns beside the three read are dropped.
    """
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
    stored_form = files.select(
        F.monotonically_increasing_id().alias("_file"), F.col(id_col).cast("long").alias("_id"), F.col("n_bytes").cast("long").alias("_n"),
        F.octet_length(media_col).cast("long").alias("_size"), F.sha2(F.col(media_col), 256).alias("_sha"), F.col(media_col).alias("media"),
    )
    rows = media_pages(stored_form).select("_file", "_id", "_n", "_size", "_sha", "pixels", "error")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        file = None

        def opened(key: tuple) -> None:
            nonlocal file, whole, size, tail, counts, error
            file, whole, size, tail, counts, error = key, hashlib.sha256(), 0, b"", np.zeros(256, np.int64), None

        def closed() -> tuple:
            _, number, n_bytes, media_size, sha = file
            got = (size, whole.hexdigest(), zlib.crc32(tail)) if error is None else (None, None, None)
            return (number, n_bytes, *got, media_size, sha, feature(counts) if error is None else None, error)

        whole, size, tail, counts, error = hashlib.sha256(), 0, b"", np.zeros(256, np.int64), None
        for batch in batches:
            out = []
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True))
            errors = batch.column(6).to_pylist()
            for key, pixels, problem in zip(keys, batch.column(5), errors, strict=True):
                if file is None or key[0] != file[0]:
                    if file is not None:
                        out.append(closed())
                    opened(key)
                if problem is not None:
                    error = problem
                    continue
                part = pixels.as_buffer()
                whole.update(part)
                size += part.size
                values = np.frombuffer(part, np.uint8)
                tail = (tail + values[-32:].tobytes())[-32:]
                counts += np.bincount(values, minlength=256)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
        if file is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(closed(), types, strict=True)], names)

    return rows.mapInArrow(run, f"{id_col} long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")
