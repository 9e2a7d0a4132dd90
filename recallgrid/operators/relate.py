"""Joins between memories: all-pairs similarity in blocks, time windows, entities in contents, triggers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


TILE = 2048  # rows of a tile of cosines, 32 MB
PAIRS = 1 << 15  # of a batch of time neighbours, 0.8 MB
MOST_BLOCKS = 16  # of a key: a row travels at most that often, however many rows there are


def block_count(rows: DataFrame, key: str, block: int, most: int, name: str) -> DataFrame:
    """(key, name): blocks of about ``block`` rows for each key, at most ``most`` of them, which then grow with the rows."""
    return rows.groupBy(key).agg(F.least(F.lit(most), F.ceil(F.count(F.lit(1)) / block)).cast("int").alias(name))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` by ``keys`` over all shuffle partitions: few bytes may be much work, so partitions are not joined by their size."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def unit_rows(vectors) -> np.ndarray:
    """A matrix of unit rows of an Arrow list column; rows without length stay 0."""
    v = vectors.combine_chunks() if hasattr(vectors, "combine_chunks") else vectors
    v = np.asarray(v.flatten(), float).reshape(len(v), -1)
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def tiles(n: int, m: int, size: int) -> Iterator[tuple[slice, slice]]:
    for i in range(0, n, size):
        for j in range(0, m, size):
            yield slice(i, i + size), slice(j, j + size)


def _met(rows: DataFrame, key: str, vector: str, block: int, most: int, run, schema: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """``run(ids, extras, units, other's, same)`` of every two blocks of a key, and of each with itself; yields Arrow batches.

    Blocks of a key are dealt by a hash of the id; of two blocks a row travels with its vector, as the key's ``most`` blocks say.
    """
    rows = rows.where(F.col(vector).isNotNull())
    dealt = rows.select("id", key, vector, *extra).join(block_count(rows, key, block, most, "_blocks"), key).withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    dealt = dealt.select("id", key, vector, *extra, "_own", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other"))
    dealt = dealt.select("id", vector, key, *extra, "_own", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"))

    def meet(keys, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j = keys[1].as_py(), keys[2].as_py()
        sides: list[list] = [[], []]
        for batch in batches:
            own = batch.column(batch.schema.get_field_index("_own")).to_numpy(zero_copy_only=False)
            for side, number in enumerate((i, j)):
                if side == 0 or i != j:
                    at = own == number
                    part = batch.filter(pa.array(at))
                    column = lambda name: part.column(part.schema.get_field_index(name))  # noqa: E731, B023
                    if len(part):
                        sides[side].append((column("id").to_numpy(zero_copy_only=False), [column(x).to_numpy(zero_copy_only=False) for x in extra], unit_rows(column(vector))))

        def whole(parts: list):
            ids = np.concatenate([x[0] for x in parts]) if parts else np.zeros(0, np.int64)
            _, first = np.unique(ids, return_index=True)  # by id, each once
            return ids[first], [np.concatenate([x[1][n] for x in parts])[first] for n in range(len(extra))] if parts else [], np.concatenate([x[2] for x in parts])[first] if parts else np.zeros((0, 1))

        left = whole(sides[0])
        sides[0] = []
        right = left if i == j else whole(sides[1])
        sides[1] = []
        if len(left[0]) and len(right[0]):
            yield from run(left, right, i == j)

    return spread(dealt, key, "_i", "_j").groupBy(key, "_i", "_j").applyInArrow(_as_arrow(meet), schema)


def _as_arrow(f):
    """The function with the annotations by which Spark knows that it takes and gives batches one by one."""
    f.__annotations__ = {"keys": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return f


def similar_pairs(rows: DataFrame, threshold: float, key: str = "directory", vector: str = "embedding", block: int = 1024, most: int = MOST_BLOCKS) -> DataFrame:
    """(a, b, cosine), a < b within a key, cosine of the threshold or more; rows without a vector are in no pair.

    Rows of a key are dealt into blocks of about ``block``, at most ``most`` of them, by a hash of their id; two blocks meet in one
    task tile by tile, and each tile's pairs leave it at once. A row travels once for each block of its key, so what is shuffled
    grows with the rows; the cosines that are computed, and the pairs, grow with their square.
    """

    def run(left, right, same):
        (a, _, x), (b, _, y) = left, right
        for r, c in tiles(len(a), len(b), TILE):
            if same and c.stop <= r.start:
                continue
            cosine = x[r] @ y[c].T
            at, to = np.nonzero(cosine >= threshold)
            if same:
                keep = a[r][at] < b[c][to]
                at, to = at[keep], to[keep]
            if len(at):
                p, q = a[r][at], b[c][to]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q)), pa.array(np.round(cosine[at, to], 6))], ["a", "b", "cosine"])

    return _met(rows, key, vector, block, most, run, "a long, b long, cosine double")


def outranked(rows: DataFrame, threshold: float, key: str = "directory", rank: str = "heat", vector: str = "embedding", block: int = 1024, most: int = MOST_BLOCKS) -> DataFrame:
    """(id) of rows with a row of their key at a cosine of the threshold or more and of a greater ``rank``, or of the same and a
    smaller id: what ``similar_pairs`` leaves to drop, without the pairs. Where a rank is null the smaller id is dropped.
    """

    def run(left, right, same):
        (a, (ra,), x), (b, (rb,), y) = left, right
        lost, lost_too = np.zeros(len(a), bool), np.zeros(len(b), bool)
        for r, c in tiles(len(a), len(b), TILE):
            at, to = np.nonzero(x[r] @ y[c].T >= threshold)
            p, q = at + r.start, to + c.start
            first, other = a[p] < b[q], a[p] != b[q]
            kept_first = np.where(first, ra[p], rb[q]) >= np.where(first, rb[q], ra[p])  # false for null ranks: the first is dropped
            lost[p[other & (first != kept_first)]] = True
            lost_too[q[other & (first == kept_first)]] = True
        ids = a[lost] if same else np.concatenate([a[lost], b[lost_too]])
        yield pa.RecordBatch.from_arrays([pa.array(ids)], ["id"])

    return _met(rows, key, vector, block, most, run, "id long", (rank,)).distinct()


def time_neighbours(rows: DataFrame, minutes: int, ts: str = "created_at", block: int = 4096, most: int = MOST_BLOCKS) -> DataFrame:
    """(a, b, seconds) of rows within ``minutes`` of each other, a < b in (time, id) order; rows without a time are in no pair.

    Buckets are as long as the reach, so a row meets the rows of its bucket and of the next. The rows of a bucket are dealt by a
    hash of their id into blocks of about ``block``, at most ``most`` of them, each a task's share with all that it may meet. There
    a row's partners are a range of the rows in order, found by bisection, and leave in batches. A task holds two buckets of ids
    and seconds. What is shuffled grows with the rows; the pairs grow with the square of the rows in one reach of time.
    """
    width, kind = minutes * 60, rows.schema["id"].dataType.simpleString()
    timed = rows.select("id", F.unix_seconds(F.col(ts).cast("timestamp")).alias("at")).withColumn("bucket", F.floor(F.col("at") / width)).where("bucket is not null")
    counted = block_count(timed, "bucket", block, most, "n")
    sides = F.inline(F.array(F.struct("bucket", F.col("n").alias("own"), F.lit(0).alias("before")), F.struct((F.col("bucket") + 1).alias("bucket"), F.lit(0).alias("own"), F.col("n").alias("before"))))
    blocks = counted.select(sides).groupBy("bucket").agg(F.max("own").alias("own"), F.max("before").alias("before"))
    deal = lambda back, n: F.transform(F.sequence(F.lit(1), n), lambda j: F.struct((F.col("bucket") - back).alias("bucket"), j.alias("block"), (F.pmod(F.xxhash64("id"), n) + 1 == j if back == 0 else F.lit(False)).alias("first")))
    prior = F.when(F.col("before") > 0, deal(1, F.col("before"))).otherwise(F.array())
    placed = timed.join(blocks, "bucket").select("id", "at", F.inline(F.concat(deal(0, F.col("own")), prior)))

    def meet(keys, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(batches)
        rank = pc.rank(group["id"], "ascending", null_placement="at_end", tiebreaker="dense").to_numpy()
        order = np.lexsort((rank, group["at"].to_numpy()))
        ids = group["id"].combine_chunks().take(pa.array(order))
        at, rank = group["at"].to_numpy()[order], rank[order]
        a = np.flatnonzero(group["first"].to_numpy()[order])
        last = np.flatnonzero(np.append((np.diff(at) != 0) | (np.diff(rank) != 0), True))  # of the rows of one time and id, which are no pair
        start, stop = last[np.searchsorted(last, a)] + 1, np.searchsorted(at, at[a] + width, "right")
        nameless = ids.is_null().to_numpy(zero_copy_only=False)  # in no order within its second
        ends = np.cumsum(stop - start)
        for first in range(0, int(ends[-1]) if len(a) else 0, PAIRS):
            pair = np.arange(first, min(first + PAIRS, ends[-1]))
            row = np.searchsorted(ends, pair, "right")
            x, y = a[row], stop[row] + pair - ends[row]
            gap = at[y] - at[x]
            if nameless.any():
                known = (gap > 0) | ~nameless[y]
                x, y, gap = x[known], y[known], gap[known]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(x)), ids.take(pa.array(y)), pa.array(gap)], ["a", "b", "seconds"])

    return spread(placed, "bucket", "block").groupBy("bucket", "block").applyInArrow(_as_arrow(meet), f"a {kind}, b {kind}, seconds long")


def time_maxima(rows: DataFrame, marked: Column, value: str, minutes: int, ts: str = "created_at") -> DataFrame:
    """(id, best): the greatest ``value`` of the other rows that are ``marked`` and within ``minutes`` of a row, null without one.

    Buckets are as long as the reach: what a row reaches is the end of the bucket before its own, its own bucket (whose two best
    rows are kept, as the row itself does not count) and the beginning of the next. Rows of a second are one value in the first
    and last, so a window holds a bucket's seconds however many rows there are. No pair is made. Ids are unique.
    """
    width = minutes * 60
    timed = rows.select("id", F.unix_seconds(F.col(ts).cast("timestamp")).alias("at"), F.when(marked, F.col(value)).alias("v")).where("at is not null")
    timed = timed.withColumn("bucket", F.floor(F.col("at") / width))
    seconds = timed.groupBy("at").agg(F.max("v").alias("v"))
    sides = F.array(*(F.struct(F.lit(s).alias("side"), (F.col("at") + s * width).alias("place"), F.when(F.lit(s == 0), F.col("v")).alias("x")) for s in (-1, 0, 1)))
    placed = seconds.select("at", F.inline(sides)).withColumn("bucket", F.floor(F.col("place") / width))
    ends = Window.partitionBy("bucket")
    reached = placed.withColumns({"later": F.max("x").over(ends.orderBy(F.desc("place"))), "earlier": F.max("x").over(ends.orderBy("place"))})
    outer = reached.where("side <> 0").groupBy("at").agg(F.max(F.when(F.col("side") == -1, F.col("later")).otherwise(F.col("earlier"))).alias("outer"))
    first = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("v"), "id"))
    two = timed.where("v is not null").select("bucket", "id", "v", first.alias("n")).where("n <= 2")
    own = two.groupBy("bucket").agg(*(F.max(F.when(F.col("n") == n, F.col(x))).alias(f"{x}{n}") for n in (1, 2) for x in ("id", "v")))
    met = timed.select("id", "at", "bucket").join(outer, "at").join(own, "bucket", "left")
    return met.select("id", F.greatest("outer", F.when(F.col("id1") == F.col("id"), F.col("v2")).otherwise(F.col("v1"))).alias("best"))


def mentions(rows: DataFrame, entities: DataFrame, text: str = "content") -> DataFrame:
    """(id, name) where the lower-case text holds the lower-case name.

    A name is found by its first word among the words of a text, an equi-join of (id, word) pairs; then the names found
    join their text, once by id, and are checked as substrings that begin a word.
    """
    keyed = entities.select("name", F.regexp_extract(F.lower("name"), r"[\p{L}\p{N}_]+", 0).alias("word")).distinct()
    words = rows.select("id", F.explode(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"))).alias("word"))
    near = words.join(keyed, "word").groupBy("id").agg(F.collect_set("name").alias("names"))
    found = rows.select("id", F.lower(text).alias("low")).join(near, "id")
    return found.select("id", F.explode(F.filter("names", lambda n: F.contains(F.col("low"), F.lower(n)))).alias("name")).distinct()


def fired(context: DataFrame, triggers: DataFrame, block: int = 1000) -> DataFrame:
    """(id, trigger_id): contexts that fire a trigger by directory, keyword, entity or time. Triggers are a stated set; more than
    ``block`` of them are tried in blocks, each of which reads the contexts once.

    context: id, directory, content, entities, ts. triggers: trigger_id, kind, condition, target.
    """
    kind, condition = F.col("kind"), F.col("condition")
    place = F.coalesce(F.nullif("target", F.lit("")), condition)
    clock = F.when(condition.rlike(r"^\d{1,2}:\d{2}$"), (F.hour("ts") == F.split(condition, ":")[0].try_cast("int")) & (F.minute("ts") == F.split(condition, ":")[1].try_cast("int")))
    clock = clock.when(condition.rlike(r"^weekday:\d$"), F.weekday("ts") == F.substring(condition, 9, 1).try_cast("int")).otherwise(False)
    keywords = F.exists(F.filter(F.split(F.lower(condition), r"\s+"), lambda w: w != ""), lambda w: F.contains(F.lower("content"), w))
    test: Column = (
        F.when(kind == "directory_match", (place != "") & F.contains("directory", place)).when(kind == "keyword_match", keywords)
        .when(kind == "entity_match", F.exists("entities", lambda e: F.lower(e) == F.lower(condition))).when(kind == "time_based", clock).otherwise(False)
    )
    blocks, out = max(1, -(-triggers.count() // block)), None
    for n in range(blocks):
        own = triggers.where(F.pmod(F.xxhash64("trigger_id"), F.lit(blocks)) == n) if blocks > 1 else triggers
        listed = own.agg(F.collect_list(F.struct("trigger_id", "kind", "condition", "target")).alias("t")).scalar()
        found = context.select("*", F.inline(listed)).where(test).select("id", "trigger_id")
        out = found if out is None else out.unionAll(found)
    return out


def embed(rows: DataFrame, dims: int = 64, text: str = "content", out: str = "embedding", encoder=None) -> DataFrame:
    """Add unit vectors by ``encoder`` (list of texts to matrix); the default hashes words to signed positions."""
    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch[out] = list((encoder or hash_encoder(dims))(batch[text].fillna("").tolist()))
            yield batch

    return rows.mapInPandas(run, schema)


def hash_encoder(dims: int):
    """Deterministic encoder: each word adds +1 or -1 at a position that its CRC names; vectors have unit length."""
    import zlib

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dims] += 1.0 if h & 0x80000000 else -1.0
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, size, out=out, where=size > 0)

    return encode
