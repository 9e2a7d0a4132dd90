"""Similarity self-join of documents on word shingles, with Bayesian pruning of MinHash candidates.

Documents with equal word sequences form one node. Nodes are put into buckets by bands of MinHash values; every pair of
nodes that share a bucket is a candidate. Nodes that share buckets, directly or through others, are brought together once
as a group, and the pairs inside it are looked at in blocks of bounded size, so that no pair becomes a row. Where such a
group has more than ``refine`` nodes, as chains of slightly alike texts make them, its buckets are first looked at one by one
(a hot one in blocks) on MinHash values alone: only nodes joined by pairs that the pruning does not drop stay together.

A pair's MinHash values are compared a few at a time; the pair is dropped as soon as the posterior probability (uniform
prior) that its Jaccard similarity reaches the threshold falls below ``tolerance``. All others are verified exactly on their
shingle sets. A block returns link counts by node and a spanning forest of its links, both linear in its nodes.

With 30 bands of 5 values a pair of similarity 0.8 shares no band with probability 7e-6; above 0.85 below 1e-7.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.llm.components import components
from recallgrid.llm.shared import discard, stored
from recallgrid.llm.textscan import Words, mix, slices


@dataclass(frozen=True)
class JoinSettings:
    """width: words in a shingle. chunk: nodes on each side of a block, in groups of up to 32
    chunks; beyond, it grows with the square root of the group, to 32 times as much, so that a node travels less often. refine: nodes
    of a group from which its buckets are looked at first, in blocks of ``side`` nodes. steps: MinHash values compared before
    each test. key_bits: of a node's number; the words' other 64 bits are checked beside it."""

    width: int = 5
    threshold: float = 0.8
    bands: int = 30
    rows: int = 5
    tolerance: float = 1e-9
    chunk: int = 128
    refine: int = 512
    side: int = 1024
    key_bits: int = 64
    steps: tuple[int, ...] = (25, 50, 75, 100, 150)


def minhash(shingles: np.ndarray, offsets: np.ndarray, count: int) -> np.ndarray:
    """``count`` MinHash values (uint32) for each document; rows of documents without shingles stay at the maximum."""
    out = np.full((len(offsets) - 1, count), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        seeds = mix(np.arange(1, 2 * count + 1, dtype=np.uint64))
        low = shingles.astype(np.uint32)
        high = (shingles >> np.uint64(32)).astype(np.uint32)
        for k in range(count):
            value = (low ^ np.uint32(seeds[2 * k] >> np.uint64(32))) * (np.uint32(seeds[2 * k] & np.uint64(0xFFFFFFFE)) | np.uint32(1))
            value ^= high * (np.uint32(seeds[2 * k + 1] & np.uint64(0xFFFFFFFE)) | np.uint32(1))
            value *= np.uint32(0x9E3779B1)
            out[full, k] = np.minimum.reduceat(value, offsets[full])
    return out


def node_keys(words: Words, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each document's word sequence, together 128 bits of a digest: the node and its check."""
    text, at = words.normalised()
    view = memoryview(text)
    digests = b"".join(hashlib.md5(view[at[i] : at[i + 1]]).digest() for i in range(len(at) - 1))
    both = np.frombuffer(digests, "<i8").reshape(-1, 2)
    return both[:, 0] >> np.int64(64 - bits), both[:, 1]


def band_keys(values: np.ndarray, settings: JoinSettings) -> np.ndarray:
    """The bucket of each band, from MinHash values (documents x values)."""
    places = mix(np.arange(1, settings.rows + 1, dtype=np.uint64)) | np.uint64(1)
    names = mix(np.arange(1001, 1001 + settings.bands, dtype=np.uint64))
    values = values.reshape(-1, settings.bands, settings.rows)
    return mix((values.astype(np.uint64) * places).sum(axis=2, dtype=np.uint64) + names).view(np.int64)


def _sign(settings: JoinSettings):
    """(id, raw, node, check, sign) for rows (id, raw, text); sign is null for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, at in slices(batch.column(2)):
                words = Words(data, at)
                shingles, first = words.shingles(settings.width)
                values = minhash(shingles, first, settings.bands * settings.rows)
                node, check = node_keys(words, settings.key_bits)
                signs = [v.tobytes() if n else None for v, n in zip(values, np.diff(first), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), pa.array(node), pa.array(check), pa.array(signs, pa.binary())], ["id", "raw", "node", "check", "sign"])

    return run


def _place(settings: JoinSettings):
    """(node, band) for each bucket of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), settings.bands)), pa.array(band_keys(values, settings).reshape(-1))], ["node", "band"])

    return run


def keep_at_least(settings: JoinSettings) -> list[int]:
    """For each step, the fewest equal values with which the posterior of reaching the threshold is not below tolerance."""
    t, out = settings.threshold, []
    for n in settings.steps:
        total, least = 0.0, 0
        for m in range(n + 1):
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= settings.tolerance:
                least = m
                break
        out.append(least)
    return out


def _own_chunk(nodes: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    return (mix(nodes.view(np.uint64)) % chunks.astype(np.uint64)).astype(np.int64)


def _spread(settings: JoinSettings):
    """A row for each block that a node takes part in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["component", "i", "j", "node", "weight", "chunk", "sign", "shingles"]
        for batch in batches:
            nodes, groups, weights, chunks, checks = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4, 5, 6))
            own = _own_chunk(nodes, chunks)
            for low, high, data, at in slices(batch.column(1)):
                words = Words(data, at)
                keep = np.flatnonzero(node_keys(words)[1] == checks[low:high])
                shingles, first = words.shingles(settings.width)
                rows: list[tuple] = []
                for x in keep:
                    r = low + x
                    sets = np.unique(shingles[first[x] : first[x + 1]]).tobytes()
                    sign, mine = batch.column(7)[r].as_py(), int(own[r])
                    rows += [(int(groups[r]), min(mine, c), max(mine, c), int(nodes[r]), int(weights[r]), mine, sign, sets) for c in range(int(chunks[r]))]
                    if len(rows) > 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

    return run


def surviving_pairs(settings: JoinSettings, a_sign: np.ndarray, b_sign: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows (a, b) of the pairs that no test drops; same: both sides are one, and a < b."""
    least, equal, done = keep_at_least(settings), np.zeros((len(a_sign), len(b_sign)), np.uint16), 0
    a = b = agree = None
    for n, need in zip(settings.steps, least, strict=True):
        if a is None:
            for k in range(done, n):
                equal += a_sign[:, k][:, None] == b_sign[:, k][None, :]
            alive = equal >= need
            if same:
                alive &= np.triu(np.ones_like(alive), 1)
            a, b = np.nonzero(alive)
            agree = equal[a, b]
        else:
            agree = agree + (a_sign[a, done:n] == b_sign[b, done:n]).sum(axis=1)
            alive = agree >= need
            a, b, agree = a[alive], b[alive], agree[alive]
        done = n
        if not len(a):
            break
    return a, b


class Forest:
    """Union-find that keeps the links which join two trees."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        parent = self.parent
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.links.append((a, b))


def _blocks_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[list]]]:
    """(first three columns, rows of the other columns) for runs of equal first three columns; a node stands once in each."""
    key, members = None, {}
    for batch in batches:
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
        columns = [batch.column(i).to_pylist() for i in range(3, width)]
        for r, k in enumerate(keys):
            if k != key:
                if key is not None:
                    yield key, list(members.values())
                key, members = k, {}
            members[columns[0][r]] = [c[r] for c in columns]
    if key is not None:
        yield key, list(members.values())


def _sides(key: tuple, rows: list, chunk: int) -> tuple[list, list | None]:
    """The members of a block's two chunks; one side only for a chunk with itself."""
    left = [r for r in rows if r[chunk] == key[1]]
    return left, None if key[1] == key[2] else [r for r in rows if r[chunk] == key[2]]


def _refine(settings: JoinSettings):
    """(a, b): a spanning forest of the pairs in a bucket's block that pruning does not drop. Rows: band, i, j, node, chunk, sign."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _blocks_of(batches, 6):
            left, right = _sides(key, rows, 1)
            if not left or right == []:
                continue
            a_sign = np.stack([np.frombuffer(r[2], np.uint32) for r in left])
            b_sign = a_sign if right is None else np.stack([np.frombuffer(r[2], np.uint32) for r in right])
            forest = Forest()
            for a, b in zip(*surviving_pairs(settings, a_sign, b_sign, right is None), strict=True):
                forest.join(left[a][0], (left if right is None else right)[b][0])
            if forest.links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*forest.links, strict=True)], ["a", "b"])

    return run


def verify_block(settings: JoinSettings, left: list[tuple], right: list[tuple] | None) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Weights of partners by node, and a spanning forest of the links. Members: (node, weight, MinHash values, shingle set).

    right None: all pairs within ``left``.
    """
    other = left if right is None else right
    a_sign = np.stack([m[2] for m in left])
    a, b = surviving_pairs(settings, a_sign, a_sign if right is None else np.stack([m[2] for m in other]), right is None)
    if not len(a):
        return {}, []
    used = np.unique(b)
    slot = np.full(len(other), -1)
    slot[used] = np.arange(len(used))
    sets = [other[u][3] for u in used]
    sizes = np.array([len(s) for s in sets])
    vocabulary, codes = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.cumsum(sizes) - sizes
    links: dict[int, int] = {}
    forest = Forest()
    cuts = np.flatnonzero(np.diff(a)) + 1
    for own, partners in zip(a[np.concatenate([[0], cuts])], np.split(b, cuts), strict=True):
        node, weight, _, mine = left[own]
        at = np.searchsorted(vocabulary, mine)
        at = at[at < len(vocabulary)] if len(at) and at[-1] >= len(vocabulary) else at
        marked = np.zeros(len(vocabulary), np.int64)
        marked[at[vocabulary[at] == mine[: len(at)]]] = 1
        common = np.add.reduceat(marked[codes], first)[slot[partners]]
        union = len(mine) + sizes[slot[partners]] - common
        for p in partners[common >= settings.threshold * union - 1e-9]:
            to, to_weight = other[p][0], other[p][1]
            links[node] = links.get(node, 0) + to_weight
            links[to] = links.get(to, 0) + weight
            forest.join(node, to)
    return links, forest.links


def _verify(settings: JoinSettings):
    """Rows: component, i, j, node, weight, chunk, sign, shingles. Results: link counts (other null) and links of a forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def table() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["node", "other", "links"])
            out.clear()
            return batch

        def member(r: list) -> tuple:
            return r[0], r[1], np.frombuffer(r[3], np.uint32), np.frombuffer(r[4], np.uint64)

        for key, rows in _blocks_of(batches, 8):
            left, right = _sides(key, rows, 2)
            if left and right != []:
                links, forest = verify_block(settings, [member(r) for r in left], None if right is None else [member(r) for r in right])
                out.extend((n, None, w) for n, w in links.items())
                out.extend((x, y, 0) for x, y in forest)
            if len(out) > 5000:
                yield table()
        if out:
            yield table()

    return run


def _nodes(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``signed`` and its nodes (node, rep, weight, check, sign). Node numbers that stand for two word sequences are replaced."""
    while True:
        nodes = stored(signed.groupBy("node").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.min("check").alias("check"), F.max("check").alias("high"), F.first("sign").alias("sign")), "nodes")
        clash = nodes.where(F.col("check") != F.col("high")).select("node", F.lit(True).alias("clash"))
        if clash.isEmpty():
            return signed, nodes.drop("high")
        renamed = F.when(F.col("clash"), F.xxhash64("node", "check")).otherwise(F.col("node"))
        signed = stored(signed.join(clash, "node", "left").withColumn("node", renamed).drop("clash"), "signed")


def candidate_groups(nodes: DataFrame, settings: JoinSettings) -> DataFrame:
    """(node, component) of nodes that share a bucket with another, directly or through others; see the module's text on ``refine``."""
    placed = nodes.where("sign is not null").select("node", "sign").mapInArrow(_place(settings), "node long, band long")
    shared = stored(placed.join(placed.groupBy("band").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1"), "band"), "buckets")
    groups = components(shared.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")))
    large = stored(groups.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > settings.refine).select("component"), "large")
    if large.isEmpty():
        discard(shared, large)
        return groups
    inside = groups.join(large, "component").select("node").join(nodes.select("node", "sign"), "node")
    chunks = F.ceil(F.col("n") / settings.side).cast("int")
    dealt = shared.select("node", "band", chunks.alias("chunks")).join(inside, "node").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(5)), F.col("chunks")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    blocks = other.select("band", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "node", "chunk", "sign")
    close = blocks.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(_refine(settings), "a long, b long")
    done = stored(groups.join(large, "component", "left_anti").select("node", "component").unionByName(components(close).select("node", "component")), "groups")
    discard(shared, large)
    return done


def _joined(docs: DataFrame, id_col: str, text_col: str, settings: JoinSettings) -> tuple[DataFrame, DataFrame]:
    """(id, raw, node) of every row, and (node, root, class_id, weight, links) of every node."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    raw = F.coalesce(F.md5(F.col("text")), F.lit(""))
    signed = stored(rows.select("id", raw.alias("raw"), "text").mapInArrow(_sign(settings), "id long, raw string, node long, check long, sign binary"), "signed")
    signed, nodes = _nodes(signed)
    groups = candidate_groups(nodes, settings)
    size = F.count(F.lit(1))
    side = settings.chunk * F.least(F.lit(32.0), F.greatest(F.lit(1.0), F.sqrt(size / (32 * settings.chunk))))
    sizes = stored(groups.groupBy("component").agg(F.ceil(size / side).cast("int").alias("chunks")), "sizes")
    active = groups.join(sizes, "component").join(nodes, "node")
    texts = rows.join(active, F.col("id").eqNullSafe(F.col("rep"))).select("id", "text", "node", "component", "weight", "chunks", "check", "sign")
    blocks = texts.mapInArrow(_spread(settings), "component long, i long, j long, node long, weight long, chunk long, sign binary, shingles binary")
    found = blocks.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(_verify(settings), "node long, other long, links long")
    found = stored(found, "found")
    classes = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = stored(
        nodes.select("node", "rep", "weight").join(classes, "node", "left").join(links, "node", "left")
        .select("node", "rep", "weight", F.coalesce("component", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links")),
        "known",
    )
    discard(nodes, groups, sizes, found, classes)
    least = known.groupBy("root").agg(F.min("rep").alias("class_id"))
    return signed, known.drop("rep").join(least, "root")


def similarity_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: JoinSettings | None = None) -> DataFrame:
    """One row per input row: id, class_id (least id of its group of linked documents), n_copies, n_links.

    A link joins two documents whose sets of ``width``-word shingles have Jaccard similarity of the threshold or more
    (a document of fewer words has one shingle, of all its words). n_copies counts documents with the same words, itself
    included; n_links counts all other documents linked to it, copies among them. class_id joins links transitively.
    A null text counts as empty; documents without words are copies of each other and of nothing else. A null id is
    kept and never chosen as class_id unless the whole class has none. Repeated rows are copies. Texts of any length are
    compared whole. An empty table gives an empty one. Other columns are ignored, whatever their names.
    """
    signed, known = _joined(docs, id_col, text_col, settings or JoinSettings())
    return signed.select("id", "node").join(known, "node").select(F.col("id").alias(id_col), "class_id", F.col("weight").alias("n_copies"), (F.col("weight") - 1 + F.col("links")).alias("n_links"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: JoinSettings | None = None) -> DataFrame:
    """One row of ``docs`` for each class of linked documents, whole: that of the least id (null last), then of the least digest of the text.

    Of rows that repeat both id and text one stays. An empty table gives an empty one.
    """
    signed, known = _joined(docs, id_col, text_col, settings or JoinSettings())
    stays = F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("raw").alias("raw"))).alias("stays")
    keepers = stored(signed.select("id", "raw", "node").join(known.select("node", "root"), "node").groupBy("root").agg(stays, F.count(F.lit(1)).alias("n")).select("stays.id", "stays.raw", "n"), "keepers")
    own = docs.withColumns({"_id": F.col(id_col).cast("long"), "_raw": F.coalesce(F.md5(F.col(text_col).cast("string")), F.lit(""))})
    renamed = keepers.select(F.col("id").alias("_keep_id"), F.col("raw").alias("_keep_raw"), F.col("n").alias("_keep_n"))
    same = own["_id"].eqNullSafe(renamed["_keep_id"]) & (own["_raw"] == renamed["_keep_raw"])
    kept = own.join(renamed, same)
    # Only a row that has copies can stand twice under one id and text.
    single = kept.where("_keep_n = 1").select(*docs.columns)
    several = kept.where("_keep_n > 1").dropDuplicates(["_id", "_raw"]).select(*docs.columns)
    return single.unionByName(several)
