"""Best-fit packing of token pieces into sequences by bin completion.

Only a piece's length matters, and lengths lie in 1..capacity, so the problem is its histogram of at most ``capacity``
entries, whatever the number of documents. A plan is a list of (pattern, times): a pattern is a filling of one sequence,
as (length, count) pairs. Best-fit decreasing on the histogram gives the first plan. If it uses more sequences than the
waste bound allows, bin completion looks for a better one: take the largest length left, enumerate the fillings around it
that no other filling dominates, in the order of their waste, apply one as often as the counts allow, and cut a branch when
its waste exceeds what an improvement can afford. Plans found become the new incumbent. Fillings are made one by one, as
the search asks for them; all of them are reached unless the one limit of the search, its ``nodes``, ends it before. The
column ``proven`` says whether the plan is known to have the fewest sequences: it meets the bound or the search ended.

Pieces are numbered within their length (by part, then by order in the part), and each takes the place that the plan
gives to its number. The plan has at most a few thousand patterns and is broadcast; pieces are never collected.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.llm.encode import encoder, text_slices
from recallgrid.llm.shared import stored

Pattern = tuple[tuple[int, int], ...]
Plan = list[tuple[Pattern, int]]


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing on a histogram: each length goes to the fullest sequences that still take it."""
    open_bins: dict[int, list[tuple[Pattern, int]]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, times: int) -> None:
        if room not in open_bins:
            open_bins[room] = []
            rooms.insert(bisect_right(rooms, room), room)
        open_bins[room].append((pattern, times))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_right(rooms, length - 1)
            if at == len(rooms):
                fits = min(left, capacity // length)
                times = left // fits
                put(capacity - fits * length, ((length, fits),), times)
                left -= fits * times
                continue
            room = rooms[at]
            pattern, times = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room], rooms[at]
            fits = min(left, room // length)
            used = min(times, left // fits)
            if used < times:
                put(room, pattern, times - used)
            put(room - fits * length, (*pattern, (length, fits)), used)
            left -= fits * used
    return [bin_ for room in rooms for bin_ in open_bins[room]]


def sequences(plan: Plan) -> int:
    return sum(times for _, times in plan)


def waste_bound(counts: dict[int, int], capacity: int) -> int:
    """A lower bound of the sequences: the total over the capacity, or more where, for some k, the pieces of k to half the
    capacity exceed the room beside those over half that leave k or more.
    """
    n = np.zeros(capacity + 2, np.int64)
    for length, times in counts.items():
        n[length] = times
    total = n * np.arange(capacity + 2)
    pieces, tokens = np.cumsum(n), np.cumsum(total)  # of lengths up to the index
    half, k = capacity // 2, np.arange(1, capacity // 2 + 1)
    alone = pieces[capacity] - pieces[capacity - k]
    halves = pieces[capacity - k] - pieces[half]
    room = halves * capacity - (tokens[capacity - k] - tokens[half])
    small = tokens[half] - tokens[k - 1]
    more = np.maximum(0, -((room - small) // capacity))
    return int(max(-(-int(tokens[capacity]) // capacity), (alone + halves + more).max(initial=0)))


def _reachable(lengths: list[int], counts: list[int], room: int) -> list[int]:
    """For each index, the sums up to ``room`` that the lengths from there on can make, as bits of a number."""
    whole = (1 << (room + 1)) - 1
    out = [1] * (len(lengths) + 1)
    for i in range(len(lengths) - 1, -1, -1):
        sums, left, step = out[i + 1], min(counts[i], room // lengths[i]), 1
        while left:
            take = min(step, left)
            sums |= sums << (take * lengths[i]) & whole
            left, step = left - take, step * 2
        out[i] = sums
    return out


def fillings(counts: dict[int, int], largest: int, capacity: int, most_waste: int) -> Iterator[Pattern]:
    """All undominated fillings around one piece of ``largest`` that leave at most ``most_waste``, those that leave least first.

    A filling that could take a further piece, or exchange one for a longer one that is left and fits, is dominated. Sums
    that the lengths can make are known beforehand, so that every step of the enumeration leads to a filling.
    """
    room = capacity - largest
    lengths = sorted((l for l, n in counts.items() if l <= room and n - (l == largest) > 0), reverse=True)
    left_of = [counts[l] - (l == largest) for l in lengths]
    sums = _reachable(lengths, left_of, room)

    def undominated(chosen: dict[int, int], waste: int) -> bool:
        if not waste:
            return True
        have = sorted(chosen)
        for l, n in zip(lengths, left_of, strict=True):
            if n > chosen.get(l, 0):
                at = bisect_right(have, l - 1)
                if l <= waste or (at and have[at - 1] + waste >= l):
                    return False
        return True

    def exact(at: int, total: int, chosen: tuple[tuple[int, int], ...]) -> Iterator[tuple[tuple[int, int], ...]]:
        if not total:
            yield chosen
            return
        for i in range(at, len(lengths)):
            for n in range(min(total // lengths[i], left_of[i]), 0, -1):
                after = total - n * lengths[i]
                if sums[i + 1] >> after & 1:
                    yield from exact(i + 1, after, (*chosen, (lengths[i], n)))
            if not sums[i + 1] >> total & 1:
                return

    for waste in range(min(most_waste, room) + 1):
        if sums[0] >> (room - waste) & 1:
            for chosen in exact(0, room - waste, ()):
                if undominated(dict(chosen), waste):
                    yield ((largest, 1), *chosen)


def _merged(pattern: Pattern) -> Pattern:
    total: dict[int, int] = {}
    for length, n in pattern:
        total[length] = total.get(length, 0) + n
    return tuple(sorted(total.items(), reverse=True))


def bin_completion(counts: dict[int, int], capacity: int, nodes: int = 1000) -> tuple[Plan, bool]:
    """The best plan found within ``nodes`` search nodes, and whether it is proven; best-fit decreasing is the first incumbent."""
    counts = {l: n for l, n in counts.items() if n}
    incumbent = best_fit(counts, capacity)
    bound = waste_bound(counts, capacity)
    total = sum(l * n for l, n in counts.items())

    def affordable() -> int:
        return (sequences(incumbent) - 1) * capacity - total

    def branches(left: dict[int, int], waste: int) -> Iterator[tuple[Pattern, int, int]]:
        """(pattern, times, waste of a sequence): as often as counts and waste allow, and, for exactness, fewer times."""
        for pattern in fillings(left, max(left), capacity, max(0, affordable() - waste)):
            pattern = _merged(pattern)
            lost = capacity - sum(l * n for l, n in pattern)
            most = min(left[l] // n for l, n in pattern)
            if lost:
                most = max(1, min(most, (affordable() - waste) // lost))
            for times in (most, 1) if most > 1 else (1,):
                yield pattern, times, lost

    stack: list[tuple[dict[int, int], Plan, int, int, Iterator]] = []
    spent, whole = 0, True

    def enter(left: dict[int, int], plan: Plan, used: int, waste: int) -> None:
        nonlocal incumbent, spent
        spent += 1
        rest = best_fit(left, capacity)
        if used + sequences(rest) < sequences(incumbent):
            incumbent = plan + rest
        if left and waste <= affordable() and used + waste_bound(left, capacity) < sequences(incumbent):
            stack.append((left, plan, used, waste, branches(left, waste)))

    if counts and sequences(incumbent) > bound:
        enter(counts, [], 0, 0)
    while stack and sequences(incumbent) > bound:
        if spent >= nodes:
            whole = False
            break
        left, plan, used, waste, more = stack[-1]
        step = next(more, None) if used + waste_bound(left, capacity) < sequences(incumbent) else None
        if step is None:
            stack.pop()
            continue
        pattern, times, lost = step
        if waste + lost * times > affordable():
            continue
        after = {l: n for l, n in ((l, n - times * dict(pattern).get(l, 0)) for l, n in left.items()) if n}
        enter(after, [*plan, (pattern, times)], used + times, waste + lost * times)
    return incumbent, whole or sequences(incumbent) <= bound


def places(plan: Plan) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first number, first sequence, pieces a sequence, offset of the first piece in it, in ascending first number."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    given: dict[int, int] = {}
    base = 0
    for pattern, times in plan:
        offset = 0
        for length, n in _merged(pattern):
            first = given.get(length, 0)
            found.setdefault(length, []).append((first, base, n, offset))
            given[length] = first + n * times
            offset += n * length
        base += times
    return {l: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for l, rows in found.items()}


def cut_pieces(docs: DataFrame, path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored pieces: doc_id, piece, start, length, ids_crc32, and part and number (order within part and length).

    A null or empty text gives the end id alone, a very long one as many pieces as it needs. Rows with a null or repeated
    number are documents of their own. An empty table gives an empty one; other columns are dropped, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, given = encoder(path), TaskContext.get().partitionId(), {}
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "number"]
        for batch in batches:
            rows = []
            numbers = batch.column(0).to_pylist()
            for row, ids in ((low + i, ids) for low, texts in text_slices(batch.column(1)) for i, ids in enumerate(coder.many(texts))):
                number, ids = numbers[row], np.append(ids, coder.dtype.type(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    own = ids[at : at + capacity]
                    n = given.get(len(own), 0)
                    given[len(own)] = n + 1
                    rows.append((number, k, at, len(own), zlib.crc32(own.tobytes()), part, n))
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(cols)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return stored(rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part long, number long"), "pieces")


def pack(pieces: DataFrame, capacity: int, nodes: int = 1000) -> DataFrame:
    """Pieces with sequence_id, offset and proven. Counts by (length, part) are shuffled; pieces meet their part's offsets by a merge.

    ``pieces`` comes from ``cut_pieces``; nulls and repeats of doc_id stay as they are, since only lengths decide. Pieces
    of equal length are interchangeable and placed in the order of their parts. An empty table gives an empty one; further
    columns are dropped. proven: no plan has fewer sequences.
    """
    counts = stored(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    plan, proven = bin_completion(histogram, capacity, nodes)
    shared = pieces.sparkSession.sparkContext.broadcast(places(plan))
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = stored(counts.select("length", "part", F.coalesce(earlier, F.lit(0)).alias("earlier")), "offsets")
    # The offsets grow with the parts, so they are never broadcast.
    ranked = pieces.join(offsets.hint("merge"), ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("earlier") + F.col("number")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            lengths, ranks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            order = np.argsort(lengths, kind="stable")
            cuts = np.flatnonzero(np.diff(lengths[order])) + 1
            for rows in np.split(order, cuts) if len(order) else []:
                length = int(lengths[rows[0]])
                first, base, each, start = table[length]
                at = np.searchsorted(first, ranks[rows], side="right") - 1
                into = ranks[rows] - first[at]
                sequence[rows] = base[at] + into // each[at]
                offset[rows] = start[at] + into % each[at] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumn("proven", F.lit(proven))
