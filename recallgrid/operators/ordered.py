"""Order-bound folds over bounded or keyed groups: packing of contexts, rotation of episodes, slots, hypervectors."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunks(pool: DataFrame, overlap: float = 0.3, hours: float = 2.0) -> DataFrame:
    """(query_id, id, chunk): greedy chunks of a recall's rows in their order. A row joins the first chunk whose opener shares
    more than ``overlap`` of its names, or is less than ``hours`` away. pool: query_id, id, rank, names, created_at; top-k sized.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["rank", "id"], ignore_index=True)
        names = [set(x) for x in group["names"]]
        at = group["created_at"].astype("int64") if group["created_at"].notna().all() else None
        unit = 3.6e12 if at is None or str(group["created_at"].dtype).endswith("ns]") else 3.6e9
        chunk = [-1] * len(group)
        for i in range(len(group)):
            if chunk[i] >= 0:
                continue
            chunk[i] = i
            for j in range(i + 1, len(group)):
                if chunk[j] < 0:
                    both = names[i] | names[j]
                    near = bool(names[i] and names[j]) and len(names[i] & names[j]) / len(both) > overlap
                    if near or (at is not None and abs(at[i] - at[j]) / unit < hours):
                        chunk[j] = i
        return pd.DataFrame({"query_id": group["query_id"], "id": group["id"], "chunk": chunk})

    return pool.groupBy("query_id").applyInPandas(run, "query_id long, id long, chunk long")


def episodes(turns: DataFrame, key: str, order: str, text: str, size: int = 200_000, overlap: int = 8_000) -> DataFrame:
    """(key, order, episode): a session's turns cut into episodes. A new one opens when the characters since the last cut,
    ``overlap`` carried over, exceed ``size``. One session is read in order by one task, without being held.
    """
    rows = turns.select(F.col(key).cast("long").alias("key"), F.col(order).cast("long").alias("at"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n"))
    ordered = rows.repartition("key").sortWithinPartitions("key", "at", "n")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, total, episode = None, 0, 0
        for batch in batches:
            out = np.zeros(len(batch), np.int64)
            for i, (k, n) in enumerate(zip(batch["key"], batch["n"], strict=True)):
                if k != last:
                    last, total, episode = k, 0, 0
                if total and total + n > size:
                    episode, total = episode + 1, min(overlap, total)
                total += n
                out[i] = episode
            yield pd.DataFrame({"key": batch["key"], "at": batch["at"], "episode": out})

    return ordered.mapInPandas(run, "key long, at long, episode long").toDF(key, order, "episode")


def slots(stores: DataFrame, n_slots: int = 100, half_life: float = 6.0, boost: float = 0.5, inhibit: float = 0.2, reach: int = 2) -> DataFrame:
    """(agent, id, slot, linked): each store of an agent, in (ts, id) order, takes the most excitable slot (the first of
    equals), raises it and lowers its neighbours; linked counts the slot's earlier stores. State is ``n_slots`` numbers.
    """
    rows = stores.select("agent", F.col("id").cast("long").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    ordered = rows.repartition("agent").sortWithinPartitions("agent", "us", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for batch in batches:
            got = []
            for agent, us in zip(batch["agent"], batch["us"], strict=True):
                if agent != last:
                    last, state = agent, SlotState.new(n_slots, us)
                got.append(state.take(us, half_life, boost, inhibit, reach))
            yield pd.DataFrame({"agent": batch["agent"], "id": batch["id"], "slot": [s for s, _ in got], "linked": [n for _, n in got]})

    return ordered.mapInPandas(run, "agent string, id long, slot long, linked long")


@dataclass
class SlotState:
    """Excitability of an agent's slots as of ``seen`` (microseconds), and the number of stores that each holds."""

    level: np.ndarray
    seen: np.ndarray
    held: np.ndarray

    @classmethod
    def new(cls, n_slots: int, us: int) -> SlotState:
        return cls(np.zeros(n_slots), np.full(n_slots, us, np.int64), np.zeros(n_slots, np.int64))

    def take(self, us: int, half_life: float, boost: float, inhibit: float, reach: int) -> tuple[int, int]:
        """(slot, its earlier stores) of a store at ``us``; the slot rises and its neighbours sink."""
        now = self.level * 2.0 ** (-np.maximum(us - self.seen, 0) / 3.6e9 / half_life)
        slot = int(now.argmax())
        linked = int(self.held[slot])
        self.held[slot] += 1
        self.level[slot], self.seen[slot] = min(1.0, now[slot] + boost), us
        for d in (*range(-reach, 0), *range(1, reach + 1)):
            if 0 <= slot + d < len(self.level):
                self.level[slot + d], self.seen[slot + d] = max(0.0, now[slot + d] - inhibit), us
        return slot, linked


def atom(name: str, dims: int) -> np.ndarray:
    """A fixed bipolar vector of a name: signs from a generator seeded by its CRC, the same in every process."""
    return np.random.default_rng(zlib.crc32(name.encode())).integers(0, 2, dims, dtype=np.int8) * 2 - 1


def hypervector(directory: str | None, tags: list[str], names: list[str], store: str | None, dims: int = 10_000) -> np.ndarray:
    """Sign of the sum of role * filler; equal counts take the sign of a fixed atom."""
    parts = [("directory", directory)] * (directory is not None) + [("tag", t) for t in tags] + [("entity", e) for e in names] + [("type", store)] * (store is not None)
    total = np.zeros(dims, np.int32)
    for role, filler in parts:
        total += atom(f"role:{role}", dims) * atom(filler, dims)
    return np.where(total == 0, atom("tie", dims), np.sign(total)).astype(np.int8)


def permuted(vector: np.ndarray, steps: int = 1) -> np.ndarray:
    """The vector turned by ``steps`` places: marks an order."""
    return np.roll(vector, steps)


def to_bytes(vector: np.ndarray) -> bytes:
    """One bit for each sign."""
    return np.packbits(vector > 0).tobytes()


def from_bytes(data: bytes, dims: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8))[:dims].astype(np.int8) * 2 - 1


def hyper_search(memories: DataFrame, query: np.ndarray, k: int = 10) -> DataFrame:
    """(id, similarity): cosine of each memory's hypervector with the query's; vectors are made and compared in one pass."""
    shared = memories.sparkSession.sparkContext.broadcast(query.astype(np.float32))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = shared.value
        for batch in batches:
            cos = [float(hypervector(d, list(t), list(n), s, len(q)) @ q) / len(q) for d, t, n, s in zip(batch["directory"], batch["tags"], batch["names"], batch["store_type"], strict=True)]
            yield pd.DataFrame({"id": batch["id"], "similarity": np.round(cos, 6)})

    scored = memories.select("id", "directory", "tags", "names", "store_type").mapInPandas(run, "id long, similarity double")
    return scored.orderBy(F.desc("similarity"), "id").limit(k)


def complete(patterns: DataFrame, query: list[float], beta: float = 8.0, rounds: int = 5, most: int = 5000) -> list[float]:
    """Pattern completion: the query becomes the softmax-weighted mean of the ``most`` hottest unit vectors, a few times."""
    hot = patterns.orderBy(F.desc("heat"), "id").limit(most).select("embedding").collect()
    q = np.asarray(query, float)
    if not hot:
        return q.tolist()
    x = np.array([r["embedding"] for r in hot])
    for _ in range(rounds):
        s = beta * (x @ q)
        w = np.exp(s - s.max())
        q = w @ x / w.sum()
        q = q / max(np.linalg.norm(q), 1e-12)
    return q.tolist()
