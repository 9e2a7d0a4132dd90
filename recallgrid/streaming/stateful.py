"""Keyed state on streams: limited triggers, episode rotation, cooldowns, excitable slots, recent stores."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recallgrid.operators.ordered import SlotState


def limited(fired: DataFrame, most: int = 5) -> DataFrame:
    """(trigger_id, id, count) of a stream of (trigger_id, id): each trigger's first ``most`` firings, by id within a batch."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches), ignore_index=True).sort_values("id", ignore_index=True).head(max(0, most - count))
        state.update((count + len(rows),))
        yield pd.DataFrame({"trigger_id": key[0], "id": rows["id"], "count": range(count + 1, count + len(rows) + 1)})

    return fired.groupBy("trigger_id").applyInPandasWithState(run, "trigger_id long, id long, count long", "n long", "append", GroupStateTimeout.NoTimeout)


def rotated(turns: DataFrame, size: int = 200_000, overlap: int = 8_000) -> DataFrame:
    """(session_id, turn, episode) of a stream of (session_id, turn, text): a new episode opens when the characters since
    the last cut exceed ``size``; ``overlap`` of them carry over. Turns are taken in order within a batch; batches in order.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, episode = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches), ignore_index=True).sort_values("turn", ignore_index=True)
        out = []
        for n in rows["text"].fillna("").str.len():
            if total and total + n > size:
                episode, total = episode + 1, min(overlap, total)
            total += int(n)
            out.append(episode)
        state.update((int(total), int(episode)))
        yield pd.DataFrame({"session_id": key[0], "turn": rows["turn"], "episode": out})

    return turns.groupBy("session_id").applyInPandasWithState(run, "session_id long, turn long, episode long", "total long, episode long", "append", GroupStateTimeout.NoTimeout)


def every(calls: DataFrame, n: int = 50) -> DataFrame:
    """(key, id, count) of each key's every n-th call of a stream of (key, id): cooldown counters."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches), ignore_index=True).sort_values("id", ignore_index=True)
        rows["count"] = range(count + 1, count + len(rows) + 1)
        state.update((count + len(rows),))
        yield rows.loc[rows["count"] % n == 0, ["key", "id", "count"]]

    return calls.groupBy("key").applyInPandasWithState(run, "key string, id long, count long", "n long", "append", GroupStateTimeout.NoTimeout)


def slotted(stores: DataFrame, n_slots: int = 100, half_life: float = 6.0, boost: float = 0.5, inhibit: float = 0.2, reach: int = 2) -> DataFrame:
    """(agent, id, slot, linked) of a stream of (agent, id, us): ``ordered.slots`` with the state kept between batches.

    us: microseconds. Stores of a batch are taken in (us, id) order, batches in order. State: three numbers for each slot.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [(b["us"].to_numpy(np.int64), b["id"].to_numpy(np.int64)) for b in batches]  # two numbers a row, no more
        us, ids = (np.concatenate([p[n] for p in parts]) for n in (0, 1))
        parts.clear()
        order = np.lexsort((ids, us))
        us, ids = us[order], ids[order]
        del order
        if state.exists:
            slots = SlotState(*(np.array(v, t) for v, t in zip(json.loads(state.get[0]), (float, np.int64, np.int64), strict=True)))
        else:
            slots = SlotState.new(n_slots, int(us[0]))
        for at in range(0, len(us), 10_000):
            got = [slots.take(int(t), half_life, boost, inhibit, reach) for t in us[at : at + 10_000]]
            if at + 10_000 >= len(us):
                state.update((json.dumps([slots.level.tolist(), slots.seen.tolist(), slots.held.tolist()]),))
            yield pd.DataFrame({"agent": key[0], "id": ids[at : at + 10_000], "slot": [s for s, _ in got], "linked": [n for _, n in got]})

    return stores.groupBy("agent").applyInPandasWithState(run, "agent string, id long, slot long, linked long", "slots string", "append", GroupStateTimeout.NoTimeout)


def continued(stores: DataFrame, most: int = 10, hour_us: int = 3_600_000_000) -> DataFrame:
    """(session_id, id, continuity) of a stream of (session_id, id, us, directory, embedding).

    Continuity with the session's last ``most`` stores: 0.3 for their share in the same directory, 0.3 for their share
    within the hour before, 0.4 for the best cosine; 0 for the first store. It lowers the threshold of the write gate.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = json.loads(state.get[0]) if state.exists else []
        rows, out = pd.concat(list(batches), ignore_index=True).sort_values(["us", "id"], ignore_index=True), []
        for us, directory, vector in zip(rows["us"], rows["directory"], rows["embedding"], strict=True):
            v = np.asarray(vector if vector is not None else [], float)
            v = v / max(np.linalg.norm(v), 1e-12)
            near = [float(v @ np.array(r[2])) for r in recent if len(r[2]) == len(v)]
            n = max(len(recent), 1)
            score = 0.3 * sum(r[1] == directory for r in recent) / n + 0.3 * sum(us - r[0] < hour_us for r in recent) / n + 0.4 * max(near, default=0.0)
            out.append(round(min(1.0, score), 6))
            recent = [*recent, [int(us), directory, v.tolist()]][-most:]
        state.update((json.dumps(recent),))
        yield pd.DataFrame({"session_id": key[0], "id": rows["id"], "continuity": out})

    return stores.groupBy("session_id").applyInPandasWithState(run, "session_id long, id long, continuity double", "recent string", "append", GroupStateTimeout.NoTimeout)


def plastic(recalls: DataFrame, spike: float = 0.3, half_life: float = 6.0) -> DataFrame:
    """(id, us, plasticity) of a stream of (id, us): each recall of a memory adds ``spike`` to what is left after its half-life in
    hours, at most 1. Recalls of a batch are taken in time order, batches in order; equal times follow each other.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, seen = state.get if state.exists else (0.0, 0)
        rows, out = pd.concat(list(batches), ignore_index=True).sort_values("us", ignore_index=True), []
        for us in rows["us"]:
            level = min(1.0, level * 2.0 ** (-max(0, us - seen) / 3.6e9 / half_life) + spike)
            seen = int(us)
            out.append(round(level, 6))
        state.update((float(level), int(seen)))
        yield pd.DataFrame({"id": key[0], "us": rows["us"], "plasticity": out})

    return recalls.groupBy("id").applyInPandasWithState(run, "id long, us long, plasticity double", "level double, us long", "append", GroupStateTimeout.NoTimeout)
