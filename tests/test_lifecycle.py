"""Stored tables, a session's life, gaps, graph iterations to their end, recall, and streams, against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallgrid.engine import Engine
from recallgrid.operators import graph, lifecycle, recall, relate, rules, search, spectral, store
from recallgrid.sources.shared import discard, stored


def now():
    return F.lit("2024-02-01").cast("timestamp")


@pytest.fixture
def tables(spark, tmp_path):
    return store.Store(spark, str(tmp_path / "tables"))


def test_store_versions_and_defaults(spark, tables):
    assert tables.version("edges") == 0 and tables.read("edges").count() == 0
    tables.insert("edges", spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long"))
    tables.upsert("edges", spark.createDataFrame([(2, 3, 7.0), (9, 9, 1.5)], "src long, dst long, weight double"), ["src", "dst"])
    tables.delete("edges", spark.createDataFrame([(1,)], "src long"), ["src"])
    assert tables.version("edges") == 3
    assert sorted((r.src, r.dst, r.weight) for r in tables.read("edges").collect()) == [(2, 3, 7.0), (9, 9, 1.5)]
    for _ in range(4):
        tables.insert("edges", spark.createDataFrame([], "src long, dst long"))
    assert tables.read("edges").count() == 2


def test_an_unfinished_version_is_not_read(spark, tables, tmp_path):
    tables.insert("cursors", spark.createDataFrame([("a", 1)], "name string, at long"))
    (tmp_path / "tables" / "cursors" / "v2").mkdir()
    assert tables.version("cursors") == 1 and tables.read("cursors").first().at == 1


def test_engine_inserts_recalls_and_forgets(spark, tmp_path):
    rows = spark.createDataFrame([(1, "the Parser fails with ValueError", "/a", ["x"], [1.0, 0.0], "h1"), (2, "tea time", "/b", [], [0.0, 1.0], "h2"), (3, None, "/b", None, None, None)], "id long, content string, directory string, tags array<string>, embedding array<double>, file_hash string")
    with Engine(spark, str(tmp_path / "e")) as e:
        e.insert(rows)
        assert e.recall("Parser ValueError", [1.0, 0.0], 1).first().id == 1
        e.validate(spark.createDataFrame([("/a", "h9"), ("/c", "z")], "path string, hash string"))
        assert [r.is_stale for r in e.memories().orderBy("id").collect()] == [True, False, False]
        e.forget(spark.createDataFrame([(1,)], "id long"))
        assert {t: e.store.read(t).where("id = 1").count() for t in ("memories", "vectors", "postings")} == {"memories": 0, "vectors": 0, "postings": 0}
        assert e.store.read("processes").count() == 4


def test_cursors_never_move_back(spark):
    c = spark.createDataFrame([("x", 5), ("y", 1)], "name string, at long")
    rows = spark.createDataFrame([(3,), (4,)], "id long")
    assert dict(store.advanced(c, "x", rows).collect()) == {"x": 5, "y": 1}
    assert dict(store.advanced(c, "y", rows).collect()) == {"x": 5, "y": 4}
    assert dict(store.advanced(c, "y", rows.limit(0)).collect()) == {"x": 5, "y": 1}
    assert store.since(rows, F.lit(None).cast("long")).count() == 2 and store.since(rows, F.lit(3)).count() == 1


def test_rule_table_checks_and_retires(spark):
    t = spark.createDataFrame([], store.schema_of("rules"))
    for bad in (rules.Rule("heat > 0", "boost:1", "odd"), rules.Rule("heat > 0", "boost:1", "soft", "galaxy"), rules.Rule("heat", "boost:1"), rules.Rule("heat > 0", "explode"), rules.Rule("heat > 0", "boost:1", "hard")):
        with pytest.raises(ValueError):
            rules.added(t, bad)
    t = rules.added(rules.added(t, rules.Rule("heat > 0", "filter", "hard")), rules.Rule("heat > 1", "boost:1"))
    assert [r.id for r in rules.listed(rules.retired(t, 1)).collect()] == [2] and t.count() == 2


def walk(edges, seeds, rounds=500):
    weight = {}
    for a, b, w in edges:
        for x, y in ((a, b), (b, a)):
            weight[x, y] = max(weight.get((x, y), 0), w)
    nodes = sorted({x for e in weight for x in e} | set(seeds))
    out = {x: sum(w for (a, _), w in weight.items() if a == x) for x in nodes}
    seed = {x: (x in seeds) / len(seeds) for x in nodes}
    rank = dict(seed)
    for _ in range(rounds):
        lost = sum(rank[x] for x in nodes if not out[x])
        got = {x: 0.0 for x in nodes}
        for (a, b), w in weight.items():
            got[b] += rank[a] * w / out[a]
        rank = {x: 0.85 * (got[x] + lost * seed[x]) + 0.15 * seed[x] for x in nodes}
    return rank


@pytest.mark.parametrize("local", [10**6, 0])
def test_page_rank_converges_either_way(spark, local):
    rng = random.Random(2)
    edges = [(rng.randrange(12), rng.randrange(12, 20), float(rng.randint(1, 5))) for _ in range(40)]
    want = walk(edges, [1, 99])
    got = graph.page_rank(spark.createDataFrame(edges, "src long, dst long, weight double"), spark.createDataFrame([(1,), (99,)], "id long"), tolerance=1e-6, local_edges=local, rounds=100 if local else 60).collect()
    assert {r.id for r in got} == set(want) and all(abs(r["rank"] - want[r.id]) < 1e-4 for r in got)


def test_page_rank_without_seeds_or_edges(spark):
    none = spark.createDataFrame([], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("a",)], "id string")
    assert [tuple(r) for r in graph.page_rank(none, seeds).collect()] == [("a", 1.0)]
    edge = spark.createDataFrame([("a", "b", 1.0)], "src string, dst string, weight double")
    assert {r["rank"] for r in graph.page_rank(edge, seeds.limit(0)).collect()} == {0.0}


def test_components_of_a_long_chain(spark):
    order = list(range(400))
    random.Random(1).shuffle(order)
    edges = [(a, b, 1.0) for a, b in zip(order, order[1:], strict=False)] + [(1000, 1001, 1.0)]
    got = dict(graph.components(spark.createDataFrame(edges, "src long, dst long, weight double")).collect())
    assert {got[i] for i in range(400)} == {0} and got[1001] == 1000


def test_communities_end(spark):
    edges = [(a, b, 5.0) for g in (range(5), range(10, 15)) for a in g for b in g if a < b] + [(4, 10, 0.5)]
    got = dict(graph.communities(spark.createDataFrame(edges, "src long, dst long, weight double")).collect())
    assert len({got[i] for i in range(5)}) == 1 and len({got[i] for i in range(10, 15)}) == 1 and got[0] != got[10]


def test_successor_series_matches_the_inverse(spark):
    rng = np.random.default_rng(1)
    t = rng.random((5, 5))
    t /= t.sum(axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, j, float(t[i, j])) for i in range(5) for j in range(5)], "src long, dst long, p double")
    series = sum(np.linalg.matrix_power(0.5 * t, k) for k in range(9))
    got = {(r.src, r.dst): r.m for r in graph.successors(rows, 0.5, 8).collect()}
    assert all(abs(got[i, j] - series[i, j]) < 1e-9 for i in range(5) for j in range(5))
    after = {r.id: r.m for r in graph.successors_from(rows, spark.createDataFrame([(2,)], "id long"), 0.5, 8).collect()}
    assert set(after) == {0, 1, 3, 4} and all(abs(after[j] - series[2, j]) < 1e-9 for j in after)
    exact = {(r.src, r.dst): r.m for r in spectral.successor_table(rows, 0.5).collect()}
    assert abs(exact[1, 3] - np.linalg.inv(np.eye(5) - 0.5 * t)[1, 3]) < 1e-6
    assert spectral.successor_table(rows, 0.5, most=2).count() == 25


def test_nearest_batch_in_blocks_and_chunks(spark):
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=(60, 4)), 2)
    m = spark.createDataFrame([(i, 0.5 if i % 7 else 0.0, x.tolist() if i != 33 else None) for i, x in enumerate(v)], "id long, heat double, embedding array<double>")
    asked = m.where("id % 5 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    want = {}
    for qi in range(0, 60, 5):
        near = sorted((-round(1 / (1 + float(np.sqrt(((v[i] - v[qi]) ** 2).sum()))), 6), i) for i in range(60) if i % 7 and i != 33)
        want |= {(qi, r + 1): i for r, (_, i) in enumerate(near[:4])}
    for block, chunk in ((512, 65536), (3, 7)):
        got = {(r.query_id, r["rank"]): r.id for r in search.nearest_batch(m, asked, 4, block=block, chunk=chunk).collect()}
        assert got == want
    assert search.nearest_batch(m.limit(0), asked, 4).count() == 0 and search.nearest_batch(m, asked.limit(0), 4).count() == 0


def test_similar_pairs_skip_rows_without_vectors(spark):
    rows = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [1.0, 0.1]), (3, "a", None)], "id long, directory string, embedding array<double>")
    assert [(r.a, r.b) for r in relate.similar_pairs(rows, 0.9).collect()] == [(1, 2)]


def test_mentions_of_long_texts(spark):
    long = " ".join(f"word{i}" for i in range(20_000)) + " see user_profile.py now"
    rows = spark.createDataFrame([(1, long), (2, "User_Profile.py"), (3, None), (4, "xuser_profile.py")], "id long, content string")
    names = spark.createDataFrame([("user_profile.py",), ("word19999",), ("word",)], "name string")
    assert sorted((r.id, r.name) for r in relate.mentions(rows, names).collect()) == [(1, "user_profile.py"), (1, "word19999"), (2, "user_profile.py")]


def test_phrase_first_then_substring(spark):
    m = spark.createDataFrame([(1, 0.5, "Big Red Fox"), (2, 0.5, "the redfox"), (3, 0.0, "red fox")], "id long, heat double, content string")
    ids = lambda name: sorted(r.id for r in search.naming(m, name).collect())
    assert ids("red fox") == [1] and ids("edfo") == [2] and ids("nothing") == []


def test_passage_clusters(spark):
    texts = ["red fox runs", "red fox sleeps", "red fox eats", "red fox sits", "blue sky", "blue sky day", None]
    pool = spark.createDataFrame([(1, i, t, 1.0 - i / 10) for i, t in enumerate(texts)], "query_id long, id long, content string, score double")
    got = {r.id: r.cluster for r in search.passage_clusters(pool, ("the",)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4, 6: 6}


def test_upserted_edges(spark):
    e = spark.createDataFrame([("a", "b", "x", 2.0), ("b", "a", "y", 5.0), ("c", "d", "x", 1.0)], "src string, dst string, kind string, weight double")
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("q", "p")], "src string, dst string")
    got = sorted(map(tuple, lifecycle.upserted_edges(e, pairs, "new").collect()))
    assert got == [("a", "b", "x", 2.0), ("b", "a", "y", 7.0), ("c", "d", "x", 1.0), ("p", "q", "new", 1.0)]


def test_gaps_of_all_kinds(spark):
    m = spark.createDataFrame([(1, "/a", 0.1, 0.9), (2, "/a", 0.2, 0.4), (3, "/b", 0.9, 0.9)], "id long, directory string, heat double, confidence double")
    entities = spark.createDataFrame([("x", "error"), ("y", "file"), ("z", "error")], "name string, kind string")
    edges = spark.createDataFrame([("z", "s", "resolved_by"), ("z", "t", "co_occurrence")], "src string, dst string, kind string")
    mentions = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (2, "y"), (3, "z"), (3, "x")], "id long, name string")
    got = sorted((r.kind, r.subject, r.severity) for r in lifecycle.gaps(m, entities, edges, mentions).collect())
    assert got == [("isolated_entity", "x", 0.6), ("isolated_entity", "y", 0.6), ("low_confidence", "/a", 0.4), ("missing_connection", "x + y", 0.4), ("one_sided_knowledge", "x", 0.5), ("stale_region", "/a", 0.5)]


def test_triggers_in_blocks(spark):
    x = spark.createDataFrame([(i, f"/d{i % 5}", "say hello" if i % 2 else "bye", []) for i in range(20)], "id long, directory string, content string, entities array<string>").withColumn("ts", now())
    t = spark.createDataFrame([(n, "directory_match", "x", f"/d{n % 7}") for n in range(9)] + [(50, "keyword_match", "hello", "")], "trigger_id int, kind string, condition string, target string")
    whole = sorted(map(tuple, relate.fired(x, t).collect()))
    assert whole and whole == sorted(map(tuple, relate.fired(x, t, block=2).collect())) and relate.fired(x, t.limit(0)).count() == 0


def test_hypervector_codec():
    from recallgrid.operators import ordered

    v = ordered.hypervector("/a", ["x"], ["n"], None, 1000)
    assert np.array_equal(ordered.from_bytes(ordered.to_bytes(v), 1000), v)
    assert np.array_equal(ordered.permuted(ordered.permuted(v, 3), -3), v) and abs(float(ordered.permuted(v).astype(int) @ v)) < 200


def test_drain_adds_a_checkpoint_only_where_the_active_one_lags(spark):
    rows = [(1, "s", "/a", "t", 3, True, 1), (2, "s", "/a", "t", 4, False, 2), (3, "u", "/a", "t", 1, True, 1), (4, "u", "/a", "t", 5, False, 1), (5, "v", "/a", "t", 2, False, 1)]
    c = spark.createDataFrame(rows, "id long, session string, directory string, task string, epoch long, active boolean, at int").withColumn("created_at", F.timestamp_seconds("at")).drop("at")
    got = {r.id: (r.session, r.epoch, r.active) for r in lifecycle.drained(c, "/z", now()).collect()}
    assert got == {1: ("s", 3, True), 2: ("s", 4, False), 3: ("u", 1, True), 4: ("u", 5, False), 5: ("v", 2, False), 6: ("s", 5, True), 7: ("u", 6, True), 8: ("v", 3, True)}


def test_idle_sessions(spark):
    rows = spark.createDataFrame([(1, 100, None), (2, 400, None), (3, 700, 2), (4, 700, 9), (5, 700, None)], "session_id long, idle int, slept_hours int")
    last = rows.select("session_id", F.timestamp_seconds(F.unix_seconds(now()) - F.col("idle")).alias("at"), F.timestamp_seconds(F.unix_seconds(now()) - F.col("slept_hours") * 3600).alias("slept"))
    assert [tuple(r)[2:] for r in lifecycle.idle_jobs(last, now()).orderBy("session_id").collect()] == [(False, False), (True, False), (True, False), (True, True), (True, True)]


def test_recall_ranks_by_text_vector_and_names(spark):
    rows = [(1, "the parser raises ValueError in main.py", [1.0, 0.0], 0.9), (2, "def load_data fixed main.py", [0.9, 0.1], 0.8), (3, "tea and cake", [0.0, 1.0], 0.9), (4, "the parser raises ValueError in main.py", [1.0, 0.0], 0.01), (5, "in march we met, session 3", None, 0.5)]
    m = spark.createDataFrame(rows, "id long, content string, embedding array<double>, heat double").withColumns({"label": F.lit(1), "directory": F.lit("/a"), "tags": F.array(F.lit("t")), "store_type": F.lit("episodic"), "created_at": now()})
    visits = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (1, 3, 2), (1, 4, 5)], "key long, ts long, id long")
    got = [r.id for r in recall.recall(m, recall.mentioned(m), "Why ValueError in main.py? March session 3", [1.0, 0.0], 3, visits=visits).collect()]
    assert got[0] == 1 and 4 not in got
    assert recall.recall(m.limit(0), recall.mentioned(m.limit(0)), "Why?", [1.0, 0.0], 3).count() == 0
    assert [r.id for r in recall.temporal(m, "session 3 in february", 5).orderBy(F.desc("score"), "id").collect()][0] == 5


def test_discard_deletes_stored_tables(spark, tmp_path):
    df = stored(spark.range(3), "x")
    assert df.count() == 3
    discard(df, spark.range(1))
    with pytest.raises(Exception, match="does not exist|FILE_NOT_EXIST|PATH_NOT_FOUND|FileNotFound"):
        spark.read.parquet(df._stored_at).count()


def test_slot_stream_gives_its_rows_in_bounded_frames():
    from types import SimpleNamespace

    import pandas as pd

    from recallgrid.streaming.stateful import slotted

    made = {}
    slotted(SimpleNamespace(groupBy=lambda k: SimpleNamespace(applyInPandasWithState=lambda run, *a: made.update(run=run))), 5)
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"agent": "a", "id": np.arange(23_000), "us": rng.integers(0, 10**12, 23_000)})

    def run(parts):
        state = SimpleNamespace(exists=False, update=lambda v: state.__dict__.update(exists=True, get=v))
        return [f for p in parts for f in made["run"](("a",), iter([p.iloc[:9000], p.iloc[9000:]]), state)], state.get

    frames, end = run([rows])
    assert max(map(len, frames)) <= 10_000 and sum(map(len, frames)) == len(rows)
    ordered = rows.sort_values(["us", "id"])
    halves, end_too = run([ordered.iloc[:12_000], ordered.iloc[12_000:]])
    assert pd.concat(frames, ignore_index=True).equals(pd.concat(halves, ignore_index=True)) and end == end_too
