"""Operators against truth tables, plain Python and their batch twins."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallgrid.functions import queries as Q
from recallgrid.functions import vectors as V
from recallgrid.operators import causal, fusion, graph, maintain, metrics, ordered, relate, replicas, rules, search
from recallgrid.sources import project
from recallgrid.streaming.rollup import rollup, rollup_stream
from recallgrid.streaming.stateful import limited


@pytest.mark.parametrize(
    ("condition", "parsed"),
    [("language == typescript", ("language", "==", "typescript")), ("content not_contains a > b", ("content", "not_contains", "a > b")), ("importance >= 0.7", ("importance", ">=", "0.7")), ("directory matches /p/*", ("directory", "matches", "/p/*"))],
)
def test_rule_parts(condition, parsed):
    assert rules.parse(condition) == parsed


def test_bad_rules():
    with pytest.raises(ValueError):
        rules.parse("nothing here")
    with pytest.raises(ValueError):
        rules.parse_action("explode:1")


def test_rules_by_scope_and_priority(spark):
    rows = spark.createDataFrame([(1, ["lang:go", "x"], 0.5, "A note"), (2, ["lang=py"], 0.9, "b"), (3, [], None, None)], "id long, tags array<string>, heat double, content string").withColumn("score", F.lit(1.0))
    test = lambda cond: [r.id for r in rows.where(rules.predicate(cond, rows.columns)).orderBy("id").collect()]
    assert test("lang == GO") == [1] and test("lang != go") == [2, 3] and test("heat < 0.6") == [1, 3]
    assert test("tag contains lang") == [1, 2] and test("content matches a*") == [1] and test("content not_contains note") == [2, 3]
    listed = [rules.Rule("heat > 0", "boost:1", scope="directory", value="/a", priority=1), rules.Rule("heat > 0", "filter", "hard", priority=5), rules.Rule("heat > 0", "boost:9", active=False), rules.Rule("heat > 0", "penalty:1", scope="file", value="*.py")]
    chosen = rules.applicable(listed, "/a/b")
    assert [r.action for r in chosen] == ["filter", "boost:1"] and len(rules.applicable(listed, "/z", "m.py")) == 2
    assert {r.id: r.score for r in rules.apply_rules(rows, chosen).collect()} == {1: 2.0, 2: 2.0}


@pytest.mark.parametrize(("a", "b", "order"), [({"x": 1}, {"x": 1}, "equal"), ({"x": 1}, {"x": 2}, "before"), ({"x": 1, "y": 1}, {"x": 1}, "after"), ({"x": 1}, {"y": 1}, "concurrent"), ({}, {"y": 1}, "before"), ({}, {}, "equal")])
def test_clocks(spark, a, b, order):
    row = spark.createDataFrame([(a, b)], "a map<string,int>, b map<string,int>").select(replicas.compare_clocks(F.col("a"), F.col("b")).alias("o"), replicas.merge_clocks(F.col("a"), F.col("b")).alias("m"), replicas.tick(F.col("a"), F.lit("x")).alias("t")).first()
    assert row.o == order and row.m == {k: max(a.get(k, 0), b.get(k, 0)) for k in {*a, *b}} and row.t["x"] == a.get("x", 0) + 1


def test_conflicts(spark):
    df = spark.createDataFrame([("one\n--- [Agent: b] ---\ntwo long",), ("plain",)], "c string")
    pick = lambda how: [r.v for r in df.select(replicas.resolve(F.col("c"), how).alias("v")).collect()]
    assert pick("latest") == ["two long", "plain"] and pick("longest") == ["two long", "plain"] and pick("merge") == ["one\ntwo long", "plain"] and pick("agent:b") == ["two long", "plain"] and pick("agent:z") == ["one", "plain"]


def test_softmax_and_sparsemax(spark):
    rng = random.Random(4)
    z = [rng.uniform(-2, 2) for _ in range(30)]
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate(z)], "g int, id int, z double")
    soft = {r.id: r.w for r in V.softmax(df, ["g"], "z", 3.0, "w").collect()}
    total = sum(math.exp(3 * x) for x in z)
    assert all(math.isclose(soft[i], math.exp(3 * x) / total) for i, x in enumerate(z))
    sparse = {r.id: r.w for r in V.sparsemax(df, ["g"], "z", "id", "w").collect()}
    assert math.isclose(sum(sparse.values()), 1) and 0 < sum(w > 0 for w in sparse.values()) < 30
    support = [z[i] for i, w in sparse.items() if w > 0]
    tau = (sum(support) - 1) / len(support)
    assert all(math.isclose(w, max(z[i] - tau, 0), abs_tol=1e-9) for i, w in sparse.items())


def test_gating_truth_table(spark):
    rows = [(0, 1, "vector", 0.9), (0, 2, "vector", 0.5), (0, 1, "fts", 3.0), (0, 1, "ppr", 0.2), (0, 2, "ppr", 0.2), (0, 1, "hopfield", 0.05)]
    got = {r.signal: r.confidence for r in fusion.confidence(spark.createDataFrame(rows, "query_id int, id int, signal string, score double")).collect()}
    assert got == pytest.approx({"vector": 1.0, "fts": 0.2, "ppr": 0.0, "hopfield": 0.05})
    fused = fusion.convex(spark.createDataFrame(rows[:0], "query_id int, id int, signal string, score double"))
    assert fused.count() == 0


def test_page_rank_against_numpy(spark):
    edges = [(1, 2, 1.0), (2, 3, 2.0), (3, 1, 0.5), (3, 4, 1.0), (5, 6, 1.0)]
    got = {r.id: r["rank"] for r in graph.page_rank(spark.createDataFrame(edges, "src long, dst long, weight double"), spark.createDataFrame([(1,), (9,)], "id long"), rounds=8).collect()}
    ids = [1, 2, 3, 4, 5, 6, 9]
    w = np.zeros((7, 7))
    for a, b, x in edges:
        w[ids.index(a), ids.index(b)] = w[ids.index(b), ids.index(a)] = x
    out, seed = w.sum(1), np.array([0.5, 0, 0, 0, 0, 0, 0.5])
    rank = seed.copy()
    for _ in range(8):
        flow = sum(rank[i] * w[i] / out[i] for i in range(7) if out[i])
        rank = 0.85 * (flow + rank[out == 0].sum() * seed) + 0.15 * seed
    assert [got[i] for i in ids] == pytest.approx(rank.tolist())


def test_components_and_communities(spark):
    e = spark.createDataFrame([(i, i + 1, 1.0) for i in range(20)] + [(50, 51, 1.0)], "src long, dst long, weight double")
    got = {r.id: r.component for r in graph.components(e).collect()}
    assert set(got.values()) == {0, 50} and got[20] == 0
    two = [(a, b, 5.0) for a, b in ((1, 2), (2, 3), (1, 3), (11, 12), (12, 13), (11, 13))] + [(3, 11, 0.1)]
    com = {r.id: r.community for r in graph.communities(spark.createDataFrame(two, "src long, dst long, weight double")).collect()}
    assert len({com[i] for i in (1, 2, 3)}) == 1 and com[1] != com[12]


def test_similar_pairs_in_blocks(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 8))
    v[7] = v[3] + 0.01 * rng.normal(size=8)
    df = spark.createDataFrame([(i, "a" if i % 2 else "b", x.tolist()) for i, x in enumerate(v)], "id long, directory string, embedding array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if i % 2 == j % 2 and unit[i] @ unit[j] >= 0.6}
    for block in (1024, 9):
        assert {(r.a, r.b) for r in relate.similar_pairs(df, 0.6, block=block).collect()} == want and (3, 7) in want


def test_mmr_prefers_variety(spark):
    pool = spark.createDataFrame([(0, 1, 1.0, [1.0, 0.0]), (0, 2, 0.99, [1.0, 0.01]), (0, 3, 0.7, [0.0, 1.0])], "query_id long, id long, score double, embedding array<double>")
    assert [r.id for r in search.mmr(pool, 2).orderBy("position").collect()] == [1, 3]


def test_pc_finds_a_collider(spark):
    rng = np.random.default_rng(42)
    x, y = rng.normal(size=800), rng.normal(size=800)
    z = 0.6 * x + 0.6 * y + 0.2 * rng.normal(size=800)
    rows = spark.createDataFrame([tuple(map(float, r)) for r in zip(x, y, z, strict=True)], "x double, y double, z double")
    directed, plain = causal.pc(rows, ["x", "y", "z"])
    assert directed == {("x", "z"), ("y", "z")} and not plain
    assert causal.p_value(0.0, 50, 0) == pytest.approx(1.0) and causal.p_value(0.5, 30, 0) == pytest.approx(0.00489, abs=1e-4)


def test_episodes_and_slots(spark):
    turns = spark.createDataFrame([(s, t, "x" * n) for s in (1, 2) for t, n in enumerate((60, 30, 50, 10, 200, 5))], "s long, t long, text string")
    got = [r.episode for r in ordered.episodes(turns, "s", "t", "text", 100, 20).where("s = 1").orderBy("t").collect()]
    assert got == [0, 0, 1, 1, 2, 3]
    stores = spark.createDataFrame([("a", i, f"2024-01-01 00:0{i}:00") for i in range(5)], "agent string, id long, ts string")
    slots = [(r.slot, r.linked) for r in ordered.slots(stores, 10).orderBy("id").collect()]
    assert slots == [(0, i) for i in range(5)]


def test_chunks_and_hypervectors(spark):
    rows = [(0, 1, 1, ["a", "b"], "2024-01-01 00:00:00"), (0, 2, 2, ["a", "b", "c"], "2024-01-05 00:00:00"), (0, 3, 3, ["z"], "2024-01-01 01:00:00"), (0, 4, 4, ["q"], "2024-02-01 00:00:00")]
    df = spark.createDataFrame(rows, "query_id long, id long, rank long, names array<string>, t string").withColumn("created_at", F.to_timestamp("t"))
    got = {r.id: r.chunk for r in ordered.chunks(df).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 3}
    one = ordered.hypervector("/a", ["t"], ["auth.py"], "episodic", 4096).astype(int)
    ask = ordered.hypervector(None, [], ["auth.py"], None, 4096).astype(int)
    other = ordered.hypervector("/b", ["u"], ["main.py"], "semantic", 4096).astype(int)
    assert one @ ask / 4096 > 0.2 > abs(other @ ask / 4096)


def test_completion_moves_to_the_stored_pattern(spark):
    x = np.eye(4)
    df = spark.createDataFrame([(i, 1.0, v.tolist()) for i, v in enumerate(x)], "id long, heat double, embedding array<double>")
    assert np.argmax(ordered.complete(df, [0.9, 0.3, 0.1, 0.0])) == 0


def test_compress_and_decompress(spark):
    base = "First sentence. We decided to go. Third here. Fourth one. Last line."
    rows = [(i, base, ["t"], 0.1, 0.1, 0.1, 0, "episodic", False, f"2024-01-{d:02d} 00:00:00") for i, d in ((1, 30), (2, 20))] + [(3, base, ["t"], 0.1, 0.1, 0.1, 0, "episodic", False, "2023-01-01 00:00:00")]
    m = spark.createDataFrame(rows, "id long, content string, tags array<string>, importance double, surprise double, confidence double, access_count int, store_type string, is_protected boolean, t string").withColumn("created_at", F.to_timestamp("t"))
    short, archive = maintain.compress(m, F.lit("2024-02-01").cast("timestamp"))
    got = {r.id: r.content for r in short.collect()}
    assert got[1] == base and got[2].startswith("First") and "decided" in got[2] and len(got[2]) < len(base) and got[3].startswith("t | ")
    assert {r.id: r.content for r in maintain.decompress(short, archive).collect()} == {1: base, 2: base, 3: base}


def test_metrics():
    mean, low, high = metrics.paired_bootstrap([1.0, 0.5, 0.8] * 10, [0.5, 0.5, 0.2] * 10)
    assert low < mean < high and mean == pytest.approx(1.1 / 3) and metrics.sign_test([1, 1, 1, 1], [0, 0, 0, 0]) == 0.125 and metrics.sign_test([1], [1]) == 1.0


def test_query_kinds(spark):
    df = spark.createDataFrame([("when did it break",), ("could it be related",), ("who is it",), ("schema of it all",), ("impact on sales",), ("hi",)], "q string")
    assert [r.k for r in df.select(Q.kind(F.col("q")).alias("k")).collect()] == ["temporal", "open_domain", "factoid", "code", "relational", "keyword"]


def test_project_source(spark, tmp_path):
    for name, text in {"README.md": "# hello", "src/main.py": "print()", "src/util.py": "x = 1", "pyproject.toml": "[project]", "node_modules/a.js": "no", "logo.png": "no", "src/data.bin2": "a\0b"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    found = project.files(spark, str(tmp_path)).cache()
    assert {r.name: r.kind for r in found.collect()} == {"README.md": "documentation", "main.py": "entry_point", "util.py": "component", "pyproject.toml": "config", "data.bin2": "component"}
    assert found.where("name = 'data.bin2'").first().text is None
    seeds = {r.kind: r.heat for r in project.seed(found, str(tmp_path)).collect()}
    assert seeds == {"overview": 0.9, "documentation": 0.85, "entry_point": 0.75, "config": 0.7, "component": 0.5}
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, hash string")
    assert {r.path: r.state for r in project.changed(old, new).collect()} == {"b": "changed", "c": "gone", "d": "new"}


def drain(query):
    query.processAllAvailable()
    query.stop()


def test_streamed_rollup_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    events.repartitionByRange(4, "ts").write.parquet(str(tmp_path / "in"))
    last = events.agg(F.max("ts").alias("m")).first().m
    spark.createDataFrame([(0, "end")], "user_id long, event_type string").select("*", F.lit(last).cast("timestamp") + F.expr("interval 9 days")).toDF("user_id", "event_type", "ts").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    drain(rollup_stream(stream, "user_id", late="40 days", least=2).writeStream.format("memory").queryName("rolled").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start())
    batch = {tuple(r) for r in rollup(events, "user_id", least=2).collect()}
    assert {tuple(r) for r in spark.table("rolled").collect()} <= batch and batch
    again = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    drain(rollup(again, "user_id", least=2).writeStream.format("memory").queryName("whole").option("checkpointLocation", str(tmp_path / "c2")).outputMode("complete").start())
    assert {tuple(r) for r in spark.table("whole").collect()} == batch


def test_limited_triggers(spark, tmp_path):
    spark.createDataFrame([(t, i) for t in (1, 2) for i in range(4 * t)], "trigger_id long, id long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("trigger_id long, id long").parquet(str(tmp_path / "in"))
    drain(limited(stream).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start())
    got = {}
    for r in spark.table("limited").collect():
        got.setdefault(r.trigger_id, []).append((r["count"], r.id))
    assert sorted(got[1]) == [(i + 1, i) for i in range(4)] and sorted(got[2]) == [(i + 1, i) for i in range(5)]


def test_outranked_rows_are_those_that_pairs_drop(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "a" if i % 3 else "b", x.tolist(), None if i == 11 else float(i * 7 % 5)) for i, x in enumerate(rng.normal(size=(90, 6)))]
    df = spark.createDataFrame(rows, "id long, directory string, embedding array<double>, heat double")
    heat = {r[0]: r[3] for r in rows}
    pairs = [(r.a, r.b) for r in relate.similar_pairs(df, 0.4).collect()]
    want = {b if None not in (heat[a], heat[b]) and heat[a] >= heat[b] else a for a, b in pairs}
    for block, most in ((1024, 16), (7, 16), (7, 3)):
        assert sorted(r.id for r in relate.outranked(df, 0.4, block=block, most=most).collect()) == sorted(want)
        assert sorted((r.a, r.b) for r in relate.similar_pairs(df, 0.4, block=block, most=most).collect()) == sorted(pairs)


def test_rows_travel_to_a_bounded_number_of_blocks(spark):
    df = spark.range(400).select("id", F.lit("a").alias("directory"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))
    counts = [relate.block_count(df, "directory", 10, most, "n").first().n for most in (16, 100)]
    assert counts == [16, 40]


def test_time_maxima_are_those_of_all_neighbours(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, *range(-4000, 9000, 300), *range(100, 140)]), rng.random() < 0.4, rng.choice([0.1, 0.5, 0.9, None])) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, s long, strong boolean, heat double").withColumn("created_at", F.timestamp_seconds("s"))
    for minutes in (1, 30):
        near = lambda a, b, m=minutes: a[1] is not None and b[1] is not None and abs(a[1] - b[1]) <= 60 * m and a[0] != b[0]
        want = {b[0]: max((a[3] for a in rows if a[2] and a[3] is not None and near(a, b)), default=None) for b in rows if b[1] is not None}
        assert {r.id: r.best for r in relate.time_maxima(df, F.col("strong"), "heat", minutes).collect()} == want


def test_words_are_counted_within_a_row(spark):
    from recallgrid.functions import extract as X

    df = spark.createDataFrame([(1, "b a B c a b"), (2, ""), (3, None), (4, "x " * 500)], "id long, content string")
    got = {r.id: r.c for r in df.select("id", X.counted(X.tokens(F.col("content"))).alias("c")).collect()}
    assert [tuple(x) for x in got[1]] == [("a", 2), ("b", 3), ("c", 1)] and got[2] == [] and not got[3] and [tuple(x) for x in got[4]] == [("x", 500)]
    rows = sorted(map(tuple, search.postings(df).select("id", "term", "tf", "dl").collect()))
    assert rows == [(1, "a", 2, 6), (1, "b", 3, 6), (1, "c", 1, 6), (4, "x", 500, 500)]
    pairs = spark.createDataFrame([(1, "a a b", "A b b c"), (2, "", ""), (3, None, "x"), (4, "x y", "z")], "id long, p string, t string")
    f1 = metrics.token_f1(pairs, "p", "t")
    assert {r.id: r.f1 for r in f1.collect()} == {1: round(4 / 7, 6), 2: 0.0, 3: 0.0, 4: 0.0}
    for plan in (f1, search.postings(df)):
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
