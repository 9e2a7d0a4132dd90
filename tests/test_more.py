"""Ingest, rerankers, sources, keyed streams and spectral coordinates."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallgrid.functions import expansions as E
from recallgrid.operators import graph, ingest, ordered, relate, rerank, spectral
from recallgrid.sources import benchmarks, project
from recallgrid.streaming.stateful import every, rotated



def now():
    return F.lit("2024-02-01").cast("timestamp")


def test_nearest_known_in_blocks(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(40, 6))
    rows = [(i, "ab"[i % 2], x.tolist()) for i, x in enumerate(v)]
    schema = "id long, directory string, embedding array<double>"
    new, known = spark.createDataFrame(rows[:12], schema), spark.createDataFrame(rows[12:], schema)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {i: max(range(12 + (i % 2), 40, 2), key=lambda j: unit[i] @ unit[j]) for i in range(12)}
    for block in (1024, 5):
        assert {r.id: r.near_id for r in ingest.nearest_known(new, known, block).collect()} == want


def near_in_time(rows, width):
    """Pairs by their definition; of a second only those whose ids are both known are in an order."""
    at = [(i, t) for i, t in rows if t is not None]
    return sorted(((i, j, u - t) for i, t in at for j, u in at if 0 < u - t <= width or u == t and None not in (i, j) and i < j), key=repr)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_time_neighbours(spark, kind, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(int(i), int(t)) for i, t in enumerate(rng.integers(-400, 400, 90))] + [(200 + i, 60) for i in range(30)]  # before 1970 too; many of one second
    rows += [(7, 10), (7, 10), (7, 30), (500, None), (None, 60), (None, 60), (None, 61), (900, 5000), (901, 5060), (902, 5061)]
    rows = [(str(i) if kind == "string" and i is not None else i, t) for i, t in rows]
    df = spark.createDataFrame(rows, f"id {kind}, t long").select("id", F.timestamp_seconds("t").alias("created_at"))
    want = near_in_time(rows, 60)
    monkeypatch.setattr(relate, "PAIRS", 50)  # many batches
    for block, most in ((4096, 16), (7, 16), (7, 3)):
        got = relate.time_neighbours(df, 1, block=block, most=most)
        assert got.dtypes == [("a", df.dtypes[0][1]), ("b", df.dtypes[0][1]), ("seconds", "bigint")]
        assert sorted(map(tuple, got.collect()), key=repr) == want
    assert relate.time_neighbours(df.limit(0), 1).count() == 0 and relate.time_neighbours(df.where("id = '500'"), 1).count() == 0


def test_time_neighbours_are_dealt_out(spark):
    at = lambda rows: rows.withColumn("created_at", F.timestamp_seconds("t"))
    tasks = lambda pairs: pairs.select(F.spark_partition_id()).distinct().count()
    spaced = at(spark.range(0, 400).withColumn("t", F.col("id") * 120))  # many buckets of few rows
    assert tasks(relate.time_neighbours(spaced, 30)) > 1
    crowded = at(spark.range(0, 300).withColumn("t", F.col("id") % 3))  # one bucket
    assert tasks(relate.time_neighbours(crowded, 30, block=20)) > 1 and relate.time_neighbours(crowded, 30, block=20).count() == 300 * 299 // 2


def test_time_neighbours_read_the_memories_once(spark):
    from recallgrid.plans.memory_queries import QUERIES

    df = QUERIES["c9_time_window"](spark, "/root/testdata/sf0.001")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the plan shows what is taken again
    try:
        plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("events.parquet") == 1


def test_remember(spark):
    known = relate.embed(spark.createDataFrame([(1, "the parser reads tokens in order and then builds a tree of nodes", "/a")], "id long, content string, directory string"))
    batch = spark.createDataFrame(
        [(2, "the parser reads tokens in order and then builds a tree of nodes now", "/a", ["x"]), (3, "completely different words here", "/b", []), (4, "the parser reads tokens in order and then builds a tree of nodes", "/a", []), (5, None, "/a", None)],
        "id long, content string, directory string, tags array<string>",
    )
    got = {r.id: r for r in ingest.remember(batch, known, now()).collect()}
    assert (got[2].action, got[2].near_id) in {("merge", 1), ("skip", None)} and got[3].action == "create" and got[3].near_id is None
    assert got[4].action == "skip" and set(got) == {2, 3, 4, 5}
    loud = batch.where("id = 4").withColumn("tags", F.array(F.lit("important")))
    assert ingest.remember(loud, known, now()).first().action == "merge"


def test_remember_stream_sees_earlier_batches(spark, tmp_path):
    schema = "id long, content string, directory string, tags array<string>"
    store = str(tmp_path / "store")
    relate.embed(spark.createDataFrame([(0, "seed row of the store", "/z")], "id long, content string, directory string")).write.parquet(f"{store}/batch=-1")
    for n in (1, 2):
        spark.createDataFrame([(n, "alpha beta gamma delta epsilon zeta eta theta iota", "/a", ["x"])], schema).write.mode("append").parquet(str(tmp_path / "in"))
    q = ingest.remember_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), store, str(tmp_path / "c"), now()).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema("id long, action string, batch long").parquet(store).where("batch >= 0").collect()
    assert len(rows) == 1 and rows[0].action == "create"  # the second says nothing new and stays out


def test_rerankers(spark):
    words = " ".join(f"w{i}" for i in range(25))
    pool = spark.createDataFrame([(0, 1, "find apples", f"apples find {words}", 0.2), (0, 2, "find apples", f"nothing {words}", 0.9), (0, 3, "find apples", "find apples", 0.2)], "query_id long, id long, query string, content string, score double")
    got = {r.id: r.score for r in rerank.cross_rerank(pool, 3).collect()}
    assert got == {1: 0.68, 2: 0.36, 3: 0.38}
    assert {r.id: r.score for r in rerank.entail_rerank(pool, 2, lambda q, t: [0.0] * len(q)).collect()} == {2: 0.63, 1: 0.14}
    pairs = spark.createDataFrame([(0, 1, 0.6), (0, 2, 0.1)], "query_id long, id long, with_score double")
    assert {r.id: r.score for r in rerank.support_boost(pool, pairs).collect()} == {1: 0.4, 2: 0.9, 3: 0.2}
    facts = spark.createDataFrame([(0, 7, 0.8, 0.5)], "query_id long, fact_id long, confidence double, score double")
    assert {r.id: r.score for r in rerank.with_facts(rerank.merged(pool, pool), facts).collect()} == pytest.approx({1: 0.2, 2: 0.9, 3: 0.2, -7: 0.6})


def test_expansions(spark):
    df = spark.createDataFrame([("We went camping near Yosemite",), ("plain text",), ("Would she prefer a quiet cabin or the big city hotel?",)], "t string")
    rows = df.select(E.expansions(F.col("t")).alias("e"), E.enriched(F.col("t")).alias("x")).collect()
    assert rows[0].e == ["national_park", "camping trip"] and rows[0].x.endswith("[national_park, camping trip]") and rows[1].e == [] and rows[1].x == "plain text"


def test_benchmark_sources(spark, tmp_path):
    one = [{"sample_id": "c1", "conversation": {"speaker_a": "A", "session_1": [{"speaker": "A", "dia_id": "D1:1", "text": "hi"}], "session_1_date_time": "1 May"}, "qa": [{"question": "q", "answer": "a", "category": 1, "evidence": ["D1:1"]}]}]
    (tmp_path / "a.json").write_text(json.dumps(one))
    turns, questions = benchmarks.session_dialogues(spark, str(tmp_path / "a.json"))
    assert [tuple(r) for r in turns.collect()] == [("c1", 1, "1 May", "D1:1", "A", "hi")] and questions.first().evidence == ["D1:1"]
    two = [{"question_id": "x", "question": "q", "answer": "a", "haystack_session_ids": ["s1"], "haystack_dates": ["d"], "haystack_sessions": [[{"role": "user", "content": "u"}, {"role": "assistant", "content": "v"}]], "answer_session_ids": ["s1"]}]
    (tmp_path / "b.json").write_text(json.dumps(two))
    turns, questions = benchmarks.haystack_questions(spark, str(tmp_path / "b.json"))
    assert [(r.session_id, r.turn, r.role, r.content) for r in turns.orderBy("turn").collect()] == [("s1", 0, "user", "u"), ("s1", 1, "assistant", "v")] and questions.first().answer_session_ids == ["s1"]


def test_manifests(spark):
    rows = [("package.json", '{"name": "app", "version": "1.2.0", "dependencies": {"a": "1", "b": "2"}}'), ("pyproject.toml", '[project]\nname = "lib"\nversion = "0.1"\ndependencies = [\n "x>=1",\n "y",\n]'), ("Cargo.toml", '[package]\nname = "cr"\nversion = "3.0"\n[dependencies]\nserde = "1"\n'), ("go.mod", "module m.org/x\ngo 1.22\nrequire (\n\tk.io/y v1.2.3\n)"), ("notes.txt", "x")]
    got = [r.s for r in spark.createDataFrame(rows, "name string, text string").select(project.manifest_summary().alias("s")).collect()]
    assert got == ["npm app 1.2.0 2 dependencies", "python lib 0.1 2 dependencies", "rust cr 3.0 1 dependencies", "go m.org/x 1.22 1 dependencies", None]


def drained(frame, name, folder):
    q = frame.writeStream.format("memory").queryName(name).option("checkpointLocation", str(folder)).outputMode("append").start()
    q.processAllAvailable()
    q.stop()


def test_streamed_rotation_equals_batch(spark, tmp_path):
    schema = "session_id long, turn long, text string"
    rows = [(s, t, "x" * n) for s in (1, 2) for t, n in enumerate((60, 30, 50, 10, 200, 5))]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    drained(rotated(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 100, 20), "rotated_turns", tmp_path / "c")
    batch = ordered.episodes(spark.createDataFrame(rows, schema), "session_id", "turn", "text", 100, 20)
    assert sorted(map(tuple, spark.table("rotated_turns").collect())) == sorted(map(tuple, batch.collect()))


def test_cooldown_counter(spark, tmp_path):
    spark.createDataFrame([("a", i) for i in range(11)] + [("b", 1)], "key string, id long").write.parquet(str(tmp_path / "in"))
    drained(every(spark.readStream.schema("key string, id long").parquet(str(tmp_path / "in")), 5), "every_fifth", tmp_path / "c")
    assert sorted(map(tuple, spark.table("every_fifth").collect())) == [("a", 4, 5), ("a", 9, 10)]


def test_spectral_form_equals_the_series(spark):
    chances = spark.createDataFrame([("a", "b", 0.5), ("a", "a", 0.5), ("b", "a", 1.0), ("c", "a", 0.2), ("c", "c", 0.8)], "src string, dst string, p double")
    states, m = spectral.successor_matrix(chances, 0.5)
    series = {(r.src, r.dst): r.m for r in graph.successors(chances, 0.5, 30).collect()}
    for i, a in enumerate(states):
        for j, b in enumerate(states):
            assert m[i, j] == pytest.approx(series.get((a, b), 0.0), abs=1e-6)
    places = spectral.coordinates(states, m)
    assert spectral.navigate(places, ["c"])[0] == ("c", 1.0) and spectral.navigate(places, ["zz"]) == []
    t = np.zeros((3, 3))
    t[0, :2], t[1, 0], t[2] = 0.5, 1.0, [0.2, 0, 0.8]
    assert np.allclose(np.eye(3) + 0.5 * t @ m, m, atol=1e-6)
    assert np.allclose(spectral.td_update(m, 1, 0, 0.1, 0.5), m, atol=1e-6)  # b always moves to a: the exact row is a fixed point


def test_dream_pairs_are_disjoint(spark):
    pairs = graph.dream_pairs(spark.range(100), 20).collect()
    assert len(pairs) == 20 and len({x for r in pairs for x in (r.a, r.b)}) == 40


def test_expansions_lower_a_text_once_and_find_whole_words(spark):
    texts = ["camping", "Running, camping!", "decamping camping_trip campings", "éCAMPINGé", "", None, "a reading7 reading"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t"), E.expansions(F.col("t")).alias("e"), E.enriched(F.col("t")).alias("x"))
    rows = df.collect()
    assert [r.e for r in rows] == [["camping trip"], ["camping trip", "running exercise"], [], ["camping trip"], [], [], ["reading hobby"]]
    assert [r.x for r in rows][:2] == ["camping [camping trip]", "Running, camping! [camping trip, running exercise]"] and rows[5].x is None
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "split" not in plan and plan.count("lower(") == 2  # one for each of the two columns


def test_nearest_known_in_few_blocks(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(80, 5)).round(1)
    new, known = (spark.createDataFrame([(i, "/d", v[i].tolist()) for i in ids], "id long, directory string, embedding array<double>") for ids in (range(40), range(40, 80)))
    one, few = ({(r.id, r.near_id, r.cosine) for r in ingest.nearest_known(new, known, *how).collect()} for how in ((1024,), (5, 3)))
    assert one == few and len(one) == 40


def test_a_recall_reads_texts_that_are_written_once(spark):
    from recallgrid.operators import recall

    df = spark.createDataFrame([(1, "a", 0.5, [1.0], "x")], "id long, content string, heat double, embedding array<double>, text string")
    got = recall.gathered(df.join(df.select("id"), "id"))
    assert got.columns == ["id", "content", "heat", "embedding"] and "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
