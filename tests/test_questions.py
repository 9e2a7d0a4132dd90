"""Questions, implied facts, typed entities, the write gate, curation, tree levels, jobs and slot streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallgrid.functions import extract as X
from recallgrid.functions import queries as Q
from recallgrid.functions import subqueries as U
from recallgrid.operators import ingest, jobs, ordered, search
from recallgrid.streaming.stateful import continued, slotted


def now():
    return F.lit("2024-02-01").cast("timestamp")


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


def test_options_and_terms(spark):
    text = "Would Ann rather read a long novel or the short poem, or nothing?"
    assert one(spark, text, U.options) == ["read long novel", "short poem"]
    assert one(spark, text, U.content_terms) == ["Ann", "rather", "read", "long", "novel", "short", "poem", "nothing"]
    for text in ("", None, "or", "no choice here"):
        assert one(spark, text, U.options) in ([], None)
    assert one(spark, "Tea tea TEA time", U.content_terms) == ["Tea", "time"]


def test_subqueries(spark):
    got = one(spark, "Would Carol enjoy a national park?", lambda t: U.subqueries(t, Q.statement(t)))
    assert got == ["Carol enjoy a national park", "Carol enjoy national park", "Carol camping outdoors nature hiking", "camping outdoors nature hiking"][: len(got)] and 3 <= len(got) <= 4
    assert one(spark, "what is the plan for lunch", lambda t: U.subqueries(t, Q.statement(t)))[-1] == "plan lunch"
    assert one(spark, "", lambda t: U.subqueries(t, Q.statement(t))) == []


def test_implied_facts(spark):
    text = "Ann said: You're so thoughtful, Bob\nBob said: your drive is great\nAnn loves old maps because they smell\nBob went camping\nBob wants to sail, maybe"
    assert one(spark, text, U.implied_facts) == ["Bob is thoughtful.", "Ann is driven.", "Ann enjoys old maps.", "Bob enjoys outdoor activities, nature, camping, hiking, and national parks."]
    for text in ("", "nothing here", "lower case camping"):
        assert one(spark, text, U.implied_facts) == []


def test_typed_entities(spark):
    text = "from os import path, sep\nimport json\ndef load(x):\n    return other(x)\nload(3)\nFixed the KeyError today. We decided to use Postgres instead of MySQL\nrequire('fs') function go src/a.py src/a.zzz"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id long, content string")
    got = {(r.name, r.kind, r.context) for r in X.typed_entities(df, "id", "content").collect()}
    assert got == {
        ("os", "dependency", ""), ("path", "function", "imports"), ("sep", "function", "imports"), ("json", "dependency", ""), ("load", "function", ""),
        ("load", "function", "calls"), ("KeyError", "error", "resolved_by"), ("Postgres", "decision", "decided_to_use"), ("MySQL\nrequire", "decision", "decided_to_use"),
    }
    plain = {(r.name, r.kind) for r in X.entities(df, "id", "content").collect()}
    assert {("src/a.py", "file"), ("fs", "dependency"), ("go", "function"), ("KeyError", "error"), ("json", "dependency")} <= plain and ("src/a.zzz", "file") not in plain


MEMORY = "id long, content string, directory string, tags array<string>, embedding array<double>, heat double, created_at timestamp"


def test_write_gate(spark):
    import datetime as dt

    day = dt.datetime(2024, 1, 31, 12)
    known = spark.createDataFrame([(1, "import json here", "/a", [], [1.0, 0.0], 0.5, day)], MEMORY)
    new = spark.createDataFrame(
        [
            (10, "import json", "/a", [], [1.0, 0.0], 1.0, day), (11, "import yaml", "/a", [], [0.0, 1.0], 1.0, day), (12, "import json", "/new", [], [1.0, 0.0], 1.0, day),
            (13, "a crash", "/a", [], [1.0, 0.0], 1.0, day), (14, "plain", "/a", ["Critical"], [1.0, 0.0], 1.0, day), (15, "we solved the bug", "/a", [], [1.0, 0.0], 1.0, day),
        ],
        MEMORY,
    )
    names = spark.createDataFrame([("json",)], "name string")
    got = {r.id: r for r in ingest.write_gate(new, known, names, spark.createDataFrame([("imports",)], "context string"), now()).collect()}
    assert got[10].surprisal == pytest.approx(0.2 * 0.3 + 0.15 * 0.2) and not got[10].stored
    assert got[11].surprisal == pytest.approx(0.4 + 0.25 + 0.2 * 0.7 + 0.15 * 0.2) and got[11].reason == "surprising"
    assert got[12].surprisal == 0.8 and got[13].reason == "error" and got[14].reason == "tag" and got[14].entity == 0.5
    assert got[15].structure == 0.8 and got[15].entity == 1.0 and len(got) == 6


def test_curate(spark):
    known = spark.createDataFrame([(1, "red green blue", [1.0, 0.0]), (2, "up down", [0.0, 1.0])], "id long, content string, embedding array<double>")
    new = spark.createDataFrame([(5, "Red green blue", [1.0, 0.1]), (6, "other words", [1.0, 0.1]), (7, "x", [-1.0, -1.0]), (8, None, [0.6, 0.65])], "id long, content string, embedding array<double>")
    for block in (1024, 1):
        assert {r.id: (r.action, r.near_id) for r in ingest.curate(new, known, block=block).collect()} == {5: ("merge", 1), 6: ("link", 1), 7: ("create", None), 8: ("link", 2)}
    assert {r.action for r in ingest.curate(new, known.limit(0)).collect()} == {"create"}


def test_tree_levels(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "x", "p"), (2, [0.0, 1.0], "x", "p"), (3, [1.0, 0.0], "y", "p")], "id long, embedding array<double>, l1 string, l2 string")
    short = {(r.level, r.item): r.score for r in search.tree(rows, [1.0, 0.0], "two words", ("l1", "l2")).collect()}
    assert short[0, "1"] == 0.3 and short[1, "y"] == 0.5 and short[1, "x"] == pytest.approx(0.5 * np.sqrt(0.5), abs=1e-6) and short[2, "p"] == pytest.approx(2 / np.sqrt(5), abs=1e-6)
    long = {(r.level, r.item): r.score for r in search.tree(rows, [1.0, 0.0], "w " * 31, ("l1", "l2"), 1).collect()}
    assert set(long) == {(0, "1"), (1, "y"), (2, "p")} and long[0, "1"] == 1.0 and long[1, "y"] == 0.5


def test_jobs(spark):
    from recallgrid.plans.more_queries import _bundle

    bundle = _bundle(spark, "/root/testdata/sf0.001")
    after, stats = jobs.consolidate(bundle, now(), similar=0.3)
    got = {r.step: r.rows for r in stats.collect()}
    assert after["memories"].count() == 200 - got["duplicates"] - got["pruned"] and got["duplicates"] > 0
    assert after["archive"].count() == sum(n for s, n in got.items() if s.startswith("compressed"))
    after, stats = jobs.sleep(bundle, now(), near=-1.0)
    got = {r.step: r.rows for r in stats.collect()}
    assert got["replayed"] == 20 and got["summaries"] == after["summaries"].count() and after["memories"].count() == 200


def drained(stream, name, checkpoint):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(checkpoint)).start()
    q.processAllAvailable()
    q.stop()


def test_slot_stream_equals_batch(spark, tmp_path):
    schema = "agent string, id long, us long"
    rows = [(a, i, 1_700_000_000_000_000 + i * i * 3_600_000_000) for a in "ab" for i in range(12)]
    for part in (rows[:5] + rows[12:15], rows[5:12] + rows[15:]):  # two batches, in the order of time
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = slotted(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 6).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        q.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    batch = ordered.slots(spark.createDataFrame(rows, schema).select("agent", "id", F.timestamp_micros("us").alias("ts")), 6)
    want = sorted(map(tuple, batch.select("agent", "id", "slot", "linked").collect()))
    assert len(want) == 24 and sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("agent", "id", "slot", "linked").collect())) == want


def test_continuity_stream(spark, tmp_path):
    schema = "session_id long, id long, us long, directory string, embedding array<double>"
    rows = [(1, 1, 0, "/a", [1.0, 0.0]), (1, 2, 10, "/a", [1.0, 0.0]), (1, 3, 8_000_000_000, "/b", [0.0, 1.0]), (2, 4, 0, "/a", None)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    drained(continued(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), "continuity", tmp_path / "c")
    assert {r.id: r.continuity for r in spark.table("continuity").collect()} == {1: 0.0, 2: 1.0, 3: 0.0, 4: 0.0}
