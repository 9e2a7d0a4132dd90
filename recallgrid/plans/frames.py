"""Engine frames over the test tables, and the same frames as SQL for the queries' counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-02-01 00:00:00"

# One phrase for each kind of text that patterns look for; row n takes phrase n modulo their number.
PHRASES = (
    "we decided to use Postgres instead of MySQL for storage.",
    "Traceback (most recent call last) ValueError: bad input in src/app/main.py line 42",
    "fixed and deployed the parser, success.",
    "from os import path\nimport json\ndef load_data(x)",
    "TODO: write more tests for the loader\nremember to update the docs.",
    "Alice likes hiking. Bob works as a teacher, Carol went to Paris.",
    "The architecture pattern is modular; always prefer composition.",
    "on 12 March 2023 and 2024-01-05 we met, last week, session 3",
    "never use tabs, we stopped using svn",
    "UserProfile.save() in user_profile.py v2.3.1 `code` is broken",
    "one\n--- [Agent: agent-beta] ---\ntwo and more\n--- [Agent: agent-beta] ---\nx",
    "pip install package version upgrade library",
    "Dave is cheerful. Dave wants to travel abroad. Erin always cooks dinner, Erin believes dogs smile.",
)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A memory for every document, with its vector and label where embeddings has them and the time of the event of its
    id; all scores are integer arithmetic on the id."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    t = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts")
    i = F.col("id")
    share = lambda k: (i * k % 100) / F.lit(1e2)
    tags = F.array("lang", F.concat(F.lit("t"), i % 5))
    return d.join(e, "id", "left").join(t, "id", "left").select(
        "id",
        F.concat("text", F.lit(" "), F.get(F.array(*map(F.lit, PHRASES)), (i % len(PHRASES)).cast("int"))).alias("content"),
        "text",
        F.concat(F.lit("/src/"), "source").alias("directory"),
        F.when(i % 6 == 0, F.concat(tags, F.array(F.lit("standard")))).otherwise(tags).alias("tags"),
        "embedding", "label",
        share(37).alias("heat"), share(53).alias("importance"), ((i * 29 % 200 - 100) / F.lit(1e2)).alias("valence"), share(71).alias("confidence"),
        share(17).alias("surprise"), share(43).alias("stability"), share(61).alias("plasticity"),
        (i * 7 % 20).alias("access_count"), (i * 3 % 10).alias("useful_count"), (i % 11 == 0).alias("is_stale"), (i % 13 == 0).alias("is_protected"),
        F.concat(F.lit("h"), i % 50).alias("file_hash"), F.when(i % 3 == 0, "semantic").otherwise("episodic").alias("store_type"),
        (i % 20).alias("slot"), (i % 30).alias("session_id"), F.concat(F.lit("agent-"), i % 3).alias("agent"),
        F.col("ts").alias("created_at"), F.timestamp_add("HOUR", F.pmod(i, F.lit(72)).cast("int"), "ts").alias("last_accessed"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memories that have a vector."""
    return memories(spark, sf_dir).where("embedding is not null")


_case = " ".join(f"WHEN {n} THEN {quoted(p)}" for n, p in enumerate(PHRASES))
_BODY = f"""(SELECT d.doc_id AS id, d.text || ' ' || CASE d.doc_id % {len(PHRASES)} {_case} END AS content, d.text, '/src/' || d.source AS directory,
  CASE WHEN d.doc_id % 6 = 0 THEN [d.lang, 't' || (d.doc_id % 5), 'standard'] ELSE [d.lang, 't' || (d.doc_id % 5)] END AS tags,
  CAST(e.embedding AS DOUBLE[]) AS embedding, e.label, (d.doc_id * 37 % 100) / 1e2 AS heat, (d.doc_id * 53 % 100) / 1e2 AS importance,
  (d.doc_id * 29 % 200 - 100) / 1e2 AS valence, (d.doc_id * 71 % 100) / 1e2 AS confidence, (d.doc_id * 17 % 100) / 1e2 AS surprise,
  (d.doc_id * 43 % 100) / 1e2 AS stability, (d.doc_id * 61 % 100) / 1e2 AS plasticity, d.doc_id * 7 % 20 AS access_count, d.doc_id * 3 % 10 AS useful_count,
  d.doc_id % 11 = 0 AS is_stale, d.doc_id % 13 = 0 AS is_protected, 'h' || (d.doc_id % 50) AS file_hash,
  CASE WHEN d.doc_id % 3 = 0 THEN 'semantic' ELSE 'episodic' END AS store_type, d.doc_id % 20 AS slot, d.doc_id % 30 AS session_id, 'agent-' || (d.doc_id % 3) AS agent,
  ev.ts AS created_at, ev.ts + to_hours(CAST(d.doc_id % 72 AS INTEGER)) AS last_accessed
  FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id LEFT JOIN events ev ON ev.event_id = d.doc_id)"""
MEM_SQL = f"mem AS {_BODY}"
VEC_SQL = f"every AS {_BODY}, mem AS (SELECT * FROM every WHERE embedding IS NOT NULL)"
HOURS_SQL = f"(epoch_us(TIMESTAMP '{NOW}') - epoch_us({{}})) / 3.6e9"


def now():
    return F.lit(NOW).cast("timestamp")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected weighted edges between nations: pairs whose order lines exceed the mean of all pairs by a tenth."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("y"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("x"))
    pairs = l.join(o, "l_orderkey").join(c, "o_custkey").join(s, "l_suppkey").where("x <> y")
    n = pairs.groupBy(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst")).agg(F.count(F.lit(1)).alias("n"))
    mean = n.agg(F.struct(F.count(F.lit(1)).alias("pairs"), F.sum("n").alias("lines")).alias("m")).scalar()
    return n.where(F.col("n") * 10 * mean["pairs"] > 11 * mean["lines"]).select("src", "dst", (F.col("n") / F.lit(1e1)).alias("weight"))


EDGE_SQL = """
edge AS (SELECT src, dst, n / 1e1 AS weight FROM (SELECT *, count(*) OVER () AS pairs, sum(n) OVER () AS lines FROM (
  SELECT CAST(least(s_nationkey, c_nationkey) AS BIGINT) AS src, CAST(greatest(s_nationkey, c_nationkey) AS BIGINT) AS dst, count(*) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE s_nationkey <> c_nationkey GROUP BY ALL)) WHERE n * 10 * pairs > 11 * lines),
both_ways AS (SELECT src, dst, weight FROM edge UNION ALL SELECT dst, src, weight FROM edge)"""
