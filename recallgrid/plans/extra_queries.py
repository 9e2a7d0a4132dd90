"""Queries of reranking, rule scopes, pattern completion, single linkage, exact successors, partial correlations and clocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallgrid.operators import causal, graph, ordered, relate, replicas, rerank, rules, spectral
from recallgrid.plans.frames import VEC_SQL, table, vectors
from recallgrid.plans.graph_queries import COUNT_SQL, _counts
from recallgrid.plans.memory_queries import DOT_SQL, STATIC, STATIC_SQL, c, over_memories, over_vectors, query, r6

SCOPES = ((1, "global", ""), (2, "directory", "/src/src1"), (3, "file", "*7"), (4, "file", "h?"), (5, "file", "h.*"))


@over_memories("b3_applicable_rules", "SELECT id, 1 AS rule FROM mem UNION ALL SELECT id, 2 FROM mem WHERE starts_with(directory, '/src/src1') UNION ALL SELECT id, 3 FROM mem WHERE suffix(file_hash, '7') UNION ALL SELECT id, 4 FROM mem WHERE length(file_hash) = 2")
def _(m):
    listed = m.sparkSession.createDataFrame([(*s, True) for s in SCOPES] + [(6, "global", "", False)], "id long, scope string, value string, active boolean")
    return rules.applicable_to(m.select("id", "directory", c("file_hash").alias("file")), listed)


def _completion_sql(rounds: int = 5) -> str:
    steps = [f"x AS MATERIALIZED (SELECT id, embedding AS v FROM (SELECT * FROM mem ORDER BY heat DESC, id LIMIT 5000)), q0 AS (SELECT {STATIC_SQL} AS q)"]
    for t in range(rounds):
        steps.append(f"""s{t} AS MATERIALIZED (SELECT v, 8 * {DOT_SQL.format(a='v', b='q')} AS s FROM x, q{t}), w{t} AS (SELECT v, exp(s - (SELECT max(s) FROM s{t})) AS w FROM s{t}),
  p{t} AS MATERIALIZED (SELECT pos, sum(w * x) / (SELECT sum(w) FROM w{t}) AS x FROM (SELECT w, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM w{t}) GROUP BY pos), q{t + 1} AS MATERIALIZED (SELECT list(x / n ORDER BY pos) AS q FROM p{t}, (SELECT sqrt(sum(x * x)) AS n FROM p{t}))""")
    return ", " + ", ".join(steps) + f" SELECT unnest(range(64)) AS place, round(unnest(q), 5) AS value FROM q{rounds}"


@over_vectors("f7_completion", _completion_sql())
def _(m):
    found = ordered.complete(m, STATIC)
    return m.sparkSession.createDataFrame(list(enumerate(found)), "place long, value double").select("place", F.round("value", 5).alias("value"))


OVERLAP_SQL = "len(list_intersect(['the', 'parser', 'success.'], list_distinct(string_split_regex(lower(content), '\\s+')))) / 3"


def _pool(m):
    return m.where("heat >= 0.5").select(F.lit(0).alias("query_id"), "id", F.lit("the parser success.").alias("query"), "content", c("heat").alias("score"))


@over_memories("i6_entailment", f"SELECT id, round(0.7 * heat + 0.3 * {OVERLAP_SQL}, 6) AS score FROM mem WHERE heat >= 0.5 ORDER BY score DESC, id LIMIT 10")
def _(m):
    return rerank.entail_rerank(_pool(m), 10).select("id", "score")


@over_memories("i6_support", ", p AS (SELECT id, max(w) AS w FROM (SELECT a.id, a.heat + 0.1 * b.importance AS w FROM mem a JOIN mem b ON b.id = a.id + 20 WHERE a.heat >= 0.5) GROUP BY id) SELECT id, round(heat + greatest(coalesce(w, heat) - heat, 0) / 2, 6) AS score FROM mem LEFT JOIN p USING (id) WHERE heat >= 0.5")
def _(m):
    other = m.select((c("id") - 20).alias("id"), c("importance").alias("gain"))
    pairs = _pool(m).join(other, "id").select("query_id", "id", (c("score") + 0.1 * c("gain")).alias("with_score"))
    return rerank.support_boost(_pool(m), pairs).select("id", "score")


@over_memories("i7_comparison", """, r AS (SELECT id, max(s) AS score FROM (SELECT id, heat AS s FROM mem WHERE contains(content, 'Postgres') UNION ALL SELECT id, importance FROM mem WHERE contains(content, 'parser')) GROUP BY id)
  SELECT id, round(score, 6) AS score FROM r UNION ALL SELECT -id, round(heat * CASE WHEN confidence > 0.7 THEN 1.2 ELSE 1.0 END, 6) FROM mem WHERE is_protected AND id > 0""")
def _(m):
    ranked = lambda word, score: m.where(F.contains("content", F.lit(word))).select(F.lit(0).alias("query_id"), "id", c(score).alias("score"))
    facts = m.where("is_protected and id > 0").select(F.lit(0).alias("query_id"), c("id").alias("fact_id"), "confidence", c("heat").alias("score"))
    return rerank.with_facts(rerank.merged(ranked("Postgres", "heat"), ranked("parser", "importance")), facts).select("id", r6(c("score"), "score"))


def _linkage_sql() -> str:
    return f"""WITH RECURSIVE {VEC_SQL}, e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM mem a JOIN mem b ON a.directory = b.directory AND a.id <> b.id WHERE {DOT_SQL.format(a='a.embedding', b='b.embedding')} / sqrt({DOT_SQL.format(a='a.embedding', b='a.embedding')}) / sqrt({DOT_SQL.format(a='b.embedding', b='b.embedding')}) >= 0.3),
  reach(id, seen) AS (SELECT DISTINCT a, a FROM e UNION SELECT reach.id, e.b FROM reach JOIN e ON reach.seen = e.a) SELECT id, min(seen) AS component FROM reach GROUP BY id"""


@query("i15_fractal_linkage", _linkage_sql(), "")
def _(spark, d):
    pairs = relate.similar_pairs(vectors(spark, d), 0.3, "directory")
    return graph.components(pairs.select(c("a").alias("src"), c("b").alias("dst")))


def _exact_sql(terms: int = 250) -> str:
    steps = [f"WITH {COUNT_SQL}, ch AS MATERIALIZED (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS p FROM tr), n0 AS MATERIALIZED (SELECT DISTINCT src, src AS dst, 1.0::DOUBLE AS m FROM ch), m0 AS (FROM n0)"]
    for t in range(terms):
        steps.append(f"m{t + 1} AS MATERIALIZED (SELECT src, dst, sum(m) AS m FROM (SELECT ch.src, x.dst, ch.p * x.m * 0.9 AS m FROM ch JOIN m{t} x ON x.src = ch.dst UNION ALL FROM n0) GROUP BY ALL)")
    return ", ".join(steps) + f" SELECT src, dst, round(m, 5) AS m FROM m{terms}"


@query("i18_successors_exact", _exact_sql(), "")
def _(spark, d):
    return spectral.successor_table(graph.stochastic(_counts(spark, d))).select("src", "dst", F.round("m", 5).alias("m"))


KINDS = ("click", "error", "view")
_hour_sql = "h AS (SELECT date_trunc('hour', ts) AS hour, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in KINDS) + " FROM events GROUP BY ALL), r AS (SELECT count(*) AS n, " + ", ".join(f"corr({a}, {b}) AS {a}_{b}" for a, b in (("click", "error"), ("click", "view"), ("error", "view"))) + " FROM h)"


def _partial_sql() -> str:
    name = lambda a, b: "_".join(sorted((a, b)))
    rows = []
    for a, b, k in (("click", "error", "view"), ("click", "view", "error"), ("error", "view", "click")):
        rows.append(f"SELECT '{a}' AS a, '{b}' AS b, '{k}' AS given, n, ({name(a, b)} - {name(a, k)} * {name(b, k)}) / sqrt((1 - {name(a, k)} * {name(a, k)}) * (1 - {name(b, k)} * {name(b, k)})) AS r FROM r")
    return f"WITH {_hour_sql} SELECT a, b, given, round(r, 6) AS r, round(r * sqrt((n - 3) / (1 - r * r)), 4) AS t FROM ({' UNION ALL '.join(rows)})"


@query("i20_partial", _partial_sql(), "")
def _(spark, d):
    h = table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(*(F.count_if(c("event_type") == k).alias(k) for k in KINDS))
    return causal.partial_table(h, list(KINDS)).select("a", "b", "given", "r", F.round("t", 4).alias("t"))


@over_memories("k21_clock_tick", "SELECT id, id % 3 + CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS zero, id % 4 + CASE WHEN id % 3 = 1 THEN 1 ELSE 0 END AS one, CASE WHEN id % 3 = 2 THEN 1 ELSE 0 END AS two FROM mem")
def _(m):
    clock = F.create_map(F.lit("agent-0"), c("id") % 3, F.lit("agent-1"), c("id") % 4)
    ticked = replicas.tick(clock, c("agent"))
    value = lambda a: F.coalesce(F.try_element_at(ticked, F.lit(a)), F.lit(0).cast("long"))
    return m.select("id", value("agent-0").alias("zero"), value("agent-1").alias("one"), value("agent-2").alias("two"))
