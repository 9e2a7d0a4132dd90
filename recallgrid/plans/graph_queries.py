"""Queries over graphs and event histories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recallgrid.operators import graph, relate
from recallgrid.plans.frames import EDGE_SQL, edges, table
from recallgrid.plans.memory_queries import ORACLES as _O
from recallgrid.plans.memory_queries import c, query, r6

PR_ROUNDS = 120  # of the SQL, which cannot test for convergence; far beyond it


@query("c3_named_edges", "SELECT src, dst, a.n_name AS src_name, b.n_name AS dst_name, weight FROM edge JOIN nation a ON src = a.n_nationkey JOIN nation b ON dst = b.n_nationkey", EDGE_SQL)
def _(spark, d):
    entities = table(spark, d, "nation").select(c("n_nationkey").cast("long").alias("id"), c("n_name").alias("name"))
    return graph.named(edges(spark, d), entities).select("src", "dst", "src_name", "dst_name", "weight")


@query("i13_partners", "SELECT dst, round(sum(weight), 6) AS weight FROM both_ways WHERE src = 3 GROUP BY dst ORDER BY weight DESC, dst LIMIT 10", EDGE_SQL)
def _(spark, d):
    return graph.partners(edges(spark, d), 3).select("dst", r6(c("weight"), "weight"))


@query("i11_spreading", """, s1 AS (SELECT dst AS id, 0.5 AS a FROM both_ways WHERE src IN (1, 4)), s2 AS (SELECT b.dst AS id, 0.25 AS a FROM both_ways b JOIN s1 ON b.src = s1.id)
  SELECT id, max(a)::DOUBLE AS activation FROM (SELECT 1 AS id, 1.0 AS a UNION ALL SELECT 4, 1.0 UNION ALL FROM s1 UNION ALL FROM s2) GROUP BY id""", EDGE_SQL)
def _(spark, d):
    return graph.spread(edges(spark, d), spark.createDataFrame([(1,), (4,)], "id long"))


def _rank_sql() -> str:
    steps = ["w AS MATERIALIZED (SELECT src, dst, max(weight) AS weight FROM both_ways GROUP BY ALL)", "o AS MATERIALIZED (SELECT src, sum(weight) AS total FROM w GROUP BY src)", "nodes AS MATERIALIZED (SELECT src AS id FROM w UNION SELECT 1 UNION SELECT 4)",
             "r0 AS (SELECT id, CASE WHEN id IN (1, 4) THEN 0.5 ELSE 0 END AS seed, CASE WHEN id IN (1, 4) THEN 0.5 ELSE 0 END::DOUBLE AS rank FROM nodes)"]
    for t in range(PR_ROUNDS):
        steps.append(f"""g{t} AS (SELECT w.dst AS id, sum(r.rank * w.weight / o.total) AS got FROM w JOIN o USING (src) JOIN r{t} r ON r.id = w.src GROUP BY w.dst),
r{t + 1} AS MATERIALIZED (SELECT r.id, r.seed, 0.85 * (coalesce(g.got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{t} WHERE id NOT IN (SELECT src FROM o)) * r.seed) + 0.15 * r.seed AS rank FROM r{t} r LEFT JOIN g{t} g USING (id))""")
    return f", {', '.join(steps)} SELECT id, round(rank, 6) AS rank FROM r{PR_ROUNDS}"


@query("i10_page_rank", _rank_sql(), EDGE_SQL)
def _(spark, d):
    return graph.page_rank(edges(spark, d), spark.createDataFrame([(1,), (4,)], "id long")).select("id", r6(c("rank"), "rank"))


@query("i15_components")
def _(spark, d):
    return graph.components(edges(spark, d))


_O["i15_components"] = f"""WITH RECURSIVE {EDGE_SQL.strip()}, s AS (SELECT src, dst FROM both_ways),
reach(id, seen) AS (SELECT DISTINCT src, src FROM s UNION SELECT reach.id, s.dst FROM reach JOIN s ON reach.seen = s.src) SELECT id, min(seen) AS component FROM reach GROUP BY id"""


@query("i35_isolated", ", g AS (SELECT src, count(*) AS k FROM both_ways WHERE weight > 25 GROUP BY src) SELECT CAST(n_nationkey AS BIGINT) AS id, coalesce(k, 0) AS degree, CASE WHEN coalesce(k, 0) = 0 THEN 0.6 ELSE 0.4 END AS severity FROM nation LEFT JOIN g ON src = n_nationkey WHERE coalesce(k, 0) <= 1", EDGE_SQL)
def _(spark, d):
    return graph.isolated(table(spark, d, "nation").select(c("n_nationkey").cast("long").alias("id")), edges(spark, d).where("weight > 25"))


PAIR_SQL = """pairs AS (SELECT CAST(least(s_nationkey, c_nationkey) AS BIGINT) AS src, CAST(greatest(s_nationkey, c_nationkey) AS BIGINT) AS dst, count(*) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey GROUP BY ALL)"""


def _pairs(spark, d):
    o = table(spark, d, "orders").select(c("o_orderkey").alias("l_orderkey"), "o_custkey")
    cu = table(spark, d, "customer").select(c("c_custkey").alias("o_custkey"), c("c_nationkey").cast("long").alias("y"))
    s = table(spark, d, "supplier").select(c("s_suppkey").alias("l_suppkey"), c("s_nationkey").cast("long").alias("x"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(o, "l_orderkey").join(cu, "o_custkey").join(s, "l_suppkey").where("x <> y")
    return rows.groupBy(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst")).agg(F.count(F.lit(1)).alias("n"))


@query("d8_cooccurrence", f"WITH {PAIR_SQL} SELECT src, dst, n FROM pairs", "")
def _(spark, d):
    return _pairs(spark, d)


@query("c11_missing_links", f", {PAIR_SQL} SELECT src, dst, n FROM pairs WHERE n >= 2 AND (src, dst) NOT IN (SELECT src, dst FROM edge)", EDGE_SQL)
def _(spark, d):
    return graph.missing_links(_pairs(spark, d), edges(spark, d))


@query("i22_causal_paths", """, p1 AS (SELECT dst AS id, 1 AS depth, [src, dst] AS path FROM edge WHERE src = 1), p2 AS (SELECT e.dst AS id, 2 AS depth, list_append(path, e.dst) AS path FROM p1 JOIN edge e ON e.src = p1.id WHERE NOT list_contains(path, e.dst)),
  p3 AS (SELECT e.dst AS id, 3 AS depth, list_append(path, e.dst) AS path FROM p2 JOIN edge e ON e.src = p2.id WHERE NOT list_contains(path, e.dst))
  SELECT id, depth, array_to_string(path, '>') AS path FROM (FROM p1 UNION ALL FROM p2 UNION ALL FROM p3)""", EDGE_SQL)
def _(spark, d):
    return graph.paths(edges(spark, d), 1).select("id", "depth", F.array_join("path", ">").alias("path"))


BITEMPORAL_SQL = """rel AS (SELECT event_id AS id, user_id % 20 AS src, user_id % 7 + 100 AS dst, event_type AS kind, ts AS event_time FROM events)"""


@query("c10_as_of", f"WITH {BITEMPORAL_SQL} SELECT src, dst, id, kind FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY event_time DESC, id) AS r FROM rel WHERE event_time <= TIMESTAMP '2024-01-15') WHERE r = 1", "")
def _(spark, d):
    e = table(spark, d, "events").select(c("event_id").alias("id"), (c("user_id") % 20).alias("src"), (c("user_id") % 7 + 100).alias("dst"), c("event_type").alias("kind"), c("ts").alias("event_time"))
    return graph.as_of(e, F.lit("2024-01-15").cast("timestamp_ntz")).select("src", "dst", "id", "kind")


COUNT_SQL = "tr AS (SELECT src, dst, count(*) AS n FROM (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS src, event_type AS dst FROM events) WHERE src IS NOT NULL GROUP BY ALL)"


def _counts(spark, d):
    return graph.transitions(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("e8_transitions", f"WITH {COUNT_SQL} SELECT src, dst, n FROM tr", "")
def _(spark, d):
    return _counts(spark, d)


@query("d7_stochastic", f"WITH {COUNT_SQL} SELECT src, dst, round(n / sum(n) OVER (PARTITION BY src), 6) AS p FROM tr", "")
def _(spark, d):
    return graph.stochastic(_counts(spark, d)).select("src", "dst", r6(c("p"), "p"))


_sr = [f"WITH {COUNT_SQL}, ch AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS p FROM tr), m0 AS (SELECT DISTINCT src, src AS dst, 1.0::DOUBLE AS m FROM ch)"]
for _t in range(1, 21):
    _sr.append(f"m{_t} AS MATERIALIZED (SELECT a.src, ch.dst, sum(a.m * ch.p * 0.9) AS m FROM m{_t - 1} a JOIN ch ON a.dst = ch.src GROUP BY ALL)")
_sr_sql = ", ".join(_sr) + " SELECT src, dst, round(sum(m), 6) AS m FROM (" + " UNION ALL ".join(f"FROM m{t}" for t in range(21)) + ") GROUP BY ALL"


@query("i18_successors", _sr_sql, "")
def _(spark, d):
    return graph.successors(graph.stochastic(_counts(spark, d))).select("src", "dst", r6(c("m"), "m"))


@query("i28_action_rollup", """SELECT user_id, time_bucket(INTERVAL 30 minutes, ts) AS start, count(*) AS n, count(DISTINCT event_type) AS kinds, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS summary FROM events GROUP BY ALL HAVING count(*) >= 2""", "")
def _(spark, d):
    from recallgrid.streaming.rollup import rollup

    return rollup(table(spark, d, "events").select("event_id", "user_id", "event_type", "ts"), "user_id", least=2)


@query("i19_event_matrix", "SELECT date_trunc('hour', ts) AS hour, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY ALL", "")
def _(spark, d):
    return table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("hour")).pivot("event_type", ["click", "error", "purchase", "signup", "view"]).count().na.fill(0)


@query("i20_correlations", "WITH h AS (SELECT date_trunc('hour', ts) AS hour, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type = 'error') AS b, count(*) FILTER (event_type = 'view') AS v FROM events GROUP BY ALL) SELECT round(corr(a, b), 6) AS click_error, round(corr(a, v), 6) AS click_view, round(corr(b, v), 6) AS error_view FROM h", "")
def _(spark, d):
    h = table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count_if(c("event_type") == "click").alias("a"), F.count_if(c("event_type") == "error").alias("b"), F.count_if(c("event_type") == "view").alias("v"))
    return h.agg(r6(F.corr("a", "b"), "click_error"), r6(F.corr("a", "v"), "click_view"), r6(F.corr("b", "v"), "error_view"))


@query("c12_unresolved_errors", "WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error') SELECT event_id FROM e WHERE NOT EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND p.ts > e.ts)", "")
def _(spark, d):
    e = table(spark, d, "events")
    last = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("last"))
    return e.where("event_type = 'error'").join(last, "user_id", "left").where("last is null or last <= ts").select("event_id")


@query("c6_mentions", "WITH p AS (SELECT DISTINCT p_brand AS name FROM part), t AS (SELECT p_partkey AS id, lower(p_name || ' ' || p_brand || ' ' || p_type) AS low FROM part) SELECT id, name FROM t JOIN p ON contains(low, lower(name)) WHERE regexp_matches(low, '(^|[^a-z0-9_])' || regexp_replace(lower(name), '[#]', '.', 'g'))", "")
def _(spark, d):
    p = table(spark, d, "part")
    rows = p.select(c("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("content"))
    return relate.mentions(rows, p.select(c("p_brand").alias("name")).distinct())


@query("c15_triggers", """WITH x AS (SELECT event_id AS id, '/u/' || (user_id % 9) AS directory, event_type || ' ' || coalesce(props, '') AS content, ts FROM events)
  SELECT id, 1 AS trigger_id FROM x WHERE contains(directory, '/u/3') UNION ALL SELECT id, 2 FROM x WHERE contains(lower(content), 'purchase') OR contains(lower(content), 'signup')
  UNION ALL SELECT id, 3 FROM x WHERE string_split(content, ' ')[1] = 'error' UNION ALL SELECT id, 4 FROM x WHERE hour(ts) = 9 AND minute(ts) = 30 UNION ALL SELECT id, 5 FROM x WHERE isodow(ts) = 3""", "")
def _(spark, d):
    x = table(spark, d, "events").select(c("event_id").alias("id"), F.concat(F.lit("/u/"), c("user_id") % 9).alias("directory"), F.concat("event_type", F.lit(" "), F.coalesce("props", F.lit(""))).alias("content"), F.array("event_type").alias("entities"), "ts")
    t = spark.createDataFrame([(1, "directory_match", "x", "/u/3"), (2, "keyword_match", "purchase signup", ""), (3, "entity_match", "Error", ""), (4, "time_based", "9:30", ""), (5, "time_based", "weekday:2", "")], "trigger_id int, kind string, condition string, target string")
    return relate.fired(x, t)


@query("e12_session_gaps", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 hours THEN 0 ELSE 1 END AS fresh FROM events) SELECT user_id, sum(fresh)::BIGINT AS sessions FROM g GROUP BY user_id", "")
def _(spark, d):
    gap = F.unix_micros(c("ts").cast("timestamp")) - F.unix_micros(F.lag(c("ts").cast("timestamp")).over(Window.partitionBy("user_id").orderBy("ts")))
    return table(spark, d, "events").select("user_id", F.when(gap <= 6 * 3600 * 1_000_000, 0).otherwise(1).alias("fresh")).groupBy("user_id").agg(F.sum("fresh").alias("sessions"))
