"""Queries of the stored tables, of a session's life, of gaps, and of streams run to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from recallgrid.functions import extract as X
from recallgrid.functions import patterns as P
from recallgrid.functions import scoring as S
from recallgrid.operators import graph, lifecycle, maintain, recall, relate, rules, search, store
from recallgrid.plans.frames import EDGE_SQL, HOURS_SQL, MEM_SQL, NOW, VEC_SQL, edges, memories, now, quoted, table, vectors
from recallgrid.plans.memory_queries import ATTR_SQL, BM25_SQL, DIST_SQL, DOT_SQL, IMPORTANCE_SQL, MISMATCH_SQL, STATIC, STATIC_SQL, TERMS, TOK_SQL, _mismatch, c, over_memories, over_vectors, query, r6
from recallgrid.plans.more_queries import COS_SQL, DOMAIN_SQL, _typed_sql
from recallgrid.sources import project
from recallgrid.sources.shared import shared_root, stored

q = quoted


def _store(spark) -> store.Store:
    return store.Store(spark, f"{shared_root(spark)}/recallgrid/store-{uuid.uuid4().hex}")


def _union(parts):
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


# A. Stored tables
@over_memories("a1_schema_migration", "SELECT id, content, 0.5::DOUBLE AS importance, 1.0::DOUBLE AS confidence, 0 AS reconsolidations FROM mem WHERE is_protected")
def _(m):
    s = _store(m.sparkSession)
    old = m.where("is_protected").select("id", "content")  # as an earlier schema had it
    old.write.parquet(f"{s.root}/memories/v1")
    return s.read("memories").select("id", "content", "importance", "confidence", "reconsolidations")


@over_memories("a2_insert_memories", f""", w AS (SELECT id, unnest({TOK_SQL.format('content')}) AS t FROM mem), d AS (SELECT DISTINCT id, t FROM w)
  SELECT 'memories' AS "table", count(*) AS n FROM mem UNION ALL SELECT 'vectors', count(*) FROM mem WHERE embedding IS NOT NULL""")
def _(m):
    s = _store(m.sparkSession)
    s.insert_memories(m)
    return _union(s.read(t).agg(F.lit(t).alias("table"), F.count(F.lit(1)).alias("n")) for t in ("memories", "vectors"))


@query("a2_postings", r"""SELECT id, count(*) AS terms, sum(tf)::BIGINT AS words FROM (SELECT id, t, count(*) AS tf FROM (SELECT p_partkey AS id, unnest(list_filter(string_split_regex(lower(p_name || ' ' || p_type), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS t FROM part) GROUP BY ALL) GROUP BY id""", "")
def _(spark, d):
    s = _store(spark)
    s.insert_memories(table(spark, d, "part").select(c("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("content")))
    return s.read("postings").groupBy("id").agg(F.count(F.lit(1)).alias("terms"), F.sum("tf").alias("words"))


@query("a7_incremental_scan", "WITH cur AS (SELECT max(event_id) - 5000 AS pos FROM events WHERE event_type = 'signup') SELECT event_id, user_id, event_type FROM events, cur WHERE event_id > pos", "")
def _(spark, d):
    e = table(spark, d, "events")
    cursors = store.advanced(spark.createDataFrame([("episodes", 0)], "name string, at long"), "episodes", e.where("event_type = 'signup'"), "event_id")
    at = cursors.where("name = 'episodes'").select(c("at") - 5000).scalar()
    return store.since(e, at, "event_id").select("event_id", "user_id", "event_type")


@over_memories("a8_cascade_delete", """, gone AS (SELECT id FROM mem WHERE file_hash IN ('h1', 'h7')), kept AS (SELECT * FROM mem WHERE id NOT IN (FROM gone))
  SELECT 'memories' AS "table", id FROM kept UNION ALL SELECT 'vectors', id FROM kept WHERE embedding IS NOT NULL UNION ALL SELECT 'archives', id FROM kept WHERE is_stale
  UNION ALL SELECT 'transitions', id FROM kept WHERE id + 1 NOT IN (FROM gone)""")
def _(m):
    gone = m.where(c("file_hash").isin("h1", "h7")).select("id")
    steps = m.select(c("id").alias("src"), (c("id") + 1).alias("dst"))
    tables = {"memories": m.select("id"), "vectors": m.where("embedding is not null").select("id"), "archives": m.where("is_stale").select("id"), "transitions": steps}
    left = store.forgotten(tables, gone)
    return _union(rows.select(F.lit(name).alias("table"), c("src" if name == "transitions" else "id").alias("id")) for name, rows in left.items())


@over_memories("a9_profile_upsert", """, p AS (SELECT directory, tags[1] AS key, id, confidence, access_count >= 10 AS fresh FROM mem),
  g AS (SELECT directory, key, fresh, round(least(1.0, min(confidence) + 0.1 * (count(*) - 1)), 6) AS confidence, count(*) AS evidence, arg_max(id, id)::VARCHAR AS value FROM p GROUP BY ALL),
  o AS (SELECT * FROM g WHERE NOT fresh), n AS (SELECT * FROM g WHERE fresh)
  SELECT coalesce(o.directory, n.directory) AS directory, coalesce(o.key, n.key) AS key, coalesce(n.value, o.value) AS value,
  round(CASE WHEN o.key IS NULL THEN n.confidence WHEN n.key IS NULL THEN o.confidence ELSE least(1.0, o.confidence + 0.1 * n.evidence) END, 6) AS confidence, coalesce(o.evidence, 0) + coalesce(n.evidence, 0) AS evidence
  FROM o FULL JOIN n ON o.directory = n.directory AND o.key = n.key""")
def _(m):
    rows = m.select("directory", F.element_at("tags", 1).alias("key"), c("id").cast("string").alias("value"), "confidence", c("id").alias("at"), "access_count")
    empty = store.schema_of("profiles")
    first = store.upserted_profiles(m.sparkSession.createDataFrame([], empty), rows.where("access_count < 10"))
    return store.upserted_profiles(first, rows.where("access_count >= 10")).select("directory", "key", "value", r6(c("confidence"), "confidence"), "evidence")


@query("a10_stored_tables", """, e2 AS (SELECT src, dst, weight::DOUBLE AS weight FROM edge UNION ALL SELECT 0, 99, 2.0), u AS (SELECT src, dst, CASE WHEN src = 1 THEN 9.5 ELSE weight END AS weight FROM e2) SELECT src, dst, weight FROM u WHERE dst <> 3""", EDGE_SQL)
def _(spark, d):
    s = _store(spark)
    rows = stored(edges(spark, d), "edges")
    s.insert("edges", rows)
    s.insert("edges", spark.createDataFrame([(0, 99, 2.0)], "src long, dst long, weight double"))
    s.upsert("edges", rows.where("src = 1").withColumn("weight", F.lit(9.5)), ["src", "dst"])
    s.delete("edges", spark.createDataFrame([(3,)], "dst long"), ["dst"])
    return s.read("edges").select("src", "dst", "weight")


@query("a14_file_diff", """WITH a AS (SELECT url AS path, sha256(html) AS hash FROM pages), o AS (SELECT url AS path, sha256(CASE WHEN page_id % 5 = 0 THEN html || 'x' ELSE html END) AS hash FROM pages WHERE page_id % 7 <> 0)
  SELECT coalesce(a.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN a.path IS NULL THEN 'gone' ELSE 'changed' END AS change FROM (SELECT DISTINCT * FROM a) a FULL JOIN (SELECT DISTINCT * FROM o) o ON a.path = o.path WHERE o.path IS NULL OR a.path IS NULL OR a.hash <> o.hash""", "")
def _(spark, d):
    p = table(spark, d, "pages")
    new = p.select(c("url").alias("path"), F.sha2("html", 256).alias("hash")).distinct()
    changed = F.when(c("page_id") % 5 == 0, F.concat("html", F.lit("x"))).otherwise(c("html"))
    old = p.where("page_id % 7 <> 0").select(c("url").alias("path"), F.sha2(changed, 256).alias("hash")).distinct()
    return project.changed(old, new).select("path", c("state").alias("change"))


@query("a15_action_log", """SELECT event_id AS id, user_id AS session_id, event_type AS tool, '/u/' || (user_id % 9) AS directory, substr(coalesce(nullif(props, ''), event_type), 1, 200) AS summary, ts, false AS processed FROM events""", "")
def _(spark, d):
    s = _store(spark)
    e = table(spark, d, "events")
    summary = F.substring(F.coalesce(F.nullif("props", F.lit("")), "event_type"), 1, 200)
    s.insert("actions", e.select(c("event_id").alias("id"), c("user_id").alias("session_id"), c("event_type").alias("tool"), F.concat(F.lit("/u/"), c("user_id") % 9).alias("directory"), summary.alias("summary"), c("ts").cast("timestamp").alias("ts")))
    return s.read("actions")


# B. Rules and maintenance steps
RULE_ROWS = [("importance > 0.7", "filter", "hard", "global", "", 3), ("tag contains standard", "boost:0.2", "soft", "directory", "/src", 5), ("heat < 0.2", "penalty:0.3", "soft", "global", "", 9)]


@query("b5_rule_table", "SELECT * FROM (VALUES (4, 'access_count >= 7', 1), (2, 'tag contains standard', 2), (1, 'importance > 0.7', 3)) t(i, condition, place) ORDER BY 1", "")
def _(spark, d):
    t = spark.createDataFrame([], store.schema_of("rules"))
    for condition, action, kind, scope, value, priority in (*RULE_ROWS, ("access_count >= 7", "boost:0.1", "soft", "directory", "/src", 7)):
        t = rules.added(t, rules.Rule(condition, action, kind, scope, value, priority))
    return rules.listed(rules.retired(t, 3)).select(c("id").alias("i"), "condition", c("place").alias("place"))


@over_memories("b6_prune", "SELECT id FROM mem WHERE NOT (heat < 0.01 AND confidence < 0.3 AND access_count = 0)")
def _(m):
    return maintain.prune(m).select("id")


@over_memories("b7_strengthen", "SELECT id, round(CASE WHEN access_count > 5 AND confidence > 0.8 THEN least(importance + 0.1, 1.0) ELSE importance END, 6) AS importance FROM mem")
def _(m):
    return maintain.strengthen(m).select("id", r6(c("importance"), "importance"))


@query("b11_without_binary", "SELECT page_id, url FROM pages", "")
def _(spark, d):
    return store.without_binary(table(spark, d, "pages").withColumns({"html": c("html").cast("binary"), "embedding": F.array(F.lit(1.0))}))


# C, D. Names in memories, order votes
_phrase = lambda name: " ".join(t for t in name.lower().replace("_", " ").replace(".", " ").split())
NAMES = ("user_profile.py", "ostgre")


@over_memories("c7_entity_memories", ", w AS (SELECT id, lower(content) AS low, ' ' || array_to_string(" + TOK_SQL.format("content") + ", ' ') || ' ' AS w FROM mem WHERE heat >= 0.1) " + " UNION ALL ".join(f"SELECT {q(n)} AS name, id FROM w WHERE CASE WHEN (SELECT bool_or(contains(w, {q(' ' + _phrase(n) + ' ')})) FROM w) THEN contains(w, {q(' ' + _phrase(n) + ' ')}) ELSE contains(low, {q(n)}) END" for n in NAMES))
def _(m):
    return _union(search.naming(m, n).select(F.lit(n).alias("name"), "id") for n in NAMES)


@query("d9_order_votes", """WITH f AS (SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY ALL), p AS (SELECT a.event_type AS a, b.event_type AS b, a.ts < b.ts AS first FROM f a JOIN f b ON a.user_id = b.user_id AND a.event_type < b.event_type AND a.ts <> b.ts)
  SELECT a, b, count(*) FILTER (first) AS before, count(*) FILTER (NOT first) AS after FROM p GROUP BY ALL HAVING count(*) >= 3""", "")
def _(spark, d):
    return graph.order_votes(table(spark, d, "events"), "user_id", "event_type", "ts")


# F. Vectors
@over_vectors("f2_dual_nearest", f""", d AS (SELECT id, 1 / (1 + {DIST_SQL.format(a='embedding', b=STATIC_SQL)}) AS e, 1 / (1 + {DIST_SQL.format(a='list_reverse(embedding)', b=STATIC_SQL)}) AS i FROM mem WHERE heat >= 0.1),
  a AS (SELECT id, 0.7 * round(e, 6) AS s FROM d ORDER BY round(e, 6) DESC, id LIMIT 30), b AS (SELECT id, 0.3 * round(i, 6) AS s FROM d ORDER BY round(i, 6) DESC, id LIMIT 30)
  SELECT id, round(sum(s), 6) AS score FROM (FROM a UNION ALL FROM b) GROUP BY id ORDER BY score DESC, id LIMIT 30""")
def _(m):
    return search.dual_nearest(m.withColumn("implicit", F.reverse("embedding")), STATIC, 30)


@query("f11_passage_clusters")
def _(spark, d):
    m = memories(spark, d)
    return search.passage_clusters(m.select(c("session_id").alias("query_id"), "id", "content", c("heat").alias("score")), P.STOP_WORDS)


@over_memories("f3_bm25_postings", f", {BM25_SQL} SELECT id, bm25 FROM bm ORDER BY bm25 DESC, id LIMIT 50")
def _(m):
    index = stored(search.postings(m), "postings")
    sizes = m.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(X.tokens(c("content")))).alias("mean"))
    return search.bm25_postings(index, sizes, TERMS)


# I. Graph building, gaps, checkpoints
EPISODE_SQL = f"""te AS MATERIALIZED (SELECT DISTINCT id, name, kind, context FROM ({_typed_sql('mem')})), one AS (SELECT id, name, min(kind) AS kind FROM te GROUP BY ALL),
  mod AS (SELECT id, min(name) AS dst FROM te WHERE kind = 'dependency' GROUP BY id),
  imp AS (SELECT name AS src, dst, 'imports' AS kind, count(DISTINCT id)::DOUBLE AS weight FROM te JOIN mod USING (id) WHERE context = 'imports' AND name <> dst GROUP BY ALL)"""


@over_memories("i27_episode_entities", f", {EPISODE_SQL} SELECT name, arg_min(kind, (id, kind)) AS kind, 1.0::DOUBLE AS heat, count(*) AS episodes FROM one GROUP BY name")
def _(m):
    return lifecycle.episode_graph(X.typed_entities(m, "id", "content"))[0]


@over_memories("i27_episode_edges", f", {EPISODE_SQL} SELECT a.name AS src, b.name AS dst, 'co_occurrence' AS kind, count(*)::DOUBLE AS weight FROM one a JOIN one b ON a.id = b.id AND a.name < b.name GROUP BY ALL UNION ALL SELECT * FROM imp")
def _(m):
    return lifecycle.episode_graph(stored(X.typed_entities(m, "id", "content"), "typed"))[1]


NAMED_SQL = "men AS MATERIALIZED (SELECT DISTINCT id, name FROM (" + " UNION ".join(f"SELECT DISTINCT id, unnest(regexp_extract_all(content, {q(p)}, 1)) AS name, '{k}' AS kind FROM mem" for k, p in X.ENTITY_FORMS) + f") WHERE kind <> 'file' OR regexp_matches(name, {q(P.CODE_SUFFIX)}))"


@over_memories("i35_gaps", f""", {EPISODE_SQL}, {NAMED_SQL}, ent AS (SELECT name, min(kind) AS kind FROM te GROUP BY name), both_dir AS (SELECT src, dst FROM imp UNION ALL SELECT dst, src FROM imp),
  deg AS (SELECT name, (SELECT count(*) FROM both_dir WHERE src = name) AS k FROM ent), dir AS (SELECT directory, count(*) FILTER (heat < 0.3) AS cold, count(*) FILTER (confidence < 0.5) AS unsure FROM mem WHERE heat > 0 GROUP BY directory),
  live AS (SELECT id, name FROM men WHERE id IN (SELECT id FROM mem WHERE heat > 0)), co AS (SELECT a.name AS src, b.name AS dst, count(*) AS n FROM live a JOIN live b ON a.id = b.id AND a.name < b.name GROUP BY ALL HAVING count(*) >= 2)
  SELECT 'isolated_entity' AS kind, name AS subject, CASE WHEN k = 0 THEN 0.6 ELSE 0.4 END::DOUBLE AS severity FROM deg WHERE k <= 1 UNION ALL SELECT 'stale_region', directory, round(least(0.9, 0.3 + cold * 0.1), 6) FROM dir WHERE cold >= 2
  UNION ALL SELECT 'low_confidence', directory, round(least(0.8, 0.3 + unsure * 0.1), 6) FROM dir WHERE unsure >= 1
  UNION ALL SELECT 'missing_connection', src || ' + ' || dst, round(least(0.7, 0.2 + n * 0.1), 6) FROM co WHERE NOT EXISTS (SELECT 1 FROM both_dir b WHERE b.src = co.src AND b.dst = co.dst)
  UNION ALL SELECT 'one_sided_knowledge', name, 0.5 FROM ent WHERE kind = 'error'""")
def _(m):
    found = stored(X.typed_entities(m, "id", "content"), "typed")  # read five times, and far smaller than the texts
    entities = found.groupBy("name").agg(F.min("kind").alias("kind"))
    imports = lifecycle.episode_graph(found)[1].where("kind = 'imports'")
    return lifecycle.gaps(m, entities, imports, stored(recall.mentioned(m), "named"))


CHECK_SQL = "cp AS (SELECT id, agent AS session, directory, 'task ' || id AS task, id % 10 AS epoch, is_protected AND agent <> 'agent-2' AS active, created_at FROM mem WHERE is_protected OR is_stale)"


def _checkpoints(m):
    rows = m.where("is_protected or is_stale")
    return rows.select("id", c("agent").alias("session"), "directory", F.concat(F.lit("task "), "id").alias("task"), (c("id") % 10).alias("epoch"), (c("is_protected") & (c("agent") != "agent-2")).alias("active"), c("created_at").cast("timestamp").alias("created_at"))


@over_memories("k7_active_checkpoint", f", {CHECK_SQL} SELECT session, id, task, epoch FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY created_at DESC, id) AS r FROM cp WHERE active) WHERE r = 1")
def _(m):
    return lifecycle.active_checkpoints(_checkpoints(m)).select("session", "id", "task", "epoch")


@over_memories("i40_drain", f""", {CHECK_SQL}, ep AS (SELECT session, max(epoch) + 1 AS e FROM cp GROUP BY session), act AS (SELECT * FROM (SELECT id, session, epoch, row_number() OVER (PARTITION BY session ORDER BY created_at DESC, id) AS r FROM cp WHERE active) WHERE r = 1),
  pl AS (SELECT ep.session, e, act.id AS aid, act.epoch IS NULL OR act.epoch < e - 1 AS fresh FROM ep LEFT JOIN act USING (session))
  SELECT cp.id, cp.session, task, CASE WHEN cp.id = aid AND NOT fresh THEN e ELSE epoch END AS epoch, active FROM cp JOIN pl USING (session)
  UNION ALL SELECT (SELECT max(id) FROM cp) + row_number() OVER (ORDER BY session), session, '[auto-captured before compaction]', e, true FROM pl WHERE fresh""")
def _(m):
    return lifecycle.drained(_checkpoints(m), "/src", now()).select("id", "session", "task", "epoch", "active")


@over_memories("i40_micro_checkpoints", f"""SELECT id, CASE WHEN access_count < 5 THEN NULL WHEN regexp_matches(content, {q(P.ERROR_WORDS)}) THEN 'error_detected' WHEN regexp_matches(content, {q(P.DECISION_WORDS)}) THEN 'decision_made' WHEN surprise > 0.8 THEN 'high_surprise_event' END AS reason FROM mem""")
def _(m):
    return m.select("id", lifecycle.micro_checkpoint(c("content"), c("tags"), c("surprise"), c("access_count")).alias("reason"))


@over_memories("i40_restore", """, a AS (SELECT *, is_protected AND access_count > 10 AS anchored FROM mem WHERE CASE WHEN is_protected AND access_count > 10 THEN 1.0 ELSE heat END > 0),
  f AS (SELECT id FROM a WHERE anchored ORDER BY created_at DESC, id LIMIT 10), r AS (SELECT id FROM a WHERE NOT is_protected ORDER BY created_at DESC, id LIMIT 10),
  h AS (SELECT id FROM a WHERE heat >= 0.7 AND NOT anchored AND directory = '/src/src3' AND id NOT IN (FROM r) ORDER BY heat DESC, id LIMIT 10), p AS (SELECT id FROM mem WHERE id NOT IN (FROM f) AND id NOT IN (FROM r) AND id NOT IN (FROM h) ORDER BY importance DESC, id LIMIT 5)
  SELECT id, 'anchored' AS part FROM f UNION ALL SELECT id, 'recent' FROM r UNION ALL SELECT id, 'hot' FROM h UNION ALL SELECT id, 'predicted' FROM p""")
def _(m):
    keep = c("is_protected") & (c("access_count") > 10)
    rows = lifecycle.anchored(m.where(keep), "fact").unionByName(m.where(~keep))
    hot = rows.where("not array_contains(tags, '_anchor') or directory <> '/src/src3'").unionByName(rows.where("array_contains(tags, '_anchor') and directory = '/src/src3'"))
    return lifecycle.restored(hot, "/src/src3", m.select("id", c("importance").alias("score")))


@over_memories("i41_validate", ", f AS (SELECT DISTINCT directory, 'h' || (length(directory) * 3) AS hash FROM mem WHERE directory <> '/src/src5') SELECT id, CASE WHEN hash IS NULL THEN is_stale ELSE file_hash <> hash END AS is_stale FROM mem LEFT JOIN f USING (directory)")
def _(m):
    files = m.where("directory <> '/src/src5'").select(c("directory").alias("path"), F.concat(F.lit("h"), F.length("directory") * 3).alias("hash")).distinct()
    return maintain.validated(m, files).select("id", "is_stale")


# K. Accessors and state
@query("k1_entity_scan", "SELECT c_custkey AS id, (c_custkey * 37 % 100) / 1e2 AS heat FROM customer WHERE (c_custkey * 37 % 100) / 1e2 >= 0.5 AND c_custkey % 7 <> 0", "")
def _(spark, d):
    return lifecycle.entity_scan(_entities(spark, d), 0.5).select("id", "heat")


def _entities(spark, d):
    i = c("c_custkey")
    at = F.timestamp_add("HOUR", -(i % 200).cast("int"), now())
    return table(spark, d, "customer").select(i.alias("id"), c("c_name").alias("name"), c("c_mktsegment").alias("kind"), (i * 37 % 100 / F.lit(1e2)).alias("heat"), (i % 7 == 0).alias("archived"), at.alias("last_accessed"))


@query("k1_entity_decay", """WITH e AS (SELECT c_custkey AS id, (c_custkey * 37 % 100) / 1e2 AS heat, c_custkey % 7 = 0 AS archived, (c_custkey * 37 % 100) / 1e2 * pow(0.95, c_custkey % 200) AS h FROM customer)
  SELECT id, round(CASE WHEN archived THEN heat WHEN h < 0.05 THEN 0 ELSE h END, 6) AS heat, archived OR h < 0.05 AS archived FROM e""", "")
def _(spark, d):
    return lifecycle.decayed_entities(_entities(spark, d), now()).select("id", r6(c("heat"), "heat"), "archived")


@over_memories("k2_point_updates", "SELECT id, round(CASE WHEN is_stale THEN confidence ELSE heat END, 6) AS heat, round(CASE WHEN is_stale THEN 1.0 ELSE importance END, 6) AS importance FROM mem")
def _(m):
    changes = m.where("is_stale").select("id", c("confidence").alias("heat"), F.lit(1.0).alias("importance"))
    return store.updated(m, changes, ["heat", "importance"]).select("id", r6(c("heat"), "heat"), r6(c("importance"), "importance"))


@over_memories("k3_reinforce", "SELECT id, round(least(1.0, heat + 0.1 * (CASE WHEN heat >= 0.5 THEN 1 ELSE 0 END + CASE WHEN is_stale THEN 1 ELSE 0 END)), 6) AS heat FROM mem")
def _(m):
    hits = m.where("heat >= 0.5").select("id").unionAll(m.where("is_stale").select("id"))
    return lifecycle.reinforced(m.select("id", "heat"), hits).select("id", r6(c("heat"), "heat"))


@query("k3_reinforce_edges", """, p AS (SELECT dst AS src, src AS dst FROM edge WHERE weight >= 27 UNION ALL SELECT 98, 99 UNION ALL SELECT 99, 98)
  SELECT src, dst, 'trade' AS kind, round(weight + CASE WHEN weight >= 27 THEN 1 ELSE 0 END, 6) AS weight FROM edge UNION ALL SELECT 98, 99, 'co_occurrence', 2.0""", EDGE_SQL)
def _(spark, d):
    e = edges(spark, d).withColumn("kind", F.lit("trade"))
    pairs = e.where("weight >= 27").select(c("dst").alias("src"), c("src").alias("dst")).unionAll(spark.createDataFrame([(98, 99), (99, 98)], "src long, dst long"))
    return lifecycle.upserted_edges(e, pairs, "co_occurrence").select("src", "dst", "kind", r6(c("weight"), "weight"))


@over_vectors("k8_rebuilt_vectors", f", t AS (SELECT id, embedding[1:48] AS v FROM mem) SELECT id, 48 AS dims, round(v[1] / sqrt({DOT_SQL.format(a='v', b='v')}), 6) AS first FROM t")
def _(m):
    return store.rebuilt_vectors(m.select("id", "embedding"), 48).select("id", F.size("embedding").cast("long").alias("dims"), r6(c("embedding")[0], "first"))


@over_vectors("k8_vector_rows", "SELECT id, round(embedding[1], 6) AS first FROM mem WHERE NOT is_stale AND NOT is_protected UNION ALL SELECT id, round(embedding[64], 6) FROM mem WHERE is_protected AND NOT is_stale")
def _(m):
    s = _store(m.sparkSession)
    s.insert("vectors", m.select("id", "embedding"))
    s.upsert("vectors", m.where("is_protected").select("id", F.reverse("embedding").alias("embedding")), ["id"])
    s.delete("vectors", m.where("is_stale"), ["id"])
    return s.read("vectors").select("id", r6(c("embedding")[0], "first"))


@over_memories("k9_needs_reembedding", "SELECT id FROM mem WHERE id % 4 <> 1")
def _(m):
    model = F.when(c("id") % 4 == 1, "hash-64").when(c("id") % 4 == 2, "hash-32")
    return store.needs_reembedding(m.withColumn("embedding_model", model), "hash-64").select("id")


@over_memories("k15_memory_links", """, e AS (SELECT 'memory:' || id AS src, 'memory:' || (id + 1) AS dst FROM mem WHERE is_protected), p AS (SELECT 'memory:' || (id + 1) AS src, 'memory:' || id AS dst FROM mem WHERE is_protected OR is_stale),
  x AS (SELECT src, dst, 'co_occurrence' AS kind, 0.5 AS w, 0 AS n FROM e UNION ALL SELECT dst, src, 'derived_from', 0, 1 FROM p)
  SELECT least(src, dst) AS a, greatest(src, dst) AS b, min(kind) AS kind, CASE WHEN sum(w) > 0 THEN sum(w) + sum(n) ELSE sum(n) END::DOUBLE AS weight FROM x GROUP BY ALL""")
def _(m):
    own = m.where("is_protected").select(F.concat(F.lit("memory:"), "id").alias("src"), F.concat(F.lit("memory:"), c("id") + 1).alias("dst"), F.lit("co_occurrence").alias("kind"), F.lit(0.5).alias("weight"))
    linked = lifecycle.memory_links(own, m.where("is_protected or is_stale").select((c("id") + 1).alias("a"), c("id").alias("b")))
    return linked.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "kind", "weight")


@over_vectors("i33_dream_links", f""", x AS (SELECT a.id AS a, b.id AS b, round({DOT_SQL.format(a='a.embedding', b='b.embedding')} / sqrt({DOT_SQL.format(a='a.embedding', b='a.embedding')}) / sqrt({DOT_SQL.format(a='b.embedding', b='b.embedding')}), 6) AS cosine FROM mem a JOIN mem b ON b.id = a.id + 10)
  SELECT a, b, cosine, CASE WHEN cosine > 0.2 THEN 'insight' ELSE 'link' END AS action FROM x WHERE cosine > 0.1 AND a % 13 <> 0""")
def _(m):
    x = m.select(c("id").alias("a"), c("embedding").alias("v")).join(m.select((c("id") - 10).alias("a"), c("id").alias("b"), c("embedding").alias("w")), "a")
    from recallgrid.functions import vectors as V

    known = m.where("is_protected").select(F.concat(F.lit("memory:"), c("id") + 10).alias("src"), F.concat(F.lit("memory:"), "id").alias("dst"))
    return lifecycle.dreamed(x.select("a", "b", r6(V.cosine(c("v"), c("w")), "cosine")), known, 0.1, 0.2)


RECON_SQL = f"""{MISMATCH_SQL}, rc AS (SELECT *, CASE WHEN is_protected OR round(m, 6) < 0.3 + 0.2 * stability - l THEN 'none' WHEN round(m, 6) < 0.7 + 0.1 * stability - l THEN 'update' ELSE 'archive' END AS action FROM (SELECT *, CASE WHEN plasticity > 0.5 THEN 0.1 ELSE 0.0 END AS l FROM x2))"""


def _reconsolidated(m):
    rows = _mismatch(m).withColumn("reconsolidations", c("access_count"))
    return lifecycle.reconsolidated(rows, F.lit("new context"), c("m"), now(), F.lit("/src/src3"))


@over_vectors("k16_reconsolidated", f""", {RECON_SQL} SELECT id, action, CASE action WHEN 'archive' THEN 'new context' WHEN 'update' THEN CASE WHEN length(content) + 12 > 2000 THEN substr(content, 1, 500) || chr(10) || 'new context' ELSE content || chr(10) || 'new context' END ELSE content END AS content,
  CASE action WHEN 'archive' THEN '/src/src3' ELSE directory END AS directory, round(CASE action WHEN 'archive' THEN 1.0 ELSE heat END, 6) AS heat, access_count + CASE action WHEN 'none' THEN 0 ELSE 1 END AS reconsolidations FROM rc""")
def _(m):
    return _reconsolidated(m)[0].select("id", "action", "content", "directory", r6(c("heat"), "heat"), "reconsolidations")


@over_vectors("k16_archives", f", {RECON_SQL} SELECT id, content, round(m, 6) AS mismatch, 'extinction' AS reason FROM rc WHERE action = 'archive'")
def _(m):
    return _reconsolidated(m)[1].select("id", "content", "mismatch", "reason")


@over_memories("k17_domains", f""", v AS (SELECT id, heat, unnest(CASE WHEN len(l) = 0 THEN ['code-patterns'] ELSE l END) AS name FROM (SELECT *, list_filter([{DOMAIN_SQL}], lambda x: x IS NOT NULL) AS l FROM mem WHERE heat > 0)),
  p(name, decay) AS (VALUES {', '.join(f"('{n}', {d if n != 'errors' else 4.0}::DOUBLE)" for n, _, _, d in P.DOMAINS)}) SELECT name, count(*) AS n, round(avg(heat), 6) AS heat, count(*) FILTER (round(heat * pow(0.95, decay), 6) >= 0.05) AS kept FROM v JOIN p USING (name) GROUP BY name""")
def _(m):
    own = m.sparkSession.createDataFrame([("errors", 4.0, "error")], "name string, decay double, kinds string")
    return lifecycle.domain_consolidation(m, lifecycle.domain_processes(own))


@query("k18_checked_triggers", "SELECT event_id AS trigger_id, CASE WHEN event_type = 'view' THEN 'unknown kind' WHEN event_id % 5 = 0 THEN 'no condition' WHEN event_type = 'click' AND event_id % 2 = 0 THEN 'no time' END AS problem FROM events", "")
def _(spark, d):
    i, t = c("event_id"), c("event_type")
    kind = F.when(t == "view", "other").when(t == "click", "time_based").otherwise("keyword_match")
    condition = F.when(i % 5 == 0, " ").when((t == "click") & (i % 2 == 0), "soon").otherwise("9:30")
    return lifecycle.checked_triggers(table(spark, d, "events").select(i.alias("trigger_id"), kind.alias("kind"), condition.alias("condition"))).select("trigger_id", "problem")


@over_memories("k25_context", r"""SELECT row_number() OVER (ORDER BY heat DESC, id) AS rank, '- [' || format('{:.2f}', heat) || '] ' || substr(regexp_replace(content, '\s+', ' ', 'g'), 1, 120) AS line FROM mem WHERE directory = '/src/src3' AND heat > 0 ORDER BY heat DESC, id LIMIT 10""")
def _(m):
    return lifecycle.context_lines(m, "/src/src3")


@over_memories("k26_engine", """, g AS (SELECT id FROM mem WHERE file_hash = 'h7') SELECT id, round(CASE WHEN is_stale THEN 0.5 ELSE heat END, 6) AS heat FROM mem WHERE id NOT IN (FROM g)""")
def _(m):
    from recallgrid.engine import Engine

    with Engine(m.sparkSession, _store(m.sparkSession).root) as e:
        rows = m.drop("embedding").withColumns({"created_at": c("created_at").cast("timestamp"), "last_accessed": c("last_accessed").cast("timestamp")})
        e.insert(rows)
        e.update(m.where("is_stale").select("id", F.lit(0.5).alias("heat")), ["heat"])
        e.forget(m.where("file_hash = 'h7'").select("id"))
        return e.memories().select("id", r6(c("heat"), "heat"))


# J. Streams, run to the end of what is there
def _streamed(spark, d, name):
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{d}/{name}.parque[t]")  # a pattern, so that one file will do as well as a folder


def _drained(out, spark):
    """Run a stream to its end into the shared folder and read what it wrote."""
    root = f"{shared_root(spark)}/recallgrid/stream-{uuid.uuid4().hex}"
    job = out.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/rows")


@query("j1_rollup_stream", """, w AS (SELECT user_id, time_bucket(INTERVAL 30 minutes, ts) AS start, count(*) AS n, count(DISTINCT event_type) AS kinds, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS summary FROM events GROUP BY ALL HAVING count(*) >= 2)
  SELECT * FROM w WHERE start + INTERVAL 30 minutes <= (SELECT max(ts) FROM events) - INTERVAL 1 hour""".replace(", w AS", "WITH w AS", 1), "")
def _(spark, d):
    from recallgrid.streaming.rollup import rollup_stream

    e = _streamed(spark, d, "events").select("event_id", "user_id", "event_type", c("ts").cast("timestamp").alias("ts"))
    return _drained(rollup_stream(e, "user_id", least=2), spark)


@query("j2_idle_jobs", f"""WITH l AS (SELECT user_id AS session_id, max(ts) AS last, max(ts) FILTER (event_type = 'purchase') AS slept FROM events GROUP BY user_id), s AS (SELECT session_id, epoch_us(TIMESTAMP '2024-01-20') // 1000000 - epoch_us(last) // 1000000 AS idle_seconds, slept FROM l)
  SELECT session_id, CAST(idle_seconds AS BIGINT) AS idle_seconds, idle_seconds > 86400 AS consolidate, idle_seconds > 172800 AND (slept IS NULL OR (epoch_us(TIMESTAMP '2024-01-20') - epoch_us(slept)) / 3.6e9 >= 100) AS sleep FROM s""", "")
def _(spark, d):
    e = table(spark, d, "events")
    last = e.groupBy(c("user_id").alias("session_id")).agg(F.max("ts").alias("at"), F.max(F.when(c("event_type") == "purchase", c("ts"))).alias("slept"))
    return lifecycle.idle_jobs(last, F.lit("2024-01-20 00:00:00").cast("timestamp"), 86400, 100.0)


@query("j3_cursor_runs", "WITH r AS (SELECT *, event_id <= (SELECT max(event_id) FROM events WHERE ts < TIMESTAMP '2024-01-16') AS first FROM events) SELECT CASE WHEN first THEN 1 ELSE 2 END AS run, count(*) AS n, min(event_id) AS low, max(event_id) AS high FROM r GROUP BY 1", "")
def _(spark, d):
    e, s = table(spark, d, "events").select(c("event_id").alias("id"), "ts"), _store(spark)
    parts = []
    for run, seen in ((1, e.where("ts < timestamp_ntz'2024-01-16 00:00:00'")), (2, e)):  # what is there when the job runs
        at = s.read("cursors").where("name = 'episodes'").agg(F.max("at")).scalar()
        fresh = stored(store.since(seen if run == 2 else e.where(c("id") <= seen.agg(F.max("id")).scalar()), at), "fresh")
        parts.append(fresh.groupBy(F.lit(run).alias("run")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high")))
        s.write("cursors", store.advanced(s.read("cursors"), "episodes", fresh))
    return _union(parts)


@query("j4_limited_triggers", "SELECT user_id % 50 AS trigger_id, event_id AS id, r AS count FROM (SELECT *, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS r FROM events WHERE event_type = 'error') WHERE r <= 5", "")
def _(spark, d):
    from recallgrid.streaming.stateful import limited

    fired = _streamed(spark, d, "events").where("event_type = 'error'").select((c("user_id") % 50).alias("trigger_id"), c("event_id").alias("id"))
    return _drained(limited(fired), spark)


_EPISODES = """WITH RECURSIVE t AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(coalesce(text, ''))) AS r FROM conversations), f(conv_id, r, turn, total, episode) AS (SELECT conv_id, r, turn, CAST(length(coalesce(text, '')) AS BIGINT), CAST(0 AS BIGINT) FROM t WHERE r = 1
  UNION ALL SELECT t.conv_id, t.r, t.turn, CASE WHEN total > 0 AND total + length(coalesce(text, '')) > 4000 THEN least(400, total) ELSE total END + length(coalesce(text, '')), CASE WHEN total > 0 AND total + length(coalesce(text, '')) > 4000 THEN episode + 1 ELSE episode END FROM f JOIN t ON t.conv_id = f.conv_id AND t.r = f.r + 1)
  SELECT conv_id{alias}, turn, episode FROM f"""


@query("j5_rotation_stream", _EPISODES.replace("{alias}", " AS session_id"), "")
def _(spark, d):
    from recallgrid.streaming.stateful import rotated

    return _drained(rotated(_streamed(spark, d, "conversations").select(c("conv_id").alias("session_id"), "turn", "text"), 4000, 400), spark)


@query("e10_episodes", _EPISODES.replace("{alias}", ""), "")
def _(spark, d):
    from recallgrid.operators import ordered

    return ordered.episodes(table(spark, d, "conversations"), "conv_id", "turn", "text", 4000, 400)


@query("j6_plasticity")
def _(spark, d):
    from recallgrid.streaming.stateful import plastic

    recalls = _streamed(spark, d, "events").where("event_type = 'view'").select((c("user_id") % 100).alias("id"), F.unix_micros(c("ts").cast("timestamp")).alias("us"))
    return _drained(plastic(recalls), spark)


@query("j6_slot_stream")
def _(spark, d):
    from recallgrid.streaming.stateful import slotted

    stores = _streamed(spark, d, "events").select(F.concat(F.lit("agent-"), c("user_id") % 5).alias("agent"), c("event_id").alias("id"), F.unix_micros(c("ts").cast("timestamp")).alias("us"))
    return _drained(slotted(stores, 20), spark)


@query("j7_cooldowns", "SELECT event_type AS key, event_id AS id, r AS count FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) WHERE r % 50 = 0", "")
def _(spark, d):
    from recallgrid.streaming.stateful import every

    return _drained(every(_streamed(spark, d, "events").select(c("event_type").alias("key"), c("event_id").alias("id"))), spark)
