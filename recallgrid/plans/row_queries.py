"""Queries of single inventory rows: joins of index and base tables, set and state steps, small text forms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recallgrid.functions import extract as X
from recallgrid.functions import patterns as P
from recallgrid.functions import vectors as V
from recallgrid.operators import search
from recallgrid.plans.frames import EDGE_SQL, edges, memories, quoted, table
from recallgrid.plans.memory_queries import ATTR_SQL, STATIC, TOK_SQL, c, over_memories, over_vectors, query, r6
from recallgrid.plans.more_queries import ASKED_SQL, COS_SQL, _asked

q = quoted


@over_memories("b8_month_filter", "SELECT id, created_at FROM mem WHERE month(created_at) IN (1, 3) ORDER BY id LIMIT 50")
def _(m):
    return m.where(F.month("created_at").isin(1, 3)).select("id", c("created_at").cast("timestamp").alias("created_at")).orderBy("id").limit(50)


@over_memories("c1_postings_join", f", w AS (SELECT id, heat, {TOK_SQL.format('content')} AS w FROM mem WHERE heat >= 0.3), t(term) AS (VALUES ('parser'), ('postgres'), ('paris')) SELECT * FROM (SELECT id, term, len(list_filter(w, lambda x: x = term)) AS tf, heat FROM w, t) WHERE tf > 0")
def _(m):
    found = search.postings(m).where(c("term").isin("parser", "postgres", "paris"))
    return found.join(m.where("heat >= 0.3").select("id", "heat"), "id").select("id", "term", "tf", "heat")


@query("c2_vectors_join", "SELECT id, e.label, directory FROM embeddings e JOIN mem ON mem.id = e.vec_id WHERE heat >= 0.1")
def _(spark, d):
    v = table(spark, d, "embeddings").select(c("vec_id").alias("id"), "label")
    return v.join(memories(spark, d).where("heat >= 0.1").select("id", "directory"), "id")


@over_memories("c4_profile_join", f", {ATTR_SQL} SELECT mem.id, directory, name, key FROM attr JOIN mem ON attr.id = mem.id WHERE heat >= 0.1")
def _(m):
    return X.attributes(m, "id", "content").select("id", "name", "key").join(m.where("heat >= 0.1").select("id", "directory"), "id")


@query("c5_edges_named", " SELECT a.n_name AS cause, b.n_name AS effect, weight FROM edge JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst", EDGE_SQL)
def _(spark, d):
    n = table(spark, d, "nation")
    cause, effect = n.select(c("n_nationkey").cast("long").alias("src"), c("n_name").alias("cause")), n.select(c("n_nationkey").cast("long").alias("dst"), c("n_name").alias("effect"))
    return edges(spark, d).join(cause, "src").join(effect, "dst").select("cause", "effect", "weight")


@over_memories("c13_signal_alignment", """, s AS (SELECT id, 'heat' AS signal, heat AS score FROM mem WHERE heat >= 0.5 UNION ALL SELECT id, 'importance', importance FROM mem WHERE importance >= 0.5 UNION ALL SELECT id, 'confidence', confidence FROM mem WHERE confidence >= 0.5)
  SELECT id, coalesce(max(score) FILTER (signal = 'heat'), 0) AS heat, coalesce(max(score) FILTER (signal = 'importance'), 0) AS importance, coalesce(max(score) FILTER (signal = 'confidence'), 0) AS confidence FROM s GROUP BY id""")
def _(m):
    signals = ("heat", "importance", "confidence")
    rows = m.select("id", F.explode(F.array(*(F.struct(F.lit(s).alias("signal"), c(s).alias("score")) for s in signals))).alias("x")).select("id", "x.*").where("score >= 0.5")
    return rows.groupBy("id").agg(*(F.coalesce(F.max(F.when(c("signal") == s, c("score"))), F.lit(0.0)).alias(s) for s in signals))


@over_vectors("c14_merged_lists", f""", a AS (SELECT id, heat AS score FROM mem ORDER BY heat DESC, id LIMIT 20), b AS (SELECT id, round({COS_SQL}, 6) AS score FROM mem ORDER BY score DESC, id LIMIT 20)
  SELECT id, max(score) AS score, count(*) AS lists FROM (FROM a UNION ALL FROM b) GROUP BY id""")
def _(m):
    hot = search.top(m.select("id", c("heat").alias("score")), 20, "score")
    near = search.top(m.select("id", r6(V.cosine(c("embedding"), V.constant(STATIC)), "score")), 20, "score")
    return hot.unionByName(near).groupBy("id").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("lists"))


@over_memories("d15_distinct", "SELECT DISTINCT directory FROM mem WHERE heat >= 0.1")
def _(m):
    return m.where("heat >= 0.1").select("directory").distinct()


@over_memories("g2_tag_union", "SELECT id, array_to_string(list_sort(list_distinct(list_concat(tags, ['standard', 'new']))), ',') AS tags FROM mem")
def _(m):
    return m.select("id", F.array_join(F.array_sort(F.array_union("tags", F.array(F.lit("standard"), F.lit("new")))), ",").alias("tags"))


_stops = ", ".join(map(q, P.QUERY_STOPS))
_cut = r"[A-Za-z][\p{L}\p{N}_'.-]*"


@query("h3_boosted_terms", rf"""WITH {ASKED_SQL}, w AS (SELECT id, regexp_replace(unnest(regexp_extract_all(text, {q(_cut)})), '[.,'']+$', '') AS w FROM asked)
  SELECT id, lower(w) AS term, sum(CASE WHEN length(w) <= 1 OR lower(w) IN ({_stops}) THEN 1 WHEN regexp_matches(w, '^[A-Z]') THEN 3 ELSE 2 END)::BIGINT AS weight FROM w GROUP BY ALL""", "")
def _(spark, d):
    words = _asked(spark, d).select("id", F.explode(X.all_of(c("text"), _cut)).alias("w")).select("id", F.regexp_replace("w", "[.,']+$", "").alias("w"))
    weight = F.when((F.length("w") <= 1) | F.lower("w").isin(*P.QUERY_STOPS), 1).when(c("w").rlike("^[A-Z]"), 3).otherwise(2)
    return words.groupBy("id", F.lower("w").alias("term")).agg(F.sum(weight).alias("weight"))


_names = " UNION ".join(f"SELECT id, unnest(regexp_extract_all(text, {q(p)})) AS name FROM asked" for p in (P.FILE_PATH, P.DOTTED_NAME, P.ERROR_NAME, P.CAPITAL_NAME))


@query("h5_query_entities", rf"""WITH {ASKED_SQL}, n AS (SELECT id, name FROM ({_names}) WHERE length(name) > 1 UNION SELECT id, w FROM (SELECT id, regexp_replace(unnest(string_split_regex(text, '\s+')), '^[.,;:!?()\[\]{{}}"'']+|[.,;:!?()\[\]{{}}"'']+$', '', 'g') AS w FROM asked) WHERE length(w) > 2) SELECT DISTINCT id, name FROM n""", "")
def _(spark, d):
    return _asked(spark, d).select("id", F.explode(X.query_entities(c("text"))).alias("name"))


@over_vectors("h32_consistency", f", n AS (SELECT label, regexp_matches(content, {q(P.NEGATION)}) AS no FROM mem) SELECT label, count(*) FILTER (no) AS negated, count(*) FILTER (NOT no) AS plain, NOT (bool_or(no) AND bool_or(NOT no)) AS consistent FROM n GROUP BY label")
def _(m):
    no = c("content").rlike(P.NEGATION)
    return m.groupBy("label").agg(F.count_if(no).alias("negated"), F.count_if(~no).alias("plain"), (~(F.max(no) & F.max(~no))).alias("consistent"))


@over_vectors("h33_schema", f""", w AS (SELECT DISTINCT label, id, unnest({TOK_SQL.format('content')}) AS w FROM mem), z AS (SELECT label, count(*) AS n FROM mem GROUP BY label), k AS (SELECT label, w, count(*) AS k FROM w WHERE length(w) > 3 GROUP BY ALL)
  SELECT label, string_agg(w, ' ' ORDER BY r) AS words FROM (SELECT label, w, row_number() OVER (PARTITION BY label ORDER BY k DESC, w) AS r FROM k JOIN z USING (label) WHERE k >= greatest(n / 2, 2)) WHERE r <= 15 GROUP BY label""")
def _(m):
    words = m.select("label", F.explode(F.array_distinct(X.tokens(c("content")))).alias("w")).where("length(w) > 3").groupBy("label", "w").agg(F.count(F.lit(1)).alias("k"))
    sizes = m.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    common = words.join(sizes, "label").where(c("k") >= F.greatest(c("n") / 2, F.lit(2.0)))
    best = search.top_by(common, ["label"], 15, "k", "w")
    return best.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("rank", "w"))).alias("l")).select("label", F.array_join(F.transform("l", lambda x: x["w"]), " ").alias("words"))


@over_vectors("h42_noise_filter", f"SELECT id, round({COS_SQL}, 6) AS cosine FROM mem WHERE round({COS_SQL}, 6) >= 0.25")
def _(m):
    return m.select("id", r6(V.cosine(c("embedding"), V.constant(STATIC)), "cosine")).where("cosine >= 0.25")


@over_memories("h43_contextual_prefix", "SELECT id, '[' || directory || '] [' || array_to_string(tags, ', ') || '] ' || substr(content, 1, 80) AS prefixed FROM mem")
def _(m):
    return m.select("id", F.concat(F.lit("["), "directory", F.lit("] ["), F.array_join("tags", ", "), F.lit("] "), F.substring("content", 1, 80)).alias("prefixed"))


@over_memories("h46_json", "SELECT id, CAST(to_json(tags) AS VARCHAR) AS json, len(tags) AS n FROM mem")
def _(m):
    coded = m.select("id", F.to_json("tags").alias("json"))
    return coded.select("id", "json", F.size(F.from_json("json", "array<string>")).cast("long").alias("n"))


@query("k4_sufficient", ", t AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) SELECT src, count(*) AS n, count(*) >= 20 AS sufficient FROM t WHERE dst IS NOT NULL GROUP BY src")
def _(spark, d):
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, d, "events").select(c("event_type").alias("src"), after.alias("dst")).where("dst is not null")
    return rows.groupBy("src").agg(F.count(F.lit(1)).alias("n")).withColumn("sufficient", c("n") >= 20)


@over_vectors("k5_cluster_scan", "SELECT label, count(*) AS members, max(heat) AS heat FROM mem GROUP BY label ORDER BY heat DESC, label LIMIT 100")
def _(m):
    return m.groupBy("label").agg(F.count(F.lit(1)).alias("members"), F.max("heat").alias("heat")).orderBy(F.desc("heat"), "label").limit(100)


@over_memories("k6_slot_members", "SELECT id, slot FROM mem WHERE slot = 3 AND heat > 0")
def _(m):
    return m.where("slot = 3 AND heat > 0").orderBy("created_at", "id").select("id", "slot")


@query("k14_edge_upsert", ", n AS (SELECT src, dst, 1.0::DOUBLE AS weight FROM edge WHERE weight >= 27 UNION ALL SELECT src, dst, weight::DOUBLE FROM edge UNION ALL SELECT 0, 99, 1.0) SELECT src, dst, round(sum(weight), 6) AS weight FROM n GROUP BY src, dst", EDGE_SQL)
def _(spark, d):
    e = edges(spark, d)
    fresh = e.where("weight >= 27").select("src", "dst", F.lit(1.0).alias("weight")).unionAll(spark.createDataFrame([(0, 99, 1.0)], "src long, dst long, weight double"))
    return e.unionAll(fresh).groupBy("src", "dst").agg(r6(F.sum("weight"), "weight"))


@query("k20_action_text", "SELECT event_id, '[ACTION:' || event_type || '] ' || coalesce(props, '') AS text FROM events", "")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.concat(F.lit("[ACTION:"), "event_type", F.lit("] "), F.coalesce("props", F.lit(""))).alias("text"))


@over_vectors("k23_cluster_summary", "SELECT label, string_agg(substr(content, 1, 100), ' | ' ORDER BY r) AS summary FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY heat DESC, id) AS r FROM mem) WHERE r <= 3 GROUP BY label")
def _(m):
    best = search.top_by(m.select("label", "id", "heat", F.substring("content", 1, 100).alias("text")), ["label"], 3, "heat")
    return best.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("l")).select("label", F.array_join(F.transform("l", lambda x: x["text"]), " | ").alias("summary"))
