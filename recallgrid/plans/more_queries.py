"""Queries of maintenance, clusters, search kinds and order-bound folds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recallgrid.functions import expansions as E
from recallgrid.functions import extract as X
from recallgrid.functions import patterns as P
from recallgrid.functions import queries as Q
from recallgrid.functions import subqueries as U
from recallgrid.functions import vectors as V
from recallgrid.operators import causal, graph, ingest, jobs, maintain, ordered, relate, rerank, search
from recallgrid.plans.frames import EDGE_SQL, HOURS_SQL, edges, memories, now, quoted, table
from recallgrid.plans.memory_queries import ATTR_SQL, DECAY_SQL, DIST_SQL, DOT_SQL, GENERAL_SQL, SENTENCE_SQL, STATIC, STATIC_SQL, c, over_memories, over_vectors, query, r6
from recallgrid.plans.memory_queries import _domain_sql as DOMAIN_SQL

q = quoted
static = lambda: V.constant(STATIC)

ASKED = (
    "What is the parser?", "When did we deploy v2?", "fix the login bug", "relationship of orders and parts", "hello world", "the big red fox", "one two three four five six",
    "Would Alice like this?", "who wrote it", "How does the retrieval system work?", "Why is it slow?", "Can we ship it?", "meeting last week", "Is Bob here?",
    "Would Carol prefer a quiet beach or the old mountain cabin?", "Is Dana going to a national park or theme park, or home?", "What are Alice's plans?",
    "Does Erin enjoy classical music like Vivaldi?", "what kind of degree does Frank want", "which one is it.",
)
# Every user turn asks, in ASCII: two of three begin with, or are, one of the questions above, as the raw turns hold none.
ASKED_SQL = f"""asked AS (SELECT conv_id * 1000 + turn AS id, CASE (conv_id + turn) % 3 WHEN 0 THEN p WHEN 1 THEN p || ' ' || t ELSE t END AS text
  FROM (SELECT *, regexp_replace(text, '[^ -~]', '', 'g') AS t, CASE (conv_id * 7 + turn) % {len(ASKED)} {" ".join(f"WHEN {i} THEN {q(t)}" for i, t in enumerate(ASKED))} END AS p FROM conversations WHERE role = 'user'))"""
_any_sql = lambda keys: "(" + " OR ".join(f"contains(low, {q(k.lower())})" for k in keys) + ")"


_word_sql = lambda text: f"regexp_extract_all({text}, {q(U.WORD)})"
_listed = lambda words: ", ".join(map(q, words))
_bare_words = f"lambda x: x NOT IN {P.ARTICLES}"
OPTION_SQL = f"""ow AS (SELECT id, {_word_sql('lower(text)')} AS w FROM asked), oi AS (SELECT * FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM ow) WHERE w[i] = 'or'),
  ob AS (SELECT id, 2 * i AS place, list_filter(list_reverse(w[1:i - 1]), {_bare_words}) AS b FROM oi UNION ALL SELECT id, 2 * i + 1, list_filter(w[i + 1:len(w)], {_bare_words}) FROM oi),
  os AS (SELECT id, place, list_slice(b, 1, least(3, coalesce(nullif(list_position(list_transform(b, lambda x: x IN ({_listed(P.QUERY_STOPS + P.OPTION_STOPS)})), true), 0), len(b) + 1) - 1)) AS b FROM ob),
  opt AS (SELECT * FROM (SELECT id, o, min(place) AS place, row_number() OVER (PARTITION BY id ORDER BY min(place)) AS r FROM (SELECT id, place, array_to_string(CASE WHEN place % 2 = 0 THEN list_reverse(b) ELSE b END, ' ') AS o FROM os) WHERE o <> '' GROUP BY id, o) WHERE r <= 2)"""


def _asked(spark, d):
    n, phrase = c("conv_id") + c("turn"), F.get(F.array(*map(F.lit, ASKED)), ((c("conv_id") * 7 + c("turn")) % len(ASKED)).cast("int"))
    plain = F.regexp_replace("text", "[^ -~]", "")
    text = F.when(n % 3 == 0, phrase).when(n % 3 == 1, F.concat(phrase, F.lit(" "), plain)).otherwise(plain)
    return table(spark, d, "conversations").where("role = 'user'").select((c("conv_id") * 1000 + c("turn")).alias("id"), text.alias("text"))


@query("h9_query_kind", f"""WITH {ASKED_SQL}, {OPTION_SQL}, w AS (SELECT id, trim(lower(text)) AS low, string_split_regex(trim(lower(text)), '\\s+') AS w FROM asked)
  SELECT id, CASE WHEN {_any_sql(P.TEMPORAL_KEYS)} THEN 'temporal' WHEN {_any_sql(P.CUE_PHRASES)} OR {_any_sql([t for t, _ in P.TOPICS])} OR id IN (SELECT id FROM opt) OR (list_has_any(w, {list(P.MODAL_WORDS)}) AND {_any_sql(P.RELATION_KEYS)}) OR regexp_matches(low, '^(?:would|could|might) ') THEN 'open_domain'
  WHEN list_has_any(w, {list(P.QUESTION_WORDS)}) THEN 'factoid' WHEN {_any_sql(P.CODE_KEYS)} THEN 'code' WHEN {_any_sql(P.RELATION_KEYS)} THEN 'relational' WHEN len(w) <= 2 THEN 'keyword' WHEN len(w) < 5 THEN 'simple' ELSE 'complex' END AS kind FROM w""", "")
def _(spark, d):
    return _asked(spark, d).select("id", Q.kind(c("text")).alias("kind"))


_statement_sql = "CASE " + " ".join(f"WHEN regexp_matches(t, {q(p)}) THEN trim(regexp_replace(regexp_replace(t, {q(p)}, {q(chr(92) + '1' + a)}), '[?.!]+$', ''))" for p, a in P.STATEMENTS) + f""" ELSE CASE WHEN regexp_matches(t, {q(Q.LEAD)}) AND trim(regexp_replace(regexp_replace(t, {q(Q.LEAD)}, ''), '[?.!]+$', '')) <> '' THEN trim(regexp_replace(regexp_replace(t, {q(Q.LEAD)}, ''), '[?.!]+$', '')) ELSE trim(regexp_replace(t, '[?]+$', '')) END END"""


@query("h6_statement", f"WITH {ASKED_SQL}, t AS (SELECT id, trim(text) AS t FROM asked) SELECT id, {_statement_sql} AS statement FROM t", "")
def _(spark, d):
    return _asked(spark, d).select("id", Q.statement(c("text")).alias("statement"))


_plain_sql = "trim(regexp_replace(trim(text), '[?]+$', ''))"
_confirmed_sql = "CASE " + " ".join(f"WHEN regexp_matches(t, {q(p)}) THEN regexp_replace(t, {q(p)}, {q(chr(92) + '1' + v + chr(92) + '2')})" for p, v in P.CONFIRMED) + f" ELSE regexp_replace(t, {q(P.CONFIRM_LEAD)}, '') END"


@query("h7_confirmed", f"WITH {ASKED_SQL}, t AS (SELECT id, {_plain_sql} AS t FROM asked) SELECT id, {_confirmed_sql} AS statement FROM t", "")
def _(spark, d):
    return _asked(spark, d).select("id", U.confirmed(c("text")).alias("statement"))


@query("h8_content_terms", f"WITH {ASKED_SQL}, w AS (SELECT id, list_filter({_word_sql('text')}, lambda x: length(x) >= 3 AND lower(x) NOT IN ({_listed(P.QUERY_STOPS)})) AS w FROM asked), l AS (SELECT *, list_transform(w, lambda x: lower(x)) AS l FROM w) SELECT id, array_to_string(list_filter(w, lambda x, i: list_position(l, lower(x)) = i), ' ') AS terms FROM l", "")
def _(spark, d):
    return _asked(spark, d).select("id", F.array_join(U.content_terms(c("text")), " ").alias("terms"))


@query("h8_options", f"WITH {ASKED_SQL}, {OPTION_SQL} SELECT asked.id, coalesce(string_agg(o, '; ' ORDER BY r), '') AS options FROM asked LEFT JOIN opt ON asked.id = opt.id GROUP BY asked.id", "")
def _(spark, d):
    return _asked(spark, d).select("id", F.array_join(U.options(c("text")), "; ").alias("options"))


@query("h10_subqueries")
def _(spark, d):
    return _asked(spark, d).select("id", F.explode(U.subqueries(c("text"), Q.statement(c("text")))).alias("subquery"))


@query("h10_implied_facts")
def _(spark, d):
    return memories(spark, d).select("id", F.explode(U.implied_facts(F.regexp_replace("content", r"([.!?])\s+", "$1\n"))).alias("fact"))


_cut_sql = r"string_split_regex(regexp_replace(regexp_replace(text, '([a-z])([A-Z])', '\1 \2', 'g'), '[_.]', ' ', 'g'), '\s+')"
_bare_sql = rf"""list_transform({_cut_sql}, lambda t: regexp_replace(t, '^[?!,;:()\[\]{{}}"'']+|[?!,;:()\[\]{{}}"'']+$', '', 'g'))"""


@query("h2_query_terms", f"WITH {ASKED_SQL} SELECT id, array_to_string(list_filter({_bare_sql}, lambda t: length(t) >= 2 AND lower(t) NOT IN {P.STOP_WORDS}), ' ') AS terms FROM asked", "")
def _(spark, d):
    return _asked(spark, d).select("id", F.array_join(X.query_terms(c("text")), " ").alias("terms"))


@over_memories("i26_decay_pass", f", {DECAY_SQL} SELECT count(*) FILTER (h >= 0.05) AS warm, count(*) FILTER (h < 0.05) AS cold, round(sum(CASE WHEN h < 0.05 THEN 0 ELSE h END), 4) AS heat FROM d4")
def _(m):
    return maintain.decay(m, now()).agg(F.count_if(c("heat") > 0).alias("warm"), F.count_if(c("heat") == 0).alias("cold"), F.round(F.sum("heat"), 4).alias("heat"))


@query("d10_reweigh", """, e AS (SELECT src, dst, weight, (src * 37 % 100) / 1e2 AS a, (dst * 37 % 100) / 1e2 AS b FROM edge)
  SELECT src, dst, round(CASE WHEN (a + b) / 2 > 0.7 AND weight >= 5 THEN weight + 0.5 WHEN (a + b) / 2 < 0.1 THEN greatest(weight * 0.9, 0.1) ELSE weight END, 6) AS weight FROM e""", EDGE_SQL)
def _(spark, d):
    heat = table(spark, d, "nation").select(c("n_nationkey").cast("long").alias("id"), (c("n_nationkey") * 37 % 100 / F.lit(1e2)).alias("heat"))
    return maintain.reweigh(edges(spark, d), heat).select("src", "dst", r6(c("weight"), "weight"))


@query("d11_derived_facts", ", f AS (SELECT src, dst FROM edge), k AS (SELECT src, dst FROM edge WHERE weight >= 27) SELECT src, dst FROM f EXCEPT SELECT src, dst FROM k", EDGE_SQL)
def _(spark, d):
    e = edges(spark, d)
    return e.select("src", "dst").join(e.where("weight >= 27").select("src", "dst"), ["src", "dst"], "left_anti")


SCORED_SQL = f"""s AS (SELECT id, unnest({SENTENCE_SQL}) AS s, generate_subscripts({SENTENCE_SQL}, 1) AS pos FROM mem), sc AS (SELECT *, CASE WHEN regexp_matches(s, {q(P.FILE_PATH)}) THEN 3 ELSE 0 END + CASE WHEN regexp_matches(s, {q(P.ERROR_WORDS)}) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(s, {q(P.DECISION_WORDS)}) THEN 3 ELSE 0 END + CASE WHEN regexp_matches(s, {q(P.NUMBER_VERSION)}) THEN 2 ELSE 0 END + CASE WHEN regexp_matches(s, {q(P.CAMEL_NAME)}) THEN 2 ELSE 0 END + CASE WHEN contains(s, '`') THEN 2 ELSE 0 END AS score FROM s)"""


@over_memories("i32_gist", f", {SCORED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, pos) AS rank, count(*) OVER (PARTITION BY id) AS n FROM sc) SELECT id, string_agg(s, ' ' ORDER BY pos) AS gist FROM r WHERE pos = 1 OR pos = n OR rank <= ceil(n * 0.3) GROUP BY id")
def _(m):
    return maintain.gist(m)


@over_memories("i39_narrative", f""", s AS (SELECT directory, date_trunc('day', created_at) AS period, id, unnest({SENTENCE_SQL}) AS s FROM mem)
  SELECT directory, period, count(DISTINCT id) AS n, coalesce(string_agg(DISTINCT substr(s, 1, 120), '; ' ORDER BY substr(s, 1, 120)) FILTER (regexp_matches(s, {q(P.DECISION_WORDS)})), '') AS decisions,
  coalesce(string_agg(DISTINCT substr(s, 1, 120), '; ' ORDER BY substr(s, 1, 120)) FILTER (regexp_matches(s, {q(P.SUCCESS_WORDS)})), '') AS events FROM s GROUP BY directory, period""")
def _(m):
    return maintain.narrative(m)


COS_SQL = f"({DOT_SQL.format(a='embedding', b=STATIC_SQL)} / sqrt({DOT_SQL.format(a='embedding', b='embedding')}) / sqrt({DOT_SQL.format(a=STATIC_SQL, b=STATIC_SQL)}))"


@over_vectors("i30_consensus", f""", v AS (SELECT id, 0.6 * {COS_SQL} + 0.4 * heat AS base, unnest(CASE WHEN len(l) = 0 THEN ['code-patterns'] ELSE l END) AS domain FROM (SELECT *, list_filter([{DOMAIN_SQL}], lambda x: x IS NOT NULL) AS l FROM mem WHERE heat > 0)),
  w AS (SELECT id, base * CASE domain WHEN 'errors' THEN 1.5 WHEN 'dependencies' THEN 1.5 ELSE 1.0 END AS s FROM v) SELECT id, round(max(s) * (1 + 0.15 * (count(*) - 1)), 6) AS score FROM w GROUP BY id ORDER BY score DESC, id LIMIT 5""")
def _(m):
    return maintain.consensus(m, "bug in the package", V.cosine(c("embedding"), static()))


@over_vectors("c17_roll_up", "SELECT id, label AS l1, directory AS l2, count(*) OVER (PARTITION BY label) AS n1, count(*) OVER (PARTITION BY directory) AS n2 FROM mem")
def _(m):
    one = m.groupBy(c("label").alias("l1")).agg(F.count(F.lit(1)).alias("n1"))
    two = m.groupBy(c("directory").alias("l2")).agg(F.count(F.lit(1)).alias("n2"))
    return m.select("id", c("label").alias("l1"), c("directory").alias("l2")).join(one, "l1", "left").join(two, "l2", "left").select("id", "l1", "l2", "n1", "n2")


@over_memories("c18_stale_by_hash", "SELECT id FROM mem WHERE file_hash IN ('h3', 'h9') UNION SELECT id FROM mem WHERE directory = '/src/src4'")
def _(m):
    from recallgrid.sources.project import stale

    changes = m.sparkSession.createDataFrame([("/src/src4/a.py", "h3"), ("/else/b.py", "h9")], "path string, old_hash string")
    return stale(m, changes)


@over_vectors("i16_tree_search", f""", cen AS (SELECT label, list(x ORDER BY pos) AS v FROM (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM mem) GROUP BY ALL) GROUP BY label),
  l1 AS (SELECT label, {COS_SQL.replace('embedding', 'v')} AS s FROM cen), m0 AS (SELECT id, label, {COS_SQL} AS s FROM mem) SELECT id, round(0.3 * m0.s + 0.5 * l1.s, 6) AS score FROM m0 JOIN l1 USING (label) ORDER BY score DESC, id LIMIT 20""")
def _(m):
    centre = V.centroid(m, ["label"], "embedding").select("label", V.cosine(c("centroid"), static()).alias("s1"))
    own = m.select("id", "label", V.cosine(c("embedding"), static()).alias("s0"))
    return search.top(own.join(centre, "label").select("id", r6(0.3 * c("s0") + 0.5 * c("s1"), "score")), 20, "score")


_level_sql = lambda key: f"(SELECT {key} AS k, list(x ORDER BY pos) AS v FROM (SELECT {key}, pos, avg(x) AS x FROM (SELECT {key}, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM mem) GROUP BY ALL) GROUP BY {key})"


@over_vectors("i16_tree_levels", f""", s AS (SELECT 0 AS level, id::VARCHAR AS item, round(0.3 / (1 + {DIST_SQL.format(a='embedding', b=STATIC_SQL)}), 6) AS score FROM mem UNION ALL SELECT 1, k::VARCHAR, round(0.5 * {COS_SQL.replace('embedding', 'v')}, 6) FROM {_level_sql('label')} UNION ALL SELECT 2, k::VARCHAR, round({COS_SQL.replace('embedding', 'v')}, 6) FROM {_level_sql('directory')})
  SELECT level, item, score FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY score DESC, item) AS r FROM s) WHERE r <= 10""")
def _(m):
    return search.tree(m, STATIC, "where is the parser", ("label", "directory"))


@over_memories("i9_auto_recall", """, s AS (SELECT id, directory, heat, importance FROM mem WHERE regexp_matches(lower(content), 'parser|postgres')) SELECT id, round(importance * CASE WHEN directory = '/src/src3' THEN 1.5 ELSE 1 END * (1 + heat), 6) AS score FROM s ORDER BY score DESC, id LIMIT 15""")
def _(m):
    hit = m.where(F.lower("content").rlike("parser|postgres"))
    return search.top(hit.select("id", r6(c("importance") * F.when(c("directory") == "/src/src3", 1.5).otherwise(1.0) * (1 + c("heat")), "score")), 15, "score")


@over_vectors("i31_recurring", """SELECT label, count(*) AS members, count(DISTINCT session_id) AS sessions FROM mem WHERE store_type = 'episodic' GROUP BY label HAVING count(*) >= 3 AND count(DISTINCT session_id) >= 2""")
def _(m):
    g = m.where("store_type = 'episodic'").groupBy("label").agg(F.count(F.lit(1)).alias("members"), F.count_distinct("session_id").alias("sessions"))
    return g.where("members >= 3 and sessions >= 2")


@over_vectors("i31_dual_query", f"""SELECT id, store_type, score FROM (SELECT *, row_number() OVER (PARTITION BY store_type ORDER BY score DESC, id) AS r FROM (SELECT id, store_type, round({COS_SQL} * CASE store_type WHEN 'semantic' THEN 2.0 ELSE 1.0 END, 6) AS score FROM mem)) WHERE r <= 10""")
def _(m):
    s = m.select("id", "store_type", r6(V.cosine(c("embedding"), static()) * F.when(c("store_type") == "semantic", 2.0).otherwise(1.0), "score"))
    return search.top_by(s, ["store_type"], 10, "score").drop("rank")


KNOWN_SQL = f""", b AS (SELECT * FROM mem WHERE store_type = 'episodic'), k AS (SELECT * FROM mem WHERE store_type = 'semantic'),
  cs AS (SELECT b.id, k.id AS near, round({DOT_SQL.format(a='b.embedding', b='k.embedding')} / sqrt({DOT_SQL.format(a='b.embedding', b='b.embedding')}) / sqrt({DOT_SQL.format(a='k.embedding', b='k.embedding')}), 6) AS cosine FROM b, k),
  nr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, near) AS r FROM cs) WHERE r = 1)"""


def _new_and_known(m):
    return m.where("store_type = 'episodic'"), m.where("store_type = 'semantic'")


_set_sql = r"list_distinct(string_split_regex(lower({}), '\s+'))"


@over_vectors("i24_curation", KNOWN_SQL + f""" SELECT b.id, CASE WHEN cosine >= 0.35 AND len(list_intersect({_set_sql.format('b.content')}, {_set_sql.format('k.content')}))::DOUBLE / len(list_distinct(list_concat({_set_sql.format('b.content')}, {_set_sql.format('k.content')}))) > 0.02 THEN 'merge'
  WHEN cosine >= 0.3 THEN 'link' ELSE 'create' END AS action, CASE WHEN cosine >= 0.3 THEN near END AS near_id FROM b JOIN nr USING (id) JOIN k ON k.id = nr.near""")
def _(m):
    return ingest.curate(*_new_and_known(m), merge=0.35, link=0.3, overlap=0.02).select("id", "action", "near_id")


TYPED_SQL = f"""SELECT id, unnest(regexp_extract_all(content, {q(P.FROM_IMPORT)}, 1)) AS name, 'dependency' AS kind, '' AS context FROM {{t}}
  UNION SELECT id, n, 'function', 'imports' FROM (SELECT id, trim(unnest(string_split(l, ','))) AS n FROM (SELECT id, unnest(regexp_extract_all(content, {q(P.FROM_IMPORT)}, 2)) AS l FROM {{t}})) WHERE n <> ''
  UNION SELECT id, unnest(regexp_extract_all(content, {q(P.IMPORTED)}, 1)), 'dependency', '' FROM {{t}}
  UNION SELECT id, unnest(regexp_extract_all(content, {q(P.DEFINED)}, 1)), 'function', '' FROM {{t}}
  UNION SELECT id, unnest(list_intersect(regexp_extract_all(content, {q(P.DEFINED)}, 1), flatten(list_transform(list_filter(string_split(content, chr(10)), lambda l: NOT regexp_matches(l, '^\\s*def ')), lambda l: regexp_extract_all(l, {q(P.CALLED)}, 1))))), 'function', 'calls' FROM {{t}}
  UNION SELECT id, unnest(regexp_extract_all(content, {q(P.ERROR_FIXED)}, 1)), 'error', 'resolved_by' FROM {{t}}
  UNION SELECT id, unnest(regexp_extract_all(content, {q(P.DECIDED)}, 1)), 'decision', 'decided_to_use' FROM {{t}}
  UNION SELECT id, unnest(regexp_extract_all(content, {q(P.DECIDED)}, 2)), 'decision', 'decided_to_use' FROM {{t}}""".replace("{{", "{").replace("}}", "}")
_typed_sql = lambda t: TYPED_SQL.replace("{t}", t)


@over_memories("h11_entities", ", t AS (" + _typed_sql("mem") + ") SELECT DISTINCT id, name, kind, context FROM t")
def _(m):
    return X.typed_entities(m, "id", "content")


GATE_SQL = KNOWN_SQL + f""", eb AS MATERIALIZED ({_typed_sql('b')}), ek AS MATERIALIZED ({_typed_sql('k')}), nm AS (SELECT DISTINCT name FROM ek), rel AS (SELECT DISTINCT context FROM ek WHERE context <> ''),
  wd AS (SELECT id, store_type, heat, created_at, lower(content) AS low, unnest(list_distinct(string_split_regex(lower(content), '[^\\p{{L}}\\p{{N}}_]+'))) AS word FROM mem),
  an AS (SELECT name, regexp_extract(lower(name), '[\\p{{L}}\\p{{N}}_]+') AS word FROM (SELECT name FROM nm UNION SELECT name FROM eb)),
  mn AS (SELECT wd.*, name FROM wd JOIN an USING (word) WHERE contains(low, lower(name))),
  lt AS (SELECT name, max(created_at) AS seen FROM mn WHERE store_type = 'semantic' AND heat > 0 GROUP BY name),
  bn AS (SELECT id, name FROM eb UNION SELECT id, name FROM mn WHERE store_type = 'episodic' AND name IN (FROM nm)),
  tm AS (SELECT id, max(seen) AS seen FROM bn JOIN lt USING (name) GROUP BY id),
  en AS (SELECT id, sum(CASE WHEN name IN (FROM nm) THEN 0 ELSE 1 END)::DOUBLE / count(*) AS fresh, bool_or(context <> '' AND context NOT IN (FROM rel)) AS novel FROM eb GROUP BY id),
  g AS (SELECT b.id, greatest(0, least(1, 1 - cosine)) AS vector, coalesce(fresh, 0.5) AS names, CASE WHEN seen IS NULL THEN 0.7 WHEN {HOURS_SQL.format('seen')} < 1 THEN 0.1 WHEN {HOURS_SQL.format('seen')} < 24 THEN 0.3 ELSE 0.7 END AS topic, CASE WHEN coalesce(novel, false) THEN 0.8 ELSE 0.2 END AS structure,
    b.directory IN (SELECT directory FROM k) AS known FROM b JOIN nr USING (id) LEFT JOIN en USING (id) LEFT JOIN tm USING (id))"""


@over_vectors("h29_write_gate", GATE_SQL + " SELECT id, round(CASE WHEN known THEN 0.4 * vector + 0.25 * names + 0.2 * topic + 0.15 * structure ELSE 0.8 END, 6) AS surprisal FROM g")
def _(m):
    new, known = _new_and_known(m)
    typed = X.typed_entities(known, "id", "content")
    return ingest.write_gate(new, known, typed.select("name").distinct(), typed.where("context <> ''").select("context").distinct(), now()).select("id", "surprisal")


@over_memories("h22_content_merge", "SELECT id, CASE WHEN length(content) + length(text) + 1 > 2000 THEN substr(content, 1, 500) || chr(10) || substr(text, 1, 500) ELSE content || chr(10) || text END AS merged FROM mem")
def _(m):
    long = F.length("content") + F.length("text") + 1 > 2000
    return m.select("id", F.when(long, F.concat_ws("\n", F.substring("content", 1, 500), F.substring("text", 1, 500))).otherwise(F.concat_ws("\n", "content", "text")).alias("merged"))


@over_memories("h27_sleep_compression", f"""SELECT id, array_to_string(list_filter({SENTENCE_SQL}, lambda s: regexp_matches(s, {q(P.CAMEL_NAME)}) OR regexp_matches(s, {q(P.FILE_PATH)})), ' ') AS kept FROM mem WHERE length(content) > 1000""")
def _(m):
    keep = F.filter(X.sentences(c("content")), lambda s: s.rlike(P.CAMEL_NAME) | s.rlike(P.FILE_PATH))
    return m.where(F.length("content") > 1000).select("id", F.array_join(keep, " ").alias("kept"))


@over_memories("h40_beliefs", f", {ATTR_SQL} SELECT name, kind, count(*) AS n, round(avg(confidence), 6) AS confidence FROM attr GROUP BY name, kind HAVING count(*) >= 2")
def _(m):
    return X.attributes(m, "id", "content").groupBy("name", "kind").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("confidence"), "confidence")).where("n >= 2")


@over_memories("k19_hot_topics", f"SELECT id, substr(({SENTENCE_SQL})[1], 1, 60) AS topic FROM mem WHERE heat >= 0.7 ORDER BY heat DESC, id LIMIT 10")
def _(m):
    hot = search.top(m.where("heat >= 0.7").select("id", "content", "heat"), 10, "heat")
    return hot.select("id", F.substring(F.get(X.sentences(c("content")), F.lit(0)), 1, 60).alias("topic"))


_hyper = ", ".join(f"CASE WHEN contains(low, '{k}') THEN '{v}' END" for k, v in E.HYPERNYMS.items())
_nominal = ", ".join(f"CASE WHEN list_contains(w, '{k}') THEN '{v}' END" for k, v in E.NOMINALS.items())


@over_memories("h41_expansions", f"""SELECT id, array_to_string(list_sort(list_distinct(list_filter([{_hyper}, {_nominal}], lambda x: x IS NOT NULL))), ',') AS expansions FROM (SELECT id, lower(content) AS low, string_split_regex(lower(content), '[^a-z0-9_]+') AS w FROM mem)""")
def _(m):
    return m.select("id", F.array_join(F.array_sort(E.expansions(c("content"))), ",").alias("expansions"))


@over_memories("i42_enriched", f"""SELECT id, CASE WHEN len(e) > 0 THEN length(content) + 3 + length(array_to_string(e, ', ')) ELSE length(content) END AS size FROM (SELECT *, list_distinct(list_filter([{_hyper}, {_nominal}], lambda x: x IS NOT NULL)) AS e FROM (SELECT id, content, lower(content) AS low, string_split_regex(lower(content), '[^a-z0-9_]+') AS w FROM mem))""")
def _(m):
    return m.select("id", F.length(E.enriched(c("content"))).cast("long").alias("size"))


@over_memories("i5_cross_rerank", f"""SELECT id, score, rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, round(0.4 * heat + 0.6 * (CASE WHEN hi = lo THEN 1.0 ELSE (s - lo) / (hi - lo) END) * CASE WHEN n < 10 THEN 0.5 WHEN n < 20 THEN 0.8 ELSE 1.0 END, 6) AS score FROM
  (SELECT *, max(s) OVER () AS hi, min(s) OVER () AS lo FROM (SELECT id, heat, len(string_split_regex(trim(content), '\\s+')) AS n, len(list_intersect(['the', 'parser', 'success.'], list_distinct(string_split_regex(lower(content), '\\s+')))) / 3 AS s FROM (SELECT * FROM mem WHERE heat >= 0.5 ORDER BY heat DESC, id LIMIT 75))))) WHERE rank <= 10""")
def _(m):
    pool = m.where("heat >= 0.5").select(F.lit(0).alias("query_id"), "id", F.lit("the parser success.").alias("query"), "content", c("heat").alias("score"))
    return rerank.cross_rerank(pool, 10).select("id", "score", c("rank").cast("long").alias("rank"))


@query("i12_neighbourhood", """, n1 AS (SELECT dst AS id FROM both_ways WHERE src = 2), n2 AS (SELECT b.dst AS id FROM both_ways b JOIN n1 ON b.src = n1.id)
  SELECT id, min(d) AS depth FROM (SELECT 2 AS id, 0 AS d UNION ALL SELECT id, 1 FROM n1 UNION ALL SELECT id, 2 FROM n2) GROUP BY id""", EDGE_SQL)
def _(spark, d):
    return graph.neighbourhood(edges(spark, d), 2)[0]


@over_memories("i33_dream_pairs", """, o AS (SELECT id, row_number() OVER (ORDER BY md5(id::VARCHAR || ':1'), id) - 1 AS r FROM mem) SELECT min(id) AS a, max(id) AS b FROM o WHERE r < 40 GROUP BY r // 2 HAVING count(*) = 2""")
def _(m):
    return graph.dream_pairs(m)


@query("i23_remember")
def _(spark, d):
    docs = table(spark, d, "documents").select(c("doc_id").alias("id"), c("text").alias("content"), F.concat(F.lit("/src/"), "source").alias("directory"), F.array("lang").alias("tags"), "n_chars")
    known = relate.embed(docs.where("n_chars >= 1000")).select("id", "content", "directory", "embedding")
    return ingest.remember(docs.where("n_chars < 1000"), known, now()).select("id", "action", "near_id", "store_type", "surprisal")


# Results that SQL does not express; the tests hold them against plain Python
def _mmr_sql(k: int = 10) -> str:
    steps = [f"pool AS MATERIALIZED (SELECT id, {COS_SQL} AS score, embedding AS v FROM mem ORDER BY score DESC, id LIMIT {2 * k})", f"""cs AS MATERIALIZED (SELECT a.id AS a, b.id AS b, {DOT_SQL.format(a='a.v', b='b.v')} / sqrt({DOT_SQL.format(a='a.v', b='a.v')}) / sqrt({DOT_SQL.format(a='b.v', b='b.v')}) AS c FROM pool a, pool b)""", "got0 AS (SELECT NULL::BIGINT AS id, 0 AS position WHERE false)"]
    for t in range(k):
        steps.append(f"""got{t + 1} AS MATERIALIZED (FROM got{t} UNION ALL (SELECT id, {t + 1} FROM (SELECT p.id, p.score, 0.7 * p.score - 0.3 * coalesce((SELECT max(c) FROM cs WHERE cs.a = p.id AND cs.b IN (SELECT id FROM got{t})), 0) AS gain FROM pool p WHERE p.id NOT IN (SELECT id FROM got{t})) ORDER BY gain DESC, score DESC, id LIMIT 1))""")
    return ", " + ", ".join(steps) + f" SELECT 0 AS query_id, id, position FROM got{k}"


@over_vectors("f10_mmr", _mmr_sql())
def _(m):
    pool = m.select(F.lit(0).cast("long").alias("query_id"), "id", V.cosine(c("embedding"), static()).alias("score"), "embedding")
    return search.mmr(pool, 10)


@query("f9_hyper_search")
def _(spark, d):
    m = memories(spark, d).withColumn("names", F.array(c("agent")))
    return ordered.hyper_search(m, ordered.hypervector("/src/src3", ["en"], [], None, 2048))


@query("i36_chunks")
def _(spark, d):
    m = memories(spark, d).where("heat > 0.7")
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("heat"), "id"))
    pool = m.select(c("label").cast("long").alias("query_id"), "id", rank.alias("rank"), c("tags").alias("names"), c("created_at").cast("timestamp").alias("created_at"))
    return ordered.chunks(pool)


@query("i37_slots")
def _(spark, d):
    return ordered.slots(memories(spark, d).select("agent", "id", c("created_at").alias("ts")), 20)


@query("i21_pc")
def _(spark, d):
    kinds = ["click", "error", "purchase", "signup", "view"]
    h = table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(*(F.count_if(c("event_type") == k).alias(k) for k in kinds))
    directed, plain = causal.pc(h, kinds)
    rows = [(a, b, "directed") for a, b in sorted(directed)] + [(a, b, "undirected") for a, b in sorted(plain)]
    return spark.createDataFrame(rows, "src string, dst string, kind string")


@over_memories("i29_cycle", f""", {DECAY_SQL}, n AS (SELECT *, CASE WHEN h < 0.05 THEN 0 ELSE h END AS nh FROM d4) SELECT id, round(nh, 6) AS heat, round(CASE WHEN access_count > 5 AND confidence > 0.8 THEN least(importance + 0.1, 1.0) ELSE importance END, 6) AS importance,
  CASE WHEN list_has_any(tags, {list(P.SEMANTIC_TAGS)}) THEN 'semantic' WHEN regexp_matches(content, {q(P.SPECIFIC)}) THEN 'episodic' WHEN {GENERAL_SQL} THEN 'semantic' ELSE 'episodic' END AS store_type FROM n WHERE NOT (nh < 0.01 AND confidence < 0.3 AND access_count = 0)""")
def _(m):
    return maintain.cycle(m, now()).select("id", r6(c("heat"), "heat"), r6(c("importance"), "importance"), "store_type")


@query("i29_consolidation")
def _(spark, d):
    new, stats = jobs.consolidate(_bundle(spark, d), now(), similar=0.35)
    return stats


@query("i29_sleep")
def _(spark, d):
    new, stats = jobs.sleep(_bundle(spark, d), now())
    return stats


def _bundle(spark, d):
    e = table(spark, d, "events")
    heat = table(spark, d, "nation").select(c("n_nationkey").cast("long").alias("id"), (c("n_nationkey") * 37 % 100 / F.lit(1e2)).alias("heat"))
    return {"memories": memories(spark, d), "edges": edges(spark, d), "heat": heat, "actions": e.select("user_id", "ts", "event_type")}


def _community_sql(rounds: int = 50) -> str:
    steps = ["bw AS MATERIALIZED (SELECT src, dst, weight FROM both_ways UNION ALL SELECT src, src, max(weight) FROM both_ways GROUP BY src), l0 AS MATERIALIZED (SELECT DISTINCT src AS id, src AS community FROM both_ways)"]
    for t in range(rounds):
        steps.append(f"l{t + 1} AS MATERIALIZED (SELECT id, community FROM (SELECT src AS id, community, row_number() OVER (PARTITION BY src ORDER BY round(sum(weight), 6) DESC, community) AS r FROM bw JOIN l{t} ON l{t}.id = bw.dst GROUP BY src, community) WHERE r = 1)")
    return ", " + ", ".join(steps) + f" SELECT id, community FROM l{rounds}"


@query("i14_communities", _community_sql(), EDGE_SQL)
def _(spark, d):
    return graph.communities(edges(spark, d))
