"""Queries over memories: scans, filters, scores, extraction, vectors, search, fusion, maintenance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recallgrid.functions import extract as X
from recallgrid.functions import patterns as P
from recallgrid.functions import scoring as S
from recallgrid.functions import vectors as V
from recallgrid.operators import fusion, metrics, relate, replicas, rules, search
from recallgrid.plans.frames import HOURS_SQL, MEM_SQL, VEC_SQL, memories, now, quoted, table, vectors

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
r6 = lambda c, name: F.round(c, 6).alias(name)
c = F.col


def query(name: str, sql: str = "", prelude: str = MEM_SQL):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = f"WITH {prelude.strip()}{'' if sql.lstrip().startswith(',') else ' '}{sql}" if prelude else sql
        return f

    return add


def over_memories(name: str, sql: str):
    """A query that is a function of the memories frame."""

    def add(f):
        query(name, sql)(lambda spark, d: f(memories(spark, d)))
        return f

    return add


def over_vectors(name: str, sql: str):
    """A query that is a function of the memories with a vector."""

    def add(f):
        query(name, sql, VEC_SQL)(lambda spark, d: f(vectors(spark, d)))
        return f

    return add


AGE, IDLE = HOURS_SQL.format("created_at"), HOURS_SQL.format("last_accessed")
age = lambda: S.hours_between(c("created_at"), now())
idle = lambda: S.hours_between(c("last_accessed"), now())
q = quoted
STATIC = [(i * 8 % 13 - 6) / 20 for i in range(64)]
STATIC_SQL = "[" + ", ".join(f"{x}::DOUBLE" for x in STATIC) + "]"
DIST_SQL = "sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"
DOT_SQL = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"
TOK_SQL = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


# Scans
@over_memories("a3_point_lookup", "SELECT id, directory, heat FROM mem WHERE id IN (3, 17, 42, 199)")
def _(m):
    return m.where(c("id").isin(3, 17, 42, 199)).select("id", "directory", "heat")


@over_memories("a4_heat_scan", "SELECT id, heat FROM mem WHERE heat >= 0.7 ORDER BY heat DESC, id LIMIT 100")
def _(m):
    return search.top(m.where("heat >= 0.7").select("id", "heat"), 100, "heat")


@over_memories("a5_directory_scan", "SELECT id, heat, importance FROM mem WHERE directory = '/src/src3' AND heat >= 0.1")
def _(m):
    return m.where("directory = '/src/src3' AND heat >= 0.1").select("id", "heat", "importance")


@over_memories("a6_stale_scan", "SELECT id, file_hash FROM mem WHERE is_stale AND heat > 0")
def _(m):
    return m.where("is_stale AND heat > 0").select("id", "file_hash")


@query("a14_file_hashes", "SELECT page_id, sha256(html) AS hash FROM pages", "")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("hash"))


@query("a16_conversation_pairs", """SELECT conv_id, CAST(floor((rn - 1) / 2) AS BIGINT) AS pair, string_agg(role || ': ' || text, chr(10) ORDER BY rn) AS content FROM
  (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE role <> 'system') GROUP BY ALL""", "")
def _(spark, d):
    t = table(spark, d, "conversations").where("role <> 'system'").withColumn("rn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    pair = t.groupBy("conv_id", F.floor((c("rn") - 1) / 2).alias("pair")).agg(F.array_sort(F.collect_list(F.struct("rn", F.concat("role", F.lit(": "), "text").alias("t")))).alias("p"))
    return pair.select("conv_id", "pair", F.array_join(F.transform("p", lambda x: x["t"]), "\n").alias("content"))


# Filters and rules
RULES = [rules.Rule("importance > 0.3", "filter", "hard", priority=9), rules.Rule("tag contains standard", "boost:0.2", priority=5), rules.Rule("content contains traceback", "penalty:0.3", priority=4), rules.Rule("directory matches /src/src1*", "boost:0.1", priority=1)]


@over_memories("b4_apply_rules", """SELECT id, round(heat + CASE WHEN list_contains(tags, 'standard') THEN 0.2 ELSE 0 END - CASE WHEN contains(lower(content), 'traceback') THEN 0.3 ELSE 0 END
  + CASE WHEN starts_with(directory, '/src/src1') THEN 0.1 ELSE 0 END, 6) AS score FROM mem WHERE importance > 0.3""")
def _(m):
    return rules.apply_rules(m.withColumn("score", c("heat")), rules.applicable(RULES, "/src")).select("id", r6(c("score"), "score"))


for _name, _condition, _sql in (
    ("number", "access_count >= 7", "access_count >= 7"),
    ("equals", "store_type == Semantic", "store_type = 'semantic'"),
    ("differs", "agent != agent-1", "agent <> 'agent-1'"),
    ("lacks", "content not_contains decided", "NOT contains(lower(content), 'decided')"),
    ("tag", "tag == T3", "list_contains(tags, 't3')"),
    ("glob", "directory matches /src/src?", "regexp_full_match(directory, '/src/src.')"),
):
    over_memories(f"b2_condition_{_name}", f"SELECT id FROM mem WHERE {_sql}")(lambda m, x=_condition: m.where(rules.predicate(x, m.columns)).select("id"))


@over_memories("b9_time_range", "SELECT id FROM mem WHERE created_at BETWEEN TIMESTAMP '2024-01-01 03:00:00' AND TIMESTAMP '2024-01-01 09:00:00' AND month(created_at) = 1")
def _(m):
    return m.where(c("created_at").between(F.lit("2024-01-01 03:00:00").cast("timestamp_ntz"), F.lit("2024-01-01 09:00:00").cast("timestamp_ntz")) & (F.month("created_at") == 1)).select("id")


@over_memories("b10_conflict_agents", rf"SELECT id, array_to_string(list_sort(list_distinct(regexp_extract_all(content, {q(P.CONFLICT_MARK)}, 1))), ',') AS agents FROM mem WHERE regexp_matches(content, {q(P.CONFLICT_MARK)})")
def _(m):
    return m.where(replicas.conflicted(c("content"))).select("id", F.array_join(F.array_sort(replicas.conflict_agents(c("content"))), ",").alias("agents"))


# Scores
IMPORTANCE_SQL = f"""least(1.0, CASE WHEN regexp_matches(content, {q(P.ERROR_WORDS)}) THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(content, {q(P.DECISION_WORDS)}) THEN 0.3 ELSE 0 END
 + CASE WHEN regexp_matches(content, {q(P.DESIGN_WORDS)}) THEN 0.2 ELSE 0 END + CASE WHEN len(tags) >= 3 THEN 0.1 ELSE 0 END + CASE WHEN length(content) > 500 THEN 0.1 ELSE 0 END
 + CASE WHEN regexp_matches(content, {q(P.CODE_SPAN)}) OR regexp_matches(content, {q(P.FILE_PATH)}) THEN 0.1 ELSE 0 END)"""


@over_memories("h13_importance", f"SELECT id, round({IMPORTANCE_SQL}, 6) AS score FROM mem")
def _(m):
    return m.select("id", r6(S.importance(c("content"), c("tags")), "score"))


@over_memories("h14_valence", f"""SELECT id, round(CASE WHEN b + g = 0 THEN 0 ELSE (g - b) / (g + b) END, 6) AS valence FROM (SELECT id, len(regexp_extract_all(content, {q(P.ERROR_WORDS)})) AS b,
  len(regexp_extract_all(content, {q(P.SUCCESS_WORDS)})) AS g FROM mem)""")
def _(m):
    return m.select("id", r6(S.valence(c("content")), "valence"))


DECAY_SQL = f"""d1 AS (SELECT *, CASE WHEN importance > 0.7 THEN 0.998 ELSE 0.95 END AS f0, {IDLE} AS hours FROM mem),
d2 AS (SELECT *, 1 - (1 - f0) / (1 + 0.5 * abs(valence)) AS f1 FROM d1), d3 AS (SELECT *, 1 - (1 - f1) / (1 + 0.1 * confidence) AS f2 FROM d2),
d4 AS (SELECT *, heat * pow(least(1, greatest(0, f2)), greatest(hours, 0)) AS h FROM d3)"""


@over_memories("h15_decay", f", {DECAY_SQL} SELECT id, round(CASE WHEN h < 0.05 THEN 0 ELSE h END, 6) AS heat FROM d4")
def _(m):
    return m.select("id", r6(S.decayed_heat(c("heat"), idle(), c("importance"), c("valence"), c("confidence")), "heat"))


@over_memories("h16_surprise_boost", "SELECT id, round(least(heat + 0.3 * surprise, 1.0), 6) AS heat FROM mem")
def _(m):
    return m.select("id", r6(S.surprise_boost(c("heat"), c("surprise")), "heat"))


@over_memories("h17_coherence", f"SELECT id, round(CASE WHEN h < 400 THEN least(heat + 0.2 * (1 - h / 400), 1.0) ELSE heat END, 6) AS heat FROM (SELECT *, {AGE} AS h FROM mem)")
def _(m):
    return m.select("id", r6(S.coherence(c("heat"), age(), 400.0), "heat"))


@over_memories("h18_metamemory", "SELECT id, round(CASE WHEN access_count > 3 THEN useful_count / access_count ELSE confidence END, 6) AS confidence, round(CASE WHEN access_count < 3 THEN 1.0 ELSE confidence END, 6) AS reliability FROM mem")
def _(m):
    return m.select("id", r6(S.rated_confidence(c("access_count"), c("useful_count"), c("confidence")), "confidence"), r6(S.reliability(c("access_count"), c("confidence")), "reliability"))


@over_memories("h19_half_lives", f"""SELECT id, round(least(plasticity * pow(2.0, -greatest(h, 0) / 60) + 0.3, 1.0), 6) AS plasticity,
  round(CASE WHEN useful_count > 4 THEN least(stability + 0.1, 1.0) WHEN access_count > 5 THEN greatest(stability - 0.05, 0.0) ELSE stability END, 6) AS stability FROM (SELECT *, {IDLE} AS h FROM mem)""")
def _(m):
    return m.select("id", r6(S.plasticity(c("plasticity"), idle(), 60.0), "plasticity"), r6(S.stability(c("stability"), c("useful_count") > 4, c("access_count")), "stability"))


MISMATCH_SQL = f"""x1 AS (SELECT *, 0.5 * (1 - {DOT_SQL.format(a='embedding', b=STATIC_SQL)} / sqrt({DOT_SQL.format(a='embedding', b='embedding')}) / sqrt({DOT_SQL.format(a=STATIC_SQL, b=STATIC_SQL)}))
 + 0.2 * CASE WHEN directory = '/src/src3' THEN 0 ELSE 0.5 END + 0.15 * least({IDLE} / 168, 1)
 + 0.15 * (1 - len(list_intersect(tags, ['en', 't1', 'standard'])) / len(list_distinct(tags || ['en', 't1', 'standard']))) AS mm FROM mem), x2 AS (SELECT *, greatest(0, least(1, mm)) AS m FROM x1)"""


def _mismatch(m):
    near = V.cosine(c("embedding"), V.constant(STATIC))
    return m.withColumn("m", S.mismatch(near, c("directory"), F.lit("/src/src3"), idle(), c("tags"), F.array(F.lit("en"), F.lit("t1"), F.lit("standard"))))


@over_vectors("h20_mismatch", f", {MISMATCH_SQL} SELECT id, round(m, 6) AS mismatch FROM x2")
def _(m):
    return _mismatch(m).select("id", r6(c("m"), "mismatch"))


@over_vectors("h21_reconsolidate", f""", {MISMATCH_SQL} SELECT id, CASE WHEN is_protected OR round(m, 6) < 0.3 + 0.2 * stability - l THEN 'none' WHEN round(m, 6) < 0.7 + 0.1 * stability - l THEN 'update' ELSE 'archive' END AS decision
  FROM (SELECT *, CASE WHEN plasticity > 0.5 THEN 0.1 ELSE 0.0 END AS l FROM x2)""")
def _(m):
    return _mismatch(m).select("id", S.reconsolidation(F.round("m", 6), c("stability"), c("plasticity"), c("is_protected")).alias("decision"))


GENERAL_SQL = f"(regexp_matches(content, {q(P.RULE_WORDS)}) OR regexp_matches(content, {q(P.THEORY_WORDS)}))"


@over_memories("h23_memory_class", f"""SELECT id, CASE WHEN list_has_any(tags, {list(P.SEMANTIC_TAGS)}) THEN 'semantic' WHEN regexp_matches(content, {q(P.SPECIFIC)}) THEN 'episodic'
  WHEN {GENERAL_SQL} THEN 'semantic' ELSE 'episodic' END AS class FROM mem""")
def _(m):
    return m.select("id", S.memory_class(c("content"), c("tags")).alias("class"))


@over_memories("h24_store_weights", f"""SELECT id, CASE WHEN s AND NOT g THEN 2.0 ELSE 1.0 END AS episodic, CASE WHEN g AND NOT s THEN 2.0 ELSE 1.0 END AS semantic
  FROM (SELECT id, regexp_matches(content, {q(P.SPECIFIC)}) AS s, {GENERAL_SQL} AS g FROM mem)""")
def _(m):
    e, s = S.store_weights(c("content"))
    return m.select("id", e.alias("episodic"), s.alias("semantic"))


@over_memories("h25_compression_level", f"""SELECT id, CASE WHEN is_protected OR store_type = 'semantic' OR h < 168 * k THEN 0 WHEN h < 720 * k THEN 1 ELSE 2 END AS level FROM (SELECT *, {AGE} AS h,
  CASE WHEN importance > 0.7 THEN 2.0 ELSE 1 END * CASE WHEN surprise > 0.6 THEN 1.5 ELSE 1 END * CASE WHEN confidence > 0.8 THEN 1.3 ELSE 1 END * CASE WHEN access_count > 10 THEN 1.5 ELSE 1 END AS k FROM mem)""")
def _(m):
    return m.select("id", S.compression_level(age(), c("importance"), c("surprise"), c("confidence"), c("access_count"), c("store_type"), c("is_protected")).alias("level"))


SENTENCE_SQL = r"list_filter(list_transform(string_split_regex(regexp_replace(content, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda s: trim(s)), lambda s: s <> '')"


@over_memories("h26_sentence_scores", f""", s AS (SELECT id, unnest({SENTENCE_SQL}) AS s FROM mem) SELECT id, count(*) AS n, sum(CASE WHEN regexp_matches(s, {q(P.FILE_PATH)}) THEN 3 ELSE 0 END + CASE WHEN regexp_matches(s, {q(P.ERROR_WORDS)}) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(s, {q(P.DECISION_WORDS)}) THEN 3 ELSE 0 END + CASE WHEN regexp_matches(s, {q(P.NUMBER_VERSION)}) THEN 2 ELSE 0 END + CASE WHEN regexp_matches(s, {q(P.CAMEL_NAME)}) THEN 2 ELSE 0 END
  + CASE WHEN contains(s, '`') THEN 2 ELSE 0 END)::DOUBLE AS score FROM s GROUP BY id""")
def _(m):
    return m.select("id", F.explode(X.sentences(c("content"))).alias("s")).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(S.sentence_score(c("s"))).alias("score"))


_domain_sql = ", ".join(
    f"""CASE WHEN round(0.3 * len(regexp_extract_all(content, {q(w)})) + 0.2 * len(regexp_extract_all(lower(array_to_string(tags, ' ')), {q(w)})) + {' + '.join(f"CASE WHEN contains(lower(content), '{t}') THEN 0.2 ELSE 0 END" for t in ts)}, 6) >= 0.3 THEN '{n}' END"""
    for n, w, ts, _ in P.DOMAINS
)


@over_memories("h28_domains", f"""SELECT id, coalesce(nullif(array_to_string(list_filter([{_domain_sql}], lambda x: x IS NOT NULL), ','), ''), 'code-patterns') AS domains FROM mem""")
def _(m):
    return m.select("id", F.array_join(S.domains(c("content"), c("tags")), ",").alias("domains"))


@over_memories("d14_domain_stats", f""", a AS (SELECT id, heat, unnest(list_filter([{_domain_sql}], lambda x: x IS NOT NULL)) AS domain FROM mem) SELECT domain, count(*) AS n, round(avg(heat), 6) AS heat FROM a GROUP BY domain""")
def _(m):
    # rows without a domain of their own are left to the default and not counted here
    named = F.filter(S.domains(c("content"), c("tags")), lambda d: d.isNotNull())
    own = F.when((F.size(named) == 1) & (named[0] == "code-patterns") & ~_scores_code(m), F.array().cast("array<string>")).otherwise(named)
    return m.select("heat", F.explode(own).alias("domain")).groupBy("domain").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("heat"), "heat"))


def _scores_code(m):
    name, words, types, _ = P.DOMAINS[0]
    score = 0.3 * F.regexp_count(c("content"), F.lit(words)) + 0.2 * F.regexp_count(F.lower(F.array_join("tags", " ")), F.lit(words))
    for kind in types:
        score = score + F.when(F.contains(F.lower("content"), F.lit(kind)), 0.2).otherwise(0.0)
    return F.round(score, 6) >= 0.3


# Extraction
@over_memories("h4_times", ", t AS (" + " UNION ALL ".join(f"SELECT id, '{k}' AS kind, unnest(list_transform(regexp_extract_all(content, {q(p)}, 1), lambda x: lower(x))) AS expression FROM mem" for k, p in P.TIMES) + ") SELECT id, kind, expression FROM t")
def _(m):
    return X.times(m, "id", "content")


@over_memories("h12_entities", ", t AS (" + " UNION ".join(f"SELECT DISTINCT id, unnest(regexp_extract_all(content, {q(p)}, 1)) AS name, '{k}' AS kind FROM mem" for k, p in X.ENTITY_FORMS) + f") SELECT DISTINCT id, name, kind FROM t WHERE kind <> 'file' OR regexp_matches(name, {q(P.CODE_SUFFIX)})")
def _(m):
    return X.entities(m, "id", "content")


@over_memories("h34_intentions", ", t AS (" + " UNION ALL ".join(f"SELECT id, trim(unnest(regexp_extract_all(content, {q(p)}, 1))) AS phrase FROM mem" for p in P.INTENTIONS) + ") SELECT id, phrase FROM t WHERE length(phrase) >= 5")
def _(m):
    return X.intentions(m, "id", "content")


_attr = " UNION ALL ".join(
    f"SELECT id, p[1] AS name, '{k}' AS kind, {q(y) if y else 'substr(replace(lower(trim(p[2])), chr(32), chr(95)), 1, 50)'} AS key, trim(p[2]) AS value, {cf} AS confidence FROM (SELECT id, unnest(list_zip(regexp_extract_all(content, {q(p)}, 1), regexp_extract_all(content, {q(p)}, 2))) AS p FROM mem)"
    for k, y, p, cf in P.ATTRIBUTES
)
ATTR_SQL = f"attr AS (SELECT * FROM ({_attr}) WHERE regexp_matches(name, '^[A-Z][a-z]+$') AND name NOT IN {P.NOT_NAMES} AND value <> '')"


@over_memories("h39_attributes", f", {ATTR_SQL} SELECT id, name, kind, key, value, confidence::DOUBLE AS confidence FROM attr")
def _(m):
    return X.attributes(m, "id", "content")


@over_memories("h40_profile_summary", f", {ATTR_SQL} SELECT name, kind, count(DISTINCT key) AS keys, string_agg(DISTINCT key, '; ' ORDER BY key) AS summary FROM attr GROUP BY ALL")
def _(m):
    keys = F.array_sort(F.collect_set("key"))
    return X.attributes(m, "id", "content").groupBy("name", "kind").agg(F.size(keys).cast("long").alias("keys"), F.array_join(keys, "; ").alias("summary"))


@query("h1_identifier_index", r"""SELECT id, CASE WHEN len(p) > 0 THEN t || ' ' || array_to_string(p, ' ') ELSE t END AS indexed FROM (SELECT *, flatten(list_transform(string_split_regex(t, '\s+'), lambda w:
  CASE WHEN len(string_split(replace(regexp_replace(w, '([a-z])([A-Z])', '\1 \2', 'g'), '_', ' '), ' ')) > 1 THEN list_filter(string_split(replace(regexp_replace(w, '([a-z])([A-Z])', '\1 \2', 'g'), '_', ' '), ' '), lambda x: x <> w) ELSE [] END)) AS p
  FROM (SELECT p_partkey AS id, p_name || ' ' || replace(p_name, ' ', '_') || ' partNameValue' AS t FROM part))""", "")
def _(spark, d):
    t = table(spark, d, "part").select(c("p_partkey").alias("id"), F.concat("p_name", F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(" partNameValue")).alias("t"))
    return t.select("id", X.identifier_parts(c("t")).alias("indexed"))


@over_memories("h31_contradictions", f""", n AS (SELECT id, directory, regexp_matches(content, {q(P.NEGATION)}) AS neg, list_distinct(list_transform(regexp_extract_all(content, {q(P.ACTION)}), lambda x: lower(x))) AS act FROM mem)
  SELECT a, b, n1 <> n2 OR (len(a1) > 0 AND len(a2) > 0 AND len(list_intersect(a1, a2)) = 0) AS contradicts FROM (SELECT lag(id) OVER w AS a, id AS b, lag(neg) OVER w AS n1, neg AS n2, lag(act) OVER w AS a1, act AS a2 FROM n WINDOW w AS (PARTITION BY directory ORDER BY id)) WHERE a IS NOT NULL""")
def _(m):
    w = Window.partitionBy("directory").orderBy("id")
    pairs = m.select(F.lag("id").over(w).alias("a"), c("id").alias("b"), F.lag("content").over(w).alias("ca"), c("content").alias("cb")).where("a is not null")
    return pairs.select("a", "b", S.contradicts(c("ca"), c("cb")).alias("contradicts"))


# Vectors and search
@over_vectors("f1_nearest", f"SELECT id, round(1 / (1 + {DIST_SQL.format(a='embedding', b=STATIC_SQL)}), 6) AS similarity FROM mem WHERE heat >= 0.1 ORDER BY similarity DESC, id LIMIT 10")
def _(m):
    return search.nearest(m, STATIC)


@over_vectors("f4_cosine_rank", f"SELECT id, round({DOT_SQL.format(a='embedding', b=STATIC_SQL)} / sqrt({DOT_SQL.format(a='embedding', b='embedding')}) / sqrt({DOT_SQL.format(a=STATIC_SQL, b=STATIC_SQL)}), 6) AS cosine FROM mem ORDER BY cosine DESC, id LIMIT 20")
def _(m):
    return search.top(m.select("id", r6(V.cosine(c("embedding"), V.constant(STATIC)), "cosine")), 20, "cosine")


# The stated query set: every memory whose id is divisible by 100, against all memories.
@over_vectors("f1_nearest_batch", f""", p AS (SELECT b.id AS query_id, a.id, round(1 / (1 + {DIST_SQL.format(a='a.embedding', b='b.embedding')}), 6) AS similarity FROM mem a, mem b WHERE a.heat >= 0.1 AND b.id % 100 = 0)
  SELECT query_id, id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM p) WHERE rank <= 10""")
def _(m):
    return search.nearest_batch(m, _asked_vectors(m))


def _asked_vectors(m):
    return m.where("id % 100 = 0").select(c("id").alias("query_id"), c("embedding").alias("query"))


TERMS = {"the": 1.0, "of": 1.0, "parser": 2.0, "architecture": 1.0, "postgres": 3.0}
BM25_SQL = f"""w AS (SELECT id, {TOK_SQL.format('content')} AS w FROM mem), st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w),
qt(term, qtf) AS (VALUES {', '.join(f"('{t}', {v}::DOUBLE)" for t, v in TERMS.items())}),
h AS (SELECT id, term, qtf, len(w) AS dl, len(list_filter(w, lambda x: x = term)) AS tf FROM w, qt), hh AS (SELECT * FROM h WHERE tf > 0),
df AS (SELECT term, count(*) AS df FROM hh GROUP BY term),
bm AS (SELECT id, round(sum(qtf * CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS bm25 FROM hh JOIN df USING (term), st GROUP BY id)"""


@over_memories("f3_bm25", f", {BM25_SQL} SELECT id, bm25 FROM bm ORDER BY bm25 DESC, id LIMIT 50")
def _(m):
    return search.bm25(m, TERMS)


HOT_SQL = "(SELECT * FROM mem WHERE embedding IS NOT NULL AND heat >= 0.3 ORDER BY heat DESC, id LIMIT 5000)"


@over_vectors("f5_hopfield", f""", s AS (SELECT id, {DOT_SQL.format(a='embedding', b=STATIC_SQL)} AS s FROM {HOT_SQL}), e AS (SELECT id, exp(8 * (s - max(s) OVER ())) AS e FROM s)
  SELECT id, round(e / sum(e) OVER (), 6) AS weight FROM e ORDER BY weight DESC, id LIMIT 20""")
def _(m):
    return search.top(search.hopfield(m, STATIC, min_heat=0.3), 20, "weight")


@over_vectors("f6_hopfield_sparse", f""", s AS (SELECT id, 8 * {DOT_SQL.format(a='embedding', b=STATIC_SQL)} AS z FROM {HOT_SQL}),
  k AS (SELECT id, z, row_number() OVER (ORDER BY z DESC, id) AS k, sum(z) OVER (ORDER BY z DESC, id ROWS UNBOUNDED PRECEDING) AS cz FROM s),
  t AS (SELECT (cz - 1) / k AS tau FROM k WHERE 1 + k * z > cz ORDER BY k DESC LIMIT 1) SELECT id, round(z - tau, 6) AS weight FROM k, t WHERE round(z - tau, 6) > 0""")
def _(m):
    return search.hopfield(m, STATIC, min_heat=0.3, sparse=True).where("weight > 0")


@over_vectors("f8_energy", f""", s AS (SELECT 8 * {DOT_SQL.format(a='embedding', b=STATIC_SQL)} AS z FROM {HOT_SQL}), mx AS (SELECT max(z) AS mx FROM s)
  SELECT 1 AS one, round(-(max(mx) + ln(sum(exp(z - mx)))) / 8 + 0.5 * {DOT_SQL.format(a=STATIC_SQL, b=STATIC_SQL)}, 6) AS energy FROM s, mx""")
def _(m):
    return search.energy(m, STATIC, min_heat=0.3).select(F.lit(1).alias("one"), "energy")


@over_vectors("h44_quantised", "SELECT id, list_sum(list_transform(embedding, lambda x: greatest(-127, least(127, CAST(round(x * 127) AS INTEGER))))) AS total FROM mem")
def _(m):
    return m.select("id", F.aggregate(V.quantised(c("embedding")), F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@over_vectors("h44_truncated", f", t AS (SELECT id, embedding[1:16] AS v FROM mem) SELECT id, round(v[1] / sqrt({DOT_SQL.format(a='v', b='v')}), 6) AS first, len(v) AS dims FROM t")
def _(m):
    v = V.truncated(c("embedding"), 16)
    return m.select("id", r6(v[0], "first"), F.size(v).cast("long").alias("dims"))


@over_vectors("d5_centroids", """, p AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM mem) GROUP BY ALL),
  n AS (SELECT label, sqrt(sum(x * x)) AS n FROM p GROUP BY label) SELECT p.label, round(x / n, 6) AS first, round(n, 6) AS length FROM p JOIN n USING (label) WHERE pos = 1""")
def _(m):
    raw = V.centroid(m, ["label"], "embedding", unit=False)
    return raw.select("label", r6(V.normalised(c("centroid"))[0], "first"), r6(V.norm(c("centroid")), "length"))


@over_vectors("c8_similar_pairs", f"""SELECT a.id AS a, b.id AS b, round({DOT_SQL.format(a='a.embedding', b='b.embedding')} / sqrt({DOT_SQL.format(a='a.embedding', b='a.embedding')}) / sqrt({DOT_SQL.format(a='b.embedding', b='b.embedding')}), 6) AS cosine
  FROM mem a JOIN mem b ON a.store_type = b.store_type AND a.id < b.id WHERE {DOT_SQL.format(a='a.embedding', b='b.embedding')} / sqrt({DOT_SQL.format(a='a.embedding', b='a.embedding')}) / sqrt({DOT_SQL.format(a='b.embedding', b='b.embedding')}) >= 0.35""")
def _(m):
    return relate.similar_pairs(m, 0.35, "store_type")


@over_vectors("i25_duplicate_merge", f""", p AS (SELECT a.id AS a, b.id AS b, a.heat AS ha, b.heat AS hb FROM mem a JOIN mem b ON a.store_type = b.store_type AND a.id < b.id
  WHERE {DOT_SQL.format(a='a.embedding', b='b.embedding')} / sqrt({DOT_SQL.format(a='a.embedding', b='a.embedding')}) / sqrt({DOT_SQL.format(a='b.embedding', b='b.embedding')}) >= 0.35)
  SELECT id, heat FROM mem WHERE id NOT IN (SELECT CASE WHEN ha >= hb THEN b ELSE a END FROM p)""")
def _(m):
    return m.select("id", "heat").join(relate.outranked(m, 0.35, "store_type"), "id", "left_anti")


@over_memories("c9_time_window", """SELECT a.id AS a, b.id AS b, CAST(epoch_us(b.created_at) // 1000000 - epoch_us(a.created_at) // 1000000 AS BIGINT) AS seconds FROM mem a JOIN mem b
  ON epoch_us(b.created_at) // 1000000 - epoch_us(a.created_at) // 1000000 BETWEEN 0 AND 1800 AND (epoch_us(a.created_at) // 1000000, a.id) < (epoch_us(b.created_at) // 1000000, b.id)""")
def _(m):
    return relate.time_neighbours(m, 30)


@over_memories("i38_synaptic_boost", """, p AS (SELECT b.id, max(a.heat) AS h FROM mem a JOIN mem b ON a.id <> b.id AND abs(epoch_us(b.created_at) // 1000000 - epoch_us(a.created_at) // 1000000) <= 1800 AND a.importance > 0.7 GROUP BY b.id)
  SELECT id, round(least(1.0, heat + 0.2 * coalesce(h, 0)), 6) AS heat FROM mem LEFT JOIN p USING (id)""")
def _(m):
    best = relate.time_maxima(m, c("importance") > 0.7, "heat", 30)
    return m.select("id", "heat").join(best, "id", "left").select("id", r6(F.least(F.lit(1.0), c("heat") + 0.2 * F.coalesce("best", F.lit(0.0))), "heat"))


# Fusion: vector, text and heat as three signals of one query
SIGNAL_SQL = f"""{BM25_SQL}, vec AS (SELECT id, round(1 / (1 + {DIST_SQL.format(a='embedding', b=STATIC_SQL)}), 6) AS s FROM mem WHERE heat >= 0.1 AND embedding IS NOT NULL ORDER BY s DESC, id LIMIT 60), hs AS (SELECT id, {DOT_SQL.format(a='embedding', b=STATIC_SQL)} AS s FROM {HOT_SQL}), he AS (SELECT id, exp(8 * (s - max(s) OVER ())) AS e FROM hs),
sig AS (SELECT id, 'vector' AS signal, s AS score FROM vec UNION ALL SELECT id, 'fts', bm25 FROM (SELECT id, bm25 FROM bm ORDER BY bm25 DESC, id LIMIT 50)
  UNION ALL SELECT id, 'hopfield', w FROM (SELECT id, round(e / sum(e) OVER (), 6) AS w FROM he ORDER BY w DESC, id LIMIT 40))"""
NORM_SQL = "nrm AS (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 0.5 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm FROM sig WHERE score > 0 WINDOW w AS (PARTITION BY signal))"
MIX = {"vector": 1.0, "fts": 0.5, "hopfield": 0.2}
WEIGHT_SQL = "CASE signal WHEN 'vector' THEN 1.0 WHEN 'fts' THEN 0.5 ELSE 0.2 END"


def signals(m):
    """Three signals of one query in long form."""
    q0 = F.lit(0).alias("query_id")
    vec = search.nearest(m, STATIC, 60).select(q0, "id", F.lit("vector").alias("signal"), c("similarity").alias("score"))
    fts = search.bm25(m, TERMS).select(q0, "id", F.lit("fts").alias("signal"), c("bm25").alias("score"))
    hot = search.top(search.hopfield(m, STATIC, min_heat=0.3), 40, "weight").select(q0, "id", F.lit("hopfield").alias("signal"), c("weight").alias("score"))
    return vec.unionByName(fts).unionByName(hot)


@over_memories("e1_min_max", f", {SIGNAL_SQL}, {NORM_SQL} SELECT id, signal, round(norm, 6) AS norm FROM nrm")
def _(m):
    return fusion.min_max(signals(m).where("score > 0")).select("id", "signal", r6(c("norm"), "norm"))


@over_memories("e1_z_score", f""", {SIGNAL_SQL}, z AS (SELECT id, signal, coalesce((score - avg(score) OVER w) / nullif(stddev_pop(score) OVER w, 0), 0) AS z FROM sig WINDOW w AS (PARTITION BY signal))
  SELECT id, signal, round(CASE WHEN max(z) OVER w = min(z) OVER w THEN 0.5 ELSE (z - min(z) OVER w) / (max(z) OVER w - min(z) OVER w) END, 6) AS norm FROM z WINDOW w AS (PARTITION BY signal)""")
def _(m):
    return fusion.z_score(signals(m)).select("id", "signal", r6(c("norm"), "norm"))


@over_memories("e2_max_norm", f", {SIGNAL_SQL} SELECT id, signal, round(score / max(score) OVER (PARTITION BY signal), 6) AS norm FROM sig")
def _(m):
    return fusion.max_norm(signals(m)).select("id", "signal", r6(c("norm"), "norm"))


@over_memories("e4_reciprocal_rank", f", {SIGNAL_SQL} SELECT id, round(sum(w / (60 + r)), 8) AS score FROM (SELECT id, {WEIGHT_SQL} AS w, row_number() OVER (PARTITION BY signal ORDER BY score DESC, id) AS r FROM sig) GROUP BY id")
def _(m):
    return fusion.reciprocal_rank(signals(m), MIX).select("id", "score")


CONF_SQL = """rk AS (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY score DESC, id) AS r FROM sig WHERE score > 0), st2 AS (SELECT signal, count(*) AS n, max(score) AS top, max(CASE WHEN r = 2 THEN score END) AS second FROM rk GROUP BY signal),
cf AS (SELECT signal, CASE signal WHEN 'vector' THEN least(1.0, top * (1 + coalesce(top - second, top))) WHEN 'fts' THEN least(1.0, n / 5) ELSE top END AS confidence FROM st2)"""


@over_memories("e5_signal_confidence", f", {SIGNAL_SQL}, {CONF_SQL} SELECT signal, round(confidence, 6) AS confidence FROM cf")
def _(m):
    return fusion.confidence(signals(m).where("score > 0")).select("signal", r6(c("confidence"), "confidence"))


CONVEX_SQL = f"""{SIGNAL_SQL}, {NORM_SQL}, {CONF_SQL}, wt AS (SELECT signal, CASE WHEN confidence < 0.1 THEN 0 ELSE {WEIGHT_SQL} END AS weight FROM cf),
fused AS (SELECT id, round(sum(weight / (SELECT sum(weight) FROM wt) * norm), 6) AS score FROM nrm JOIN wt USING (signal) GROUP BY id)"""


@over_memories("i2_convex_fusion", f", {CONVEX_SQL} SELECT id, score FROM fused")
def _(m):
    return fusion.convex(signals(m), MIX).select("id", "score")


@over_memories("i3_weighted_mnz", f", {SIGNAL_SQL}, {NORM_SQL} SELECT id, round(sum({WEIGHT_SQL} * norm) * count(*), 6) AS score FROM nrm GROUP BY id")
def _(m):
    return fusion.weighted(signals(m), MIX).select("id", "score")


@over_memories("i8_diversity", f", {SIGNAL_SQL} SELECT DISTINCT id FROM (SELECT id, row_number() OVER (PARTITION BY signal ORDER BY score DESC, id) AS r FROM sig) WHERE r <= 10")
def _(m):
    return fusion.diversity(signals(m)).select("id")


@over_memories("e6_result_confidence", f""", {CONVEX_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r FROM fused), t AS (SELECT max(score) AS s1, max(CASE WHEN r = 2 THEN score END) AS s2, avg(score) AS mean, stddev_pop(score) AS std FROM r),
  g AS (SELECT s1, (s1 - s2) / std AS gap, std / mean AS cv FROM t), v AS (SELECT *, round(0.4 * least(1, gap / 2) + 0.4 * least(1, 2 * s1) + 0.2 * least(1, 2 * cv), 6) AS confidence FROM g)
  SELECT confidence, confidence < 0.3 AS uncertain, confidence < 0.15 OR (s1 < 0.1 AND gap < 0.5) AS abstain FROM v""")
def _(m):
    return fusion.result_confidence(fusion.convex(signals(m), MIX)).select("confidence", "uncertain", "abstain")


@over_vectors("d17_retrieval_metrics", f""", rel AS (SELECT b.id AS query_id, a.id FROM mem a JOIN mem b ON a.label = b.label AND a.id <> b.id AND b.id % 100 = 0),
  p AS (SELECT b.id AS query_id, a.id, round(1 / (1 + {DIST_SQL.format(a='a.embedding', b='b.embedding')}), 6) AS s FROM mem a, mem b WHERE a.heat >= 0.1 AND b.id % 100 = 0),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM p), h AS (SELECT query_id, min(rank) AS f, count(*) AS hits, sum(1 / log2(rank + 1)) AS dcg FROM k JOIN rel USING (query_id, id) WHERE rank <= 10 GROUP BY query_id),
  n AS (SELECT query_id, count(*) AS wanted FROM rel GROUP BY query_id) SELECT query_id, round(coalesce(1 / f, 0), 6) AS mrr, round(coalesce(hits / wanted, 0), 6) AS recall,
  round(coalesce(dcg / list_sum(list_transform(range(1, least(wanted, 10) + 1), lambda i: 1 / log2(i + 1))), 0), 6) AS ndcg FROM n LEFT JOIN h USING (query_id)""")
def _(m):
    asked = m.where("id % 100 = 0").select(c("id").alias("query_id"), "label")
    relevant = asked.join(m.select("id", "label"), "label").where("id <> query_id").select("query_id", "id")
    return metrics.retrieval_metrics(search.nearest_batch(m, _asked_vectors(m)), relevant)


@over_memories("d17_token_f1", f""", p AS (SELECT a.id, {TOK_SQL.format('a.text')} AS p, {TOK_SQL.format('b.text')} AS t FROM mem a JOIN mem b ON b.id = a.id + 1),
  f AS (SELECT id, len(p) + len(t) AS n, list_sum(list_transform(list_distinct(p), lambda w: least(len(list_filter(p, lambda x: x = w)), len(list_filter(t, lambda x: x = w))))) AS k FROM p) SELECT id, round(2.0 * k / n, 6) AS f1 FROM f""")
def _(m):
    a, b = m.select("id", c("text").alias("p")), m.select((c("id") - 1).alias("id"), c("text").alias("t"))
    return metrics.token_f1(a.join(b, "id"), "p", "t")


# Aggregates
@over_memories("d1_stats", f"SELECT count(*) AS total, count(*) FILTER (heat >= 0.05) AS active, count(*) FILTER (heat < 0.05) AS archived, count(*) FILTER (is_stale) AS stale, round(avg(heat), 6) AS heat FROM mem")
def _(m):
    return m.agg(F.count(F.lit(1)).alias("total"), F.count_if(c("heat") >= 0.05).alias("active"), F.count_if(c("heat") < 0.05).alias("archived"), F.count_if("is_stale").alias("stale"), r6(F.avg("heat"), "heat"))


@over_memories("d2_heat_histogram", "SELECT least(4, CAST(floor(heat * 5) AS INTEGER)) AS bucket, count(*) AS n, sum(access_count)::BIGINT AS accesses, min(created_at) AS oldest, max(created_at) AS newest FROM mem GROUP BY ALL")
def _(m):
    return m.groupBy(F.least(F.lit(4), F.floor(c("heat") * 5).cast("int")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("access_count").alias("accesses"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))


@over_memories("d2_top_tags", "SELECT tag, n FROM (SELECT unnest(tags) AS tag, 1 AS one FROM mem) JOIN (SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM mem) GROUP BY tag) USING (tag) GROUP BY ALL ORDER BY n DESC, tag LIMIT 10")
def _(m):
    return m.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").limit(10)


@over_memories("d3_slot_occupancy", "SELECT slot, count(*) AS n, round(avg(plasticity), 6) AS excitability, round(max(heat), 6) AS hottest FROM mem GROUP BY slot")
def _(m):
    return m.groupBy("slot").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("plasticity"), "excitability"), r6(F.max("heat"), "hottest"))


@over_vectors("d4_cluster_directory", "SELECT label, directory, n FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, directory) AS r FROM (SELECT label, directory, count(*) AS n FROM mem GROUP BY ALL)) WHERE r = 1")
def _(m):
    n = m.groupBy("label", "directory").agg(F.count(F.lit(1)).alias("n"))
    return search.top_by(n, ["label"], 1, "n", "directory").drop("rank")


@over_vectors("d6_cluster_terms", f""", n AS (SELECT label, t, count(*) AS n FROM (SELECT label, unnest({TOK_SQL.format('content')}) AS t FROM mem) GROUP BY ALL)
  SELECT label, t, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, t) AS rank FROM n) WHERE rank <= 5""")
def _(m):
    n = m.select("label", F.explode(X.tokens(c("content"))).alias("t")).groupBy("label", "t").agg(F.count(F.lit(1)).alias("n"))
    return search.top_by(n, ["label"], 5, "n", "t")


@over_memories("d12_directory_model", "SELECT directory, count(*) AS n, round(avg(heat), 6) AS heat, count(DISTINCT tags[2]) AS tags, max(last_accessed) AS seen FROM mem GROUP BY directory")
def _(m):
    return m.groupBy("directory").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("heat"), "heat"), F.count_distinct(F.element_at("tags", 2)).alias("tags"), F.max("last_accessed").alias("seen"))


@over_memories("d13_agent_stats", f"SELECT agent, count(*) AS n, count(*) FILTER (regexp_matches(content, {q(P.CONFLICT_MARK)})) AS conflicts FROM mem GROUP BY agent")
def _(m):
    return m.groupBy("agent").agg(F.count(F.lit(1)).alias("n"), F.count_if(replicas.conflicted(c("content"))).alias("conflicts"))


@over_memories("d16_coverage", f"""SELECT directory, round(0.3 * CASE WHEN n = 0 THEN 0 WHEN n <= 2 THEN 0.3 WHEN n <= 5 THEN 0.6 ELSE 0.9 END + 0.3 * e + 0.2 * CASE WHEN d < 1 THEN 1.0 WHEN d < 7 THEN 0.7 WHEN d < 30 THEN 0.4 ELSE 0.2 END + 0.2 * cf, 6) AS coverage
  FROM (SELECT directory, count(*) AS n, count(*) FILTER (list_contains(tags, 'standard')) / count(*) AS e, min({AGE}) / 24 AS d, avg(confidence) AS cf FROM mem WHERE heat > 0.6 GROUP BY directory)""")
def _(m):
    s = m.where("heat > 0.6").groupBy("directory").agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.array_contains("tags", "standard")) / F.count(F.lit(1))).alias("e"), (F.min(age()) / 24).alias("d"), F.avg("confidence").alias("cf"))
    n, d = c("n"), c("d")
    density = F.when(n == 0, 0.0).when(n <= 2, 0.3).when(n <= 5, 0.6).otherwise(0.9)
    recency = F.when(d < 1, 1.0).when(d < 7, 0.7).when(d < 30, 0.4).otherwise(0.2)
    return s.select("directory", r6(0.3 * density + 0.3 * c("e") + 0.2 * recency + 0.2 * c("cf"), "coverage"))


# Sets, order, replicas
@over_memories("g3_set_difference", "SELECT id FROM mem WHERE heat >= 0.7 EXCEPT SELECT id FROM mem WHERE is_protected EXCEPT SELECT id FROM mem WHERE access_count > 15")
def _(m):
    return m.where("heat >= 0.7").select("id").join(m.where("is_protected").select("id"), "id", "left_anti").join(m.where("access_count > 15").select("id"), "id", "left_anti")


@over_memories("g1_union_distinct", "SELECT id, heat FROM mem WHERE heat >= 0.8 UNION SELECT id, heat FROM mem WHERE importance >= 0.8")
def _(m):
    return m.where("heat >= 0.8").select("id", "heat").unionByName(m.where("importance >= 0.8").select("id", "heat")).dropDuplicates(["id"])


@over_memories("g4_word_jaccard", f"""SELECT a.id, round(len(list_intersect(list_distinct(a.w), list_distinct(b.w))) / len(list_distinct(a.w || b.w)), 6) AS jaccard FROM (SELECT id, {TOK_SQL.format('content')} AS w FROM mem) a JOIN (SELECT id, {TOK_SQL.format('content')} AS w FROM mem) b ON b.id = a.id + 1""")
def _(m):
    w = m.select("id", F.array_distinct(X.tokens(c("content"))).alias("w"))
    return w.join(w.select((c("id") - 1).alias("id"), c("w").alias("v")), "id").select("id", r6(S.jaccard(c("w"), c("v")), "jaccard"))


@over_memories("e11_primacy_recency", "SELECT id, CASE WHEN r = 1 THEN 1 WHEN r = 2 THEN n ELSE r - 1 END AS position FROM (SELECT id, row_number() OVER (ORDER BY importance DESC, id) AS r, count(*) OVER () AS n FROM (SELECT id, importance FROM mem ORDER BY importance DESC, id LIMIT 12))")
def _(m):
    pool = search.top(m.select("id", "importance"), 12, "importance").withColumn("k", F.lit(0))
    w = Window.partitionBy("k")
    r, n = F.row_number().over(w.orderBy(F.desc("importance"), "id")), F.count(F.lit(1)).over(w)
    return pool.select("id", r.alias("r"), n.alias("n")).select("id", F.when(c("r") == 1, 1).when(c("r") == 2, c("n")).otherwise(c("r") - 1).cast("long").alias("position"))


@over_memories("e3_position_score", "SELECT id, round(1 / row_number() OVER (PARTITION BY directory ORDER BY created_at DESC, id), 6) AS score FROM mem")
def _(m):
    return m.select("id", r6(1 / F.row_number().over(Window.partitionBy("directory").orderBy(F.desc("created_at"), "id")), "score"))


@over_memories("e9_recent_stores", "SELECT session_id, id, r FROM (SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id) AS r FROM mem) WHERE r <= 10")
def _(m):
    return search.top_by(m.select("session_id", "id", "created_at"), ["session_id"], 10, "created_at", rank="r").drop("created_at")


@over_vectors("h30_topic_boundary", f""", p AS (SELECT session_id, id, embedding AS a, lag(embedding) OVER (PARTITION BY session_id ORDER BY created_at, id) AS b FROM mem)
  SELECT id, round(1 - {DOT_SQL.format(a='a', b='b')} / sqrt({DOT_SQL.format(a='a', b='a')}) / sqrt({DOT_SQL.format(a='b', b='b')}), 6) AS boundary FROM p WHERE b IS NOT NULL""")
def _(m):
    before = F.lag("embedding").over(Window.partitionBy("session_id").orderBy("created_at", "id"))
    return m.select("id", "embedding", before.alias("b")).where("b is not null").select("id", r6(1 - V.cosine(c("embedding"), c("b")), "boundary"))


@over_memories("h36_clock_order", """SELECT id, CASE WHEN (a < d OR b < e) AND (a > d OR b > e) THEN 'concurrent' WHEN a < d OR b < e THEN 'before' WHEN a > d OR b > e THEN 'after' ELSE 'equal' END AS ordering, greatest(a, d) + greatest(b, e) AS total
  FROM (SELECT id, id % 3 AS a, id % 4 AS b, id % 5 AS d, id % 2 AS e FROM mem)""")
def _(m):
    i = c("id")
    x, y = F.create_map(F.lit("p"), i % 3, F.lit("q"), i % 4), F.create_map(F.lit("p"), i % 5, F.lit("q"), i % 2)
    merged = replicas.merge_clocks(x, y)
    return m.select("id", replicas.compare_clocks(x, y).alias("ordering"), (merged["p"] + merged["q"]).alias("total"))


@over_memories("h38_resolve", rf"""SELECT id, trim(regexp_replace(list_filter(string_split_regex(content, {q(P.CONFLICT_MARK)}), lambda p: trim(p, chr(10) || ' ') <> '')[-1], '^\n+|\n+$', '', 'g')) AS latest FROM mem WHERE regexp_matches(content, {q(P.CONFLICT_MARK)})""")
def _(m):
    return m.where(replicas.conflicted(c("content"))).select("id", replicas.resolve(c("content"), "latest").alias("latest"))


@over_memories("c16_replica_merge", """, l AS (SELECT text AS content, max(heat) AS heat FROM mem WHERE agent <> 'agent-0' GROUP BY text), r AS (SELECT text AS content, max(heat) AS heat FROM mem WHERE access_count >= 8 GROUP BY text)
  SELECT coalesce(l.content, r.content) AS content, round(greatest(l.heat, r.heat), 6) AS heat, CASE WHEN l.content IS NULL THEN 'remote' WHEN r.content IS NULL THEN 'local' ELSE 'equal' END AS origin FROM l FULL JOIN r ON l.content = r.content""")
def _(m):
    side = lambda keep: m.where(keep).groupBy(c("text").alias("content")).agg(F.max("heat").alias("heat")).select("content", F.array(F.lit("x")).alias("tags"), "heat", F.lit(0.5).alias("importance"), F.create_map(F.lit("p"), F.lit(1)).alias("clock"))
    return replicas.merge_records(side("agent <> 'agent-0'"), side("access_count >= 8")).select("content", r6(c("heat"), "heat"), "origin")


@over_memories("f12_restore_sets", """, hot AS (SELECT id FROM mem ORDER BY heat DESC, id LIMIT 30), anchored AS (SELECT id FROM mem WHERE is_protected), recent AS (SELECT id FROM mem ORDER BY created_at DESC, id LIMIT 30)
  SELECT id, 'anchored' AS part FROM anchored UNION ALL SELECT id, 'recent' FROM recent WHERE id NOT IN (FROM anchored) UNION ALL SELECT id, 'hot' FROM hot WHERE id NOT IN (FROM anchored) AND id NOT IN (FROM recent)""")
def _(m):
    anchored = m.where("is_protected").select("id")
    recent, hot = search.top(m.select("id", "created_at"), 30, "created_at").select("id"), search.top(m.select("id", "heat"), 30, "heat").select("id")
    tag = lambda df, name: df.select("id", F.lit(name).alias("part"))
    return tag(anchored, "anchored").unionAll(tag(recent.join(anchored, "id", "left_anti"), "recent")).unionAll(tag(hot.join(anchored, "id", "left_anti").join(recent, "id", "left_anti"), "hot"))
