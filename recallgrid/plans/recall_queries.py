"""The flagship: hybrid recall, with SQL over five of its signals, and with all nine."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallgrid.functions import patterns as P
from recallgrid.operators import fusion, recall
from recallgrid.plans.memory_queries import DIST_SQL, DOT_SQL, STATIC, STATIC_SQL, TOK_SQL, c, over_memories
from recallgrid.plans.store_queries import NAMED_SQL

ASK = "Why did the Postgres parser raise ValueError in user_profile.py?"
FIVE = recall.RecallSettings(signals=("vector", "fts", "ppr", "spread", "hopfield"))
K, POOL, ROUNDS = 10, 200, 120


def _sql() -> str:
    terms = recall.boosted_terms(ASK)
    names = ", ".join(f"'{n}'" for n in recall.query_names(ASK))
    weight = "CASE signal " + " ".join(f"WHEN '{s}' THEN {float(FIVE.weights[s])}" for s in FIVE.signals) + " END"
    best = lambda name, source: f"{name} AS (SELECT id, s / max(s) OVER () AS s FROM (SELECT id, round(s, 6) AS s FROM ({source}) WHERE round(s, 6) > 0 ORDER BY 2 DESC, id LIMIT {POOL}))"
    steps = [
        f"w AS (SELECT id, {TOK_SQL.format('content')} AS w FROM mem), st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w)",
        "qt(term, qtf) AS (VALUES " + ", ".join(f"('{t}', {v}::DOUBLE)" for t, v in terms.items()) + ")",
        "hh AS (SELECT * FROM (SELECT id, term, qtf, len(w) AS dl, len(list_filter(w, lambda x: x = term)) AS tf FROM w, qt) WHERE tf > 0), df AS (SELECT term, count(*) AS df FROM hh GROUP BY term)",
        "bm AS (SELECT id, round(sum(qtf * CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS s FROM hh JOIN df USING (term), st GROUP BY id)",
        best("fts", "SELECT id, s FROM bm"),
        f"vec AS (SELECT id, round(1 / (1 + {DIST_SQL.format(a='embedding', b=STATIC_SQL)}), 6) AS s FROM mem WHERE heat >= 0.1 AND embedding IS NOT NULL ORDER BY s DESC, id LIMIT {POOL})",
        NAMED_SQL, "ed AS MATERIALIZED (SELECT a.name AS src, b.name AS dst, count(*)::DOUBLE AS weight FROM men a JOIN men b ON a.id = b.id AND a.name < b.name GROUP BY ALL)",
        "bw AS MATERIALIZED (SELECT src, dst, max(weight) AS weight FROM (SELECT src, dst, weight FROM ed UNION ALL SELECT dst, src, weight FROM ed) GROUP BY ALL), o AS MATERIALIZED (SELECT src, sum(weight) AS total FROM bw GROUP BY src)",
        f"sd AS MATERIALIZED (SELECT DISTINCT name AS id FROM men WHERE lower(name) IN ({names}))",
        "r0 AS MATERIALIZED (SELECT id, seed, seed AS rank, id NOT IN (SELECT src FROM o) AS ends FROM (SELECT id, CASE WHEN id IN (FROM sd) THEN 1.0::DOUBLE / (SELECT count(*) FROM sd) ELSE 0 END AS seed FROM (SELECT src AS id FROM bw UNION FROM sd)))",
    ]
    for t in range(ROUNDS):
        steps.append(f"""r{t + 1} AS MATERIALIZED (SELECT r.id, r.seed, 0.85 * (coalesce(g.got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{t} WHERE ends) * r.seed) + 0.15 * r.seed AS rank, r.ends
  FROM r{t} r LEFT JOIN (SELECT bw.dst AS id, sum(x.rank * bw.weight / o.total) AS got FROM bw JOIN o USING (src) JOIN r{t} x ON x.id = bw.src GROUP BY bw.dst) g USING (id))""")
    steps += [
        "seen AS (SELECT id, name FROM men WHERE id IN (SELECT id FROM mem WHERE heat >= 0.1))",
        best("ppr", f"SELECT seen.id, sum(rank) AS s FROM seen JOIN r{ROUNDS} r ON r.id = seen.name GROUP BY seen.id"),
        "s0 AS (SELECT DISTINCT name AS id, 1.0::DOUBLE AS a FROM men WHERE id IN (SELECT id FROM vec ORDER BY s DESC, id LIMIT 5)), s1 AS (SELECT bw.dst AS id, 0.5 AS a FROM bw JOIN s0 ON s0.id = bw.src), s2 AS (SELECT bw.dst AS id, 0.25 AS a FROM bw JOIN s1 ON s1.id = bw.src)",
        "act AS (SELECT id, max(a) AS a FROM (FROM s0 UNION ALL FROM s1 UNION ALL FROM s2) GROUP BY id)",
        best("spread", "SELECT seen.id, max(a) AS s FROM seen JOIN act ON act.id = seen.name GROUP BY seen.id"),
        f"hs AS (SELECT id, {DOT_SQL.format(a='embedding', b=STATIC_SQL)} AS s FROM (SELECT * FROM mem WHERE embedding IS NOT NULL AND heat >= 0.1 ORDER BY heat DESC, id LIMIT 5000)), he AS (SELECT id, exp(8 * (s - max(s) OVER ())) AS e FROM hs)",
        best("hop", "SELECT id, round(e / sum(e) OVER (), 6) AS s FROM he"),
        "sig AS (SELECT id, 'vector' AS signal, s AS score FROM vec UNION ALL SELECT id, 'fts', s FROM fts UNION ALL SELECT id, 'ppr', s FROM ppr UNION ALL SELECT id, 'spread', s FROM spread UNION ALL SELECT id, 'hopfield', s FROM hop)",
        "nrm AS (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 0.5 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm FROM sig WHERE score > 0 WINDOW w AS (PARTITION BY signal))",
        "st2 AS (SELECT signal, count(*) AS n, max(score) AS top, avg(score) AS mean, max(CASE WHEN r = 2 THEN score END) AS second FROM (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY score DESC, id) AS r FROM sig WHERE score > 0) GROUP BY signal)",
        "cf AS (SELECT signal, CASE WHEN signal = 'vector' THEN least(1.0, top * (1 + coalesce(top - second, top))) WHEN signal = 'fts' THEN least(1.0, n / 5) WHEN signal IN ('ppr', 'spread') THEN CASE WHEN n = 1 THEN top ELSE (top - mean) / top END ELSE top END AS confidence FROM st2)",
        f"wt AS (SELECT signal, CASE WHEN confidence < 0.1 THEN 0 ELSE {weight} END AS weight FROM cf)",
        "fused AS (SELECT id, round(sum(weight / (SELECT sum(weight) FROM wt) * norm), 6) AS score FROM nrm JOIN wt USING (signal) GROUP BY id)",
    ]
    bare = "list_filter(list_transform(string_split_regex(lower(content), '\\s+'), lambda t: regexp_replace(t, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')), lambda t: t <> '')"
    named, words, pairs = fusion.query_parts(ASK, P.STOP_WORDS)
    listed = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    steps.append(f"""rr AS (SELECT id, 0.35 * len(list_intersect({listed(named)}, w)) / {len(named)} + 0.30 * len(list_intersect({listed(words)}, w)) / {len(words)}
   + 0.20 * len(list_filter({listed(pairs)}, lambda b: contains(' ' || array_to_string(w, ' ') || ' ', ' ' || b || ' '))) / {len(pairs)} + CASE WHEN contains(low, '{ASK.lower()}') THEN 0.15 ELSE 0 END AS lex FROM (SELECT id, {bare} AS w, lower(content) AS low FROM mem WHERE heat >= 0.1))""")
    return ", " + ", ".join(steps) + f" SELECT id, round(0.85 * score + 0.15 * lex, 6) AS score FROM fused JOIN rr USING (id) ORDER BY score DESC, id LIMIT {K}"


@over_memories("i1_recall", _sql())
def _(m):
    m = recall.gathered(m)
    return recall.recall(m, recall.mentioned(m), ASK, STATIC, K, settings=FIVE)


@over_memories("i1_recall_all_signals", "")
def _(m):
    visits = m.select(c("session_id").alias("key"), F.col("last_accessed").alias("ts"), "id")
    m = recall.gathered(m)
    return recall.recall(m, recall.mentioned(m), ASK + " In January 2024, session 3", STATIC, K, visits=visits)
