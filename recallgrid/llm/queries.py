"""Queries opN of the training-data operators over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.llm import chat, decontaminate, licenses, ngram_join, packing, quality, tiff, tokenfile, toxicity, urls

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
CAPACITY = 4096


def tokenizer_path(name: str = TOKENIZER) -> str:
    """The file of a public tokenizer."""
    try:
        import public_tokenizers
    except ImportError:
        sys.path.append(os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers"))
        import public_tokenizers
    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.read_token_file(tokenfile.write_token_file(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, lexicon)
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= 0.5).cast("int").alias("predicted"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["word_to"] - h["word_from"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(table(spark, sf_dir, "conversations"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_join(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, weights)
    return scored.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


def op9_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = tiff.text_to_media(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return tiff.media_digest(media).drop("error")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.cut_pieces(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID, CAPACITY), CAPACITY)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_token_files, op3_toxicity, op4_licenses, op5_decontaminate, op6_chat, op7_ngram_join, op8_quality, op9_tiff, op10_packing, pipeline)}

_CLEAN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words_sql(column: str) -> str:
    return f"list_filter(string_split_regex({_LOWER.format(f'coalesce({column}, {chr(39) * 2})')}, '{_CLEAN}'), lambda w: w <> '')"


_RULE_SQL = " ".join(
    f"WHEN (host = '{h}' OR suffix(host, '.{h}')) AND prefix(path, '{p}') THEN {{}}" for _, h, p in sorted(urls.RULES, key=lambda r: (-len(r[1] + r[2]), r))
)
_RULES_BY_LENGTH = sorted(urls.RULES, key=lambda r: (-len(r[1] + r[2]), r))


def _case(values: list[str]) -> str:
    return "CASE " + _RULE_SQL.format(*(f"'{v}'" for v in values)) + " END"


def _url_sql(s: urls.UrlSettings) -> str:
    """The same tree level by level; levels that no path reaches change nothing."""
    steps, prev = [], "t0"

    def level(d: int, name: str) -> str:
        stem = f"array_to_string(seg[1:{d - 1}], '/')" if d > 1 else "''"
        return f"{name} AS MATERIALIZED (SELECT *, {stem} AS stem, seg[{d}] AS part, CASE WHEN len(seg) > {d} THEN '/' || array_to_string(seg[{d + 1}:], '/') ELSE '' END AS rest FROM {prev})"

    def starred(d: int, source: str, marks: str, keys: str) -> str:
        return f"SELECT p.host, p.shape, p.n, p.bad, p.known, list_transform(p.seg, lambda x, i: CASE WHEN i = {d} AND v.mark THEN '*' ELSE x END) AS seg FROM {source} p LEFT JOIN {marks} v USING ({keys})"

    for d in range(1, s.levels + 1):
        steps.append(f"""{level(d, f"p{d}")},
v{d} AS (SELECT host, stem, true AS mark FROM p{d} WHERE len(seg) >= {d} GROUP BY host, stem HAVING count(DISTINCT part) >= {s.many} AND count(DISTINCT part) >= {s.fresh} * sum(n)),
t{d} AS MATERIALIZED ({starred(d, f"p{d}", f"v{d}", "host, stem")})""")
        prev = f"t{d}"
    for d in range(s.levels, 0, -1):
        steps.append(f"""{level(d, f"q{d}")},
c{d} AS (SELECT host, stem, part, rest, sum(n) AS n, sum(bad) AS bad, sum(known) AS known FROM q{d} WHERE len(seg) >= {d} GROUP BY ALL),
r{d} AS (SELECT host, stem, rest, sum(n) AS rest_n FROM c{d} GROUP BY ALL),
g{d} AS (SELECT host, stem, sum(n) AS all_n, coalesce(sum(bad)::DOUBLE / nullif(sum(known), 0), 0) AS share, count(DISTINCT rest) - 1 AS free FROM c{d} GROUP BY ALL HAVING count(DISTINCT part) > 1),
s{d} AS (SELECT host, stem, part, sum(c.n) AS n, sum(bad) AS bad, sum(known) AS known, sum(c.n::DOUBLE * c.n / rest_n) AS squares, sum(CASE WHEN rest <> '' AND rest_n > c.n THEN c.n ELSE 0 END) AS common FROM c{d} c JOIN r{d} USING (host, stem, rest) GROUP BY ALL),
l{d} AS (SELECT host, stem, part FROM s{d} JOIN g{d} USING (host, stem) WHERE (2 * common >= n OR known >= {s.strength}) AND round(all_n::DOUBLE / n * squares - n, 6) <= round(free + {s.z} * sqrt(2.0 * free), 6)
  AND round(abs(bad - share * known) / (known + 2), 6) <= round({s.z} * sqrt(greatest(0, share * (1 - share)) / (known + 2)), 6)),
a{d} AS (SELECT host, stem, part, true AS mark FROM l{d} JOIN (SELECT host, stem FROM l{d} GROUP BY ALL HAVING count(*) > 1) USING (host, stem)),
u{d} AS MATERIALIZED ({starred(d, f"q{d}", f"a{d}", "host, stem, part")})""")
        prev = f"u{d}"
    cut = s.levels - 1
    return rf"""
WITH u AS (SELECT page_id, {_LOWER.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, {_case([h + p for _, h, p in _RULES_BY_LENGTH])} AS rule, {_case([k for k, _, _ in _RULES_BY_LENGTH])} AS given,
  regexp_replace(regexp_replace(path, '^/', ''), '[^/]*[0-9][^/]*', '*', 'g') AS shape FROM u),
t0 AS MATERIALIZED (SELECT host, shape, count(*) AS n, count(*) FILTER (given = 'block') AS bad, count(given) AS known,
  CASE WHEN len(string_split(shape, '/')) <= {s.levels} THEN string_split(shape, '/') ELSE list_append(string_split(shape, '/')[1:{cut}], array_to_string(string_split(shape, '/')[{s.levels}:], '/')) END AS seg FROM r GROUP BY host, shape),
{", ".join(steps)},
m AS (SELECT host, shape, n, bad, known, array_to_string(seg, '/') AS node FROM {prev}),
z AS (SELECT host, node, round(sum(bad) / (sum(known) + {s.strength} + {s.doubt} * (sum(n) - sum(known))), 6) AS purity FROM m GROUP BY ALL)
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.given, CASE WHEN z.purity >= {s.purity} THEN 'block' ELSE 'allow' END) AS verdict
FROM r JOIN m ON r.host = m.host AND r.shape = m.shape JOIN z ON m.host = z.host AND m.node = z.node
"""


_DECONTAMINATE_SQL = f"""
WITH d AS (SELECT doc_id, {_words_sql('text')} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words_sql('text')} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item, least(len(w), 10) AS k, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda p: array_to_string(w[p:p + 9], ' '))) AS s FROM i WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM win),
places AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS p, w FROM d, ks WHERE len(w) >= k),
hit AS (SELECT doc_id, p, k, win.item FROM (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS s FROM places) x JOIN win USING (k, s)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_CHAT_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
p AS (SELECT DISTINCT conv_id, role AS participant FROM t WHERE role <> 'system'),
x AS (SELECT t.conv_id, participant, CAST(floor(turn / 256) AS BIGINT) AS block, turn, role, text,
  '<|im_start|>' || CASE WHEN role = participant THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || role END || chr(10) AS head FROM t JOIN p USING (conv_id)),
y AS (SELECT *, sum(len(head) + len(text) + 11) OVER (PARTITION BY conv_id, participant, block ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS past FROM x)
SELECT conv_id, participant, block, CAST(sum(sum(len(head) + len(text) + 11)) OVER (PARTITION BY conv_id, participant ORDER BY block) - sum(len(head) + len(text) + 11) AS BIGINT) AS start, count(*) AS n_turns, string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS rendered,
  coalesce(string_agg(CAST(past - 11 - len(text) AS BIGINT) || '-' || CAST(past - 1 AS BIGINT), ',' ORDER BY turn, role, text) FILTER (role = participant), '') AS mask
FROM y GROUP BY conv_id, participant, block
"""

ORACLES = {"op1_url_filters": _url_sql(urls.UrlSettings()), "op5_decontaminate": _DECONTAMINATE_SQL, "op6_chat": _CHAT_SQL}
