"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardinal.llm import ann, bpe, chat, html_text, licenses, mixing, ngram_join, quality, secrets, suffix_dedup

TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), lambda vec_id: F.col(vec_id) % 100 == 0)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.probabilities(table(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=85)


def op7_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_counts(table(spark, sf_dir, "documents"), words=4, percent=85)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    return chat.digests(chat.format_conversations(log.unionByName(hostile)))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_ann": op3_ann,
    "op4_html_text": op4_html_text,
    "op5_quality_rules": op5_quality_rules,
    "op6_mix_sources": op6_mix_sources,
    "op7_ngram_join": op7_ngram_join,
    "op7_ngram_links": op7_ngram_links,
    "op8_secret_scan": op8_secret_scan,
    "op9_chat_format": op9_chat_format,
    "op10_license_scan": op10_license_scan,
}

_SPACE = r"[^\x20\x09-\x0D]"
_QUALITY_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{_SPACE}+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_SPACE}')) AS ls FROM d),
u AS (SELECT doc_id, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM w),
tri AS (SELECT doc_id, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
dup AS (SELECT doc_id, i, c IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, a, b, c) > 1 AS x FROM tri),
cov AS (SELECT doc_id, x OR coalesce(lag(x, 1) OVER o, false) OR coalesce(lag(x, 2) OVER o, false) AS y FROM dup WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, count(*) FILTER (WHERE y) AS n_repeat_words FROM cov GROUP BY doc_id),
m AS (SELECT doc_id, t, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
  CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS BIGINT) AS lettered,
  coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars BETWEEN 2 * n_words AND 25 * n_words AND 4 * n_symbols <= n_words AND 2 * n_dup_lines <= n_lines
  AND length(regexp_replace(t, '[^A-Z]', '', 'g')) <= length(regexp_replace(t, '[^a-z]', '', 'g')) AND 10 * (n_words - lettered) <= 6 * n_words AS kept FROM b
"""

_ESCAPED = "replace(replace({0}, chr(92), chr(92) || chr(92)), '<|', chr(92) || 'l|')"
_CHAT_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, chr(92) || '### Assistant: </turn> ok' FROM range(2) g(i)),
l AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
  CAST(sum(17 + length(replace({_ESCAPED.format("role")}, chr(10), chr(92) || 'n')) + length({_ESCAPED.format("text")})) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM l
"""

_PHRASES = ", ".join(f"('{p}', '{label}', {licenses.FREEDOM[label]}, {str(base).lower()})" for base, phrases in ((True, licenses.BASE_PHRASES), (False, licenses.MORE_PHRASES)) for p, label in phrases.items())
#: SPDX tags need a parser and are left out here; the tables hold none, and tests cover them.
_LICENSE_SQL = rf"""
WITH p(phrase, label, freedom, base) AS (VALUES {_PHRASES}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
u AS (SELECT doc_id, unnest(ws) AS a, generate_subscripts(ws, 1) - 1 AS i FROM d),
n AS (SELECT doc_id, i, concat_ws(' ', a, lead(a, 1) OVER o) AS two, concat_ws(' ', a, lead(a, 1) OVER o, lead(a, 2) OVER o, lead(a, 3) OVER o) AS four FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT doc_id, i FROM n WHERE two IN ('apache license', 'cc by', 'mit license') OR four = 'gnu general public license'),
g AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM h GROUP BY doc_id),
f AS (SELECT doc_id, label, freedom, base FROM (SELECT doc_id, ' ' || array_to_string(ws, ' ') || ' ' AS line FROM d) x, p WHERE contains(line, ' ' || phrase || ' ')),
s AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, min(freedom) AS score FROM f GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score FROM d LEFT JOIN g USING (doc_id) LEFT JOIN s USING (doc_id)
"""

_JOIN_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}+') AS ws FROM documents),
u AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS sh FROM d),
s AS (SELECT DISTINCT doc_id, md5(sh) AS sh FROM u),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x AS doc_id, x AS other FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.other),
k AS (SELECT doc_id, min(other) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(k.c, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""

_REPEATS_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, p, md5(substr(x, 2 * p + 1, 100)) AS m FROM (SELECT doc_id, x, unnest(range(CAST(length(x) / 2 - 49 AS BIGINT))) AS p FROM d WHERE length(x) >= 100)),
f AS (SELECT m, min(doc_id) AS least FROM w GROUP BY m),
g AS (SELECT doc_id, p FROM w JOIN f USING (m) WHERE least < doc_id),
o AS (SELECT *, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 50, true) AS fresh FROM g),
q AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM o),
runs AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM q GROUP BY doc_id, run),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM runs
  UNION ALL SELECT d.doc_id, coalesce(max(runs.b), 0), any_value(length(x)) // 2 FROM d LEFT JOIN runs USING (doc_id) GROUP BY d.doc_id),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS y FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
t AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(y)) AS kept_sha256 FROM d JOIN kept USING (doc_id) LEFT JOIN t USING (doc_id)
"""

ORACLES: dict[str, str] = {"op2_suffix_dedup": _REPEATS_SQL, "op5_quality_rules": _QUALITY_SQL, "op7_ngram_join": _JOIN_SQL, "op9_chat_format": _CHAT_SQL, "op10_license_scan": _LICENSE_SQL}
