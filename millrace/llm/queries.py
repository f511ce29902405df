"""The queries of this subpackage, and the SQL that expresses those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, html_text, language, merge_dropout, minhash, packing, quality_model, quality_rules, token_files, toxicity
from ._spark import ready, table


def op1_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), bound=0.3)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return token_files.round_trip(table(spark, sf_dir, "documents"), end_id=2)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return quality_rules.verdicts(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return minhash.classes(table(spark, sf_dir, "documents"), width=4)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return packing.pack(table(spark, sf_dir, "documents"), end_id=1)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fixed=0.5)


def op9_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return merge_dropout.encode(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return language.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""


_STOPS = ", ".join(f"'{x}'" for x in dict.fromkeys(quality_rules.STOP_WORDS))
_RULES = " AND ".join(
    " AND ".join(
        [f"{r.numerator} * {r.scale} >= {r.denominator} * {r.low}"] * (r.low is not None) + [f"{r.numerator} * {r.scale} <= {r.denominator} * {r.high}"] * (r.high is not None)
    )
    for r in quality_rules.RULES
)
OP5_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, unnest(generate_series(1, len(w) - 2)) AS i, w FROM w WHERE len(w) >= 3),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM g),
r AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + j AS p FROM k, (VALUES (0), (1), (2)) AS o(j) WHERE c >= 2) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
  len(lines) AS n_lines, len(list_filter(lines, lambda l: regexp_matches(l, '^[\x20\x09-\x0D]*[-*•–][\x20\x09]'))) AS n_bullet_lines,
  len(list_filter(lines, lambda l: regexp_matches(l, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines,
  len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS n_stop_words, len(list_filter(w, lambda x: regexp_matches(x, '\pL'))) AS n_alpha_words,
  len(regexp_extract_all(t, '!!')) AS n_shouts FROM w LEFT JOIN r ON r.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_RULES} AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
"""

OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
c AS (SELECT a, b FROM p UNION SELECT c.a, p.b FROM c JOIN p ON c.b = p.a),
m AS (SELECT a AS doc_id, min(b) AS low FROM c GROUP BY a)
SELECT g.doc_id, len(s) AS n_shingles, least(g.doc_id, coalesce(low, g.doc_id)) AS component_id, g.doc_id = least(g.doc_id, coalesce(low, g.doc_id)) AS kept FROM g LEFT JOIN m USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_quality_model": op1_quality_model, "op2_token_files": op2_token_files, "op3_exact_dedup": op3_exact_dedup, "op4_html_text": op4_html_text, "op5_quality_rules": op5_quality_rules, "op6_minhash": op6_minhash, "op7_packing": op7_packing, "op8_toxicity": op8_toxicity, "op9_merge_dropout": op9_merge_dropout, "op10_language": op10_language}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3_SQL, "op5_quality_rules": OP5_SQL, "op6_minhash": OP6_SQL}
