"""The queries of this subpackage over the standard tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, html_extraction, jaccard_join, language_id, lm_scoring, mixing, packing, pii, quality_classifier, quality_rules
from .common import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(f):
    Q[f.__name__] = f
    return f


@query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.decide(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumnRenamed("id", "doc_id")


SQL["op1_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY h ORDER BY doc_id) = 1 AS kept, h AS text_sha256
FROM t WINDOW w AS (PARTITION BY h)
"""


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.decide(table(spark, sf_dir, "documents"))


SQL["op10_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
         md5('17|' || coalesce(doc_id::VARCHAR, '-') || '|' || coalesce(text, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, ([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE])[1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT] AS w,
             row_number() OVER (ORDER BY source NULLS LAST) AS nth, source_size * 3.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY cap / w, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
water AS (SELECT arg_min(level, cap / w) AS v FROM l WHERE level * w <= cap),
t AS (SELECT source, source_size, least(cap, coalesce(v * w, cap)) AS target FROM l LEFT JOIN water ON true),
f AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12) ELSE 0 END AS whole FROM t),
g AS (SELECT *, greatest(0, target - whole * source_size) AS lim FROM f),
c AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.whole, g.lim,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k ROWS UNBOUNDED PRECEDING) - d.size / 2.0 AS middle
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN lim > 0 AND middle <= lim THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.decide(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.decide(table(spark, sf_dir, "documents"))


SQL["op7_quality_rules"] = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
l AS (SELECT *, len(w)::BIGINT AS n_words, list_transform(generate_series(1, len(w) - 7), lambda i: array_to_string(w[i:i + 7], ' ')) AS win FROM w),
x AS (SELECT doc_id, n_words, unnest(win) AS h, unnest(generate_series(1, n_words - 7)) AS i FROM l WHERE n_words >= 8),
d AS (SELECT *, count(*) OVER (PARTITION BY doc_id, h) AS c FROM x),
g AS (SELECT doc_id, least(8, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i), 8)) AS covers FROM d WHERE c > 1),
r AS (SELECT doc_id, sum(covers)::BIGINT AS n FROM g GROUP BY doc_id),
f AS (SELECT doc_id, unnest(list_distinct(lines)) AS line FROM w),
m AS (SELECT doc_id, line, length(regexp_replace(line, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*', 'x', 'g')) AS nw,
             length(regexp_replace(line, '\PL+', '', 'g')) AS letters, length(regexp_replace(line, '\P{{Lu}}+', '', 'g')) AS caps,
             length(regexp_replace(line, '[^#*$%&|<>!]+', '', 'g')) AS marks FROM f),
k AS (SELECT doc_id, sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) AS left_chars FROM m
      WHERE NOT (letters = 0 OR marks > {quality_rules.MARKS_A_WORD} * nw OR (nw <= {quality_rules.SHORT_LINE} AND NOT regexp_matches(line, '{quality_rules.END_MARK.replace("'", "''")}')) OR (letters >= {quality_rules.MIN_LETTERS} AND caps > {quality_rules.CAPITALS} * letters)
                 OR regexp_matches(line, '(?i)^[\x20\x09-\x0D]*({quality_rules.MENU})[\x20\x09-\x0D]*$')
                 OR (nw <= {quality_rules.BOILERPLATE_WORDS} AND regexp_matches(line, '(?i){quality_rules.BOILERPLATE}'))) GROUP BY doc_id),
b AS (SELECT l.doc_id, n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(r.n, 0) AS n_repeat_words, coalesce(left_chars, 0) AS left_chars FROM l LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND left_chars >= {quality_rules.MIN_LEFT} * word_chars AS kept FROM b
"""


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.decide(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.decide(table(spark, sf_dir, "documents"))


@query
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.decide(table(spark, sf_dir, "documents"))


@query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.decide(table(spark, sf_dir, "documents"), width=3, percent=90)


SQL["op6_jaccard_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(w[i:i + 2], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, (SELECT min(b) FROM r WHERE r.a = s.doc_id) AS component_id FROM s
"""


@query
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_pages(table(spark, sf_dir, "pages"))
