"""Markdown pages made from ``documents`` for the token queries, in Spark and in SQL.

Lines are marked by their place: headings, callouts, fences, signatures and blank lines in turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import edges, tokens


def _marked(line: Column, i: Column) -> Column:
    name = F.concat(F.lit("string fn"), (F.col("doc_id") % 17).cast("string"), F.when(F.col("doc_id") % 3 == 0, "(a)").otherwise("(a, b)"))
    k = i % 10
    return (
        F.when(k == 0, F.concat(F.lit("## "), F.substring(line, 1, 24)))
        .when(k == 3, F.concat(F.lit("**Note:** "), line))
        .when((k == 2) | (k == 4), "")
        .when((k == 5) | (k == 7), "```")
        .when(k == 8, name)
        .otherwise(line)
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    body = F.array_join(F.transform(F.split("text", "\n"), _marked), "\n")
    return docs.select(F.col("source").alias("module"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("page_url"), body.alias("body"))


def page_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tokens(pages(spark, sf_dir))


def page_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.infer(page_tokens(spark, sf_dir))


# fixed values in the SQL below: the patterns and weights of ``tokens.CALLOUTS``, ``RETURN_TYPES`` and ``CONTENT_WEIGHTS``, said a second time as the oracle
TOKENS_SQL = r"""
WITH raw AS (
    SELECT source AS module, 'doc/' || doc_id AS page_url, doc_id, unnest(string_split(text, chr(10))) AS l,
           generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
    FROM documents
), marked AS (
    SELECT module, page_url, i, CASE i % 10 WHEN 0 THEN '## ' || substr(l, 1, 24) WHEN 3 THEN '**Note:** ' || l WHEN 2 THEN '' WHEN 4 THEN '' WHEN 5 THEN '```' WHEN 7 THEN '```'
           WHEN 8 THEN 'string fn' || (doc_id % 17) || CASE WHEN doc_id % 3 = 0 THEN '(a)' ELSE '(a, b)' END ELSE l END AS line
    FROM raw
), headed AS (
    SELECT *, CASE WHEN regexp_matches(line, '^#{1,6}\s+.+') THEN trim(regexp_extract(line, '^#{1,6}\s+(.+)', 1)) END AS heading FROM marked
), numbered AS (
    SELECT *, count(heading) OVER w AS sec, coalesce(last_value(heading IGNORE NULLS) OVER w, '') AS section
    FROM headed WINDOW w AS (PARTITION BY page_url ORDER BY i)
), fenced AS (
    SELECT *, CASE WHEN starts_with(trim(line), '```') THEN 1 ELSE 0 END AS mark FROM numbered WHERE heading IS NULL
), inside AS (
    SELECT *, (sum(mark) OVER (PARTITION BY page_url, sec ORDER BY i) - mark) % 2 = 1 AS within FROM fenced
), stepped AS (
    SELECT *, trim(line) = '' AND NOT within AND mark = 0 AS blank,
           coalesce(lag(mark = 1 AND within) OVER (PARTITION BY page_url, sec ORDER BY i), false) AS after_close
    FROM inside
), blocked AS (
    SELECT *, sum(CASE WHEN (mark = 1 AND NOT within) OR blank OR after_close THEN 1 ELSE 0 END) OVER (PARTITION BY page_url, sec ORDER BY i) AS block FROM stepped
), paragraphs AS (
    SELECT module, page_url, section, min(i) AS first, string_agg(line, chr(10) ORDER BY i) AS content
    FROM blocked WHERE NOT blank GROUP BY module, page_url, sec, section, block
), counted AS (
    SELECT module, page_url, section, CAST(row_number() OVER (PARTITION BY page_url ORDER BY first) - 1 AS INTEGER) AS paragraph, content,
           regexp_replace(content, '^\s+|\s+$', '', 'g') AS t
    FROM paragraphs
), typed AS (
    SELECT *, CASE
        WHEN regexp_matches(t, '(?im)^(?:>\s*)?(?:\*\*|__)Very\s+Important[:.]?(?:\*\*|__)[:.]?\s*(.+)') THEN 'VERY_IMPORTANT'
        WHEN regexp_matches(t, '(?im)^(?:>\s*)?(?:\*\*|__)Important[:.]?(?:\*\*|__)[:.]?\s*(.+)') THEN 'IMPORTANT'
        WHEN regexp_matches(t, '(?im)^(?:>\s*)?(?:\*\*|__)(?:Pro\s*Tip|Tip)[:.]?(?:\*\*|__)[:.]?\s*(.+)') THEN 'PRO_TIP'
        WHEN regexp_matches(t, '(?im)^(?:>\s*)?(?:\*\*|__)Note[:.]?(?:\*\*|__)[:.]?\s*(.+)') THEN 'NOTE'
        WHEN starts_with(t, '```') THEN 'CODE_EXAMPLE'
        WHEN regexp_matches(t, '(?i)^(?:void|string|int|float|bool|list|map|bigint|decimal|date|datetime)\s+\w+\s*\(.*?\)') THEN 'SIGNATURE'
        WHEN len(list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '')) > 0
             AND len(list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '' AND NOT contains(x, '|'))) = 0 THEN 'TABLE_ROW'
        ELSE 'PROSE' END AS content_type
    FROM counted
), tokens AS (
    SELECT sha256(content || chr(0) || page_url || chr(0) || paragraph) AS token_sha, module, page_url, section, paragraph, content_type,
           CAST(CASE content_type WHEN 'CODE_EXAMPLE' THEN 1.0 WHEN 'SIGNATURE' THEN 0.9 WHEN 'PROSE' THEN 0.5 WHEN 'TABLE_ROW' THEN 0.4
                WHEN 'NOTE' THEN 0.6 WHEN 'IMPORTANT' THEN 1.0 WHEN 'VERY_IMPORTANT' THEN 1.2 WHEN 'PRO_TIP' THEN 0.5 END AS DOUBLE) AS weight, content
    FROM typed
)"""

EDGES_SQL = (
    TOKENS_SQL
    + r""", placed AS (
    SELECT *, lead(token_sha) OVER w AS next_sha, first_value(token_sha) OVER w AS anchor, row_number() OVER w AS k,
           last_value(CASE WHEN content_type NOT IN ('NOTE', 'PRO_TIP', 'IMPORTANT', 'VERY_IMPORTANT') THEN token_sha END IGNORE NULLS)
               OVER (PARTITION BY page_url, section ORDER BY paragraph RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS plain_before,
           last_value(CASE WHEN content_type = 'PROSE' THEN token_sha END IGNORE NULLS)
               OVER (PARTITION BY page_url, section ORDER BY paragraph RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prose_before
    FROM tokens WINDOW w AS (PARTITION BY page_url, section ORDER BY paragraph, token_sha)
), edges AS (
    SELECT anchor AS source_sha, token_sha AS target_sha, 'HIERARCHY' AS rel_type, CAST(1.0 AS DOUBLE) AS weight FROM placed WHERE k > 1
    UNION SELECT token_sha, next_sha, 'NEXT_SIBLING', 0.3 FROM placed WHERE next_sha IS NOT NULL
    UNION SELECT plain_before, token_sha, CASE content_type WHEN 'NOTE' THEN 'CALLOUT_NOTE' WHEN 'PRO_TIP' THEN 'CALLOUT_TIP' WHEN 'IMPORTANT' THEN 'CALLOUT_IMPORTANT' ELSE 'CALLOUT_CRITICAL' END,
          CASE content_type WHEN 'NOTE' THEN 0.5 WHEN 'PRO_TIP' THEN 0.6 WHEN 'IMPORTANT' THEN 0.8 ELSE 1.0 END
    FROM placed WHERE content_type IN ('NOTE', 'PRO_TIP', 'IMPORTANT', 'VERY_IMPORTANT') AND plain_before IS NOT NULL
    UNION SELECT prose_before, token_sha, 'EXAMPLE_OF', 0.6 FROM placed WHERE content_type = 'CODE_EXAMPLE' AND prose_before IS NOT NULL
)"""
)
