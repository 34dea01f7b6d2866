"""Queries over a stored index of the page tokens (phrases, modules, changes), and over the links of pages and their hosts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import links
from weftline.operators.lineage import cut, shared
from weftline.plans.pages import TOKENS_SQL, page_tokens
from weftline.sources import textindex

QUERIES, SQL = {}, {}

PHRASES = "fn1(a) thanedble rein"
IN_MODULE = ("fn2(a,b) atth", "src3")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _indexed(spark: SparkSession, tokens: DataFrame) -> str:
    path = f"{shared(spark)}/index-{uuid.uuid4().hex}"
    textindex.build(tokens.select("token_sha", "module", "content"), path)
    return path


def _search_sql(phrases: list[list[str]], most: int, module: str = "") -> str:
    def times(words: list[str]) -> str:
        return f"len(list_filter(range(1, len(t) + 1), lambda i: {' AND '.join(f'''t[i + {k}] = '{w}' ''' for k, w in enumerate(words))}))"

    found = " UNION ALL ".join(f"SELECT {i} AS phrase, token_sha, module, len(t) AS length, {times(p)} AS tf FROM cut" for i, p in enumerate(phrases))
    return f"""{TOKENS_SQL}, cut AS (SELECT token_sha, module, regexp_extract_all(lower(strip_accents(content)), '[\\p{{L}}\\p{{N}}]+') AS t FROM tokens),
        f AS (SELECT * FROM ({found}) WHERE tf > 0), d AS (SELECT phrase, count(*) AS df FROM f GROUP BY phrase), w AS (SELECT count(*) AS n, sum(len(t)) AS total FROM cut),
        s AS (SELECT token_sha, module, round(sum(greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 0.000001::DOUBLE) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length * n / total))), 6) AS score
              FROM f JOIN d USING (phrase) CROSS JOIN w {f"WHERE module = '{module}'" if module else ''} GROUP BY token_sha, module)
        SELECT token_sha, module, score FROM s ORDER BY score DESC, token_sha LIMIT {most}"""


@query(_search_sql([["fn1", "a"], ["thanedble"], ["rein"]], 50))
def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best tokens for words of which one is a phrase, from the buckets of its terms."""
    return textindex.search(spark, _indexed(spark, page_tokens(spark, sf_dir)), PHRASES, most=50).select("token_sha", "module", F.round("score", 6).alias("score"))


@query(_search_sql([["fn2", "a", "b"], ["atth"]], 40, "src3"))
def module_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One module's best tokens; frequencies are those of the whole index."""
    return textindex.search(spark, _indexed(spark, page_tokens(spark, sf_dir)), IN_MODULE[0], module=IN_MODULE[1], most=40).select("token_sha", "module", F.round("score", 6).alias("score"))


@query(TOKENS_SQL + r""", now AS (
        SELECT token_sha, CASE WHEN paragraph % 5 = 0 THEN 'Frèsh words ' || paragraph || ' fresh' ELSE content END AS content FROM tokens WHERE paragraph % 7 <> 0
    ), p AS (SELECT token_sha, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS place FROM (SELECT token_sha, regexp_extract_all(lower(strip_accents(content)), '[\p{L}\p{N}]+') AS t FROM now))
    SELECT term, token_sha, count(*) AS tf, CAST(min(place) AS INTEGER) AS first FROM p GROUP BY term, token_sha""")
def indexed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth paragraph changes, every seventh goes, in three batches of which one is run again before and after a compaction."""
    t = cut(page_tokens(spark, sf_dir).select("token_sha", "module", "paragraph", "content"))
    path = _indexed(spark, t)
    fresh = F.concat(F.lit("Frèsh words "), F.col("paragraph").cast("string"), F.lit(" fresh"))
    changes = t.filter("paragraph % 5 = 0").select("token_sha", "module", fresh.alias("content"), F.lit(False).alias("deleted"), F.lit(1).alias("version"))
    older = changes.withColumn("content", F.lit("too late")).withColumn("version", F.lit(0))
    gone = t.filter("paragraph % 7 = 0").select("token_sha", "module", F.lit(None).cast("string").alias("content"), F.lit(True).alias("deleted"), F.lit(2).alias("version"))
    textindex.apply_batch(path, older, 1)
    textindex.apply_batch(path, changes.unionByName(older), 2)
    textindex.apply_batch(path, changes.unionByName(older), 2)
    textindex.compact(spark, path)
    textindex.apply_batch(path, older, 1)
    textindex.apply_batch(path, gone, 3)
    return textindex.read(spark, path).select("term", "token_sha", F.size("positions").cast("long").alias("tf"), F.col("positions")[0].alias("first"))


@query(r"""WITH h AS (SELECT DISTINCT url AS page_url, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g'), '<a\s[^>]*?href="([^"]*)"', 1)) AS href FROM pages),
        t AS (SELECT page_url, regexp_replace(regexp_extract(page_url, '^(https?://[^/?#]+)', 1) || regexp_replace(href, '#.*$', ''), '[/?]+$', '') AS target FROM h WHERE starts_with(href, '/') AND NOT starts_with(href, '//'))
    SELECT DISTINCT page_url, target FROM t WHERE NOT regexp_matches(target, '^https?://[^/?#]+/([^?#]*/)?[^/?#]*\.[^./?#]+$') OR regexp_matches(target, '\.html?$')""")
def site_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of every page to pages of its own host."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("url").alias("page_url"), "html")
    return links.page_links(pages, same_section=False).select("page_url", "target").distinct()


ALIAS = {"alias.example.com": "main.example.com"}


@query(r"""WITH p AS (SELECT 'https://alias.example.com/p/' || page_id AS url, page_id, sha256(trim(regexp_replace(html, '\s+', ' ', 'g'))) AS h FROM pages WHERE html <> ''),
        r AS (SELECT *, row_number() OVER (ORDER BY md5(url), url) AS k FROM p), s AS (SELECT * FROM r WHERE k <= greatest(1, CAST(floor((SELECT count(*) FROM p) * 0.3::DOUBLE) AS BIGINT))),
        c AS (SELECT (SELECT count(*) FROM p) AS pool, count(*) AS sampled, count(*) FILTER (WHERE page_id % 5 <> 0) AS compared, count(*) FILTER (WHERE page_id % 5 <> 0 AND page_id % 7 <> 0) AS equal FROM s)
    SELECT 'alias.example.com' AS alias, 'main.example.com' AS canonical, *, equal / compared AS share, equal / compared >= 0.8 AS equivalent FROM c""")
def alias_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page under an alias host; its main host lacks every fifth and serves another text for every seventh."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").filter("html <> ''").select("page_id", "html")

    def under(name: str, html) -> DataFrame:
        return p.select(F.concat(F.lit(f"https://{name}/p/"), F.col("page_id").cast("string")).alias("url"), html.alias("html"), "page_id")

    main = under("main.example.com", F.when(F.col("page_id") % 7 == 0, F.lit("another text")).otherwise(F.col("html"))).filter("page_id % 5 <> 0")
    return links.alias_sample(under("alias.example.com", F.col("html")).unionByName(main).drop("page_id"), ALIAS)
