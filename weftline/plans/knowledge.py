"""Queries from HTML pages to markdown and tokens, and look-ups, cases, names and checks over a token store."""

from __future__ import annotations

import html.entities

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import audit, cases, markdown, tokens, traverse
from weftline.operators.lineage import cut
from weftline.plans.pages import EDGES_SQL, TOKENS_SQL, page_edges, page_tokens

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- pages to markdown

# all named references of the standard, for the SQL
_NAMES = ", ".join("'{}': '{}'".format(k, v.replace("'", "''")) for k, v in sorted(html.entities.html5.items()))
_DECODED = f"""array_to_string(list_transform(regexp_extract_all(piece, '(&#?[0-9a-zA-Z]{{1,32}};|[^&]+|&)', 1), lambda x: CASE
            WHEN regexp_matches(x, '^&#[0-9]+;$') THEN chr(CAST(regexp_extract(x, '[0-9]+') AS INTEGER)) WHEN regexp_matches(x, '^&#[xX][0-9a-fA-F]+;$') THEN chr(CAST('0x' || regexp_extract(x, '^&#.([0-9a-fA-F]+)', 1) AS INTEGER))
            WHEN x LIKE '&_%' THEN coalesce(map_extract(MAP {{{_NAMES}}}, substr(x, 2))[1], x) ELSE x END), '')"""


def _cases(values: dict[str, str]) -> str:
    return "CASE name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " ELSE '' END"


# the tags of a page in order, with list depth, preformatted text and links as windows
MARKDOWN_SQL = f"""
WITH pieces AS (
    SELECT page_id, unnest(p) AS piece, generate_subscripts(p, 1) - 1 AS i
    FROM (
        SELECT page_id, regexp_extract_all(html, '(?s)(<!--.*?-->|<(?i:script)(?:\\s[^>]*)?>.*?</(?i:script)\\s*>|<(?i:style)(?:\\s[^>]*)?>.*?</(?i:style)\\s*>|</?[a-zA-Z](?:[^>"'']|"[^"]*"|''[^'']*'')*>|<[!?/][^>]*>|[^<]+|<)', 1) AS p FROM pages
    )
), flagged AS (
    SELECT *, regexp_matches(piece, '(?is)^<(script|style)(\\s[^>]*)?>.*</') AS raw FROM pieces
), tags AS (
    SELECT *, CASE WHEN raw THEN '' ELSE lower(regexp_extract(piece, '^</?([a-zA-Z][^\\s/>]*)', 1)) END AS name, starts_with(piece, '</') AS shut,
           coalesce(nullif(regexp_extract(piece, '(?i)\\shref\\s*=\\s*"([^"]*)"', 1), ''), regexp_extract(piece, '(?i)\\shref\\s*=\\s*''([^'']*)''', 1)) AS href_ FROM flagged
), placed AS (
    SELECT *, greatest(0, sum(CASE WHEN name IN ('ul', 'ol') THEN CASE WHEN shut THEN -1 ELSE 1 END ELSE 0 END) OVER w) AS depth,
           coalesce(last_value(CASE WHEN name = 'pre' THEN NOT shut END IGNORE NULLS) OVER w, false) AS pre, coalesce(last_value(CASE WHEN name = 'a' THEN NOT shut END IGNORE NULLS) OVER w, false) AS linked,
           last_value(CASE WHEN name = 'a' AND NOT shut THEN href_ END IGNORE NULLS) OVER w AS href, min(CASE WHEN name = 'a' AND shut THEN i END) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS link_end
    FROM tags WINDOW w AS (PARTITION BY page_id ORDER BY i ROWS UNBOUNDED PRECEDING)
), made AS (
    SELECT *, raw OR name = '' AND NOT regexp_matches(piece, '^<[!?/]') AS is_text, CASE
        WHEN (raw OR name = '' AND NOT regexp_matches(piece, '^<[!?/]')) AND linked AND link_end IS NULL THEN ''
        WHEN raw THEN regexp_extract(piece, '(?is)^<(?:script|style)[^>]*>(.*)</[a-z]+\\s*>$', 1)
        WHEN name = '' AND NOT regexp_matches(piece, '^<[!?/]') THEN {_DECODED}
        WHEN name = '' THEN ''
        WHEN shut THEN CASE WHEN regexp_matches(name, '^h[1-6]$') THEN chr(10) WHEN name = 'a' THEN '](' || coalesce(href, '') || ')' WHEN name = 'code' THEN CASE WHEN pre THEN '' ELSE '`' END ELSE {_cases(markdown.CLOSES)} END
        WHEN regexp_matches(name, '^h[1-6]$') THEN chr(10) || repeat('#', CAST(substr(name, 2, 1) AS INTEGER)) || ' '
        WHEN name = 'li' THEN chr(10) || repeat('  ', greatest(0, CAST(depth - 1 AS INTEGER))) || '- '
        WHEN name = 'div' AND regexp_matches(regexp_extract(piece, '(?i)\\sclass\\s*=\\s*["'']([^"'']*)', 1), '{markdown.CALLOUT_CLASSES}') THEN chr(10) || '> '
        WHEN name = 'a' THEN CASE WHEN link_end IS NULL THEN '' ELSE '[' END WHEN name = 'code' THEN CASE WHEN pre THEN '' ELSE '`' END
        ELSE {_cases(markdown.OPENS)} END AS out FROM placed
), moved AS (
    SELECT *, linked AND link_end IS NOT NULL AND (is_text OR name = 'a') AS goes FROM made
), joined AS (
    SELECT page_id, string_agg(out, '' ORDER BY CASE WHEN goes THEN link_end ELSE i END, CASE WHEN goes THEN i WHEN name = 'a' THEN 1073741824 ELSE -1 END) AS body FROM moved GROUP BY page_id
), markdowns AS (
    SELECT page_id, url, regexp_replace(regexp_replace(coalesce(body, ''), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') || chr(10) AS markdown FROM pages LEFT JOIN joined USING (page_id)
)"""


def _markdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return markdown.to_markdown(pages.select("page_id", "html"), "page_id")


@query(MARKDOWN_SQL + " SELECT page_id, nullif(trim(regexp_extract(markdown, '(?m)^# (.+)$', 1)), '') AS title, CAST(length(markdown) AS INTEGER) AS n_chars, sha256(markdown) AS hash FROM markdowns")
def html_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _markdowns(spark, sf_dir)
    return m.select("page_id", tokens.title(F.col("markdown")).alias("title"), F.length("markdown").alias("n_chars"), F.sha2("markdown", 256).alias("hash"))


_PAGE_TOKENS_SQL = (
    MARKDOWN_SQL
    + """, marked AS (
    SELECT 'web' AS module, 'page/' || page_id AS page_url, unnest(string_split(markdown, chr(10))) AS line, generate_subscripts(string_split(markdown, chr(10)), 1) - 1 AS i FROM markdowns
)"""
    + TOKENS_SQL[TOKENS_SQL.index(", headed AS (") :]
)


@query(_PAGE_TOKENS_SQL + " SELECT token_sha, module, page_url, section, paragraph, content_type, weight FROM tokens")
def html_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The start of the text pipeline: pages to markdown to tokens."""
    m = _markdowns(spark, sf_dir)
    return tokens.tokens(m.select(F.lit("web").alias("module"), F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("page_url"), F.col("markdown").alias("body"))).drop("content")


@query(r"""SELECT page_id, 'site/' || CASE WHEN trim(p, '/') = '' THEN 'index' ELSE replace(trim(p, '/'), '/', '_') END || '.md' AS md_path, CASE WHEN page_id % 2 = 0 THEN ['site', 'start', url] ELSE ['site', url] END AS crumbs,
    '"' || replace(replace(replace(replace(html, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '') || '"' AS quoted FROM (SELECT *, regexp_extract(url, '^[a-zA-Z][\w+.\-]*://[^/?#]*([^?#]*)', 1) AS p FROM pages)""")
def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    parent = F.when(F.col("page_id") % 2 == 0, "start")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        "page_id", markdown.markdown_path(F.col("url"), F.lit("site")).alias("md_path"), markdown.breadcrumb(F.col("url"), parent, F.lit("site")).alias("crumbs"),
        F.concat(F.lit('"'), markdown.yaml_escaped(F.col("html")), F.lit('"')).alias("quoted"),
    )


@query(r"""WITH h AS (SELECT page_id, url, sha256(trim(regexp_replace(html, '\s+', ' ', 'g'))) AS content_hash FROM pages)
    SELECT page_id, url, content_hash FROM h WHERE page_id % 3 = 0 OR page_id % 5 = 0""")
def changed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest lacks every third page and has an old hash of every fifth."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    key = F.concat("url", F.lit("#"), F.col("page_id").cast("string"))
    p = p.withColumn("url", key)
    h = tokens.content_hash(F.col("html"))
    manifest = p.filter("page_id % 3 <> 0").select("url", F.when(F.col("page_id") % 5 == 0, "old").otherwise(h).alias("content_hash"))
    return markdown.changed(p, manifest, h).select("page_id", F.regexp_replace("url", "#[^#]*$", "").alias("url"), "content_hash")


_CRAWL = "SELECT 'd' || doc_id AS source_sha, 'd' || (doc_id * 2 + k) % (SELECT count(*) FROM documents) AS target_sha FROM documents, (VALUES (0), (1)) v(k)"


@query(f"""WITH RECURSIVE l AS ({_CRAWL}), w(node, depth) AS (SELECT 'd1', 0 UNION SELECT l.target_sha, depth + 1 FROM w JOIN l ON l.source_sha = w.node WHERE depth < 5),
    d AS (SELECT node, min(depth) AS depth FROM w GROUP BY node)
    SELECT d.node AS url, CAST(d.depth AS INTEGER) AS depth, min(l.source_sha) FILTER (WHERE u.depth = d.depth - 1) AS parent_url FROM d LEFT JOIN l ON l.target_sha = d.node LEFT JOIN d u ON u.node = l.source_sha GROUP BY ALL""")
def crawl_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    n = docs.agg(F.count("*").alias("n"))
    to = ((F.col("doc_id") * 2 + F.col("k")) % F.col("n")).cast("string")
    links = docs.crossJoin(F.broadcast(n)).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_sha"), F.concat(F.lit("d"), to).alias("target_sha"))  # one row
    links = cut(links)
    return markdown.crawl(links, traverse.bfs(links, spark.createDataFrame([("d1",)], "node string"), 5))


# --- look-ups


@query(TOKENS_SQL + " SELECT token_sha, module, content_type FROM tokens WHERE contains(lower(content), 'fn1') AND module = 'src1' AND content_type IN ('SIGNATURE', 'PROSE') ORDER BY module, page_url, paragraph, token_sha LIMIT 20")
def token_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.search(page_tokens(spark, sf_dir), "FN1", "src1", ["SIGNATURE", "PROSE"]).select("token_sha", "module", "content_type")


@query(TOKENS_SQL + " SELECT content FROM tokens WHERE contains(lower(content), 'an') AND content_type = 'CODE_EXAMPLE' ORDER BY module, page_url, paragraph, token_sha LIMIT 10")
def pattern_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.patterns(page_tokens(spark, sf_dir), "an")


_NAMES = """, names AS (SELECT token_sha, CASE WHEN row_number() OVER (PARTITION BY n ORDER BY page_url, token_sha) > 1 THEN n || '_' || substr(token_sha, 1, 8) ELSE n END AS name
    FROM (SELECT *, module || '.' || CASE WHEN section = '' THEN 'root' ELSE section END || '.p' || paragraph AS n FROM tokens))"""


@query(TOKENS_SQL + _NAMES + " SELECT * FROM names")
def entity_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.names(page_tokens(spark, sf_dir))


@query(EDGES_SQL + f""" SELECT CASE rel_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in cases.KINDS.items())} ELSE 'CONTAINS' END AS kind, rel_type, count(*) AS n FROM edges GROUP BY ALL""")
def edge_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.relation_kinds(page_edges(spark, sf_dir)).groupBy("kind", "rel_type").agg(F.count("*").alias("n"))


_ASKED = ["fn1", "string", "missingword", "absentname"]


@query(EDGES_SQL + _NAMES + r""", asked AS (SELECT unnest(['fn1', 'string', 'missingword', 'absentname']) AS entity UNION ALL SELECT min(name) FROM names UNION ALL SELECT max(token_sha) FROM tokens),
    w AS (SELECT token_sha, unnest(regexp_extract_all(lower(content), '[\p{L}\p{N}_]+')) AS word FROM tokens)
    SELECT entity, CASE WHEN entity IN (SELECT name FROM names) OR entity IN (SELECT token_sha FROM tokens) THEN 'true' ELSE 'mentioned_in_' || substr((SELECT min(token_sha) FROM w WHERE word = lower(entity)), 1, 8) END AS answer FROM asked""")
def premise_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = page_tokens(spark, sf_dir)
    asked = spark.createDataFrame([(x,) for x in _ASKED], "entity string").union(cases.names(t).agg(F.min("name"))).union(t.agg(F.max("token_sha")))
    return cases.ask(asked, t, page_edges(spark, sf_dir))


_CASES = "SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 40 = 0 THEN text ELSE 'case ' || doc_id || ' of its own kind' END AS text, CASE WHEN doc_id % 60 = 0 THEN '' ELSE 'x' END AS learned, CASE WHEN doc_id % 100 = 0 THEN 'nowhereword' ELSE 'fn' || doc_id % 17 END AS query FROM documents WHERE doc_id % 20 = 0"


def _new_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new cases are made from the documents whose id is divisible by 20."""
    k = F.col("doc_id")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id % 20 = 0")
    text = F.when(k % 40 == 0, F.col("text")).otherwise(F.concat(F.lit("case "), k.cast("string"), F.lit(" of its own kind")))
    word = F.when(k % 100 == 0, "nowhereword").otherwise(F.concat(F.lit("fn"), (k % 17).cast("string")))
    return docs.select(k.cast("string").alias("id"), text.alias("text"), F.when(k % 60 == 0, "").otherwise("x").alias("learned"), word.alias("query"))


@query(TOKENS_SQL + rf""", c AS ({_CASES}), cw AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS w FROM c),
    tw AS (SELECT list_distinct(list_filter(regexp_split_to_array(lower(content), '\s+'), lambda w: w <> '')) AS w FROM tokens), terms AS (SELECT DISTINCT unnest(regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}]+')) AS t FROM tokens),
    near AS (SELECT DISTINCT id FROM cw JOIN tw ON len(cw.w) > 0 AND len(tw.w) > 0 AND len(list_intersect(cw.w, tw.w)) / least(len(cw.w), len(tw.w)) > 0.6),
    r AS (SELECT id, CASE WHEN trim(coalesce(text, '')) = '' OR trim(learned) = '' THEN 'empty' WHEN text IN (SELECT content FROM tokens) THEN 'duplicate' WHEN id IN (SELECT id FROM near) THEN 'near duplicate'
        WHEN query NOT IN (SELECT t FROM terms) THEN 'unrelated' ELSE 'ok' END AS reason FROM c) SELECT id, reason = 'ok' AS valid, reason FROM r""")
def case_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.validated(_new_cases(spark, sf_dir), cut(page_tokens(spark, sf_dir)))


@query(TOKENS_SQL + rf""", c AS ({_CASES}), i AS (SELECT DISTINCT token_sha, content_type, unnest(regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}]+')) AS t FROM tokens)
    SELECT id, token_sha AS target_sha, CASE content_type WHEN 'CODE_EXAMPLE' THEN 'EXAMPLE_OF' WHEN 'IMPORTANT' THEN 'CALLOUT_IMPORTANT' WHEN 'VERY_IMPORTANT' THEN 'CALLOUT_IMPORTANT' WHEN 'NOTE' THEN 'CALLOUT_NOTE' ELSE 'LEARNED_FROM' END AS rel_type,
        CAST(CASE content_type WHEN 'CODE_EXAMPLE' THEN 0.8 WHEN 'IMPORTANT' THEN 0.9 WHEN 'VERY_IMPORTANT' THEN 0.9 WHEN 'NOTE' THEN 0.7 ELSE 0.95 END AS DOUBLE) AS weight
    FROM c JOIN i ON t = query QUALIFY row_number() OVER (PARTITION BY id ORDER BY token_sha) <= 20""")
def related_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.related(_new_cases(spark, sf_dir), page_tokens(spark, sf_dir))


_APP = TOKENS_SQL + ", app AS (SELECT * REPLACE (CASE WHEN paragraph % 11 = 0 THEN 'doc/' || module || '/overview' ELSE page_url END AS page_url) FROM tokens)"


def _app(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eleventh paragraph stands on its module's overview page."""
    return page_tokens(spark, sf_dir).withColumn("page_url", F.when(F.col("paragraph") % 11 == 0, F.concat(F.lit("doc/"), F.col("module"), F.lit("/overview"))).otherwise(F.col("page_url")))


@query(_APP + """, p AS (SELECT *, lead(token_sha) OVER w AS nxt, lead(content_type) OVER w AS nt FROM app WINDOW w AS (PARTITION BY page_url ORDER BY paragraph, token_sha)),
    o AS (SELECT module, last(token_sha ORDER BY paragraph, token_sha) AS overview FROM app WHERE page_url LIKE '%/overview' GROUP BY module),
    e AS (SELECT overview AS s, token_sha AS t, 'HIERARCHY' AS rel_type, 1.0 AS weight FROM p JOIN o USING (module) WHERE overview <> token_sha UNION ALL SELECT token_sha, nxt, 'NEXT_SIBLING', 0.3 FROM p WHERE nxt IS NOT NULL
        UNION ALL SELECT token_sha, nxt, 'EXAMPLE_OF', 0.6 FROM p WHERE content_type = 'PROSE' AND nt = 'CODE_EXAMPLE')
    SELECT s AS source_sha, t AS target_sha, rel_type, CAST(weight AS DOUBLE) AS weight FROM e""")
def app_token_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.app_edges(_app(spark, sf_dir))


@query(TOKENS_SQL + r""", f AS (SELECT lower(regexp_extract(content, '(\w+)\s*\(', 1)) AS name, min(token_sha) AS doc FROM tokens WHERE content_type = 'SIGNATURE' AND regexp_matches(content, '(\w+)\s*\(') GROUP BY 1), c AS (
    SELECT DISTINCT token_sha, unnest(regexp_extract_all(lower(content), '(\w+)', 1)) AS word FROM (SELECT token_sha, 'x = fn' || paragraph % 40 || '(a); ' || content AS content FROM tokens WHERE content_type = 'CODE_EXAMPLE'))
    SELECT DISTINCT c.token_sha AS source_sha, doc AS target_sha, 'CROSS_MODULE' AS rel_type, CAST(0.9 AS DOUBLE) AS weight FROM c JOIN f ON word = name WHERE length(name) > 3""")
def code_function_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = page_tokens(spark, sf_dir)
    name = F.lower(F.regexp_extract("content", r"(\w+)\s*\(", 1))
    functions = t.filter("content_type = 'SIGNATURE'").select(name.alias("name"), F.col("token_sha").alias("doc_sha")).filter("name <> ''")
    code = t.filter("content_type = 'CODE_EXAMPLE'").withColumn("content", F.concat(F.lit("x = fn"), (F.col("paragraph") % 40).cast("string"), F.lit("(a); "), "content"))
    return cases.code_references(code, functions)


# --- totals


@query(TOKENS_SQL + r", d AS (SELECT *, paragraph % 3 AS depth FROM tokens) SELECT count(DISTINCT module) AS n_modules, count(DISTINCT page_url) AS n_pages, count(*) FILTER (WHERE depth = 0) AS n_seeds, count(*) FILTER (WHERE depth > 0) AS n_expanded, CAST(sum(len(list_filter(regexp_split_to_array(content, '\s+'), lambda w: w <> ''))) AS BIGINT) AS n_words FROM d")
def retrieval_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.retrieval_stats(page_tokens(spark, sf_dir).withColumn("depth", F.col("paragraph") % 3))


@query(EDGES_SQL + r""", s AS (SELECT lower(regexp_extract(content, '(\w+)\s*\(([^)]*)\)', 1)) AS f, len(list_filter(string_split(regexp_extract(content, '(\w+)\s*\(([^)]*)\)', 2), ','), lambda p: trim(p) <> '')) AS n
        FROM tokens WHERE content_type = 'SIGNATURE' AND regexp_matches(content, '(\w+)\s*\(([^)]*)\)')),
    x AS (SELECT source_sha AS s, CASE WHEN ascii(target_sha) % 2 = 0 THEN 'gone' ELSE target_sha END AS t FROM edges WHERE rel_type = 'NEXT_SIBLING'),
    c AS (SELECT 'orphan_token' AS "check", count(*) AS n FROM tokens t WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE rel_type = 'HIERARCHY' AND (e.source_sha = t.token_sha OR e.target_sha = t.token_sha))
        UNION ALL SELECT 'broken_reference', count(*) FROM x WHERE t NOT IN (SELECT token_sha FROM tokens) UNION ALL SELECT 'shadow_field', count(*) FROM (VALUES ('fn1'), ('missingword'), ('absentname')) v(name) WHERE NOT EXISTS (SELECT 1 FROM tokens WHERE regexp_matches(lower(content), '\b' || name || '\b'))
        UNION ALL SELECT 'inconsistent_signature', count(*) FROM (SELECT f FROM s GROUP BY f HAVING count(DISTINCT n) > 1))
    SELECT * FROM c UNION ALL SELECT 'residual', CAST(sum(n) AS BIGINT) FROM c""")
def store_self_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks at once; of the sibling edges half are read as cross-references to a token that is gone."""
    t, e = cut(page_tokens(spark, sf_dir)), cut(page_edges(spark, sf_dir))
    target = F.when(F.ascii("target_sha") % 2 == 0, "gone").otherwise(F.col("target_sha"))
    crossed = e.filter("rel_type = 'NEXT_SIBLING'").select("source_sha", target.alias("target_sha"), F.lit("CROSS_REFERENCE").alias("rel_type"))
    absent = spark.createDataFrame([("fn1",), ("missingword",), ("absentname",)], "name string")
    return cases.store_residual(audit.orphan_tokens(t, e), audit.broken_references(t, crossed), audit.uncovered_names(t, absent), audit.inconsistent_signatures(t))


@query(TOKENS_SQL + r""", p AS (SELECT token_sha, unnest(regexp_extract_all(lower(CASE WHEN paragraph % 5 = 0 THEN 'fresh words' ELSE content END), '[\p{L}\p{N}]+')) AS term FROM tokens) SELECT term, count(DISTINCT token_sha) AS df, count(*) AS tf FROM p GROUP BY term""")
def index_maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth paragraph changes: its postings go and new ones come."""
    from weftline.operators.retrieval import postings, term_counts

    t = cut(page_tokens(spark, sf_dir))
    changed = t.filter("paragraph % 5 = 0")
    index = cases.updated_counts(term_counts(t), changed, changed.withColumn("content", F.lit("fresh words")))
    return postings(index).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
