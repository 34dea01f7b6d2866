"""Queries over tokens, edges, traversal and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import audit, edges, retrieval, tokens, traverse
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


ASKED = "thanedble rein"
NAMES = ["fn1", "fn5", "the", "missingword", "absentname"]


@query(TOKENS_SQL + " SELECT token_sha, module, page_url, section, paragraph, content_type, weight FROM tokens")
def tokenize_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_tokens(spark, sf_dir).drop("content")


@query(TOKENS_SQL + " SELECT module, content_type, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS n_chars FROM tokens GROUP BY ALL")
def content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_tokens(spark, sf_dir).groupBy("module", "content_type").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("n_chars"))


@query(EDGES_SQL + " SELECT * FROM edges")
def infer_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_edges(spark, sf_dir)


@query(EDGES_SQL + " SELECT rel_type, count(*) AS n, CAST(round(sum(weight), 6) AS DOUBLE) AS total FROM edges GROUP BY rel_type")
def edge_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_edges(spark, sf_dir).groupBy("rel_type").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("total"))


@query(EDGES_SQL + " SELECT source_sha, count(*) AS out_degree FROM edges GROUP BY source_sha")
def out_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.degrees(page_edges(spark, sf_dir))


@query(EDGES_SQL + " SELECT (SELECT count(*) FROM (SELECT token_sha FROM tokens UNION SELECT source_sha FROM edges UNION SELECT target_sha FROM edges)) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges")
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.counts(page_tokens(spark, sf_dir), page_edges(spark, sf_dir))


@query(EDGES_SQL + " SELECT token_sha, page_url FROM tokens t WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE rel_type = 'HIERARCHY' AND (e.source_sha = t.token_sha OR e.target_sha = t.token_sha))")
def orphan_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.orphan_tokens(page_tokens(spark, sf_dir), page_edges(spark, sf_dir)).select("token_sha", "page_url")


@query(TOKENS_SQL + r""", s AS (
    SELECT token_sha, lower(regexp_extract(content, '(\w+)\s*\(([^)]*)\)', 1)) AS f, len(list_filter(string_split(regexp_extract(content, '(\w+)\s*\(([^)]*)\)', 2), ','), lambda p: trim(p) <> '')) AS n
    FROM tokens WHERE content_type = 'SIGNATURE' AND regexp_matches(content, '(\w+)\s*\(([^)]*)\)'))
    SELECT f AS "function", string_agg(DISTINCT CAST(n AS VARCHAR), ',' ORDER BY CAST(n AS VARCHAR)) AS counts, count(*) AS n_tokens FROM s GROUP BY f HAVING count(DISTINCT n) > 1""")
def signature_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.inconsistent_signatures(page_tokens(spark, sf_dir))


@query(TOKENS_SQL + r""" SELECT lower(regexp_extract(content, '(\w+)\s*\(([^)]*)\)', 1)) AS "function",
    CAST(max(len(list_filter(string_split(regexp_extract(content, '(\w+)\s*\(([^)]*)\)', 2), ','), lambda p: trim(p) <> ''))) AS INTEGER) AS n_params
    FROM tokens WHERE content_type = 'SIGNATURE' AND regexp_matches(content, '(\w+)\s*\(([^)]*)\)') GROUP BY 1""")
def widest_overloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.widest_overloads(page_tokens(spark, sf_dir))


@query(TOKENS_SQL + r""" SELECT name FROM (VALUES ('fn1'), ('fn5'), ('the'), ('missingword'), ('absentname')) v(name)
    WHERE NOT EXISTS (SELECT 1 FROM tokens WHERE regexp_matches(lower(content), '\b' || name || '\b'))""")
def function_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.uncovered_names(page_tokens(spark, sf_dir), spark.createDataFrame([(n,) for n in NAMES], "name string"))


@query(TOKENS_SQL + " SELECT token_sha AS source_sha, token_sha AS target_sha, 'FUNCTION_OF' AS rel_type, CAST(0.8 AS DOUBLE) AS weight FROM tokens WHERE content_type = 'SIGNATURE' AND (contains(lower(content), 'fn1') OR contains(lower(content), 'fn5'))")
def function_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.functions(page_tokens(spark, sf_dir), NAMES[:2])


@query(r"""WITH t AS (SELECT doc_id, source, 'doc/' || doc_id AS page_url FROM documents),
    l AS (SELECT page_url AS f, source, 'doc/' || (doc_id * 3 % 1500) || CASE WHEN doc_id % 2 = 0 THEN '#top' ELSE '/' END AS target FROM t),
    r AS (SELECT l.f, l.source, coalesce(a.page_url, b.page_url) AS to_url, coalesce(a.source, b.source) AS to_source FROM l
          LEFT JOIN t a ON a.page_url = l.target LEFT JOIN t b ON b.page_url = regexp_replace(regexp_replace(l.target, '#.*$', ''), '/+$', ''))
    SELECT DISTINCT sha256('x' || chr(0) || f || chr(0) || '0') AS source_sha, sha256('x' || chr(0) || to_url || chr(0) || '0') AS target_sha,
           CASE WHEN source <> to_source THEN 'CROSS_MODULE' ELSE 'CROSS_REFERENCE' END AS rel_type, CAST(CASE WHEN source <> to_source THEN 0.9 ELSE 0.7 END AS DOUBLE) AS weight
    FROM r WHERE to_url IS NOT NULL AND f <> to_url""")
def reference_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    url = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    t = docs.select("doc_id", F.col("source").alias("module"), url.alias("page_url"), F.lit(0).alias("paragraph"))
    t = t.withColumn("token_sha", tokens.token_sha(F.lit("x"), F.col("page_url"), F.col("paragraph")))
    target = F.concat(F.lit("doc/"), (F.col("doc_id") * 3 % 1500).cast("string"), F.when(F.col("doc_id") % 2 == 0, "#top").otherwise("/"))
    return edges.references(t, t.select("token_sha", target.alias("target")))


@query(EDGES_SQL.replace("WITH raw", "WITH RECURSIVE raw", 1) + """, walk(node, depth) AS (
    SELECT token_sha, 0 FROM tokens WHERE paragraph = 0 UNION SELECT e.target_sha, depth + 1 FROM walk JOIN edges e ON e.source_sha = walk.node)
    SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY node""")
def reachable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = page_edges(spark, sf_dir)
    start = page_tokens(spark, sf_dir).filter("paragraph = 0").select(F.col("token_sha").alias("node"))
    return traverse.bfs(e, start)


_PARTS = "SELECT 's' || l_suppkey AS source_sha, 'p' || l_partkey AS target_sha FROM lineitem UNION ALL SELECT 'p' || l_partkey, 'c' || o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directed graph from suppliers to parts to customers of all lines, with parallel edges and ends without outgoing edges."""
    lines, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders"))
    s, p, c = (F.concat(F.lit(k), F.col(x).cast("string")) for k, x in (("s", "l_suppkey"), ("p", "l_partkey"), ("c", "o_custkey")))
    bought = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(s.alias("source_sha"), p.alias("target_sha")).unionAll(bought.select(p.alias("source_sha"), c.alias("target_sha")))


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT * FROM ({_PARTS})), w(node, depth) AS (
    SELECT 's0', 0 UNION SELECT e.target_sha, depth + 1 FROM w JOIN e ON e.source_sha = w.node WHERE depth < 3)
    SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY node""")
def bfs_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.bfs(_parts(spark, sf_dir), spark.createDataFrame([("s0",)], "node string"), 3)


@query(f"SELECT target_sha, CAST(1 AS DOUBLE) AS weight FROM ({_PARTS}) WHERE source_sha = 's0' ORDER BY target_sha LIMIT 100")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.neighbours(_parts(spark, sf_dir).withColumn("weight", F.lit(1.0)), "s0", 100)


_ROUND = """, g{i} AS MATERIALIZED (SELECT e.target_sha AS node, sum(0.85 * r.rank / d.degree) AS got FROM r{j} r JOIN e ON e.source_sha = r.node JOIN d ON d.source_sha = r.node GROUP BY e.target_sha),
    r{i} AS MATERIALIZED (SELECT n.node, (1 - 0.85) / (SELECT count(*) FROM n) + coalesce(g.got, 0) AS rank FROM n LEFT JOIN g{i} g ON g.node = n.node)"""


@query(f"WITH e AS MATERIALIZED ({_PARTS}), n AS MATERIALIZED (SELECT source_sha AS node FROM e UNION SELECT target_sha FROM e), d AS MATERIALIZED (SELECT source_sha, count(*) AS degree FROM e GROUP BY source_sha), r0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM n) AS rank FROM n)"
       + "".join(_ROUND.format(i=i, j=i - 1) for i in range(1, 21)) + " SELECT node, round(rank, 9) AS rank FROM r20")
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _parts(spark, sf_dir)
    nodes = e.select(F.col("source_sha").alias("node")).union(e.select("target_sha")).distinct()
    return traverse.pagerank(e, nodes).select("node", F.round("rank", 9).alias("rank"))


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tokens and edges as a store holds them: computed once."""
    t = cut(page_tokens(spark, sf_dir))
    return t, cut(edges.infer(t))


_SEEDS = """, seeds AS (SELECT *, CAST(row_number() OVER (ORDER BY module, page_url, paragraph, token_sha) AS INTEGER) AS position FROM tokens
    WHERE contains(lower(content), 'thanedble') OR contains(lower(content), 'rein') ORDER BY module, page_url, paragraph, token_sha LIMIT 10)"""


@query(TOKENS_SQL + _SEEDS + " SELECT token_sha, position, 1.0::DOUBLE / position AS seed_rank FROM seeds")
def seed_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.seeds_like(page_tokens(spark, sf_dir), ASKED, most=10).select("token_sha", "position", "seed_rank")


@query(TOKENS_SQL + r""", p AS (SELECT token_sha, unnest(regexp_extract_all(lower(content), '[\p{L}\p{N}]+')) AS term FROM tokens),
    i AS (SELECT term, token_sha, count(*) AS tf FROM p GROUP BY ALL), l AS (SELECT token_sha, sum(tf) AS length FROM i GROUP BY ALL),
    w AS (SELECT (SELECT count(*) FROM tokens) AS n, (SELECT sum(length) FROM l) AS total),
    a AS (SELECT * FROM i WHERE term IN ('thanedble', 'rein')), d AS (SELECT term, count(*) AS df FROM a GROUP BY term),
    s AS (SELECT token_sha, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length * n / total))), 6) AS score
          FROM a JOIN d USING (term) JOIN l USING (token_sha) CROSS JOIN w GROUP BY token_sha)
    SELECT token_sha, score FROM s ORDER BY score DESC, token_sha LIMIT 20""")
def seed_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25(page_tokens(spark, sf_dir), ASKED, most=20).select("token_sha", F.round("score", 6).alias("score"))


_PRIORITY = "CASE rel_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in retrieval.EXPANSION_PRIORITY.items()) + " ELSE 0.2 END"
_LEVEL = """, x{i} AS (SELECT b.t AS token_sha, f.parent, f.score * CAST({p} AS DOUBLE) * b.weight AS score, b.weight, b.rel_type
        FROM f{j} f JOIN both_ b ON b.f = f.token_sha WHERE b.t NOT IN (SELECT token_sha FROM seen{j})),
    w{i} AS (SELECT *, row_number() OVER (PARTITION BY token_sha ORDER BY parent, score DESC, weight DESC, rel_type) AS k FROM x{i}),
    o{i} AS (SELECT *, row_number() OVER (ORDER BY parent, score DESC, token_sha) AS place FROM w{i} WHERE k = 1 QUALIFY place <= 40),
    f{i} AS (SELECT token_sha, place AS parent, score FROM o{i}), seen{i} AS (SELECT token_sha FROM seen{j} UNION ALL SELECT token_sha FROM o{i})"""
_EXPANDED = (EDGES_SQL + _SEEDS + ", both_ AS (SELECT source_sha AS f, target_sha AS t, rel_type, weight FROM edges UNION ALL SELECT target_sha, source_sha, rel_type, weight FROM edges)"
    + ", f0 AS (SELECT token_sha, position AS parent, 1.0::DOUBLE / position AS score FROM seeds), seen0 AS (SELECT token_sha FROM seeds)"
    + "".join(_LEVEL.format(i=i, j=i - 1, p=_PRIORITY) for i in (1, 2))
    + ", expanded AS (SELECT token_sha, weight AS edge_weight, depth, CAST(row_number() OVER (ORDER BY depth, place) AS INTEGER) AS position FROM (SELECT token_sha, weight, 1 AS depth, place FROM o1 UNION ALL SELECT token_sha, weight, 2, place FROM o2) QUALIFY position <= 40)")


@query(_EXPANDED + " SELECT * FROM expanded")
def expand_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, e = _stored(spark, sf_dir)
    return retrieval.expand(retrieval.seeds_like(t, ASKED, most=10), e, most=40)


_TYPE = "CASE content_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in retrieval.CONTENT_PRIORITY.items()) + " ELSE 0.5 END"
_BUDGET = (_EXPANDED + f""", line AS (SELECT token_sha, 1.0::DOUBLE / position AS seed_rank, 0::DOUBLE AS edge_weight, 0 AS depth, position AS line FROM seeds
        UNION ALL SELECT token_sha, 0, edge_weight, depth, position + 1000000 FROM expanded),
    scored AS (SELECT t.*, line, round((3 * seed_rank + 1.5::DOUBLE * edge_weight + CAST({_TYPE} AS DOUBLE) + least(length(content) / 500.0::DOUBLE, 1.0::DOUBLE) * 0.3::DOUBLE) / (1 + 0.5::DOUBLE * depth), 9) AS score,""" + r"""
        len(list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '')) AS words FROM tokens t JOIN line USING (token_sha)),
    totals AS (SELECT *, sum(words) OVER w AS total, row_number() OVER w AS k FROM scored WINDOW w AS (ORDER BY score DESC, line, token_sha ROWS UNBOUNDED PRECEDING)),
    budget AS (SELECT * FROM totals WHERE total <= 400 OR k = 1)""")


def _budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, e = _stored(spark, sf_dir)
    seeds = cut(retrieval.seeds_like(t, ASKED, most=10))
    return retrieval.within_budget(retrieval.ranked(t, seeds, retrieval.expand(seeds, e, most=40)), 400)


@query(_BUDGET + " SELECT token_sha, round(score, 6) AS score, CAST(words AS INTEGER) AS words, CAST(total AS BIGINT) AS total FROM budget")
def word_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _budget(spark, sf_dir).select("token_sha", F.round("score", 6).alias("score"), "words", "total")


@query(_BUDGET + r""", h AS (SELECT *, trim(regexp_replace(section, '[\[\]()]', '', 'g')) AS s, trim(content) AS c,
        module IS DISTINCT FROM lag(module) OVER w OR row_number() OVER w = 1 AS nm, page_url IS DISTINCT FROM lag(page_url) OVER w OR row_number() OVER w = 1 AS np,
        section IS DISTINCT FROM lag(section) OVER w OR row_number() OVER w = 1 AS ns, row_number() OVER w AS pos
        FROM budget WINDOW w AS (ORDER BY module, page_url, section, paragraph, token_sha)),
    p AS (SELECT pos, concat_ws(chr(10), CASE WHEN nm THEN chr(10) || '## [' || module || ']' || chr(10) END, CASE WHEN nm OR np THEN chr(10) || '### ' || page_url || chr(10) END,
        CASE WHEN (nm OR np OR ns) AND s <> '' THEN chr(10) || '#### ' || s || chr(10) END,
        CASE content_type WHEN 'NOTE' THEN '> **Note:** ' || c WHEN 'IMPORTANT' THEN '> **Important:** ' || c WHEN 'VERY_IMPORTANT' THEN '> **Critical:** ' || c WHEN 'PRO_TIP' THEN '> **Tip:** ' || c
            ELSE CASE WHEN content_type = 'CODE_EXAMPLE' AND NOT starts_with(c, '```') THEN '```' || chr(10) || c || chr(10) || '```' ELSE c END END || chr(10)) AS part FROM h)
    SELECT trim(string_agg(part, chr(10) ORDER BY pos)) AS markdown, count(*) AS n_tokens FROM p""")
def assemble_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.assembled(_budget(spark, sf_dir))


@query(r"""WITH c AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS w FROM documents)
    SELECT a.doc_id AS left_id, b.doc_id AS right_id, round(len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)), 6) AS overlap
    FROM c a JOIN c b ON a.doc_id % 20 = 0 AND a.doc_id <> b.doc_id WHERE len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)) > 0.6""")
def near_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new cases are the documents whose id is divisible by 20; all documents are the known ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    return retrieval.near_cases(docs.filter("id % 20 = 0"), docs).select("left_id", "right_id", F.round("share", 6).alias("overlap"))


@query(r"""WITH h AS (SELECT url AS page_url, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS base, unnest(regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1)) AS href FROM pages),
    w AS (SELECT page_url, base, regexp_replace(regexp_replace(CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '/') THEN base || href END, '[?#].*$', ''), '/+$', '') AS target FROM h)
    SELECT DISTINCT page_url, target FROM w WHERE target IS NOT NULL AND target <> base AND regexp_extract(target, '^(https?://[^/?#]+)', 1) = base
    AND NOT regexp_matches(lower(target), '\.(?:png|jpe?g|gif|svg|css|js|pdf|zip|ico)$')""")
def link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.links(spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("url").alias("page_url"), "html"))


@query(r"SELECT regexp_extract(url, '^https?://(?:www\.|m\.|blog\.)?([^/?#]+)', 1) AS host, sha256(trim(regexp_replace(html, '\s+', ' ', 'g'))) AS content_hash, count(*) AS n FROM pages GROUP BY ALL")
def host_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    host = F.regexp_extract("url", r"^https?://(?:www\.|m\.|blog\.)?([^/?#]+)", 1)
    return p.groupBy(host.alias("host"), tokens.content_hash(F.col("html")).alias("content_hash")).agg(F.count("*").alias("n"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
    e AS (SELECT doc_id, i, unnest(regexp_extract_all(line, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) AS email FROM l)
    SELECT 'doc/' || doc_id AS page_url, CAST(i AS INTEGER) AS i, email, lower(string_split(email, '@')[-1]) IN ('mail1.example.com', 'mail2.example.com') AS is_demo FROM e""")
def email_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = docs.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("page_url"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return tokens.emails(lines, ["mail1.example.com", "mail2.example.com"])
