"""The thin queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import langid, quality, toxicity, whitening
from weftline.llm.fingerprint import fingerprints
from weftline.llm.html import extract
from weftline.llm.near import near_classes
from weftline.llm.packing import pack
from weftline.llm.phrases import collocations
from weftline.llm.pii import replace_pii
from weftline.llm.session import table
from weftline.llm.topk import top_k
from weftline.llm.viterbi import count_tokens, decode_texts, encode_texts


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.filter("vec_id % 100 = 0"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels").filter(~quality.held_out()))
    return quality.rate(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), key="query-key")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = decode_texts(encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return docs.select("doc_id", "ids", F.coalesce(F.size("ids"), F.lit(0)).alias("n_ids"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(~langid.held_out()))
    return langid.identify(docs.drop("lang"), model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_pretokens", "n_tokens")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors)
    rows = whitening.whiten(vectors, model)
    n, shares, error = 0, [], 0.0
    if model is not None and len(model.values):
        n, shares, error = model.n, [float(e) / model.trace for e in model.values], whitening.identity_error(rows, model)
    explained = F.array(*map(F.lit, shares)).cast("array<double>")
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return each.select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        explained[F.col("place")].alias("explained"), F.lit(error).alias("identity_error"),
    )


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~toxicity.held_out()))
    return toxicity.rate(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_top_k": op1_exact_top_k,
    "op2_html_extraction": op2_html_extraction,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_document_fingerprints": op4_document_fingerprints,
    "op5_pii_surrogates": op5_pii_surrogates,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_language_id": op9_language_id,
    "op10_token_counts": op10_token_counts,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_toxicity": op12_toxicity,
    "op13_phrase_collocations": op13_phrase_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
            FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, d.vec_id AS vec_id,
                   CAST(list_sum(list_transform(range(1, len(q.c) + 1), lambda i: q.c[i] * d.c[i])) AS BIGINT) AS score
            FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id AND len(q.c) = len(d.c)
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op13_phrase_collocations": """
        WITH w AS (
            SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w
            FROM (
                SELECT coalesce(lang, 'und') AS lang,
                       unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
                FROM documents
            )
        ), t AS (
            SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang
        ), f AS (
            SELECT lang, g, len(g) AS m, count(*) AS f
            FROM (SELECT lang, unnest(flatten(list_transform(range(1, 6), lambda m: list_transform(range(1, len(w) - m + 2), lambda i: w[i : i + m - 1])))) AS g FROM w)
            GROUP BY lang, g HAVING count(*) >= 100
        ), c AS (
            SELECT f.lang, f.g, f.m, f.f AS a, k.k FROM f, (SELECT unnest(range(1, 5)) AS k) AS k WHERE k.k < f.m
        ), s AS (
            SELECT c.lang, c.g, c.m, c.a, x.f AS l, y.f AS r, t.n, c.k,
                   CAST(CAST(1000 AS HUGEINT) * c.a * t.n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
            FROM c JOIN t ON t.lang = c.lang
            JOIN f x ON x.lang = c.lang AND x.g = c.g[1 : c.k] JOIN f y ON y.lang = c.lang AND y.g = c.g[c.k + 1 : c.m]
        ), b AS (
            SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
        ), i AS (
            SELECT lang, g, max(f) AS most
            FROM (SELECT lang, f, unnest(flatten(list_transform(range(2, m), lambda p: list_transform(range(1, m - p + 2), lambda i: g[i : i + p - 1])))) AS g FROM f WHERE m > 2)
            GROUP BY lang, g
        ), o AS (
            SELECT b.lang, array_to_string(b.g, ' ') AS phrase, b.a, b.l, b.r, b.n, b.score
            FROM b LEFT JOIN i ON i.lang = b.lang AND i.g = b.g WHERE i.most IS NULL OR 100 * i.most < 100 * b.a
        ), z AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM o
        )
        SELECT lang, rank, phrase, a, l, r, n, score FROM z WHERE rank <= 2000
    """,
}
