"""The corpus pipeline: stages over ``documents``, each written as Parquet and read by the next.

Every stage works on all rows its predecessor kept. Language ID and quality learn from the rows and
labels that their queries may learn from. Rows with a null doc_id are kept by the near-duplicate stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import langid, quality
from weftline.llm.near import near_classes
from weftline.llm.packing import pack
from weftline.llm.pii import replace_pii
from weftline.llm.session import folder, table

PII_KEY = "corpus-pipeline"
LEAST_SCORE = 0.5  # posterior below which a language is uncertain


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list]:
    """``docs`` with columns of these names under other ones, and the columns that give the old names back."""
    other = {c: f"_own_{i}_{c}" for i, c in enumerate(docs.columns) if c.lower() in names}
    return docs.withColumnsRenamed(other), [F.col(other.get(c, c)).alias(c) for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters (null and empty texts too) and those whose language is uncertain.

    Repeated rows, very long texts, null ids and an empty table are as ``langid.identify`` has them; columns of its names stay.
    """
    model = langid.fit(docs.filter(~langid.held_out()))
    plain, back = _aside(docs, "lang_pred", "score")
    return langid.identify(plain, model).filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(back)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier scores below its cut; null, empty and repeated texts are as ``quality.rate`` has them."""
    model = quality.fit(docs, table(spark, sf_dir, "labels").filter(~quality.held_out()))
    plain, back = _aside(docs, "score", "predicted")
    return quality.rate(plain, model).filter("predicted = 1").select(back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least doc_id of each class of near duplicates."""
    classes = near_classes(docs)
    plain, back = _aside(docs, "_times")
    kept = classes.filter("doc_id = class_id").groupBy("doc_id").agg(F.count("*").alias("_times"))
    unnamed = plain.filter("doc_id is null")
    named = plain.join(kept, "doc_id")
    once = named.filter("_times = 1").drop("_times")
    repeated = named.filter("_times > 1").drop("_times").dropDuplicates(["doc_id"])
    return once.unionByName(repeated).unionByName(unnamed).select(back)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and secrets by surrogates; n_chars follows the new text."""
    plain, back = _aside(docs, "n_entities")
    return replace_pii(plain, PII_KEY).withColumn("n_chars", F.length("text").cast("long")).select(back)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; null and empty texts are one end id each, an empty table gives no rows."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("quality_classifier", good_quality),
    ("ngram_jaccard_join", near_duplicates),
    ("pii", private),
    ("best_fit_packing", packed),
]

# language ID, the classifier and the packing are learned or solved: SQL can't express them
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written under spark.checkpoint.dir. An empty table gives no rows."""
    own = f"{folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{own}/{i}-{name}")
            docs = spark.read.parquet(f"{own}/{i}-{name}")
    return docs
