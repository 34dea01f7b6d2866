"""Typed, weighted relations inferred between tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: relation weights, and the relation of each callout
WEIGHTS = {
    "HIERARCHY": 1.0, "NEXT_SIBLING": 0.3, "CROSS_REFERENCE": 0.7, "CALLOUT_NOTE": 0.5, "CALLOUT_TIP": 0.6, "CALLOUT_IMPORTANT": 0.8,
    "CALLOUT_CRITICAL": 1.0, "CROSS_MODULE": 0.9, "FUNCTION_OF": 0.8, "EXAMPLE_OF": 0.6, "SUPERSEDES": 1.0, "LEARNED_FROM": 0.95,
}
CALLOUT_RELATIONS = {"NOTE": "CALLOUT_NOTE", "PRO_TIP": "CALLOUT_TIP", "IMPORTANT": "CALLOUT_IMPORTANT", "VERY_IMPORTANT": "CALLOUT_CRITICAL"}


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def _weighted(edges: DataFrame) -> DataFrame:
    return edges.select("source_sha", "target_sha", "rel_type", F.try_element_at(_map(WEIGHTS), F.col("rel_type")).alias("weight"))


def _within() -> Window:
    return Window.partitionBy("page_url", "section").orderBy("paragraph", "token_sha")


def siblings(tokens: DataFrame) -> DataFrame:
    """Each token of a section to the next."""
    out = tokens.select(F.col("token_sha").alias("source_sha"), F.lead("token_sha").over(_within()).alias("target_sha"), F.lit("NEXT_SIBLING").alias("rel_type"))
    return _weighted(out.filter("target_sha is not null"))


def hierarchy(tokens: DataFrame) -> DataFrame:
    """The first token of a section to each later one."""
    anchor = F.first("token_sha").over(_within())
    out = tokens.select(anchor.alias("source_sha"), F.col("token_sha").alias("target_sha"), F.row_number().over(_within()).alias("k"), F.lit("HIERARCHY").alias("rel_type"))
    return _weighted(out.filter("k > 1"))


def preceding(rows: DataFrame, group: list[str], order: str, value: str, which: Column, name: str) -> DataFrame:
    """As-of: ``name`` is the ``value`` of the nearest earlier row (strictly smaller ``order``) of the group for which ``which`` holds."""
    before = Window.partitionBy(*group).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(F.when(which, F.col(value)), ignorenulls=True).over(before))


def callouts(tokens: DataFrame) -> DataFrame:
    """The nearest earlier token that is no callout to each callout of the section."""
    callout = F.col("content_type").isin(*CALLOUT_RELATIONS)
    out = preceding(tokens, ["page_url", "section"], "paragraph", "token_sha", ~callout, "source_sha").filter(callout & F.col("source_sha").isNotNull())
    return _weighted(out.select("source_sha", F.col("token_sha").alias("target_sha"), F.try_element_at(_map(CALLOUT_RELATIONS), F.col("content_type")).alias("rel_type")))


def examples(tokens: DataFrame) -> DataFrame:
    """The nearest earlier prose to each code example of the section."""
    out = preceding(tokens, ["page_url", "section"], "paragraph", "token_sha", F.col("content_type") == "PROSE", "source_sha")
    out = out.filter((F.col("content_type") == "CODE_EXAMPLE") & F.col("source_sha").isNotNull())
    return _weighted(out.select("source_sha", F.col("token_sha").alias("target_sha"), F.lit("EXAMPLE_OF").alias("rel_type")))


def functions(tokens: DataFrame, names: list[str]) -> DataFrame:
    """A loop edge at each signature that holds a catalogued name."""
    known = reduce(lambda a, b: a | b, (F.contains(F.lower("content"), F.lit(n.lower())) for n in names))
    hit = tokens.filter((F.col("content_type") == "SIGNATURE") & known)
    return _weighted(hit.select(F.col("token_sha").alias("source_sha"), F.col("token_sha").alias("target_sha"), F.lit("FUNCTION_OF").alias("rel_type")))


def references(tokens: DataFrame, links: DataFrame) -> DataFrame:
    """Links (token_sha, target) to the first token of the page they name; without such a page the address is tried again without fragment and slash."""
    first = tokens.groupBy("page_url").agg(F.min_by("token_sha", "paragraph").alias("first_sha"), F.min("module").alias("to_module"))
    source = tokens.select(F.col("token_sha").alias("source_sha"), F.col("module").alias("from_module"))
    asked = links.select(F.col("token_sha").alias("source_sha"), "target", F.regexp_replace(F.regexp_replace("target", "#.*$", ""), "/+$", "").alias("plain")).join(source, "source_sha")
    exact = first.select(F.col("page_url").alias("target"), F.col("first_sha").alias("sha_1"), F.col("to_module").alias("module_1"))
    plain = first.select(F.col("page_url").alias("plain"), F.col("first_sha").alias("sha_2"), F.col("to_module").alias("module_2"))
    out = asked.join(exact, "target", "left").join(plain, "plain", "left").withColumn("target_sha", F.coalesce("sha_1", "sha_2")).filter("target_sha is not null and target_sha <> source_sha")
    rel = F.when(F.coalesce("module_1", "module_2") != F.col("from_module"), "CROSS_MODULE").otherwise("CROSS_REFERENCE")
    return _weighted(out.select("source_sha", "target_sha", rel.alias("rel_type"))).dropDuplicates(["source_sha", "target_sha", "rel_type"])


def infer(tokens: DataFrame) -> DataFrame:
    """Hierarchy, sibling, callout and example edges, each (source, target, relation) once.

    As the four functions above, but over one sort by page and section: each token makes an array of its edges.
    """
    before = Window.partitionBy("page_url", "section").orderBy("paragraph").rangeBetween(Window.unboundedPreceding, -1)
    kind, sha = F.col("content_type"), F.col("token_sha")
    callout = kind.isin(*CALLOUT_RELATIONS)
    placed = tokens.select(
        "token_sha", "content_type", F.lead("token_sha").over(_within()).alias("next"), F.first("token_sha").over(_within()).alias("anchor"), F.row_number().over(_within()).alias("k"),
        F.last(F.when(~callout, sha), ignorenulls=True).over(before).alias("plain"), F.last(F.when(kind == "PROSE", sha), ignorenulls=True).over(before).alias("prose"),
    )

    def edge(cond: Column, source: Column, target: Column, rel: Column) -> Column:
        return F.when(cond, F.struct(source.alias("source_sha"), target.alias("target_sha"), rel.alias("rel_type")))

    made = F.array(
        edge(F.col("k") > 1, F.col("anchor"), sha, F.lit("HIERARCHY")),
        edge(F.col("next").isNotNull(), sha, F.col("next"), F.lit("NEXT_SIBLING")),
        edge(callout & F.col("plain").isNotNull(), F.col("plain"), sha, F.try_element_at(_map(CALLOUT_RELATIONS), kind)),
        edge((kind == "CODE_EXAMPLE") & F.col("prose").isNotNull(), F.col("prose"), sha, F.lit("EXAMPLE_OF")),
    )
    return _weighted(placed.select(F.inline(F.filter(made, lambda e: e.isNotNull())))).dropDuplicates(["source_sha", "target_sha", "rel_type"])
