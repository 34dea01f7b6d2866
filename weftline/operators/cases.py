"""Look-ups in a token store: premises, queries, patterns, new cases and what they relate to, names, app edges, totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import retrieval
from weftline.operators.edges import WEIGHTS
from weftline.operators.lineage import cut

MOST_SENT = 1_000_000  # asked words that are sent to all tasks; more are shuffled

# fixed values: the relation and weight that a new case has to a token of each type, and to any other
RELATED = {"CODE_EXAMPLE": ("EXAMPLE_OF", 0.8), "IMPORTANT": ("CALLOUT_IMPORTANT", 0.9), "VERY_IMPORTANT": ("CALLOUT_IMPORTANT", 0.9), "NOTE": ("CALLOUT_NOTE", 0.7)}
RELATED_ELSE = ("LEARNED_FROM", 0.95)
# fixed values: the kind of relation that each edge is in proofs
KINDS = {
    "HIERARCHY": "CONTAINS", "NEXT_SIBLING": "DATAFLOW", "CROSS_REFERENCE": "LOOKUP", "CROSS_MODULE": "LOOKUP", "CALLOUT_NOTE": "CONTAINS", "CALLOUT_TIP": "CONTAINS",
    "CALLOUT_IMPORTANT": "CONTAINS", "CALLOUT_CRITICAL": "CONTAINS", "FUNCTION_OF": "CALLS", "EXAMPLE_OF": "CONTAINS", "SUPERSEDES": "DATAFLOW",
}


def search(tokens: DataFrame, term: str, module: str | None = None, types: list[str] | None = None, most: int = 20) -> DataFrame:
    """Tokens whose content holds the term (ignoring case), of a module and of types if named, in reading order."""
    hit = F.contains(F.lower("content"), F.lit(term.lower()))
    if module is not None:
        hit &= F.col("module") == module
    if types is not None:
        hit &= F.col("content_type").isin(types)
    return tokens.filter(hit).orderBy("module", "page_url", "paragraph", "token_sha").limit(most)


def patterns(tokens: DataFrame, name: str, most: int = 10) -> DataFrame:
    """content of code examples that hold the pattern's name."""
    return search(tokens, name, types=["CODE_EXAMPLE"], most=most).select("content")


def names(tokens: DataFrame) -> DataFrame:
    """token_sha, name: module.section.pN; a name that several tokens have goes on with eight digits of the sha but for the first token."""
    name = F.concat(F.col("module"), F.lit("."), F.when(F.coalesce("section", F.lit("")) == "", "root").otherwise(F.col("section")), F.lit(".p"), F.coalesce("paragraph", F.lit(0)).cast("string"))
    again = F.row_number().over(Window.partitionBy("name").orderBy("page_url", "token_sha")) > 1
    return tokens.select("token_sha", "page_url", name.alias("name")).withColumn("again", again).select("token_sha", F.when(F.col("again"), F.concat("name", F.lit("_"), F.substring("token_sha", 1, 8))).otherwise(F.col("name")).alias("name"))


def relation_kinds(edges: DataFrame) -> DataFrame:
    """Edges with the kind they have in proofs; unknown relations contain."""
    kinds = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    return edges.withColumn("kind", F.coalesce(F.try_element_at(kinds, F.col("rel_type")), F.lit("CONTAINS")))


def ask(asked: DataFrame, tokens: DataFrame, edges: DataFrame) -> DataFrame:
    """entity, answer for asked entities (entity): whether the store knows them.

    ``true`` for a token's name or sha; else ``mentioned_in_`` and eight digits of the first token, by sha, whose content
    holds the entity as a word; else null. A name is a token's, so the third look, at its edges, is only met by
    tokens that are gone: ``connected_via_N_edges`` for a sha that edges have but the store hasn't.
    """
    known = names(tokens).select(F.col("name").alias("entity")).union(tokens.select("token_sha")).distinct().withColumn("exact", F.lit("true"))
    words = tokens.select("token_sha", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))).alias("word"))
    wanted = asked.select("entity", F.lower("entity").alias("word")).distinct()
    said = words.join(F.broadcast(wanted), "word").groupBy("entity").agg(F.min("token_sha").alias("sha"))  # asked entities are a caller's list
    ends = edges.select(F.col("source_sha").alias("entity")).unionAll(edges.select("target_sha")).groupBy("entity").agg(F.count("*").alias("n"))
    out = asked.join(known, "entity", "left").join(said, "entity", "left").join(ends, "entity", "left")
    return out.select("entity", F.coalesce("exact", F.concat(F.lit("mentioned_in_"), F.substring("sha", 1, 8)), F.concat(F.lit("connected_via_"), F.col("n").cast("string"), F.lit("_edges"))).alias("answer"))


def validated(cases: DataFrame, tokens: DataFrame) -> DataFrame:
    """id, valid, reason of new cases (id, text, learned, query): empty, duplicate, near duplicate, unrelated or ok.

    A duplicate has a token's content; a near one shares over 0.6 of the smaller word set with a token; a case is
    unrelated if it asks for a word (query) that no token has. The first that holds is the reason.
    """
    known = tokens.select(F.col("token_sha").alias("id"), F.col("content").alias("text"))
    asked = cases.select(F.col("id").cast("string").alias("id"), "text", "learned", "query")
    same = cut(asked.join(known.select("text"), "text", "left_semi").select("id").distinct()).withColumn("same", F.lit(True))
    empty = (F.trim(F.coalesce("text", F.lit(""))) == "") | (F.trim(F.coalesce("learned", F.lit(""))) == "")
    left = asked.filter(~empty).join(same, "id", "left_anti")  # the others are decided
    near = retrieval.near_ids(left, known).withColumn("near", F.lit(True))
    found = retrieval.terms_of(tokens).select(F.col("term").alias("word")).distinct().withColumn("found", F.lit(True))
    rows = asked.join(same, "id", "left").join(near, "id", "left").withColumn("word", F.lower("query")).join(found, "word", "left")
    reason = F.when(empty, "empty").when(F.col("same"), "duplicate").when(F.col("near"), "near duplicate").when(F.col("query").isNotNull() & F.col("found").isNull(), "unrelated").otherwise("ok")
    return rows.select("id", (reason == "ok").alias("valid"), reason.alias("reason"))


def related(cases: DataFrame, tokens: DataFrame, most: int = 20) -> DataFrame:
    """id, target_sha, rel_type, weight: up to ``most`` tokens that hold the word a case asks for (id, query), by sha; the relation follows the token's type."""
    asked = cut(cases.select(F.col("id").cast("string").alias("id"), F.lower("query").alias("term")).distinct())
    wanted = cut(asked.select("term").distinct())
    if wanted.count() <= MOST_SENT:
        wanted = F.broadcast(wanted)
    # the first tokens of each asked term, then of each case: what is shuffled and joined grows with terms and cases, not with their product
    holds = retrieval.terms_of(tokens, "token_sha", "content_type").join(wanted, "term")
    first = F.row_number().over(Window.partitionBy("term").orderBy("token_sha", "content_type"))  # Spark keeps only ``most`` rows of a group before the shuffle
    kept = holds.distinct().withColumn("k", first).filter(F.col("k") <= most)
    place = F.row_number().over(Window.partitionBy("id").orderBy("token_sha"))
    hits = asked.join(kept, "term").select("id", "token_sha", "content_type").distinct()
    rel, weight = F.lit(RELATED_ELSE[0]), F.lit(RELATED_ELSE[1])
    for kind, (r, w) in RELATED.items():
        rel, weight = F.when(F.col("content_type") == kind, r).otherwise(rel), F.when(F.col("content_type") == kind, w).otherwise(weight)
    return hits.withColumn("k", place).filter(F.col("k") <= most).select("id", F.col("token_sha").alias("target_sha"), rel.alias("rel_type"), weight.alias("weight"))


def app_edges(tokens: DataFrame) -> DataFrame:
    """Edges of apps' tokens: a module's overview page to all others, neighbours of a page, prose to the code behind it."""
    page = Window.partitionBy("page_url").orderBy("paragraph", "token_sha")
    rows = tokens.select("token_sha", "module", "page_url", "content_type", F.lead("token_sha").over(page).alias("next"), F.lead("content_type").over(page).alias("next_type"))
    overview = tokens.filter(F.col("page_url").endswith("/overview")).groupBy("module").agg(F.max_by("token_sha", F.struct("paragraph", "token_sha")).alias("overview"))

    def edge(cond: Column, source: Column, target: Column, rel: str, weight: float) -> Column:
        return F.when(cond, F.struct(source.alias("source_sha"), target.alias("target_sha"), F.lit(rel).alias("rel_type"), F.lit(weight).alias("weight")))

    sha, follows = F.col("token_sha"), F.col("next").isNotNull()
    made = F.array(
        edge(F.col("overview").isNotNull() & (F.col("overview") != sha), F.col("overview"), sha, "HIERARCHY", WEIGHTS["HIERARCHY"]),
        edge(follows, sha, F.col("next"), "NEXT_SIBLING", WEIGHTS["NEXT_SIBLING"]),
        edge(follows & (F.col("content_type") == "PROSE") & (F.col("next_type") == "CODE_EXAMPLE"), sha, F.col("next"), "EXAMPLE_OF", WEIGHTS["EXAMPLE_OF"]),
    )
    return rows.join(F.broadcast(overview), "module", "left").select(F.inline(F.filter(made, lambda e: e.isNotNull())))  # a row per module


def code_references(tokens: DataFrame, functions: DataFrame) -> DataFrame:
    """Code examples that name a documented function (name, doc_sha; over three letters), as cross-module edges: an equi-join on the code's words."""
    words = tokens.filter("content_type = 'CODE_EXAMPLE'").select("token_sha", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(r"(\w+)"), F.lit(1)))).alias("word"))
    known = functions.filter(F.length("name") > 3).groupBy(F.lower("name").alias("word")).agg(F.min("doc_sha").alias("target_sha"))
    return words.join(known, "word").select(F.col("token_sha").alias("source_sha"), "target_sha", F.lit("CROSS_MODULE").alias("rel_type"), F.lit(WEIGHTS["CROSS_MODULE"]).alias("weight")).distinct()


def retrieval_stats(rows: DataFrame) -> DataFrame:
    """Totals of assembled tokens (module, page_url, depth, content): modules and pages covered, seeds and expanded tokens, words."""
    words = F.size(F.filter(F.split("content", r"\s+"), lambda w: w != ""))
    return rows.agg(F.count_distinct("module").alias("n_modules"), F.count_distinct("page_url").alias("n_pages"), F.count_if(F.col("depth") == 0).alias("n_seeds"), F.count_if(F.col("depth") > 0).alias("n_expanded"), F.sum(words).alias("n_words"))


def store_residual(orphans: DataFrame, broken: DataFrame, shadows: DataFrame, inconsistent: DataFrame) -> DataFrame:
    """check, n of each self-check of a store, and their sum as the check ``residual``."""
    parts = {"orphan_token": orphans, "broken_reference": broken, "shadow_field": shadows, "inconsistent_signature": inconsistent}
    counted = reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("n")).select(F.lit(k).alias("check"), "n") for k, df in parts.items()))
    return counted.unionByName(counted.agg(F.sum("n").alias("n")).select(F.lit("residual").alias("check"), "n"))


def updated_counts(index: DataFrame, gone: DataFrame, new: DataFrame) -> DataFrame:
    """The counts of an index (``retrieval.term_counts``) after tokens went (token_sha) and others came (token_sha, content): only theirs are cut again."""
    return index.join(gone.select("token_sha").distinct(), "token_sha", "left_anti").unionByName(retrieval.term_counts(new))
