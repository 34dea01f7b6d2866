"""Markdown pages to classified, content-addressed tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: callouts from most to least specific, and the return types that open a signature
CALLOUTS = (("VERY_IMPORTANT", r"Very\s+Important"), ("IMPORTANT", "Important"), ("PRO_TIP", r"(?:Pro\s*Tip|Tip)"), ("NOTE", "Note"))
RETURN_TYPES = "void|string|int|float|bool|list|map|bigint|decimal|date|datetime"
CONTENT_WEIGHTS = {
    "BLUEPRINT": 2.0, "PAGE": 1.8, "DASHBOARD": 1.8, "CODE_EXAMPLE": 1.0, "SIGNATURE": 0.9, "PROSE": 0.5, "TABLE_ROW": 0.4,
    "NOTE": 0.6, "IMPORTANT": 1.0, "VERY_IMPORTANT": 1.2, "PRO_TIP": 0.5, "LEARNED": 1.5,
}


def callout_pattern(label: str) -> str:
    # fixed value: how a callout is written
    return rf"(?im)^(?:>\s*)?(?:\*\*|__){label}[:.]?(?:\*\*|__)[:.]?\s*(.+)"


def content_type(block: Column) -> Column:
    """The class of a block: callouts, then fenced code, signature, table row, prose."""
    text = F.trim(block, F.lit(" \t\n\x0b\f\r"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    plain = F.when(text.startswith("```"), "CODE_EXAMPLE").when(text.rlike(rf"(?i)^(?:{RETURN_TYPES})\s+\w+\s*\(.*?\)"), "SIGNATURE")
    plain = plain.when((F.size(lines) > 0) & F.forall(lines, lambda x: F.contains(x, F.lit("|"))), "TABLE_ROW").otherwise("PROSE")
    for name, label in reversed(CALLOUTS):
        plain = F.when(text.rlike(callout_pattern(label)), name).otherwise(plain)
    return plain


def token_sha(content: Column, url: Column, paragraph: Column) -> Column:
    nul = F.char(F.lit(0))
    return F.sha2(F.concat(content, nul, url, nul, paragraph.cast("string")), 256)


def page_lines(pages: DataFrame) -> DataFrame:
    """module, page_url, i, line of pages (module, page_url, body), with the section each line stands in (headings themselves drop out).

    A heading counts inside a fence too. ``sec`` numbers the sections of a page, ``fence`` tells whether a line lies in or on a fence.
    """
    page = Window.partitionBy("page_url").orderBy("i")
    section = Window.partitionBy("page_url", "sec").orderBy("i")
    # pages are moved whole: their lines would bring their keys along
    lines = pages.select("module", "page_url", "body").repartition("page_url").select("module", "page_url", F.posexplode(F.split("body", "\n")).alias("i", "line"))
    heading = F.regexp_extract("line", r"^#{1,6}\s+(.+)", 1)
    lines = lines.withColumn("heading", F.when(heading != "", F.trim(heading)))
    lines = lines.withColumn("sec", F.sum(F.when(F.col("heading").isNotNull(), 1).otherwise(0)).over(page))
    lines = lines.withColumn("section", F.coalesce(F.last("heading", ignorenulls=True).over(page), F.lit(""))).filter("heading is null")
    mark = F.when(F.trim("line").startswith("```"), 1).otherwise(0)
    lines = lines.withColumn("mark", mark).withColumn("inside", (F.sum("mark").over(section) - F.col("mark")) % 2 == 1)
    return lines.select("module", "page_url", "i", "line", "sec", "section", "mark", "inside")


def paragraphs(pages: DataFrame) -> DataFrame:
    """module, page_url, section, paragraph, content: blocks between blank lines, fences kept whole, counted through the page from 0."""
    section = Window.partitionBy("page_url", "sec").orderBy("i")
    lines = page_lines(pages)
    blank = (F.trim("line") == "") & ~F.col("inside") & (F.col("mark") == 0)
    opens = (F.col("mark") == 1) & ~F.col("inside")
    closes = (F.col("mark") == 1) & F.col("inside")
    after_close = F.coalesce(F.lag(closes).over(section), F.lit(False))
    lines = lines.withColumn("blank", blank).withColumn("cut", F.when(opens | blank | after_close, 1).otherwise(0))
    lines = lines.withColumn("block", F.sum("cut").over(section)).filter("not blank")
    blocks = lines.groupBy("module", "page_url", "sec", "section", "block").agg(F.min("i").alias("first"), F.sort_array(F.collect_list(F.struct("i", "line"))).alias("rows"))
    content = F.array_join(F.transform("rows", lambda r: r["line"]), "\n")
    number = F.row_number().over(Window.partitionBy("page_url").orderBy("first")) - 1
    return blocks.select("module", "page_url", "section", number.alias("paragraph"), content.alias("content"))


def tokens(pages: DataFrame) -> DataFrame:
    """token_sha, module, page_url, section, paragraph, content_type, weight, content of pages (module, page_url, body)."""
    weights = F.create_map(*(F.lit(x) for pair in CONTENT_WEIGHTS.items() for x in pair))
    typed = paragraphs(pages).withColumn("content_type", content_type(F.col("content")))
    return typed.select(
        token_sha(F.col("content"), F.col("page_url"), F.col("paragraph")).alias("token_sha"), "module", "page_url", "section", "paragraph",
        "content_type", F.try_element_at(weights, F.col("content_type")).alias("weight"), "content",
    )


def content_hash(text: Column) -> Column:
    """Hash of a text but for its white space."""
    return F.sha2(F.trim(F.regexp_replace(text, r"\s+", " ")), 256)


def title(markdown: Column) -> Column:
    """The first ``# `` line; null without one."""
    found = F.regexp_extract(markdown, r"(?m)^# (.+)$", 1)
    return F.when(found != "", F.trim(found))


def links(pages: DataFrame) -> DataFrame:
    """page_url, target: distinct links of the same host as absolute URLs without fragment, query or trailing slash."""
    base = F.regexp_extract("page_url", r"^(https?://[^/?#]+)", 1)
    href = pages.select("page_url", base.alias("base"), F.explode(F.regexp_extract_all("html", F.lit(r'<a\s[^>]*?href="([^"]*)"'), F.lit(1))).alias("href"))
    whole = F.when(F.col("href").rlike("^https?://"), F.col("href")).when(F.col("href").startswith("/"), F.concat("base", "href"))
    target = F.regexp_replace(F.regexp_replace(whole, r"[?#].*$", ""), "/+$", "")
    out = href.withColumn("target", target).filter(F.col("target").isNotNull() & (F.col("target") != F.col("base")))
    asset = F.lower("target").rlike(r"\.(?:png|jpe?g|gif|svg|css|js|pdf|zip|ico)$")
    same = F.regexp_extract("target", r"^(https?://[^/?#]+)", 1) == F.col("base")
    return out.filter(same & ~asset).select("page_url", "target").distinct()


def emails(lines: DataFrame, demo_domains: list[str]) -> DataFrame:
    """page_url, i, email, is_demo for each address in lines (page_url, i, line)."""
    found = F.regexp_extract_all("line", F.lit(r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"), F.lit(1))
    out = lines.select("page_url", "i", F.explode(found).alias("email"))
    return out.withColumn("is_demo", F.lower(F.substring_index("email", "@", -1)).isin(demo_domains))
