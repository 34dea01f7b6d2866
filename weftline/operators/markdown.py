"""HTML pages to markdown, and what a scraper keeps of them: paths, breadcrumbs, links, a manifest."""

from __future__ import annotations

import html
import html.entities
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: what tags become, as they open and as they close
OPENS = {"p": "\n\n", "br": "\n", "strong": "**", "b": "**", "em": "*", "i": "*", "pre": "\n```\n", "table": "\n", "tr": "| "}
CLOSES = {"strong": "**", "b": "**", "em": "*", "i": "*", "pre": "\n```\n", "td": " | ", "th": " | ", "tr": "\n"}
CALLOUT_CLASSES = "note|tip|important"



def _of(values: dict[str, str], name: Column) -> Column:
    out = F.lit("")
    for k, v in values.items():
        out = F.when(name == k, v).otherwise(out)
    return out


# a page's pieces: comments, scripts and styles with their raw text, marked sections, tags whose quoted values may hold a >, what breaks off, text
_REST = r"""(?:[^>=]++|=++\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
_RAW = "|".join(rf"<(?i:{name})(?=[\s/>]){_REST}(?<!/)>.*?(?:</(?i:{name})\s*>|\z)" for name in ("script", "style"))
PIECE = rf"(?s)(<!--.*?--\s*>|{_RAW}|<!\[(?i:cdata|temp|ignore|include|rcdata)\b.*?\]\s*\]\s*>|<[a-zA-Z]{_REST}>|<[/!?][^>]*>|<[a-zA-Z/!?].*\z|[^<]+|<)"
_RAW_PIECE = r"(?is)^<(script|style)(?=[\s/>])"
_ATTRIBUTE = r"""([^\s/>=][^\s/>=]*)(?:\s*=+\s*("[^"]*"|'[^']*'|[^>\s]*))?"""
_REFERENCE = r"(&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[^\s<&#;]{1,32};?|[^&]+|&)"


def _text_of(code: Column) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def _numbered(reference: Column) -> Column:
    """What a numeric reference stands for: the standard's replacements for controls, U+FFFD beyond Unicode, nothing for non-characters."""
    digits = F.regexp_extract(reference, "^&#[xX]?0*([0-9a-fA-F]*)", 1)
    short = F.length(digits) <= 8
    number = F.when(short & (digits != ""), digits).otherwise("0")
    code = F.when(short, F.when(reference.rlike("^&#[xX]"), F.conv(number, 16, 10)).otherwise(F.conv(number, 10, 10)).cast("long"))
    moved = F.create_map(*(F.lit(x) for k, v in sorted(html._invalid_charrefs.items()) for x in (k, v)))
    gone = F.array(*(F.lit(c) for c in sorted(html._invalid_codepoints)))
    found = F.try_element_at(moved, code.cast("int"))
    wrong = code.isNull() | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    return F.when(wrong, "�").when(found.isNotNull(), found).when(F.array_contains(gone, code.cast("int")), "").otherwise(_text_of(code))


def decoded(text: Column) -> Column:
    """``text`` with its character references as HTML 5 reads them: all names, the old ones also without a semicolon and in front of other letters."""
    names = F.from_json(F.lit(json.dumps(html.entities.html5)), "map<string,string>")  # one literal: thousands of columns take half a minute to plan
    old = "|".join(sorted((n for n in html.entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))

    def one(x: Column) -> Column:
        named = F.try_element_at(names, F.substr(x, F.lit(2)))
        start = F.regexp_extract(x, rf"^&({old})", 1)
        other = F.when(start != "", F.concat(F.try_element_at(names, start), F.substr(x, F.length(start) + 2))).otherwise(x)
        return F.when(~x.startswith("&") | (x == "&"), x).when(x.startswith("&#"), _numbered(x)).otherwise(F.coalesce(named, other))

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(1)), one), "")).otherwise(text)


def _attribute(piece: Column, name: str) -> Column:
    """The decoded value of a tag's last attribute of that name; empty without one."""
    rest = F.regexp_replace(F.regexp_replace(piece, r"^<[^\s/>]+", ""), r"/?>$", "")
    names, values = (F.regexp_extract_all(rest, F.lit(_ATTRIBUTE), F.lit(i)) for i in (1, 2))
    pairs = F.filter(F.arrays_zip(names.alias("n"), values.alias("v")), lambda p: F.lower(p["n"]) == name)
    value = F.coalesce(F.try_element_at(pairs, F.lit(-1))["v"], F.lit(""))
    return decoded(F.when(value.rlike("""^["']"""), F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value))


def page_events(pages: DataFrame, key: str) -> DataFrame:
    """key, i, name, close, alone, text, href, class: the tags and texts of pages (key, html) in order, as an HTML parser reports them.

    ``text`` is null for tags, ``name`` empty for texts. References in texts and attributes are decoded; scripts and styles are raw text between
    their tags; quoted values may hold a >. Comments and declarations aren't events, nor is what breaks off at the end of a page: an open tag, script or reference, or a last <.
    Null and empty html have one event without name and text.
    """
    whole = rf"(?s)^(<[a-zA-Z]+{_REST}>)(.*?)(</[^>]*>)$"

    def parts(piece: Column) -> Column:
        raw = piece.rlike(r"(?is)^<(script|style)(?=[\s/>]).*</\1\s*>\z")
        broken = piece.rlike(_RAW_PIECE) & ~raw  # without an end: its text is lost
        three = F.array(*(F.struct(F.regexp_extract(piece, whole, k).alias("piece"), F.lit(k == 2).alias("raw")) for k in (1, 2, 3)))
        start = F.array(F.struct(F.regexp_extract(piece, rf"(?s)^(<[a-zA-Z]+{_REST}>)", 1).alias("piece"), F.lit(False).alias("raw")))
        return F.when(raw, F.filter(three, lambda x: x["piece"] != "")).when(broken, start).otherwise(F.array(F.struct(piece.alias("piece"), F.lit(False).alias("raw"))))

    pieces = F.flatten(F.transform(F.regexp_extract_all("html", F.lit(PIECE), F.lit(1)), parts))
    # a column of its own: beside the generator the size would cut the whole page again for each piece
    whole_page = pages.select(key, pieces.alias("_pieces")).withColumn("_n", F.size("_pieces"))
    rows = whole_page.select(key, "_n", F.posexplode_outer("_pieces").alias("i", "_piece")).select(key, "i", "_n", "_piece.piece", F.coalesce("_piece.raw", F.lit(False)).alias("_raw"))
    piece, raw = F.col("piece"), F.col("_raw")
    markup = piece.rlike(r"^<[a-zA-Z/!?]") & ~raw
    tag = piece.rlike(r"^<(/\s*)?[a-zA-Z]") & piece.endswith(">") & ~raw
    cut_off = (F.col("i") == F.col("_n") - 1) & ~markup & piece.rlike(r"(?s)&[^\s;]{0,33}\z|^<\z")
    text = F.when(raw, piece).when(markup | cut_off, F.lit(None)).otherwise(decoded(piece))
    name = F.when(tag, F.lower(F.regexp_extract(piece, r"^<(?:/\s*)?([a-zA-Z][^\s/>]*)", 1))).otherwise("")
    out = rows.select(key, "i", "piece", F.coalesce(name, F.lit("")).alias("name"), F.coalesce(tag & piece.startswith("</"), F.lit(False)).alias("close"), F.coalesce(tag & piece.endswith("/>") & ~piece.startswith("</"), F.lit(False)).alias("alone"), text.alias("text"))
    opened = ~F.col("close")
    return out.select(
        key, "i", "name", "close", "alone", "text",
        F.when((F.col("name") == "a") & opened, _attribute(piece, "href")).alias("href"), F.when((F.col("name") == "div") & opened, _attribute(piece, "class")).alias("class"),
    )


def to_markdown(pages: DataFrame, key: str) -> DataFrame:
    """key, markdown of pages (key, html): headings, paragraphs, emphasis, code, nested lists, tables, links and callouts.

    ``key`` is a distinct column. The events of a page are its rows in order: list depth, preformatted text and the end of
    a link are windows over them. A link's text comes where the link ends, and is lost where it doesn't. Null and empty
    html give a line break alone.
    """
    order = Window.partitionBy(key).orderBy("i")
    back = Window.partitionBy(key).orderBy(F.desc("i"))  # a running minimum from behind: a frame that ends behind all rows looks at all of them again for each
    name, close, alone = F.col("name"), F.col("close"), F.col("alone")
    starts = ~close & ~alone
    rows = page_events(pages, key).select(
        key, "i", "name", "close", "alone", "text", "class", F.col("href").alias("own"),
        F.greatest(F.lit(0), F.sum(F.when(name.isin("ul", "ol") & ~alone, F.when(close, -1).otherwise(1)).otherwise(0)).over(order)).cast("int").alias("depth"),
        F.coalesce(F.last(F.when(name == "pre", starts), ignorenulls=True).over(order), F.lit(False)).alias("pre"),
        F.coalesce(F.last(F.when(name == "a", starts), ignorenulls=True).over(order), F.lit(False)).alias("linked"),
        F.last(F.when((name == "a") & ~close, F.col("href")), ignorenulls=True).over(order).alias("href"),
        F.min(F.when((name == "a") & (close | alone), F.col("i"))).over(back).alias("link_end"),
    )
    text = F.col("text").isNotNull()
    heading = name.rlike("^h[1-6]$")
    opened = (
        F.when(heading, F.concat(F.lit("\n"), F.repeat(F.lit("#"), F.substring(name, 2, 1).try_cast("int")), F.lit(" ")))
        .when(name == "li", F.concat(F.lit("\n"), F.repeat(F.lit("  "), F.col("depth") - 1), F.lit("- ")))
        .when((name == "div") & F.col("class").rlike(CALLOUT_CLASSES), "\n> ")
        .when(name == "a", F.when(alone | F.col("link_end").isNotNull(), "[").otherwise(""))
        .when(name == "code", F.when(F.col("pre"), "").otherwise("`"))
        .otherwise(_of(OPENS, name))
    )
    closed = F.when(heading, "\n").when(name == "a", F.concat(F.lit("]("), F.coalesce("href", F.lit("")), F.lit(")"))).when(name == "code", F.when(F.col("pre"), "").otherwise("`")).otherwise(_of(CLOSES, name))
    words = F.when(F.col("linked") & F.col("link_end").isNull(), "").otherwise(F.col("text"))
    out = F.when(text, words).when(name == "", "").when(alone, F.concat(opened, closed)).when(close, closed).otherwise(opened)
    moved = F.col("linked") & F.col("link_end").isNotNull() & (text | (name == "a"))
    at = F.struct(F.when(moved, F.col("link_end")).otherwise(F.col("i")).alias("to"), F.when(moved, F.col("i")).otherwise(F.when(name == "a", F.lit(1 << 30)).otherwise(-1)).alias("by"), F.coalesce(out, F.lit("")).alias("out"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(at)), lambda x: x["out"]), "")
    done = F.regexp_replace(F.regexp_replace(whole, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    return rows.groupBy(key).agg(F.concat(done, F.lit("\n")).alias("markdown"))


def markdown_path(url: Column, module: Column) -> Column:
    """module/path_with_underscores.md of a page; a page without a path is its module's index."""
    path = F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z][\w+.\-]*://[^/?#]*([^?#]*)", 1), "^/+|/+$", "")
    return F.concat(module, F.lit("/"), F.when(path == "", "index").otherwise(F.replace(path, F.lit("/"), F.lit("_"))), F.lit(".md"))


def breadcrumb(url: Column, parent: Column, module: Column) -> Column:
    """Module, parent page if any, page."""
    return F.filter(F.array(module, parent, url), lambda x: x.isNotNull())


def yaml_escaped(text: Column) -> Column:
    """Backslashes, quotes and line breaks escaped, carriage returns gone."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def changed(pages: DataFrame, manifest: DataFrame, content_hash: Column) -> DataFrame:
    """Pages (url, ...) that the manifest (url, content_hash) doesn't have with their hash: new and changed ones."""
    return pages.withColumn("content_hash", content_hash).join(manifest.select("url", "content_hash"), ["url", "content_hash"], "left_anti")


def crawl(links: DataFrame, depths: DataFrame) -> DataFrame:
    """url, depth, parent_url: reached pages (node, depth) with the first page by name, one level up, that links to each.

    ``links`` has source_sha and target_sha, as ``traverse.bfs`` walks them; start pages have no parent.
    """
    above = depths.select(F.col("node").alias("source_sha"), F.col("depth").alias("up"))
    found = links.join(above, "source_sha").select(F.col("target_sha").alias("node"), "source_sha", "up")
    parent = depths.join(found, "node").filter("up = depth - 1").groupBy("node").agg(F.min("source_sha").alias("parent_url"))
    return depths.join(parent, "node", "left").select(F.col("node").alias("url"), "depth", "parent_url")
