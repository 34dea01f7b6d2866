"""Links of pages: resolved against their page, kept within a site and section, and whether an alias host serves its site's pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators import markdown, tokens
from weftline.sources import store

_PARTS = r"^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"  # scheme, authority, path, query with its mark, fragment with its mark
_SCHEME, _AUTHORITY, _PATH, _QUERY = 1, 2, 3, 4


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, _PARTS, k)


def resolved(base: Column, reference: Column) -> Column:
    """A reference as an absolute URL without its fragment, as seen from the page ``base`` (an http or https URL).

    Dots and empty segments of paths fold away, an empty path keeps the page's, a query alone replaces the page's query, references with another scheme stay.
    """
    reference = F.trim(F.regexp_replace(reference, r"[\t\r\n]", ""))
    scheme, authority, path, query = (_part(reference, k) for k in (_SCHEME, _AUTHORITY, _PATH, _QUERY))
    own, host, here, asked = (_part(base, k) for k in (_SCHEME, _AUTHORITY, _PATH, _QUERY))
    split = F.split(here, "/")
    above = F.when(F.element_at(split, -1) != "", F.slice(split, 1, F.size(split) - 1)).otherwise(split)
    mine = F.split(path, "/")
    joined = F.concat(above, mine)
    inner = F.filter(F.slice(joined, 2, F.greatest(F.size(joined) - 2, F.lit(0))), lambda s: s != "")
    relative = F.when(F.size(joined) < 3, joined).otherwise(F.concat(F.slice(joined, 1, 1), inner, F.slice(joined, -1, 1)))
    segments = F.when(path.startswith("/"), mine).otherwise(relative)
    none = F.array().cast("array<string>")
    stack = F.aggregate(segments, none, lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.concat(done, F.array(s))))
    stack = F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(stack, F.array(F.lit("")))).otherwise(stack)
    merged = F.array_join(stack, "/")
    merged = F.when(merged == "", "/").otherwise(merged)
    merged = F.when((host != "") & ~merged.startswith("/"), F.concat(F.lit("/"), merged)).otherwise(merged)
    site = F.concat(own, F.lit("://"), host)
    same = (scheme == "") | (F.lower(scheme) == F.lower(own))
    found = (
        F.when(~same, F.regexp_replace(reference, "#.*$", ""))
        .when(authority != "", F.concat(own, F.lit("://"), authority, path, query))
        .when(path == "", F.concat(site, here, F.when(query != "", query).otherwise(asked)))
        .otherwise(F.concat(site, merged, query))
    )
    return F.regexp_replace(found, r"\?$", "")


def host(url: Column) -> Column:
    """The host of a URL in lower case, without user and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(_part(url, _AUTHORITY), "^.*@", ""), r":\d*$", ""))


def _on(url: Column, hosts: dict[str, str]) -> Column:
    """``url`` with the host that stands for its own."""
    out = url
    for alias, canonical in hosts.items():
        out = F.when(host(url) == alias, F.replace(url, F.lit(f"//{alias}"), F.lit(f"//{canonical}"))).otherwise(out)
    return out


def page_links(pages: DataFrame, aliases: dict[str, str] | None = None, verified: tuple[str, ...] = (), same_section: bool = True) -> DataFrame:
    """page_url, place, target: the links of pages (page_url, html) to pages of their own site, in the order in which a page first names them.

    Anchors and scripts drop out, trailing slashes and fragments go. A host and its alias are one site; links that differ only by a ``verified`` alias count as one, under
    the name that comes first. With ``same_section`` the path has to begin with that of the page's folder. Paths with an extension other than html and htm are no
    pages. Null html has no links; pages of equal page_url are one page each by ``page_url`` and place.
    """
    aliases = aliases or {}
    numbered = pages.select("page_url", "html").distinct().withColumn("_page", F.sha2(F.concat_ws("\x00", "page_url", "html"), 256))
    tags = markdown.page_events(numbered.select("_page", "html"), "_page").filter("name = 'a' and href <> ''").select("_page", "i", "href")
    tags = tags.filter(~F.col("href").startswith("#") & ~F.col("href").startswith("javascript:"))
    named = tags.join(numbered.select("_page", "page_url"), "_page")
    target = F.regexp_replace(resolved(F.col("page_url"), F.col("href")), "/+$", "")
    found = named.withColumn("target", target)
    here, there = _on(F.col("page_url"), aliases), _on(F.col("target"), aliases)
    path = _part(F.col("target"), _PATH)
    extension = F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"\.([^.]*)$", 1)
    folder = F.regexp_replace(_part(F.col("page_url"), _PATH), "/[^/]*$", "")
    kept = found.filter((host(here) == host(there)) & extension.isin("", "html", "htm"))
    if same_section:
        kept = kept.filter(path.startswith(folder))
    one = kept.withColumn("_same", _on(F.col("target"), {a: c for a, c in aliases.items() if a in verified}))
    first = one.groupBy("page_url", "_page", "_same").agg(F.min(F.struct("i", "target")).alias("f"))
    return first.select("page_url", F.col("f.i").alias("place"), F.col("f.target").alias("target"))


def alias_sample(pages: DataFrame, aliases: dict[str, str], ratio: float = 0.3, least: float = 0.8) -> DataFrame:
    """alias, canonical, pool, sampled, compared, equal, share, equivalent of each alias host that pages (url, html) have.

    The sample has exactly max(1, floor(pool * ratio)) pages of the alias, those of the least md5 of their URL, so it is the same however the
    pages are dealt. A sampled page is compared where the canonical host has the same path: by the hash of the text but for its white space. Of repeated URLs the page
    of the least hash counts; null and empty pages aren't compared. share is 0 where nothing is.
    """
    hashed = pages.filter("url is not null").select("url", F.when(F.coalesce(F.col("html"), F.lit("")) != "", tokens.content_hash(F.col("html"))).alias("hash"))
    once = hashed.groupBy("url").agg(F.min("hash").alias("hash")).withColumn("alias", host(F.col("url")))
    pool = once.filter(F.col("alias").isin(*aliases)).select("alias", "url", "hash", F.md5("url").alias("h"))
    placed = store.numbered(pool, ["alias", "h", "url"], "_i")
    sizes = placed.groupBy("alias").agg(F.count("*").alias("pool"), F.min("_i").alias("_first"))  # a row per alias
    sizes = sizes.withColumn("sampled", F.greatest(F.floor(F.col("pool") * ratio), F.lit(1)))
    sample = placed.join(F.broadcast(sizes), "alias").filter(F.col("_i") - F.col("_first") < F.col("sampled"))
    pairs = sample.withColumn("_there", _on(F.col("url"), aliases)).join(once.select(F.col("url").alias("_there"), F.col("hash").alias("_other")), "_there", "left")
    both = F.col("hash").isNotNull() & F.col("_other").isNotNull()
    counted = pairs.groupBy("alias", "pool", "sampled").agg(F.count_if(both).alias("compared"), F.count_if(both & (F.col("hash") == F.col("_other"))).alias("equal"))
    share = F.when(F.col("compared") > 0, F.col("equal") / F.col("compared")).otherwise(0.0)
    canonical = F.element_at(F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair)), F.col("alias"))
    return counted.select("alias", canonical.alias("canonical"), "pool", "sampled", "compared", "equal", share.alias("share"), (share >= least).alias("equivalent"))
