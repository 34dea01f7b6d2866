"""Links against urllib's own resolution, and the alias check against a plain one."""

from __future__ import annotations

import hashlib
import random
import re
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlparse

from pyspark.sql import functions as F

from weftline.operators import links as L

REFERENCES = [
    "a", "./a", "../a", "../../a", "../../../../a", "/a", "/a/../b", "/a/./b/", "//other.org/x", "//other.org", "http://x.org/y?z", "https://x.org/a/../b", "?q=1", "", ".", "..", "./", "../", "a/b/../../c", "a//b", "/a//b",
    "a?b#c", "a/./", "a/..", "mailto:x@y.z", "b;p=1", "a b", "é/ü", "x.html", "x.pdf", "g?y/./x", "/..", "/../g", "...", "..g", "g..", "a/?x=../y",
]
BASES = ["http://h.org/a/b/c.html", "https://h.org/a/b/", "http://h.org", "http://h.org/", "http://h.org:80/x?y=1", "https://h.org/a?q=/b/c", "http://h.org/a/b//c/d"]


def test_resolution_as_urllib(spark):
    rng = random.Random(1)
    more = ["/".join(rng.choices(["a", "..", ".", "b.html", "", "c?d"], k=rng.randrange(1, 6))) for _ in range(150)]
    pairs = [(b, r) for b in BASES for r in [*REFERENCES, *more] if not re.match("//+[^o]|//$|///", r)]
    got = spark.createDataFrame(pairs, "base string, reference string").select("base", "reference", L.resolved(F.col("base"), F.col("reference")).alias("u")).collect()
    for r in got:
        assert r.u == urldefrag(urljoin(r.base, r.reference))[0], r


class _Links(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out = []

    def handle_starttag(self, tag, attrs):
        if tag == "a" and dict(attrs).get("href"):
            self.out.append(dict(attrs)["href"])


def plain_links(base, html, aliases, verified, section):
    parser = _Links()
    parser.feed(html or "")
    same = lambda h: aliases.get(h, h)
    seen, out = set(), []
    for ref in parser.out:
        if ref.startswith(("#", "javascript:")):
            continue
        url = urldefrag(urljoin(base, ref))[0].rstrip("/")
        parts = urlparse(url)
        last = parts.path.rsplit("/", 1)[-1]
        if same(parts.hostname or "") != same(urlparse(base).hostname) or ("." in last and last.rsplit(".", 1)[1] not in ("html", "htm", "")):
            continue
        if section and not parts.path.startswith(urlparse(base).path.rsplit("/", 1)[0]):
            continue
        key = url.replace(f"//{parts.hostname}", f"//{aliases[parts.hostname]}", 1) if parts.hostname in verified else url
        if key not in seen:
            seen.add(key)
            out.append(url)
    return out


def test_links_of_pages(spark):
    aliases = {"m.h.org": "h.org"}
    made = "".join(f"<p>x<a class=q href='{r}'>l</a>" for r in [*REFERENCES, "http://m.h.org/a/b/x.html", "http://h.org/a/b/x.html", "x.html#y", "javascript:go()", "#top"]) + '<a href="d?a=1&amp;b=2">d</a> <!-- <a href="gone">g</a> --> '
    pages = [("http://h.org/a/b/c.html", made), ("http://m.h.org/a/", made), ("https://other.net/", None)]
    pages += [(r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    df = spark.createDataFrame(pages, "page_url string, html string")
    for verified, section in (((), True), (("m.h.org",), False)):
        found = {}
        for r in L.page_links(df, aliases, verified, section).orderBy("page_url", "place").collect():
            found.setdefault(r.page_url, []).append(r.target)
        want = {u: plain_links(u, h, aliases, verified, section) for u, h in pages}
        assert found == {u: x for u, x in want.items() if x}


def test_alias_sample_is_the_bottom_by_hash(spark):
    rng = random.Random(5)
    aliases = {"m.h.org": "h.org", "old.x.net": "x.net", "none.y.org": "y.org"}
    pages = [(f"https://{a}/p{i}", f"text {i}") for a, n in (("m.h.org", 57), ("old.x.net", 4)) for i in range(n)]
    pages += [(f"https://{c}/p{i}", None if i % 11 == 0 else f"text  {i} " if rng.random() < 0.8 else "other") for c in ("h.org", "x.net") for i in range(50)]
    df = spark.createDataFrame([*pages, pages[0], (None, "x")], "url string, html string").repartition(5)
    for ratio in (0.1, 0.5, 1.0):
        got = {r.alias: r for r in L.alias_sample(df, aliases, ratio, 0.7).collect()}
        assert set(got) == {"m.h.org", "old.x.net"}
        text = {u: re.sub(r"\s+", " ", h).strip() if h else None for u, h in pages}
        for alias, r in got.items():
            pool = sorted((u for u in text if urlparse(u).hostname == alias), key=lambda u: hashlib.md5(u.encode()).hexdigest())
            chosen = pool[: max(1, int(len(pool) * ratio))]
            pairs = [(text[u], text.get(u.replace(f"//{alias}", f"//{aliases[alias]}"))) for u in chosen]
            pairs = [p for p in pairs if p[0] and p[1]]
            equal = sum(a == b for a, b in pairs)
            assert (r.pool, r.sampled, r.compared, r.equal) == (len(pool), len(chosen), len(pairs), equal)
            assert r.share == (equal / len(pairs) if pairs else 0) and r.equivalent == (r.share >= 0.7)
