"""HTML main text with the repeated suffixes of a host.

Each page's HTML is read into text blocks, each with its place in the page: inside or outside a main region
(article, main, or an element named as content). The suffixes of the blocks' token streams, hashed by prefix doubling
up to DEPTH tokens and seeded by the host, are counted over all pages of the host, however many: those that stand on
several pages with distinct token streams are repeated. Of blocks outside a main region that such suffixes cover only
the unique runs of UNIQUE tokens or more stay. In a main region, where articles may be copied, a block goes only if such suffixes
stand on SITE_SHARE of the host's pages, and not if most of the region would go: that is a copy. Pages with equal
token streams count once; short whole blocks, such as headings, and nearly whole pages go only by SITE_SHARE too.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import bytetext as B
from weftline.llm.groups import sorted_groups
from weftline.llm.session import cut, mapped

DEPTH = 8  # tokens of a repeated substring; shorter blocks repeat as a whole
COVERED = 0.5  # share of a block's tokens under repeated substrings that makes it boilerplate
UNIQUE = 4  # least tokens of a run of a covered block that stays; shorter ones are page numbers, dates and the like
LEAST_PAGES = 3  # distinct pages of a host with a suffix that is repeated; of two, one may be a copy of the other
COPIED = 0.9  # share of a page's tokens under repeats that aren't the site's that makes it a copy
SITE_PAGES = 5  # least distinct pages, and
SITE_SHARE = 0.5  # least share of the host's distinct pages, with a suffix that is the site's
GROUP_CHARS = 4_000_000  # HTML bytes that are read at a time
HELD = 1 << 20  # suffixes that a task counts at a time
BUCKETS = 1 << 10  # of the first count; it keeps 32 more bits of a suffix
MOST_BROADCAST = 4_000_000  # up to so many repeated suffixes are broadcast; more are joined by a shuffle

# fixed values: HTML's element names
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "audio", "video", "canvas", "select", "xmp", "noembed", "noframes")
CHROME = ("nav", "header", "footer", "aside", "form", "dialog", "menu", "button", "fieldset", "head")
BLOCKS = (
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
)
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
CONTAINERS = ("article", "aside", "dialog", "div", "footer", "form", "header", "main", "menu", "nav", "ol", "section", "span", "table", "td", "ul", "button", "fieldset", "p", "li", "blockquote", "figure", "details")
# class, id and role words of what is not the article
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar side footer header masthead topbar "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login comment comments disqus reply replies respond related recommended recommendations share sharing social widget "
    "pagination pager toolbar skip toc contentinfo complementary search".split()
)
# words that stand beside one of NOISE in names of what is not the article; beside others (no-sidebar, related-work) a name means something else
BESIDE = frozenset(
    "area articles bar block bottom box btn button buttons container content desktop global group holder icons inner item items left links list main mobile outer page panel post posts primary right row secondary section site slot "
    "stories story to top unit wrap wrapper zone article entry".split()
)
SOFT = ("form", "fieldset")  # left out as CHROME is, but pages may be wrapped in them
MAIN = frozenset("article content main post entry story".split())
MAIN_HOLDERS = frozenset(("div", "section", "td"))

_ODD = np.uint64(0x9E3779B97F4A7C15)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?=/?[a-zA-Z])[^>]*>?", re.S)
_NAMES = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_RAW, _CHROME, _BLOCKS, _VOID, _CONTAINERS = map(frozenset, (RAW, CHROME, BLOCKS, VOID, CONTAINERS))
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}


def _noise(name: str) -> set[str]:
    """The words of NOISE that a class, id or role consists of, beside words of BESIDE; none if it has others."""
    parts = {w for w in _WORD.findall(name) if len(w) > 1}
    return parts & NOISE if parts <= NOISE | BESIDE else set()


def _role(name: str, attributes: str, inside: bool) -> int:
    """1 for a main region, 0 for any other element, below 0 for what isn't the article: -1 hidden, -2 by its element, -3 by its
    name or a form. Headers in a main region are part of it."""
    words: set[str] = set()
    noise: set[str] = set()
    if attributes:
        for m in _NAMES.finditer(attributes):
            kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if kind == "hidden" or (kind == "aria-hidden" and value == "true"):
                return -1
            if kind in ("class", "id", "role"):
                words.update(_WORD.findall(value))
                for part in value.split():
                    noise |= _noise(part)
    if name in _CHROME:
        return 0 if inside and name == "header" else -3 if name in SOFT else -2
    if name in ("article", "main") and not (noise & {"comment", "comments", "related", "sponsored", "ad"}):
        return 1
    if noise and not (words & MAIN and noise == {"header"}):
        return -3
    return 1 if words & MAIN and not noise and name in MAIN_HOLDERS else 0


@dataclass
class _Noise:
    """An element that isn't the article by its role."""

    role: int
    chars: int = 0
    main: bool = False  # holds a main element
    article: bool = False


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, place) of each block that isn't marked as something else; place 1: inside a main region.

    What is marked by a name or a form stays if it holds a main element or, on pages without another main region, most
    of the text. On such pages any marked element that holds an article stays too, with place 0 if that is less than most.
    """
    out: list[tuple[str, int, tuple[int, ...]]] = []
    run: list[str] = []
    open_: list[tuple[str, int]] = []  # containers and their roles
    noise: list[_Noise] = []
    marked: list[int] = []  # numbers of those that are open
    hidden = inside = at = 0

    def end() -> None:
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            run.clear()
            if text:
                out.append((text, int(inside > 0), tuple(marked)))
                for i in marked:
                    noise[i].chars += len(text)

    def close() -> str:
        nonlocal hidden, inside
        name, role = open_.pop()
        if role < -1:
            end()
            marked.pop()
        hidden -= role == -1
        inside -= role > 0
        return name

    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            if not hidden:
                run.append(page[at:])
            break
        if not hidden and m.start() > at:
            run.append(page[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            if m[1] is not None and not hidden:
                run.append(html.escape(m[1]))
            continue
        name = name.lower()
        if m[2]:
            if name in _BLOCKS:
                end()
            if name in _CONTAINERS and any(x[0] == name for x in open_):
                while open_ and close() != name:
                    pass
            continue
        if name in _BLOCKS or name == "br":
            end() if name != "br" else run.append("\n")
        if name in _RAW and not m[4].endswith("/"):
            close_ = _ENDS[name].search(page, at)
            at = close_.end() if close_ else n
            continue
        if name in _VOID or name not in _CONTAINERS:
            continue
        if name in ("p", "li") and open_ and open_[-1][0] == name:  # an open one ends here
            close()
        role = _role(name, m[4], inside > 0)
        if role < 0:
            end()
        open_.append((name, role))
        hidden += role == -1
        inside += role > 0
        if role > 0 and name in ("main", "article") and not hidden:
            for i in marked:
                noise[i].main |= name == "main"
                noise[i].article = True
        if role < -1:
            marked.append(len(noise))
            noise.append(_Noise(role))
    end()
    if not noise:
        return [(text, place) for text, place, _ in out]
    total = sum(len(text) for text, _, _ in out)
    other = any(place and not within for _, place, within in out)
    most = [2 * x.chars > total for x in noise]
    whole = [x.main or not other and large and (x.role == -3 or x.article) for x, large in zip(noise, most, strict=True)]
    stays = [w or not other and x.article for x, w in zip(noise, whole, strict=True)]
    return [(text, int(place and all(whole[i] for i in within))) for text, place, within in out if all(stays[i] for i in within)]


def windows(tokens: np.ndarray, bound: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Hash and length of the suffix that each token begins, cut to ``depth`` tokens and to its block.

    ``tokens`` are hashes of the concatenated streams, ``bound`` tells whether a block ends with the token. Length 0:
    the suffix is shorter than ``depth`` and no whole block, and doesn't count. Hashes are made by prefix doubling.
    """
    n = len(tokens)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = np.flatnonzero(bound)
    last = ends[np.searchsorted(ends, np.arange(n))]  # of each token's block
    room = np.minimum(last - np.arange(n) + 1, depth)
    value, span = B.mix(tokens.astype(np.uint64) + _ODD), 1  # 0 stands for no token
    while span < depth:
        ahead = np.zeros(n, np.uint64)
        ahead[: max(0, n - span)] = value[span:]
        ahead[room <= span] = 0  # the block ends before
        value = B.mix(value * _ODD + ahead)
        span *= 2
    return value, np.where((room == depth) | np.r_[True, bound[:-1]], room, 0)


def covered(length: np.ndarray) -> np.ndarray:
    """Whether each token lies under one of the runs that begin at the tokens and have these lengths (0: none)."""
    cover = np.zeros(len(length) + 1, np.int64)
    at = np.flatnonzero(length)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + length[at], -1)
    return np.cumsum(cover[:-1]) > 0


def _pairs(value: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (value, page), by page and value."""
    order = np.lexsort((value, page))
    value, page = value[order], page[order]
    new = np.r_[True, (value[1:] != value[:-1]) | (page[1:] != page[:-1])] if len(value) else np.zeros(0, bool)
    return value[new], page[new]


def _found(counts: tuple[np.ndarray, np.ndarray], value: np.ndarray) -> np.ndarray:
    """The count of each value by the sorted values and counts of ``counts``; 0 for others."""
    known, n = counts
    if not len(known):
        return np.zeros(len(value), np.int64)
    at = np.minimum(np.searchsorted(known, value), len(known) - 1)
    return np.where(known[at] == value, n[at], 0)


def repeated(tokens: np.ndarray, page: np.ndarray, bound: np.ndarray, depth: int = DEPTH, least: int = 2) -> np.ndarray:
    """Whether each token lies under a substring of ``depth`` tokens, or a whole block of fewer, that stands on ``least`` pages."""
    value, length = windows(tokens, bound, depth)
    counts = np.unique(_pairs(value[length > 0], page[length > 0])[0], return_counts=True)
    return covered(np.where(_found(counts, value) >= least, length, 0))


@dataclass(frozen=True)
class Streams:
    """Blocks and suffixes of some pages."""

    texts: list[str]
    inside: np.ndarray  # of a main region, by block
    owner: np.ndarray  # page of each block
    first: np.ndarray  # first token of each block, and the number of tokens
    page: np.ndarray  # of each token
    value: np.ndarray  # hash of the suffix of each token, seeded by the page's host
    length: np.ndarray
    stream: np.ndarray  # hash of each page's tokens, seeded by its host
    filled: np.ndarray  # whether a page has tokens
    host: np.ndarray  # a value of each page that counts as a suffix of all pages of its host

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct (suffix, page), with the hosts' values."""
        able = self.length > 0
        return _pairs(np.r_[self.value[able], self.host[self.filled]], np.r_[self.page[able], np.flatnonzero(self.filled)])


def streams(pages: list[str], hosts: np.ndarray) -> Streams:
    """The streams of pages whose hosts have these hashes."""
    parsed = [blocks(p) for p in pages]
    texts = [t for blocks_ in parsed for t, _ in blocks_]
    inside = np.array([p for blocks_ in parsed for _, p in blocks_], bool)
    owner = np.repeat(np.arange(len(pages)), [len(b) for b in parsed])
    data, offsets = B.raw(pa.array(texts, pa.large_string()))
    start, end, first = B.words(data, offsets)
    count = np.diff(first)
    page = np.repeat(owner, count)
    bound = np.zeros(len(start), bool)
    bound[first[1:][count > 0] - 1] = True
    tokens = B.spans(B.byte_sums(data), start, end)
    value, length = windows(tokens, bound)
    seeds = B.mix(hosts + _ODD)
    low, high = np.searchsorted(page, np.arange(len(pages))), np.searchsorted(page, np.arange(len(pages)), "right")
    stream = B.mix(B.spans(B.sums(tokens), low, high) ^ seeds)
    return Streams(texts, inside, owner, first, page, B.mix(value ^ seeds[page]), length, stream, high > low, B.mix(seeds * _ODD))


def _texts(s: Streams, counts: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """The main text of each page by the repeated suffixes' numbers of pages."""
    number, all_ = _found(counts, s.value), _found(counts, s.host)[s.page]
    count = np.diff(s.first)

    def cover(suffixes: np.ndarray) -> np.ndarray:
        return covered(np.where(suffixes, s.length, 0))

    def boilerplate(suffixes: np.ndarray) -> np.ndarray:
        under = np.r_[0, np.cumsum(cover(suffixes))]
        return (under[s.first[1:]] - under[s.first[:-1]]) > COVERED * np.maximum(count, 1)

    def tokens(some: np.ndarray) -> np.ndarray:
        """Tokens of some blocks by page."""
        return np.bincount(s.owner[some], count[some], len(s.stream))

    wide = (number >= LEAST_PAGES) & (number >= SITE_SHARE * all_)
    often = wide | (number >= LEAST_PAGES) & (s.length == DEPTH)
    repeats, whole = boilerplate(often), boilerplate(wide)
    repeats &= whole | (tokens(repeats & ~whole) <= COPIED * tokens(~whole))[s.owner]
    site = s.inside & boilerplate(wide & (number >= SITE_PAGES))
    site &= (2 * tokens(site) <= tokens(s.inside))[s.owner]
    # a page with a main region has its article there; of another page the blocks that are its own
    has_main = np.zeros(len(s.stream), bool)
    has_main[s.owner[s.inside]] = True
    asked = np.where(has_main[s.owner], s.inside, True)
    gone = np.where(has_main[s.owner], site, repeats)
    under = {True: cover(wide & (number >= SITE_PAGES)), False: cover(often)}  # by whether the page has a main region
    lines: list[list[str]] = [[] for _ in s.stream]
    for i in np.flatnonzero(asked):
        text = s.texts[i]
        if gone[i]:
            text = unique_runs(text, under[bool(has_main[s.owner[i]])][s.first[i] : s.first[i + 1]])
        if text:
            lines[s.owner[i]].append(text)
    return ["\n".join(x) for x in lines]


def unique_runs(text: str, under: np.ndarray) -> str:
    """The runs of UNIQUE or more tokens of a block that aren't covered, joined by blanks; none if tokens aren't its words."""
    words = text.split(" ")
    if len(words) != len(under):
        return ""
    edge = np.flatnonzero(np.diff(np.r_[True, under, True].astype(np.int8)))
    return " ".join(" ".join(words[a:b]) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= UNIQUE)


def main_texts(pages: list[str]) -> list[str]:
    """The main text of each of some pages of one host."""
    s = streams(pages, np.zeros(len(pages), np.uint64))
    value, page = s.pairs()
    once = np.zeros(len(pages), bool)
    once[np.unique(s.stream, return_index=True)[1]] = True
    return _texts(s, np.unique(value[once[page]], return_counts=True))


def _read(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.RecordBatch, Streams]]:
    for batch in B.slices(batches, "html", limit):
        yield batch, streams([h or "" for h in batch.column("html").to_pylist()], batch.column("host").to_numpy().view(np.uint64))


def _tallied(parts: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct values and their counts, of about HELD values at a time."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part)
        if n >= HELD:
            yield np.unique(np.concatenate(held), return_counts=True)
            held, n = [], 0
    if n:
        yield np.unique(np.concatenate(held), return_counts=True)


def _prefix(value: np.ndarray) -> np.ndarray:
    """What the first count keeps of a suffix's hash: the bucket and 32 more bits."""
    return value >> np.uint64(32 - BUCKETS.bit_length() + 1)


def _first_count(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for prefix, n in _tallied(_prefix(s.pairs()[0]) for _, s in _read(batches, limit)):
            at = np.searchsorted(prefix, np.arange(BUCKETS + 1, dtype=np.uint64) << np.uint64(32))
            low, times = prefix.astype(np.uint32), np.minimum(n, 255).astype(np.uint8)
            some = np.flatnonzero(np.diff(at))
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), *(pa.array([x[at[i] : at[i + 1]].tobytes() for i in some], pa.binary()) for x in (low, times))],
                ["bucket", "low", "times"],
            )

    return run


def _often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in sorted_groups(batches, ["bucket"]):
        low = np.frombuffer(b"".join(group["low"].to_pylist()), np.uint32)
        times = np.frombuffer(b"".join(group["times"].to_pylist()), np.uint8)
        order = np.argsort(low, kind="stable")
        low = low[order]
        new = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        low = low[new][np.add.reduceat(times[order].astype(np.int64), new) >= LEAST_PAGES]
        yield pa.RecordBatch.from_arrays([pa.array((group["bucket"][0].as_py() << 32) + low.astype(np.int64))], ["prefix"])


def _candidates(limit: int, often):
    """(stream, suffixes) of each page, of the suffixes whose prefixes are in the broadcast array ``often`` (None: of all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if often is None else (often.value, np.ones(len(often.value), np.int64))
        seen: set[int] = set()
        for _, s in _read(batches, limit):
            value, page = s.pairs()
            if known is not None:
                some = _found(known, _prefix(value)) > 0
                value, page = value[some], page[some]
            at = np.searchsorted(page, np.arange(len(s.stream) + 1))
            names, parts = [], []
            for i in np.flatnonzero(np.diff(at)):
                name = int(s.stream[i].view(np.int64))
                if name not in seen:
                    seen.add(name)
                    names.append(name)
                    parts.append(value[at[i] : at[i + 1]].tobytes())
            if len(seen) > HELD:  # only spares rows: copies are left out after the shuffle
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(parts, pa.binary())], ["stream", "value"])

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(value, n) over the distinct streams, which come to one task each."""

    def parts() -> Iterator[np.ndarray]:
        seen: set[int] = set()
        for batch in batches:
            for name, value in zip(batch.column("stream").to_pylist(), batch.column("value").to_pylist(), strict=True):
                if name not in seen:
                    seen.add(name)
                    yield np.frombuffer(value, np.uint64)

    for value, n in _tallied(parts()):
        yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], ["value", "n"])


def _occurrences(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, s in _read(batches, limit):
            value, page = s.pairs()
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("key").to_numpy()[page]), pa.array(value.view(np.int64))], ["key", "value"])

    return run


def _extracted(limit: int, counts=None):
    """By the broadcast ``counts``, or by those in the rows' columns value and n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, s in _read(batches, limit):
            if counts is None:
                value, at = np.unique(pc.list_flatten(batch.column("value")).to_numpy().view(np.uint64), return_index=True)
                known = value, pc.list_flatten(batch.column("n")).to_numpy()[at]
            else:
                known = counts.value
            texts = _texts(s, known)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, group_chars: int = GROUP_CHARS, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """page_id, url, text, n_chars (code points of text) per row of ``pages`` (page_id, url, html).

    Blocks come in page order, one per line, with white space as single blanks. Null, empty and textless html give
    an empty text. Pages whose url is null or has no host form one host. Repeats are counted over the whole host: a
    first count over parts of the hashes finds what may be repeated, a second one counts that exactly over the pages
    with distinct token streams. Up to ``most_broadcast`` repeated suffixes are broadcast to the pages, more are joined to them;
    ``group_chars`` only bounds what a task reads at a time. Neither changes the result. Repeated rows
    repeat in the result. Other columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][\w+.\-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select("page_id", "url", "html", F.xxhash64(host).alias("host"))
    schema = "page_id long, url string, text string, n_chars long"
    read = rows.select("host", "html")
    first = mapped(read, _first_count(group_chars), "bucket int, low binary, times binary")
    often = cut(mapped(first.repartition(width, "bucket").sortWithinPartitions("bucket"), _often, "prefix long"))
    known = spark.sparkContext.broadcast(np.sort(often.toArrow()["prefix"].to_numpy()).view(np.uint64)) if often.count() <= most_broadcast else None
    counts = mapped(mapped(read, _candidates(group_chars, known), "stream long, value binary").repartition(width, "stream"), _counted, "value long, n long")
    counts = cut(counts.groupBy("value").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_PAGES))
    if counts.count() <= most_broadcast:
        got = counts.toArrow()
        value, n = got["value"].to_numpy().view(np.uint64), got["n"].to_numpy()
        order = np.argsort(value)
        return mapped(rows, _extracted(group_chars, spark.sparkContext.broadcast((value[order], n[order]))), schema)
    keyed = rows.withColumn("key", F.xxhash64("host", "html"))
    lists = mapped(keyed.select("host", "html", "key"), _occurrences(group_chars), "key long, value long").join(counts, "value").distinct()
    lists = lists.groupBy("key").agg(F.collect_list(F.struct("value", "n")).alias("found")).select("key", F.col("found.value").alias("value"), F.col("found.n").alias("n"))
    return mapped(keyed.join(lists, "key", "left").drop("key"), _extracted(group_chars), schema)
