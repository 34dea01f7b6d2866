from __future__ import annotations

import numpy as np

from weftline.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style></head><body><nav><ul><li><a href="/x">Menu</a></li></ul></nav>
<header>Site</header><div class="cookie-notice">We use cookies</div><main><article class="post"><header><h1>Head  line</h1></header><p>One &lt;b&gt; &amp; <b>two</b>
 three<br>four<p>Five<script>var t="</p>";</script><!-- <p>no</p> --><ul><li>a<li>b</ul><div class="share-buttons">Share</div>
<section id="comments"><p>Nice!</p></section></article><aside>More</aside></main><form>Mail <input></form><footer>&copy; x</footer>"""


def test_main_region():
    assert html.main_texts([PAGE]) == ["Head line\nOne <b> & two three four\nFive\na\nb"]


def test_odd_pages():
    pages = ["", "no markup at all", "<p>open <b>never <i>closed", "<article></article>", "<<<>>> 1 < 2 & 3 > 2", "<article><p>a b&nbsp;c</p></article>", "<article>x</article><article>y</article>"]
    assert html.main_texts(pages) == ["", "no markup at all", "open never closed", "", "<<<>>> 1 < 2 & 3 > 2", "a b c", "x\ny"]


def brute(streams, depth):
    """streams: per page a list of blocks of tokens."""
    seen = {}
    for p, blocks in enumerate(streams):
        for b in blocks:
            for i in range(len(b)):
                for key in ([tuple(b[i : i + depth])] if len(b) - i >= depth else [tuple(b)] if i == 0 else []):
                    seen.setdefault((key, len(b) < depth), set()).add(p)
    out = []
    for blocks in streams:
        for b in blocks:
            cover = [False] * len(b)
            for i in range(len(b)):
                short = len(b) < depth
                if (len(b) - i >= depth or (short and i == 0)) and len(seen[tuple(b[i : i + depth]), short]) > 1:
                    cover[i : i + min(depth, len(b))] = [True] * min(depth, len(b))
            out += cover
    return out


def test_suffix_array_against_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(20):
        streams = [[rng.integers(0, 3, rng.integers(1, 12)).tolist() for _ in range(3)] for _ in range(4)]
        tokens = np.array([t for s in streams for b in s for t in b], np.uint64)
        page = np.array([p for p, s in enumerate(streams) for b in s for _ in b])
        bound = np.array([i == len(b) - 1 for s in streams for b in s for i in range(len(b))])
        assert html.repeated(tokens, page, bound, 4).tolist() == brute(streams, 4)


def test_boilerplate_of_pages_without_main_region():
    pages = [f"<div>Welcome to our site of many fine things</div><div>Story number {'abcdef'[i]} is told {'uvwxyz'[i]} here</div><div>All rights reserved</div>" for i in range(6)]
    assert html.main_texts(pages) == [f"Story number {'abcdef'[i]} is told {'uvwxyz'[i]} here" for i in range(6)]


def test_repeated_articles_stay(spark):
    rows = [(i, "http://h.example.com/a", PAGE, 1) for i in range(5)] + [(5, None, None, 1), (None, "x", "", 1), (6, "http://h.example.com/", "<p>alone</p>", 1)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, part int"), group_chars=2000).collect()
    assert len(got) == 8
    assert {r.text for r in got if r.page_id in range(5)} == {"Head line\nOne <b> & two three four\nFive\na\nb"}
    assert {(r.page_id, r.text, r.n_chars) for r in got if r.page_id in (None, 5, 6)} == {(5, "", 0), (None, "", 0), (6, "alone", 5)}
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_repeats_are_sought_in_the_whole_host(spark):
    passage = "This passage of nine words stands on few pages"
    own = [" ".join(f"w{i}x{k}" for k in range(400)) for i in range(40)]
    rows = [(i, f"http://big.example.com/{i}", f"<div>{own[i]}</div>" + f"<div>{passage}</div>" * (i in (3, 17, 31))) for i in range(40)]
    rows += [(100 + i, f"http://other.example.com/{i}", f"<div>{own[i]}</div><div>{passage if i == 3 else 'x'}</div>") for i in (3, 4)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: own[i] for i in range(40)} | {103: f"{own[3]}\n{passage}", 104: f"{own[4]}\nx"}
    for options in ({"group_chars": 5000}, {"group_chars": 5000, "most_broadcast": 0}, {}):
        assert {r.page_id: r.text for r in html.extract(frame, **options).collect()} == want
    assert html.main_texts(["<p>three words here</p>"]) == ["three words here"]


def test_site_notices_in_main_regions_go_and_copied_passages_stay(spark):
    own = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(12)]
    notice, passage = "Every page of this site carries this notice", "Some of the articles quote this whole passage here"
    pages = [f"<article><p>{own[i]}</p><p>{passage if i < 4 else 'Odd'}</p><p>{notice}</p></article>" for i in range(12)]
    want = [f"{own[i]}\n{passage}" if i < 4 else f"{own[i]}\nOdd" for i in range(12)]
    want[4:] = own[4:]  # 'Odd' stands on most pages
    assert html.main_texts(pages) == want
    copies = [f"<article><p>{notice} {own[0]}</p><p>Edit {i}</p></article>" for i in range(12)]
    assert html.main_texts(copies) == [f"{notice} {own[0]}\nEdit {i}" for i in range(12)]
    frame = spark.createDataFrame([(i, "http://a.example.com/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    for most in (0, 1000):
        assert [r.text for r in html.extract(frame, most_broadcast=most).orderBy("page_id").collect()] == want


def test_copies_and_headings_of_pages_without_main_region_stay(spark):
    own = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(20)]
    pages = [f"<div>{own[i]}</div><div>{'Conclusion' if i < 4 else i}</div><div>The same words stand at the end of all pages</div>" for i in range(20)]
    want = [f"{own[i]}\n{'Conclusion' if i < 4 else i}" for i in range(20)]
    near = [f"<div>{own[0]} and then the story goes on</div><div>Copy {i}</div>" for i in range(4)]
    got = html.main_texts(pages + near + pages[:1] * 3)
    assert got == want + [f"{own[0]} and then the story goes on\nCopy {i}" for i in range(4)] + want[:1] * 3
    for copies in (2, 3, 50):  # of a page, alone on its host
        frame = spark.createDataFrame([(i, "http://c.example.com/", pages[0]) for i in range(copies)], "page_id long, url string, html string")
        assert {r.text for r in html.extract(frame).collect()} == {"\n".join(t for t, _ in html.blocks(pages[0]))}
    two = [f"<div>{own[0]}</div><div>{i} of two</div>" for i in (1, 2)]
    assert html.main_texts(two) == [f"{own[0]}\n{i} of two" for i in (1, 2)]


def test_wrappers_with_words_of_noise_stay():
    story = "<article><p>The whole story is told here</p></article>"
    for page in (
        f"<div class='page no-sidebar'>{story}</div>", f"<div id='wrapper' class='has-header'>{story}</div>", f"<form action='x'><nav>Menu</nav><div>{story}</div></form>",
        f"<div class='sidebar'>{story}</div>", f"<div class='page header'><nav>Menu</nav><main>{story}</main></div>", f"<form><div class='search'>Find</div><div id='content'><p>The whole story is told here</p></div></form>",
        "<section id='related-work'><p>The whole story is told here</p></section>", "<div class='sidebar'><p>The whole story is told here</p></div><div class='ad'>Buy</div>",
        f"{story}<div class='related-posts'><article>Other</article></div><form><p>Mail us all of your many words if you like</p></form>",
        f"<article><p>The whole story is told here</p><div class='ad-box'>Buy <span class='share'>it</span></div></article>", f"<div hidden>{story}</div>{story}",
    ):
        assert html.main_texts([page]) == ["The whole story is told here"], page
    assert html.main_texts(["<div>Body text that has no mark of its own</div><div class='sidebar'><article>Tease</article></div>"]) == ["Body text that has no mark of its own\nTease"]


def test_unique_runs_of_covered_blocks_stay():
    opening = "welcome to the pages of our house where everything you read is told"
    pages = [f"<p>{opening} {end}</p><p>own text of page {n} stands here alone</p>" for n, end in enumerate(("and now a tale of seven red foxes", "but first the price of wheat in may", "17", "while rivers rise in the early spring"))]
    got = html.main_texts(pages)
    assert got[0].split("\n")[0] == "and now a tale of seven red foxes"
    assert got[1].split("\n")[0] == "but first the price of wheat in may"
    assert got[2] == "own text of page 2 stands here alone"
    assert html.unique_runs("a b c d e f", np.array([1, 1, 0, 0, 0, 0], bool)) == "c d e f"
    assert html.unique_runs("a b c d e f", np.array([0, 0, 0, 1, 1, 1], bool)) == ""
