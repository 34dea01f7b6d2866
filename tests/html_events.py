"""What the standard HTML parser reports of a page, and markdown written from it: expected values for the page operators."""

from __future__ import annotations

import re
from html.parser import HTMLParser


class _Events(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out = []

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        self.out.append(("start", tag, (own.get("href") or "") if tag == "a" else None, (own.get("class") or "") if tag == "div" else None))

    def handle_endtag(self, tag):
        self.out.append(("end", tag))

    def handle_data(self, data):
        if self.out and self.out[-1][0] == "text":
            data = self.out.pop()[1] + data
        self.out.append(("text", data))


def events(html: str | None) -> list[tuple]:
    parser = _Events()
    parser.feed(html or "")
    return parser.out


def markdown(html: str | None) -> str:
    """The rules of the operator's docstring, said once more over the events."""
    out, link, href, pre, depth = [], None, "", False, 0
    marks = {"strong": "**", "b": "**", "em": "*", "i": "*"}
    for kind, tag, *more in events(html):
        put = out if link is None else link
        if kind == "text":
            put.append(tag)
        elif tag == "a":
            if kind == "start":
                link, href = [], more[0]
            else:
                out.append(f"[{''.join(link or [])}]({href})")
                link = None
        elif re.fullmatch("h[1-6]", tag):
            out.append("\n" + "#" * int(tag[1]) + " " if kind == "start" else "\n")
        elif tag in marks:
            out.append(marks[tag])
        elif tag == "pre":
            pre = kind == "start"
            out.append("\n```\n")
        elif tag == "code":
            out.append("" if pre else "`")
        elif tag in ("ul", "ol"):
            depth = max(0, depth + (1 if kind == "start" else -1))
        elif kind == "start":
            callout = tag == "div" and re.search("note|tip|important", more[1])
            out.append({"p": "\n\n", "br": "\n", "li": "\n" + "  " * (depth - 1) + "- ", "table": "\n", "tr": "| "}.get(tag, "\n> " if callout else ""))
        else:
            out.append({"td": " | ", "th": " | ", "tr": "\n"}.get(tag, ""))
    return re.sub("\n{3,}", "\n\n", "".join(out)).strip() + "\n"
