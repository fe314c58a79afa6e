"""One pass over a page's HTML: title, rendered text by selector, link targets."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

from lorespan.fixed_values import CONTENT_SELECTORS, MIN_RAW_CHARS

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_HIDDEN = frozenset("script style template noscript head title".split())
_BLOCK = frozenset(
    "address article aside blockquote body dd details div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tr ul".split())
_SELF_CLOSING = frozenset({"p", "li", "dt", "dd", "tr", "td", "th", "option"})
_SPACE = re.compile(r"[ \t\n\r\f]+")


class _Page(HTMLParser):
    """Collects text pieces and line-break requests; a selector's text is a slice of them."""

    def __init__(self, selectors):
        super().__init__(convert_charrefs=True)
        self.selectors = selectors
        self.pieces: list[str | int] = []       # text, or a number of required line breaks
        self.spans: dict[str, list] = {}        # selector -> [start, end or None]
        self.open: list[tuple[str, list[str]]] = []
        self.hidden = 0
        self.title: list[str] | None = None
        self.in_title = False
        self.hrefs: list[str] = []

    def _break(self, tag):
        if tag in _BLOCK:
            self.pieces.append(2 if tag == "p" else 1)

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "a" and attrs.get("href"):
            self.hrefs.append(attrs["href"])
        if tag == "br":
            self.pieces.append("\0")
        if tag in _VOID:
            self._break(tag)
            return
        if tag in _SELF_CLOSING and self.open and self.open[-1][0] == tag:
            self.handle_endtag(tag)
        if tag == "title" and self.title is None:
            self.title, self.in_title = [], True
        self._break(tag)
        ids = {tag, "#" + (attrs.get("id") or "")} | {"." + c for c in (attrs.get("class") or "").split()}
        mine = [s for s in self.selectors if s in ids and s not in self.spans]
        for s in mine:
            self.spans[s] = [len(self.pieces), None]
        self.open.append((tag, mine))
        self.hidden += tag in _HIDDEN

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "p" and not any(t == "p" for t, _ in self.open):
            self._break(tag)
        if not any(t == tag for t, _ in self.open):
            return
        while self.open:
            name, mine = self.open.pop()
            self.hidden -= name in _HIDDEN
            for s in mine:
                self.spans[s][1] = len(self.pieces)
            self._break(name)
            if name == "title":
                self.in_title = False
            if name == tag:
                return

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.hidden:
            self.pieces.append(data)


def _rendered(pieces) -> str:
    """Visible text: white space collapses, block edges become line breaks."""
    out: list[str] = []
    wanted = 0          # line breaks required before the next text
    line = ""           # text since the last break, still uncollapsed

    def flush():
        nonlocal line, wanted
        rows = [_SPACE.sub(" ", part).strip(" ") for part in line.split("\0")]
        text = "\n".join(rows)
        line = ""
        if text:
            if out:
                out.append("\n" * wanted)
            out.append(text)
            wanted = 0

    for piece in pieces:
        if isinstance(piece, int):
            flush()
            wanted = max(wanted, piece)
        else:
            line += piece
    flush()
    return "".join(out)


def parse_page(url: str, html: str, selectors=CONTENT_SELECTORS, min_chars: int = MIN_RAW_CHARS):
    """``(title, raw_text, links)``; the text is the first selector's with enough characters."""
    page = _Page(selectors)
    page.feed(html)
    page.close()
    if "body" in selectors:
        page.spans.setdefault("body", [0, None])
    raw = None
    for s in selectors:
        if s in page.spans:
            start, end = page.spans[s]
            text = _rendered(page.pieces[start:end]).strip()
            if len(text) > min_chars:
                raw = text
                break
    title = _SPACE.sub(" ", "".join(page.title or [])).strip(" ")
    return title, raw, [urljoin(url, h) for h in page.hrefs]
