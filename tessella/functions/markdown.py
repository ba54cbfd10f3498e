"""Splitting of Markdown and conversion of HTML to it (T1-T3), in plain Python for Arrow batches.

The splitter cuts at the coarsest borders that make pieces fit: headings by level, thematic breaks, blocks (blank lines, list
items, fences), lines, sentences, words, characters. Neighbouring sections of one level are merged while they fit.
Chunks have at most ``size`` characters, are trimmed and not empty, and come in the order of the text; without overlap
they hold every character of it other than white space once. With overlap a chunk begins at the earliest word of the
chunk before that keeps the shared part within ``overlap`` characters and the chunk within ``size``.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

_LEVELS = [re.compile(rf"(?m)^(?=#{{1,{n}}}[ \t])") for n in range(1, 7)] + [
    re.compile(r"(?m)^(?=(?:-{3,}|\*{3,}|_{3,})[ \t]*$)"),
    re.compile(r"\n[ \t]*\n\s*|(?m:^)(?=```|[ \t]*(?:[-*+]|\d+[.)])[ \t]|>[ \t])"),
    re.compile(r"\n"),
    re.compile(r"(?<=[.!?;:])\s+"),
    re.compile(r"\s+"),
]


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    return a, b


def _pieces(text: str, a: int, b: int, size: int, level: int) -> list[tuple[int, int]]:
    a, b = _trim(text, a, b)
    if b - a <= size:
        return [(a, b)] if a < b else []
    if level == len(_LEVELS):
        return [(k, min(b, k + size)) for k in range(a, b, size)]
    cuts = [a, *(m.end() for m in _LEVELS[level].finditer(text, a, b) if a < m.end() < b), b]
    if len(cuts) == 2:
        return _pieces(text, a, b, size, level + 1)
    out: list[tuple[int, int]] = []
    open_: tuple[int, int] | None = None  # sections merged so far
    for x, y in zip(cuts, cuts[1:], strict=False):
        x, y = _trim(text, x, y)
        if x == y:
            continue
        if open_ and y - open_[0] <= size:
            open_ = (open_[0], y)
            continue
        if open_:
            out.append(open_)
            open_ = None
        if y - x <= size:
            open_ = (x, y)
        else:
            out += _pieces(text, x, y, size, level + 1)
    return out + ([open_] if open_ else [])


def spans(text: str, size: int, overlap: int = 0) -> list[tuple[int, int]]:
    """Where the chunks of a text lie."""
    if size < 1:
        raise ValueError("chunk_size must be positive")
    if not 0 <= overlap < size:
        raise ValueError(f"overlap must be less than chunk_size, got {overlap} and {size}")
    found = _pieces(text, 0, len(text), size, 0)
    if not overlap:
        return found
    out = found[:1]
    for (before, end), (a, b) in zip(found, found[1:], strict=False):
        low = max(before + 1, a - overlap, b - size)
        while low < end and not (text[low - 1].isspace() and not text[low].isspace()):
            low += 1
        out.append((low if low < end else a, b))
    return out


def split(text: str, size: int, overlap: int = 0) -> list[str]:
    """T1."""
    return [text[a:b] for a, b in spans(text, size, overlap)]


_SILENT = {"script", "style", "noscript", "template", "head", "svg", "iframe"}
_BLOCK = {"p", "div", "section", "article", "header", "footer", "nav", "aside", "main", "figure", "form", "fieldset", "address", "details", "table", "tr", "dl", "dt", "dd", "body"}
_MARK = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`", "del": "~~", "s": "~~"}


class _Writer(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.silent, self.pre = 0, 0
        self.lists: list[int] = []
        self.links: list[str] = []

    def _line(self, blank: bool = False) -> None:
        self.out.append("\n\n" if blank else "\n")

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in _SILENT:
            self.silent += 1
        if self.silent:
            return
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self._line(True)
            self.out.append("#" * int(tag[1]) + " ")
        elif tag in _BLOCK:
            self._line(True)
        elif tag == "br":
            self._line()
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag in ("ul", "ol"):
            self._line(not self.lists)
            self.lists.append(0 if tag == "ul" else 1)
        elif tag == "li":
            self._line()
            depth = max(0, len(self.lists) - 1)
            number = self.lists[-1] if self.lists else 0
            self.out.append("  " * depth + (f"{number}. " if number else "- "))
            if number:
                self.lists[-1] += 1
        elif tag == "blockquote":
            self.out.append("\n\n> ")
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag == "a":
            self.links.append(a.get("href", ""))
            self.out.append("[")
        elif tag == "img":
            self.out.append(f"![{a.get('alt', '')}]({a.get('src', '')})")
        elif tag in ("td", "th"):
            self.out.append(" | ")
        elif tag in _MARK and not self.pre:
            self.out.append(_MARK[tag])

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
            return
        if self.silent:
            return
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6", "blockquote") or tag in _BLOCK:
            self._line(True)
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self._line(not self.lists)
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self.out.append("\n```\n\n")
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")
        elif tag in _MARK and not self.pre:
            self.out.append(_MARK[tag])

    def handle_data(self, data):
        if self.silent:
            return
        self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def from_html(html: str) -> str:
    """The page as Markdown, blocks parted by a blank line."""
    w = _Writer()
    w.feed(html)
    w.close()
    lines = [x.rstrip() for x in "".join(w.out).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x if x.startswith("  ") and x.strip() else x.strip() for x in lines)).strip()


def unwrap_links(text: str) -> str:
    """T4."""
    return re.sub(r"\[([^\]]+)\]\([^\)]+\)", r"\1", text)
