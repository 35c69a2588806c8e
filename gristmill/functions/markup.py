"""HTML as properly nested events, and markdown written from them. The page functions run both inside Arrow batches."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

# What never holds content, and what frames a page.
SILENT = frozenset({"script", "style", "noscript", "iframe", "svg", "form"})
CHROME = frozenset({"nav", "footer", "aside", "header"})
CHROME_CLASSES = frozenset({"ads", "advertisement", "related-posts", "related", "comments", "social-share"})
VOID = frozenset({"br", "img", "meta", "link", "hr", "input", "source", "wbr", "area", "base", "col", "embed", "track"})
BLOCKS = frozenset({"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "ul"})
RAW = frozenset({"script", "style", "title", "textarea"})

_LISTS, _TABLES = frozenset({"ul", "ol", "menu"}), frozenset({"table"})
_HOLDERS = BLOCKS - {"p"} | {"td", "th", "caption", "button"}
#: A start tag ends these open elements, looked for up to one of those.
_ENDS = {
    "li": (frozenset({"li"}), _LISTS), "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})), "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})), "option": (frozenset({"option"}), frozenset({"select"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})), "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})), "tr": (frozenset({"tr", "caption"}), _TABLES), **{t: (frozenset({"thead", "tbody", "tfoot", "caption"}), _TABLES) for t in ("thead", "tbody", "tfoot")},
}
_TOKEN = re.compile(r"""(?P<text>[^<]+)|(?P<none><!--.*?(?:-->|\Z)|<[!?][^>]*>?)|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>?|<(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>|<(?P<bad>[a-zA-Z][^\s/>]*)(?P<rest>[^>]*)(?:>|\Z)|(?P<mark><)""", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTR.findall(text):
        if value[:1] in ("'", '"'):
            value = value[1:-1]
        out.setdefault(name.lower(), unescape(value) if "&" in value else value)
    return out


def events(html: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """("text", characters, {}), ("open", tag, attributes) and ("close", tag, {}): each element that opens closes, in order, whatever the page leaves out.

    Elements that are void open and close at once; an end without a beginning is passed over, and paragraphs, items, rows and cells end where the next begins.
    """
    stack: list[str] = []
    there: Counter[str] = Counter()
    at, size = 0, len(html)

    def upto(tags: frozenset[str], most: frozenset[str]) -> int | None:
        """Where the innermost of these is open, if nothing of `most` stands above it."""
        if not any(there[t] for t in tags):
            return None
        for i in range(len(stack) - 1, -1, -1):
            if stack[i] in tags:
                return i
            if stack[i] in most:
                return None
        return None

    def cut(i: int | None) -> Iterator[tuple[str, str, dict[str, str]]]:
        while i is not None and len(stack) > i:
            there[stack[-1]] -= 1
            yield "close", stack.pop(), {}

    while at < size:
        m = _TOKEN.match(html, at)
        at, kind = m.end(), m.lastgroup
        if kind == "text" or kind == "mark":
            text = m.group()
            yield "text", unescape(text) if "&" in text else text, {}
        elif kind == "end":
            tag = m["end"].lower()
            if there[tag]:
                yield from cut(len(stack) - 1 - stack[::-1].index(tag))
        elif kind in ("attrs", "rest"):
            tag = (m["tag"] or m["bad"]).lower()
            held = m[kind]
            if tag in _ENDS:
                yield from cut(upto(*_ENDS[tag]))
            if tag in BLOCKS:
                yield from cut(upto(frozenset({"p"}), _HOLDERS))
            yield "open", tag, attributes(held) if held and not held.isspace() else {}
            if tag in VOID:
                yield "close", tag, {}
                continue
            stack.append(tag)
            there[tag] += 1
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                text = html[at : end.start() if end else size]
                at = end.start() if end else size
                if text:
                    yield "text", unescape(text) if tag in ("title", "textarea") else text, {}
    yield from cut(0)


def is_chrome(tag: str, attrs: dict[str, str]) -> bool:
    return tag in CHROME or (bool(attrs) and (attrs.get("role") == "navigation" or attrs.get("id") == "comments" or not CHROME_CLASSES.isdisjoint(attrs.get("class", "").split())))


#: A link's target stands between these until its column function has seen it.
LINK = "\ue000"
_HEADINGS = {f"h{i}": i for i in range(1, 7)}
_AROUND = {"b": "**", "strong": "**", "em": "*", "i": "*", "del": "~~", "s": "~~", "code": "`", "kbd": "`", "samp": "`", "tt": "`"}
_VERBATIM = frozenset({"pre", "code", "kbd", "samp", "tt"})


class _Element:
    __slots__ = ("attrs", "cells", "head", "items", "parts", "rows", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.parts = tag, attrs, []
        self.items, self.head = 0, False
        self.rows: list[tuple[bool, list[str]]] = []
        self.cells: list[str] = []


def _run_on(parts: list[str]) -> str:
    """Parts one after the other; where they meet, the more line ends of the two (two at most), and no blanks beside these."""
    out: list[str] = []
    gap = 0
    for p in parts:
        body = p.strip("\n")
        if not body:
            gap = max(gap, min(2, len(p)))
            continue
        gap = max(gap, min(2, len(p) - len(p.lstrip("\n"))))
        if gap:
            if not (body := body.lstrip(" ")):
                continue
            if out and not (last := out.pop().rstrip(" ")) == "":
                out.append(last)
            out.append("\n" * gap)
        out.append(body)
        gap = min(2, len(p) - len(p.rstrip("\n")))
    if gap:
        out.append("\n" * gap)
    return "".join(out)


def _hug(mark: str, inner: str) -> str:
    """Emphasis around what is not blank; the blanks stay outside."""
    text = inner.strip()
    if not text:
        return " " if inner else ""
    return " " * inner[:1].isspace() + mark + text + mark + " " * inner[-1:].isspace()


def _table(rows: list[tuple[bool, list[str]]], before: str) -> str:
    if not rows:
        return before
    wide = max(len(cells) for _, cells in rows)
    lines = [] if rows[0][0] else ["|" + "  |" * wide]
    lines += ["| " + " | ".join(cells) + " |" for _, cells in rows]
    lines.insert(1, "| " + " | ".join(["---"] * wide) + " |")
    return (f"\n\n{before.strip()}" if before.strip() else "") + "\n\n" + "\n".join(lines) + "\n\n"


class Writer:
    """Markdown from events: an element is written when it closes, from what its children wrote; silent and chrome elements write nothing."""

    def __init__(self) -> None:
        self.stack = [_Element("", {})]
        self.dropped = self.verbatim = self.inline = self.lists = 0

    def open(self, tag: str, attrs: dict[str, str], drop: bool) -> None:
        self.dropped += drop or self.dropped > 0
        self.stack.append(_Element(tag, attrs))
        self.verbatim += tag in _VERBATIM
        self.inline += tag in _HEADINGS or tag in ("td", "th")
        self.lists += tag in _LISTS

    def text(self, text: str) -> None:
        if self.dropped:
            return
        if not self.verbatim:
            text = re.sub(r"[ \t\r\n\f]+", lambda m: "\n" if "\n" in m[0] else " ", text)
            text = re.sub(r"([*_])", r"\\\1", text).replace("\n", " ")
        elif not any(e.tag == "pre" for e in self.stack):
            text = re.sub(r"\s+", " ", text)
        self.stack[-1].parts.append(text)

    def _nearest(self, *tags: str) -> _Element | None:
        return next((e for e in reversed(self.stack) if e.tag in tags), None)

    def close(self) -> None:
        e = self.stack.pop()
        self.verbatim -= e.tag in _VERBATIM
        self.inline -= e.tag in _HEADINGS or e.tag in ("td", "th")
        self.lists -= e.tag in _LISTS
        if self.dropped:
            self.dropped -= 1
            return
        if written := self._written(e):
            self.stack[-1].parts.append(written)

    def _written(self, e: _Element) -> str:
        tag, attrs = e.tag, e.attrs
        if tag == "br":
            return " " if self.inline else "\u2028"
        if tag == "hr":
            return "\n\n---\n\n"
        if tag == "img":
            alt, src = attrs.get("alt", "").replace("\n", " "), attrs.get("src", "")
            return alt if self.inline else f"![{alt}]({LINK}{src}{LINK}{_titled(attrs)})" if src else ""
        if tag == "title":
            return ""
        if tag == "pre":
            text = "".join(e.parts).strip("\n")
            return f"\n\n```\n{text}\n```\n\n" if text.strip() else ""
        inner = _run_on(e.parts) if len(e.parts) > 1 else "".join(e.parts)
        if tag in _AROUND:
            return inner if _AROUND[tag] == "`" and any(x.tag == "pre" for x in self.stack) else _hug(_AROUND[tag], inner.replace("\u2028", " ") if not inner.strip(" \u2028") else inner.strip("\u2028"))
        if tag == "a":
            text, href = inner.strip(" \n\u2028"), attrs.get("href", "")
            if not text or not href:
                return inner
            return " " * inner[:1].isspace() + f"[{text}]({LINK}{href}{LINK}{_titled(attrs)})" + " " * inner[-1:].isspace()
        if tag in _HEADINGS:
            text = " ".join(inner.replace("\u2028", " ").split())
            return f"\n\n{'#' * _HEADINGS[tag]} {text}\n\n" if text else ""
        if tag in ("td", "th"):
            row, text = self._nearest("tr", "table"), " ".join(inner.replace("\u2028", " ").split())
            if row is None or row.tag == "table":
                return f"\n\n{text}\n\n"
            wide = attrs.get("colspan", "1")
            row.head |= tag == "th" and (not row.cells or row.head)
            row.cells += [text.replace("|", "\\|")] + [""] * ((int(wide) if wide.isascii() and wide.isdigit() else 1) - 1 if len(wide) < 4 else 0)
            if tag == "td":
                row.head = False
            return ""
        if tag == "tr":
            table = self._nearest("table")
            if e.cells and table is not None:
                table.rows.append((e.head or self._nearest("thead", "table").tag == "thead", e.cells))
            return inner if table is None else ""
        if tag == "table":
            return _table(e.rows, inner)
        text = inner.strip(" \n\u2028")
        if tag == "li":
            if not text:
                return ""
            of = self._nearest("ul", "ol", "menu")
            if of is not None and of.tag == "ol":
                first = of.attrs.get("start", "1")
                mark = f"{(int(first) if first.isascii() and first.isdigit() and len(first) < 10 else 1) + of.items}. "
                of.items += 1
            else:
                mark = "*+-"[(max(1, sum(x.tag in ("ul", "menu") for x in self.stack)) - 1) % 3] + " "
            return "\n" + mark + text.replace("\n", "\n" + " " * len(mark)).replace("\n" + " " * len(mark) + "\n", "\n\n") + "\n"
        if not text:
            return " " if inner and tag not in BLOCKS else ""
        if tag in _LISTS:
            inner = inner.strip("\n")
            return f"\n{inner}\n" if self.lists else f"\n\n{inner}\n\n"
        if tag == "blockquote":
            return "\n\n" + "\n".join(f"> {x}".rstrip() for x in text.split("\n")) + "\n\n"
        return f"\n\n{text}\n\n" if tag in BLOCKS else inner

    def result(self) -> str:
        while len(self.stack) > 1:
            self.close()
        text = _run_on(self.stack[0].parts)
        return re.sub(r" *\u2028 *", "  \n", re.sub(r"[ \u2028]*\u2028[ ]*(?=\n|$)", "", text)).strip()


def _titled(attrs: dict[str, str]) -> str:
    return ' "' + attrs["title"].replace('"', '\\"').replace("\n", " ") + '"' if attrs.get("title") else ""
