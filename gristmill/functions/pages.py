"""Pages to regions, text, metadata, embedded JSON and markdown. Arrow functions read the HTML; choosing, scoring and putting together are columns."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType, StructField, StructType

from gristmill.functions.lexicons import REGION_PHRASES, REGIONS
from gristmill.functions.markup import LINK, SILENT, Writer, events, is_chrome
from gristmill.functions.text import region_score
from gristmill.functions.urls import absolute

_TEXT = StringType()
_REGION = StructType([StructField("selector", _TEXT), StructField("ord", IntegerType()), StructField("at", IntegerType()), StructField("text", _TEXT)])
SCHEMA = StructType([StructField("lang", _TEXT), StructField("title", _TEXT), StructField("base", _TEXT), StructField("visible", _TEXT), StructField("regions", ArrayType(_REGION)), StructField("meta", MapType(_TEXT, _TEXT)), StructField("json", ArrayType(_TEXT))])


class Selectors:
    """Which selector of a list names an element first: tags and classes are looked up, attributes gone through."""

    def __init__(self, selectors: list[str]):
        self.names, self.tags, self.classes, self.attrs = selectors, {}, {}, []
        for i, s in enumerate(selectors):
            if s.startswith("."):
                self.classes.setdefault(s[1:], i)
            elif m := re.fullmatch(r"\[([\w-]+)(?:(\*?)='(.*)')?\]", s):
                self.attrs.append((m[1], m[2] == "*", m[3], i))
            else:
                self.tags.setdefault(s, i)

    def place(self, tag: str, attrs: dict[str, str]) -> int | None:
        found = [self.tags[tag]] if tag in self.tags else []
        if attrs:
            found += [self.classes[c] for c in attrs.get("class", "").split() if c in self.classes]
            found += [i for name, part, value, i in self.attrs if name in attrs and (value is None or (value in attrs[name] if part else value == attrs[name]))]
        return min(found, default=None)


_REGIONS = Selectors(REGIONS)


def _page(html: str) -> tuple:
    """One page as a row of SCHEMA. A region is an element that a selector names; its text leaves out what silent and chrome elements hold, itself included."""
    lang, base, title, texts, meta, scripts = None, None, None, [], {}, []
    regions: list[dict] = []
    stack: list[tuple[str, int, int, dict | None]] = []
    silent = chrome = n = 0
    fresh = True  # whether the next characters begin a text of their own
    for kind, tag, attrs in events(html):
        if kind == "text":
            own = stack[-1][0] if stack else ""
            if own == "title":
                title = tag.strip() if title is None else title
            elif own == "script":
                if scripts and scripts[-1] is None:
                    scripts[-1] = tag
            elif fresh or not texts:
                texts.append((tag, silent, chrome))
            else:
                texts[-1] = (texts[-1][0] + tag, silent, chrome)
            fresh = False
            continue
        fresh = True
        if kind == "open":
            region = None
            if (place := _REGIONS.place(tag, attrs)) is not None:
                region = {"ord": place * 1_000_000 + n, "selector": REGIONS[place], "at": n, "start": len(texts), "end": None, "held": (silent, chrome)}
                regions.append(region)
            if tag == "html":
                lang = attrs.get("lang", lang)
            elif tag == "base":
                base = base or attrs.get("href")
            elif tag == "meta":
                for by in ("property", "name"):
                    if by in attrs:
                        meta.setdefault(f"{by} {attrs[by]}", attrs["content"].strip() if attrs.get("content") else None)
            elif tag == "script" and attrs.get("type", "").lower() == "application/ld+json":
                scripts.append(None)
            own = (int(tag in SILENT), int(is_chrome(tag, attrs)))
            stack.append((tag, *own, region))
            silent, chrome, n = silent + own[0], chrome + own[1], n + 1
        else:
            _, s, c, region = stack.pop()
            silent, chrome = silent - s, chrome - c
            if tag == "script" and scripts and scripts[-1] is None:
                scripts[-1] = ""
            if region:
                region["end"] = len(texts)
    if not any(r["selector"] == "body" for r in regions):  # a page without one is all body
        regions.append({"ord": REGIONS.index("body") * 1_000_000 if "body" in REGIONS else 0, "selector": "body", "at": -1, "start": 0, "end": None, "held": (0, 0)})
    stripped = [t.strip() for t, _, _ in texts]
    rows = [(r["selector"], r["ord"], r["at"], " ".join(x for x, (_, s, c) in zip(stripped[r["start"] : r["end"]], texts[r["start"] : r["end"]], strict=True) if x and (s, c) == r["held"])) for r in sorted(regions, key=lambda r: r["ord"])]
    visible = re.sub(r"\s+", " ", " ".join(t for t, s, _ in texts if not s)).strip()
    return lang, title or "", base, visible, [dict(zip(("selector", "ord", "at", "text"), r, strict=True)) for r in rows], meta, [x for x in scripts if x is not None]


#: Characters of pages that are read before what they hold is handed on: a batch of Arrow has ten thousand pages, and a page read is many times its size.
PIECE_CHARS = 1 << 20


def _pieces(pages: pd.Series) -> Iterator[slice]:
    """A batch in pieces of so many characters, or of one page."""
    start = size = 0
    for i, s in enumerate(pages):
        size += len(s) if isinstance(s, str) else 0
        if size >= PIECE_CHARS:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(pages) or not len(pages):
        yield slice(start, len(pages))


@F.pandas_udf(SCHEMA)
def parsed_page(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Null pages give empty fields; nothing a page holds makes it fail."""
    for x in batches:
        for piece in _pieces(x):
            yield pd.DataFrame([_page(s or "") for s in x.iloc[piece]], columns=["lang", "title", "base", "visible", "regions", "meta", "json"])


def _written(html: str, at: int) -> str:
    w, n, depth = Writer(), 0, 0
    for kind, tag, attrs in events(html):
        if kind == "text":
            if depth or at < 0:
                w.text(tag)
            continue
        if kind == "open":
            if depth or at < 0 or n == at:
                w.open(tag, attrs, n != at and (tag in SILENT or is_chrome(tag, attrs)))
                depth += 1
            n += 1
        elif depth:
            w.close()
            depth -= 1
            if not depth and at >= 0:
                break
    return w.result()


@F.pandas_udf(_TEXT)
def _marked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for html, at in batches:
        for piece in _pieces(html):
            yield pd.Series([None if pd.isna(i) else _written(h or "", int(i)) for h, i in zip(html.iloc[piece], at.iloc[piece], strict=True)], dtype=object)


def markdown_at(html: Column, at: Column, link: Callable[[Column], Column] | None = None) -> Column:
    """The element of this number (-1: the whole page) as markdown, without what is silent or chrome inside it. link: what becomes of a target."""
    parts = F.split(_marked(html, at), LINK)
    return F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, link(x)).otherwise(x)) if link else parts, "")


def spread(df: DataFrame) -> DataFrame:
    """A table of few splits, dealt out to all cores before a costly function; tables of many splits stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def main_region(page: Column, phrases: list[str] = REGION_PHRASES) -> Column:
    """The region of the highest score: characters and 100 for each phrase; the first selector wins ties."""
    scored = F.transform(page["regions"], lambda r: F.struct(region_score(r["text"], phrases).alias("score"), (-r["ord"]).alias("place"), r["selector"].alias("selector"), r["text"].alias("text"), r["at"].alias("at")))
    return F.array_max(scored)


@F.pandas_udf(_TEXT)
def record_json(scripts: pd.Series) -> pd.Series:
    """The records of type Recipe in a page's scripts, indented: an object, or a list if there are several; null if there are none. Malformed scripts are passed over."""

    def told(x: object) -> bool:
        return isinstance(x, dict) and "Recipe" in (t if isinstance(t := x.get("@type"), list) else [t])

    def one(texts: list[str] | None) -> str | None:
        found = []
        for s in texts if texts is not None else []:
            try:
                held = json.loads(s)
            except ValueError:
                continue
            for item in held if isinstance(held, list) else [held]:
                inner = item.get("@graph") if isinstance(item, dict) else None
                found += [x for x in (item, *(inner if isinstance(inner, list) else [])) if told(x)]
        return json.dumps(found[0] if len(found) == 1 else found, indent=2, ensure_ascii=False) if found else None

    return scripts.map(one)


def envelope(title: Column, url: Column, json: Column, body: Column) -> Column:
    """A page as markdown: title (none if blank), URL, embedded records if any, content."""
    named = F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("# "), title, F.lit("\n")))
    held = F.when(F.coalesce(json, F.lit("")) != "", F.concat(F.lit("## STRUCTURED RECIPE DATA (JSON-LD)\n\n```json\n"), json, F.lit("\n```\n")))
    return F.concat_ws("\n", named, F.concat(F.lit("URL: "), url, F.lit("\n")), held, F.lit("## PAGE CONTENT\n"), body)


def meta_of(page: Column, *names: str) -> Column:
    """The content of the first of these meta fields that has any, as property or as name; else empty."""
    return F.coalesce(*[F.try_element_at(page["meta"], F.lit(f"{by} {n}")) for n in names for by in ("property", "name")], F.lit(""))


def open_graph(page: Column, url: Column) -> Column:
    """The eight fields of a page's preview; what it doesn't publish is empty. The image is absolute."""
    image = meta_of(page, "og:image", "twitter:image")
    base = F.coalesce(absolute(page["base"], url), url)
    fields = {
        "image": F.when(image == "", image).otherwise(absolute(image, base)),
        "description": meta_of(page, "og:description", "twitter:description"),
        "imageAlt": meta_of(page, "og:image:alt", "twitter:image:alt"),
        "title": meta_of(page, "og:title", "twitter:title"),
        "siteName": meta_of(page, "og:site_name", "application-name"),
        "author": meta_of(page, "article:author", "author"),
        "publishedTime": meta_of(page, "article:published_time"),
        "modifiedTime": meta_of(page, "article:modified_time"),
    }
    return F.struct(*[c.alias(n) for n, c in fields.items()])
