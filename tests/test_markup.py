"""Markdown of pages: written-out cases, and random pages whose markdown is told from what they were made of and not from their HTML."""

import random

import pytest
from pyspark.sql import functions as F

from gristmill.functions import pages as P
from gristmill.functions import urls as U
from gristmill.functions.markup import LINK, events

CASES = {
    "<a href='/q'>link</a><b>bold</b><table><tr><td>1</td><td>2</td></tr></table>": "[link](/q)**bold**\n\n|  |  |\n| --- | --- |\n| 1 | 2 |",
    "<p>One <b> two</b>three<br>four</p>": "One  **two**three  \nfour",
    "<ul><li>a<ul><li>b<li>c <i>x</i></ul><li>d</ul><ol start=3><li><p>x</p><p>y</p><li>z</ol>": "* a\n  + b\n  + c *x*\n* d\n\n3. x\n\n   y\n4. z",
    "<blockquote><p>q1</p><p>q2<blockquote>in</blockquote></blockquote>after": "> q1\n>\n> q2\n>\n> > in\n\nafter",
    "<table><caption>C</caption><thead><tr><th>A<th>B|</thead><tr><td colspan=2>x <b>y</b></table>": "C\n\n| A | B\\| |\n| --- | --- |\n| x **y** |  |",
    "<pre>  code *x*\n\n\n y</pre><p>a*b_c</p><code>x*y</code> z": "```\n  code *x*\n\n\n y\n```\n\na\\*b\\_c\n\n`x*y` z",
    "<h2>Ti <em>tle</em><br>x</h2>text <div>in div</div> tail <img src=a.png alt='p'>": "## Ti *tle* x\n\ntext\n\nin div\n\ntail ![p](a.png)",
    "<p><b>Lead text.<br><p>Next": "**Lead text.**\n\nNext",
    "<body><nav><a href=x>menu</a></nav><div class='a related'>more</div><p role=navigation>go</p><p id=comments>c</p><script>var a='<p>';</script><style>p{}</style><form>f</form>kept</body>": "kept",
    "a < b &amp; c &lt;d&gt; <b></b><i> </i><a href=''>none</a><a name=x>bare</a>": "a < b & c <d>  nonebare",
    "<!-- c --><!doctype html></p></div><p>x</b></p><hr><p title='a>b'>y": "x\n\n---\n\ny",
    "": "",
    "   ": "",
    "<": "<",
    "<p": "",
    "<p class='open>never closed": "never closed",
    "<td>cell alone<li>item alone": "cell alone * item alone",
    "<div>" * 3000 + "deep" + "</div>" * 10: "deep",
    "<b>" * 2000 + "x": "**" * 2000 + "x" + "**" * 2000,
}


def _markdown(spark, pages, link=None):
    df = spark.createDataFrame(list(enumerate(pages)), "id int, html string")
    return [r["m"] for r in df.select("id", P.markdown_at(F.col("html"), F.lit(-1), link).alias("m")).orderBy("id").collect()]


def test_markdown_cases(spark):
    got = dict(zip(CASES, _markdown(spark, list(CASES)), strict=True))
    assert {k[:200]: v for k, v in got.items()} == {k[:200]: v for k, v in CASES.items()}


def _inline(r, depth=0):
    """html, markdown"""
    word = lambda: r.choice(["salt", "flour", "ein", "été", "x<y", "a&b", "50%"])
    shown = lambda w: w.replace("&", "&amp;").replace("<", "&lt;")
    kind = r.choice(["text"] * 4 + ["b", "em", "a", "code", "img"]) if depth < 2 else "text"
    if kind == "text":
        w = [word() for _ in range(r.randint(1, 4))]
        return r.choice([" ", "\n  ", "<!-- x --> "]).join(map(shown, w)), " ".join(w)
    if kind == "code":
        return "<code>a_b*c</code>", "`a_b*c`"
    if kind == "img":
        return '<img alt="pic" src="/i.png">', "![pic](/i.png)"
    h, m = _inline(r, depth + 1)
    return {"b": (f"<strong>{h}</strong>", f"**{m}**"), "em": (f"<i>{h}</i>", f"*{m}*"), "a": (f'<a href="/p?q=1&amp;r=2">{h}</a>', f"[{m}](/p?q=1&r=2)")}[kind]


def _line(r):
    parts = [_inline(r) for _ in range(r.randint(1, 3))]
    return " ".join(h for h, _ in parts), " ".join(m for _, m in parts)


def _list(r, depth=0, bullets=0):
    ordered = r.random() < 0.4
    items, lines, n = [], [], r.randint(1, 3)
    for i in range(n):
        h, m = _line(r)
        mark = f"{i + 1}. " if ordered else "*+-"[bullets % 3] + " "
        if depth < 2 and r.random() < 0.4:
            ih, im = _list(r, depth + 1, bullets + (not ordered))
            h, m = h + ih, m + "\n" + "\n".join(" " * len(mark) + x for x in im.split("\n"))
        items.append(f"<li>{h}" + r.choice(["</li>", ""]))
        lines.append(mark + m)
    tag = "ol" if ordered else "ul"
    return f"<{tag}>{''.join(items)}</{tag}>", "\n".join(lines)


def _cell(r):
    words = " ".join(r.choice(["one", "two", "drei"]) for _ in range(r.randint(1, 3)))
    return words, words


def _block(r, depth=0):
    kind = r.choice(["p", "p", "h", "list", "table", "pre", "quote", "div", "chrome"] if depth < 2 else ["p"])
    if kind == "p":
        h, m = _line(r)
        return f"<p>{h}" + r.choice(["</p>", ""]), m
    if kind == "h":
        n, (h, m) = r.randint(1, 6), _cell(r)
        return f"<h{n}> {h}\n</h{n}>", "#" * n + " " + m
    if kind == "list":
        return _list(r)
    if kind == "table":
        wide, head = r.randint(1, 3), r.random() < 0.5
        rows = [[_cell(r) for _ in range(wide)] for _ in range(r.randint(1, 3))]
        h = "".join("<tr>" + "".join(f"<{'th' if head and not i else 'td'}>{c[0]}" for c in row) for i, row in enumerate(rows))
        lines = [] if head else ["|" + "  |" * wide]
        lines += ["| " + " | ".join(c[1] for c in row) + " |" for row in rows]
        lines.insert(1, "| " + " | ".join(["---"] * wide) + " |")
        return f"<table>{h}</table>", "\n".join(lines)
    if kind == "pre":
        return "<pre>a\n  b *c*</pre>", "```\na\n  b *c*\n```"
    if kind == "chrome":
        return "<aside><p>ad</aside><script>1<2</script>", ""
    h, m = _blocks(r, depth + 1)
    if kind == "div":
        return f"<section><div class=x>{h}</div></section>", m
    return f"<blockquote>{h}</blockquote>", "\n".join(f"> {x}".rstrip() for x in m.split("\n")) if m else ""


def _blocks(r, depth=0):
    parts = [_block(r, depth) for _ in range(r.randint(1, 4))]
    return r.choice(["", "\n", "  "]).join(h for h, _ in parts), "\n\n".join(m for _, m in parts if m)


def test_markdown_of_random_pages(spark):
    made = [_blocks(random.Random(i)) for i in range(200)]
    got = _markdown(spark, [h for h, _ in made])
    for (h, m), g in zip(made, got, strict=True):
        assert g == m, h


def test_links_are_cleaned_by_a_column(spark):
    html = "<a href='https://a.example/x?utm_source=1&id=2&TAG=3#f'>x</a> and <img src='/i.png?gclid=9' alt=i>"
    link = lambda x: U.cleaned_link(U.absolute(x, F.lit("https://b.example/d/e")), ["utm_", "gclid"], ["tag"])
    assert _markdown(spark, [html], link) == ["[x](https://a.example/x?id=2#f) and ![i](https://b.example/i.png)"]


@pytest.mark.parametrize("html", ["<a><b></a></b>", "<ul><li>1<li>2</ul></ul>", "<table><tr><td>x<tr><td>y</table>z", "<p><div></p>", "<br></br>", "<title>a<b></title>", "<script>", "<p a='", "<script>x</scriptx></script>y"])
def test_events_nest(html):
    open_ = []
    for kind, tag, _ in events(html):
        if kind == "open":
            open_.append(tag)
        elif kind == "close":
            assert open_.pop() == tag
    assert not open_


def test_absolute(spark):
    from urllib.parse import urljoin

    base = ["https://a.example/b/c/d?q#f", "http://a.example", "https://a.example/b/"]
    link = ["x.png", "/x.png", "//h.example/x", "https://o.example/y", "?z", "#g", "", "../x", "../../../x", "./x/./y/../z", "..", ".", "x?y=/../z", "mailto:me", "/a/../b"]
    df = spark.createDataFrame([(b, x) for b in base for x in link], "b string, x string")
    for r in df.select("b", "x", U.absolute(F.col("x"), F.col("b")).alias("u")).collect():
        assert r["u"] == urljoin(r["b"], r["x"]), r


def test_record_json(spark):
    recipe = '{"@type": ["Thing", "Recipe"], "name": "é", "a": 1}'
    scripts = [[recipe], ["[" + recipe + ", 3]", "{bad"], ['{"@graph": [' + recipe + ', {"@type": "WebPage"}, "x"]}', recipe], ["{}", "null", "3"], [], None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(scripts)], "id int, s array<string>")
    got = [r["j"] for r in df.select("id", P.record_json("s").alias("j")).orderBy("id").collect()]
    one = '{\n  "@type": [\n    "Thing",\n    "Recipe"\n  ],\n  "name": "é",\n  "a": 1\n}'
    assert got[:2] == [one, one] and got[2].startswith("[\n  {") and got[2].count('"name"') == 2 and got[3:] == [None] * 3


def test_envelope(spark):
    df = spark.createDataFrame([("T", '{"a": 1}'), ("", None), (None, "")], "t string, j string")
    got = [r["e"] for r in df.select(P.envelope(F.col("t"), F.lit("u"), F.col("j"), F.lit("body")).alias("e")).collect()]
    assert got == ["# T\n\nURL: u\n\n## STRUCTURED RECIPE DATA (JSON-LD)\n\n```json\n{\"a\": 1}\n```\n\n## PAGE CONTENT\n\nbody"] + ["URL: u\n\n## PAGE CONTENT\n\nbody"] * 2
    assert LINK not in "".join(got)


def test_a_batch_is_read_and_handed_on_in_pieces(monkeypatch):
    import pandas as pd

    from gristmill.functions import pages

    monkeypatch.setattr(pages, "PIECE_CHARS", 100)
    html = pd.Series(["<p>x</p>" * 5, None, "<p>y</p>" * 40, "", "z"] * 3)
    found = list(pages.parsed_page.func(iter([html, html[:0]])))
    assert len(found) >= 4 and sum(map(len, found)) == len(html)
    assert [v for f in found for v in f["visible"]] == [pages._page(s or "")[3] for s in html]
    marked = list(pages._marked.func(iter([(html, pd.Series([-1, -1, 0, None, -1] * 3))])))
    assert len(marked) >= 4 and sum(map(len, marked)) == len(html)
