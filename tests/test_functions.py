"""Edge cases of functions and operators, on rows of our own."""

import re

import numpy as np
from pyspark.sql import functions as F

from gristmill.functions import documents as D
from gristmill.functions import pages as P
from gristmill.functions import scores as S
from gristmill.functions import text as T
from gristmill.functions import urls as U
from gristmill.operators import cohorts, funnel, state


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_urls(spark):
    def norm(u):
        return one(spark, U.normalize_url(F.lit(u)))

    assert norm("HTTP://www.Example.com:80/a/b//?utm_source=x&b=&b=2#frag") == "http://example.com/a/b?b=&b=2"
    assert norm("https://example.com:80/") == "https://example.com:80/"
    assert norm("  ") == ""
    assert one(spark, U.root_domain(F.lit("https://a.b.example.co.uk/x"))) == "co.uk"
    held = one(spark, U.url_variants(F.lit("https://www.example.com/a/")))
    assert held[0] == "https://www.example.com/a/" and len(set(held)) == len(held) == 4


def _normalized(u):
    """normalize_url in plain Python."""
    u = re.sub(r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+\Z", "", u or "")
    if not u:
        return ""
    scheme, netloc, path, query = re.match(r"(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?", u).groups()
    scheme, host = (scheme or "https").lower(), (netloc or "").lower().removeprefix("www.")
    host = host.removesuffix({"http": ":80", "https": ":443"}.get(scheme, "\0"))
    path = re.sub(";[^/]*$", "", path) or "/"
    path = path.rstrip("/") if len(path) > 1 else path
    path = path if path.startswith("/") or not path else "/" + path
    pairs = [(p.partition("=")[0], p.partition("=")[2]) for p in (query or "").split("&") if p]
    query = "&".join(f"{k}={v}" for k, v in pairs if k.lower() not in U.TRACKING)
    return f"{scheme}://{host}{path}" + (query and f"?{query}")


def test_urls_are_those_of_plain_python(spark):
    heads, hosts = ["", "http:", "https:", "HTTPS:", "ftp:"], ["", "//www.A.example", "//a.example:80", "//a.example:443", "//www.", "//"]
    urls = [None, " ", *(a + b + c + d + e for a in heads for b in hosts for c in ["", "/", "//", "/a/", "/a//", "/a;b", "/a;b/", "/;", "a", "a/", ";", ";/x"] for d in ["", "?", "?a=1&&b", "?Ref=1", "?x=&utm_source=2"] for e in ["", "#f", " "])]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", U.normalize_url(F.col("u")).alias("x")).collect()
    assert len(got) == len(urls) and {r["u"]: (r["x"], _normalized(r["u"])) for r in got if r["x"] != _normalized(r["u"])} == {}


def test_a_url_is_taken_apart_once(spark):
    df = spark.createDataFrame([("http://a.example",)], "u string").select(U.normalize_url(F.col("u")).alias("x"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(coalesce(u#") == 1 and len(re.findall(r"regexp_(?:replace|extract)\(", plan)) <= 20, plan


def test_grade_ladder_edges(spark):
    rows = [r["g"] for r in spark.createDataFrame([(x,) for x in (97.5, 97.4, 42.5, 42.4, -5.0, None)], "s double").select(S.grade(F.col("s")).alias("g")).collect()]
    assert rows[4] == "F" and rows[5] is None and rows[2] != "F" and rows[3] == "F"


def test_fits_agree_with_numpy(spark):
    rng = np.random.default_rng(0)
    da = rng.uniform(5, 95, 60)
    pa = 5 + 0.6 * da - 0.002 * da**2 + rng.normal(0, 2, 60)
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(da, pa, strict=True)] + [("small", float(a), float(a)) for a in range(1, 25)], "k string, da double, pa double")
    fits = {r["k"]: r for r in cohorts.fit_groups(df, ["k"]).collect()}
    assert not fits["small"]["used"] and fits["g"]["used"]
    want = np.polyfit(da, pa, 2)
    resid = pa - np.polyval(want, da)
    assert fits["g"]["model"] == "quadratic"
    assert np.allclose(fits["g"]["coefficients"], want, rtol=1e-6, atol=1e-9) or np.allclose(fits["g"]["coefficients"], want[::-1], rtol=1e-6, atol=1e-9)
    assert abs(1 - (resid**2).sum() / ((pa - pa.mean()) ** 2).sum() - fits["g"]["r2_quadratic"]) < 1e-4


def test_the_line_alone_is_the_line_among_others(spark):
    rng = np.random.default_rng(1)
    rows = [("a", float(x), float(3 + 2 * x + rng.normal())) for x in range(40)] + [("one", 1.0, 2.0)] + [("same", 5.0, float(i)) for i in range(30)] + [("flat", float(i), 7.0) for i in range(30)] + [("few", float(i), float(i)) for i in range(24)] + [("null", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, da double, pa double")
    alone = {r["k"]: r for r in cohorts.fit_groups(df, ["k"], models=("linear",)).collect()}
    among = {r["k"]: r for r in cohorts.fit_groups(df, ["k"]).collect()}
    assert set(alone) == set(among) == {"a", "one", "same", "flat", "few"}
    for k, r in alone.items():
        assert (r["n"], r["used"], r["reason"]) == (among[k]["n"], among[k]["used"], among[k]["reason"])
        assert r["r2_linear"] == among[k]["r2_linear"] or abs(r["r2_linear"] - among[k]["r2_linear"]) < 1e-9
    x = np.arange(40.0)
    y = np.array([r[2] for r in rows[:40]])
    assert np.allclose(alone["a"]["coefficients"], np.polyfit(x, y, 1)) and abs(alone["a"]["sigma_observed"] - (y - np.polyval(np.polyfit(x, y, 1), x)).std()) < 1e-9
    assert alone["flat"]["r2"] == 0.0 and alone["flat"]["sigma_effective"] == 0.5


def test_dedup_keeps_first_row_best_rank_longest_title(spark):
    rows = [("https://a.com/x", "q1", 5, "short", 0), ("http://www.a.com/x/", "q2", 2, "longer title", 1), ("https://a.com/x?utm_source=1", "q3", None, "LONGER TITLE", 2)]
    df = spark.createDataFrame(rows, "url string, query string, rank int, title string, seq int")
    held = funnel.merged_candidates(df).collect()
    assert sum("longer title" in str(r) for r in held) == 1


def test_state_boundaries(spark):
    now = F.to_timestamp(F.lit("2024-01-31 00:00:00"))
    at = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    assert one(spark, state.is_stale(at, 30, now)) is False  # strictly older
    assert one(spark, state.is_due(at, F.lit(30), now)) is True  # reached
    assert one(spark, state.is_due(F.lit(None).cast("timestamp"), F.lit(30), now)) is True
    assert one(spark, state.is_due(at, F.lit(None).cast("int"), now)) is False
    assert one(spark, state.is_stale(F.lit(None).cast("timestamp"), 30, now)) is True


def test_text(spark):
    assert one(spark, T.normalized_title(F.lit("Crème Brûlée!"))).strip() == "creme brulee"
    assert one(spark, T.nullish(F.lit(" NULL "))) is True
    assert one(spark, T.unescaped(F.lit("a &amp; b"))) == "a & b"
    assert one(spark, T.is_foreign(F.lit(""))) is False and one(spark, T.is_foreign(F.lit("fr-FR"))) is True


def test_pages_survive_what_they_hold(spark):
    html = ["<html lang='de'><body><article>One<script>var x = '</p>';</script> two</article></body></html>", "", None, "<div><p>open <b>tags", "<body><main>x &amp; y</main><nav>menu</nav></body>"]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(html)], "id int, html string")
    rows = {r["id"]: r for r in df.select("id", P.parsed_page("html").alias("p")).select("id", "p.visible", P.main_region(F.col("p")).alias("m")).collect()}
    assert rows[0]["m"]["text"] == "One two"
    assert "x & y" in rows[4]["visible"] and "var x" not in rows[0]["visible"]
    assert len(rows) == 5


def test_main_content_by_selector(spark):
    html = {
        "<body><p>intro words that are long enough to win</p><div itemtype='http://schema.org/Recipe'>1 cup, bake 5 minutes</div></body>": "body",
        "<body><nav>menu menu menu</nav><aside><div class='x recipe'>1 cup flour, 2 tbsp oil, preheat, bake, whisk</div></aside><p>short</p></body>": ".recipe",
        "<div class='big-hrecipe'>simmer</div>": "[class*='hrecipe']",
        "<div data-slot-rendered-recipe>boil <script>cup</script></div>": "[data-slot-rendered-recipe]",
        "<div role=main>one</div>": "[role='main']",
        "<article>first</article><article>other</article>": "body",
        "<header class='recipe'>all chrome</header>text": "body",
        "plain": "body",
        "": "body",
    }
    df = spark.createDataFrame([(h,) for h in html], "html string")
    found = {r["html"]: r["m"] for r in df.select("html", P.main_region(P.parsed_page("html")).alias("m")).collect()}
    assert {h: m["selector"] for h, m in found.items()} == html
    assert found["<div data-slot-rendered-recipe>boil <script>cup</script></div>"]["text"] == "boil"
    assert found["<article>first</article><article>other</article>"]["text"] == "first other"
    assert found["<header class='recipe'>all chrome</header>text"]["text"] == "text"


def test_phrases_are_presence_and_count_twice_if_listed_twice(spark):
    assert one(spark, T.hits(F.lit("Spread THE butter, spread the jam"), T.PHRASES)) == 2
    assert one(spark, T.hits(F.lit(None).cast("string"), T.PHRASES)) == 0 and one(spark, T.hits(F.lit("x"), [])) == 0
    v = one(spark, T.verdict(F.lit("prep time cook time total time 1/2 cup tsp tbsp preheat the knead"), T.PHRASES, 7))
    assert (v["accepted"], v["score"]) == (True, 8)
    assert one(spark, T.region_score(F.lit("Boil cups"))) == 9 + 300


def test_quality_gate(spark):
    def gate(name, n, m, *least):
        lines = lambda k: F.array(*[F.lit("x")] * k, F.lit(" "), F.lit(None))
        return tuple(one(spark, D.quality_gate(F.lit(name), lines(n), lines(m), *least)))

    assert gate("n", 3, 3) == (True, "ok")
    assert gate("n", 2, 3) == (False, "fewer than 3 ingredients (2)")
    assert gate("n", 3, 2) == (False, "fewer than 3 instructions (2)")
    assert gate(" ", 9, 9) == gate(None, 9, 9) == (False, "no name")
    assert gate("n", 2, 1, 2, 1) == (True, "ok")
    assert tuple(one(spark, D.quality_gate(F.lit("n"), F.lit(None).cast("array<string>"), F.array(F.lit("x"))))) == (False, "fewer than 3 ingredients (0)")
