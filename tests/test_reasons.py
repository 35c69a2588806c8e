"""What translation_plausible and html_visible_text decide, beyond what their queries return: every reason, and the visible text itself."""

from pyspark.sql import functions as F

from gristmill.functions import pages as P
from gristmill.functions import text as T

#: Texts with a quantity, or with three numbers of up to three digits, and texts with neither.
MEASURED = ["2 cups of rice", "1 2 3", "a\n- 2 kg flour", "5 g salt " * 100, "\n- add 20 mg salt", "\n- add 500 G salt", "\n- 180 °C", "\n- 1,5 L", "\n# 12345 1 22 333"]
BARE = ["plain words", "\n# 1 2", "word " * 200, "x" * 79, "x" * 80, "\n* 3 min", "\n- wait 5 minutes", "\n- in 2019 2020 2021", "a20 g"]


def _reason(original, translated):
    t, n = translated or "", len(original or "")
    if not t.strip():
        return "empty translation"
    if n > 200 and len(t) / n < 0.4:
        return f"length ratio {len(t) / n:.2f} < 0.4"
    if t in BARE:
        return "no quantities or numeric content"
    return "no list/heading structure" if not any(x in t for x in ("\n- ", "\n* ", "\n#")) and len(t) < 800 else "ok"


def test_every_reason(spark):
    texts = [None, "", "   ", " \n", *MEASURED, *BARE]
    rows = [(o, t) for o in (None, "short", "y" * 200, "y" * 201) for t in texts]
    df = spark.createDataFrame(rows, "o string, t string")
    found = {(r["o"], r["t"]): (r["x"]["reason"], r["x"]["ok"]) for r in df.select("o", "t", T.plausible(F.col("o"), F.col("t")).alias("x")).collect()}
    assert found == {(o, t): (x := _reason(o, t), x == "ok") for o, t in rows}
    assert {x.split(" ")[0] for x, _ in found.values()} == {"empty", "length", "no", "ok"}


def test_the_visible_text_itself(spark):
    pages = {
        "<html><head><title>T</title><style>p {a: b}</style></head><body><p>One <b>two</b></p><script>var x = 1</script><!-- no --><p>three &amp; four</p></body></html>": "One two three & four",
        "<body><ul><li>a</li><li>b</li></ul></body>": "a b",
        "no tags": "no tags",
        "<script>only()</script>": "",
        "": "",
    }
    df = spark.createDataFrame([(h,) for h in pages], "html string")
    found = {r["html"]: r["p"]["visible"] for r in df.select("html", P.parsed_page("html").alias("p")).collect()}
    assert {h: " ".join((v or "").split()) for h, v in found.items()} == pages
