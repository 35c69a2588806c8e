"""Languages, grades, scores and chapters given after the fact, beyond what their queries see."""

import json
import math
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.operators import backfill, chapters, languages


def _grams(text):
    out = Counter()
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        w = f" {w} "
        out.update(w[i : i + 3] for i in range(len(w) - 2))
    return out


def test_languages_are_those_of_plain_python(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    rows = d.collect()
    counts = defaultdict(Counter)
    for r in rows:
        if r["lang"] is not None and r["text"] is not None:
            counts[r["lang"]].update(_grams(r["text"]))
    kinds = len(set().union(*counts.values()))
    total = {x: sum(c.values()) + 0.5 * kinds for x, c in counts.items()}
    model = languages.profiles(d)
    found = {r["doc_id"]: r for r in languages.told(d, model, "doc_id", "text").collect()}
    right = 0
    for r in rows:
        grams = _grams(r["text"] or "")
        if len((r["text"] or "").strip(" ")) < 50 or not grams:
            assert r["doc_id"] not in found
            continue
        score = {x: round(sum(c * math.log((counts[x][g] + 0.5) / total[x]) for g, c in grams.items()), 6) for x in counts}
        best = sorted(score, key=lambda x: (-score[x], x))
        got = found[r["doc_id"]]
        assert got["lang"] == best[0] or abs(score[got["lang"]] - score[best[0]]) < 1e-5
        assert abs(got["margin"] - (score[best[0]] - score[best[1]]) / sum(grams.values())) < 1e-5
        right += got["lang"] == r["lang"]
    assert right >= 0.9 * len(found)


def test_a_model_of_nothing_tells_nothing(spark):
    d = spark.createDataFrame([(1, "some text that is long enough to be told by any model at all", None), (2, "1234 " * 20, "en"), (3, None, "en")], "doc_id int, text string, lang string")
    assert languages.told(d, languages.profiles(d.where("lang is null")), "doc_id", "text").count() == 0
    assert languages.told(d.limit(0), languages.profiles(d), "doc_id", "text").count() == 0
    one = languages.told(d, languages.profiles(d.withColumn("lang", F.lit("xx"))), "doc_id", "text").collect()
    assert [(r["doc_id"], r["lang"], r["margin"]) for r in one] == [(1, "xx", None)]


def test_tiers_of_a_page(spark):
    cases = [("<html lang='EN-us'>", "de", "fr", "en"), ("<html data-x lang=en>", " DE-at, en", "fr", "de"), ("<html>", None, "fr", "fr"), ("<html>", "", "", "en"), (None, None, None, "en"), ("<body lang='de'>", "", None, "en")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, h string, head string, told string, want string")
    for r in df.select("i", "want", T.language_of(F.col("h"), F.col("head"), F.col("told")).alias("got")).collect():
        assert r["got"] == r["want"], r
    assert [r["x"] for r in spark.createDataFrame([("el-GR",), ("hi",), ("xx",), ("",), (None,)], "c string").select(T.language_name(F.col("c")).alias("x")).collect()] == ["Greek", "Hindi", "XX", "", ""]


def test_each_step_of_the_ladder(spark):
    fit = F.struct(F.lit("linear").alias("model"), F.array(F.lit(1.0), F.lit(0.0)).alias("coefficients"), F.lit(2.0).alias("sigma_effective"), F.lit(2.0).alias("sigma_observed"), F.lit(30).cast("long").alias("n"))
    fits = spark.createDataFrame([("pie",), ("tart",)], "dish string").withColumn("fit", fit)
    dishes = spark.createDataFrame([("pie", "A", [1.0, 0.0]), ("tart", "B", [0.0, 1.0]), ("bare", "C", [-1.0, 0.0])], "dish string, chapter string, embedding array<double>")
    rows = spark.createDataFrame([(1, True, 1.0, 1.0, "pie", "A", [1.0, 0.0]), (2, False, None, 1.0, "pie", "A", None), (3, None, 10.0, 12.0, "pie", "B", None), (4, False, 10.0, 8.0, "gone", "B", [0.6, 0.8]), (5, False, 10.0, 10.0, None, "Z", [0.9, 0.1]), (6, False, 1.0, 1.0, None, "C", [-1.0, 0.0]), (7, False, 1.0, 1.0, None, None, None)], "id int, graded boolean, da double, pa double, dish string, chapter string, embedding array<double>")
    got = {r["id"]: (r["status"], r["grade"] and r["grade"]["score"], r["matched_dish"], r["match_method"]) for r in backfill.graded_rows(rows, fits, dishes).collect()}
    assert got == {1: ("already", None, None, None), 2: ("skipped-no-da-pa", None, None, None), 3: ("graded-explicit", 85.0, "pie", "explicit"), 4: ("graded-embed", 65.0, "tart", "embedding-match-narrow"), 5: ("graded-embed", 75.0, "pie", "embedding-match-wide"), 6: ("no-match", None, None, None), 7: ("no-match", None, None, None)}
    assert {r["status"] for r in backfill.graded_rows(rows.where("id = 1"), fits, dishes, force=True).collect()} == {"graded-explicit"}


def test_patches_keep_all_else(spark):
    docs = ['{"_source": {"originalUrl": "http://a.example/x"}, "_scoring": {"pageAuthority": 1, "iconUrl": "i", "rawTitle": "old"}, "deep": {"l": [1, {"z": null}]}}', '{"_source": {"originalUrl": "https://www.A.example/x/?utm_source=1"}}', '{"_source": {"originalUrl": "our/own"}, "_scoring": 3}', "3", "{}"]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "id int, j string").select("id", F.parse_json("j").alias("data"))
    scores = spark.createDataFrame([("http://a.example/x", 30.0, 40.0, None, "new"), ("https://a.example/x", 31.0, 41.0, 5.0, "other")], "url_key string, pa double, da double, ou double, raw_title string")
    got = {r["id"]: json.loads(r["j"]) for r in backfill.rescored(rows, scores).select("id", F.to_json("data").alias("j")).collect()}
    assert got[0]["_scoring"] == {"pageAuthority": 30.0, "domainAuthority": 40.0, "iconUrl": "i", "rawTitle": "old"} and got[0]["deep"] == {"l": [1, {"z": None}]}
    assert got[1]["_scoring"] == {"pageAuthority": 31.0, "domainAuthority": 41.0, "ouScore": 5.0, "rawTitle": "other"}
    assert (got[2], got[3], got[4]) == (json.loads(docs[2]), 3, {})


def test_changes_of_pages_stand_beside_their_rows(spark):
    rows = [(i, f'{{"_source": {{"originalUrl": "{u}"}}, "_scoring": {{"pageAuthority": {pa}}}}}') for i, (u, pa) in enumerate([("http://a.example/x", 30), ("http://www.a.example/x/?ref=1", 1), ("http://b.example", 2), ("our own", 3), ("", 4), ("http://A.example/x#f", 5)])]
    scores = spark.createDataFrame([("http://a.example/x", 30.0, 40.0, 1.0, "new")], "url_key string, pa double, da double, ou double, raw_title string")
    a, b = ("http://a.example/x", 30.0, 3, 2), ("http://b.example/", 2.0, 1, 0)
    for most in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
        try:
            out = backfill.with_group_changes(backfill.rescored(spark.createDataFrame(rows, "id int, j string").select("id", F.parse_json("j").alias("data")), scores))
            assert out.columns == ["id", "data", "url_key", "old_pa", "new_pa", "rows", "moved"]
            got = {r["id"]: (r["url_key"], r["new_pa"], r["rows"], r["moved"]) for r in out.collect()}
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert got == {0: a, 1: a, 2: b, 3: (None, 3.0, None, None), 4: (None, 4.0, None, None), 5: a}


def test_records_of_pages_are_worked_out_once(spark, data, monkeypatch):
    from gristmill.plans import backfills

    plans, staged = {}, backfill.staged
    monkeypatch.setattr(backfill, "staged", lambda df, name: (plans.update({name: (_plan(df, "Exchange")[0], df._jdf.queryExecution().optimizedPlan().toString())}), staged(df, name))[1])
    whole = backfills.rescored_groups(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    held, at = plans["rescored"]
    assert held == 1 and at.count("RLIKE") == 1, plans  # ids are dealt out before they become records
    assert "RLIKE" not in whole + plans["moved"][1] and "doc_id" not in whole + plans["moved"][1]


def test_chapters_read_with_care(spark):
    texts = ['{"used": true, "n": 30, "coefficients": [1.5, 2]}', '{"used": false, "n": 3, "reason": "below_min_n"}', '{"used": true, "n"', "[]", "null", "", None, "3", '{"n": 4}']
    got = [(r["f"] and r["f"]["n"], r["s"]) for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("f", chapters.stored_fit(F.col("t"))).withColumn("s", chapters.status_of(F.col("f"))).orderBy("i").collect()]
    assert got == [(30, "graded"), (3, "below_min_n")] + [(None, "never")] * 7
    tops = ['[{"id": 1, "title": "a", "ou": 2.5}]', "[", "{}", None, "[]"]
    got = [[t["id"] for t in r["x"]] for r in spark.createDataFrame([(i, t) for i, t in enumerate(tops)], "i int, t string").orderBy("i").select(chapters.stored_top(F.col("t")).alias("x")).collect()]
    assert got[0] == [1] and got[1:2] + got[3:] == [[], [], []]


def test_notes_are_set_and_cleared(spark):
    at = F.to_timestamp(F.lit("2024-01-01"))
    stored = spark.createDataFrame([("a", "{}", 1, None, "[]", "old"), ("b", None, None, None, None, "stay")], "name string, last_ou_fit string, fit_recipe_count long, fit_updated_at timestamp, top_recipes string, notes string")
    notes = spark.createDataFrame([("a", None), ("c", "new")], "name string, notes string")
    got = {r["name"]: (r["last_ou_fit"], r["notes"], r["fit_updated_at"] is not None) for r in chapters.with_notes(stored, notes, at).collect()}
    assert got == {"a": ("{}", None, False), "b": (None, "stay", False), "c": (None, "new", True)}


def _plan(df, *names):
    text = df._jdf.queryExecution().executedPlan().toString()
    return [len(re.findall(rf"(?m)^[ :+*\-()\d]*{n}\b", text)) for n in names]


def test_fits_and_refreshes_take_few_passes(spark, data, tmp_path):
    from gristmill.operators.cohorts import fit_groups
    from gristmill.plans import ingest

    points = spark.read.parquet(f"{data}/lineitem.parquet").select(F.col("l_suppkey").alias("g"), F.col("l_quantity").alias("da"), F.col("l_extendedprice").alias("pa"))
    scans, shuffles = _plan(fit_groups(points, ["g"]), "(?:File)?Scan parquet", "Exchange")
    assert (scans, shuffles <= 5) == (3, True), (scans, shuffles)  # the sums; for power fits the sums again beside the points
    assert _plan(fit_groups(points, ["g"], models=("linear", "quadratic")), "(?:File)?Scan parquet", "Exchange") == [1, 1]
    results = spark.createDataFrame([(f"https://a.example/{i}", "q", i, "t", i, "d") for i in range(40)], "url string, query string, rank int, title string, seq int, dish string")
    authority = results.select(F.col("url").alias("url_key"), F.lit(40.0).alias("pa"), F.col("rank").cast("double").alias("da"))
    won, lost = ingest.refreshed_group(results, authority, domains=[], paths=[])
    assert _plan(won, "(?:File)?Scan parquet", "Exchange") == _plan(lost, "(?:File)?Scan parquet", "Exchange") == [1, 0]
    assert won.count() + lost.count() == 40


def test_texts_are_dealt_out_once_to_tell_their_language(spark, data, monkeypatch):
    plans, staged = {}, languages.staged
    monkeypatch.setattr(languages, "staged", lambda df, name: (plans.update({name: _plan(df, "Exchange")[0]}), staged(df, name))[1])
    d = spark.read.parquet(f"{data}/documents.parquet")
    assert languages.told(d, languages.profiles(d), "doc_id", "text").count()
    assert plans["asked"] == 1, plans  # texts by key; neither words nor trigrams


def test_more_languages_than_a_block_holds(spark):
    n = 2 * languages.BLOCK + 3
    said = [f"common words of all {chr(97 + i % 26) * 3}{'xyz'[i // 26] * 2}qa stand in the texts of every language Été" for i in range(n)]
    d = spark.createDataFrame([(i, t, f"l{i:02}") for i, t in enumerate(said)], "doc_id int, text string, lang string")
    counts = [_grams(t) for t in said]
    kinds = len(set().union(*counts))
    asked = [*said, "unseen jjjkkk vvvwww letters alone " * 3]
    for whole in (0, 5, 1000):
        got = {r["doc_id"]: r for r in languages.told(spark.createDataFrame(list(enumerate(asked)), "doc_id int, text string"), languages.profiles(d, whole_words=whole), "doc_id", "text").collect()}
        for i, t in enumerate(asked):
            grams = _grams(t)
            score = sorted((round(sum(c * math.log((x[g] + 0.5) / (sum(x.values()) + 0.5 * kinds)) for g, c in grams.items()), 9), -j) for j, x in enumerate(counts))
            assert abs(got[i]["margin"] - (score[-1][0] - score[-2][0]) / sum(grams.values())) < 1e-8
            assert i == n or got[i]["lang"] == f"l{i:02}" == f"l{-score[-1][1]:02}"
