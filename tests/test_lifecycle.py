"""Orders, errors and edge cases of listings and of stored rows' changes, and sources and streams on files."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.operators import lifecycle, listings, state, vectors
from gristmill.plans import ingest
from gristmill.sources import records
from gristmill.streaming import journal

NOW = "2024-01-31 00:00:00"


def _now():
    return F.to_timestamp(F.lit(NOW))


def test_due_comes_never_run_first(spark):
    rows = [(1, "2024-01-05", 10), (2, None, 10), (3, "2024-01-01", 10), (4, "2024-01-30", 10), (5, None, None), (6, "2024-01-21", 10)]
    df = spark.createDataFrame(rows, "id int, at string, refresh_ttl_days int").withColumn("last_refreshed", F.to_timestamp("at"))
    assert [r["id"] for r in listings.due(df, _now()).collect()] == [2, 3, 1, 6]


def test_jobs_newest_first_with_filters(spark):
    rows = [(i, "ab"[i % 2], i % 3, "queued", f"2024-01-{i + 1:02d}") for i in range(9)]
    df = spark.createDataFrame(rows, "id int, type string, entity_ref int, status string, created_at string")
    assert [r["id"] for r in listings.jobs(df, type="a", entity_ref=0).collect()] == [6, 0]
    assert [r["id"] for r in listings.jobs(df, limit=2).collect()] == [8, 7]
    assert [r["id"] for r in lifecycle.drained(df, [5, 2, 99]).collect()] == [2, 5]
    assert listings.jobs(df.limit(0)).count() == 0


def test_list_page_orders(spark):
    df = spark.createDataFrame([("b", False, 1, "2024"), ("A", True, None, "2023"), ("c", True, 5, None)], "name string, bad boolean, n int, at string")
    order = lambda s: [r["name"] for r in listings.by_sorter(df, s, F.col("bad"), "name", "n", "at").collect()]
    assert order("attention") == ["A", "c", "b"] and order("name") == ["A", "b", "c"] and order("number") == ["c", "b", "A"] and order("newest") == ["b", "A", "c"]
    with pytest.raises(ValueError):
        order("size")


def test_a_status_that_is_none_is_an_error(spark):
    r = spark.createDataFrame([(1, "new", None, None), (2, "new", "n", None)], "id int, status string, notes string, marked_at timestamp")
    change = lambda s: lifecycle.marked(r, spark.createDataFrame([(1, s, "")], "id int, status string, notes string"), _now())
    assert {x["id"]: (x["status"], x["notes"]) for x in change("skipped").collect()} == {1: ("skipped", None), 2: ("new", "n")}
    with pytest.raises(PySparkException):
        change("gone").collect()


def test_rejects_of_dishes_that_did_not_run_stay(spark):
    schema = "dish_name string, url string, rank int, status string, notes string, marked_at string, created_at string"
    old = spark.createDataFrame([("a", "u1", 1, "new", None, None, "t"), ("a", "u2", 1, "skipped", "n", "m", "t"), ("b", "u1", 1, "new", None, None, "t"), ("c", "u9", 1, "new", None, None, "t"), ("a", "u4", 1, None, None, None, "t")], schema)
    new = spark.createDataFrame([("a", "u2", 3), ("a", "u3", 4), ("a", "u3", 5)], "dish_name string, url string, rank int")
    told = lambda df: {(r["dish_name"], r["url"]): (r["rank"], r["status"], r["notes"]) for r in df.collect()}
    base = {("a", "u2"): (3, "skipped", "n"), ("a", "u3"): (5, "new", None), ("b", "u1"): (1, "new", None), ("a", "u4"): (1, None, None)}
    assert told(state.merged_rejects(old, new)) == {**base, ("c", "u9"): (1, "new", None)}
    ran = spark.createDataFrame([("a",), ("c",)], "dish_name string")
    assert told(state.merged_rejects(old, new, ran=ran)) == base


def test_of_repeated_keys_the_first_comes_in(spark):
    old = spark.createDataFrame([(1, "x"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (2, "b"), (1, "z"), (None, "m"), (3, "d")], "k int, v string")
    assert {(r["k"], r["v"]) for r in state.inserted_absent(old, new, ["k"], "v").collect()} == {(1, "x"), (None, "n"), (2, "b"), (3, "d")}
    assert state.inserted_absent(old.limit(0), new.limit(0), ["k"], "v").count() == 0


def test_two_dishes_keep_their_own_pages(spark):
    rows = [("a", "https://x.com/1", "q", 1, "t", 1), ("a", "https://x.com/2", "q", 2, "t", 2), ("b", "https://www.x.com/2/", "p", 7, "t", 3)]
    results = spark.createDataFrame(rows, "dish string, url string, query string, rank int, title string, seq int")
    authority = spark.createDataFrame([("https://x.com/1", 50.0, 20.0), ("https://x.com/2", 60.0, 20.0)], "url_key string, pa double, da double")
    won, lost = ingest.refreshed_group(results, authority)
    assert {(r["dish"], r["url_key"], r["rank"], r["best_rank"]) for r in won.collect()} == {("a", "https://x.com/2", 1, 2), ("a", "https://x.com/1", 2, 1), ("b", "https://x.com/2", 1, 7)}
    assert lost.count() == 0
    assert "CartesianProduct" not in won._jdf.queryExecution().executedPlan().toString()
    won, lost = ingest.refreshed_group(results, authority.limit(0), n=1)
    assert won.count() == 0 and {r["drop_reason"] for r in lost.collect()} == {"authority-unavailable"}


def test_vectors_of_another_length(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "id int, embedding array<double>")
    bad = spark.createDataFrame([(1, [1.0])], v.schema)
    assert lifecycle.upserted_vectors(v, spark.createDataFrame([(1, [9.0, 9.0]), (3, [0.0, 0.0])], v.schema), 2).count() == 3
    with pytest.raises(PySparkException):
        lifecycle.upserted_vectors(v, bad, 2).collect()
    assert lifecycle.fitting(v.unionByName(bad), 2).count() == 2


def test_match_needs_neither_scope(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [-1.0, 0.0], 2), (3, None, 1)], "vec_id int, embedding array<double>, label int")
    q = v.where("embedding is not null").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.col("label").alias("query_label"))
    found = {r["query_id"]: (r["match"], r["scope"]) for r in vectors.best_match(v, q, F.col("label") == F.col("query_label"), -0.1, among=F.col("vec_id") != F.col("query_id")).collect()}
    assert found == {0: (1, "narrow"), 1: (0, "narrow"), 2: (1, "wide")}
    assert vectors.best_match(v, q.limit(0), F.lit(True)).count() == 0


def test_shortcuts_are_checked():
    assert T.checked_shortcuts({" pie ": "Cake", "": "x", "tart": "__DEFER__"}, ["Cake"]) == ({"pie": "Cake"}, ["tart"])
    with pytest.raises(ValueError, match="Cakes"):
        T.checked_shortcuts({"pie": "Cakes"}, ["Cake"])


def test_titles_of_all_scripts(spark):
    import re
    import unicodedata

    def plain(s):
        s = "".join(c for c in unicodedata.normalize("NFD", s or "") if not unicodedata.combining(c)).lower()
        s = re.sub("[^a-z0-9]+", " ", s).strip()
        return f" {s} " if s else ""

    titles = ["Crème Brûlée!", "Ệ ắ phở", "", "  ", None, "Ёлка x", "été", "ａbc", "K2 Å", "日本 ラーメン 3", "ǅ ǆ", "a҉b", "İi ı", "ﬁ ½", "가 a"] + [chr(i) + "x" for i in range(0xC0, 0x2000, 3)]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    assert {r["t"]: r["n"] for r in df.select("t", T.normalized_title(F.col("t")).alias("n")).collect()} == {t: plain(t) for t in titles}


# --- sources


def test_batches_in_both_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"u": {"url": "https://a.com", "current_status": "accepted", "pa": {"value": 41.5, "history": []}, "da": 3, "rank": {"value": 2}}, "v": {"url": "ftp://x"}}))
    (tmp_path / "b.json").write_text(json.dumps([{"url": "http://b.com", "title": "t", "rank": 7}, {"title": "no url"}]))
    (tmp_path / "c.json").write_text("{broken")
    rows = {r["url"]: r.asDict() for r in records.read_batch(spark, f"file://{tmp_path}/*.json").collect()}
    assert set(rows) == {"https://a.com", "http://b.com"}
    assert (rows["https://a.com"]["status"], rows["https://a.com"]["pa"], rows["https://a.com"]["da"], rows["https://a.com"]["rank"]) == ("accepted", 41.5, 3.0, 2)
    assert (rows["http://b.com"]["status"], rows["http://b.com"]["title"], rows["http://b.com"]["rank"], rows["http://b.com"]["pa"]) == ("new", "t", 7, None)
    records.write_batch(spark.createDataFrame([(1, None), (2, "x")], "a int, b string").coalesce(1), f"file://{tmp_path}/out")
    assert sorted(line for p in (tmp_path / "out").glob("*.json") for line in p.read_text().splitlines()) == ['{"a":1}', '{"a":2,"b":"x"}']


def test_records_of_an_owner(spark, tmp_path):
    at = f"file://{tmp_path}/records"
    spark.createDataFrame([(1, 5, '{"name": "a"}', "2024-01-01"), (2, 5, "{bad", "2024-01-02"), (3, 5, '{"name": "c"}', "2024-01-03"), (4, 6, "{}", "2024-01-04"), (5, 5, None, "2024-01-05")], "id int, user_id int, data string, updated_at string").write.parquet(at)
    assert [r["id"] for r in records.read_records(spark, at, 5).collect()] == [3, 1]
    assert records.read_records(spark, at).count() == 3
    view = records.routed(spark.createDataFrame([(7, 5)], "id int, user_id int"), spark.createDataFrame([(7, 0), (8, 0)], "id int, user_id int"))
    assert records.find_owner(view, F.col("id") == 7).first()["user_id"] == 0


def test_uploads_keys_and_dumps(spark, tmp_path):
    df = spark.createDataFrame([(bytearray("é".encode()),), (bytearray(b"\xe9"),), (bytearray(b""),), (None,)], "b binary")
    assert [r["t"] for r in df.select(records.decoded(F.col("b")).alias("t")).collect()] == ["é", "é", None, None]
    keys = spark.createDataFrame([("a/b.jpg",), ("../x",), ("/x",), ("",), ("a..b",)], "k string")
    assert [r["s"] for r in keys.select(records.is_safe_key(F.col("k")).alias("s")).collect()] == [True, False, False, False, True]
    assert records.dump({"a": keys, "derived": keys}, f"file://{tmp_path}/dump", ("derived",)) == {"a": 5}
    assert not (tmp_path / "dump/derived").exists()
    records.append_manifest(keys, f"file://{tmp_path}/manifest")
    records.append_manifest(keys, f"file://{tmp_path}/manifest")
    assert spark.read.json(f"file://{tmp_path}/manifest").count() == 10


def test_config_has_defaults(tmp_path):
    at = tmp_path / "config.json"
    assert records.Config.load(str(at)).is_recipe_threshold == 7
    at.write_text('{"_note": 1, "is_recipe_threshold": 9, "other": 2}')
    assert records.Config.load(str(at)).is_recipe_threshold == 9
    at.write_text("{")
    with pytest.raises(ValueError):
        records.Config.load(str(at))


def test_providers_that_answer_nothing(spark):
    rows = spark.createDataFrame([("u", "mine"), ("v", "mine")], "url string, title string")
    assert {r["drop_reason"] for r in records.Providers().scored(rows).collect()} == {"authority-unavailable"}
    scored = records.Providers(authority=lambda urls: urls.where("url = 'u'").select("url", F.lit(5.0).alias("pa"), F.lit(6.0).alias("da"), F.lit("theirs").alias("provider_title"))).scored(rows)
    assert {(r["url"], r["title"], r["drop_reason"]) for r in scored.collect()} == {("u", "theirs", None), ("v", "mine", "authority-unavailable")}


# --- streams


def test_journal_goes_on_after_a_restart(spark, tmp_path):
    source, out, check = tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/check"
    source.mkdir()
    schema = "model string, created_at timestamp, prompt_tokens long, output_tokens long"

    def write(name, *rows):
        (source / name).write_text("\n".join(json.dumps(r) for r in rows))

    def run():
        journal.append_journal(journal.journal_stream(spark, f"file://{source}", schema), out, check).awaitTermination(120)

    write("1.json", {"model": "m", "created_at": "2024-01-01T00:00:00", "prompt_tokens": 5}, {"model": "m", "created_at": "2024-01-01T00:10:00", "prompt_tokens": 1, "output_tokens": 2})
    run()
    run()
    write("2.json", {"model": "n", "created_at": "2024-01-01T02:00:00"})
    run()
    rows = spark.read.parquet(out)
    assert sorted((r["model"], r["input_tokens"], r["output_tokens"]) for r in rows.collect()) == [("m", 1, 2), ("m", 5, 0), ("n", 0, 0)]


def test_late_entries_are_left_out(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    schema = "model string, created_at timestamp, input_tokens long, output_tokens long"
    line = lambda t, n: json.dumps({"model": "m", "created_at": t, "input_tokens": n, "output_tokens": 0})

    def run():
        usage = journal.windowed_usage(journal.journal_stream(spark, f"file://{source}", schema), "1 hour", "1 hour").select(F.hour("window.start").alias("hour"), "input_tokens")
        usage.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start().awaitTermination(120)
        return {(r["hour"], r["input_tokens"]) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}

    (source / "1.json").write_text("\n".join([line("2024-01-01T00:10:00", 1), line("2024-01-01T05:00:00", 2)]))
    run()
    (source / "2.json").write_text("\n".join([line("2024-01-01T00:20:00", 50), line("2024-01-01T09:00:00", 4)]))
    assert run() == {(0, 1), (5, 2)}  # the late 50 counts nowhere, and the last window is still open


def test_snapshot_keeps_the_newest_row_of_each_key(spark, tmp_path):
    source, out, check = tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/check"
    source.mkdir()

    def run(name, *rows):
        (source / name).write_text("\n".join(json.dumps(dict(zip(("k", "at", "v"), r, strict=True))) for r in rows))
        changes = spark.readStream.schema("k string, at long, v string").json(f"file://{source}")
        journal.latest_by_key(changes, out, check, ["k"], "at").awaitTermination(120)
        return {(r["k"], r["v"]) for r in journal.snapshot(spark, out, "k string, at long, v string").collect()}

    assert run("1.json", ("a", 1, "x"), ("b", 5, "y"), ("a", 0, "w")) == {("a", "x"), ("b", "y")}
    assert run("2.json", ("a", 3, "z"), ("b", 2, "old"), ("c", 1, "n")) == {("a", "z"), ("b", "y"), ("c", "n")}
    assert run("3.json", ("d", 1, "q")) == {("a", "z"), ("b", "y"), ("c", "n"), ("d", "q")}
