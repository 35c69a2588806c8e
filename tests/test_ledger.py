"""Keyed buckets behind a stream, staged changes and typed input, beyond what their queries see."""

import datetime as dt
import glob
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gristmill.operators import changes, forms, state
from gristmill.streaming.keyed import KeyedStore

SCHEMA = "k string, at int, v string"


def _files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/data/**/part-*", recursive=True)}


def _state(store):
    return {r["k"]: (r["at"], r["v"], r["first_at"], r["changes"]) for r in store.read().collect()}


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i}", 1, f"v{i}") for i in range(200)], SCHEMA)
    store = KeyedStore(spark, str(tmp_path), rows.schema, ["k"], "at", buckets=16)
    store.merge(rows, 0)
    before = _files(tmp_path)
    assert len({os.path.dirname(f) for f in before}) == 16
    store.merge(spark.createDataFrame([("k3", 5, "new"), ("k3", 4, "older"), ("zz", 2, None)], SCHEMA), 1)
    after = _files(tmp_path)
    assert {f: t for f, t in after.items() if f in before} == before  # version 0 still stands, as two are kept
    fresh = {os.path.dirname(f) for f in after if f not in before}
    assert 1 <= len(fresh) <= 2 and all("/v1/" in f for f in fresh)
    got = _state(store)
    assert len(got) == 201 and got["k3"] == (5, "new", 1, 3) and got["zz"] == (2, None, 2, 1) and got["k4"] == (1, "v4", 1, 1)
    store.merge(spark.createDataFrame([("k3", 2, "late")], SCHEMA), 2)
    assert _state(store)["k3"] == (5, "new", 1, 4)  # a late row is counted and changes nothing else
    gone = set(before) - set(_files(tmp_path))
    assert gone and {os.path.basename(os.path.dirname(f)) for f in gone} <= {os.path.basename(d) for d in fresh}  # only what no kept version names
    store.merge(spark.createDataFrame([], SCHEMA), 3)
    assert len(_state(store)) == 201


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    a, b = spark.createDataFrame([("x", 1, "a"), ("y", 1, "b")], SCHEMA), spark.createDataFrame([("x", 2, "c"), (None, 7, "null key")], SCHEMA)
    store = KeyedStore(spark, str(tmp_path), a.schema, ["k"], "at", buckets=4)
    store.merge(a, 0)
    store.merge(b, 1)
    once = _state(store)
    store.merge(b, 1)
    assert _state(store) == once == {"x": (2, "c", 1, 2), "y": (1, "b", 1, 1), None: (7, "null key", 7, 1)}
    # a batch that failed before its version was written is as if it had never been
    os.makedirs(tmp_path / "data/v2/_b=0")
    os.makedirs(tmp_path / "versions/v2")
    assert _state(store) == once
    assert _state(KeyedStore(spark, str(tmp_path / "none"), a.schema, ["k"], "at")) == {}


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "store"), spark.createDataFrame([], SCHEMA).schema, ["k"], "at", buckets=8)
    feed = str(tmp_path / "feed")
    for n in range(3):
        spark.createDataFrame([(f"k{i % 7}", n * 10 - i, f"{n}") for i in range(20)], SCHEMA).coalesce(1).write.mode("append").parquet(feed)
        store.follow(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(feed), str(tmp_path / "checkpoint")).awaitTermination()
    got = _state(store)
    assert {k: v[0] for k, v in got.items()} == {f"k{i}": 20 - i for i in range(7)} and sum(v[3] for v in got.values()) == 60


# --- staged changes


@pytest.fixture
def staged_table(spark, tmp_path):
    t = changes.StagedTable(spark, str(tmp_path), ["id"])
    t.create(spark.createDataFrame([(i, f"n{i}", i * 1.0) for i in range(10)], "id int, name string, price double"))
    return t


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_what_is_planned_is_what_is_applied(spark, staged_table):
    old = staged_table.read()
    new = spark.createDataFrame([(i, None if i == 4 else f"n{i}", i * (2.0 if i == 5 else 1.0)) for i in range(2, 13)], old.schema)
    plan = changes.planned(old, new, ["id"])
    assert {(r["action"], r["n"]) for r in changes.summary(plan).collect()} == {("delete", 2), ("insert", 3), ("update", 2)}
    assert _rows(changes.applied(old, plan, ["id"])) == _rows(new)
    before = _rows(old)
    assert staged_table.version() == 0 and staged_table.apply(plan, {"price": F.col("price") >= 0}) == 1
    assert _rows(staged_table.read()) == _rows(new) and _rows(staged_table.read(0)) == before
    assert changes.planned(staged_table.read(), new, ["id"]).count() == 0
    assert staged_table.rollback() == 0 and _rows(staged_table.read()) == before
    with pytest.raises(changes.FailedCheck):
        staged_table.rollback()
    # after a rollback the same change fits again
    assert staged_table.apply(plan) == 3 and _rows(staged_table.read()) == _rows(new)


def test_a_failing_check_leaves_the_table(spark, staged_table, tmp_path):
    old = staged_table.read()
    before = _rows(old)
    plan = changes.planned(old, old.withColumn("price", F.col("price") - 5), ["id"])
    for bad, checks in (
        (plan, {"price": F.col("price") >= 0}),
        (plan, {"unknown is no": F.lit(None).cast("boolean")}),
        (plan.withColumn("before", F.struct(F.lit("other").alias("name"), F.lit(1.0).alias("price"))), {}),
        (plan.withColumn("action", F.lit("insert")), {}),
        (plan.withColumn("id", F.col("id") + 100), {}),
        (plan.unionByName(plan), {}),
    ):
        with pytest.raises(changes.FailedCheck):
            staged_table.apply(bad, checks)
        assert staged_table.version() == 0 and _rows(staged_table.read()) == before
    with pytest.raises(PySparkException):
        staged_table.apply(plan, {"broken": F.raise_error(F.lit("x")).cast("boolean")})
    assert _rows(staged_table.read()) == before and not glob.glob(f"{tmp_path}/changes-*") and not glob.glob(f"{tmp_path}/v1")


def test_one_of_two_writers_wins(spark, staged_table):
    plan = changes.planned(staged_table.read(), staged_table.read().where("id > 2"), ["id"])
    moves = staged_table._moves()
    staged_table.apply(plan)
    with pytest.raises(changes.FailedCheck):
        staged_table._point(9, moves)
    assert staged_table.read().count() == 7


def test_rows_that_move(spark):
    own = spark.createDataFrame([(1, "u1", "b"), (2, "u2", ""), (3, "", "b"), (4, "u4", None), (5, "u5", "b")], "id int, url string, batch string")
    master = spark.createDataFrame([(9, "u5", "m"), (8, "", "m")], "id int, url string, batch string")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    gained, lost, refused = changes.moved_rows(own, master, F.col("batch").isNotNull(), F.col("batch") != "", "url")
    assert (ids(gained), ids(lost), ids(refused)) == ([1, 3], [1, 3, 5], [2])
    gained, lost, refused = changes.moved_rows(own, master, F.col("batch").isNotNull(), F.col("batch") != "", "url", force=True)
    assert (ids(gained), ids(lost), ids(refused)) == ([1, 2, 3], [1, 2, 3, 5], [])


# --- typed input


def test_values_of_each_kind(spark):
    schema = StructType([forms.field("a", "number", required=True), forms.field("b", "bool"), forms.field("c", "select", options=("x", "y")), forms.field("d", "select"), forms.field("e"), forms.field("f", "number", editable=False), forms.field("g", default="std")])
    rows = [("1", "yes", "x", "any", "t", "7"), (" +2_000 ", "0", "y", None, None, None), ("", "ON", "z", "", "", "x"), ("3.0", None, None, "q", " ", "8"), ("9" * 30, "maybe", "X", "q", "r", "9"), ("1__0", "true", "x", "q", "r", "9")]
    got = forms.coerced(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, a string, b string, c string, d string, e string, f string"), schema).orderBy("id").collect()
    assert [r["a"] for r in got] == [1, 2000, None, None, None, None] and [r["b"] for r in got] == [True, False, True, False, False, True]
    assert [[(e["field"], e["reason"]) for e in r["errors"]] for r in got] == [[], [], [("a", "required"), ("c", "not one of x, y")], [("a", "not a whole number"), ("c", "not one of x, y")], [("a", "not a whole number"), ("c", "not one of x, y")], [("a", "not a whole number")]]
    assert [r["f"] for r in got] == [7, 0, None, 8, 9, 9] and [r["d"] for r in got][:2] == ["any", ""] and {r["g"] for r in got} == {"std"}
    one = spark.createDataFrame([("a", "1"), ("f", "2"), ("zz", "3")], "field string, value string")
    assert [r["reason"] for r in forms.unknown_fields(one, schema).collect()] == [None, "f can't be changed", "unknown field zz"]
    assert [(r["name"], r["kind"], r["required"], r["options"]) for r in forms.described(spark, schema).orderBy("ord").collect()][:3] == [("a", "number", True, []), ("b", "bool", False, []), ("c", "select", False, ["x", "y"])]
    assert forms.described(spark, StructType([StructField("plain", StringType())])).first()["kind"] == "text"
    with pytest.raises(ValueError):
        forms.field("x", "colour")


def test_one_look_up_reads_the_requests_once(spark, tmp_path):
    spark.createDataFrame([(i, f"u{i % 5}") for i in range(50)], "id int, url_normalized string").write.parquet(f"{tmp_path}/asked")
    asked = spark.read.parquet(f"{tmp_path}/asked")
    cache = spark.createDataFrame([("u1", "m", "v", "x", None, dt.datetime(2024, 1, 1))], "url_normalized string, model string, version string, value string, fingerprint string, created_at timestamp")
    answers, journal = state.cache_answers(asked, cache, 30, F.to_timestamp(F.lit("2024-01-02")), "m", "v", [])
    for out in (answers, journal):
        assert str(tmp_path) not in out._jdf.queryExecution().toString()  # both read what was written once
    assert answers.count() == 50 and journal.count() == 10 and answers.where("status = 'hit' and prior_fingerprint = ''").count() == 10
