"""Records, vectors and positions beyond what their queries see."""

import html
import json
import random

import numpy as np
from pyspark.sql import functions as F

from gristmill.functions import documents as D
from gristmill.functions import text as T
from gristmill.functions import urls as U
from gristmill.functions import vectors as V
from gristmill.functions.sanitize import sanitized
from gristmill.operators import listings


def _nested(r, depth=0):
    kind = r.choice(["text", "text", "number", "null", "true", "list", "dict"] if depth < 5 else ["text"])
    if kind == "text":
        return r.choice(["a &amp; b", "&lt;i&gt;", "plain", "&", "&#39;", "\"q\\&quot;", "é&eacute;", "", "tab\t&nbsp;", " &copy"])
    if kind == "list":
        return [_nested(r, depth + 1) for _ in range(r.randint(0, 4))]
    if kind == "dict":
        return {r.choice(["k&amp;", "&lt;", "x", "y\"z"]) + str(i): _nested(r, depth + 1) for i in range(r.randint(0, 4))}
    return {"number": 1.5, "null": None, "true": True}[kind]


def _twin(x):
    """The decoded value and how many texts changed."""
    if isinstance(x, str):
        return html.unescape(x), int(html.unescape(x) != x)
    if isinstance(x, list):
        held = [_twin(i) for i in x]
        return [v for v, _ in held], sum(n for _, n in held)
    if isinstance(x, dict):
        held = {k: _twin(v) for k, v in x.items()}
        return {k: v for k, (v, _) in held.items()}, sum(n for _, n in held.values())
    return x, 0


def test_decoding_at_any_depth(spark):
    docs = [_nested(random.Random(i)) for i in range(300)]
    rows = [(i, json.dumps(d, ensure_ascii=bool(i % 2))) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "id int, j string").select("id", D.decoded(F.parse_json("j")).alias("x"), D.decoded_json("j").alias("y"))
    for r in df.select("id", F.to_json("x.value").alias("v"), F.col("x.changed").alias("n"), F.col("y.text").alias("t"), F.col("y.changed").alias("m")).collect():
        value, n = _twin(docs[r["id"]])
        assert json.loads(r["v"]) == json.loads(r["t"]) == value and r["n"] == r["m"] == n
    odd = [None, "", "not json &amp; so", '"&amp;"', '{"a": "&amp;', "1", '["' + "\\n" * 20_000 + '&amp;"]', "[" * 5000 + '"&amp;"' + "]" * 5000]
    got = [(r["y"]["text"], r["y"]["changed"]) for r in spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "id int, j string").orderBy("id").select(D.decoded_json("j").alias("y")).collect()]
    assert got[:6] == [(None, 0), ("", 0), ("not json &amp; so", 0), ('"&"', 1), ('{"a": "&amp;', 0), ("1", 0)] and [n for _, n in got[6:]] == [1, 1]


def test_a_record_of_nothing_is_all_defaults(spark):
    odd = ["null", "3", '"text"', "[]", "{}"]
    rows = spark.createDataFrame([(x,) for x in odd], "j string").select(F.to_json(sanitized(F.parse_json("j"))).alias("r")).distinct().collect()
    assert len(rows) == 1 and json.loads(rows[0]["r"])["author"] == {"@type": "Person", "name": ""}
    none = spark.createDataFrame([(None,)], "j string").select(sanitized(F.try_parse_json("j"))["name"].alias("n")).first()["n"]
    assert none == ""


def test_vectors_as_bytes(spark):
    rng = np.random.default_rng(0)
    held = [rng.normal(size=int(n)).astype(np.float32).tolist() for n in rng.integers(0, 9, 200)] + [None, [], [1.0, None], [float("nan"), float("inf"), -0.0, 1e-42]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(held)], "id int, v array<float>").repartition(3).withColumn("b", V.to_bytes(F.col("v")))
    rows = {r["id"]: r for r in df.withColumn("back", V.from_bytes(F.col("b"))).withColumn("state", V.byte_state(F.col("b"), 4)).collect()}
    for i, v in enumerate(held):
        r = rows[i]
        if v is None or None in v:
            assert r["b"] is None and r["back"] is None and r["state"] == "empty"
            continue
        want = np.array(v, "<f4").tobytes()
        assert bytes(r["b"]) == want
        assert (r["back"] is None) == (not v) and (not v or np.array(r["back"], "<f4").tobytes() == want)
        assert r["state"] == ("empty" if not v else "ok" if len(v) == 4 else "dimension")
    torn = spark.createDataFrame([(b"abc",), (b"abcde",), (b"\x00\x00\x80?",), (None,)], "b binary")
    assert [r["x"] for r in torn.select(V.from_bytes(F.col("b")).alias("x")).collect()] == [None, None, [1.0], None]
    assert [r["x"] for r in torn.filter("b is not null").offset(1).select(V.from_bytes(F.col("b"), 1).alias("x")).collect()] == [None, [1.0]]


def test_positions_in_groups_of_all_sizes(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([None, 1, 2, 3])) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, g string, v int")
    for group in ([], ["g"], ["g", "v"]):
        want, n = {}, {}
        for i, g, v in sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[2] is not None, r[2] or 0, r[0]) if len(group) == 2 else ((r[1] is not None, r[1] or "") if group else (), r[2] is None, -(r[2] or 0), r[0])):
            key = {"g": g, "v": v}
            k = tuple(key[c] for c in group)
            n[k] = want[i] = n.get(k, 0) + 1
        order = [F.col("id")] if len(group) == 2 else [F.col("v").desc_nulls_last(), F.col("id")]
        got = listings.placed(df, group, *order)
        assert got.columns == ["id", "g", "v", "position"] or set(got.columns) == {"id", "g", "v", "position"}
        assert {r["id"]: r["position"] for r in got.collect()} == want
        assert "Window" not in got._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    assert listings.placed(df.limit(0), [], F.col("id")).count() == 0


def test_file_titles(spark):
    names = {"context-bananabread.json": "Bananabread", "x/context-BananaBread.json": "Banana Bread", "a_b-c d.tar": "A B C D", "123.json": "123", "McDonald": "Mc Donald", "": ""}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r["n"]: r["t"] for r in df.select("n", U.title_from_file(F.col("n")).alias("t")).collect()} == names


def test_texts_of_cards(spark):
    card = lambda **k: F.struct(*[F.lit(k.get(c)).cast("string").alias(c) for c in ("likelyDish", "cuisine", "ethnicity")], F.lit(k.get("primary", [])).cast("array<string>").alias("primaryIngredients"), F.lit(k.get("technique")).cast("string").alias("technique"))
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(T.identity_text(card(likelyDish=" Pie ", cuisine="Thai", ethnicity="thai", primary=["", "a"], technique=" x "), F.lit(" PIE "))) == "Pie. cuisine: Thai. primary: a. technique: x"
    assert one(T.identity_text(card(), F.lit(None).cast("string"))) == ""
    assert one(T.identity_text(card(primary=[""]), F.lit("T"))) == "T. primary: "
    parts = F.lit([" a ", "", "b", "c", "d", "e", "f", "g", "h", "i"])
    assert one(T.recipe_text(card(likelyDish=" "), F.lit("N"), F.lit(None).cast("string"), F.lit(" "), F.lit("eth"), F.lit("Ch"), parts)) == "N. cuisine: eth. chapter: Ch. ingredients: a, b, c, d, e, f, g"
    assert one(T.recipe_text(F.lit(None).cast("struct<likelyDish string, cuisine string, ethnicity string, primaryIngredients array<string>, technique string>"), *[F.lit(None).cast("string")] * 5, F.lit(None).cast("array<string>"))) == ""


def test_records_of_one_row_group_are_typed_by_all_tasks(spark, data):
    from gristmill.plans import catalogue

    df = catalogue.queries()["sanitized_records"](spark, data)
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and spark.read.parquet(f"{data}/part.parquet").rdd.getNumPartitions() == 1
