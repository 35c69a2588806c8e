"""Searches from every row whose id is divisible by 100 against all rows, in one block and in several, and from more queries than one block."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.operators import vectors

OWN, SAME = "vec_id <> query_id", "label = query_label"


def _pairs(data, where):
    e = f"(SELECT vec_id, label, embedding::DOUBLE[] AS e FROM '{data}/embeddings.parquet')"
    return f"SELECT q.vec_id AS query_id, v.vec_id, q.label = v.label AS same, list_distance(q.e, v.e) AS d FROM (SELECT * FROM {e} WHERE vec_id % 100 = 0) q JOIN {e} v ON {where}"


def _searched(spark, data):
    v = spark.read.parquet(f"{data}/embeddings.parquet")
    return v, v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.col("label").alias("query_label"))


def _plain(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("block", [1, 1000])
@pytest.mark.parametrize(("where", "sql"), [(None, "true"), (SAME, "q.label = v.label"), (f"{OWN} AND label <> 3", "q.vec_id <> v.vec_id AND v.label <> 3")])
def test_every_hundredth_row_finds_its_nearest(spark, data, monkeypatch, block, where, sql):
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", block)
    found = vectors.knn(*_searched(spark, data), 10, where and F.expr(where))
    want = duckdb.sql(f"SELECT query_id, rank, vec_id, d FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM ({_pairs(data, sql)})) WHERE rank <= 10").fetchall()
    assert _plain(found.collect()) == _plain(want)
    assert len({r[0] for r in want}) == 5


@pytest.mark.parametrize("block", [1, 1000])
def test_every_hundredth_row_finds_its_match(spark, data, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", block)
    found = vectors.best_match(*_searched(spark, data), F.expr(SAME), 0.3, among=F.expr(OWN))
    want = duckdb.sql(f"""WITH b AS (SELECT query_id, arg_min(vec_id, d) FILTER (same) AS nm, 1 - pow(min(d) FILTER (same), 2) / 2 AS ns, arg_min(vec_id, d) AS wm, 1 - pow(min(d), 2) / 2 AS ws FROM ({_pairs(data, "q.vec_id <> v.vec_id")}) GROUP BY query_id)
    SELECT query_id, CASE WHEN ns >= 0.3 THEN nm WHEN ws >= 0.3 THEN wm END, CASE WHEN ns >= 0.3 THEN ns WHEN ws >= 0.3 THEN ws END, CASE WHEN ns >= 0.3 THEN 'narrow' WHEN ws >= 0.3 THEN 'wide' END FROM b""").fetchall()
    assert _plain(found.collect()) == _plain(want)


def test_more_than_ten_thousand_queries(spark):
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(30, 4)), rng.normal(size=(10_500, 4))
    v = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    found = vectors.knn(v, spark.createDataFrame(list(enumerate(q.tolist())), "query_id long, query array<double>"), 2)
    best = np.argsort(((q[:, None] - x) ** 2).sum(2), axis=1)[:, :2]
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in found.collect()) == [(i, k + 1, int(best[i, k])) for i in range(len(q)) for k in range(2)]


@pytest.mark.parametrize("rows", [7, 32_768])
@pytest.mark.parametrize(("arg", "sql"), [({}, "true"), ({"same": ("label", "query_label")}, "q.label = v.label"), ({"apart": True}, "q.vec_id <> v.vec_id")])
def test_cells_of_any_size_find_the_nearest(spark, data, monkeypatch, rows, arg, sql):
    monkeypatch.setattr(vectors, "CELL_ROWS", rows)
    found = vectors.knn(*_searched(spark, data), 10, **arg)
    want = duckdb.sql(f"SELECT query_id, rank, vec_id, d FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM ({_pairs(data, sql)})) WHERE rank <= 10").fetchall()
    assert _plain(found.collect()) == _plain(want)


@pytest.mark.parametrize("search", ["knn", "best_match"])
def test_no_pair_is_shuffled_or_sorted(spark, search):
    """What leaves the cells is k rows for each query and cell, however many vectors there are."""
    v = spark.range(4000).selectExpr("id as vec_id", "id % 3 as label", "array(id % 50.0, id % 7.0) as embedding")
    q = v.where("vec_id < 20").selectExpr("vec_id as query_id", "embedding as query", "label as query_label")
    found = vectors.knn(v, q, 10, apart=True) if search == "knn" else vectors.best_match(v, q, ("label", "query_label"), -9.0, apart=True)
    held = vectors._gridded(v, q, 10, ("wide",), None, True, "vec_id", "embedding")
    assert held.count() == 20 * 10 * vectors.LEAST_CELLS
    d = {(a["query_id"], b["vec_id"]): ((np.array(a["query"], float) - np.array(b["embedding"], float)) ** 2).sum() ** 0.5 for a in q.collect() for b in v.collect() if a["query_id"] != b["vec_id"]}
    for i, rows in {i: [r for r in found.collect() if r["query_id"] == i] for i in range(20)}.items():
        best = sorted((x, b) for (a, b), x in d.items() if a == i)
        if search == "knn":  # copies by key
            assert [r["vec_id"] for r in sorted(rows, key=lambda r: r["rank"])] == [b for _, b in best[:10]]
        else:
            near = min(x for x in best if x[1] % 3 == i % 3)
            assert [(r["match"], r["scope"]) for r in rows] == [(near[1], "narrow")]
