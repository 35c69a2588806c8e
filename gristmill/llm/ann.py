"""Approximate nearest neighbours by cross-polytope hashing.

A table's hash turns a unit vector by a pseudo-rotation (three rounds of random signs and a fast Hadamard transform) and takes the
signed axis it lies nearest to. Every vector is indexed in each table; a query probes, in each, the axes it leans to most.
The candidates are ranked by their exact inner products. Vectors of unequal length are cut into bands of near equal length, where the
order of inner products is nearly that of angles; each band has buckets of its own, a query probes all bands, and bands of few
rows are searched as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.session import staged

#: A band's longest vector is at most so many times its shortest, and a band of fewer rows is not hashed but searched as a whole.
BAND, BAND_ROWS = 1.25, 2048


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def signs(tables: int, dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 3, 1 << (dim - 1).bit_length()))


def leaning(x: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """How far each row leans to each signed axis of one table: coordinates, then the same with the other sign."""
    x = np.pad(x, ((0, 0), (0, turns.shape[1] - x.shape[1])))
    for s in turns:
        x = _hadamard(x * s)
    return np.concatenate([x, -x], 1)


def leaders(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, rows: int = 256, cols: int = 16_384) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """ids and scores of the k best of x for each row of q, highest score first and then smallest id; a row's own id is left out.

    A matrix product finds what may be among the best; its rounding differs from place to place, so these few are summed again coordinate
    by coordinate, and equal vectors get equal scores wherever they stand.
    """
    slack = 1e-9 * float(np.abs(q).sum(1).max(initial=0)) * float(np.abs(x).max(initial=0))
    for a in range(0, len(q), rows):
        own, own_ids = q[a : a + rows], q_ids[a : a + rows]
        row, ids, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for b in range(0, len(x), cols):
            near = own @ x[b : b + cols].T
            near[own_ids[:, None] == x_ids[b : b + cols]] = -np.inf
            edge = np.partition(near, near.shape[1] - k, 1)[:, near.shape[1] - k, None] - slack if near.shape[1] > k else -np.inf
            r, c = np.nonzero((near >= edge) & (near > -np.inf))
            exact = np.zeros(len(r))
            for j in range(q.shape[1]):
                exact += own[r, j] * x[b + c, j]
            row, ids, score = np.r_[row, r], np.r_[ids, x_ids[b + c]], np.r_[score, exact]
            top = np.lexsort((ids, -score, row))
            row, ids, score = row[top], ids[top], score[top]
            stay = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, ids, score = row[stay], ids[stay], score[stay]
        ends = np.searchsorted(row, np.arange(len(own) + 1))
        for lo, hi in zip(ends[:-1], ends[1:], strict=True):
            yield ids[lo:hi], score[lo:hi]


def _proper(e: Column) -> Column:
    """Not null or empty, without null or non-finite components, and not zero."""
    big = F.lit(float("inf"))
    bad = F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == big))
    return e.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.coalesce(F.exists(e, lambda v: v != 0), F.lit(False))


def nearest(df: DataFrame, is_query: Column, k: int = 20, tables: int = 8, probes: int = 16, block: int = 20_000, seed: int = 0, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k rows of largest inner product that its probes find.

    A query whose probes find fewer than k is asked again against all rows, which is an exact search; so it gets k, or all there are.
    Rows with a null key, and vectors that are null, empty, zero or not finite take no part; all others must have one length (an error
    otherwise). Equal scores go by the smaller key. Rows that repeat a key and vector are one row, and a row is never its own neighbour. An empty table, or
    one vector, gives none. A vector travels once for each table, in the type it has, and a query once for each cell that it probes: a cell holds buckets of a table, of about
    `block` vectors together, or a part of one larger bucket, so a bucket may hold any part of the rows. Where lengths differ, buckets are of scaled vectors by bands; scores never are. Other columns of df are not read.
    """
    spark = df.sparkSession
    single = df.schema[embedding].dataType.elementType.typeName() == "float"
    number = "float" if single else "double"
    vector = f"array<{number}>"
    # lengths as logarithms of scaled vectors: squares of very large or small numbers are not held. The scale is a column of its own, worked out once
    large = F.array_max(F.transform("v", lambda v: F.abs(v.cast("double"))))
    scaled = lambda v: v.cast("double") / F.col("large")
    length = F.log("large") + F.log(F.aggregate("v", F.lit(0.0), lambda a, v: a + scaled(v) * scaled(v))) / 2
    rows = df.where(_proper(F.col(embedding)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).cast(vector).alias("v"), is_query.alias("is_query")).dropDuplicates(["vec_id", "v"])
    rows = staged(rows.withColumn("large", large).withColumn("length", length).drop("large"), "vectors")
    seen = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("most"), F.min(F.size("v")).alias("least"), F.max("length").alias("long"), F.min("length").alias("short")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if seen["most"] is None:
        return spark.createDataFrame([], schema)
    if seen["most"] != seen["least"]:
        raise ValueError(f"vectors of {seen['least']} and {seen['most']} components")
    turns = signs(tables, seen["most"], seed)
    axes = 2 * turns.shape[2]
    if seen["long"] - seen["short"] <= np.log(1.001):
        band, deep = F.lit(0), np.zeros(1, np.int64)
    else:
        # doubles span less than 7000 bands, so the driver gets a row for each
        band = F.floor((F.lit(seen["long"]) - F.col("length")) / float(np.log(BAND))).cast("int")
        deep = np.array(sorted(r["band"] for r in rows.groupBy(band.alias("band")).count().collect() if r["count"] >= BAND_ROWS), np.int64)
    rows = rows.withColumn("band", band)

    def hashed(deep: np.ndarray, taken: int | None):  # noqa: ANN202
        """Buckets of rows, with their vectors: in each table of their band the nearest axis. With `taken`, without them: the axes that a query probes, in all bands. Bucket 0 holds the bands that aren't in `deep`."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            def out(at: np.ndarray, bucket: np.ndarray) -> pd.DataFrame:
                return pd.DataFrame({"bucket": bucket.astype(np.int64), "id": ids[at], **({} if taken else {"v": list(vectors[at])})})

            for b in batches:
                if not len(b):
                    continue
                ids, vectors, bands = b["vec_id"].to_numpy(), b["v"].to_numpy(), b["band"].to_numpy()
                whole = np.flatnonzero(~np.isin(bands, deep)) if taken is None else np.arange(len(b))
                if len(whole):
                    yield out(whole, np.zeros(len(whole)))
                if not len(deep):
                    continue
                u = np.stack(vectors).astype(np.float64)
                u = u / np.abs(u).max(1, keepdims=True)
                u = u / np.linalg.norm(u, axis=1, keepdims=True)
                for t in range(tables):
                    lean = leaning(u, turns[t])
                    for j, own in enumerate(deep):
                        mine = np.flatnonzero(bands == own) if taken is None else np.arange(len(b))
                        if len(mine):
                            at = np.argpartition(-lean[mine], taken - 1, 1)[:, :taken] if taken else lean[mine].argmax(1)[:, None]
                            yield out(np.repeat(mine, at.shape[1]), 1 + (j * tables + t) * axes + at.ravel())

        return run

    def best(ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Places of the k best; a key that stands several times counts with its best score."""
        order = np.lexsort((ids, -scores))
        _, first = np.unique(ids[order], return_index=True)
        return order[np.sort(first)[:k]]

    def ranked(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        """The k best of a cell for each of its queries."""
        if not len(x) or not len(q):
            return pd.DataFrame({"query_id": [], "ids": [], "scores": []}, dtype=object)
        x = x.sort_values("bucket", kind="stable")
        bucket, ids, own = x["bucket"].to_numpy(), x["id"].to_numpy(), np.stack(x["v"].to_numpy()).astype(np.float64)
        asked, q_ids = np.stack(q["v"].to_numpy()).astype(np.float64), q["id"].to_numpy()
        which = np.repeat(np.arange(len(q)), [len(z) for z in q["buckets"]])
        probed = np.concatenate(q["buckets"].to_list())
        found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(len(q))]
        there, first = np.unique(bucket, return_index=True)
        for z, lo, hi in zip(there, first, [*first[1:], len(bucket)], strict=True):
            mine = which[probed == z]
            for i, pair in zip(mine, leaders(asked[mine], q_ids[mine], own[lo:hi], ids[lo:hi], k), strict=True):
                found[i].append(pair)
        held = [i for i in range(len(q)) if found[i]]
        out = [(np.concatenate([a for a, _ in found[i]]), np.concatenate([s for _, s in found[i]])) for i in held]
        out = [(a[top], s[top]) for a, s in out for top in [best(a, s)]]
        return pd.DataFrame({"query_id": q_ids[held], "ids": pd.Series([a for a, _ in out], dtype=object), "scores": pd.Series([s for _, s in out], dtype=object)})

    def merged(own: pd.DataFrame) -> pd.DataFrame:
        """The k best of all cells: at most k come from each."""
        ids, scores = np.concatenate(own["ids"].to_list()), np.concatenate(own["scores"].to_list())
        top = best(ids, scores)
        return pd.DataFrame({"query_id": own["query_id"].iloc[0], "rank": np.arange(1, len(top) + 1, dtype=np.int32), "vec_id": ids[top], "score": scores[top]})

    def search(queries: DataFrame, deep: np.ndarray) -> DataFrame:
        indexed = rows.mapInPandas(hashed(deep, None), f"bucket long, id long, v {vector}")
        probed = staged(queries.mapInPandas(hashed(deep, min(probes, axes)), "bucket long, id long").distinct(), "probes")
        # a row for each bucket, of which there are bands x tables x axes: the cell that it begins in, and the parts of one that is larger than a cell
        table = F.floor((F.col("bucket") - 1) / axes)
        counts = indexed.groupBy("bucket").agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.partitionBy("table").orderBy("bucket")) - F.col("n")
        cells = counts.withColumn("table", table).select("bucket", "table", F.floor(before / block).alias("cell"), F.ceil(F.col("n") / block).cast("int").alias("xs"))
        cells = F.broadcast(staged(cells, "cells"))
        asked = probed.join(cells, "bucket").select("table", "cell", F.explode(F.sequence(F.lit(0), F.col("xs") - 1)).alias("x_block"), "bucket", "id")
        asked = staged(asked.groupBy("table", "cell", "x_block", "id").agg(F.collect_list("bucket").alias("buckets")), "asked")
        at = ["table", "cell", "x_block"]
        blocks = F.broadcast(staged(asked.groupBy(*at).agg(F.ceil(F.count("*") / block).cast("int").alias("qs")), "blocks"))
        asked = asked.join(blocks, at).join(queries.select(F.col("vec_id").alias("id"), "v"), "id").select(*at, F.pmod(F.xxhash64("id"), "qs").cast("int").alias("q_block"), "id", "buckets", "v")
        index = indexed.join(cells, "bucket").withColumn("x_block", F.pmod(F.xxhash64("id"), "xs").cast("int")).join(blocks, at).select(*at, F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("q_block"), "bucket", "id", "v")
        found = index.groupBy(*at, "q_block").cogroup(asked.groupBy(*at, "q_block")).applyInPandas(ranked, "query_id long, ids array<long>, scores array<double>")
        return staged(found.groupBy("query_id").applyInPandas(merged, schema), "nearest")

    asked = rows.where("is_query")
    found = search(asked, deep)
    full = found.groupBy(F.col("query_id").alias("vec_id")).count().where(F.col("count") >= min(k, seen["n"] - 1))
    short = staged(asked.join(full, "vec_id", "left_anti"), "short")
    if seen["n"] < 2 or short.isEmpty():
        return found
    return found.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(search(short, deep[:0]))


def brute_force(df: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The exact answer for tests and for measuring recall on small tables, by SQL alone."""
    rows = df.where(_proper(F.col(embedding)) & F.col(key).isNotNull())
    dot = F.aggregate(F.zip_with("q", "x", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, v: a + v)
    pairs = rows.where(is_query).select(F.col(key).alias("query_id"), F.col(embedding).alias("q")).join(rows.select(F.col(key).alias("vec_id"), F.col(embedding).alias("x")), F.col("query_id") != F.col("vec_id"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.select("query_id", "vec_id", dot.alias("score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
