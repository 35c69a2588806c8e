"""Exact nearest neighbours under a filter, for any number of queries against a table of vectors."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.scores import cosine_of_l2, l2
from gristmill.session import place, staged

#: Rows of either side of a cell of the grid, and the least number of cells that the vectors make.
CELL_ROWS, LEAST_CELLS = 32_768, 16
#: Queries of a cell that are held against its vectors at a time.
SLAB = 128

#: Queries of one block, and bytes of their vectors: a block is broadcast, so its size is bounded. Each block is two passes over the vectors.
BLOCK_QUERIES, BLOCK_BYTES = 250_000, 64 << 20
#: Vectors are dealt to so many buckets (bits of a long), each in one task.
BUCKETS = 64


def _shape(queries: DataFrame) -> tuple[int, int | None]:
    """How many blocks the queries make, and their number of components if all have the same (and not very many)."""
    q = queries.agg(F.count("*").alias("n"), F.min(F.size("query")).alias("lo"), F.max(F.size("query")).alias("hi")).first()
    dim = max(q["hi"] or 1, 1)
    return -(-q["n"] // max(1, min(BLOCK_QUERIES, BLOCK_BYTES // (8 * dim)))), dim if q["lo"] == dim <= 512 else None


def _distance(a: Column, b: Column, dim: int | None) -> Column:
    """Of vectors of a known length a plain sum, which is compiled; a lambda is run for each component of each pair otherwise."""
    if dim is None:
        return l2(a, b)
    parts = [F.get(a, F.lit(i)).cast("double") - F.get(b, F.lit(i)).cast("double") for i in range(dim)]
    return F.sqrt(functools.reduce(lambda s, d: s + d * d, parts, F.lit(0.0)))


def _dealt(vectors: DataFrame, key: str) -> DataFrame:
    """vectors by _bucket, a bucket in one task, so that what a query finds in it is put together without a shuffle of pairs."""
    return vectors.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")).repartition(BUCKETS, "_bucket")


def _mask(buckets: Column) -> Column:
    """Buckets as bits."""
    return F.aggregate(buckets, F.lit(0).cast("long"), lambda m, b: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))


def _masked() -> Column:
    return F.call_function("shiftright", F.col("_mask"), F.col("_bucket")).bitwiseAND(F.lit(1).cast("long")) == 1


def _cell(k: int, scopes: tuple[str, ...], apart: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Of each query of a cell the k nearest of its vectors, of all (wide) and of those of its own group (narrow), ties by key.

    Products of matrices say roughly how near all pairs are; who may be among the k by these, with all that rounding can move, is measured component by component.
    """

    def found(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        out, none = [], pd.DataFrame({"query_id": q["query_id"][:0], "key": v["key"][:0], "distance": np.zeros(0), "scope": np.zeros(0, dtype=object)})
        lengths = v["e"].map(len)
        for n, qs in q.groupby(q["e"].map(len)):
            vs = v[lengths == n]
            if not len(vs):
                continue
            a, b = (np.array(list(x["e"]), dtype=np.float64).reshape(len(x), n) for x in (qs, vs))
            groups, _ = pd.factorize(pd.concat([qs["g"], vs["g"]]))
            ga, gb = np.where(groups[: len(qs)] < 0, -2, groups[: len(qs)]), groups[len(qs) :]
            qi, vi = qs["query_id"].to_numpy(), vs["key"].to_numpy()
            place = np.argsort(np.argsort(vi, kind="stable"), kind="stable")
            with np.errstate(all="ignore"):
                b2 = (b * b).sum(1)
                for at in range(0, len(a), SLAB):
                    x = a[at : at + SLAB]
                    x2 = (x * x).sum(1)
                    near = np.nan_to_num(x2[:, None] + b2 - 2 * (x @ b.T), nan=1e300, posinf=1e300, neginf=1e300)
                    slack = np.nan_to_num(1e-11 * (x2 + np.max(b2[b2 < np.inf], initial=0.0)), nan=0.0, posinf=0.0)
                    if apart:
                        near[qi[at : at + SLAB, None] == vi] = np.inf
                    for scope in scopes:
                        d = near if scope == "wide" else np.where(ga[at : at + SLAB, None] == gb, near, np.inf)
                        bound = np.partition(d, k - 1, axis=1)[:, k - 1] if k < d.shape[1] else np.full(len(x), np.inf)
                        i, j = np.nonzero((d <= (bound + slack)[:, None]) & (d < np.inf))
                        exact = np.zeros(len(i))
                        for c in range(n):
                            exact += (x[i, c] - b[j, c]) ** 2
                        exact = np.sqrt(exact)
                        order = np.lexsort((place[j], exact, i))
                        i, j, exact = i[order], j[order], exact[order]
                        kept = np.arange(len(i)) - np.searchsorted(i, i) < k
                        out.append(pd.DataFrame({"query_id": qi[at : at + SLAB][i[kept]], "key": vi[j[kept]], "distance": exact[kept], "scope": scope}))
        return pd.concat(out) if out else none

    return found


def _gridded(vectors: DataFrame, queries: DataFrame, k: int, scopes: tuple[str, ...], same: tuple[str, str] | None, apart: bool, key: str, embedding: str) -> DataFrame:
    """query_id, key, distance, scope: what each query finds in each cell of vectors, k rows a cell and scope at most. Both sides are dealt to cells of a bounded size, and every pair of cells is one group."""
    whole = lambda c: F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull())
    group = [F.col(c) if same else F.lit(None).cast("int") for c in reversed(same or ("", ""))]
    q = queries.where(whole("query")).select("query_id", F.col("query").cast("array<double>").alias("e"), group[0].alias("g"))
    v = vectors.where(whole(embedding)).select(F.col(key).alias("key"), F.col(embedding).cast("array<double>").alias("e"), group[1].alias("g"))
    across, down = -(-q.count() // CELL_ROWS) or 1, max(-(-v.count() // CELL_ROWS), LEAST_CELLS)
    own = lambda x, n: F.pmod(F.xxhash64(x), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.withColumn("_q", own("query_id", across)).withColumn("_v", every(down)).groupBy("_q", "_v")
    v = v.withColumn("_v", own("key", down)).withColumn("_q", every(across)).groupBy("_q", "_v")
    kinds = {f.name: f.dataType.simpleString() for f in [*queries.schema, *vectors.schema]}
    return q.cogroup(v).applyInPandas(_cell(k, scopes, apart), f"query_id {kinds['query_id']}, key {kinds[key]}, distance double, scope string")


def knn(vectors: DataFrame, queries: DataFrame, k: int, where: Column | None = None, key: str = "vec_id", embedding: str = "embedding", same: tuple[str, str] | None = None, apart: bool = False) -> DataFrame:
    """query_id, rank, the vector's key, distance: the k nearest by Euclidean distance among the vectors that pass `where`, ties by key.

    queries: query_id, query (and any columns that `where` uses). Vectors of another length, or null, take no part. Queries of more than a block
    go block by block, dealt by query_id, and the k nearest of each block are written before the next one begins.

    same: columns of vector and query that have to be equal; apart: not the vector of the query's own id. Without another filter, cells of vectors and
    queries are held against each other as matrices, and the k nearest of each cell are ranked.

    With `where`, a first pass keeps the least distance of each query in each bucket, a number each. The k-th of these bounds the k nearest, so a second pass
    looks only into buckets that begin within it, and ranks only what lies within it.
    """
    if where is None:
        cells = _gridded(vectors, queries, k, ("narrow" if same else "wide",), same, apart, key, embedding).withColumnRenamed("key", key)
        return cells.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", key))).where(F.col("rank") <= k).select("query_id", "rank", key, "distance")
    spark = queries.sparkSession
    blocks, dim = _shape(queries)
    cond = (F.size("query") == F.size(embedding)) & where
    for col, other in [(F.col(same[0]), same[1])] if same else []:
        cond &= col == F.col(other)
    cond = cond & (F.col(key) != F.col("query_id")) if apart else cond
    w, dealt, d = Window.partitionBy("query_id").orderBy("distance", key), _dealt(vectors, key), _distance(F.col("query"), F.col(embedding), dim)

    def nearest(own: DataFrame) -> DataFrame:
        least = dealt.join(F.broadcast(own), cond).groupBy("query_id", "_bucket").agg(F.min(d).alias("d"))
        held = least.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("d", "_bucket"))).alias("_x"))
        # fewer than k buckets: all that they hold
        held = held.withColumn("_bound", F.coalesce(F.get("_x", F.lit(k - 1))["d"], F.lit(float("inf"))))
        held = held.select("query_id", "_bound", _mask(F.transform(F.filter("_x", lambda x: x["d"] <= F.col("_bound")), lambda x: x["_bucket"])).alias("_mask"))
        bounded = staged(own.join(held, "query_id"), "bounds")
        pairs = dealt.join(F.broadcast(bounded), cond & F.when(_masked(), d <= F.col("_bound")))
        return pairs.select("query_id", key, d.alias("distance")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", key, "distance")

    if blocks <= 1:
        return nearest(queries)
    held, at = staged(queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))), "queries"), place(spark, "nearest")
    for b in range(blocks):
        found = nearest(held.where(F.col("_block") == b).drop("_block"))
        found.write.mode("append").parquet(at)
    return spark.read.schema(found.schema).parquet(at)


def best_match(vectors: DataFrame, queries: DataFrame, narrow: Column | tuple[str, str], least: float = 0.55, key: str = "vec_id", embedding: str = "embedding", among: Column | None = None, apart: bool = False) -> DataFrame:
    """query_id, match, similarity, scope: the nearest vector within the narrow filter, or else of all, if its cosine reaches `least`; null if neither does.

    narrow: a condition, or columns of vector and query that have to be equal; apart: not the vector of the query's own id. With columns and without `among`, cells of
    vectors and queries are held against each other as matrices, and the best of each cell are compared.

    among: what else either search is held to. With a condition, a first pass over the vectors finds the least distances of both searches
    in each bucket, a second one who stands there, in the buckets that have them; ties go by key.
    """
    if isinstance(narrow, tuple) and among is None:
        x = F.struct(F.col("distance"), F.col("key").alias("match"))
        cells = _gridded(vectors, queries, 1, ("wide", "narrow"), narrow, apart, key, embedding)
        return _told(queries, cells.groupBy("query_id").agg(*[F.min(F.when(F.col("scope") == s, x)).alias(s) for s in ("narrow", "wide")]), least)
    narrow = F.col(narrow[0]) == F.col(narrow[1]) if isinstance(narrow, tuple) else narrow
    spark, cond = queries.sparkSession, F.size("query") == F.size(embedding)
    cond = cond if among is None else cond & among
    cond, dealt = cond & (F.col(key) != F.col("query_id")) if apart else cond, _dealt(vectors, key)
    blocks, dim = _shape(queries)
    d = _distance(F.col("query"), F.col(embedding), dim)

    def nearest(own: DataFrame) -> DataFrame:
        pairs = dealt.join(F.broadcast(own), cond).select("query_id", "_bucket", narrow.alias("_in"), d.alias("d"))
        first = pairs.groupBy("query_id", "_bucket").agg(F.min("d").alias("w"), F.min(F.when(F.col("_in"), F.col("d"))).alias("n"))
        held = first.groupBy("query_id").agg(F.min("w").alias("_wide"), F.min("n").alias("_narrow"), F.collect_list(F.struct("w", "n", "_bucket")).alias("_x"))
        begins = F.filter("_x", lambda x: (x["w"] == F.col("_wide")) | F.coalesce(x["n"] == F.col("_narrow"), F.lit(False)))
        held = held.select("query_id", "_wide", "_narrow", _mask(F.transform(begins, lambda x: x["_bucket"])).alias("_mask"))
        bounded = staged(own.join(held, "query_id"), "bounds")
        inside = F.coalesce(narrow, F.lit(False)) & (d == F.col("_narrow"))
        at_it = dealt.join(F.broadcast(bounded), cond & F.when(_masked(), (d == F.col("_wide")) | F.coalesce(inside, F.lit(False))))
        at_it = at_it.select("query_id", "_wide", "_narrow", F.col(key).alias("_key"), F.coalesce(inside, F.lit(False)).alias("_in"), (d == F.col("_wide")).alias("_at"))
        best = at_it.groupBy("query_id", "_wide", "_narrow").agg(F.min(F.when(F.col("_in"), F.col("_key"))).alias("n"), F.min(F.when(F.col("_at"), F.col("_key"))).alias("w"))
        one = lambda distance, match: F.when(F.col(match).isNotNull(), F.struct(F.col(distance).alias("distance"), F.col(match).alias("match")))
        return best.select("query_id", one("_narrow", "n").alias("narrow"), one("_wide", "w").alias("wide"))

    held, at, found = staged(queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(max(blocks, 1)))), "queries"), place(spark, "matches"), None
    for b in range(max(blocks, 1)):
        found = nearest(held.where(F.col("_block") == b).drop("_block"))
        if blocks > 1:
            found.write.mode("append").parquet(at)
    found = spark.read.schema(found.schema).parquet(at) if blocks > 1 else found
    return _told(queries, found, least)


def _told(queries: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """The narrow match if it is near enough, else the wide one if that is, for every query. found: query_id, narrow and wide (structs of distance and match)."""
    told = lambda s: F.struct(F.col(f"{s}.match").alias("match"), cosine_of_l2(F.col(f"{s}.distance")).alias("similarity"), F.lit(s).alias("scope"))
    good = F.when(cosine_of_l2(F.col("narrow.distance")) >= least, told("narrow")).when(cosine_of_l2(F.col("wide.distance")) >= least, told("wide"))
    return queries.select("query_id").join(found, "query_id", "left").withColumn("_x", good).select("query_id", "_x.match", "_x.similarity", "_x.scope")
