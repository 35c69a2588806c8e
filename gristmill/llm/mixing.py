"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are dealt into blocks by a seeded hash; the blocks in order of their number are a random permutation of the source in
blocks. A source that gives t times its size gives every block floor(t) times and, once more, the leading blocks up to its
target. These draws are exact quotas: a binary tree over the output shards splits the vector of quotas at each node by a
multivariate hypergeometric draw, and each shard takes the next draws of each source, disjoint from all others, and shuffles
them by a hash of its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import WORD
from gristmill.session import staged

#: Blocks of one source at most, and rows that a block is meant to have at least. The block at a source's edge is cut once more, into so many parts at most.
BLOCKS, BLOCK_ROWS = 4096, 16
#: Up to so many blocks, of some 50 bytes each, the table of blocks is broadcast; beyond, it is joined like any other.
FEW_BLOCKS = 200_000
PLANNED = ["doc_id", "source", "size", "source_size", "target", "copies", "taken", "shards", "shuffle_keys"]
#: The tree's vectors have a number for each source; more sources than this are refused.
MOST_SOURCES = 1_000_000


def water_filled(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Targets in proportion to the weights that sum to total; none above `most` times its size, the excess shared again among the others."""
    limit = np.array(sizes, float) * most
    out, w = np.zeros(len(sizes)), np.array(weights, float)
    open_ = limit > 0
    left = min(float(total), float(limit.sum()))
    while open_.any():
        want = left * w / w[open_].sum()
        over = open_ & (want >= limit)
        if not over.any():
            out[open_] = want[open_]
            break
        out[over] = limit[over]
        left -= limit[over].sum()
        open_ &= ~over
    return out.tolist()


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """quotas: draws of each source. Returns sources x shards; rows sum to the quotas, and columns are as near equal as whole numbers allow."""
    if shards == 1:
        return quotas[:, None]
    left = shards // 2
    share = (int(quotas.sum()) * left + shards // 2) // shards
    got = rng.multivariate_hypergeometric(quotas, share, method="marginals") if quotas.sum() else np.zeros_like(quotas)
    return np.concatenate([split_quotas(got, left, rng), split_quotas(quotas - got, shards - left, rng)], axis=1)


def mix_plan(df: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, shards: int = 16, seed: int = 0, key: str = "doc_id", text: str = "text", source: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """For each row of df: doc_id, source, size, source_size, target, copies (times the mix takes it), taken, shards (one for each copy), shuffle_keys (each copy's place in its shard goes by them).

    size is the number of words; a null text has none. Sources go by code point, null last (a source of its own), and weigh `weights`, repeating. Whole documents are taken, so a source misses its target by
    less than its last document. Nothing depends on how rows are stored: a row's block and order follow from key and text
    alone, and rows that repeat both come in any order, being alike. Empty documents follow their block. An empty table gives none. keep: columns of df to carry along; a name that the plan has itself is an error.
    """
    spark = df.sparkSession
    if clash := sorted(set(keep) & set(PLANNED)):
        raise ValueError(f"the plan has columns of its own named {', '.join(clash)}")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = staged(df.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("doc_id"), F.col(source).alias("source"), F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(F.lit(seed), F.col(key), body).alias("_h"), *[F.col(c).alias(f"_kept_{c}") for c in keep]), "sized")
    found = sorted(rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sizes = [r["size"] for r in found]
    targets = water_filled(sizes, [weights[i % len(weights)] for i in range(len(found))], share * sum(sizes), most)
    full = [min(most, int(t // s)) if s else 0 for s, t in zip(sizes, targets, strict=True)]
    schema = "_s int, source string, source_size long, target double, _full int, _blocks int"
    plan = spark.createDataFrame([(i, r["source"], r["size"], t, f, max(1, min(BLOCKS, r["n"] // BLOCK_ROWS))) for i, (r, t, f) in enumerate(zip(found, targets, full, strict=True))], schema)
    few = sum(max(1, min(BLOCKS, r["n"] // BLOCK_ROWS)) for r in found) <= FEW_BLOCKS  # as many sources or fewer
    dealt = rows.join(F.broadcast(plan) if few else plan, rows["source"].eqNullSafe(plan["source"])).drop(plan["source"]).withColumn("_block", F.pmod(F.shiftright("_h", 20), F.col("_blocks")).cast("int"))

    # blocks in order: whole ones below the target, and one at its edge, of which the leading documents go
    blocks = dealt.groupBy("_s", "_block").agg(F.sum("size").alias("_size"), F.first("target").alias("_t"), F.first("source_size").alias("_all"), F.first("_full").alias("_f"))
    blocks = staged(_at_edge(blocks.withColumn("_room", F.col("_t") - F.col("_f") * F.col("_all")), "_block"), "blocks")
    quotas = {r["_s"]: r["q"] for r in blocks.groupBy("_s").agg(F.count_if(F.col("_whole") | F.col("_edge")).alias("q")).collect()}
    # draws of each source: `full` rounds of all its blocks, then the leading ones; each shard's are consecutive
    counts = [f * p["_blocks"] + quotas.get(p["_s"], 0) for f, p in zip(full, plan.collect(), strict=True)]
    ends = np.cumsum(split_quotas(np.array(counts, np.int64), shards, np.random.default_rng(seed)), axis=1) if counts else np.zeros((0, shards), np.int64)
    held = spark.sparkContext.broadcast(ends)  # sources x shards numbers; the sources are bounded above

    @F.pandas_udf("array<int>")
    def shards_of(s: pd.Series, block: pd.Series, n: pd.Series, copies: pd.Series) -> pd.Series:
        return pd.Series([[int(np.searchsorted(held.value[a], c * k + b, "right")) for c in range(m)] for a, b, k, m in zip(s, block, n, copies, strict=True)])

    drawn = lambda x: dealt.join(F.broadcast(x.drop("_size")) if few else x.drop("_size"), ["_s", "_block"])
    # the block at the edge, one for each source at most, is cut again in the same way, and only the keys of one part of it are put in order
    edge = drawn(blocks.where("_edge")).select("_row", "_s", "_h", "doc_id", "size", "_room", F.col("_h").bitwiseAND(BLOCKS - 1).alias("_part"))
    parts = staged(_at_edge(edge.groupBy("_s", "_part").agg(F.sum("size").alias("_size"), F.first("_room").alias("_room")), "_part"), "parts")
    edge = edge.drop("_room").join(F.broadcast(parts.drop("_size")) if few else parts.drop("_size"), ["_s", "_part"])
    upto = F.sum("size").over(Window.partitionBy("_s").orderBy("_h", "doc_id", "size", "_row").rowsBetween(Window.unboundedPreceding, 0))
    # a document goes if that brings the source nearer to its target
    last = edge.where("_edge").withColumn("_upto", upto).where(F.col("_upto") - F.col("size") / 2 <= F.col("_room"))
    more = edge.where("_whole and not _edge").select("_row").unionByName(last.select("_row")).withColumn("_more", F.lit(1))
    edge = drawn(blocks.where("_edge")).join(more, "_row", "left").withColumn("_more", F.coalesce("_more", F.lit(0)))
    copies = F.least((F.col("_full") + F.col("_more")).cast("int"), F.lit(most))
    out = drawn(blocks.where("not _edge")).withColumn("_more", F.col("_whole").cast("int")).unionByName(edge).withColumn("copies", copies).withColumn("shards", shards_of("_s", "_block", "_blocks", "copies"))
    keys = F.transform("shards", lambda shard, i: F.xxhash64(F.lit(seed), F.col("doc_id"), i, shard))
    return out.withColumns({"taken": F.col("size") * F.col("copies"), "shuffle_keys": keys}).select(*PLANNED, *[F.col(f"_kept_{c}").alias(c) for c in keep])


def _at_edge(blocks: DataFrame, order: str) -> DataFrame:
    """blocks with _room (what is left for a block after those before it), _whole (it fits) and _edge (a part of it fits); _room: of their source. A source has BLOCKS rows here at most."""
    before = F.sum("_size").over(Window.partitionBy("_s").orderBy(order)) - F.col("_size")
    room = F.col("_room")
    return blocks.withColumn("_room", room - before).select("_s", order, "_size", "_room", (room >= F.col("_size")).alias("_whole"), ((room > 0) & (room < F.col("_size"))).alias("_edge"))


def mixed(plan: DataFrame) -> DataFrame:
    """A row for each copy, with its shard and the key by which the shard is shuffled."""
    return plan.select("*", F.posexplode(F.arrays_zip("shards", "shuffle_keys")).alias("copy", "_x")).select("*", F.col("_x.shards").alias("shard"), F.col("_x.shuffle_keys").alias("shuffle_key")).drop("shards", "shuffle_keys", "_x")


def shuffled(plan: DataFrame) -> DataFrame:
    """The copies dealt out shard after shard and, within a shard, sorted by their shuffle key; a shard may have several partitions, each a range of keys."""
    return mixed(plan).repartitionByRange("shard", "shuffle_key").sortWithinPartitions("shard", "shuffle_key")


def write_mix(plan: DataFrame, path: str) -> None:
    """Writes the mix, a folder for each shard, its rows in shuffled order."""
    shuffled(plan).write.partitionBy("shard").parquet(path)
