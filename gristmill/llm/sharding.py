"""Reproducible shards from a Feistel permutation of global row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import numbered

ROUNDS = 8


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser of multiplications and shifts."""
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(seed: int) -> list[int]:
    return [int(k) for k in _mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), seed & (2**64 - 1))]


def _walk(x: np.ndarray, n: int, keys: list[int], back: bool) -> np.ndarray:
    """Rounds over the least even number of bits that hold n numbers; what falls at n or beyond goes round again."""
    bits = np.uint64(max(1, -(-max(1, (n - 1).bit_length()) // 2)))
    mask = (np.uint64(1) << bits) - np.uint64(1)
    out, open_ = x.astype(np.uint64), np.ones(len(x), bool)
    while open_.any():
        v = out[open_]
        left, right = v >> bits, v & mask
        for k in reversed(keys) if back else keys:
            left, right = (right ^ (_mixed(left, k) & mask), left) if back else (right, left ^ (_mixed(right, k) & mask))
        out[open_] = v = (left << bits) | right
        open_[open_] = v >= np.uint64(n)
    return out.astype(np.int64)


def permuted(x: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The place of each row number in a permutation of 0 to n - 1."""
    return _walk(x, n, _keys(seed), False)


def unpermuted(y: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The row number at each place; permuted() turned back."""
    return _walk(y, n, _keys(seed), True)


def place_of(row: np.ndarray, n: int, shards: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot from row number and number of rows alone."""
    p = permuted(row, n, seed)
    return p % shards, p // shards


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int, seed: int = 0) -> np.ndarray:
    return unpermuted(np.asarray(slot) * shards + shard, n, seed)


def shard_documents(df: DataFrame, shards: int = 16, seed: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of df: doc_id, size, text_crc32, row_number, shard, slot.

    Rows are numbered by key (nulls last), then by checksum and size of the text, so the same rows get the same places however they
    are stored; rows equal in all three are alike and take their places in any order. Counts of shards are at most one apart
    and slots leave no gap. A null text has size 1 (no bytes, plus 1) and the checksum of the empty text. An empty table gives
    none. Other columns of df are not read.
    """
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows, n = numbered(df.select(F.col(key).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32")), ["doc_id", "text_crc32", "size"], "row_number")

    @F.pandas_udf("long")
    def placed(x: pd.Series) -> pd.Series:
        return pd.Series(permuted(x.to_numpy(), n, seed))

    return rows.withColumn("_p", placed("row_number")).select("doc_id", "size", "text_crc32", "row_number", F.pmod("_p", F.lit(shards)).cast("int").alias("shard"), F.expr(f"_p div {shards}").alias("slot"))
