"""What several operators share."""

from __future__ import annotations

import ctypes
import re
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.session import place, staged

#: A word of the contracts: a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = re.compile(r"[\x20\x09-\x0D]+")
_TO_SPACE = {c: " " for c in range(9, 14)}


def words(text: str | None) -> list[str]:
    """The words of a text, unchanged."""
    if not text:
        return []
    return [w for w in text.translate(_TO_SPACE).split(" ") if w] if any(c in text for c in "\t\v\f\r") else [w for w in text.replace("\n", " ").split(" ") if w]


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser of multiplications and shifts; different values stay different."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of UTF-8 texts, text after text, and the number of words of each text.

    Words are found and hashed on the bytes, eight at a time for all words at once; very long ones are hashed one by one.
    """
    buf = b" ".join(texts) + b" " + bytes(8)
    n = len(buf) - 8
    turn = np.diff(_BLANK[np.frombuffer(buf, np.uint8, n)].view(np.int8), prepend=np.int8(1))
    start, end = np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)
    length = end - start
    eight = np.ndarray((n,), "<u8", buf, 0, (1,))  # the eight bytes from every byte on
    h = mixed_bits((eight[start] & _MASK[np.minimum(length, 8)]) + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    live, done = np.flatnonzero((length > 8) & (length <= 1024)), 8
    while len(live):
        h[live] = mixed_bits(h[live] * np.uint64(0xD6E8FEB86659FD93) + (eight[start[live] + done] & _MASK[np.minimum(length[live] - done, 8)]))
        done += 8
        live = live[length[live] > done]
    for i in np.flatnonzero(length > 1024):
        h[i] = xxhash.xxh64_intdigest(buf[start[i] : end[i]])
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return h, np.diff(np.searchsorted(start, ends), prepend=0)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else. Where all characters are ASCII, lower() does just that."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


class Memo:
    """Values by word, computed in batches. Two generations of at most `limit` words (or one batch's): a word that is asked for again moves to the younger."""

    alive: ClassVar[weakref.WeakSet[Memo]] = weakref.WeakSet()

    def __init__(self, compute: Callable[[list[str]], Iterable], limit: int = 300_000):
        self.compute, self.limit, self.held, self.old = compute, limit, {}, {}
        Memo.alive.add(self)

    def of(self, wanted: set[str] | list[str]) -> dict:
        """A value for each of the wanted words, which are different."""
        missing = [w for w in wanted if w not in self.held]
        if missing and len(self.held) + len(missing) > self.limit:
            self.old, self.held, missing = self.held, {}, list(wanted)
        if missing:
            self.held.update({w: self.old[w] for w in missing if w in self.old})
            new = [w for w in missing if w not in self.held]
            self.held.update(zip(new, self.compute(new), strict=True))
        return self.held


def release() -> None:
    """Gives back a task's memory at its end: workers are used again, and what each operator leaves in them would add up."""
    for m in Memo.alive:
        m.held, m.old = {}, {}
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc keeps freed pages otherwise
        trim(0)


def slices(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in stretches of rows that have about `most` bytes in a column (but for one larger row)."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    edges = np.r_[0, np.flatnonzero(np.diff(np.cumsum(size, dtype=np.int64) // most)) + 1, len(size)]
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def bucketed(df: DataFrame, by: str, name: str) -> DataFrame:
    """df as Parquet in the shared folder, bucketed by a column, so that later joins by it leave its rows where they are.

    The catalog's entry goes as soon as it is read: the frame holds the files and their buckets itself.
    """
    spark, held = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", place(spark, name)).option("compression", "zstd").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).saveAsTable(held)
    out = spark.table(held)
    spark.sql(f"DROP TABLE {held}")
    return out


def joined_to_each(rows: DataFrame, told: DataFrame, on: list[str], n: str = "n") -> DataFrame:
    """rows with the columns of told, which has a row for each key and in `n` how many of the rows have it; rows without one keep nulls.

    Keys of many rows are few, less than four for each shuffle partition, and are broadcast; what is shuffled has no hot key.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = (told.agg(F.sum(n).alias("s")).first()["s"] or 0) // (4 * parts) + 1
    hot = F.broadcast(staged(told.where(F.col(n) >= share).drop(n), "hot"))
    return rows.join(hot, on).unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(told.drop(n), on, "left"))


def numbered(df: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """df with a global row number from 0 in the given order, and the number of rows.

    Range partitions are sorted and written once; then each partition's first number is the sum of the counts before it, so
    no task sees more than its range and the counts alone (a row for each partition) meet in one place.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = staged(df, "unnumbered")  # else df is computed twice, once for the ranges' bounds
    held = staged(df.repartitionByRange(parts, *[F.col(c).asc_nulls_last() for c in order]).sortWithinPartitions(*[F.col(c).asc_nulls_last() for c in order]).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = held.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    first = counts.select("_part", "_n", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_first"))
    total = held.count()
    return held.withColumn("_part", part).join(F.broadcast(first.drop("_n")), "_part").withColumn(name, F.col("_first") + within).drop("_part", "_at", "_first"), total
