"""Exact dedup by a persistent digest index.

The index is a table with one row for each digest, bucketed and sorted by digest. A batch is reduced to one row for each
digest, anti-joined with the index by sort and merge, and what is left is appended; a second table, bucketed alike, holds how many rows of each batch
had a digest. Later batches are held against all that came before; texts never enter the index.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import joined_to_each, lower_ascii
from gristmill.session import place, staged

SCHEMAS = {"digests": "digest STRING, keep_id BIGINT", "counts": "digest STRING, n BIGINT, batch STRING"}


class DigestIndex:
    """Digests seen so far, with the key that stays and how many rows had them. path: an index that is there, or a place for a new one.

    Two tables of the catalog stand for the files while the index is open; close() takes these entries back, and the files stay.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.path, self.id = spark, path or place(spark, "digests"), uuid.uuid4().hex
        if path and self._fs(f"{path}/about").exists(self._at(f"{path}/about")):
            self.buckets, self.version = spark.read.parquet(f"{path}/about").select("buckets", "version").first()
        else:
            self.buckets, self.version = buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), 0
            self._write_about()
        self._open()

    def _at(self, path: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):  # noqa: ANN202
        return self._at(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _write_about(self) -> None:
        self.spark.createDataFrame([(self.buckets, self.version)], "buckets int, version int").write.mode("overwrite").parquet(f"{self.path}/about")

    def _name(self, kind: str) -> str:
        return f"{kind}_{self.id}_{self.version}"

    def _open(self) -> None:
        for kind, schema in SCHEMAS.items():
            self.spark.sql(f"CREATE TABLE {self._name(kind)} ({schema}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/v{self.version}/{kind}'")

    def close(self) -> None:
        """Takes the catalog's entries back; frames that were read stay good."""
        for kind in SCHEMAS:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(kind)}")

    @contextmanager
    def _alone(self) -> Iterator[None]:
        """One writer at a time: a second one is an error. The file of a writer that died has to be removed by hand."""
        lock = f"{self.path}/lock"
        if not self._fs(lock).createNewFile(self._at(lock)):
            raise RuntimeError(f"another writer has {lock}; if it died, remove that file")
        try:
            yield
        finally:
            self._fs(lock).delete(self._at(lock), False)

    def _append(self, df: DataFrame, kind: str) -> None:
        # one task writes each bucket, so that a bucket is one sorted file for each batch
        df.repartition(self.buckets, "digest").write.insertInto(self._name(kind))

    def add(self, digests: DataFrame, batch: str | None = None) -> DataFrame:
        """Appends the digests that are new and returns them. digests: digest, keep_id, n; a row for each digest.

        batch names what is added: a batch that is added again, as after a failure, changes nothing. Without a name it counts as new data.
        """
        batch = batch or uuid.uuid4().hex
        with self._alone():
            known = self.spark.table(self._name("digests")).select("digest").hint("merge")
            fresh = staged(digests.select("digest", "keep_id").join(known, "digest", "left_anti"), "fresh")
            self._append(fresh, "digests")
            if self.spark.table(self._name("counts")).where(F.col("batch") == batch).isEmpty():
                self._append(digests.select("digest", "n", F.lit(batch).alias("batch")), "counts")
        return fresh

    def scan(self) -> DataFrame:
        """digest, keep_id, group_size. The tables' buckets meet where they lie."""
        n = self.spark.table(self._name("counts")).groupBy("digest").agg(F.sum("n").alias("group_size"))
        return self.spark.table(self._name("digests")).join(n.hint("merge"), "digest")

    def compact(self) -> None:
        """Writes each bucket's files of many batches as one sorted file. The old files stay until the folder is cleared, for those who read them."""
        with self._alone():
            held = {kind: self.spark.table(self._name(kind)) for kind in SCHEMAS}
            self.close()
            self.version += 1
            self._open()
            for kind, df in held.items():
                self._append(df, kind)
            self._write_about()


def digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the digest of the text with A-Z in lower case; a null text counts as empty."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.sha2(F.encode(lower_ascii(F.coalesce(F.col(text), F.lit(""))), "UTF-8"), 256).alias("digest"))


def dedup(df: DataFrame, index: DigestIndex | None = None, key: str = "doc_id", text: str = "text", batches: int = 1, name: str | None = None) -> DataFrame:
    """For each row of df: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest key stays (a text that the index already had keeps the row that came first, and
    none of df); group_size counts all rows that the index has seen. Null texts equal empty ones. Null keys are smaller than all others and give keep_id null when a group has no
    other; of rows that repeat a key, all count in group_size, and all that hold the kept key are kept. An empty table gives
    none. Other columns of df are not read. batches: df goes through the index in so many ranges of the key, the largest keys first, so that less has to be grouped at once.
    name: of df's batches in the index (see DigestIndex.add).
    """
    spark, own = df.sparkSession, index is None
    index = index or DigestIndex(spark)
    held = staged(digests(df, key, text), "digested")
    cuts = held.agg(F.percentile_approx("doc_id", F.array(*[F.lit(i / batches) for i in range(1, batches)])).alias("c")).first()["c"] if batches > 1 else []
    # null keys, the smallest of all, are in the last range
    at = F.lit(batches - 1) - sum((F.coalesce(F.col("doc_id") >= c, F.lit(False)).cast("int") for c in cuts or []), F.lit(0))
    groups = staged(held.groupBy(at.alias("range"), "digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n")), "groups")
    for i in range(batches):
        index.add(groups.where(F.col("range") == i), name and f"{name}-{i}")
    told = index.scan().join(groups.groupBy("digest").agg(F.sum("n").alias("n")), "digest")
    out = joined_to_each(held, staged(told, "told"), ["digest"])
    if own:
        index.close()
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))
