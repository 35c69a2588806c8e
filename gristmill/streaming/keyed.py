"""Keyed state that follows a stream, in buckets: a micro-batch reads and writes the buckets that its keys fall into and leaves the files of all others alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from gristmill.sources.records import delete_path, whole_versions


def _bucket(keys: list[str], buckets: int):  # noqa: ANN202
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


class KeyedStore:
    """The newest row of each key by `order`, with `first_<order>` (when the key was first seen) and `changes` (how many rows it had).

    A version is a table of which bucket stands where: a row for each bucket, written after the buckets themselves, so that a reader, or a batch that is
    run again after a failure, finds the version before as it was. Rows that come late change no newer row; of equal rows by `order` the greater stays, so
    any order of arrival gives the same state. The last `keep` versions stay readable.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], order: str, buckets: int = 64, keep: int = 2):
        self.spark, self.path, self.keys, self.order, self.buckets, self.keep = spark, path.rstrip("/"), keys, order, buckets, keep
        self.columns = [f.name for f in schema.fields]
        self.schema = StructType([*schema.fields]).add(f"first_{order}", schema[order].dataType).add("changes", "long")

    def _standing(self, before: int | None = None) -> dict[int, int]:
        """Of each bucket the batch that wrote it, in the last version (before a batch)."""
        held = [v for v in whole_versions(self.spark, f"{self.path}/versions") if before is None or v < before]
        return {r["bucket"]: r["batch"] for r in self.spark.read.parquet(f"{self.path}/versions/v{held[-1]}").collect()} if held else {}

    def _read(self, standing: dict[int, int], only: set[int] | None = None) -> DataFrame:
        """Rows of buckets, a read for each batch that some of them stand in."""
        out = self.spark.createDataFrame([], self.schema)
        for batch in sorted(set(standing.values())):
            own = [f"{self.path}/data/v{batch}/_b={b}" for b, v in sorted(standing.items()) if v == batch and (only is None or b in only)]
            if own:
                out = out.unionByName(self.spark.read.schema(self.schema).parquet(*own))
        return out

    def read(self) -> DataFrame:
        return self._read(self._standing())

    def merge(self, rows: DataFrame, number: int) -> None:
        """Takes up a batch of changes. The same number again does nothing anew: it starts from the version before and writes the same rows."""
        rest = [c for c in self.columns if c not in (*self.keys, self.order)]
        first, newest = f"first_{self.order}", F.max(F.struct(self.order, *rest)).alias("_x")
        came = rows.groupBy(*self.keys).agg(newest, F.min(self.order).alias(first), F.count("*").alias("changes")).select(*self.keys, "_x.*", first, "changes")
        came = came.withColumn("_b", _bucket(self.keys, self.buckets)).persist()
        try:
            touched = {r["_b"] for r in came.select("_b").distinct().collect()}  # at most `buckets` numbers
            standing = self._standing(number)
            if touched:
                held = self._read(standing, touched).withColumn("_b", _bucket(self.keys, self.buckets))
                both = came.unionByName(held).groupBy("_b", *self.keys).agg(newest, F.min(first).alias(first), F.sum("changes").alias("changes")).select("_b", *self.keys, "_x.*", first, "changes")
                parts = min(len(touched), int(self.spark.conf.get("spark.sql.shuffle.partitions")))
                both.repartition(parts, "_b").write.mode("overwrite").partitionBy("_b").parquet(f"{self.path}/data/v{number}")
            now = standing | dict.fromkeys(touched, number)
            self.spark.createDataFrame(sorted(now.items()), "bucket int, batch long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/versions/v{number}")
        finally:
            came.unpersist()
        self._forget()

    def _forget(self) -> None:
        """Drops versions beyond the last `keep`, and the buckets that none of these names."""
        held = whole_versions(self.spark, f"{self.path}/versions")
        named = {(r["bucket"], r["batch"]) for v in held[-self.keep :] for r in self.spark.read.parquet(f"{self.path}/versions/v{v}").collect()}
        for v in held[: -self.keep]:
            for r in self.spark.read.parquet(f"{self.path}/versions/v{v}").collect():
                if (r["bucket"], r["batch"]) not in named:
                    delete_path(self.spark, f"{self.path}/data/v{r['batch']}/_b={r['bucket']}")
            delete_path(self.spark, f"{self.path}/versions/v{v}")

    def follow(self, changes: DataFrame, checkpoint: str) -> StreamingQuery:
        """Takes up what has come since the last run, batch by batch, and ends."""
        return changes.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
