"""The usage journal and record changes as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from gristmill.operators.rollups import normalized_usage


def journal_stream(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Entries of new JSON files under a folder, with their token counts under one name."""
    return normalized_usage(spark.readStream.schema(schema).json(path))


def append_journal(entries: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what has come, once; a restart goes on where the checkpoint ends."""
    return entries.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_usage(entries: DataFrame, window: str = "1 hour", late: str = "1 day", at: str = "created_at") -> DataFrame:
    """Tokens by window and model; entries that come later than `late` are left out, so state stays bounded."""
    return entries.withWatermark(at, late).groupBy(F.window(at, window), "model").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the snapshots that were written whole."""
    on = spark._jvm.org.apache.hadoop.fs.Path
    fs = on(path).getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(on(path)) if fs.exists(on(s.getPath(), "_SUCCESS"))) if fs.exists(on(path)) else []


def snapshot(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The last whole snapshot; empty before the first one."""
    held = _versions(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/v{held[-1]}") if held else spark.createDataFrame([], schema)


def latest_by_key(changes: DataFrame, path: str, checkpoint: str, keys: list[str], order: str, keep: int = 2) -> StreamingQuery:
    """Keeps the newest row of each key as a snapshot: each batch is merged with the snapshot before it and written as the next one; of equal rows by `order` the greater one stays.

    The last `keep` snapshots stay, so that a reader, or a batch that is run again, finds the one before. A snapshot is written whole, which suits keyed state that is small beside its changes.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark, rest = batch.sparkSession, [c for c in batch.columns if c not in (*keys, order)]
        held = [n for n in _versions(spark, path) if n < number]
        both = batch if not held else batch.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/v{held[-1]}"))
        both.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("x")).select(*keys, "x.*").select(*batch.columns).write.mode("overwrite").parquet(f"{path}/v{number}")
        on = spark._jvm.org.apache.hadoop.fs.Path
        for old in held[: max(0, len(held) + 1 - keep)]:
            at = on(f"{path}/v{old}")
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
