"""Readers and writers of batches, records, manifests and staged payloads."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.documents import parsed, unwrapped_value

BATCH = "url string, title string, status string, pa double, da double, rank int"


def read_batch(spark: SparkSession, path: str) -> DataFrame:
    """A batch file in either shape: an object by URL whose scores are {value, history}, or a list of flat objects. URLs that aren't http(s) are left out; the status defaults to new."""
    v = parsed(F.col("value"))
    raw = spark.read.text(path, wholetext=True).select(v.alias("v"))
    entries = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.map_values(F.try_variant_get("v", "$", "map<string,variant>")))
    e = raw.select(F.explode(entries).alias("e"))
    text = lambda p: F.try_variant_get("e", p, "string")
    score = lambda p: unwrapped_value(F.try_variant_get("e", p, "variant"))
    return e.select(text("$.url").alias("url"), text("$.title").alias("title"), F.coalesce(text("$.current_status"), text("$.status"), F.lit("new")).alias("status"), score("$.pa").alias("pa"), score("$.da").alias("da"), score("$.rank").cast("int").alias("rank")).where(F.col("url").rlike("^https?://"))


def write_batch(df: DataFrame, path: str) -> None:
    """One JSON object a line; null fields are left out."""
    df.write.json(path, ignoreNullFields=True)


def read_records(spark: SparkSession, path: str, owner: int | None = None) -> DataFrame:
    """Records of one owner, newest first, with their document as VARIANT; rows whose document can't be read are dropped."""
    rows = spark.read.parquet(path)
    rows = rows if owner is None else rows.where(F.col("user_id") == owner)
    return rows.withColumn("doc", parsed(F.col("data"))).where(F.col("doc").isNotNull()).orderBy(F.desc("updated_at"))


def routed(personal: DataFrame, master: DataFrame) -> DataFrame:
    """One view of both tables: owner 0 is the master."""
    return master.withColumn("is_master", F.lit(True)).unionByName(personal.withColumn("is_master", F.lit(False)), allowMissingColumns=True)


def find_owner(view: DataFrame, key: Column) -> DataFrame:
    """The record of a key, the master's before a personal one."""
    return view.where(key).orderBy(F.desc("is_master"), "user_id").limit(1)


def append_manifest(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def store_key(url: Column, prefix: str, ext: str = "jpg") -> Column:
    """Where content of a URL is kept: by the hash of the URL."""
    return F.concat(F.lit(f"{prefix}/"), F.left(F.sha2(F.encode(url, "UTF-8"), 256), F.lit(16)), F.lit(f".{ext}"))


def is_safe_key(key: Column) -> Column:
    """Relative, and never up."""
    return ~key.startswith("/") & ~F.array_contains(F.split(key, "/"), "..") & (key != "")


def not_stored(wanted: DataFrame, manifest: DataFrame, key: str = "key") -> DataFrame:
    return wanted.join(manifest.select(key).distinct(), key, "left_anti")


def alive(staged: DataFrame, as_of: Column) -> DataFrame:
    """Staged payloads that haven't expired."""
    return staged.where(F.col("expires_at") >= as_of)


def staged_status(lookup: DataFrame, staged: DataFrame, as_of: Column) -> DataFrame:
    """404 for unknown or expired tokens, 425 while the payload is to come, else 200."""
    j = lookup.join(staged, "token", "left")
    return j.withColumn("code", F.when(F.col("expires_at").isNull() | (F.col("expires_at") < as_of), 404).when(F.col("payload").isNull(), 425).otherwise(200))


def decoded(data: Column) -> Column:
    """An upload as text: UTF-8, else Latin-1; null where it is empty."""
    return F.when(F.octet_length(data) > 0, F.coalesce(F.try_validate_utf8(data.cast("string")), F.decode(data, "ISO-8859-1")))


def dump(tables: dict[str, DataFrame], path: str, derived: tuple[str, ...] = ()) -> dict[str, int]:
    """Writes base tables, leaves out derived ones, and checks that as many rows can be read back; the counts."""
    out = {}
    for name, df in tables.items():
        if name in derived:
            continue
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        out[name] = df.sparkSession.read.parquet(f"{path}/{name}").count()
        if out[name] != df.count():
            raise ValueError(f"{name}: {out[name]} rows were written")
    return out


@dataclass
class Config:
    """Thresholds with defaults; a file may set any of them, keys that start with _ are comments. A missing file is all defaults, a malformed one an error."""

    is_recipe_threshold: int = 7
    min_ou_score: float = 0.0
    min_da_score: float = 30.0
    save_gate_min_ingredients: int = 3
    save_gate_min_instructions: int = 3
    default_top_final: int = 10
    disallowed_domains: list[str] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> Config:
        at = Path(path)
        held = json.loads(at.read_text()) if at.exists() else {}
        names = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in held.items() if k in names})


@dataclass
class Providers:
    """Services outside the engine (search, authority scores, translation, embedding) as functions from tables to tables. The defaults answer nothing."""

    authority: Callable[[DataFrame], DataFrame] = lambda urls: urls.select("url", F.lit(None).cast("double").alias("pa"), F.lit(None).cast("double").alias("da"), F.lit(None).cast("string").alias("provider_title"))
    translate: Callable[[DataFrame], DataFrame] = lambda texts: texts.withColumn("translated", F.lit(None).cast("string"))

    def scored(self, rows: DataFrame) -> DataFrame:
        """rows with pa and da; the provider's title where it has one; drop_reason where it has no score."""
        s = self.authority(rows.select("url").distinct())
        return rows.join(s, "url", "left").withColumn("title", F.coalesce(F.nullif(F.col("provider_title"), F.lit("")), F.col("title"))).drop("provider_title").withColumn("drop_reason", F.when(F.col("pa").isNull(), "authority-unavailable"))


def _hadoop(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what stands in a folder; none if it isn't there."""
    fs, at = _hadoop(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def whole_versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the folders v<number> that were written whole, ascending."""
    return sorted(int(n[1:]) for n in names_in(spark, path) if n[:1] == "v" and n[1:].isdigit() and "_SUCCESS" in names_in(spark, f"{path}/{n}"))


def delete_path(spark: SparkSession, path: str) -> None:
    fs, at = _hadoop(spark, path)
    fs.delete(at, True)


def claim_path(spark: SparkSession, path: str) -> bool:
    """Makes an empty file where none is; False if somebody else did. Stores decide this as one step."""
    fs, at = _hadoop(spark, path)
    try:
        fs.create(at, False).close()
    except Exception as e:
        if "FileAlreadyExists" in str(e) or fs.exists(at):
            return False
        raise
    return True
