"""Session helpers: shipping the package to executors and staging tables in the shared folder."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_own: list[str] = []


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python workers this package, whatever folder the driver was started in."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    at = Path(tempfile.mkdtemp(prefix="gristmill-"), f"gristmill-{uuid.uuid4().hex[:8]}.zip")
    at.write_bytes(held.getvalue())
    atexit.register(shutil.rmtree, at.parent, True)
    spark.sparkContext.addPyFile(str(at))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may fall back to a folder of this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="gristmill-shared-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return f"file://{_own[0]}"


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df, written as Parquet in the shared folder and read again: lineage is cut and a lost executor costs nothing that was written."""
    spark = df.sparkSession
    at = place(spark, name)
    df.write.option("compression", codec).parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """df, dealt out to all tasks before costly work: a file of few row groups is few tasks, whatever its size and its number of splits."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def local_session(cpus: int | None = None, partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench."""
    b = SparkSession.builder.master(f"local[{cpus or os.cpu_count()}]").config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.sql.adaptive.enabled": "true", "spark.ui.showConsoleProgress": "false", **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()
