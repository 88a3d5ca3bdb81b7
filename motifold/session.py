"""Session defaults, the shared work folder and measured broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: SQL settings the operators are written for.  All but the forced skew join are
#: Spark defaults; they are listed so that a cluster profile can be checked.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key even if the split costs one more shuffle afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

#: A side measured at or below this many bytes of text may be broadcast.
BROADCAST_BYTES = 32 * 1024 * 1024

_local_work: dict[str, str] = {}


def local_session(
    name: str, cores: str = "*", partitions: int = 8, settings: dict[str, str] | None = None
) -> SparkSession:
    """A single-JVM session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in {**RECOMMENDED, **(settings or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temp folder in local mode only."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_work:
        _local_work[app] = tempfile.mkdtemp(prefix="motifold-")
    return _local_work[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the work folder."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the written table.

    Used where later steps must all see one and the same evaluation, also after
    the loss of an executor.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(df: DataFrame) -> int:
    """Measured size: total bytes of all columns cast to text, one aggregate."""
    row = F.lit(0)
    for name in df.columns:
        row = row + F.coalesce(F.octet_length(F.col(f"`{name}`").cast("string")), F.lit(0))
    return df.agg(F.coalesce(F.sum(row + F.lit(8)), F.lit(0)).alias("b")).first()["b"]


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` if its measured size allows it, else leave the join to Spark."""
    return F.broadcast(df) if text_bytes(df) <= max_bytes else df
