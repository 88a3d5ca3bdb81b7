"""Work folder and sizes shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifold.session import stage

#: Words, as every operator here takes them (ASCII white space parts them).
WORD = r"[^\x20\x09-\x0D]+"
#: White space between words.
GAP = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Most rows of a batch between Spark and Python: texts may be long, and the usual ten thousand would not be bounded.
BATCH_ROWS = 1000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """``df``, with its session set to batches of ``BATCH_ROWS`` rows where it has larger ones."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH_SETTING)) <= BATCH_ROWS:
        conf.set(_BATCH_SETTING, str(BATCH_ROWS))
    return df


def text_size(docs: DataFrame) -> tuple[int, int]:
    """Rows and bytes of text, one aggregate."""
    row = docs.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")
    ).first()
    return row["n"], row["b"]


__all__ = ["GAP", "WORD", "bounded", "documents", "stage", "text_size"]
