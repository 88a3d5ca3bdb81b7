"""Node ids that continue over several inputs: a dictionary that is only ever appended to.

``ids/batch=N`` holds (id, uri) rows and ``heads/batch=N`` the first id and number of the batch.  The head is written last, as
one file; rows without a head do not count and are written again by the next append.  An id is never
changed, so tables encoded earlier stay valid.  One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.keys import assign_dense_ids, known_ids
from ..session import stage

_HEAD = "first bigint, n bigint, batch int"


def _heads(spark: SparkSession, path: str) -> list:
    """One row per batch."""
    try:
        return spark.read.schema(_HEAD).parquet(f"{path}/heads").collect()
    except AnalysisException:  # nothing written yet
        return []


def open_ids(spark: SparkSession, path: str) -> DataFrame:
    """``(id, uri)`` of all nodes of the dictionary; none where there is no dictionary yet."""
    batches = [r["batch"] for r in _heads(spark, path)]
    if not batches:
        return spark.createDataFrame([], "id bigint, uri string")
    rows = spark.read.schema("id bigint, uri string, batch int").parquet(f"{path}/ids")
    return rows.where(F.col("batch").isin(batches)).select("id", "uri")


def next_free_id(spark: SparkSession, path: str, start: int = 0) -> int:
    """The first id that no node has, from the heads alone."""
    return max((r["first"] + r["n"] for r in _heads(spark, path)), default=start)


def append_ids(nodes: DataFrame, path: str, start: int = 0) -> DataFrame:
    """``(id, uri)`` of all ``nodes``: those of the dictionary keep their id, the others are numbered on and added.

    New ids follow the order of the new uris, so the same inputs in the same order give the same ids, and appending
    known nodes adds nothing.  ``start`` is the first id of an empty dictionary.
    """
    spark = nodes.sparkSession
    wanted = stage(nodes.select(F.col("node").alias("uri")).distinct(), "nodes")
    known = stage(known_ids(open_ids(spark, path), wanted), "known-ids")
    fresh = wanted.join(known, "uri", "left_anti").select(F.col("uri").alias("node"))
    heads = _heads(spark, path)
    first = max((r["first"] + r["n"] for r in heads), default=start)
    number = max((r["batch"] for r in heads), default=-1) + 1
    own = f"{path}/ids/batch={number}"
    assign_dense_ids(fresh, first).write.mode("overwrite").parquet(own)
    added = spark.read.schema("id bigint, uri string").parquet(own)
    n = added.count()
    if n:
        head = spark.range(1).select(F.lit(first).cast("bigint").alias("first"), F.lit(n).cast("bigint").alias("n"))
        head.write.mode("overwrite").parquet(f"{path}/heads/batch={number}")
    return known.unionByName(added)
