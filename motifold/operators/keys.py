"""Numeric node ids."""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

_ROW_BITS = 33  # low bits of monotonically_increasing_id count rows in a partition


def assign_ids(nodes: DataFrame, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """``(id, uri)`` with a hash id: unique, not dense, stable across runs.

    The ids are written once and checked: two nodes with one hash raise ``ValueError``, and
    ``assign_dense_ids`` is the way for such node sets.
    """
    ids = stage(nodes.select(hashed(F.col("node")).alias("id"), F.col("node").alias("uri")), "ids")
    if not id_collisions(ids).isEmpty():
        raise ValueError("two nodes have one hash id: use assign_dense_ids")
    return ids


def id_collisions(ids: DataFrame) -> DataFrame:
    """``(id, n)`` of ids that stand for more than one uri."""
    return ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def assign_dense_ids(nodes: DataFrame, start: int = 0) -> DataFrame:
    """``(id, uri)`` with ids ``start, start + 1, ...`` in uri order.

    Range partitioning sorts in parallel; a row's id is its place in its range
    plus the sizes of the ranges before.  Ranges come from a sample, so the
    numbered rows are written once and everything after reads that table: a
    lost executor cannot change an id.  Offsets are one row per range.
    """
    placed = stage(
        nodes.select(F.col("node").alias("uri"))
        .repartitionByRange("uri")
        .sortWithinPartitions("uri")
        .select("uri", F.monotonically_increasing_id().alias("place")),
        "node-order",
    ).select(
        "uri",
        F.shiftright("place", _ROW_BITS).alias("range"),
        F.col("place").bitwiseAND((1 << _ROW_BITS) - 1).alias("row"),
    )
    # One row per range, whatever the number of nodes.
    sizes = placed.groupBy("range").agg(F.count("*").alias("size")).orderBy("range").collect()
    before = accumulate((r["size"] for r in sizes), initial=start)
    offsets = nodes.sparkSession.createDataFrame(
        [(r["range"], offset) for r, offset in zip(sizes, before, strict=False)],
        "range bigint, offset bigint",
    )
    return placed.join(F.broadcast(offsets), "range").select(
        (F.col("offset") + F.col("row")).alias("id"), "uri"
    )


def known_ids(existing: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(id, uri)`` of the nodes (column ``uri``) that ``existing`` already has.

    A semi join from the large side: at most as many rows as ``nodes`` has leave it, and Spark can broadcast a
    small node table or send its bloom filter to the scan.
    """
    return existing.join(nodes.select("uri"), "uri", "left_semi").select("id", "uri")


def extend_ids(existing: DataFrame, nodes: DataFrame, start: int = 0) -> DataFrame:
    """``(id, uri)`` of the nodes that ``existing`` does not have, numbered on after its highest id.

    The ids of ``existing`` are left as they are, so its rows and these together are the ids of both inputs.
    ``start`` counts where ``existing`` is empty.
    """
    wanted = stage(nodes.select(F.col("node").alias("uri")).distinct(), "nodes")
    fresh = wanted.join(known_ids(existing, wanted), "uri", "left_anti")
    first = next_id(existing, start).first()["next_id"]
    return assign_dense_ids(fresh.select(F.col("uri").alias("node")), first)


def next_id(vertices: DataFrame, start: int = 0) -> DataFrame:
    """First free id after ``vertices`` as column ``next_id``; ``start`` if there are none."""
    return vertices.agg(F.coalesce(F.max("id") + 1, F.lit(start)).alias("next_id"))
